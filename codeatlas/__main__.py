"""``python -m codeatlas dump PATH``: the indexed tree as text."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from codeatlas import api


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] != "dump":
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("codeatlas").getOrCreate()
    for row in api.dump(api.index(spark, args[1])).toLocalIterator():
        print(row["line"])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
