"""Scalar functions on literals."""

import pytest
from pyspark.sql import functions as F

from codeatlas.functions import geometry, paths, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("t, n", [("", 0), ("one", 1), ("one\n", 1), ("one\ntwo", 2), ("one\ntwo\n", 2)])
def test_line_count(spark, t, n):
    assert value(spark, text.line_count(F.lit(t))) == n


@pytest.mark.parametrize("path, want", [("Makefile", "make"), ("a/makefile", "make"), ("GNUmakefile", "make"), ("build/rules.mk", "make"), ("Makefile.txt", None), ("GNUMakefile", None), ("MAKEFILE", None), ("rules.mk.bak", None), ("A.PY", "python"), ("x.VERT", "glsl"), ("y.fxh", "hlsl"), ("shader.vs", None), (".gitignore", None)])
def test_language(spark, path, want):
    assert value(spark, paths.language(F.lit(path))) == want


@pytest.mark.parametrize("name, want", [("src", "Source"), ("unit_tests", "Test"), ("Demo-Samples", "Example"), ("ray_shaders", "ShaderAsset"), ("Documentation", "Docs"), ("third_party", "Generated"), ("misc", None)])
def test_folder_role(spark, name, want):
    assert value(spark, paths.folder_role(F.lit(name))) == want


@pytest.mark.parametrize("name, want", [("x_test.rs", "Test"), ("demo.py", "Example"), ("a.PNG", "ShaderAsset"), ("guide.md", "Docs"), ("main.rs", "Source"), ("vendor", "Generated")])
def test_file_role(spark, name, want):
    assert value(spark, paths.file_role(F.lit(name))) == want


@pytest.mark.parametrize("h, w, want", [(3.9, 400, None), (4, 400, "Dot"), (20, 400, "Label"), (80, 400, "Card"), (250, 400, "Detail"), (700, 400, "Full"), (700, 299, "Detail"), (700, 59, "Dot")])
def test_container_rung(spark, h, w, want):
    assert value(spark, geometry.container_rung(F.lit(float(h)), F.lit(float(w)))) == want


@pytest.mark.parametrize("h, w, n, want", [(80, 400, 300, "Minimap"), (80, 400, 200, "Text"), (80, 299.9, 100, "Minimap"), (19, 400, 10, "Dot"), (79, 400, 10, "Label"), (3, 400, 10, None)])
def test_leaf_draw(spark, h, w, n, want):
    assert value(spark, geometry.leaf_draw(F.lit(float(h)), F.lit(float(w)), F.lit(float(n)))) == want


@pytest.mark.parametrize("q, hit", [("prs", True), ("PRS", True), ("xyz", False), ("srp", False), ("", True)])
def test_fuzzy(spark, q, hit):
    assert value(spark, paths.fuzzy_match(q, F.lit("parse_rust_items"))) == hit


def test_fnv(spark):
    assert value(spark, text.fnv1a(F.lit("hello"))) == "a430d84680aabd0b"
    assert value(spark, text.fnv1a(F.lit(""))) == "cbf29ce484222325"


@pytest.mark.parametrize("sig, ext, want", [("fn f() -> Vec<u8>", "rs", "Vec"), ("def f(x) -> int:", "py", "int"), ("function f(a: X): Promise<Y>", "ts", "Promise"), ("fn f()", "rs", None)])
def test_return_type(spark, sig, ext, want):
    assert value(spark, text.return_type(F.lit(sig), F.lit(ext))) == want


@pytest.mark.parametrize("n, want", [(5, "5 B"), (1536, "1.5 KB"), (1 << 20, "1.0 MB"), (3 << 30, "3.0 GB")])
def test_format_bytes(spark, n, want):
    assert value(spark, text.format_bytes(F.lit(n))) == want


@pytest.mark.parametrize("folder, hit", [("b", True), ("a/b", True), ("b/a", False), ("top/a", True), ("x.rs", True)])
def test_in_folder(spark, folder, hit):
    assert value(spark, paths.in_folder(F.lit("a/b/x.rs"), folder, "top")) == hit


@pytest.mark.parametrize("n, want", [(256, "256 B"), (1280, "1.2 KB"), (1792, "1.8 KB"), ((1 << 20) - 1, "1024.0 KB"), (5388**2 * 37, "1024.4 MB"), (20 * (1 << 40) + 786432, "20971520.8 MB"), ((1 << 62) + 262144, "4398046511104.2 MB"), (None, None)])
def test_format_bytes_up_to_megabytes(spark, n, want):
    assert value(spark, text.format_bytes(F.lit(n).cast("long"), "MB")) == want
