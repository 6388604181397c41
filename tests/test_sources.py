"""Discovery, reading, history and the index over a small repository."""

import os
import subprocess

import pytest

from codeatlas import api
from codeatlas.sources import git, manifest, settings

LIB = "//! A\n//! B\nmod inner {\n    fn a() { free(); }\n}\npub struct Point {\n    x: f64,\n}\nimpl Point {\n    fn new() -> Self { Point { x: 1.0 } }\n    fn norm(&self) -> f64 {\n        1.0\n    }\n}\nfn free() { Point::new(); }\n"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("mini")
    for path, data in {".gitignore": "generated/\n*.log\n", "README.md": "# T\nx\n", "src/lib.rs": LIB, "src/util.rs": "fn util() {\n    free()\n}\n", "src/__init__.py": "", "generated/junk.rs": "x", "debug.log": "x", "Cargo.lock": "x"}.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(data)
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    for n in range(2):
        (root / "src/lib.rs").write_text(LIB + "\n" * (n + 1))
        run("commit", "-qam", "more")
    (root / "src/lib.rs").write_text(LIB)
    return str(root)


def test_discover(spark, repo):
    paths = lambda **kw: sorted(r["path"] for r in manifest.discover(spark, repo, **kw).collect())
    assert paths() == ["README.md", "src/__init__.py", "src/lib.rs", "src/util.rs"]
    assert paths(extensions=["RS"]) == ["README.md", "src/__init__.py"]
    assert paths(folders=["src"]) == ["README.md"]
    assert paths(folders=[os.path.basename(repo) + "/src"]) == ["README.md"]
    assert paths(files=["src/lib.rs"]) == ["README.md", "src/__init__.py", "src/util.rs"]


def test_ignore_rules(tmp_path):
    for p in ("a/x.tmp", "a/keep.tmp", "a/b/y.txt", "top.txt", "a/top.txt", ".hid/z"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    (tmp_path / ".ignore").write_text("*.tmp\n!keep.tmp\n/top.txt\n")
    (tmp_path / "a/.gitignore").write_text("b/\n")
    assert sorted(p for p, _ in manifest.walk(str(tmp_path))) == ["a/keep.tmp", "a/top.txt"]


def test_read_counts(spark, repo):
    got = {r["path"]: (r["lines"], r["bytes"], r["content"] is not None) for r in manifest.read(manifest.discover(spark, repo), repo).collect()}
    assert got["src/__init__.py"] == (0, 0, True) and got["README.md"] == (2, 6, True) and got["src/lib.rs"][0] == 15


def test_large_file_keeps_counts(spark, tmp_path):
    (tmp_path / "big.bin").write_bytes(b"x" * (8 * 1024 * 1024 + 1))
    r = manifest.read(manifest.discover(spark, str(tmp_path)), str(tmp_path)).first()
    assert (r["lines"], r["bytes"], r["content"]) == (1, 8 * 1024 * 1024 + 1, None)


def test_pre_scan(spark, repo):
    p = {k: {tuple(r) for r in v.collect()} for k, v in manifest.pre_scan(spark, repo).items()}
    assert p["excluded"] == {("generated",)} and {r[0] for r in p["extensions"]} == {"md", "py", "rs"} and {r[:2] for r in p["folders"]} == {("src", 3)}


def test_churn(spark, repo, tmp_path):
    for _ in range(2):  # the second time from the kept table
        out = git.churn(spark, repo, str(tmp_path))
        assert {tuple(r) for r in out.counts.collect()} >= {("src/lib.rs", 3), ("src/util.rs", 1), ("README.md", 1)} and out.warning is None
    assert os.listdir(tmp_path / "churn")
    none = git.churn(spark, str(tmp_path))
    assert none.counts.count() == 0 and none.warning is None


def test_index(spark, repo):
    found = api.index(spark, repo)
    n = found.nodes.toPandas()
    lib = n[n.path.str.startswith("src/lib.rs::") & (n.path.str.count("::") == 1)]
    assert sorted(zip(lib.name, lib.label, lib.ordinal, strict=True)) == [("Point", "impl", 1), ("Point", "struct", 0), ("free", "fn", 0), ("inner", "module", 0)]
    norm = n[n.path == "src/lib.rs::Point::norm"].iloc[0]
    assert (norm.measure, norm.signature, norm.commits) == (3, "fn norm(&self) -> f64", 3)
    by = n.set_index("path")
    assert by.loc["src"].measure == 18 and by.loc[""].measure == 20 and by.loc["src"].commits == 5
    assert by[by.kind == "file"].loc["src/lib.rs"].churn == 1.0 and by[by.kind == "file"].loc["src/util.rs"].churn == 0.0
    assert not n.duplicated(["kind", "label", "path", "ordinal"]).any()
    text = [r["line"] for r in api.dump(found).collect()]
    assert "    File util.rs [3 lines, churn 1 · p0]" in text and "        Fn norm [3 lines, churn 3 · p100]" in text
    assert text[0].startswith("Folder ")
    edges = {(r["center"], r["direction"], r["target"]) for r in api.all_call_edges(found).collect()}
    assert ("src/lib.rs::free", "callee", "src/lib.rs::Point::new") in edges and ("src/lib.rs::free", "caller", "src/util.rs::util") in edges
    rects = api.layout(found).toPandas()
    assert len(rects) == len(n) and (rects.w > 0).all()
    prints = {r["path"]: r["fingerprint"] for r in api.fingerprints(found.files).collect()}
    assert prints["README.md"] == f"{git.fnv1a(b'# T' + bytes([10]) + b'x' + bytes([10])):016x}"


def test_settings(tmp_path):
    p = str(tmp_path / "d/s.json")
    s = settings.Settings(filter_folders=["a"], max_display_lines=5)
    settings.save(s, p)
    assert settings.load(p) == s
    (tmp_path / "d/s.json").write_text('{"filter_folders": ["./b\\\\c/"], "memory_bytes": "x"}')
    assert settings.load(p).filter_folders == ["b/c"] and settings.load(p).memory_bytes == 256 << 20
    assert settings.load(str(tmp_path / "none")) == settings.Settings()
    m = settings.merged(settings.ProjectSettings(["a"], ["x"], ["f"]), settings.ProjectSettings(["a", "b"], [], ["g"]))
    assert (m.filter_extensions, m.filter_folders, m.filter_files) == (["a", "b"], ["x"], ["g"])


def test_file_docs_and_calls(spark, tmp_path):
    (tmp_path / "a.rs").write_text("//! Front door.\n//! Twice.\nfn ring() { bell(); }\nfn bell() { ring(); hall::ring(); }\n")
    (tmp_path / "b.py").write_text('"""Back door."""\n\ndef knock(door):\n    door.open()\n    bell()\n')
    (tmp_path / "c.txt").write_text("plain\n")
    found = api.index(spark, str(tmp_path))
    docs = {r["path"]: r["doc"] for r in found.nodes.where("kind = 'file'").collect()}
    assert docs == {"a.rs": "Front door.\nTwice.", "b.py": "Back door.", "c.txt": None}
    assert found.nodes.where("kind = 'doc'").count() == 0
    got = {(r["caller"], r["name"], r["receiver"]) for r in api.calls(found).collect()}
    assert got == {("a.rs::ring", "bell", None), ("a.rs::bell", "ring", None), ("a.rs::bell", "hall::ring", None), ("b.py::knock", "open", "door"), ("b.py::knock", "bell", None)}


def test_one_function(spark, tmp_path):
    """Lookups of one function give its rows of the whole call graph."""
    (tmp_path / "a.rs").write_text("//! Front.\nfn ring() { bell(); knock(); }\nfn bell() { ring(); hall::ring(); }\nmod inner { fn deep() { fn deeper() { bell() } } }\n")
    (tmp_path / "b.py").write_text("class Door:\n    def open(self):\n        bell()\n\ndef knock(door):\n    door = Door()\n    door.open()\n    bell()\n")
    (tmp_path / "c.txt").write_text("bell\n")
    found = api.index(spark, str(tmp_path))
    whole = {}
    for r in api.all_call_edges(found).collect():
        whole.setdefault(r["center"], set()).add(tuple(r))
    index = api.call_index(found, 8)
    try:
        for center in ("a.rs::bell", "b.py::knock", "b.py::Door::open"):
            want = whole.get(center, set())
            assert want and {tuple(r) for r in api.resolve_calls(found, center).collect()} == want
            assert {tuple(r) for r in api.lookup_calls(found, index, center).collect()} == want
        assert api.resolve_calls(found, "nowhere").collect() == [] and api.lookup_calls(found, index, "nowhere").collect() == []
    finally:
        index.drop()
    text = (tmp_path / "a.rs").read_text()
    spots = [("a.rs", w, text.index(w)) for w in ("knock()", "ring(); hall", "bell() } }", "//!")]
    got = {r["id"]: r["function"] for r in api.enclosing_functions(found, spark.createDataFrame(spots, "file string, id string, at long")).collect()}
    assert (got["knock()"], got["ring(); hall"], got["//!"]) == ("a.rs::ring", "a.rs::bell", None) and got["bell() } }"].startswith("a.rs::inner::deep")
