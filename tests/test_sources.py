"""Scanning trees and choosing documentation files."""

from pyspark.sql import functions as F

from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains, StringEndsWith, StringStartsWith

from doclumen.sources import docs, trees
from doclumen.sources.files import clean, read_table, scan_trees

TREE = {
    "README.md": b"# Hi\r\nthere\rend\n",
    "pkg/__init__.py": b"",
    "pkg/_private/deep/er/m.py": "x = 'é'\n".encode(),
    ".github/x.py": b"y = 1\n",
    "docs/_archive/old.md": b"old",
    "pkg/latin.py": "é".encode("latin-1"),
    "pkg/data.bin": b"\x00\x01",
}


def test_scan_finds_hidden_names_and_drops_bad_text(spark, tmp_path):
    for project in ("one", "two"):
        for path, content in TREE.items():
            target = tmp_path / project / path
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(content)
    roots = spark.createDataFrame(
        [(p, str(tmp_path / p)) for p in ("one", "two", "missing")], "project string, root string"
    )
    rows = {(r["project"], r["path"]): r["content"] for r in scan_trees(roots).collect()}
    expected = {p: c for p, c in TREE.items() if p not in ("pkg/latin.py", "pkg/data.bin")}
    assert set(rows) == {(project, path) for project in ("one", "two") for path in expected}
    assert rows["one", "README.md"] == "# Hi\nthere\nend\n"
    assert rows["two", "pkg/_private/deep/er/m.py"] == "x = 'é'\n"


def test_landed_binary_and_text_tables_read_alike(spark, tmp_path):
    binary = spark.createDataFrame(
        [("p", "a.md", bytearray(b"x\r\ny")), ("p", "b.md", bytearray(b"\xff"))],
        "project string, path string, content binary",
    )
    binary.write.parquet(str(tmp_path / "t"))
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "t")).collect()] == [("p", "a.md", "x\ny")]
    text = spark.createDataFrame([("p", "a.md", "x\r\ny")], "project string, path string, content string")
    assert clean(text).collect()[0]["content"] == "x\ny"


def paths(spark, test, candidates):
    rows = spark.createDataFrame([(p,) for p in candidates], "path string")
    return {r[0] for r in rows.where(test(F.col("path"))).collect()}


def test_coverage_docs(spark):
    yes = {
        "README.md", "README.rst", "README.txt", "readme.md", "docs/a.md", "docs/x/_archive/b.rst",
        "docs/c.txt", "__init__.py", "a/b/__init__.py", "docs/node_modules/a.md",
    }
    no = {
        "Readme.md", "sub/README.md", "docs/a.mdx", "docs/.md", "doc/a.md", "docs/a.MD",
        "tests/__init__.py", "a/Testing/__init__.py", ".venv/x/__init__.py", "a/x__init__.py",
    }
    assert paths(spark, docs.is_coverage_doc, yes | no) == yes


def test_explain_docs(spark):
    yes = {"README.md", "docs/a.md", "doc/x/b.md", "documentation/c.md"}
    no = {
        "README.rst", "readme.md", "docs/a.rst", "docs/_archive/a.md", "doc/node_modules/a.md",
        "other/a.md", "pkg/__init__.py", "docs.md",
    }
    assert paths(spark, docs.is_explain_doc, yes | no) == yes


def scans(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "ReadSchema" in line]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from doclumen.operators.extract import raw_features
    from doclumen.sources.packages import package_dirs

    spark.createDataFrame(
        [("p", "a/__init__.py", "x")], "project string, path string, content string"
    ).write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    inits, named = scans(package_dirs(frame))
    assert "StringEndsWith(path,/__init__.py)" in inits
    assert "ReadSchema: struct<project:string,path:string>" in inits
    assert "EqualTo(path,pyproject.toml)" in named
    assert "StringEndsWith(path,.py)" in scans(raw_features(frame))[0]
    assert "StringStartsWith(path,docs/)" in scans(docs.coverage_docs(frame))[0]
    assert "StringStartsWith(path,doc)" in scans(docs.explain_docs(frame))[0]
    assert "content" not in scans(docs.explain_docs(frame).select("project").distinct())[0].split("ReadSchema")[1]


def test_dangling_links_cost_only_themselves(spark, tmp_path):
    for name in ("README.txt", "a.py", "docs/x.md", "pkg/b.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("text")
    (tmp_path / "README.md").symlink_to(tmp_path / "gone.md")
    (tmp_path / "docs" / "y.md").symlink_to(tmp_path / "gone.md")
    found = {r.path for r in scan_trees(spark.createDataFrame([("p", str(tmp_path))], "project string, root string")).collect()}
    assert {"a.py", "docs/x.md", "pkg/b.py"} <= found


def _plant(root, files):
    for path in files:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(b"text")


def test_large_roots_are_opened_up_and_every_file_is_read_once(tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "LARGE", 10)
    flat = [f"flat/f{i}.py" for i in range(45)]
    deep = [f"a/b{i % 7}/c{i % 3}/d{i}.md" for i in range(60)] + ["README.md", "a/x.txt", "a/skip.bin"]
    _plant(tmp_path / "big", flat + deep)
    _plant(tmp_path / "small", ["__init__.py", ".hidden/x.py"])
    roots = [[p, str(tmp_path / p), trees.count_entries(str(tmp_path / p))] for p in ("big", "small", "gone")]
    assert [r[2] for r in roots] == [10, 3, 0]
    options = {"roots": trees.json.dumps(roots), "partitions": "12"}
    reader = trees.ProjectFilesReader(options)
    parts = reader.partitions()
    assert len(parts) >= 12 and max(len(p.units) for p in parts) <= 2
    rows = [r for part in parts for batch in reader.read(part) for r in batch.to_pylist()]
    want = sorted([("big", f) for f in flat + deep if not f.endswith(".bin")] + [("small", "__init__.py"), ("small", ".hidden/x.py")])
    assert sorted((r["project"], r["path"]) for r in rows) == want
    largest = max(sum(b.num_rows for b in reader.read(p)) for p in parts)
    assert largest <= 20


def test_filters_are_taken_over_before_files_are_opened(tmp_path, monkeypatch):
    _plant(tmp_path / "p", ["docs/a.md", "docs/b.rst", "doc/c.md", "m.py", "README.md"])
    _plant(tmp_path / "q", ["docs/a.md"])
    options = {"roots": trees.json.dumps([[p, str(tmp_path / p), 1] for p in "pq"])}
    for filters, want in (
        ([StringStartsWith(("path",), "docs/")], {"pdocs/a.md", "pdocs/b.rst", "qdocs/a.md"}),
        ([StringEndsWith(("path",), ".md"), EqualTo(("project",), "p")], {"pdocs/a.md", "pdoc/c.md", "pREADME.md"}),
        ([In(("path",), ("m.py", "README.md"))], {"pm.py", "pREADME.md"}),
        ([StringContains(("path",), "oc/")], {"pdoc/c.md"}),
    ):
        reader = trees.ProjectFilesReader(options)
        left = [GreaterThan(("path",), "x"), EqualTo(("content",), b"text")]
        assert list(reader.pushFilters([*filters, *left])) == left
        opened = []
        with monkeypatch.context() as watched:
            watched.setattr("builtins.open", lambda *a, f=open, **k: opened.append(a[0]) or f(*a, **k))
            rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
        assert {r["project"] + r["path"] for r in rows} == want and len(opened) == len(want)


def test_spark_hands_its_filters_to_the_source(spark, tmp_path):
    _plant(tmp_path / "p", ["docs/a.md", "docs/b.rst", "m.py"])
    found = scan_trees(spark.createDataFrame([("p", str(tmp_path / "p")), ("p", None)], "project string, root string"))
    wanted = found.where(F.col("path").endswith(".md"))
    assert [r.path for r in wanted.collect()] == ["docs/a.md"]
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "EndsWith(path" not in plan.split("BatchScan")[0]
    assert scan_trees(spark.createDataFrame([], "project string, root string")).count() == 0
