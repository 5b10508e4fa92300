"""Package resolution and symbols."""

import tracemalloc

import pyarrow as pa
import pytest

from doclumen import runtime
from doclumen.operators import symbols as s
from doclumen.sources.packages import package_dirs

PACKAGE = {"pyproject.toml": '[project]\nname = "mypkg"\n', "mypkg/__init__.py": ""}


@pytest.fixture
def found(make_files):
    def run(files):
        rows = s.symbols(make_files({**PACKAGE, **files})).orderBy("path", "pos").collect()
        return [r.asDict() for r in rows]

    return run


def test_classes_and_functions_without_private_ones(found):
    rows = found(
        {
            "mypkg/mod.py": '"""Module."""\nclass Public:\n    """Doc."""\n    def method(self): pass\n'
            "class _Private: pass\ndef function():\n    pass\ndef _hidden(): pass\nasync def gone(): pass\n"
        }
    )
    assert [(r["name"], r["type"], r["line"], r["docstring"]) for r in rows] == [
        ("Public", "class", 2, "Doc."),
        ("function", "function", 6, ""),
    ]


def test_nested_classes_come_after_the_top_level(found):
    rows = found({"mypkg/m.py": "class A:\n    class B:\n        pass\ndef f(): pass\nif x:\n    def g(): pass\n"})
    assert [r["name"] for r in rows] == ["A", "f", "B"]


def test_test_files_and_directories_are_left_out(found):
    body = "def f(): pass\n"
    rows = found(
        {
            "mypkg/real.py": body, "mypkg/test_real.py": body, "mypkg/real_test.py": body,
            "mypkg/tests/a.py": body, "mypkg/conftest_x.py": body, "mypkg/latest/b.py": body,
            "other/c.py": body,
        }
    )
    assert [r["path"] for r in rows] == ["mypkg/latest/b.py", "mypkg/real.py"]


def test_export_list_hides_others_of_its_file_only(found):
    rows = found(
        {
            "mypkg/a.py": "__all__ = ['shown']\ndef shown(): pass\ndef other(): pass\n",
            "mypkg/b.py": "__all__ = []\ndef kept(): pass\n",
            "mypkg/c.py": "__all__ = ('x',)\ndef also(): pass\n",
        }
    )
    assert {r["name"]: r["is_public"] for r in rows} == {
        "shown": True, "other": False, "kept": True, "also": True,
    }


def test_files_that_do_not_parse_yield_nothing(found):
    rows = found(
        {
            "mypkg/bad.py": "def f(:\n",
            "mypkg/bom.py": "\ufeffdef f(): pass\n",
            "mypkg/nul.py": "def f(): pass\n\x00",
            "mypkg/ok.py": "def ok(): pass\n",
        }
    )
    assert [r["name"] for r in rows] == ["ok"]


def test_package_preference(make_files):
    trees = {
        "src_first": {"src/b/__init__.py": "", "src/a/__init__.py": "", "z/__init__.py": ""},
        "named": {
            "pyproject.toml": "[x]\nname = 'my-pkg'\nname = 'other'", "my_pkg/__init__.py": "",
            "aaa/__init__.py": "", "other/__init__.py": "",
        },
        "any": {"pyproject.toml": "name = 'gone'", "tests/__init__.py": "", "b/__init__.py": "", "c/__init__.py": ""},
        "none": {"docs/__init__.py": "", "m.py": "def f(): pass", "a/b/__init__.py": ""},
    }
    rows = package_dirs(make_files(trees)).collect()
    assert {r["project"]: (r["package_dir"], r["preference"]) for r in rows} == {
        "src_first": ("src/a", 1), "named": ("my_pkg", 2), "any": ("b", 3),
    }


def test_key_classes_prefer_docstrings_then_long_names(make_files):
    text = "class Longest_without: pass\nclass Ab:\n    '''d'''\nclass Abc:\n    '''d'''\nclass Abd:\n    '''d'''\n"
    found = s.symbols(make_files({**PACKAGE, "mypkg/m.py": text}))
    best = s.key_classes(found, 3).orderBy("rank").collect()
    assert [r["name"] for r in best] == ["Abc", "Abd", "Ab"]


def test_same_symbols_when_packages_are_too_many_to_broadcast(make_files, monkeypatch):
    files = make_files({**PACKAGE, "mypkg/m.py": "def f(): pass\n", "x/y.py": "def g(): pass\n"})
    broadcast = s.symbols(files).collect()
    monkeypatch.setattr(s, "broadcast_if_small", lambda df: runtime.broadcast_if_small(df, 0))
    assert s.symbols(files).collect() == broadcast
    assert len(broadcast) == 1


def test_parsing_holds_one_file_at_a_time():
    """Not all texts of an Arrow batch as Python strings, nor all of their symbols."""
    text = "# " + "\u4e2d" * 100_000 + "\n" + "def f(): pass\n" * 20
    rows = [{"project": "p", "path": f"p/{i}.py", "content": text, "exports": ["f"] if i % 2 else ["g"]} for i in range(100)]
    schema = pa.schema([("project", pa.string()), ("path", pa.string()), ("content", pa.string()), ("exports", pa.list_(pa.string()))])
    batch = pa.RecordBatch.from_pylist(rows, schema=schema)
    list(s._parse([batch.slice(0, 1)]))
    tracemalloc.start()
    found = []
    for out in s._parse([batch]):
        assert out.num_rows < s.BATCH + 20
        found += zip(*(out.column(c).to_pylist() for c in ("path", "is_public")))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found) == sorted((f"p/{i}.py", bool(i % 2)) for i in range(100) for _ in range(20))
    assert peak < 5_000_000  # all texts are 20 MB
