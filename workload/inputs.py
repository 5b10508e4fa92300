"""Project files derived from the given tables, by SQL that two engines can run.

No given table holds source code, so every document becomes one source file: its
own words name what the file offers, its whole text stands in front as comments.
The documents themselves are the docs, with every line under a header for the
explain corpus; conversations are further Markdown files.  A project is a
document's ``source``.

``<name>`` marks what differs: tables, the flag for global replacement, columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TABLES = ["documents", "conversations", "benchmark", "labels"]


def _table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, spread over the cores where its files are too few for them.

    A table with splits enough, as any large one has, is not shuffled.
    """
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if df.rdd.getNumPartitions() < cores else df


#: What the two engines write differently: Spark's way, DuckDB's way.
_DIFFERS = {
    "<utf8>": (", 'UTF-8'", ""),
    "<half>": ("X'C3'", "'\\xC3'::BLOB"),
    "<g>": ("", ", 'g'"),
    "<words>": (
        "filter(split(lower(text), '[^a-z]+'), w -> length(w) > 2)",
        "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: len(w) > 2)",
    ),
    "<pairs>": (
        "explode(transform(sequence(1, greatest(size(words) - 1, 1)), i -> get(words, i - 1) || '-' || get(words, i)))",
        "unnest(list_transform(range(1, len(words)), lambda i: words[i] || '-' || words[i + 1]))",
    ),
}


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: _table(spark, sf_dir, t) for t in _TABLES if f"<{t}>" in sql}
    for table in used:
        sql = sql.replace(f"<{table}>", f"{{{table}}}")
    for mark, (here, _) in _DIFFERS.items():
        sql = sql.replace(mark, here)
    return spark.sql(sql, **used)


def duck_sql(sql: str) -> str:
    for table in _TABLES:
        sql = sql.replace(f"<{table}>", table)
    for mark, (_, there) in _DIFFERS.items():
        sql = sql.replace(mark, there)
    return sql


def _text(template: str) -> str:
    """SQL expression of a template: ``[w]`` is column ``w``, newlines are chr(10)."""
    parts = []
    for piece in re.split(r"(\[(?:[wu][123]|note)\]|\n|')", template):
        if piece == "\n":
            parts.append("chr(10)")
        elif piece == "'":
            parts.append("chr(39)")
        elif re.fullmatch(r"\[(?:[wu][123]|note)\]", piece):
            parts.append(piece[1:-1])
        elif piece:
            parts.append(f"'{piece}'")
    return " || ".join(parts)


_LONG_COMMENT = "# " + "filler " * 35

#: One template per kind of file; the kind is the document's length modulo 12.
TEMPLATES = [
    # 0: argparse; a call over two lines, a prog behind a bracket, a name from a variable
    """import argparse
sub.add_parser("run-[w1]")
sub.add_parser(
    'show_[w2]', help="x")
p = argparse.ArgumentParser(description="d", prog="[w3]-tool")
q = argparse.ArgumentParser(usage=text(), prog="lost")
sub.add_parser(name)
""",
    # 1: click; positional name, name=, a name with =, private, too far away
    """import click
@click.group()
def [w1]_group():
    pass
@cli.command()
def [w1]_[w2]():
    pass
@cli.command("ignored")
async def [w2]_[w3](a):
    pass
@cli.command(name="[w3]")
def named():
    pass
@cli.command(help="x", name="k=v")
def bad():
    pass
@cli.command()
def _private():
    pass
@click.group(help="a long help text that pushes the name of the group out of sight, as it is longer than a hundred characters")
def unseen_group():
    pass
@far.command()
"""
    + _LONG_COMMENT
    + """
def too_far():
    pass
""",
    # 2: typer; two apps, positional name, keyword only, no function
    """import typer
app = typer.Typer()
sub_[w1] = typer.Typer(help="x")
@app.command()
def [w1]_[w2]():
    pass
@sub_[w1].command("[w3]")
def first():
    pass
@app.command(help="h")
def second():
    pass
register(app.command())
thing = "@app.command()"
""",
    # 3: fire; a class, methods of another class, a private method, a function
    """import fire
class [w1][w2]s(object):
    \"""Tool of [w3].\"""
    def [w1]_[w2](self):
        return 1
    def _hidden(self):
        return 2
class Other:
    def [w3]_x(self, x):
        return x
fire.Fire([w1][w2]s)
fire.Fire([w2]_main)
fire.Fire(a, b)
""",
    # 4: FastAPI; upper-case verb, async, empty path, no function near
    """from fastapi import FastAPI
@router.POST("/[w1]/[w2]")
async def create_[w1]():
    pass
@app.get("/[w3]/<id>")
def read_[w2]():
    pass
@app.get("")
def empty():
    pass
@app.delete('/[w1]')
@app.head("/[w2]")
async def both_[w3]():
    pass
@app.put("/far")
"""
    + _LONG_COMMENT
    + """
def far_away():
    pass
""",
    # 5: Flask; listed methods, none, methods that are not quoted
    """from flask import Blueprint
@bp.route("/[w1]", methods=["GET","post"])
def [w1]_view():
    pass
@bp.route("/[w2]/[w3]")
def [w2]_view():
    pass
@bp.route("/m/[w3]", methods=[M])
def m_view():
    pass
@bp.route("/s", strict=True, methods=['PUT'])
def s_view():
    pass
""",
    # 6: Django routes; re_path, raw strings, empty, leading slash
    """from django.urls import path, re_path
urlpatterns = [
    path("[w1]/", views.[w2]_list, name="x"),
    path('/[w3]', home),
    re_path("[w2]/[w3]", views.[w1]),
    path("", root),
    re_path(r"^raw$", raw),
    path("alone"),
]
""",
    # 7: environment variables; defaults, an empty one, .get, lower case
    """import os
a = os.getenv("[u1]_[u2]", "d")
b = os.getenv("[u3]_KEY", "")
c = os.getenv('[u2]')
d = os.getenv("[u1]_N" , 5 )
e = os.environ["[u2]_[u3]"]
f = os.environ.get("[u1]_GET")
g = os.environ["lower"]
h = os.getenv("[u1]_[u2]", "second")
""",
    # 8: pydantic settings; env=, a type in brackets, bare fields in and out of the class
    """from pydantic_settings import BaseSettings
class Settings(BaseSettings):
    x: str = Field(default="d", env="[u1]_ENV")
    y: Optional[str] = Field(None, env="[u2]_MISSED")
    [u3]_NAME: str = "v"
    lower: int
class Unrelated:
    [u1]_[u3]: int = 3
    def method(self):
        DEEP: int = 4
""",
    # 9: settings module; values of 49, 50 and 51 characters, an import, names left out
    """DEBUG = True
[u1]_[u2] = "[w3]"
A49 = """
    + "a" * 49
    + """
A50 = """
    + "a" * 50
    + """
A51 = """
    + "a" * 51
    + """
LOADED = import_string("a")
TRUE = 1
NONE=2
lower = 3
    INDENTED = 4
""",
    # 10: exports; a nested class, a private function, a documented class
    """__all__ = ["[w1]_[w2]", "[w1][w3]s"]
class [w1][w3]s:
    \"""Documented [w2].\"""
    class Inner:
        pass
    def method(self):
        pass
def [w1]_[w2]():
    pass
def hidden_[w3]():
    \"""Hidden but documented.\"""
def _private():
    pass
""",
    # 11: no exports; async, decorated, documented by the label
    """class [w2][w1]s(Base):
    pass
class _Private:
    pass
@decorate
def [w2]_[w1]():
    \"""[note]\"""
async def not_counted():
    pass
def [w3]_[w2]():
    pass
if True:
    def inner_[w1]():
        pass
""",
]

_CONTENT = (
    "CASE kind "
    + " ".join(f"WHEN {i} THEN {_text(t)}" for i, t in enumerate(TEMPLATES))
    + " END"
)
# A file of every kind in 31 is broken: no symbol comes out of it.
_BROKEN = "CASE WHEN doc_id % 31 = 0 THEN 'def broken(((' || chr(10) ELSE '' END"

#: Paths that one or another scan leaves out, and paths that look like it.
_PATH = """
    base || CASE doc_id % 17
        WHEN 0 THEN '/tests/m_' WHEN 1 THEN '/test_' WHEN 2 THEN '/distance/m_'
        WHEN 3 THEN '/migrations/m_' WHEN 4 THEN '/.venv/m_' WHEN 5 THEN '/conftest_'
        WHEN 6 THEN '/latest/m_' ELSE '/m_' END
    || cast(doc_id AS string)
    || CASE WHEN kind = 9 THEN '_settings.py' WHEN doc_id % 19 = 0 THEN '_test.py' ELSE '.py' END
"""

_BASE = """CASE cast(replace(d.source, 'src', '') AS int) % 4
    WHEN 0 THEN 'src/core' WHEN 1 THEN 'named_pkg' WHEN 2 THEN 'alpha' ELSE 'scripts' END"""

# Words of a document name what its source file offers.
_WORDS = f"""
    SELECT d.doc_id, d.source AS project, d.text, length(d.text) % 12 AS kind,
        {_BASE} AS base,
        coalesce(nullif(split_part(trim(regexp_replace(lower(d.text), '[^a-z]+', ' '<g>)), ' ', 1), ''), 'x') AS w1,
        coalesce(nullif(split_part(trim(regexp_replace(lower(d.text), '[^a-z]+', ' '<g>)), ' ', 2), ''), 'y') AS w2,
        coalesce(nullif(split_part(trim(regexp_replace(lower(d.text), '[^a-z]+', ' '<g>)), ' ', 3), ''), 'z') AS w3,
        CASE WHEN l.quality = 1 THEN 'Good.' ELSE '' END AS note
    FROM <documents> d LEFT JOIN <labels> l ON d.doc_id = l.doc_id
"""

_SOURCES = f"""
    SELECT doc_id, project, {_PATH} AS path,
        '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10)
        || {_BROKEN} || {_CONTENT} AS content
    FROM (SELECT *, upper(w1) AS u1, upper(w2) AS u2, upper(w3) AS u3 FROM ({_WORDS}) words) named
"""

SOURCE_FILES = f"SELECT project, path, content FROM ({_SOURCES}) sources"

# Some projects document their own code, in whole or in part: all, four fifths and so on.
API_DOC_FILES = f"""
    SELECT project, 'docs/api/' || cast(doc_id AS string) || '.rst' AS path, content
    FROM ({_SOURCES}) sources
    WHERE doc_id % 10 < CASE cast(replace(project, 'src', '') AS int) % 7
        WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 6 WHEN 3 THEN 4 WHEN 4 THEN 2 ELSE 0 END
"""

# Package markers of every project, in the layout its number selects.
_BASES = f"(SELECT DISTINCT d.source AS project, {_BASE} AS base FROM <documents> d) bases"
LAYOUT_FILES = f"""
    SELECT project, base || '/__init__.py' AS path,
        '# package ' || project || chr(10) AS content
    FROM {_BASES} WHERE base <> 'scripts'
    UNION ALL
    SELECT project, 'zeta/__init__.py', '# zeta' FROM {_BASES} WHERE base <> 'scripts'
    UNION ALL
    SELECT project, 'aaa_tools/__init__.py', '# tools' FROM {_BASES} WHERE base = 'named_pkg'
    UNION ALL
    SELECT project, 'tests/__init__.py', '# tests' FROM {_BASES}
    UNION ALL
    SELECT project, 'pyproject.toml',
        '[project]' || chr(10) || 'name = "named-pkg"' || chr(10) FROM {_BASES}
"""

# The docs of each project: its documents, every line below a header of its own, and
# for some a line of routes.
DOC_FILES = f"""
    SELECT project,
        CASE length(text) % 5 WHEN 0 THEN 'docs/_archive/d' WHEN 1 THEN 'doc/d'
            WHEN 2 THEN 'documentation/en/d' ELSE 'docs/d' END
        || cast(doc_id AS string) || CASE WHEN doc_id % 7 = 0 THEN '.rst' ELSE '.md' END AS path,
        '# ' || project || chr(10)
        || CASE WHEN doc_id % 3 = 0 THEN 'Routes: /' || w1 || ', /' || w2 || '/' || w3 || chr(10) ELSE '' END
        || replace(text, chr(10), chr(10) || '## ' || w1 || chr(10)) AS content
    FROM ({_WORDS}) words
"""

README_FILES = f"""
    SELECT project, 'README.md' AS path, '# ' || project || chr(10) || min_by(text, doc_id) AS content
    FROM ({_WORDS}) words GROUP BY project
"""

# Conversations as Markdown: a file per turn, every line below a header of its own.
CHAT_FILES = """
    SELECT 'src' || cast(conv_id % 20 AS string) AS project,
        'documentation/c' || cast(conv_id AS string) || '/' || cast(turn AS string) || '.md' AS path,
        '# ' || role || chr(10) || replace(text, chr(10), chr(10) || '# ' || role || chr(10)) AS content
    FROM <conversations>
"""

# A project with documents and without any feature.
TALK_FILES = """
    SELECT 'talk' AS project, 'docs/' || cast(conv_id AS string) || '-' || cast(turn AS string) || '.md' AS path,
        '# ' || role || chr(10) || text AS content
    FROM <conversations>
"""

# Files as bytes: with half a character at the end or start, and with other ends of lines.
_LINES = """CASE doc_id % 7 WHEN 2 THEN replace(text, chr(10), chr(13) || chr(10))
    WHEN 3 THEN replace(text, chr(10), chr(13)) WHEN 4 THEN replace(text, chr(10), chr(13) || chr(13) || chr(10))
    ELSE text END"""
BINARY_FILES = f"""
    SELECT source AS project, 'docs/' || cast(doc_id AS string) || '.md' AS path,
        CASE doc_id % 7 WHEN 0 THEN encode({_LINES}<utf8>) || <half> WHEN 1 THEN <half> || encode({_LINES}<utf8>)
            ELSE encode({_LINES}<utf8>) END AS content
    FROM <documents>
"""
CLEAN_FILES = f"""
    SELECT source AS project, 'docs/' || cast(doc_id AS string) || '.md' AS path,
        regexp_replace({_LINES}, chr(13) || chr(10) || '?', chr(10)<g>) AS content
    FROM <documents> WHERE doc_id % 7 > 1
"""

# Documents as they are, and as terms the pairs of neighbouring words of the project two numbers on.
PLAIN_TEXTS = "SELECT source AS project, cast(doc_id AS string) AS path, text FROM <documents>"
WORD_PAIRS = """
    SELECT DISTINCT 'src' || cast((cast(replace(source, 'src', '') AS int) + 2) % 20 AS string) AS project, pair AS term
    FROM (
        SELECT source, <pairs> AS pair
        FROM (SELECT source, <words> AS words FROM <documents>) split
    ) paired
    WHERE pair IS NOT NULL
"""

# Two projects with a command for each document, of which 9 and 13 in 20 have docs: more
# than a preview shows are missing, and the shares fall between those of other projects.
_PARTLY = "(SELECT doc_id, share FROM <documents> CROSS JOIN (SELECT 9 AS share UNION ALL SELECT 13) shares) partly"
PARTLY_CODE = f"""
    SELECT 'partly' || cast(share AS string) AS project, 'tools/c' || cast(doc_id AS string) || '.py' AS path,
        'sub.add_parser("zq' || cast(doc_id AS string) || 'x")' AS content
    FROM {_PARTLY}
"""
PARTLY_DOCS = f"""
    SELECT 'partly' || cast(share AS string) AS project, 'docs/c' || cast(doc_id AS string) || '.md' AS path,
        '# zq' || cast(doc_id AS string) || 'x' || chr(10) || 'one' AS content
    FROM {_PARTLY} WHERE doc_id % 20 < share
"""

CODE_FILES = f"{SOURCE_FILES} UNION ALL {LAYOUT_FILES} UNION ALL {PARTLY_CODE}"
FILES = " UNION ALL ".join(
    [
        SOURCE_FILES, LAYOUT_FILES, DOC_FILES, API_DOC_FILES, README_FILES, CHAT_FILES, TALK_FILES,
        PARTLY_CODE, PARTLY_DOCS,
    ]
)

# A query per benchmark item: its text as a topic, a question or both; and fixed topics besides.
QUERIES = """
    SELECT item_id AS query_id, 'src' || cast(item_id % 21 AS string) AS project,
        CASE WHEN item_id % 3 < 2 THEN text END AS topic,
        CASE WHEN item_id % 3 <> 1 THEN text END AS question
    FROM <benchmark>
    UNION ALL
    SELECT -1 - item_id, 'src' || cast(item_id % 21 AS string),
        CASE item_id % 4 WHEN 0 THEN 'auth' WHEN 1 THEN 'rest api' WHEN 2 THEN 'zzz qqq'
            ELSE 'Testing: how to install?' END,
        NULL
    FROM <benchmark>
"""


def spark_files(spark: SparkSession, sf_dir: str, sql: str = FILES) -> DataFrame:
    return spark_sql(spark, sf_dir, sql)


def duck_files(sql: str = FILES) -> str:
    return duck_sql(sql)
