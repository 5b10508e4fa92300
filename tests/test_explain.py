"""Keywords, rankings, sections and answers."""

import pytest
from pyspark.sql import functions as F

from doclumen import fixed_values as fv
from doclumen.functions.sections import sections
from doclumen.functions.topics import related_topics, topic_keywords
from doclumen.operators import occurrences
from doclumen.plans import explain as plan

QUERY = "query_id long, project string, topic string, question string"


def keywords(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(topic_keywords(F.col("t"))).collect()[0]
    return set(row[0])


def test_stop_words_and_short_words_go(spark):
    assert keywords(spark, "How do I paint, my Zebra?!") == {"paint", "zebra"}


def test_a_text_without_meaningful_words_is_its_own_keyword(spark):
    assert keywords(spark, "What is it? DB") == {"what is it? db"}


def test_aliases_feed_later_aliases(spark):
    expected = set(fv.TOPIC_ALIASES["auth"]) | set(fv.TOPIC_ALIASES["logging"])
    assert expected <= keywords(spark, "auth")
    assert "endpoint" not in keywords(spark, "auth")


def test_alias_by_prefix_of_a_synonym(spark):
    assert set(fv.TOPIC_ALIASES["deploy"]) <= keywords(spark, "dockerized")
    assert set(fv.TOPIC_ALIASES["deploy"]) <= keywords(spark, "kube")


def test_related_topics(spark):
    row = spark.createDataFrame([("My API config",)], "t string").select(related_topics(F.col("t"))).collect()[0]
    assert row[0] == ["auth", "install", "test", "deploy", "database"]


def sections_line_by_line(text):
    """Line by line, as the definition reads."""
    out, header, body = [], "", []
    for line in text.split("\n"):
        if line.startswith("#"):
            if header and body:
                out.append((header, "\n".join(body)))
            header, body = line, []
        else:
            body.append(line)
    if header and body:
        out.append((header, "\n".join(body)))
    return out


@pytest.mark.parametrize(
    "text",
    [
        "", "no header", "# a", "# a\n", "# a\n\n", "# a\n# b\nx", "pre\n# a\n\n# b\n",
        "# a\nx\n\n## b\n  # not\ny\n", "\n\n#a\n\n\n#b\n\n", "# a\r\nx", "#\n#\nz\n",
    ],
)
def test_sections(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(sections(F.col("t"))).collect()[0]
    assert [(s["header"], s["body"]) for s in row[0]] == sections_line_by_line(text)


DOCS = {
    "README.md": "# Tool\nHow to login.\n## Install\nRun setup.\n",
    "docs/a.md": "intro\n# Login\n# Other\n  login with a token  \n\n# End\n",
    "docs/b.md": "# Zebra\nzebra zebra\n# Zebra\nno stripes\n",
    "docs/_archive/c.md": "# Login\nold\n",
    "doc/d.md": "# Misc\nzebra once\n",
    "docs/e.rst": "zebra",
}


@pytest.fixture
def answers(spark, make_files):
    files = make_files({"p": DOCS, "bare": {"x.py": "1"}})

    def ask(*queries):
        rows = spark.createDataFrame([(i, *q) for i, q in enumerate(queries)], QUERY)
        return [r.asDict(True) for r in plan.explain(files, rows).orderBy("query_id").collect()]

    return ask


def test_answers(answers):
    topic, question, missed, bare, empty = answers(
        ("p", "zebra", None),
        ("p", None, "Where is the zebra?"),
        ("p", "quagga", ""),
        ("bare", "zebra", None),
        ("p", None, ""),
    )
    body = "**docs/b.md** # Zebra\nzebra zebra\n\n---\n\n**docs/b.md** # Zebra\nno stripes"
    # One mention alone scores 0.1, which is not enough for doc/d.md.
    assert topic["sources"] == [{"path": "docs/b.md", "relevance": 0.9}]
    assert topic["explanation"] == "**Topic:** zebra\n\n" + body
    assert topic["ok"] and topic["error"] is None and topic["suggestions"] is None
    assert topic["related_topics"] == ["auth", "api", "config", "install", "test"]
    assert question["explanation"] == "**Answering:** Where is the zebra?\n\n" + body
    assert missed["ok"] and missed["explanation"] == "No documentation found for 'quagga'"
    assert missed["sources"] == [] and missed["suggestions"] == list(fv.TOPIC_ALIASES)
    assert not bare["ok"] and bare["error"] == fv.NO_DOCS_ERROR and bare["hint"] == fv.NO_DOCS_HINT
    assert not empty["ok"] and empty["error"] == fv.NO_QUERY_ERROR and empty["query"] is None


def test_topic_is_searched_but_the_question_heads_the_answer(answers):
    row = answers(("p", "zebra", "login?"))[0]
    assert row["query"] == "zebra"
    assert row["explanation"].startswith("**Answering:** login?\n\n**docs/b.md** # Zebra")


def test_bodies_are_cut_and_stripped(answers):
    row = answers(("p", "login", None))[0]
    assert "**docs/a.md** # Other\nlogin with a token\n\n---" in row["explanation"] + "\n\n---"


def test_at_most_five_documents_and_sections(spark, make_files):
    docs = {f"docs/{i}.md": "# x\n" + "\n".join(f"# kiwi {j}\nkiwi" for j in range(4)) for i in range(7)}
    query = spark.createDataFrame([(1, "p", "kiwi", None)], QUERY)
    row = plan.explain(make_files(docs), query).collect()[0]
    assert [s["path"] for s in row["sources"]] == [f"docs/{i}.md" for i in (6, 5, 4, 3, 2)]
    parts = row["explanation"].split("\n\n", 1)[1].split(fv.SECTION_SEPARATOR)
    assert parts == [f"**docs/6.md** # kiwi {j}\nkiwi" for j in (3, 2, 1)] + [
        f"**docs/5.md** # kiwi {j}\nkiwi" for j in (3, 2)
    ]


def test_same_answers_from_the_shuffled_plan(answers, monkeypatch):
    asked = [("p", "zebra", None), ("p", None, "login token"), ("p", "install", None)]
    expected = answers(*asked)
    monkeypatch.setattr(occurrences, "BROADCAST_PATTERNS", 0)
    monkeypatch.setattr(occurrences, "PATTERNS_PER_CHUNK", 2)
    assert answers(*asked) == expected


def test_copies_do_not_crowd_out_or_lose_documents(spark, make_files):
    docs = {f"docs/copy{i:02d}.md": "# kiwi\nkiwi" for i in range(30)}
    docs["docs/a.md"] = "# kiwi\nkiwi kiwi"
    query = spark.createDataFrame([(1, "p", "kiwi", None), (2, "p", "kiwi mango", None)], QUERY)
    rows = plan.explain(make_files(docs), query).collect()
    for row in rows:
        assert [s["path"] for s in row["sources"]] == ["docs/a.md"] + [
            f"docs/copy{i}.md" for i in (29, 28, 27, 26)
        ]


def test_words_part_where_python_parts_them(spark):
    asked = spark.createDataFrame([("zebra\x1fgiraffe\x1cwalrus",)], "t string")
    assert asked.select(topic_keywords(F.col("t"))).first()[0] == ["zebra", "giraffe", "walrus"]
