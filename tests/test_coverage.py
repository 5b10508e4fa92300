"""Mentions, category coverage and project scores."""

import itertools
import json
import random
import string
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doclumen import fixed_values as fv
from doclumen.operators import coverage as cov
from doclumen.operators import colocated, occurrences, signatures, windows
from doclumen.plans import assess as plan
from doclumen.plans import sinks

SYMBOL = "project string, name string, type string, path string, line int, docstring string, is_public boolean, pos int"
DOC = "project string, path string, text string"
FEATURE = (
    "project string, category_ord int, category string, framework string, label string,"
    " terms array<string>, docstring string, path string, line int, extractor_rank int, pos int"
)


def symbol_status(spark, symbols, docs, strict=False, category=None):
    rows = [("p", n, "class", "m.py", 1, d, True, i) for i, (n, d) in enumerate(symbols)]
    found = cov.features_from_symbols(spark.createDataFrame(rows, SYMBOL), category)
    texts = spark.createDataFrame([("p", f"d{i}", t.lower()) for i, t in enumerate(docs)], DOC)
    return cov.feature_status(found, texts, strict)


def only_row(spark, symbols, docs, strict=False, category=None):
    return cov.category_coverage(symbol_status(spark, symbols, docs, strict, category)).collect()[0]


def test_category_is_a_parameter(spark):
    row = only_row(spark, [("A", "d")], ["x"], category=fv.DEFAULT_SYMBOL_CATEGORY)
    assert row["category"] == "Core Modules"
    assert only_row(spark, [("A", "d")], ["x"])["category"] == "Classes"


def test_docstring_counts_as_documented(spark):
    row = only_row(spark, [("Foo", "A docstring")], [""])
    assert (row["documented"], row["coverage"], row["moon"]) == (1, 1.0, "🌕")


def test_strict_ignores_mentions(spark):
    docs = ["MyClass is described here"]
    assert only_row(spark, [("MyClass", "")], docs)["documented"] == 1
    row = only_row(spark, [("MyClass", "")], docs, strict=True)
    assert (row["documented"], row["undocumented"]) == (0, ["MyClass"])


def test_everything_counts_and_only_the_preview_is_cut(spark):
    symbols = [(f"Zq{i:03d}", "") for i in range(50)] + [(f"Doc{i}", "d") for i in range(10)]
    row = only_row(spark, symbols, ["nothing"])
    assert (row["total"], row["documented"]) == (60, 10)
    assert row["undocumented"] == [f"Zq{i:03d}" for i in range(20)]


@pytest.mark.parametrize(
    "term,text,hit",
    [
        ("run-all", "please RUN ALL now", True),
        ("run-all", "run_all", True),
        ("run_all", "run-all", True),
        ("run_all", "runall", False),
        ("a-b_c", "a b c", True),
        ("a-b_c", "a-b-c", True),
        ("a-b_c", "a b_c", False),
        ("_", "two words", True),
        ("Über", "das ÜBER ich", True),
        ("cat", "concatenate", True),
    ],
)
def test_mention_forms(spark, term, text, hit):
    terms = spark.createDataFrame([("p", term), ("q", term)], "project string, term string")
    docs = spark.createDataFrame([("p", "d", text)], DOC).withColumn("text", F.lower("text"))
    found = [tuple(r) for r in cov.mentioned_terms(terms, docs).collect()]
    assert found == ([("p", term)] if hit else [])


def test_endpoint_is_documented_by_path_or_name(spark):
    rows = [
        ("p", 4, "API Endpoints", "flask", "GET /aa", ["/aa", "fn_a"], "", "m.py", 1, 1, 0),
        ("p", 4, "API Endpoints", "flask", "GET /bb", ["/bb", "fn_b"], "", "m.py", 2, 1, 1),
        ("p", 4, "API Endpoints", "flask", "GET /cc", ["/cc"], "", "m.py", 3, 1, 2),
    ]
    docs = spark.createDataFrame([("p", "d", "see /aa"), ("p", "e", "call fn-b")], DOC)
    status = cov.feature_status(spark.createDataFrame(rows, FEATURE), docs, strict=True)
    assert [r["documented"] for r in status.orderBy("pos").collect()] == [True, True, False]


def brute_force(patterns, docs):
    return sorted({(p, w) for (p, w), (q, _, t) in itertools.product(patterns, docs) if p == q and w in t})


@pytest.fixture
def small_limits(monkeypatch):
    """Force the plan with buckets, with several parts and chunks for the large project."""
    monkeypatch.setattr(occurrences, "BROADCAST_PATTERNS", 0)
    monkeypatch.setattr(occurrences, "PATTERNS_PER_CHUNK", 7)
    monkeypatch.setattr(colocated, "PART_BYTES", 300)


def _random_corpus(seed):
    rng = random.Random(seed)
    word = lambda lo, hi: "".join(rng.choice("abé ") for _ in range(rng.randint(lo, hi)))
    projects = ["hot"] * 12 + ["cold", "empty"]
    patterns = sorted({(rng.choice(projects), word(1, 6)) for _ in range(120)})
    docs = [(rng.choice(projects[:-1]), f"d{i}", word(0, 60)) for i in range(80)]
    return patterns, docs


def test_both_plans_find_what_brute_force_finds(spark, small_limits):
    patterns, docs = _random_corpus(1)
    p = spark.createDataFrame(patterns, "project string, pattern string")
    d = spark.createDataFrame(docs, DOC)
    expected = brute_force(patterns, docs)
    shuffled = sorted(map(tuple, occurrences.mentioned_patterns(p, d).collect()))
    assert shuffled == expected
    occurrences.BROADCAST_PATTERNS = 1000
    assert sorted(map(tuple, occurrences.mentioned_patterns(p, d).collect())) == expected


def test_documents_landed_in_buckets_are_searched_where_they_are(spark, small_limits):
    patterns, docs = _random_corpus(3)
    p = spark.createDataFrame(patterns + [(None, "a")], "project string, pattern string")
    landed = colocated.colocate(spark.createDataFrame([*docs, (None, "x", "a")], DOC))
    assert landed.parts.where("parts > 1").count() > 0
    for _ in range(2):
        found = occurrences.mentioned_patterns(p, landed)
        assert sorted(map(tuple, found.collect())) == brute_force(patterns, docs)
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        moved = [line for line in plan.splitlines() if "Exchange" in line]
        assert moved and not any("text" in line for line in moved)
        scan = next(line for line in plan.splitlines() if "FileScan" in line and "text" in line)
        assert "Bucketed: true" in scan

@pytest.mark.parametrize("seed", range(3))
def test_signatures_miss_nothing(spark, seed):
    """Four letters only: every signature admits patterns that do not occur."""
    patterns, docs = _random_corpus(seed)
    patterns = sorted({*patterns, ("hot", "nowhere at all"), ("hot", ""), ("empty", "a")})
    p = spark.createDataFrame(patterns + [(None, "a")], "project string, pattern string")
    d = spark.createDataFrame(docs, DOC)
    found, opened = signatures.mentioned_patterns(p, d, signatures.signature_index(d))
    assert sorted(map(tuple, found.collect())) == brute_force(patterns, docs)
    assert opened.count() == opened.distinct().count() <= len(docs)


def test_signatures_spare_documents(spark):
    """Of 300 texts with a vocabulary of 900 words a search for 40 names reads a few."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(rng.randint(4, 9))) for _ in range(900)]
    docs = [("p", f"d{i}", " ".join(rng.choices(words, k=400))) for i in range(300)]
    patterns = [("p", w) for w in words[:20]] + [("p", f"{w}_missing{i}") for i, w in enumerate(words[20:40])]
    p = spark.createDataFrame(patterns, "project string, pattern string")
    d = spark.createDataFrame(docs, DOC)
    index = signatures.signature_index(d)
    found, opened = signatures.mentioned_patterns(p, d, index)
    assert sorted(map(tuple, found.collect())) == brute_force(patterns, docs)
    assert opened.count() <= 30
    assert index.agg(F.sum(F.octet_length("signature"))).first()[0] < sum(len(t) for _, _, t in docs) / 2


def test_signatures_admit_all_that_occurs(spark):
    patterns, docs = _random_corpus(5)
    for project in ("hot", "cold"):
        wanted = [w for q, w in patterns if q == project]
        asked = signatures._Patterns(wanted)
        for q, _, text in docs:
            held = asked.admitted(signatures.signature(text))
            assert all(ok or w not in text for ok, w in zip(held, wanted))
    long = "".join(chr(33 + i % 90) + chr(200 + i % 70) for i in range(20_000))
    asked = signatures._Patterns([long[i : i + 9] for i in range(0, 20_000, 37)] + ["not in there", "zzz"])
    held = asked.admitted(signatures.signature(long))
    assert held[:-2].all() and not held[-2:].any()
    assert signatures._Patterns(["", "x"]).admitted(signatures.signature("")).tolist() == [True, False]


def test_scored_patterns_equal_counting(spark, small_limits):
    patterns, docs = _random_corpus(2)
    docs += [("hot", "x1", "# ab ab ab"), ("hot", "x2", "a" * 40)]
    expected = sorted(
        (p, path, w, min(t.count(w), 10) + (5 if f"# {w}" in t else 0))
        for (p, w), (q, path, t) in itertools.product(patterns, docs)
        if p == q and w in t
    )
    p = spark.createDataFrame(patterns, "project string, pattern string")
    d = spark.createDataFrame(docs, DOC)


    def scored():
        rows = occurrences.scored_documents(p, d).select("project", "path", F.inline("hits"))
        return sorted(map(tuple, rows.collect()))

    assert scored() == expected
    occurrences.BROADCAST_PATTERNS = 1000
    assert scored() == expected


def _categories(spark, rows):
    schema = (
        "project string, category_ord int, category string, total long, documented long,"
        " coverage double, moon string, undocumented array<string>"
    )
    full = [(p, o, fv.CATEGORIES[o - 1], t, d, d / t, "", list(u)) for p, o, t, d, u in rows]
    return spark.createDataFrame(full, schema)


def test_project_scores_and_recommendations(spark):
    rows = [
        ("p", 1, 4, 1, ["a", "b", "c"]),
        ("p", 2, 10, 10, []),
        ("p", 4, 8, 2, ["GET /1", "GET /2", "GET /3", "GET /4", "GET /5", "GET /6"]),
        ("p", 5, 10, 7, ["X", "Y", "Z"]),
    ]
    projects = spark.createDataFrame([("p",), ("none",)], "project string")
    got = {r["project"]: r for r in plan.project_assessment(_categories(spark, rows), projects).collect()}
    p = got["p"]
    assert (p["total_features"], p["documented_features"]) == (32, 20)
    assert p["overall_coverage"] == 0.625
    assert p["know"] == min(0.95, 0.625 * 1.1)
    assert p["uncertainty"] == 0.375
    assert (p["assessment"], p["moon"]) == ("Documentation has notable gaps", "🌓")
    # Equal ratios keep category order; 70 % asks for nothing.
    assert p["recommendations"] == [
        "Document CLI Commands: a, b, c",
        "Document API Endpoints: GET /1, GET /2, GET /3, ...and 3 more",
    ]
    assert (p["cli_commands"], p["public_functions"], p["config_options"]) == (4, 0, 10)
    none = got["none"]
    assert (none["know"], none["uncertainty"], none["overall_coverage"]) == (0.0, 1.0, 0.0)
    assert none["assessment"] == "No features discovered"
    assert none["recommendations"] == ["Add discoverable features to your project"]
    assert none["moon"] == "🌑" and none["categories"] == []


def test_labels_at_their_thresholds(spark):
    from doclumen.functions import scores

    ratios = [0.0, 0.1999, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 1.0]
    rows = spark.createDataFrame([(r,) for r in ratios], "r double").select(
        scores.moon(F.col("r")), scores.assessment_text(F.col("r"))
    )
    moons = "".join(r[0] for r in rows.collect())
    assert moons == "🌑🌑🌑🌒🌒🌓🌓🌔🌔🌕🌕"
    assert [r[1] for r in rows.collect()][1:3] == [fv.LOWEST_ASSESSMENT, "Major documentation debt"]


MINI = {
    "pyproject.toml": 'name = "mini"',
    "mini/__init__.py": "# mini package\n",
    "mini/cli.py": "import click\n@cli.command()\ndef run_all():\n    pass\n" + "#" * 200,
    "mini/api.py": "urlpatterns = [path('users/', views.users), path('x/y/z/', hidden)]\n",
    "mini/conf.py": "os.getenv('MINI_HOME', '/')\nos.environ['SECRET_ZZ']\n",
    "mini/core.py": 'class Engine:\n    """Runs."""\nclass Qwerty:\n    pass\n',
    "README.md": "# Mini\nUse `run all` with MINI_HOME set. Visit /users/ too.\n",
    "docs/_archive/old.md": "an Engine",
}


def test_whole_report_of_a_small_project(spark, make_files):
    files = make_files({"mini": MINI, "bare": {"notes.txt": "nothing"}})
    got = {r["project"]: r.asDict(True) for r in plan.assess(files).collect()}
    mini = got["mini"]
    assert [(c["name"], c["total"], c["documented"], c["coverage"], c["moon"], c["undocumented"]) for c in mini["categories"]] == [
        ("CLI Commands", 1, 1, 100.0, "🌕", []),
        ("Classes", 2, 1, 50.0, "🌓", ["Qwerty"]),
        ("Public Functions", 1, 1, 100.0, "🌕", []),
        ("API Endpoints", 2, 1, 50.0, "🌓", ["* /x/y/z/"]),
        ("Configuration", 2, 1, 50.0, "🌓", ["SECRET_ZZ"]),
    ]
    assert mini["epistemic"] == {
        "know": 0.69, "uncertainty": 0.38, "overall_coverage": 62.5, "total_features": 8,
        "documented_features": 5, "assessment": "Documentation has notable gaps", "moon": "🌓",
        "recommendations": [
            "Document Classes: Qwerty",
            "Document API Endpoints: * /x/y/z/",
            "Document Configuration: SECRET_ZZ",
        ],
    }
    assert mini["strict"] is False
    assert mini["discovery"] == {
        "cli_commands": 1, "classes": 2, "public_functions": 1, "api_endpoints": 2, "config_options": 2,
    }
    assert got["bare"]["epistemic"]["assessment"] == "No features discovered"


def test_strict_changes_symbols_only(spark, make_files):
    files = make_files({"mini": MINI})
    strict = plan.assess(files, strict=True).collect()[0].asDict(True)
    assert [(c["name"], c["documented"]) for c in strict["categories"]] == [
        ("CLI Commands", 1), ("Classes", 1), ("Public Functions", 0),
        ("API Endpoints", 1), ("Configuration", 1),
    ]
    assert strict["strict"] is True


def test_depth_is_a_display_cap(spark, make_files):
    options = "\n".join(f"os.getenv('QZ_{i:03d}')" for i in range(120))
    files = make_files({"m.py": options})
    for depth, shown in ((1, 20), (2, 50), (3, 100), (9, 20)):
        entry = plan.assess(files, depth=depth).collect()[0]["categories"][0]
        assert (entry["total"], len(entry["undocumented"])) == (120, shown)


def test_previews_are_the_first_ones_however_tasks_are_cut(spark):
    rows = [("p", 1 + i % 2, "c", f"f{(7 * i) % 900:03}", i % 3, i, f"l{i}", i % 5 == 0) for i in range(3000)] + [("q", 1, "c", "f", 0, 0, "l", True)]
    status = spark.createDataFrame(rows, "project string, category_ord int, category string, path string, extractor_rank int, pos int, label string, documented boolean")
    got = {(r.project, r.category_ord): r for r in cov.category_coverage(status.repartition(5), 7).collect()}
    for key, row in got.items():
        mine = [r for r in rows if (r[0], r[1]) == key]
        missing = [r[6] for r in sorted(mine, key=lambda r: r[3:6]) if not r[7]]
        assert (row.total, row.documented, row.undocumented) == (len(mine), len(mine) - len(missing), missing[:7])
    assert set(got) == {("p", 1), ("p", 2), ("q", 1)}
    assert cov.category_coverage(status.limit(0)).count() == 0


def test_findings_are_appended_by_day(spark, make_files, tmp_path):
    reports = plan.assess(make_files({"mini": MINI})).persist()
    for day in ("2026-01-01", "2026-01-02"):
        sinks.append_findings(reports, F.to_date(F.lit(day)), str(tmp_path))
    found = sinks.read_findings(spark, str(tmp_path))
    assert found.count() == 2
    first = found.where("run_date = '2026-01-01'").collect()[0]
    assert first["finding"] == "Documentation assessment: 62.5% coverage, know=0.69, uncertainty=0.38"
    assert first["impact"] == 0.7
    assert sinks.read_findings(spark, str(tmp_path), "unknowns").count() == 6
    sinks.write_json(reports, f"{tmp_path}/json")
    text = spark.read.text(f"{tmp_path}/json").collect()[0][0]
    assert json.loads(text)["epistemic"]["total_features"] == 8


def test_runs_that_are_repeated_or_end_early_leave_one_set_of_rows(spark, make_files, tmp_path, monkeypatch):
    path, day = str(tmp_path), F.to_date(F.lit("2026-01-01"))
    before = plan.assess(make_files({"mini": MINI})).persist()
    after = plan.assess(make_files({"mini": MINI, "other": {"m.py": ""}})).persist()

    def seen():
        return [sorted(map(str, sinks.read_findings(spark, path, n).collect())) for n in ("findings", "unknowns")]

    sinks.append_findings(before, day, path)
    once = seen()
    assert [len(rows) for rows in once] == [1, 3]
    sinks.append_findings(before, day, path)
    assert seen() == once
    # The next try ends between the two tables.
    with monkeypatch.context() as broken:
        broken.setattr(sinks, "unknowns", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sinks.append_findings(after, day, path)
    assert seen() == once
    sinks.append_findings(after, day, path)
    assert [len(rows) for rows in seen()] == [2, 4]
    sinks.append_findings(before, day, path, run_id="7")
    assert [len(rows) for rows in seen()] == [3, 7]
    assert spark.read.parquet(f"{path}/findings").count() == 7
    kept = seen()
    sinks.remove_uncommitted(spark, path)
    assert seen() == kept and spark.read.parquet(f"{path}/findings").count() == 3


@pytest.mark.parametrize("seed", range(3))
def test_windows_hold_every_place_that_a_pattern_lies_in(spark, monkeypatch, seed):
    """Runs, separators of all kinds, empty and repeated patterns, null texts, groups in parts, windows forgotten."""
    monkeypatch.setattr(windows, "GROUP_PATTERNS", 3)
    monkeypatch.setattr(windows, "SEEN_WINDOWS", 5)
    monkeypatch.setattr(windows, "BATCH", 4)
    rng = random.Random(seed)
    word = lambda lo, hi: "".join(rng.choice("abAé𝔸0 -_/\n.<") for _ in range(rng.randint(lo, hi)))
    docs = [(rng.choice(["p", "q"]), f"d{i}", word(0, 50)) for i in range(60)] + [("p", "n", None), (None, "x", "a"), ("e", "x", "")]
    held = [(q, t[i : i + n]) for q, _, t in docs if q and t for i, n in [(rng.randint(0, 9), rng.randint(1, 12))] * 2]
    patterns = [*{*held, *((rng.choice(["p", "q", "e"]), word(0, 5)) for _ in range(200)), ("e", ""), ("p", ""), ("gone", "")}]
    forms = spark.createDataFrame([(p, w, f"{w}!") for p, w in patterns] + [(None, "a", "a"), ("p", None, "z")], "project string, pattern string, name string")
    d = spark.createDataFrame(docs, DOC).repartition(3)
    expected = [(p, f"{w}!") for p, w in brute_force(patterns, [x for x in docs if x[2] is not None])]
    assert sorted(map(tuple, windows.mentions(forms, d).collect())) == sorted(expected)
    assert sorted(map(tuple, windows.mentions(forms, colocated.colocate(d.where("text is not null"))).collect())) == sorted(expected)


def test_many_patterns_are_not_multiplied_by_the_documents(spark, small_limits):
    """A search beyond broadcasting sends a pattern to one group, however many parts its project's texts have."""
    docs = [("p", f"d{i}", f"some text with word{i} in it " * 20) for i in range(40)]
    p = spark.createDataFrame([("p", f"word{i} in") for i in range(80)], "project string, pattern string")
    landed = colocated.colocate(spark.createDataFrame(docs, DOC))
    assert landed.parts.first()["parts"] > 10
    found = occurrences.mentioned_patterns(p, landed)
    assert found.count() == 40
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().executedPlan().toString()
    index = signatures.signature_index(landed.docs)
    assert signatures.mentioned_patterns(p, landed.docs, index)[0].count() == 40


@pytest.mark.parametrize("seed", range(3))
def test_filtered_windows_hold_every_pattern_whatever_the_blocks(monkeypatch, seed):
    """Texts longer than a block, patterns longer than a text, characters of several bytes, many projects' filters in one."""
    monkeypatch.setattr(windows, "BLOCK_BYTES", 16)
    rng = random.Random(seed)
    word = lambda lo, hi: "".join(rng.choice("abé𝔸 -") for _ in range(rng.randint(lo, hi))).encode()
    texts = [word(0, 90) for _ in range(40)]
    held = [t[i : i + n] for t in texts for i, n in [(rng.randint(0, 40), rng.randint(1, 40))] * 2]
    patterns = sorted({p for p in [*held, *(word(1, 6) for _ in range(100)), word(200, 200)] if p.decode("utf-8", "ignore").encode() == p and p})
    exponent = 14
    batch = pa.RecordBatch.from_arrays([pa.array(["p"] * len(patterns)), pa.array([p.decode() for p in patterns])], names=["project", "pattern"])
    filled = np.zeros(windows.PAGE_BYTES, np.uint8)
    for out in windows._pages(64 - exponent)([batch]):
        filled |= np.frombuffer(windows._page(pa.Table.from_batches([out])).column("bits")[0].as_py(), np.uint8)
    lengths = sorted({len(p) for p in patterns})
    found = {w for b in windows._blocks(texts, lengths[-1]) for w in windows.windows(b, windows._seed("p"), lengths, filled, 64 - exponent)}
    assert found & {*patterns} == {p for p in patterns if any(p in t for t in texts)}
    few = {w for b in windows._blocks(texts, lengths[-1]) for w in windows.windows(b, windows._seed("q"), lengths, filled, 64 - exponent)}
    assert len(few) < len(found) / 4


def test_texts_give_few_windows_besides_patterns(spark, monkeypatch):
    """What meets the patterns is in proportion to what is found, not to the words of the texts."""
    cut, met = windows.cut, []
    monkeypatch.setattr(windows, "cut", lambda *a: met.append(cut(*a)) or met[-1])
    rng = random.Random(1)
    docs = [("p", f"d{i}", " ".join(f"w{rng.randint(0, 3000)}" for _ in range(500))) for i in range(20)]
    forms = spark.createDataFrame([("p", f"n{i}", f"w{i} w{j}") for i in range(100) for j in range(20)], "project string, name string, pattern string")
    expected = {(p, n) for p, n, w in map(tuple, forms.collect()) if any(w in t for _, _, t in docs)}
    assert {*map(tuple, windows.mentions(forms, spark.createDataFrame(docs, DOC)).collect())} == expected
    assert met[0].count() < 500


def test_short_windows_are_left_out_only_where_their_owner_had_them(monkeypatch):
    """One slot for all: no window is taken for another, another project's, or one of another length."""
    monkeypatch.setattr(windows, "WRITTEN_SHORT", 2)
    rng = random.Random(2)
    written, had = windows._Written(), set()
    for _ in range(200):
        owner, length, block = rng.randint(0, 1), rng.randint(1, 8), bytes(rng.choice(b"\0ab\xff") for _ in range(12))
        places = np.arange(len(block) - length + 1)
        new = {block[i : i + length] for i in written.new(block, places, length, owner).tolist()}
        for w in {block[i : i + length] for i in places.tolist()} - new:
            assert (owner, w) in had
        had |= {(owner, w) for w in new}


def test_windows_written_before_are_forgotten_between_blocks(monkeypatch):
    """However many windows the texts of one project give at a time."""
    for name, value in {"SEEN_WINDOWS": 1000, "BLOCK_BYTES": 1 << 12, "WRITTEN_SHORT": 16}.items():
        monkeypatch.setattr(windows, name, value)
    windows._powers.cache_clear()
    draw = random.Random(3)
    texts = ["".join(draw.choices(string.ascii_letters, k=50_000)) for _ in range(4)]
    batch = pa.RecordBatch.from_pylist([{"project": "p", "text": t} for t in texts])
    lengths = {windows.zlib.crc32(b"p") % windows.LENGTH_KEYS: [0, 20]}
    filled = np.full(windows.PAGE_BYTES, 255, np.uint8)  # all windows pass
    found = set()
    tracemalloc.start()
    for out in windows._new_windows([batch], lengths, filled, 64 - 21):
        found.update(hash(p) for p in out.column(1).to_pylist())
        assert out.column(0).unique().to_pylist() == ["p"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    windows._powers.cache_clear()
    assert found == {hash(t[i : i + 20].encode()) for t in texts for i in range(len(t) - 19)} | {hash(b"")}
    assert peak < 22_000_000


def test_few_patterns_are_looked_up_in_one_text_at_a_time(spark, monkeypatch):
    """Not with all texts of an Arrow batch as Python strings."""
    passes = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, scan, schema: passes.append(scan))
    patterns = spark.createDataFrame([("p", "needle")], "project string, pattern string")
    occurrences._by_broadcast(patterns, spark.createDataFrame([], DOC), occurrences._found, occurrences._FOUND_ARROW, occurrences._FOUND)
    rows = [{"project": "p" if i % 2 else None, "path": str(i), "text": "\u4e2d" * 100_000 + "needle" * (i % 4 == 1)} for i in range(100)]
    batch = pa.RecordBatch.from_pylist(rows)
    list(passes[0]([batch.slice(0, 2)]))
    tracemalloc.start()
    found = [r for out in passes[0]([batch]) for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [{"project": "p", "path": str(i), "patterns": ["needle"]} for i in range(1, 100, 4)]
    assert peak < 5_000_000  # all texts are 20 MB


def test_many_patterns_are_searched_in_groups_and_met_by_few(spark, monkeypatch):
    """Projects in several groups, one in shares: no filter gets more patterns than it is made for, and what no window holds is not joined."""
    monkeypatch.setattr(windows, "SEARCH_PATTERNS", 150)
    monkeypatch.setattr(windows, "JOINED_PATTERNS", 0)
    made, passing, left = windows._filter, windows._passing, []
    counts = []
    monkeypatch.setattr(windows, "_filter", lambda patterns, count, *a: counts.append((patterns.count(), a)) or made(patterns, count, *a))
    monkeypatch.setattr(windows, "_passing", lambda *a: left.append(passing(*a)) or left[-1])
    rng = random.Random(4)
    docs = [(p, f"{p}{i}", "é " + " ".join(f"w{rng.randint(0, 300)}" for _ in range(60))) for p in ("big", "p0", "p1", "p2") for i in range(4)]
    docs += [("big", "none", None), (None, "x", "w1 w2")]
    names = [("big", f"w{rng.randint(0, 300)}", f"w{rng.randint(0, 300)}") for _ in range(300)] + [(f"p{i % 4}", f"w{i}", f"w{rng.randint(0, 300)}") for i in range(240)]
    rows = {(p, f"{a}-{b}", form) for p, a, b in names for form in (f"{a}-{b}", f"{a} {b}", f"{a}_{b}", f"{a}")} | {("big", "empty", ""), (None, "w1", "w1"), ("p1", "w2", None)}
    forms = spark.createDataFrame(sorted(rows, key=str), "project string, name string, pattern string")
    expected = {(p, n) for p, n, w in rows if p and w is not None and any(w in (t or "") for q, _, t in docs if q == p)}
    d = spark.createDataFrame(docs, DOC)
    for there in (d, colocated.colocate(d.where("text is not null"))):
        found = [tuple(r) for r in windows.mentions(forms, there).collect()]
        assert sorted(found) == sorted(expected)
    first = [n for n, a in counts if not a]
    assert len(first) > 6 and max(first) < len(rows) / 2
    assert sum(df.count() for df in left) < 2 * len(rows) / 2
    assert windows.mentions(forms.limit(0), d).count() == 0


def test_a_filter_is_shuffled_once_for_a_task(monkeypatch):
    """Not a place for each of the bits that each pattern sets."""
    patterns = pa.array([f"name-{i}" for i in range(200_000)])
    batch = pa.RecordBatch.from_arrays([pa.array(["p"] * len(patterns)), patterns], names=["project", "pattern"])
    exponent = 22
    out = list(windows._pages(64 - exponent)([batch.slice(i, 10_000) for i in range(0, len(patterns), 10_000)]))
    assert sum(b.nbytes for b in out) < 1.1 * (1 << exponent) / 8
    filled = np.concatenate([np.frombuffer(windows._page(pa.Table.from_batches([b])).column("bits")[0].as_py(), np.uint8) for b in out])
    text = b" ".join(p.encode() for p in patterns[::1000].to_pylist())
    assert {p.as_py().encode() for p in patterns[::1000]} <= {*windows.windows(text, windows._seed("p"), sorted({len(p.as_py()) for p in patterns}), filled, 64 - exponent)}


@pytest.mark.parametrize("joined", [0, 1_000_000])
def test_parts_are_sent_only_the_patterns_that_occur_there(spark, small_limits, monkeypatch, joined):
    """Not all of the project's patterns to each of its parts, which grows with both."""
    monkeypatch.setattr(windows, "JOINED_PATTERNS", joined)
    search, sent = colocated.search, []
    monkeypatch.setattr(colocated, "search", lambda patterns, *a: sent.append(patterns) or search(patterns, *a))
    docs = [("p", f"d{i}", f"word{i} " * 20) for i in range(40)] + [("q", "d", "word1"), (None, "x", "word2")]
    patterns = [("p", f"word{i}") for i in range(60)] + [("q", "word2"), ("q", "word1"), (None, "word2")]
    found = occurrences.found_documents(spark.createDataFrame(patterns, "project string, pattern string"), spark.createDataFrame(docs, DOC))
    got = {}
    for r in found.collect():  # a row for each chunk of patterns
        got.setdefault((r.project, r.path), set()).update(r.patterns)
    want = {(q, d): {w for p, w in patterns if p == q and w in t} for q, d, t in docs if q}
    assert got == {k: v for k, v in want.items() if v}
    landed = colocated.colocate(spark.createDataFrame(docs, DOC))
    assert landed.parts.first().parts > 10
    assert "part" in sent[0].columns and sent[0].count() < 3 * 40  # each pattern goes to the parts of its documents, not to all
