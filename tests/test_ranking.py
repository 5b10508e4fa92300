import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from doclumen.operators import ranking


def _tables(spark, seed, docs=400, patterns=30, sets=25):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(patterns)]
    hits = []
    for d in range(docs):
        project = "hot" if d % 3 else "cold"
        # Rare words score high, common ones low: few documents can win.
        found = {n for i, n in enumerate(names) if rng.random() < 1 / (1 + i % 10)}
        score = lambda n: rng.randint(1, 2) if int(n[1:]) % 10 < 5 else rng.choice((1, 3, 9, 15))
        if found:
            hits.append((project, f"d{d:03}", [(n, score(n)) for n in sorted(found)]))
    keyword_sets = {(rng.choice(("hot", "cold", "none")), tuple(sorted(rng.sample(names, rng.randint(1, 6))))) for _ in range(sets)}
    words = [(p, list(k), n) for p, k in keyword_sets for n in k]
    return (
        hits,
        keyword_sets,
        spark.createDataFrame(words, "project string, keywords array<string>, pattern string"),
        spark.createDataFrame(hits, "project string, path string, hits array<struct<pattern string, tenths int>>"),
    )


def _brute(hits, keyword_sets, top, least):
    out = set()
    for project, keywords in keyword_sets:
        scores = defaultdict(int)
        for p, path, found in hits:
            for n, t in found if p == project else ():
                scores[path] += t * (n in keywords)
        best = sorted(((t, path) for path, t in scores.items() if t >= least), reverse=True)[:top]
        out |= {(project, keywords, path, t, i) for i, (t, path) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("seed, top, least", [(0, 5, 2), (1, 1, 2), (2, 300, 2), (3, 5, 40)])
def test_bounded_ranking_equals_scoring_everything(spark, seed, top, least):
    hits, keyword_sets, words, found = _tables(spark, seed)
    ranked = ranking.top_documents(words, ranking.land_postings(found), top, least).collect()
    got = {(r.project, tuple(r["keywords"]), r.path, r.tenths, r.doc_rank) for r in ranked}
    assert len(got) == len(ranked) and got == _brute(hits, keyword_sets, top, least)


def test_postings_that_cannot_matter_are_not_met(spark):
    hits, keyword_sets, words, found = _tables(spark, 4, docs=1500)
    postings = ranking.land_postings(found)
    bounds = ranking.keyword_bounds(words, postings, 5, 2)
    asked = postings.join(words.select("project", "pattern").distinct(), ["project", "pattern"])
    met = ranking.needed_postings(bounds, postings)
    assert 0 < met.count() < 0.7 * asked.count()
    assert bounds.where(~F.col("essential")).count() > 0


def test_keyword_sets_are_not_written_for_each_candidate(spark, monkeypatch):
    """Sets of many long words, each of which ranks many documents: only numbers stand beside the paths."""
    landed = []
    real = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df: (landed.append(df), real(df))[1])
    hits, keyword_sets, words, found = _tables(spark, 6)
    ranked = ranking.top_documents(words, ranking.land_postings(found), 5, 2).collect()
    assert {(r.project, tuple(r["keywords"]), r.path, r.tenths, r.doc_rank) for r in ranked} == _brute(hits, keyword_sets, 5, 2)
    by_document = [dict(df.dtypes) for df in landed if {"path", "keywords"} <= set(df.columns)]
    assert by_document and all(d["keywords"] == "bigint" for d in by_document)


def test_nothing_to_rank(spark):
    _, _, words, found = _tables(spark, 5)
    none = ranking.land_postings(found.limit(0))
    assert ranking.top_documents(words, none, 5, 2).count() == 0
    assert ranking.top_documents(words.limit(0), ranking.land_postings(found), 5, 2).count() == 0
