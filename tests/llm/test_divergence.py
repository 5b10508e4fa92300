"""The source audit against brute force, with awkward rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from doclumen.llm import divergence as div

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, p long, side int, term string"


def brute(table, min_docs, top):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    docs = [(lang or "", source or "", [low(t) for t in TERM.findall(text or "")]) for text, lang, source in table]
    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        groups[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = set()
    for lang in {k[0] for k in groups}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        every = Counter()
        for (of, _), counts in groups.items():
            every.update(counts if of == lang else {})

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        mine = {s: shares(c) for (of, s), c in groups.items() if of == lang}
        q = shares(every)
        for s, p in mine.items():
            pairs = [(-sum(abs(p[t] - o[t]) for t in kept), other.encode(), other) for other, o in mine.items() if other != s]
            terms = [(-(p[t] - q[t]), t.encode(), t) for t in kept if groups[lang, s][t] and p[t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(ranked, 1)}
    return out


def table(n=300):
    rng = np.random.default_rng(8)
    words = ["a", "Über", "ß" * 3, "exactly8", "sixteen" + "x" * 9, "seventeen" + "y" * 8, "long" * 20, "naïveté", "日本語", "zzz", "ZZZ", "mid_word", "tail9"]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words, int(rng.integers(0, 12)))) + ("\n" if i % 3 else "\x00\t.")
        lang = (None, "en", "de", "en", "")[i % 5]
        out.append((text, lang, None if i % 11 == 0 else f"s{int(rng.integers(0, 9))}" if rng.random() < 0.7 else "s0"))
    out += [("only here", "rare", "one"), ("", "rare", "two"), (None, "rare", None), ("x" * 100_000, "en", "s0"), (None, "en", "silent")]
    return out + [out[4]] * 40


def collected(spark, rows, **options):
    full = [(i, *r, 1, 2, 3, "a") for i, r in enumerate(rows)]
    out = div.divergence(spark.createDataFrame(full, SCHEMA).repartition(3), **options)
    found = out.select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


@pytest.mark.parametrize("block, waiting, size", [(div.BLOCK_SOURCES, div.WAITING, div.SLICE_BYTES), (2, 3, 64)])
def test_divergence(spark, monkeypatch, block, waiting, size):
    """Also with several blocks of sources, terms compared a few at a time, and texts counted singly."""
    monkeypatch.setattr(div, "BLOCK_SOURCES", block)
    monkeypatch.setattr(div, "WAITING", waiting)
    monkeypatch.setattr(div, "SLICE_BYTES", size)
    rows = table()
    want = brute(rows, 30, 5)
    assert collected(spark, rows, top=5) == want
    assert {"pair", "term"} == {r[2] for r in want} and ("rare", "one", "pair", "two", 0, 2) in want


def test_divergence_of_nothing(spark):
    assert div.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collected(spark, [(None, None, None)] * 3) == set()


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, terms = 3 * 10**17, 9 * 10**17 + 1, 7
    got = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long").select(div.share(*(div.F.col(c) for c in ("n", "total", "terms")))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_radix_order_is_stable():
    rng = np.random.default_rng(0)
    high, low = rng.integers(0, 3, 1000).astype(np.uint64) << np.uint64(60), rng.integers(0, 5, 1000).astype(np.uint64) << np.uint64(20)
    assert (div.radix_order(high, low) == np.lexsort((low, high))).all()
