"""The trie of conversations against brute force, with awkward rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclumen.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, size long, depth int, rem long, n long"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in own.items():
        digest = lambda t: hashlib.md5("".join(hashlib.md5(x.encode()).hexdigest() for x in t[2:]).encode()).hexdigest()
        own[c] = [t[2:] for t in sorted(turns, key=lambda t: (t[0], t[1], digest(t)))]
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h]) + tuple(turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids.get(path, [])]
        saved = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        sums[path] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = set()
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(rebuilt[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.add((min(who), len(path), parent, len(who), len(kids.get(path, [])), *sums[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def table():
    rng = np.random.default_rng(6)
    out = []
    for c in [*range(60), -7, 10**12, 10**12 + 3]:
        for t in range(int(rng.integers(1, 12))):
            text = ("a", "é" * 3, "", None, "long " * 9)[int(rng.integers(0, 2 if t < 3 else 5))]
            out.append((c, None if rng.random() < 0.1 else t, ("user", "assistant", None)[t % 3], text))
    out += [(70 + c % 4, t, "user", "same") for c in range(40) for t in range(3)]  # repeated rows
    out += [(200, t, "user", f"turn {t}") for t in range(300)] + [(201, t, "user", f"turn {t}") for t in range(290)]  # a deep path
    out += [(300 + 5 * c, 0, "user", "hello") for c in range(100)] + [(None, 1, "user", "nobody"), (None, None, None, None)]
    return out + [(2, 5, "user", "x" * 1_000_000)]


def collected(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    found = trie.prefix_trie(df)
    assert found.columns == NAMES
    out = [tuple(r) for r in found.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("nodes, listed", [(trie.TASK_NODES, trie.LISTED_BYTES), (400, 8)])
def test_trie(spark, monkeypatch, nodes, listed):
    """Also with components split by Spark in several rounds and lists of ids in many rows."""
    monkeypatch.setattr(trie, "TASK_NODES", nodes)
    monkeypatch.setattr(trie, "LISTED_BYTES", listed)
    rounds = []
    split = trie._split_once
    monkeypatch.setattr(trie, "_split_once", lambda *a: rounds.append(1) or split(*a))
    rows = table()
    assert collected(spark, rows) == brute(rows)
    assert bool(rounds) == (nodes == 400)


def test_splitting_by_spark_alone(spark, monkeypatch):
    """Every component of more than one node is split by a round; deep paths take few of them."""
    monkeypatch.setattr(trie, "TASK_NODES", 1)
    rounds = []
    split = trie._split_once
    monkeypatch.setattr(trie, "_split_once", lambda *a: rounds.append(1) or split(*a))
    rows = [(5 * c, t, "user", f"{t if t < 6 or c % 2 else c + t}") for c in range(3) for t in range(20)]
    want = brute(rows)
    assert collected(spark, rows) == want
    assert len(rounds) <= 7


def test_trie_of_nothing(spark):
    assert collected(spark, []) == set() and collected(spark, [(None, 1, "user", "text")]) == set()
    turnless = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert collected(spark, [(turnless, 0, None, None)]) == {(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())}


def test_running_values_go_on_over_partitions(spark):
    rows = [(0, i) for i in range(5)] + [(1, i) for i in range(1000)] + [(2, 0), (3, 0)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    out = trie.running(df, "k", [F.col("v")], ("v",)).collect()
    held = {k: 0 for k in range(4)}
    ordered = sorted(rows)
    got = sorted((r.k, r.n, r.v) for r in out)
    want = []
    for k, v in ordered:
        held[k] ^= v
        want.append((k, v + 1, held[k]))
    assert got == sorted(want)




def test_subtree_totals():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 400):
        parent = [0] + [int(rng.integers(max(0, i - 5), i)) for i in range(1, n)]
        value = rng.integers(0, 9, n).tolist()
        want, weight = list(value), [1] * n
        for i in range(n - 1, 0, -1):
            want[parent[i]] += want[i]
            weight[parent[i]] += weight[i]
        assert trie.subtree_totals(parent, weight, [value]) == [want]
