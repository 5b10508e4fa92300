"""The training-data operators against brute force on small tables with awkward rows."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from doclumen.llm import embedding_dedup as emb
from doclumen.llm import labelled
from doclumen.llm import line_dedup as lines
from doclumen.llm import mixing, packing, quality_classifier, quality_rules, sharding, simhash, toxicity
from doclumen.llm import substring_dedup as subs
from doclumen.llm.common import components, land

# Extra columns have the names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, fp long, _uid long, ord long, kept string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = np.random.default_rng(1)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 8))) for _ in range(300)]

    def prose(n):
        return "".join(w + (".\n" if k % 9 == 8 else " ") for k, w in enumerate(rng.choice(vocabulary, n)))

    texts = [prose(int(n)) for n in rng.integers(1, 150, 40)]
    shared = prose(60)
    texts += [t + shared for t in texts[:6]] + texts[:3] + [texts[7].replace(" ", "  ", 1), None, None, "", " \n\t", "é" * 70, "a " * 3000]
    texts += ["!! " * 40, "ONE two\x00three " * 9, prose(6000), texts[10]]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else "s0", None if t is None else len(t), 1, 2, 3, 4, 5, "x") for i, t in enumerate(texts)]
    out.append((3, texts[3], None, None, None, None, None, None, None, None, None))  # a repeated row
    out.append((None, texts[4], "en", None, 5, 1, 2, 3, 4, 5, "x"))
    out.append((None, None, None, None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, empty):
    out = sharding.kd_shards(docs, shards=8).toPandas()
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    got = sorted((x is None or x != x, 0 if x != x else int(x), s, c) for x, s, c in zip(out.doc_id, out["size"], out.text_crc32))
    assert got == want
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert set(out.shard) <= set(range(8))
    assert sharding.kd_shards(empty, shards=8).count() == 0


def test_shards_of_equal_rows_are_balanced(spark):
    same = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("text").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"))
    sizes = sharding.kd_shards(same, shards=8).groupBy("shard").count().toPandas()["count"]
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    assert sharding.kd_shards(same, target_bytes=5 * 1000).select("shard").distinct().count() == 4


def brute_fingerprint(text):
    from xxhash import xxh64

    found = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_simhash(docs, empty):
    out = simhash.simhash(docs).collect()
    fps = [brute_fingerprint(r[1]) for r in rows()]
    of = reach(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    ids = [r[0] for r in rows()]
    least = [min((ids[k] for k in range(len(ids)) if of[k] == c and ids[k] is not None), default=None) for c in of]
    want = Counter(zip(ids, fps, least))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in out) == want
    assert simhash.simhash(empty).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(brute_similar([r[1] for r in rows()])))
    assert simhash.deduplicated(empty).count() == 0


def test_masks_cover_every_small_difference():
    masks = simhash.masks()
    for places in np.random.default_rng(0).integers(0, 64, (2000, 3)).tolist():
        assert any(all(not m >> p & 1 for p in places) for m in masks)


def brute_similar(texts):
    """Where each text's group by five-word Jaccard similarity of 0.8 or more starts."""
    found = [WORDS.findall((t or "").lower()) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()} for w in found]
    return reach(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))


def near_copies(n=40, copies=4):
    """Texts of 60 to 400 words, each with copies in which every fortieth word or so differs."""
    rng = np.random.default_rng(5)
    texts = []
    for at in range(n):
        words = [f"w{k}" for k in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        texts.append(" ".join(words))
        for c in range(copies):
            copy = list(words)
            for place in range(int(rng.integers(0, 40)), len(copy), 60):
                copy[place] = f"new{at}x{c}x{place}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("block", [simhash.SET_BLOCK, 2])
def test_near_copies_at_similarity_go(spark, monkeypatch, block):
    """Most of these copies differ in more than three bits of a 64-bit fingerprint."""
    monkeypatch.setattr(simhash, "SET_BLOCK", block)
    texts = near_copies()
    of = brute_similar(texts)
    fps = [brute_fingerprint(t) for t in texts]
    apart = len(set(reach(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)))
    assert apart > 2 * len(set(of))
    kept = simhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    first = {of.index(x) for x in set(of)}
    assert first <= {r.doc_id for r in kept} and len(kept) <= len(first) + 2


def test_parts_of_fingerprints_find_sets_at_the_limit():
    rng = np.random.default_rng(3)
    hit, n = 0, 300
    for _ in range(n):
        every = rng.integers(0, 2**63, 900).astype(np.uint64)
        one, two = np.sort(every[:810]), np.sort(every[90:])  # 720 of 900 in common
        fps = np.stack([simhash.long_fingerprint(one), simhash.long_fingerprint(two)])
        keys = simhash.part_keys(fps)
        hit += bool((keys[0] == keys[1]).any()) and np.bitwise_count(fps[0, :16] ^ fps[1, :16]).sum() <= simhash.CHECK_RADIUS
        assert simhash._similar(one, two) and not simhash._similar(one[one != np.intersect1d(one, two)[0]], two)
    assert hit >= 0.97 * n


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    fps = [(1 << i) | (1 << 40) for i in range(30)] + [0x5555 << 30]
    found = components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()
    assert {r.component for r in found} == {min(fps[:30])} and len(found) == 30


def brute_substrings(table):
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, b in sorted(((r[0], (r[1] or "").encode()) for r in table), key=lambda x: key(x[0])):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], key(i))
    out = []
    for i, b in ((r[0], (r[1] or "").encode()) for r in table):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key(i):
                gone[k : k + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("many", [subs.MANY_STRETCHES, 1])
def test_substrings(docs, empty, monkeypatch, many):
    """With a limit of one stretch for an anchor every shared window takes the way for hot anchors."""
    monkeypatch.setattr(subs, "MANY_STRETCHES", many)
    want = brute_substrings(rows())
    out = subs.substring_digests(docs).collect()
    assert Counter(tuple(r) for r in out) == Counter((*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in want)
    if many > 1:
        kept = subs.substring_dedup(docs).collect()
        assert {(*r[:4], bytes(r[4])) for r in kept} == set(want)
        assert subs.substring_digests(empty).count() == 0


def test_repeated_rows_have_one_list_of_stretches(spark, monkeypatch):
    counts = []

    def counted(df, *args, **kwargs):
        out = land(df, *args, **kwargs)
        if {"stretch", "start"} <= set(out.columns):
            counts.append(out.count())
        return out

    monkeypatch.setattr(subs, "land", counted)
    shared = " ".join(f"word{k}" for k in range(30))
    once = [(1, "first " + shared), (2, "second " + shared), (None, "third " + shared)]
    for times in (1, 20):
        out = subs.substring_digests(spark.createDataFrame(once * times, "doc_id long, text string")).collect()
        want = Counter((w[0], w[2]) for w in brute_substrings(once * times))
        assert Counter((r.doc_id, r.n_removed) for r in out) == want
    assert counts[0] == counts[1] > 0


def test_pairs_sort_as_one_number_or_by_key():
    rng = np.random.default_rng(8)
    for top in (1, 50, 2**31):
        high, low = rng.integers(0, top, (2, 5000))
        order, key = subs._by_pairs(high, low)
        assert sorted(order.tolist()) == list(range(5000)) and (np.diff(key.astype(np.float64)) >= 0).all()
        assert [(h, w) for h, w in zip(high[order], low[order])] == sorted(zip(high, low))
        assert ((key[1:] == key[:-1]) == ((np.diff(high[order]) == 0) & (np.diff(low[order]) == 0))).all()


def test_smallest_documents_of_windows_equal_brute_force():
    rng = np.random.default_rng(9)
    for letters in (1, 2, 256):
        strings = [rng.integers(0, letters, int(rng.integers(50, 77))).astype(np.uint8).tobytes() for _ in range(20)]
        strings += [s[: int(rng.integers(50, len(s) + 1))] for s in strings]
        documents = rng.permutation(len(strings))
        index = subs.RunLengthIndex(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), documents)
        least = {}
        for s, d in zip(strings, documents):
            for p in range(len(s) - 49):
                least[s[p : p + 50]] = min(d, least.get(s[p : p + 50], d))
        for active, place, row in index.stream():
            whole = index.lengths[active] - place >= 50
            for s, p, d in zip(active[whole], place[whole], index.smallest(row[whole])):
                assert least[strings[s][p : p + 50]] == d


def test_run_length_index_inverts_its_strings():
    strings = [b"abracadabra" * 6, b"x" + b"abracadabra" * 6, b"\x00\xff" * 30, b"abracadabra" * 6]
    lengths = np.array([len(s) for s in strings])
    index = subs.RunLengthIndex(np.frombuffer(b"".join(strings), np.uint8), lengths, np.array([4, 3, 2, 1]))
    assert len(index.run_starts) < lengths.sum() / 2
    for active, place, row in index.stream():
        for s, p, r in zip(active, place, row):
            window = strings[s][p : p + 50]
            if len(window) == 50:
                assert index.smallest(np.array([r]))[0] == min(d for t, d in zip(strings, (4, 3, 2, 1)) if window in t)


def test_lines(docs, empty):
    out = lines.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_removed_lines", "n_removed_chunks"]
    seen, want = set(), []
    order = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))
    for r in order:
        if r[1] is None or (r[0] == 3 and r[2] is None):  # alike in id and text: treated as the other
            continue
        parts, gone = r[1].encode().split(b"\n"), set()
        for at, n in lines.chunks(parts):
            chunk = b"\n".join(parts[at : at + n])
            if chunk in seen:
                gone |= set(range(at, at + n))
            seen.add(chunk)
        want.append((r[0], b"\n".join(x for k, x in enumerate(parts) if k not in gone).decode()))
    got = out.filter("text is not null").collect()
    assert {(r.doc_id, r.text) for r in got} == set(want) and out.count() == len(rows())
    assert all(r.n_chars == len(r.text) for r in got if r.n_removed_lines)
    assert sum(r.n_removed_chunks for r in got) > 5
    assert lines.line_dedup(empty).count() == 0


def test_passages_between_other_lines_are_found():
    """Passages of some lines have a chunk of their own nearly always; no line is in over two chunks."""
    rng = np.random.default_rng(4)
    line = lambda: bytes(rng.integers(97, 123, 30).astype(np.uint8))
    found = 0
    for _ in range(500):
        passage = [line() for _ in range(3)]
        first, second = ([line() for _ in range(4)] + passage + [line() for _ in range(4)] for _ in range(2))
        held = {tuple(first[at : at + n]) for at, n in lines.chunks(first)}
        gone = {k for at, n in lines.chunks(second) if tuple(second[at : at + n]) in held for k in range(at, at + n)}
        found += gone == {4, 5, 6}
        covered = Counter(k for at, n in lines.chunks(second) for k in range(at, at + n))
        assert max(covered.values()) <= 2 and not gone - {4, 5, 6}
    assert found > 400
    assert lines.chunks([b""] * 1000 + [b"a"] + [b" "] * 1000) == [] and lines.chunks([b"one line"]) == []


def test_quality_rules(docs, empty):
    out = quality_rules.quality_rules(docs).collect()
    want = Counter()
    for r in rows():
        text = r[1] or ""
        found = WORDS.findall(text)
        counts = Counter(tuple(found[k : k + 8]) for k in range(len(found) - 7))
        covered = {k + j for k in range(len(found) - 7) if counts[tuple(found[k : k + 8])] > 1 for j in range(8)}
        with_word = [x for x in text.split("\n") if WORDS.search(x)]
        failed = len(found) < 20 or 100 * len(covered) > 30 * len(found)
        want[(r[0], len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(with_word) - len(set(with_word)), len(covered), failed)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert quality_rules.quality_rules(empty).count() == 0


def test_bad_hosts_are_turned_down(spark):
    table = [(h, i < f) for h, n, f in (("bad", 400, 380), ("good", 400, 4), ("small", 1, 1), (None, 300, 3), ("fair", 300, 30)) for i in range(n)]
    rates = {r.host: r.rate for r in quality_rules.host_rates(spark.createDataFrame(table, "h string, f boolean"), "h", "f").collect()}
    assert rates["bad"] > 0.9 and rates["good"] < 0.05 and 0.2 < rates["small"] < 1


def host_documents(spark, hosts):
    """Documents of hosts (name, documents, of these failing by few words, of these by repeats)."""
    good = " ".join(f"word{k}" for k in range(40))
    repeats = "one two three four five six seven eight " * 5
    table = []
    for host, n, short, repeated in hosts:
        texts = ["too short"] * short + [repeats] * repeated + [good] * (n - short - repeated)
        table += [(t, host) for t in texts]
    rows = [(i, t, h) for i, (t, h) in enumerate(table)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_host_verdicts_decide_about_clean_documents(spark):
    hosts = [("bad", 200, 180, 5), ("worse", 60, 0, 60), ("good", 200, 2, 0), ("fair", 100, 8, 7), ("one", 1, 1, 0), (None, 120, 70, 45)]
    n = np.array([h[1] for h in hosts], float)
    failures = np.array([h[2] + h[3] for h in hosts], float)
    mean, raw = failures.sum() / n.sum(), failures / n
    spread = mean * (1 - mean)
    between = raw.var(ddof=1) - spread * (1 / n).mean()
    assert between > 0
    strength = spread / between - 1
    want = dict(zip((h[0] for h in hosts), (failures + mean * strength) / (n + strength)))
    out = quality_rules.quality_rules(host_documents(spark, hosts)).collect()
    source = [h[0] for h in hosts for _ in range(h[1])]
    for r in out:
        host = source[r.doc_id]
        assert r.host_rate == pytest.approx(want[host])
        assert r.kept == (not r.base_failed and want[host] <= quality_rules.MAX_HOST_RATE)
    lost = Counter(source[r.doc_id] for r in out if not r.base_failed and not r.kept)
    assert lost == {"bad": 15, None: 5} and sum(r.kept for r in out) == 198 + 85


def test_hosts_that_do_not_differ_share_a_rate(spark):
    out = quality_rules.quality_rules(host_documents(spark, [("a", 50, 5, 0), ("b", 50, 0, 5), (None, 50, 5, 0)])).collect()
    assert {round(r.host_rate, 12) for r in out} == {0.1} and all(r.kept == (not r.base_failed) for r in out)
    out = quality_rules.quality_rules(host_documents(spark, [(None, 10, 10, 0)])).collect()
    assert {r.host_rate for r in out} == {1.0} and not any(r.kept for r in out)


def test_mixing(docs, empty):
    out = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    total, order = sum(sizes.values()), sorted((s for s in sizes if s is not None)) + [None]
    weights = dict(zip(order, (5, 2, 1) * 9))
    target, full = {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else rest * w / sum(weights[t] for t in order if t not in full) for s, w in weights.items()}
        above = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            break
        full |= above
    of = {(r[0], r[1]): r[3] for r in rows()}
    assert len(out) == len(rows()) and set(of.values()) == set(order)
    assert all(r.taken <= 3 * r["size"] for r in out)
    by_target = Counter()
    for r in out:
        by_target[round(r.target, 6)] += r.taken
    for t, taken in by_target.items():
        n = sum(1 for s in order if round(target[s], 6) == t)
        assert n and abs(taken - n * t) <= n
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, out))
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORDS.findall(r.text)) for r in mixed.collect()) == sum(r.taken for r in out)


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        for key in (0, 5, -3):
            there = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(there) == list(range(n))
            assert mixing.permuted(there, np.full(n, n), np.full(n, key), back=True).tolist() == list(range(n))


def test_sources_of_few_words_meet_their_targets(spark):
    """Sources smaller than a block, with a short last block, of one size, and without words."""
    sizes = [20, 20, 20, 0, 1, 63, 64, 65, 70, 127, 128, 1000, 7, 333]
    table = [(100 * k + j, " ".join(["w"] * (n // 3 if j < 2 else n - 2 * (n // 3))), f"s{k:02d}") for k, n in enumerate(sizes) for j in range(3)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    for seed in range(4):
        by_source = Counter()
        target = {}
        for r in mixing.mix(docs, seed).collect():
            assert r.taken <= 3 * r["size"]
            by_source[r.doc_id // 100] += r.taken
            target[r.doc_id // 100] = r.target
        assert all(abs(by_source[k] - t) <= 0.5 + 1e-9 for k, t in target.items())
        assert sum(target.values()) == pytest.approx(sum(sizes))


def test_shards_draw_multinomial_counts(spark, monkeypatch):
    """Every slot is in one shard, counts spread as a multinomial does, and many shards are drawn by ranges."""
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 100)
    monkeypatch.setattr(mixing, "FAN", 7)
    quota = {0: 40_000, 1: 9_000, 2: 1, 3: 0}
    rows = [(rank, n // 2 + 1, 64, n, 0) for rank, n in quota.items()]
    sources = spark.createDataFrame(rows, "rank long, blocks long, last_words long, quota long, cut long")
    counts = mixing.shard_counts(sources, 5).toPandas()
    assert counts.groupby("rank").n.sum().to_dict() == {k: n for k, n in quota.items() if n}
    for _, part in counts.sort_values(["rank", "shard"]).groupby("rank"):
        assert part["first"].tolist() == (part.n.cumsum() - part.n).tolist()
    shards = -(-sum(quota.values()) // 100)
    for rank in (0, 1):
        drawn = np.zeros(shards)
        part = counts[counts["rank"] == rank]
        drawn[part["shard"]] = part.n
        mean = quota[rank] / shards
        assert 0.75 < drawn.var() / mean < 1.3 and abs(drawn - mean).max() < 6 * mean**0.5
    found = mixing.slots(sources, 5).toPandas()
    assert len(found) == sum(quota.values()) and not found.duplicated(["source_rank", "slot"]).any()
    assert (found.groupby(["source_rank", "cycle"]).block.nunique() == found.groupby(["source_rank", "cycle"]).size()).all()
    drawn = {(r.shard, r.source_rank): r.n for r in mixing.shard_counts(sources, 5).withColumnRenamed("rank", "source_rank").collect()}
    assert found.groupby(["shard", "source_rank"]).size().to_dict() == drawn


def test_mixed_shards_hold_what_the_mix_takes(docs, empty):
    shards = mixing.mixed_shards(docs).collect()
    got, want = Counter(), Counter()
    for r in shards:
        assert len(WORDS.findall(r.text)) <= mixing.BLOCK_WORDS
        got.update((r.source, w) for w in WORDS.findall(r.text))
    for r in mixing.mixed_documents(docs).collect():
        want.update((r.source, w) for w in WORDS.findall(r.text))
    assert got == want
    places = {}
    for r in shards:
        places.setdefault(r.shard, []).append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert mixing.mixed_shards(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_rows_alike_are_parted_and_whole(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_DOCS", 50)
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit(None).cast("string").alias("source"))
    out = mixing.mix(docs)
    assert out.count() == 2000 and out.agg(F.sum("taken")).first()[0] == 6000 and out.agg(F.max("taken")).first()[0] <= 9


def test_cut_texts_keep_their_line_feeds(spark):
    lines = "\n".join(f"{i} one  two" for i in range(2000))
    docs = spark.createDataFrame([(1, lines, "a", 5), (2, lines, "b", 5), (3, lines, "c", 5), (4, lines, "c", 5)], "doc_id long, text string, source string, `a.b` int")
    for r in mixing.mixed_documents(docs).collect():
        pieces = re.findall(r"\d+ one  two\n\d+ one  two", r.text)
        assert r["a.b"] == 5 and len(pieces) > len(r.text.split("\n")) / 4
        assert set(WORDS.findall(r.text)) <= set(WORDS.findall(lines))


def test_columns_with_dots_pass_through(spark):
    text = "\n".join(f"line {i} of a text that stands twice" for i in range(20))
    docs = spark.createDataFrame([(1, text, "a", 5, 6), (2, text, "b", 7, 8)], "doc_id long, text string, source string, `a.b` int, `c``d` int")
    for out in (lines.line_dedup(docs).select("*"), simhash.deduplicated(docs), mixing.mixed_documents(docs)):
        assert out.columns[:5] == docs.columns
        assert {r["a.b"] for r in out.collect()} <= {5, 7}


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r in rows():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(r[0], piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    out = packing.pack_documents(docs).collect()
    assert Counter(tuple(r[:5]) for r in out) == want
    filled = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) + 1
    assert packing.pack_documents(empty).count() == 0


def test_packing_is_tight_though_few_bins_are_open(spark, monkeypatch):
    """Closings happen, and sequences stay within a hundredth of the fewest there can be."""
    pieces = spark.createDataFrame([(i, 0, 0, int(n), 1) for i, n in enumerate(np.random.default_rng(4).integers(1, 1300, 6000))], packing.PIECES)
    for bins, most in ((packing.OPEN_BINS, 1.01), (8, 1.6)):
        monkeypatch.setattr(packing, "OPEN_BINS", bins)
        monkeypatch.setattr(packing.BestFit.__init__, "__defaults__", (packing.SEQUENCE, bins))
        out = packing.pack(pieces.repartition(3)).toPandas()
        used, fewest = out.sequence_id.nunique(), -(-out.length.sum() // packing.SEQUENCE)
        assert len(out) == 6000 and out.groupby("sequence_id").length.sum().max() <= packing.SEQUENCE
        assert used <= most * fewest and (bins > 8 or used > 1.01 * fewest)


@pytest.mark.parametrize("text", ["a <|endoftext|> B", "<|ENDOFTEXT|>.", "don't I'LL é ́a.", "a\x1cb \x85c", "ÈÉ İa ŉ ǅ ſ ½ ª.", "x...y, A.B.", "\x00 �"])
def test_ids_of_stretches_equal_those_of_the_text(text):
    ids = packing.WordIds(packing.default_tokenizer())
    want = [*ids.tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert np.frombuffer(ids.ids(text.encode()), "<u4").tolist() == want


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(capacity=10, open_bins=2)
    assert [fit.place(n) for n in (6, 7, 8, 4, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    table = [(i, (centres[i % 20] + rng.normal(size=16) * (0.02 + 0.01 * (i % 9))).tolist(), 0) for i in range(200)]
    table += [(200, table[5][1], 1), (201, None, 1), (202, [0.0] * 16, 1), (203, [1.0, None] * 8, 1), (204, [float("nan")] * 16, 1), (205, [], 1)]
    table += [(206, [1e30, -1e30], 1), (207, [1e-30, -1e-30], 1), (208, [1.0], 0), (7, table[7][1], 0)]
    out = emb.embedding_dedup(spark.createDataFrame(table, "vec_id long, embedding array<double>, node int")).collect()
    good = lambda v: v and None not in v and np.isfinite(v).all() and any(v)
    unit = [np.array(v) / max(map(abs, v)) if good(v) else None for _, v, _ in table]
    unit = [u if u is None else u / np.linalg.norm(u) for u in unit]
    linked = lambda i, j: unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95
    of = reach(len(table), linked)
    ids = [r[0] for r in table]
    least = [min(ids[k] for k in range(len(ids)) if of[k] == c) for c in of]
    want = Counter((ids[i], sum(linked(i, j) for j in range(len(ids)) if j != i), least[i], ids[i] == least[i]) for i in range(len(ids)))
    assert Counter(tuple(r) for r in out) == want
    assert emb.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("classify, label", [(toxicity.toxicity, "toxic"), (quality_classifier.quality, "quality")])
def test_classifiers_on_held_out_rows(spark, docs, empty, classify, label):
    folder = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = classify(table, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (out.predicted == out[label]).mean() > 0.98 and out.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out.doc_id, out.held_out))
    few = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert classify(docs, few).filter("score between 0 and 1").count() == len(rows())
    assert classify(docs, few.limit(0)).count() == len(rows()) and classify(empty, few).count() == 0


def test_repeated_ids_count_once_in_samples(spark):
    table = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(7, f"more {k}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    want = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20))
    got = labelled.sample(table, labels, "toxic").collect()
    assert len(got) == want and zlib.crc32(b"7") % 5
    assert [(r.text, r.label) for r in got if r.text.startswith("more")] == [("more 0", 1)]
    assert labelled.sample(table, labels, "toxic", rows=5).count() == 5


def test_features_of_long_words_cost_their_length():
    measure = toxicity.features({"abcd": toxicity.STRONG})
    for text in ("a" * 10_000_000, "a" * 5_000_000 + "1" * 5_000_000, "é" * 5_000_000, "a1" * 5_000_000):
        began = time.perf_counter()
        measure(text)
        assert time.perf_counter() - began < 10
    assert toxicity.OBFUSCATED.findall("w0rd xx5 a.b.c a1b2c3 d.ee x") == ["w0rd", "a.b.c", "a1b2c"]


def test_isotonic_rises():
    at, level = toxicity.isotonic(np.array([3.0, 1.0, 2.0, 2.0, 5.0]), np.array([0, 0, 1, 0, 1]))
    assert (np.diff(level) > 0).all() and (np.diff(at) > 0).all() and level[0] == 0 and level[-1] == 1


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "mix", "pack"]
    stay, cut, one, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    a = stay(spark, docs, folder).cache()
    judged = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert {r.doc_id for r in a.collect()} == {i for i, p in judged.items() if not p}
    b = cut(spark, a, folder).cache()
    assert b.columns == docs.columns and b.count() == a.count()
    c = one(spark, b, folder).cache()
    texts = {r.doc_id: r.text for r in b.collect()}
    ids = sorted(texts)
    of = brute_similar([texts[i] for i in ids])
    assert {r.doc_id for r in c.collect()} == {min(ids[k] for k in range(len(ids)) if of[k] == x) for x in set(of)}
    d = mixed(spark, c, folder).cache()
    assert d.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.mix(c).collect()}
    words = Counter()
    for r in d.collect():
        words[r.doc_id] += len(WORDS.findall(r.text))
    assert words == Counter({i: n for i, n in taken.items() if n})
    assert packed(spark, d, folder).agg(F.sum("length")).first()[0] == packing.tokenized(d).agg(F.sum("length")).first()[0]
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """The word that tells good from bad comes in one row in forty only; parts and the bound on samples are small."""
    monkeypatch.setattr(labelled, "LABELLED_ROWS", 10)
    monkeypatch.setattr(quality_classifier, "PART_ROWS", 100)
    rows = [(i, "plain words that say little " * (1 + i % 3) + ("# | # | " * 9 if i % 2 else ""), 1 - i % 2) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    seen = []
    real = quality_classifier.QualityModel._quantile
    monkeypatch.setattr(quality_classifier.QualityModel, "_quantile", lambda self, placed, bad, n: (seen.append((placed.count(), n)), real(self, placed, bad, n))[1])
    out = {r.doc_id: r.predicted for r in quality_classifier.quality(docs, labels).collect()}
    learned = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(400))
    assert seen == [(learned, learned)] and learned > 300
    assert out == {i: y for i, _, y in rows}


def test_no_similar_pair_is_left_out(spark, monkeypatch):
    """Pairs at the limit, of short texts above all, that the masks of the fingerprints miss; a shingle in many texts meets in blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "FOREST_PAIRS", 3)
    rng = np.random.default_rng(11)
    texts = []
    for at in range(150):
        n = [5, 5, 10, 15, 40][at % 5]
        words = [f"w{at}x{i}" for i in range(n + 4)]
        common = " all texts have these five words" if at % 10 == 9 else ""
        texts += [" ".join(words) + common, " ".join(words[: len(words) - n // 5]) + common, " ".join(words[n // 2 :])]
    texts += ["", None, "so few", "all texts have these five words"] * 2
    order = rng.permutation(len(texts)).tolist()
    texts = [texts[i] for i in order]
    of = brute_similar(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = simhash.deduplicated(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(of.index(x) for x in set(of))


def test_prefixes_of_similar_sets_share_a_hash_and_parities_tell_them_no_further_apart():
    rng = np.random.default_rng(12)
    levels = rng.integers(0, 5, simhash.COUNTERS).astype(np.uint8)
    for n in [1, 2, 4, 5, 9, 10, 25, 100, 2500] * 5:
        lost = n // 9
        every = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        one, two = every[lost:], every[: n - lost]
        if not simhash._similar(one, two):
            one = every
        assert simhash._similar(one, two)
        assert len(np.intersect1d(simhash.prefix(one, levels), simhash.prefix(two, levels)))
        assert len(simhash.prefix(every, levels)) <= n // 5 + 1
        a, b = (np.frombuffer(simhash.parities(x), np.uint64) for x in (one, two))
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(one, two)) <= (len(one) + len(two)) / 9 + 1e-6
