"""Toxicity by gradient-boosted trees over dense features (operator 7).

The lexicon is learned: word beginnings that labelled toxic documents have far more often
than others.  Trees are fitted on a bounded sample; an isotonic step on rows that the
trees have not seen turns their margin into a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclumen.llm.common import land
from doclumen.llm.labelled import featured, sample, scored

#: Letters of word beginnings in the lexicon.  A strong entry is so much more frequent in toxic
#: documents that all beginnings together have only ``CHANCE`` of bringing one by accident; a
#: weak one needs ``WEAK_SHARE`` of that support and is ``WEAK_RATIO`` times more frequent in them.
SHORTEST, LONGEST = 4, 8
CHANCE, MIN_RATIO = 0.01, 12.0
WEAK_SHARE, WEAK_RATIO = 0.75, 40.0
STRONG, WEAK = 2, 1
#: Most entries; the strong and then the more frequent come first.
MAX_LEXICON = 20_000
#: Words around a lexicon word in which a second-person word is near.
NEAR = 5
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
CUT = 0.5

SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
LETTERS = re.compile(r"[^\W\d_]+")
#: A letter, then digits or signs that stand for letters, then a letter; or letters parted one by one.
#: A run of letters is tried from its start only and never given back, so a long word costs its length.
OBFUSCATED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$*!|]++[^\W\d_]++)++|\b[^\W\d_](?:[.\-_*][^\W\d_]){2,}\b")
STANDS_FOR = str.maketrans("013457@$!|", "oieastasil")


def beginnings(text: str) -> set[str]:
    words = set(LETTERS.findall(text.lower()))
    return {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


def grade(word: str, lexicon: dict[str, int]) -> int:
    """The strongest entry that a word begins with; 0 if none."""
    return max((lexicon.get(word[:k], 0) for k in range(SHORTEST, LONGEST + 1)), default=0)


def learned_lexicon(labelled: DataFrame) -> dict[str, int]:
    """Beginnings that tell toxic from other documents; counted by Spark, at most ``MAX_LEXICON``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, toxic = [], []
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                found = beginnings(text.as_py() or "")
                words.extend(found)
                toxic.extend([label] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int64())], names=["word", "toxic"])

    totals = labelled.agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("o")).first()
    if not totals["t"] or not totals["o"]:
        return {}
    counts = labelled.mapInArrow(each, "word string, toxic long").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    counts = land(counts)
    # In so many toxic documents, and no others, a beginning does not come by accident.
    share = totals["t"] / (totals["t"] + totals["o"])
    support = math.log(CHANCE / max(counts.count(), 1)) / math.log(share)
    ratio = (F.col("t") / totals["t"]) / ((F.col("n") - F.col("t") + 0.5) / totals["o"])
    strong = (F.col("t") >= support) & (ratio >= MIN_RATIO)
    weak = (F.col("t") >= support * WEAK_SHARE) & (ratio >= WEAK_RATIO)
    entries = counts.select("word", "t", F.when(strong, STRONG).when(weak, WEAK).alias("grade")).filter("grade is not null")
    best = entries.orderBy(F.desc("grade"), F.desc("t"), "word").limit(MAX_LEXICON).select("word", "grade").collect()
    return {r["word"]: r["grade"] for r in best}


def features(lexicon: dict[str, int]) -> Callable[[str], list[float]]:
    """Dense features of a whole text."""
    stems = {entry[:SHORTEST] for entry in lexicon}

    def measure(text: str) -> list[float]:
        raw = text.encode("utf-8", "replace")
        byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        size = max(len(raw), 1)
        words = LETTERS.findall(text.lower())
        n = max(len(words), 1)
        graded = [(i, grade(w, lexicon)) for i, w in enumerate(words) if w[:SHORTEST] in stems]
        hits = [i for i, g in graded if g == STRONG]
        weak = sum(g == WEAK for _, g in graded)
        second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = 0
        if hits and second:
            at = np.searchsorted(second, hits)
            ends = np.array([-(10**9), *second, 10**9])
            gap = np.minimum(ends[at + 1] - hits, np.array(hits) - ends[at])
            near = int((gap <= NEAR).sum())
        hidden = OBFUSCATED.findall(text)
        found = sum(grade(re.sub(r"[^\w]|_", "", w.lower().translate(STANDS_FOR)), lexicon) == STRONG for w in hidden)
        capitals = byte[65:91].sum()
        letters = capitals + byte[97:123].sum()
        marks = byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()
        closest = float(np.diff(hits).min()) if len(hits) > 1 else 1e6
        return [
            len(hits) / n, float(len(hits)), weak / n, float(weak), len({words[i] for i in hits}) / n, closest,
            len(second) / n, near / n, float(near), capitals / max(letters, 1),
            byte[33] / size, byte[63] / size, marks / size, byte[48:58].sum() / size,
            len(hidden) / n, float(found), letters / n, float(np.log1p(n)),
        ]

    return measure


def fit_trees(x: np.ndarray, y: np.ndarray) -> tuple[float, list[list[tuple]]]:
    """Boosted trees on the logistic loss.  A tree is a list of levels in heap order:
    ``(feature, threshold)`` for inner nodes, then the leaves' values."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    # Quantiles of a feature that is mostly zero would hide where it begins.
    edges = [np.unique(np.append(e, np.quantile(c[c > 0], np.linspace(0, 1, 9)) if (c > 0).any() else e)) for e, c in zip(edges, x.T)]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node, tree = np.zeros(len(y), np.int64), []
        for _level in range(DEPTH):
            splits = [(0, np.inf)] * (2**_level)
            best = np.full(2**_level, 1e-6)
            for f, e in enumerate(edges):
                width = len(e) + 1
                sums = [np.bincount(node * width + binned[:, f], w, 2**_level * width).reshape(-1, width) for w in (g, h)]
                left_g, left_h = (np.cumsum(s, axis=1)[:, :-1] for s in sums)
                all_g, all_h = (s.sum(axis=1, keepdims=True) for s in sums)
                gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                for k, row in enumerate(gain):
                    if len(row) and row.max() > best[k]:
                        best[k], splits[k] = row.max(), (f, float(e[row.argmax()]))
            goes = np.array([s[1] for s in splits])[node]
            which = np.array([s[0] for s in splits])[node]
            node = 2 * node + (x[np.arange(len(y)), which] > goes)
            tree.append(splits)
        n = 2**DEPTH
        values = RATE * np.bincount(node, g, n) / (np.bincount(node, h, n) + 1)
        margin += values[node]
        trees.append([*tree, values.tolist()])
    return start, trees


def margins(x: np.ndarray, start: float, trees: list[list[tuple]]) -> np.ndarray:
    out, rows = np.full(len(x), start), np.arange(len(x))
    for *levels, values in trees:
        node = np.zeros(len(x), np.int64)
        for splits in levels:
            which, goes = (np.array(c) for c in zip(*splits))
            node = 2 * node + (x[rows, which[node]] > goes[node])
        out += np.array(values)[node]
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points through which the rising calibration runs."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][2] == blocks[-1][2]):
            value, n, top = blocks.pop()
            before = blocks[-1]
            blocks[-1] = [(before[0] * before[1] + value * n) / (before[1] + n), before[1] + n, top]
    ends = np.array([b[2] for b in blocks])
    starts = np.append(score.min(), ends[:-1])
    level = np.array([b[0] for b in blocks])
    # A block's value holds at its middle; between middles the line is straight.
    return (starts + ends) / 2, level


class ToxicityModel:
    """Learned from ``labels.toxic``; a class that the labels lack makes the score constant."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        labelled = land(sample(docs, labels, "toxic"))
        # Trees learn from rows that their lexicon has not seen, or they would trust its accidents:
        # each half is measured with the other half's lexicon.  Scoring has that of all rows.
        half = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
        halves = [labelled.filter(half), labelled.filter(~half)]
        seen = [featured(mine, features(learned_lexicon(other))) for mine, other in (halves, halves[::-1])]
        x, y = (np.concatenate(parts) for parts in zip(*(s for s in seen if len(s[1])))) if any(len(s[1]) for s in seen) else seen[0]
        self.lexicon = learned_lexicon(labelled)
        self.constant = 0.0 if not len(y) else float(y.mean())
        self.trees = None
        if 0 < self.constant < 1 and len(y) >= 10:
            apart = np.arange(len(y)) % 4 == 0
            apart = np.random.default_rng(3).permutation(apart)
            if 0 < y[~apart].mean() < 1 and 0 < y[apart].mean() < 1:
                self.start, self.trees = fit_trees(x[~apart], y[~apart])
                self.at, self.level = isotonic(margins(x[apart], self.start, self.trees), y[apart])

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        constant, trees = self.constant, self.trees
        if trees is None:
            return lambda x: np.full(len(x), constant)
        start, at, level = self.start, self.at, self.level
        return lambda x: np.clip(np.interp(margins(x, start, trees), at, level), 0.0, 1.0)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts are scored as empty ones; repeated rows get equal scores; without
    usable labels the score is the share of toxic ones, 0 if there are none.  Columns but
    ``doc_id`` and ``text`` are not read.
    """
    model = ToxicityModel(docs, labels)
    return scored(docs, features(model.lexicon), model.scorer(), CUT)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted toxic, columns and texts as they are.

    Null and empty texts are judged as empty ones, equal texts alike, repeated rows stay or go
    together; an empty table, and labels that cannot be learned from, leave ``docs`` as it is
    (unless nearly all labels say toxic: then the constant score decides).
    """
    model = ToxicityModel(docs, labels)
    measure, score = features(model.lexicon), model.scorer()
    place = docs.columns.index("text")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([measure(t.as_py() or "") for t in batch.column(place)], dtype=np.float64)
                yield batch.filter(pa.array(score(x) < CUT))

    return docs.mapInArrow(judged, docs.schema)
