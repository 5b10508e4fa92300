"""Quality by Bradley-Terry pairwise ranking (operator 5).

A document's strength is a sum over binned features.  Preference pairs set a document of
label 1 above one of label 0, and the weights minimise the logistic loss on differences
of features.  The strength at the quantile that parts the labels is where a document
begins to be accepted.

Every labelled row takes part.  The bins' edges and the cut are quantiles that Spark takes over all
rows; the weights are fitted in parts of some ``PART_ROWS`` rows, which all start a round from the
average of the last one's.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclumen.llm.common import land
from doclumen.llm.labelled import known_labels, labelled_texts, scored

BINS = 12
#: Rounds of averaging, and steps of each part in a round; the pairs of a round hold every row of a part.
ROUNDS, STEPS, PAIRS_A_STEP, RATE, DECAY = 4, 200, 2048, 0.05, 1e-4
PART_ROWS = 20_000
#: Accuracy of the quantiles (one over the error as a share of the rows).
EDGE_ACCURACY, CUT_ACCURACY = 10_000, 1_000_000
#: Scores from here on are predicted as good.
CUT = 0.3


def features(text: str) -> list[float]:
    """Shape of a whole text; the same text in another order of lines has much the same features."""
    raw = text.encode("utf-8", "replace")
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(len(raw), 1)
    words = raw.split()
    n = max(len(words), 1)
    counts = Counter(words)
    most = max(counts.values(), default=0)
    same_next = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    capitals, small = byte[65:91].sum(), byte[97:123].sum()
    high = byte[128:].sum()
    return [
        float(np.log1p(len(words))), size / n, len(counts) / n, most / n, same_next / n, pairs / max(n - 1, 1),
        capitals / max(capitals + small, 1), byte[48:58].sum() / size, byte[33] / size, byte[63] / size,
        (byte[35] + byte[36] + byte[37] + byte[38] + byte[42]) / size, byte[124] / size, (byte[60] + byte[62]) / size,
        byte[44] / n, byte[46] / n, (byte[58:60].sum() + byte[40] + byte[41]) / size, (byte[47] + byte[92] + byte[95] + byte[64]) / size,
        high / size, len(set(lines)) / max(len(lines), 1), len(lines) / n, size / max(len(lines), 1),
        len(zlib.compress(raw, 1)) / size, max(map(len, words), default=0) / 10.0,
        sum(v for v in counts.values() if v == 1) / n,
    ]


def one_hot(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Column numbers of each feature's bin, one row for each document."""
    width = max(len(e) for e in edges) + 1
    return np.stack([np.searchsorted(e, c, side="left") + k * width for k, (e, c) in enumerate(zip(edges, x.T))], axis=1)


def fit_pairs(place: np.ndarray, y: np.ndarray, start: np.ndarray, seed: int = 5) -> np.ndarray:
    """Weights from preference pairs by steps of Adam on the logistic loss; rows take turns, so that none is left out."""
    rng = np.random.default_rng(seed)
    pairs, width = PAIRS_A_STEP, len(start)
    steps = max(STEPS, -(-len(y) // pairs))

    def turns(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([rng.permutation(rows) for _ in range(-(-steps * pairs // len(rows)))])

    good, bad = turns(np.flatnonzero(y == 1)), turns(np.flatnonzero(y == 0))
    w, m, v = start.copy(), np.zeros(width), np.zeros(width)
    for step in range(1, steps + 1):
        here = slice((step - 1) * pairs, step * pairs)
        a, b = place[good[here]], place[bad[here]]
        miss = 1 / (1 + np.exp(w[a].sum(1) - w[b].sum(1)))
        pull = np.repeat(miss, a.shape[1])
        g = (np.bincount(b.reshape(-1), pull, width) - np.bincount(a.reshape(-1), pull, width)) / pairs + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array([features(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), rows, batch.column(2).cast(pa.int32())], names=["_of", "x", "label"])


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.array(column.to_pylist()).reshape(n, -1)


class QualityModel:
    """Learned from ``labels.quality``; a class that the labels lack makes the score constant."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        texts = labelled_texts(docs, known_labels(labels, "quality"))
        rows = land(texts.select("_of", "text", "label").mapInArrow(_measured, "_of long, x array<double>, label int"))
        n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        self.constant = 1.0 if not n else good / n
        self.weights = None
        if 0 < self.constant < 1:
            self.edges = self._edges(rows)
            edges = self.edges
            self.width = (max(len(e) for e in edges) + 1) * len(edges)

            def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        place = one_hot(_matrix(batch.column(1), batch.num_rows), edges).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0), pa.array(place.tolist(), pa.list_(pa.int32())), batch.column(2)], names=["_of", "place", "label"]
                        )

            part = F.pmod(F.xxhash64("_of"), F.lit(-(-n // PART_ROWS))).alias("part")
            placed = land(rows.mapInArrow(binned, "_of long, place array<int>, label int").select("*", part))
            self.weights = np.zeros(self.width)
            for round_ in range(ROUNDS):
                self.weights = self._round(placed, self.weights, round_)
            self.cut = self._quantile(placed, n - good, n)

    @staticmethod
    def _edges(rows: DataFrame) -> list[np.ndarray]:
        """Edges of each feature's bins: its quantiles over all rows and over those of label 0."""
        share = np.linspace(0, 1, BINS + 1)[1:-1].tolist()
        k = len(features(""))
        x = [F.col("x")[i] for i in range(k)]
        found = rows.agg(
            *(F.percentile_approx(c, share, EDGE_ACCURACY).alias(f"all_{i}") for i, c in enumerate(x)),
            *(F.percentile_approx(F.when(F.col("label") == 0, c), share, EDGE_ACCURACY).alias(f"bad_{i}") for i, c in enumerate(x)),
        ).first()
        return [np.unique([*found[f"all_{i}"], *found[f"bad_{i}"]]) for i in range(k)]

    @staticmethod
    def _round(placed: DataFrame, start: np.ndarray, seed: int) -> np.ndarray:
        """The average of the weights that each part comes to, by its rows."""

        def fit(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("_of").to_numpy())
            y = table.column("label").to_numpy()[order]
            if not 0 < y.sum() < len(y):
                return pa.table({"n": pa.array([], pa.int64()), "w": pa.array([], pa.list_(pa.float64()))})
            w = fit_pairs(_matrix(table.column("place"), len(y))[order], y, start, seed)
            return pa.table({"n": pa.array([len(y)], pa.int64()), "w": pa.array([w.tolist()], pa.list_(pa.float64()))})

        parts = placed.groupBy("part").applyInArrow(fit, "n long, w array<double>")
        terms = parts.select("n", F.posexplode("w").alias("i", "v")).groupBy("i").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v"))
        averaged = start.copy()
        for row in terms.collect():  # one for each bin
            averaged[row["i"]] = round(row["v"], 9)  # sums come in any order
        return averaged

    def _quantile(self, placed: DataFrame, bad: int, n: int) -> float:
        """Where the share of label 0 parts the strengths: between the two neighbours of that rank."""
        weights = self.weights

        def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(weights[_matrix(batch.column(0), batch.num_rows)].sum(1))], names=["s"])

        ranks = [(bad - 0.5) / n, (min(bad, n - 1) + 0.5) / n]
        low, high = placed.select("place").mapInArrow(strengths, "s double").agg(F.percentile_approx("s", ranks, CUT_ACCURACY)).first()[0]
        return (low + high) / 2

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        constant = self.constant
        if self.weights is None:
            return lambda x: np.full(len(x), constant)
        weights, edges, cut = self.weights, self.edges, self.cut
        offset = np.log(CUT / (1 - CUT))
        return lambda x: 1 / (1 + np.exp(-np.clip(weights[one_hot(x, edges)].sum(1) - cut + offset, -500, 500)))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts are scored as empty ones; repeated rows get equal scores; without
    usable labels the score is the share of good ones, 1 if there are none.  Columns but
    ``doc_id`` and ``text`` are not read.
    """
    model = QualityModel(docs, labels)
    return scored(docs, features, model.scorer(), CUT)
