"""Best-fit packing of tokenised documents into sequences (operator 9).

Documents become token ids by a public tokenizer in Arrow passes.  Pieces of full length
are sequences by themselves.  The others are dealt evenly to groups, and each group is
packed on its own by bounded-space online best-fit: pieces come in an order without
meaning, the longest of the next ``AHEAD`` first, and whenever no open bin has room and
``OPEN_BINS`` are open, the fullest closes.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclumen.llm.common import land

SEQUENCE = 2048
END = b"\0\0\0\0"
#: Pieces of a group, pieces that are known ahead, and bins that are open at most.
GROUP_PIECES = 16_384
AHEAD = 1_024
OPEN_BINS = 256
#: Words whose ids a worker remembers at most.
REMEMBERED = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids of a stretch without ASCII white space, as little-endian 32-bit numbers.

    The tokenizer never joins what white space parts, so each stretch is encoded once and
    remembered.  It lowers case, and a full stop or comma after a letter is a token of
    its own, so such stretches are put together from simpler ones.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The vocabulary writes a byte as itself if that prints, else as the next of U+0100 on.
        prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = (b for b in range(256) if b not in prints)
        self.shown = {b: 256 + n for n, b in enumerate(others)}

    def __missing__(self, stretch: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        simple = b"<|" not in stretch  # else it may hold a special token
        last = stretch[-2:]
        if simple and len(stretch) > 1 and last[1:] in b".," and 97 <= (last[0] | 32) <= 122:
            found = self[stretch[:-1]] + self[last[1:]]
        elif simple and (lower := stretch.lower()) != stretch:
            found = self[lower]
        else:
            found = array("I", self._encoded(stretch.decode("utf-8", "replace"))).tobytes()
        self[stretch] = found
        return found

    def _encoded(self, stretch: str) -> list[int]:
        """A word of Latin letters needs no splitting and goes straight to the model."""
        if stretch.isalpha() and max(stretch) < "\u0250" and "\u0130" not in stretch and is_normalized("NFC", stretch):
            shown = stretch.lower().encode("utf-8").decode("latin-1").translate(self.shown)
            return [token.id for token in self.model.tokenize(shown)]
        return self.tokenizer.encode(stretch, add_special_tokens=False).ids

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) + END


def word_ids(path: str) -> WordIds:
    """One memory for each Python worker, kept with the library so that it outlives a task."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_word_ids_by_path", {})
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def tokenized(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: ``doc_id, piece, start, length, ids_crc32``, and ``ids``
    (little-endian 32-bit) if asked for.  Null texts count as empty: one piece, the end mark."""
    path = tokenizer or default_tokenizer()
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode.ids(text.as_py() or b"")
                for piece, at in enumerate(range(0, len(ids), 4 * SEQUENCE)):
                    part = ids[at : at + 4 * SEQUENCE]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["ids"].append(part if with_ids else None)
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
            types |= {"ids": pa.binary()} if with_ids else {}
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in types.items()], names=list(types))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, schema)


class BestFit:
    """Bounded-space online best-fit: open bins by free space, and a bit for each free space
    that some bin has.  A piece goes to the bin with the least room that holds it; if
    none does and all bins are open, the fullest is closed for a new one."""

    def __init__(self, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free, self.open, self.opened = 0, 0, 0

    def _take(self, room: int) -> int:
        found = self.bins[room].pop()
        if not self.bins[room]:
            self.free &= ~(1 << room)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of ``length``."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            found = self._take(room)
        else:
            if self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            found, room = self.opened, self.capacity
            self.opened += 1
        left = room - length
        if left:
            self.bins[left].append(found)
            self.free |= 1 << left
            self.open += 1
        return found, self.capacity - room


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    fit, group = BestFit(), TaskContext.get().partitionId()
    for batch in batches:
        lengths, found = batch["length"].to_numpy(), np.zeros((len(batch), 2), np.int64)
        for first in range(0, len(lengths), AHEAD):
            order = first + np.argsort(-lengths[first : first + AHEAD], kind="stable")
            found[order] = [fit.place(n) for n in lengths[order].tolist()]
        batch["sequence_id"] = (np.int64(group) << 32) + found[:, 0]
        batch["offset"] = found[:, 1]
        yield batch


def pack(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; extra columns stay.

    A sequence is filled without gaps.  An empty table gives an empty result, equal pieces
    and rows are placed one by one, pieces without an id like any others.  Give a landed table:
    it is read three times.
    """
    full = pieces.filter(F.col("length") >= SEQUENCE)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.filter(F.col("length") < SEQUENCE)
    groups = max(1, -(-rest.count() // GROUP_PIECES))
    dealt = rest.repartition(groups).sortWithinPartitions(F.xxhash64("doc_id", "start", "ids_crc32"), "doc_id", "start", "length")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema)
    return dealt.mapInPandas(_packed, schema).union(full)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack all of ``docs``; columns but ``doc_id`` and ``text`` are not read.

    A null or empty text is one piece, the end mark; repeated rows are packed each; an empty
    table gives an empty result.
    """
    return pack(land(tokenized(docs, tokenizer, with_ids), release=True))
