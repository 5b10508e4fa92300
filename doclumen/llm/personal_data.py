"""Finding personal data by boosted trees over proposed spans (operator 12).

Four strict rules give the base spans, which always stay.  Generators with far wider
patterns propose further spans, overlapping ones too: addresses spelled out or beyond
ASCII, numbers without a plus sign or with other separators, windows of runs of digits
that the strict rules take as one number and drop.  Boosted trees judge each proposal by its
format and its surroundings; an isotonic step turns their margins into probabilities,
and proposals that are likely enough are added, the likeliest of overlapping ones.

No table marks personal data, so the trees learn from the rules: proposals that are base spans,
and the same spans rewritten in place in forms that the rules do not know, are
examples; proposals away from all base spans, and dates, versions, prices and the like
put in their place, are counterexamples.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from itertools import batched
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclumen.llm.common import land
from doclumen.llm.toxicity import fit_trees, isotonic, margins

KINDS = ("email", "ip", "card", "phone")
#: Most distinct texts and most proposals that the trees are fitted on; the first in the order of a hash.
SAMPLE_TEXTS = 20_000
SAMPLE_PROPOSALS = 40_000
#: Calibrated probability from which a proposal is added.
PRECISION = 0.95
#: Code points around a span that its features see.
AROUND = 40
#: Proposals of a text that are judged together.
TOGETHER = 4096

# -- the base rules; possessive, so that no run of characters is read twice --

_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _is_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def base_spans(text: str) -> list[Span]:
    """The strict rules' spans, by start and kind."""
    out, end = [], 0
    if "@" in text:
        for m in _HOST.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                out.append(Span(0, start, end))
    for m in _IP.finditer(text):
        if all(map(_is_byte, m[0].split("."))):
            out.append(Span(1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(Span(2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(Span(3, *m.span()))
    return sorted(out, key=lambda s: (s.start, s.kind, s.end))


# -- generators: wide patterns, anchored and bounded so that long runs cost their length --

_SIGN_AT = re.compile(r"@|\bat\b", re.I)
_WIDE_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}")
_SPELLED_EMAIL = re.compile(
    r"(?<![\w.%+-])[\w.%+-]{1,64}(?: {0,2}[\[({<] ?(?:at|@) ?[\])}>] {0,2}| at | {1,2}@ {0,2}|@ {1,2})[\w-]{1,63}"
    r"(?:(?: {0,2}[\[({<] ?(?:dot|\.) ?[\])}>] {0,2}| dot |\.)[\w-]{1,63}){1,6}",
    re.I,
)
_WIDE_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?: ?[\[({] ?(?:\.|dot) ?[\])}] ?| \. ?|\.)[0-9]{1,3}){3}(?!\.?\w)")
_IP_6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]{6,39}(?![\w:]))(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}")
_DIGIT_GROUPS = re.compile(r"(?<!\w)[0-9]{3,19}(?:[ .\-/_  ‐-―]{1,2}[0-9]{3,19})*+(?!\w)")
_GROUP = re.compile(r"[0-9]+")
_WIDE_PHONE = re.compile(r"(?<![\w+])(?:\+|00 ?)?\(?[0-9]{1,5}\)?(?:(?:[ ./-]{1,2}\(?|(?<=\))\(?)[0-9]{2,8}\)?){1,6}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")
_IP_6_HINT = re.compile(r"[0-9A-Fa-f]:|::")

FORMS = ("wide", "spelled", "other", "window")


class Proposal(NamedTuple):
    kind: int
    start: int
    end: int
    form: int


def proposals(text: str) -> Iterator[Proposal]:
    """Spans that may be personal data, in no way free of overlaps, one after the other."""
    if _SIGN_AT.search(text):
        if "@" in text:
            for m in _WIDE_EMAIL.finditer(text):
                yield Proposal(0, *m.span(), 0)
        for m in _SPELLED_EMAIL.finditer(text):
            yield Proposal(0, *m.span(), 1)
    if _DIGIT.search(text):
        for m in _WIDE_IP.finditer(text):
            yield Proposal(1, *m.span(), 0)
        for m in _DIGIT_GROUPS.finditer(text):
            yield from _windows(text, *m.span())
        for m in _WIDE_PHONE.finditer(text):
            if 7 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield Proposal(3, *m.span(), 0)
    if _IP_6_HINT.search(text):
        for m in _IP_6.finditer(text):
            yield Proposal(1, *m.span(), 2)


def _windows(text: str, start: int, end: int) -> Iterator[Proposal]:
    """Neighbouring groups of digits that together are as long as a card's number."""
    open_: list[list[int]] = []
    for m in _GROUP.finditer(text, start, end):
        length = m.end() - m.start()
        open_ = [[s, n + length] for s, n in open_ if n + length <= 19] + [[m.start(), length]]
        for s, n in open_:
            if n >= 12:
                yield Proposal(2, s, m.end(), 3)


# -- features --

#: Words that tell what follows, by kind, in the four languages of the tables.
CUES = (
    "mail email e-mail courriel correo contact kontakt contacto write schreiben".split(),
    "ip server host address adresse dirección serveur servidor login node".split(),
    "card visa mastercard amex karte kreditkarte carte tarjeta credit payment konto".split(),
    "phone tel telephone telefon téléphone teléfono mobile mobil fax call whatsapp sms".split(),
)
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def _side(c: str) -> int:
    """What stands beside a span: nothing, white space, a letter, a digit, a sign."""
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, p: Proposal) -> list[float]:
    """Format and context of a proposal."""
    s = text[p.start : p.end]
    before, after = text[max(0, p.start - AROUND) : p.start], text[p.end : p.end + AROUND]
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    digits = _NOT_DIGIT.sub("", s)
    signs = re.findall(r"[^\w]|_", s)
    letters = sum(c.isalpha() for c in s)
    labels = re.split(r"(?i)\W+(?:dot\W+)?", re.split(r"(?i)@|\W+at\W+", s)[-1].strip(" []{}()<>")) if p.kind == 0 else [""]
    parts = [g for g in re.findall(r"[0-9]+", s)]
    words = [w.lower() for w in _WORD.findall(before)][-5:]
    return [
        *(float(p.form == f) for f in range(len(FORMS))),
        float(len(s)), float(len(digits)), float(letters), float(len(groups)), float(min(groups)), float(max(groups)), float(groups[-1]),
        float(len(signs)), float(len(set(signs))), float(len(set(digits))), float(bool(digits) and luhn(digits)),
        float(max((int(x[:6]) for x in parts), default=0)), float(s[0] == "+"), float(s.startswith("00")), float("(" in s), float(digits[:1] or -1),
        float(len(labels)), float(len(labels[-1])), float(labels[-1].isalpha()), float("@" in s), float(bool(re.search(r"[\[({<]", s))), float("::" in s),
        float(_side(before[-1:])), float(_side(after[:1])), float(sum(c.isdigit() for c in before)), float(sum(c.isdigit() for c in after)),
        float(before.rstrip()[-1:] in (":", "=", "#")), float(sum(w in CUES[p.kind] for w in words)), float(after[:2].lstrip()[:1] in ("%", "€", "$", "£")),
    ]


# -- examples --


def rewritten(kind: int, s: str, pick: int) -> str:
    """A base span in a form that the rules do not know."""
    if kind == 0:
        local, _, host = s.partition("@")
        if pick & 1024:  # not all addresses have digits
            local, host = re.sub("[0-9]", "", local).strip(".") or local, re.sub("[0-9]", "", host)
        return (f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local} at {host.replace('.', ' dot ')}", f"{local}(at){host}", f"é{local}é@{host}", f"{local} @ {host}")[pick % 5]
    if kind == 1:
        return (s.replace(".", "[.]"), s.replace(".", " . "), "2001:db8::" + s.replace(".", ":"), "fe80:" + ":".join(f"{int(p[:4]):x}" for p in s.split(".")) + ":0:a1:1")[pick % 4]
    digits = _NOT_DIGIT.sub("", s)
    if kind == 2:
        mark = (" ", ".", "–", "  ", "/")[pick % 5]
        return mark.join(digits[i : i + 4] for i in range(0, len(digits) - len(digits) % 4 - 4, 4)) + mark + digits[len(digits) - len(digits) % 4 - 4 :]
    rest = s[1:].lstrip("0123456789").strip()
    return (f"00 {s[1:]}", rest if len(_NOT_DIGIT.sub("", rest)) >= 7 else f"00{s[1:]}", f"({digits[:3]}) {digits[3:6]}-{digits[6:10]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}", f"+{digits[:2]}/{digits[2:5]}/{digits[5:]}")[pick % 5]


def decoy(pick: int) -> str:
    """What looks like such data and is none."""
    a, b, c, d = (pick >> k & 0xFF for k in (0, 8, 16, 24))
    year, month, day = 1900 + a % 140, 1 + b % 12, 1 + c % 28
    return (
        f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{day}/{month}/{year} {a % 24:02}:{b % 60:02}", f"{a % 24:02}:{b % 60:02}:{c % 60:02}", f"{year}-{year + 1 + b % 9}",
        f"{a}.{b}.{c}.{300 + d}", f"v{a % 9}.{b % 20}.{c % 30}", f"{a}.{b:02}{c:02} {d}", f"${a},{b:03}.{c % 100:02}", f"978-{a % 10}-{1000 + b}-{1000 + 4 * c}-{d % 10}",
        f"{a} {b} {c} {d}", f"{100 + a}/{100 + b}/{100 + c}", f"look at it.then we {a} go", f"met at noon. {a}", f"at {a}.{b}", f"{1000 + a} {1000 + b} {1000 + c}", f"{a}:{b}",
    )[d % 17]


def _at_fault(digits: str) -> str:
    """The digits with the last one changed, so that their check digit is wrong."""
    return digits[:-1] + str((int(digits[-1]) + 3) % 10)


def examples(text: str) -> Iterator[tuple[int, int, list[float]]]:
    """``kind, label, features`` for the proposals of a text and of its rewritten spans."""
    base = base_spans(text)
    strict = set(base)
    for p in proposals(text):
        if Span(*p[:3]) in strict:
            yield p.kind, 1, features(text, p)
        elif not any(p.start < b.end and b.start < p.end for b in base) and not base_spans(text[p.start : p.end]):
            yield p.kind, 0, features(text, p)  # what the rules would take, stood it alone, counts for neither
    for span in base:
        s = text[span.start : span.end]
        pick = int.from_bytes(hashlib.blake2b(s.encode(), digest_size=4).digest(), "little")
        before, after = text[max(0, span.start - AROUND) : span.start], text[span.end : span.end + AROUND]
        there = len(before)
        # A number beside the span, which the rules would take as part of it.
        crowded = f"{s} {_at_fault('4' + s[-1] * 15)}" if span.kind in (2, 3) else ""
        variants = [(other := rewritten(span.kind, s, pick), len(other)), (crowded, len(s))]
        variants += [(decoy(pick), 0), (decoy(pick * 2654435761 & 0xFFFFFFFF), 0), (_at_fault(s) if span.kind == 2 else "", 0)]
        for other, size in variants:
            changed = before + other + after
            for p in proposals(changed) if other else ():
                if size and p.kind == span.kind and (p.start, p.end) == (there, there + size):
                    yield p.kind, 1, features(changed, p)
                elif not size and p.start < there + len(other) and there < p.end:
                    yield p.kind, 0, features(changed, p)


# -- model --


class SpanModel:
    """Trees and a calibration for each kind that has examples and counterexamples."""

    def __init__(self, kinds: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.parts: dict[int, tuple] = {}
        for kind in range(len(KINDS)):
            mine = kinds == kind
            y, rows = labels[mine], x[mine] if len(x) else x
            apart = np.random.default_rng(5).permutation(np.arange(len(y)) % 4 == 0)
            if len(y) >= 20 and 0 < y[apart].mean() < 1 and 0 < y[~apart].mean() < 1:
                start, trees = fit_trees(rows[~apart], y[~apart])
                at, level = isotonic(margins(rows[apart], start, trees), y[apart])
                self.parts[kind] = (start, trees, at, level)

    def probabilities(self, found: Sequence[Proposal], x: np.ndarray) -> np.ndarray:
        """0 for kinds without a model: they keep their base spans only."""
        out, kinds = np.zeros(len(found)), np.array([p.kind for p in found], dtype=np.int64)
        for kind, (start, trees, at, level) in self.parts.items():
            mine = kinds == kind
            if mine.any():
                out[mine] = np.interp(margins(x[mine], start, trees), at, level)
        return out


def fitted(docs: DataFrame) -> SpanModel:
    """A model from at most ``SAMPLE_TEXTS`` distinct texts and ``SAMPLE_PROPOSALS`` proposals of them."""
    hashed = docs.filter(F.length("text") > 0).select(F.xxhash64("text").alias("h"), "text").filter(F.col("text").rlike("[0-9@]"))
    last = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_TEXTS).agg(F.max("h")).first()[0]
    if last is None:
        return SpanModel(np.empty(0), np.empty(0), np.empty((0, 0)))
    texts = hashed.filter(F.col("h") <= last).dropDuplicates(["h"]).select("text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                for rows in batched(examples(text.as_py()), TOGETHER):
                    types = (pa.int32(), pa.int32(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["kind", "label", "x"])

    seen = land(texts.mapInArrow(measured, "kind int, label int, x array<double>"))
    found = seen.orderBy(F.xxhash64("kind", "label", "x"), "kind", "label", "x").limit(SAMPLE_PROPOSALS).toPandas()
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(len(found), -1)
    return SpanModel(found["kind"].to_numpy(), found["label"].to_numpy(np.int64), x)


def added_spans(text: str, base: list[Span], model: SpanModel) -> list[tuple[Span, float]]:
    """Proposals apart from all base spans that are likely enough, the likeliest of overlapping ones."""
    if not model.parts:
        return []
    starts = [b.start for b in base]
    reach = np.maximum.accumulate([b.end for b in base]) if base else np.empty(0)

    def apart(p: Proposal) -> bool:
        at = int(np.searchsorted(starts, p.end))  # base spans that start before the proposal ends
        return at == 0 or reach[at - 1] <= p.start

    likely: list[tuple[float, int, int, int]] = []
    for found in batched((p for p in proposals(text) if p.kind in model.parts and apart(p)), TOGETHER):
        p = model.probabilities(found, np.array([features(text, f) for f in found]))
        likely += [(-prob, f.start, f.kind, f.end) for f, prob in zip(found, p.tolist()) if prob >= PRECISION]
    taken: list[tuple[int, int]] = []
    out = []
    for prob, start, kind, end in sorted(likely):
        at = bisect_left(taken, (start, end))
        if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
            continue
        taken.insert(at, (start, end))
        out.append((Span(kind, start, end), -prob))
    return out


def _named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.start, s.kind, s.end)))


def _scanned(model: SpanModel) -> Callable[[str], tuple[list[Span], list[tuple[Span, float]]]]:
    def scan(text: str) -> tuple[list[Span], list[tuple[Span, float]]]:
        base = base_spans(text)
        return base, added_spans(text, base, model)

    return scan


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base spans, ``base_sha256`` and all ``spans``, for every row of ``docs``.

    Spans are ``kind:start:end`` in code points, by start and kind, and never overlap a
    base span if added.  A null text is empty and has none; repeated rows get equal
    results; a table without base spans to learn from has base spans only, that is none; an
    empty table gives an empty result.  Columns but ``doc_id`` and ``text`` are not read.
    """
    scan = _scanned(fitted(docs))
    counts = [f"n_{k}" for k in KINDS]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, added = scan(text.as_py() or "")
                named = _named(base)
                number = [sum(s.kind == k for s in base) for k in range(len(KINDS))]
                rows.append((*number, hashlib.sha256(named.encode()).hexdigest(), _named([*base, *(s for s, _ in added)]) if added else named))
            columns = zip(*rows) if rows else [()] * 6
            types = (*[pa.int64()] * 4, pa.string(), pa.string())
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *counts, "base_sha256", "spans"])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judged, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, columns and rows as they are.

    Overlapping base spans are replaced together, by the kind of the first.  A null text
    stays null; columns but ``text`` keep their values.
    """
    scan = _scanned(fitted(docs))
    place = docs.columns.index("text")

    def replaced(text: str) -> str:
        base, added = scan(text)
        out, end = [], 0
        for s in sorted([*base, *(a for a, _ in added)], key=lambda s: (s.start, s.kind, s.end)):
            if s.start >= end:
                out += [text[end : s.start], f"[{KINDS[s.kind].upper()}]"]
            end = max(end, s.end)
        return "".join([*out, text[end:]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t.as_py() is None else replaced(t.as_py()) for t in batch.column(place)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(each, docs.schema)
