"""Regex matches of a text as an array of rows: line number, groups and tail.

A text is searched once per pattern.  The search writes a mark in front of every
match and behind it, and where the characters that follow a match are needed, a
capturing look-ahead copies them in as well.  Everything else is read off the
marked text with plain string functions, so the cost stays linear in the text
however many matches it holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode noncharacters, which no text should contain; in a text that holds one, three
# spare ones that it does not hold stand in for them until its rows are found.
_START, _END, _TAIL_END = (chr(c) for c in range(0xFDD0, 0xFDD3))
_MARKS = _START + _END + _TAIL_END
_SPARE = ["".join(map(chr, range(c, c + 3))) for c in range(0xFDD3, 0xFDEE, 3)]

# What Java's classes lack of Python's white space.
_SPACE = r"[\s\x1c-\x1f]"


def with_spaces(regex: str) -> str:
    """A pattern whose ``\\s``, outside brackets only, takes all that Python counts as white space."""
    return regex.replace(r"\s", _SPACE)


def pattern(text: str, flags: str = "") -> str:
    """Java form of a pattern: Unicode classes, only newline ends a line."""
    return f"(?Ud{flags}){with_spaces(text)}"


def pattern_for(text: Column, regex: str | Column, flags: str = "") -> Column:
    """The pattern to search ``text`` with.

    On ASCII text the Unicode classes find the same and take several times as long,
    so they are used only where there is something else in it.
    """
    regex = F.lit(with_spaces(regex)) if isinstance(regex, str) else regex
    is_ascii = F.octet_length(text) == F.length(text)
    mode = F.when(is_ascii, F.lit(f"(?d{flags})")).otherwise(F.lit(f"(?Ud{flags})"))
    return F.concat(mode, regex)


def extract_all(text: Column, regex: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, pattern_for(text, regex), F.lit(group))


def has_match(text: Column, regex: str | Column) -> Column:
    return F.regexp_like(text, pattern_for(text, regex))


def _holds_marks(text: Column) -> Column:
    found = F.lit(False)
    for mark in _MARKS:
        found = found | F.contains(text, F.lit(mark))
    return found


def _spare_marks(text: Column) -> Column:
    """Spare marks that ``text`` does not hold."""
    absent = [F.when(~F.regexp_like(text, F.lit(f"[{marks}]")), F.lit(marks)) for marks in _SPARE]
    return F.coalesce(*absent, F.lit(_SPARE[-1]))


def _translate(text: Column, old: Column, new: Column) -> Column:
    return F.call_function("translate", text, old, new)


def _start_lines(marked: Column) -> Column:
    """1-based line of every start mark."""

    def on_line(line: Column, index: Column) -> Column:
        marks = F.length(line) - F.length(F.replace(line, F.lit(_START), F.lit("")))
        return F.array_repeat(index + 1, marks)

    return F.flatten(F.transform(F.split(marked, "\n", -1), on_line))


def match_rows(
    text: Column,
    regex: str | Column,
    groups: int,
    tail: int = 0,
    flags: str = "",
) -> Column:
    """``array<struct<...>>``, one element per non-overlapping match.

    The element's fields are positional: ``"0"`` is the line, ``"1"`` to
    ``str(groups)`` the pattern's groups (all of them), and one more the
    following ``tail`` characters if asked for.
    """
    regex = F.lit(with_spaces(regex)) if isinstance(regex, str) else regex
    again = F.concat(F.lit(f"(?Ud{flags})"), regex)
    search = pattern_for(text, regex, flags)
    replacement = f"{_START}$0{_END}"
    if tail:
        search = F.concat(search, F.lit(f"(?=([\\s\\S]{{0,{tail}}}))"))
        replacement += f"${groups + 1}{_TAIL_END}"

    def row(m: Column) -> Column:
        match = F.substring_index(m["1"], _END, 1)
        fields = [m["0"].alias("0")]
        for g in range(1, groups + 1):
            fields.append(F.call_function("regexp_extract", match, again, F.lit(g)).alias(str(g)))
        if tail:
            behind = F.substring_index(F.substring_index(m["1"], _TAIL_END, 1), _END, -1)
            fields.append(behind.alias(str(groups + 1)))
        return F.struct(*fields)

    def rows(marked: Column) -> Column:
        in_place = F.regexp_replace(marked, f"{_END}[^{_TAIL_END}]*{_TAIL_END}", _END) if tail else marked
        pieces = F.split(marked, _START, -1)
        matches = F.arrays_zip(_start_lines(in_place), F.slice(pieces, F.lit(2), F.size(pieces)))
        return F.when(F.contains(marked, F.lit(_START)), F.transform(matches, row)).otherwise(none)

    names = [str(g) for g in range(1, groups + 1 + bool(tail))]
    fields = ["`0`:int"] + [f"`{name}`:string" for name in names]
    none = F.array().cast(f"array<struct<{','.join(fields)}>>")
    held, spare = _holds_marks(text), _spare_marks(text)
    clean = F.when(held, _translate(text, F.lit(_MARKS), spare)).otherwise(text)

    def restored(m: Column) -> Column:
        return F.struct(m["0"].alias("0"), *(_translate(m[n], spare, F.lit(_MARKS)).alias(n) for n in names))

    # The one-element arrays make the search run once for all its uses.
    marked = F.regexp_replace(clean, search, F.lit(replacement))
    found = F.get(F.transform(F.array(marked), rows), F.lit(0))
    return F.get(
        F.transform(F.array(found), lambda all_: F.when(held, F.transform(all_, restored)).otherwise(all_)),
        F.lit(0),
    )


def first_group(text: Column, regex: str, group: int = 1) -> Column:
    """Group of the first match, or NULL when there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern(regex), group), F.lit(""))


def strip_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{_SPACE}+|{_SPACE}+\\z", "")
