"""Pieces of DuckDB SQL shared by the query modules."""

from __future__ import annotations

from segmill.functions import text as T
from segmill.session import BLANK

TOKEN = T.TOKEN
STRIP = "'" + "".join(BLANK).replace("'", "''") + "'"
_BREAKS = "\\x0a\\x0b\\x0c\\x0d\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}"


def outside(encoding: str) -> str:
    """A character class of RE2 of all characters that an encoding can't hold, by ranges of the codec's own table."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    held = sorted(map(ord, every.encode(encoding, "ignore").decode(encoding)))
    begins = [c for before, c in zip([-2, *held], held, strict=False) if c != before + 1]
    ends = [c for c, after in zip(held, [*held[1:], -2], strict=True) if after != c + 1]
    return "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if a < b else f"\\x{{{a:x}}}" for a, b in zip(begins, ends, strict=True)) + "]"


def tokens(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{TOKEN}', 0)"


def bare(text: str) -> str:
    return f"regexp_replace({text}, '{TOKEN}', '', 'g')"


def strip(text: str) -> str:
    return f"trim({text}, {STRIP})"


def surplus(a: str, b: str) -> str:
    """Number of members of list ``a`` beyond their number in ``b``."""
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda x: greatest(0, len(list_filter({a}, lambda y: y = x)) - len(list_filter({b}, lambda y: y = x))))), 0)::BIGINT"


def reordered(a: str, b: str) -> str:
    return f"(list_sort({a}) = list_sort({b}) AND {a} <> {b})"


def lines(text: str) -> str:
    """Number of lines of a text, one for the empty text."""
    parts = f"len(regexp_split_to_array({text}, '\\r\\n|[{_BREAKS}]'))"
    closed = f"CASE WHEN regexp_matches({text}, '[{_BREAKS}]\\z') THEN 1 ELSE 0 END"
    return f"(CASE WHEN {text} = '' THEN 1 ELSE {parts} - {closed} END)"


def count(text: str, piece: str) -> str:
    return f"(length({text}) - length(replace({text}, '{piece}', '')))"


def agree(s: str, t: str) -> str:
    """Whether two texts have the same control tokens in the same order."""
    return f"({tokens(s)} = {tokens(t)})"
