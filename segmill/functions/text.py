"""Scalar text functions as column expressions; all of them stay inside generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from segmill.session import BLANK

# The seven kinds of control token, tried in this order.
TOKEN_KINDS = (
    r"\{\{[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2})?\}\}",  # raw bytes
    r"%[0-9]+\$[-+ #0]*[0-9]*(?:\.[0-9]+)?[diouxXeEfgGcspn%]",  # positional printf
    r"%[-+ #0]*[0-9*]*(?:\.[0-9*]+)?[diouxXeEfgGcspn%]",  # printf
    r"\{/?[A-Za-z_][^{}\n]{0,80}\}",  # named braces
    r"\{[0-9]+\}",  # numbered braces
    r"\[[^\[\]\n]{0,80}\]",  # brackets
    r"\\[nNtr\\]",  # escapes
)
TOKEN = "|".join(f"(?:{kind})" for kind in TOKEN_KINDS)
KANA = "[\\u3040-\\u30ff]"
ZERO_WIDTH = "[\\u200b\\u200c\\u200d\\ufeff]"
#: Line separators of Unicode text; CR LF is one.
LINE_BREAK = "\\r\\n|[\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\u0085\\u2028\\u2029]"
#: Pairs whose counts must agree (fixed values).
PUNCTUATION = (("“", "”"), ("「", "」"), ("『", "』"), ("（", "）"), ("(", ")"))


def tokens(text: Column) -> Column:
    """Control tokens of a text from left to right, repeats kept; NULL has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def without_tokens(text: Column) -> Column:
    return F.regexp_replace(text, TOKEN, "")


def _count(items: Column, item: Column) -> Column:
    return F.size(F.filter(items, lambda x: x == item))


def multiset_minus(left: Column, right: Column) -> Column:
    """Members of ``left`` beyond their number in ``right``, in order of first occurrence, with repeats."""
    surplus = F.transform(F.array_distinct(left), lambda x: F.array_repeat(x, F.greatest(F.lit(0), _count(left, x) - _count(right, x))))
    return F.flatten(surplus)


def reordered(left: Column, right: Column) -> Column:
    """The same tokens in another order."""
    return (F.array_sort(left) == F.array_sort(right)) & (left != right)


def tokens_agree(source: Column, target: Column, allow_added: bool = False, allow_reordered: bool = False) -> Column:
    """Whether the target keeps the source's control tokens; missing ones are never allowed."""
    s, t = tokens(source), tokens(target)
    agree = F.size(multiset_minus(s, t)) == 0
    if not allow_added:
        agree &= F.size(multiset_minus(t, s)) == 0
    if not allow_reordered:
        agree &= ~reordered(s, t)
    return agree


def stripped(text: Column) -> Column:
    """The text without outer Unicode white space."""
    return F.btrim(text, F.lit(BLANK))


def is_blank(text: Column) -> Column:
    return F.coalesce(stripped(text), F.lit("")) == ""


def truthy(*texts: Column) -> Column:
    """The first text that is neither NULL nor empty, else the empty text."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts), F.lit(""))


def kana_in(bare: Column) -> Column:
    """Different kana of a text (given without its tokens), sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(KANA), F.lit(0))))


def zero_width_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(ZERO_WIDTH), F.lit(0))))


def shown_length(bare: Column) -> Column:
    """Code points of a text (given without its tokens) but for carriage returns and line feeds."""
    return F.length(F.translate(bare, "\r\n", ""))


def line_count(text: Column) -> Column:
    """Number of lines; a break at the end opens no further one, and no text is one line."""
    parts = F.split(text, LINE_BREAK, -1)
    closed = F.element_at(parts, -1) == ""
    return F.when(text == "", F.lit(1)).otherwise(F.size(parts) - F.when(closed, F.lit(1)).otherwise(F.lit(0)))


def occurrences(text: Column, piece: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))


def unbalanced_pairs(bare: Column) -> Column:
    """Punctuation pairs whose opening and closing marks differ in number, in a text given without its tokens."""
    return F.array_compact(F.array(*(F.when(occurrences(bare, a) != occurrences(bare, b), F.lit(a + b)) for a, b in PUNCTUATION)))


def has_unescaped_quote(text: Column) -> Column:
    """A double quote that an even number of backslashes precedes."""
    return text.rlike(r'(?<!\\)(?:\\\\)*"')


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
