"""Sentence boundaries by cascading segmentation rule tables, over several languages and scripts.

A document is cut into blocks first (fences hold nothing; headings and list items end with their line; a
blank line ends a block). Inside a block every possible position, after end marks and closers, is decided
by the first rule that matches: the language's table, then the table of its writing system. A rule is a
pair of regular expressions for the text before and after the position, with break or no break.

Quoted and bracketed spans are resolved before the rules run: in a shadow copy of the block, of the same
length, end marks inside a span are blanked, and the closer of a span that ends with one is replaced by a
letter for its kind, so that rules can tell speech inside a sentence from a sentence that is speech.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of closers of spans that end with an end mark (private use letters in the shadow).
QUOTE_LEADING, QUOTE_INTRODUCED, QUOTE_INSIDE, BRACKET_LEADING, BRACKET_INSIDE = "\ue010", "\ue011", "\ue012", "\ue013", "\ue014"
_BLANKED = "\ue000"
_CLOSED = QUOTE_LEADING + QUOTE_INTRODUCED + QUOTE_INSIDE + BRACKET_LEADING + BRACKET_INSIDE

_END = ".!?…。！？｡؟۔।॥‼⁇⁈⁉"
_PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "《": "》", "〈": "〉", "【": "】", "[": "]", "［": "］", "‘": "’", "〝": "〟"}
_BRACKETS = set("（([［【")
_CLOSERS = "”’»›」』）)】〉》]］〟"
_POSITION = regex.compile(rf"[{regex.escape(_END)}]+[ \u00a0\u202f]?[»›]|[{regex.escape(_END)}{_CLOSED}]+[{regex.escape(_CLOSERS)}]*")
_OPEN = regex.compile("[" + regex.escape("".join(_PAIRS) + "\"") + "]")


class Rule(NamedTuple):
    breaks: bool
    here: regex.Pattern


def _rules(*rows: tuple[bool, str, str]) -> tuple[Rule, ...]:
    """Rules of a break or none, what stands before a position, however long, and what after it."""
    return tuple(Rule(b, regex.compile(rf"(?<={before})(?:{after})")) for b, before, after in rows)


BREAK, NO_BREAK = True, False
_LOWER = r"\s+\p{Ll}"
_WORD = r"(?<![\p{L}\p{N}])"
_ASCII_WORD = r"(?<![A-Za-z0-9])"
_CLOSE = rf"[{regex.escape(_CLOSERS)}]*"

# Abbreviations that never end a sentence, that do so only before a number, that may end one.
_NEVER = {
    "en": "Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|vs|cf|e\\.g|i\\.e|approx|dept|al|Gen|Col|Capt|Lt|Sgt|Rev|Hon|esp|resp|viz|Mt|Ft|incl|ca",
    "de": "Dr|Prof|Hr|Fr|Fa|bzw|ca|inkl|exkl|evtl|ggf|vgl|sog|Abb|Nr|Bd|Kap|Str|St|Tel|Ing|Dipl|Mio|Mrd|zzgl|z\\.\\s?B|d\\.\\s?h|u\\.\\s?a|o\\.\\s?ä|i\\.\\s?d\\.\\s?R|z\\.\\s?T|v\\.\\s?a|u\\.\\s?U",
    "fr": "M|MM|Mme|Mlle|Dr|Pr|Me|cf|env|chap|p\\.\\s?ex|c\\.-à-d|vol|éd|av|apr|St|Ste",
    "es": "Sr|Sra|Srta|Sres|Dr|Dra|Prof|Ud|Uds|Lic|Ing|pág|págs|núm|aprox|p\\.\\s?ej|tel|Avda",
    "ru": "см|См|стр|рис|проф|Проф|д-р|гл|табл|напр|др|ул|им|тыс|млн|млрд|т\\.\\s?е|т\\.\\s?к|акад|доц|ср|Ср|п",
    "ar": "د|ص|أ|م|ج|هـ|ق",
    "hi": "डॉ|प्रो|श्री|श्रीमती|मि|से|मि\\.से|पं|कु",
    "ko": "",
    "ja": "",
    "zh": "",
}
_NUMBERED = "No|Nos|no|nos|n|nr|Nr|p|pp|S|s|fig|Fig|figs|sec|Sec|secs|ch|Ch|vol|Vol|ver|v|eq|Eq|Abb|Bd|Kap|стр|рис|гл|№|tab|Tab|pt|pág|núm|cap"
_MAY_END = "etc|a\\.\\s?m|p\\.\\s?m|usw|u\\.\\s?s\\.\\s?w|Co|Inc|Ltd|Corp|т\\.\\s?д|т\\.\\s?п|г|гг|sq|ff"
_GO_ON = (
    "and|or|but|nor|in|on|at|of|for|to|with|from|by|as|the|a|an|is|are|was|were|that|which|who|than|then|into|over|until|while|if|when|because|so|it|will|has|have|had|can|may|did|does|before|after|each|last|"
    "und|oder|aber|auf|für|mit|von|zu|zum|zur|ist|sind|war|im|am|die|der|das|den|dem|des|ein|eine|et|ou|mais|dans|sur|pour|avec|de|du|des|le|la|les|un|une|est|sont|y|o|pero|en|con|por|para|el|los|las|una|es|son|и|или|но|а|в|на|с|по|из|за|для|не|то|это|был|была|были"
)
_CONTINUES = rf"\s+(?:{_GO_ON})(?![\p{{L}}\p{{N}}])"
_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Tag|Mal|Jahrhundert|Kapitel|Stock|Platz|Mann|Klasse|Auflage|Band"

_LANGUAGE_WORDS = {
    "de": regex.compile(r"(?<!\p{L})(?:der|die|das|und|nicht|ist|im|wird|mit)(?!\p{L})"),
    "fr": regex.compile(r"(?<!\p{L})(?:le|la|les|est|une|dans|pour|du|et)(?!\p{L})"),
    "es": regex.compile(r"(?<!\p{L})(?:el|los|las|una|del|por|se|con|y)(?!\p{L})"),
    "en": regex.compile(r"(?<!\p{L})(?:the|and|of|to|is|in|it|for|that)(?!\p{L})"),
}


def _never(lang: str) -> str:
    """Abbreviations of a language; English ones hold in all, as its terms are mixed in everywhere."""
    return "|".join(filter(None, (_NEVER.get(lang), _NEVER["en"] if lang != "en" else None)))


#: Writing systems with case: positions need white space after them; a small letter speaks against a break
#: after an ellipsis or a closer, not after a plain end mark (names of programs begin small).


def cased(never: str) -> tuple[Rule, ...]:
    return _rules(
        (NO_BREAK, r".", r"\S"),
        (NO_BREAK, r".", r"\s*[,;:)\]»’”]"),
        (NO_BREAK, rf"{_WORD}(?:{_NUMBERED})\.", r"\s+[\p{N}#]"),
        (NO_BREAK, rf"{_WORD}т\.", r"\s+[едпк]\."),
        (NO_BREAK, rf"{_WORD}\p{{Ll}}\.", r"\s?\p{Ll}\.(?!\p{L})"),
        (NO_BREAK, rf"{_WORD}p\.", r"\s+e[xj]\."),
        (NO_BREAK, rf"{_WORD}(?:{_MAY_END})\.", _CONTINUES),
        (NO_BREAK, rf"{_WORD}(?:г|гг|т\.\s?д|т\.\s?п|Inc|Ltd|Co|Corp)\.", _LOWER),
        (BREAK, rf"{_WORD}(?:{_MAY_END})\.{_CLOSE}", r"\s"),
        (NO_BREAK, rf"{_WORD}(?:{never})\.", r"\s"),
        (NO_BREAK, rf"{_WORD}(?:\p{{Lu}}\.)*\p{{Lu}}\.", r"\s"),
        (NO_BREAK, rf"(?:\.\.+|…){_CLOSE}", _LOWER),
        (NO_BREAK, QUOTE_LEADING + _CLOSE, _LOWER),
        (NO_BREAK, rf"[{QUOTE_INSIDE}{BRACKET_INSIDE}{QUOTE_INTRODUCED}]{_CLOSE}", _CONTINUES),
        (NO_BREAK, BRACKET_INSIDE + _CLOSE, _LOWER),
        (NO_BREAK, BRACKET_INSIDE + _CLOSE, r"\s+[\p{N}]"),
        (NO_BREAK, rf"[!?]\s?[»”\"]{_CLOSE}", _LOWER),
        (BREAK, r".", r"\s"),
    )


#: Writing systems without case but with spaces.


def spaced(never: str) -> tuple[Rule, ...]:
    return _rules(
        (NO_BREAK, r".", r"\S"),
        (NO_BREAK, r".", r"\s*[,;:،؛)\]»”]"),
        (NO_BREAK, rf"{_WORD}(?:{_NUMBERED})\.", r"\s+[\p{N}#]"),
        (BREAK, rf"[{BRACKET_LEADING}{QUOTE_INTRODUCED}]{_CLOSE}", r"\s"),
        (NO_BREAK, rf"[{QUOTE_LEADING}{QUOTE_INSIDE}{BRACKET_INSIDE}]{_CLOSE}", r"\s"),
        (NO_BREAK, rf"{_WORD}(?:{never})\.", r"\s"),
        (NO_BREAK, rf"{_WORD}(?:\p{{Lu}}\.)*\p{{Lu}}\.", r"\s"),
        (NO_BREAK, rf"(?:\.\.+|…){_CLOSE}", r"\s+[\p{L}]"),
        (BREAK, r".", r"\s"),
    )


#: Writing systems without spaces.


def dense(never: str) -> tuple[Rule, ...]:
    return _rules(
        (NO_BREAK, r".", r"\s*[,;:，、；：)）\]」』”》〉】]"),
        (BREAK, rf"[{BRACKET_LEADING}{QUOTE_INTRODUCED}]{_CLOSE}", r""),
        (NO_BREAK, rf"[{_CLOSED}]{_CLOSE}", r""),
        (BREAK, rf"[。｡！？‼⁇⁈⁉][.!?…。！？]*{_CLOSE}", r""),
        (NO_BREAK, rf"(?:…|\.\.+){_CLOSE}", r""),
        (NO_BREAK, r".", r"\S"),
        (NO_BREAK, rf"{_ASCII_WORD}(?:{_NUMBERED})\.", r"\s+[\p{N}#]"),
        (NO_BREAK, rf"{_ASCII_WORD}(?:{never})\.", r"\s"),
        (NO_BREAK, rf"{_ASCII_WORD}(?:\p{{Lu}}\.)*\p{{Lu}}\.", r"\s"),
        (BREAK, r".", r"\s"),
    )


#: Own tables of languages, before those of the writing system.
OWN = {
    "de": _rules(
        (NO_BREAK, rf"{_WORD}[a-zäöü]\.", r"\s?\p{Lu}\.(?!\p{L})"),
        (NO_BREAK, r"(?<!\p{N})(?<!Nr\.\s)\p{N}{1,2}\.", rf"\s+(?:\p{{Ll}}|(?:{_MONTHS})(?!\p{{L}}))"),
    ),
    "fr": _rules((NO_BREAK, r"[!?]", r"[\s\u00a0\u202f][»›]")),
    "hi": _rules((NO_BREAK, rf"{_WORD}(?:मि\.से|मि|से|कि\.मी|कि|मी)\.", r"\s")),
}
_SYSTEM = {"ja": dense, "zh": dense, "ko": spaced, "ar": spaced, "hi": spaced, "th": spaced}
_SCRIPTS = (("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("ko", regex.compile(r"\p{Hangul}")), ("zh", regex.compile(r"\p{Han}")), ("ar", regex.compile(r"\p{Arabic}")), ("hi", regex.compile(r"\p{Devanagari}")), ("ru", regex.compile(r"\p{Cyrillic}")))


@functools.cache
def table_of(lang: str) -> tuple[Rule, ...]:
    return OWN.get(lang, ()) + _SYSTEM.get(lang, cased)(_never(lang))


def language(text: str, declared: str | None) -> str:
    """The declared language, else the one that its script or, in Latin script, its small words suggest."""
    if declared:
        return declared.lower()[:2]
    script = None if text.isascii() else next((lang for lang, pattern in _SCRIPTS if pattern.search(text)), None)
    if script:
        return script
    low = text.lower()
    return max(_LANGUAGE_WORDS, key=lambda lang: len(_LANGUAGE_WORDS[lang].findall(low)))


def shadow(block: str) -> str:
    """The block with spans resolved (see the module), of the same length."""
    out = list(block)
    stack: list[tuple[str, int]] = []  # the closer awaited, where it was opened
    spans: list[tuple[int, int]] = []
    closers = set(_PAIRS.values()) | {'"'}
    for i, c in enumerate(block):
        if stack and c == stack[-1][0] and not (c == "’" and block[i + 1 : i + 2].isalpha()):
            spans.append((stack.pop()[1], i))
        elif c == '"':
            if any(x == '"' for x, _ in stack):
                while stack[-1][0] != '"':
                    stack.pop()
                spans.append((stack.pop()[1], i))
            else:
                stack.append((c, i))
        elif c in _PAIRS and c != "‘":
            stack.append((_PAIRS[c], i))
        elif c in closers and any(x == c for x, _ in stack):
            while stack[-1][0] != c:
                stack.pop()
            spans.append((stack.pop()[1], i))
    for start, end in spans:
        inner = block[start + 1 : end].rstrip()
        ends = bool(inner) and (inner[-1] in _END or out[start + len(inner)] in _CLOSED)
        for k in range(start + 1, end):
            if out[k] in _END or out[k] in _CLOSED:
                out[k] = _BLANKED
        if ends:
            k = start  # behind the last visible character before the span
            while k and out[k - 1].isspace():
                k -= 1
            j = k
            while j and out[j - 1] in _CLOSERS:
                j -= 1
            leading = not k or j > 0 and (out[j - 1] in _END or out[j - 1] in _CLOSED)
            if block[start] in _BRACKETS:
                out[end] = BRACKET_LEADING if leading else BRACKET_INSIDE
            elif k and out[k - 1] in ":：":
                out[end] = QUOTE_INTRODUCED
            else:
                out[end] = QUOTE_LEADING if leading else QUOTE_INSIDE
    return "".join(out)


def split_block(block: str, lang: str) -> list[tuple[int, int]]:
    """``(start, end)`` of the sentences of one block, outer white space left out."""
    rules, out, start = table_of(lang), [], 0
    if _OPEN.search(block):
        seen = shadow(block)
    else:
        seen = block
    for m in _POSITION.finditer(seen):
        at = m.end()
        if at >= len(seen):
            break
        for rule in rules:
            if rule.here.match(seen, at):
                if rule.breaks:
                    out.append((start, at))
                    start = at
                break
    out.append((start, len(block)))
    trimmed = []
    for a, b in out:
        piece = block[a:b]
        inner = piece.strip()
        if inner:
            lead = len(piece) - len(piece.lstrip())
            trimmed.append((a + lead, a + lead + len(inner)))
    return trimmed


_FENCE = regex.compile(r"\s*```")
_HEADING = regex.compile(r" {0,3}#{1,6}(?:\s|$)")
_ITEM = regex.compile(r"\s*[-*] ")


def blocks(text: str, marked: bool = True) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of the blocks that may hold sentences; without markup (code, licences) blank lines alone part them."""
    at, held, fenced = 0, None, False
    for line in text.splitlines(keepends=True):
        end = at + len(line)
        if marked and _FENCE.match(line):
            if held is not None:
                yield held, at
                held = None
            fenced = not fenced
        elif not fenced:
            if not line.strip():
                if held is not None:
                    yield held, at
                    held = None
            elif marked and (_HEADING.match(line) or (item := _ITEM.match(line))):
                if held is not None:
                    yield held, at
                    held = None
                yield (at if _HEADING.match(line) else at + item.end()), end
            elif held is None:
                held = at
        at = end
    if held is not None:
        yield held, at


def sentences(text: str, declared: str | None, marked: bool = True) -> list[tuple[int, int]]:
    """``(start, end)`` in code points of all sentences of a text; ``marked`` texts may have headings, list items and fences."""
    lang = language(text, declared)
    out = []
    for a, b in blocks(text, marked):
        for x, y in split_block(text[a:b], lang):
            out.append((a + x, a + y))
    return out


def split_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "prose_lang", class_col: str | None = None, marked: Sequence[str | None] = ("prose",)) -> DataFrame:
    """``(id, sent_no, sent_start, sent_end)`` of every sentence, offsets in code points, end exclusive.

    With ``class_col`` only files of the classes ``marked`` are read as having headings, list items and fences; in others these
    signs mean something else, and nothing is left out.

    One narrow pass over whole texts. NULL, empty and blank texts give no sentence; a NULL language is
    guessed from the script; repeated rows give repeated sentences; only the named columns are read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            ids, no, start, end = [], [], [], []
            for key, text, lang, kind in zip(own, *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                for n, (a, b) in enumerate(sentences(text or "", lang, class_col is None or kind in marked), 1):
                    ids.append(key)
                    no.append(n)
                    start.append(a)
                    end.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["id", "sent_no", "sent_start", "sent_end"]
            )

    return df.select(F.col(id_col), F.col(text_col), F.col(lang_col), (F.col(class_col) if class_col else F.lit(None).cast("string")).alias("__class")).mapInArrow(split, f"id {kind}, sent_no int, sent_start long, sent_end long").withColumnRenamed("id", id_col)
