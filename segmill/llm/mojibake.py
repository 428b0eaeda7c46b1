"""Text garbled by a wrong encoding: noisy-channel decoding over byte lattices.

A garbled text was encoded in one encoding and read in another. The channel is undone by a lattice over
the bytes of the text in the encoding it was read in: arcs decode one character of the true encoding, or
keep the character as it stands; lost bytes (U+FFFD) are wildcards that match every character with fitting
bytes. Viterbi search finds the best path under the corpus frequencies of words. As neither Japanese nor
Chinese separates words, words are characters and pairs of neighbouring ones, counted over all distinct
texts that hold no unusual characters and no run of UTF-8 bytes.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import charstats

#: (read as, really): the channels that are tried.
CHANNELS = (
    ("latin-1", "utf-8"), ("cp1252", "utf-8"), ("cp1251", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("koi8-r", "utf-8"), ("mac-roman", "utf-8"),
    ("cp932", "utf-8"), ("gb18030", "utf-8"), ("big5hkscs", "utf-8"), ("euc-jp", "utf-8"), ("cp949", "utf-8"),
    ("latin-1", "cp932"), ("cp1252", "cp932"), ("mac-roman", "cp932"), ("koi8-r", "cp932"), ("cp437", "cp932"), ("gb18030", "cp932"), ("big5hkscs", "cp932"), ("cp949", "cp932"),
    ("latin-1", "euc-jp"), ("cp1252", "euc-jp"), ("mac-roman", "euc-jp"), ("cp932", "euc-jp"), ("gb18030", "euc-jp"), ("big5hkscs", "euc-jp"),
    ("latin-1", "gbk"), ("cp1252", "gbk"), ("mac-roman", "gbk"), ("koi8-r", "gbk"), ("cp437", "gbk"), ("cp932", "gbk"), ("euc-jp", "gbk"), ("big5hkscs", "gbk"), ("cp949", "gbk"),
    ("latin-1", "big5"), ("cp1252", "big5"), ("gb18030", "big5"), ("cp932", "big5"),
)
_READ_AS_UTF8 = tuple(read_as for read_as, really in CHANNELS if really == "utf-8")
_LENGTHS = {"utf-8": (2, 3, 4), "cp932": (2, 1), "euc-jp": (2, 3), "gbk": (2,), "big5": (2,)}
LOST, FOREIGN = -1, -2
#: Log probability of a character that no sound text holds; costs of entering and leaving a garbled stretch.
UNSEEN, ENTER, LEAVE = -16.0, -6.0, -2.0
#: Least number of different characters decoded and least gain over the text as it stands: for UTF-8, whose bytes
#: seldom fit by chance, and (False) for the other encodings, as which any few half-width letters can be read.
SURE = {True: (1, 10.0), False: (4, 30.0)}
#: First code points of alphabets (and Hangul); letters of words in them may be foreign rather than garbled.
_ALPHABETS = (0x41, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0x980, 0xE00, 0xE80, 0x1E00, 0x1F00, 0x2000, 0xAC00, 0xD7A4)


@functools.lru_cache(100_000)
def foreign(before: str, char: str) -> float:
    """Log probability of a character that no sound text of the corpus holds.

    A letter that goes on a word of its own alphabet, in small letters as words do, is likely; one that
    begins a word less so; signs and everything else are unseen.
    """
    if not char.isalpha() or char.isupper() and before.isalpha():
        return UNSEEN - 1.5
    place = bisect.bisect(_ALPHABETS, ord(char))
    if place == len(_ALPHABETS) or _ALPHABETS[place - 1] in (0x250, 0x2000):
        return UNSEEN - 1.5
    if before.isalpha():
        alike = bisect.bisect(_ALPHABETS, ord(before)) == place or (char <= "\u1eff" and before < "\u0250" and "\u1e00" <= char) or ("\u1e00" <= before <= "\u1eff" and char < "\u0250")
        return -5.0 if alike else UNSEEN - 1.5
    return -7.5 if before in " \n-'([{“‘（「" else -12.0


class Words:
    """Corpus frequencies of characters and pairs as conditional log probabilities with back-off.

    ``following`` has, of every first character, the second ones as one string and the counts of the pairs in
    its order: some six bytes a pair, all pairs seen more than once, bounded by the character repertoire.
    """

    def __init__(self, single: dict[str, int], following: Iterable[tuple[str, str, Sequence[int]]]):
        total = max(1, sum(single.values()))
        self.single = {c: math.log(n / total) for c, n in single.items()}
        self.following = {c: (seconds, array("f", [math.log(n / single[c]) for n in counts])) for c, seconds, counts in following if single.get(c)}
        self._fitting: dict[str, dict] = {}

    def step(self, before: str, char: str) -> float:
        row = self.following.get(before)
        if row is not None:
            place = row[0].find(char)
            if place >= 0:
                return row[1][place]
        found = self.single.get(char)
        return found - 1.5 if found is not None else foreign(before, char)

    def score(self, text: str) -> float:
        before, total = "\n", 0.0
        for c in text:
            total += self.step(before, c)
            before = c
        return total + self.step(before, "\n")

    def fitting(self, encoding: str, pattern: tuple[int, ...]) -> list[str]:
        """Known characters whose bytes match a pattern with wildcards, most frequent first."""
        table = self._fitting.get(encoding)
        if table is None:
            table = {}
            for c in sorted(self.single, key=self.single.get, reverse=True):
                try:
                    raw = c.encode(encoding)
                except UnicodeEncodeError:
                    continue
                if len(raw) < 2:
                    continue
                for mask in range(1, 1 << len(raw)):
                    if mask.bit_count() < len(raw):
                        key = tuple(LOST if mask >> i & 1 else b for i, b in enumerate(raw))
                        table.setdefault(key, []).append(c)
            self._fitting[encoding] = table
        return table.get(pattern, [])

    def __getstate__(self):
        return {"single": self.single, "following": self.following, "_fitting": {}}


@functools.lru_cache(200_000)
def char_bytes(char: str, encoding: str) -> bytes | None:
    """The byte or bytes that were read as this character."""
    try:
        return char.encode(encoding)
    except UnicodeEncodeError:
        # bytes that an encoding leaves undefined are often passed through as controls
        return bytes([ord(char)]) if 0x80 <= ord(char) <= 0x9F else None


@functools.lru_cache(400_000)
def one_char(raw: bytes, encoding: str) -> str | None:
    try:
        text = raw.decode(encoding)
    except UnicodeDecodeError:
        return None
    return text if len(text) == 1 else None


def lattice(text: str, read_as: str) -> tuple[list[int], dict[int, tuple[str, int]]]:
    """Bytes of the text in the encoding it was read in, and the character that starts at each offset."""
    raw: list[int] = []
    starts: dict[int, tuple[str, int]] = {}
    for c in text:
        b = None if c == "\ufffd" else char_bytes(c, read_as)
        own = [LOST] if c == "\ufffd" else [FOREIGN] if b is None else list(b)
        starts[len(raw)] = (c, len(own))
        raw += own
    return raw, starts


def decode(text: str, read_as: str, really: str, words: Words) -> tuple[str, float, int]:
    """``(best text, its score, number of different characters decoded)`` by Viterbi search through the lattice."""
    raw, starts = lattice(text, read_as)
    n = len(raw)
    lengths = _LENGTHS[really]
    best: list[dict] = [{} for _ in range(n + 1)]
    best[0]["\n", False] = (0.0, None, "", 0)
    for at in range(n):
        states = best[at]
        if not states:
            continue
        arcs: list[tuple[int, str, bool | None, float]] = []
        if at in starts:
            char, length = starts[at]
            arcs.append((length, char, None if char.isascii() else False, 0.0))
        first = raw[at]
        if first >= 0x80 or first == LOST:
            for length in lengths:
                chunk = raw[at : at + length]
                if len(chunk) < length or FOREIGN in chunk:
                    continue
                if LOST in chunk:
                    if any(b != LOST for b in chunk):
                        arcs += [(length, c, True, -1.0) for c in words.fitting(really, tuple(chunk))]
                else:
                    char = one_char(bytes(chunk), really)
                    if char is not None:
                        arcs.append((length, char, True, 0.0))
            if first != LOST:
                arcs.append((1, "\ufffd", True, -4.0))  # a byte that fits nowhere
        for key, (score, *_rest) in states.items():
            before, garbled = key
            for length, char, mode, cost in arcs:
                if char == "\ufffd" and mode:
                    total = score + UNSEEN + cost
                else:
                    total = score + words.step(before, char) + cost
                if mode is None:
                    mode_after = garbled
                else:
                    mode_after = mode
                    if mode != garbled:
                        total += ENTER if mode else LEAVE
                slot = best[at + length]
                to = (char, mode_after)
                if to not in slot or slot[to][0] < total:
                    slot[to] = (total, (at, key), char, 1 if mode else 0)
    if not best[n]:
        return text, -math.inf, 0
    ends = {k: v[0] + words.step(k[0], "\n") for k, v in best[n].items()}
    key = max(ends, key=ends.get)
    score, out, decoded, at = ends[key], [], set(), n
    while True:
        _, back, char, flag = best[at][key]
        if back is None:
            break
        out.append(char)
        if flag:
            decoded.add(char)
        at, key = back
    return "".join(reversed(out)), score, len(decoded)


def _promising(text: str, channels: Sequence[tuple[str, str]], words: Words) -> Iterator[tuple[str, str]]:
    """The channels in which the plain decoding of a damaged stretch gives known characters.

    Unknown ones count a quarter against it, since sound text may stand around the damage. Encodings that lack more than
    a quarter of the stretch's characters are left out. The bytes are made once an encoding.
    """
    visible = [c for c in text if not c.isascii() and c != "\ufffd"]
    bytes_of: dict[str, bytes | None] = {}
    for read_as, really in channels:
        if read_as not in bytes_of:
            lacking = sum([char_bytes(c, read_as) is None for c in visible])
            bytes_of[read_as] = None if lacking * 4 > len(visible) else b"".join([b" " if c == "\ufffd" else char_bytes(c, read_as) or b" " for c in text])
        raw = bytes_of[read_as]
        if raw is None:
            continue
        good = bad = 0
        for c in set(raw.decode(really, "replace")):
            if not c.isascii() and c != "\ufffd":
                if words.single.get(c, UNSEEN) > -11.5:
                    good += 1
                else:
                    bad += 1
        if good >= (1 if really == "utf-8" else 3) and good - bad / 4 > 0:
            yield read_as, really


_PEELED = re.compile("[\x20-\x7e]*(?:[\x80-\u024f\u02c6\u02dc\u2013-\u203a\u20ac\u2122][\x20-\x7e]*){4,}")


def peel(text: str) -> str | None:
    """The text with stretches of Latin letters and signs read back from UTF-8 once, if any can be.

    Text garbled twice comes out garbled once; the search undoes the other time.
    """
    changed = False

    def once(m: re.Match) -> str:
        nonlocal changed
        raw = b"".join(char_bytes(c, "cp1252") or char_bytes(c, "latin-1") or b"\xff" for c in m.group())
        try:
            back = raw.decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        changed = True
        return back

    out = _PEELED.sub(once, text)
    return out if changed else None


#: Three characters of UTF-8 in a row, ideographs or kana: by chance hardly ever in the bytes of another encoding.
_UTF8_RUN = re.compile(b"(?:[\xe3-\xe9][\x80-\xbf]{2}){3,}")


#: A run of UTF-8 read byte by byte has nine characters outside ASCII, kana and ideographs; without one, encodings of several bytes are left.
_OTHER_RUN = re.compile("[^\x00-\x7f\u3000-\u9fff\uff00-\uffef]{9}")
_WIDE = tuple(e for e in _READ_AS_UTF8 if e in ("cp932", "gb18030", "big5hkscs", "euc-jp", "cp949"))


@functools.cache
def _may_hold(read_as: str) -> re.Pattern:
    """What every text has whose bytes in an encoding of several bytes hold such a run.

    Its nine bytes are lead or trail bytes of UTF-8, so all whole characters among them have such bytes alone: four
    characters at least, or two where they can have three bytes.
    """
    fits = set(range(0x80, 0xC0)) | set(range(0xE3, 0xEA))
    known, least = [], 4
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000))):
        try:
            raw = c.encode(read_as)
        except UnicodeEncodeError:
            continue
        if fits.issuperset(raw):
            known.append(c)
            least = 2 if len(raw) > 2 else least
    return re.compile("[" + re.escape("".join(known)) + "]{%d}" % least)


def hidden_utf8(text: str, share: float = 0.0) -> bool:
    """Whether the bytes of the text in an encoding it may have been read in hold a run of UTF-8, however common its characters are.

    With ``share`` the runs must be such a part of the bytes, which long sound texts don't reach by chance.
    """
    if text.isascii():
        return False
    for read_as in _READ_AS_UTF8 if _OTHER_RUN.search(text) else _WIDE:
        if read_as in _WIDE and _may_hold(read_as).search(text) is None:
            continue
        raw = text.encode(read_as, "replace")
        held = sum(len(m.group()) for m in _UTF8_RUN.finditer(raw))
        if held and held >= share * len(raw):
            return True
    return False


def restore(text: str, common: charstats.Commonness, words: Words, channels: Sequence[tuple[str, str]] = CHANNELS, rounds: int = 2) -> tuple[bool, str | None, str | None]:
    """``(garbled, restored text or None, channel)`` of one suspicious text.

    Texts without a convincing channel count as garbled only for broken characters inside them: two or more
    not counting U+FFFD at the end, which a cut leaves.
    """
    current, used = text, []
    below = peel(text)
    if below is not None and common.suspicious(below) and len(common.rare(below)) >= 3:
        found, fixed, how = restore(below, common, words, channels, 1)
        if found and fixed is not None:
            return True, fixed, f"{how} then utf-8 read as cp1252"
    for _ in range(rounds):
        rare = common.rare(current)
        if len(rare) < 3 and hidden_utf8(current):
            rare = [c for c in current if not c.isascii()]  # common characters that are garbled all the same
        if not rare:
            break
        places = [current.index(rare[0]), current.rindex(rare[-1]) + 1]
        span = current[places[0] : places[1]]
        promising = [*_promising(span, channels, words)]
        stands, won = words.score(current), None
        for read_as, really in promising:
            candidate, score, decoded = decode(current, read_as, really, words)
            least, margin = SURE[really == "utf-8"]
            if decoded >= least and score > stands + margin and (won is None or score > won[1]):
                won = (candidate, score, f"{really} read as {read_as}")
        if won is None:
            break
        current = won[0]
        used.append(won[2])
    if used:
        return True, current, " then ".join(reversed(used))
    inner = text.rstrip("\ufffd \n")
    return len(charstats.BROKEN.findall(inner)) >= 2, None, None


def word_counts(values: DataFrame, common: charstats.Commonness) -> Words:
    """:class:`Words` of all texts without unusual characters: all characters, and all pairs seen more than once.

    What reaches the driver is one row per character, with the characters seen after it.
    """
    spark = values.sparkSession
    shared = spark.sparkContext.broadcast(common)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            known = shared.value
            sound = [t for t in batch.column(0).to_pylist() if t and not known.suspicious(t, 1) and not hidden_utf8(t, 0.1)]
            if sound:
                held.append(_tally(sound))
                size += len(held[-1][0])
            if size > 2_000_000:
                yield _counts(held)
                held, size = [], 0
        if held:
            yield _counts(held)

    counted = values.select("value").where("value IS NOT NULL").distinct().mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counted = counted.where("length(w) = 1 OR n > 1")
    by_first = counted.groupBy(F.substring("w", 1, 1).alias("c")).agg(
        F.max(F.when(F.length("w") == 1, F.col("n"))).alias("n"), F.sort_array(F.collect_list(F.when(F.length("w") == 2, F.struct("n", F.substring("w", 2, 1).alias("c")))), False).alias("after")
    )
    packed = by_first.select("c", "n", F.array_join("after.c", "").alias("seconds"), F.col("after.n").alias("counts"))
    single, following = {}, []
    for r in packed.collect():
        if r.n:
            single[r.c] = r.n
            following.append((r.c, r.seconds, array("q", r.counts)))
    return Words(single, following)


def _tally(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, counts)`` of the characters and pairs of texts; a line break stands before and after every text."""
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    inside = np.ones(len(points), bool)  # but for the breaks put between the texts
    inside[np.cumsum([0, *(len(t) + 1 for t in texts)])] = False
    codes = np.concatenate((points[inside], (points[:-1] + np.uint64(1)) << np.uint64(21) | points[1:]))
    return np.unique(codes, return_counts=True)


def _counts(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    codes, place = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([n for _, n in held])).astype(np.int64)
    words = [chr(c) if c <= 0x1FFFFF else chr((c >> 21) - 1) + chr(c & 0x1FFFFF) for c in codes.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts)], names=["w", "n"])


def repaired(values: DataFrame) -> DataFrame:
    """``(field_name, id, value, restored, channel)`` of every garbled value.

    ``values`` is ``(field_name, id, value)``. ``restored`` is NULL where the original can't be had. Three
    passes over all texts: characters' document frequencies, word frequencies, then the search, which runs
    only for texts with unusual characters or a run of UTF-8 bytes. NULL, empty and ASCII texts are never garbled; every repeated
    row is judged; a whole text is searched however long it is. Texts move once a task and distinct text, to be counted without copies.
    """
    spark = values.sparkSession
    common = charstats.commonness(values)
    words = word_counts(values, common)
    model = spark.sparkContext.broadcast((common, words))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple] = {}
        for batch in batches:
            common, words = model.value
            keep, restored, channel = [], [], []
            for k, text in enumerate(batch.column("value").to_pylist()):
                if not text or not (common.suspicious(text) or hidden_utf8(text)):
                    continue
                if text not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    seen[text] = restore(text, common, words)
                garbled, fixed, how = seen[text]
                if garbled:
                    keep.append(k)
                    restored.append(fixed)
                    channel.append(how)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(keep, pa.int64())) for c in ("field_name", "id", "value")), pa.array(restored, pa.string()), pa.array(channel, pa.string())],
                names=["field_name", "id", "value", "restored", "channel"],
            )

    return values.select("field_name", "id", "value").mapInArrow(search, "field_name string, id long, value string, restored string, channel string")
