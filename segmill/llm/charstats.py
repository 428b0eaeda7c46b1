"""Character statistics of a text column over the whole corpus."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scripts whose plain characters are never suspicious: ASCII, kana, CJK punctuation, full-width forms, common typography.
_PLAIN = "\\n\\x20-\\x7e\\u3000-\\u303f\\u3041-\\u3096\\u3099-\\u30ff\\uff01-\\uff5e\\u2010-\\u2027\\u2030-\\u203a\\u266a"
#: Characters that hardly occur in sound text: C1 controls, private use, the replacement character.
BROKEN = re.compile("[\x80-\x9f-�]")


def document_frequencies(values: DataFrame) -> tuple[dict[str, int], int, dict[str, int]]:
    """``(character -> texts that hold it, number of texts, character -> texts it ends)`` over all distinct non-NULL ``value``\\ s.

    Copies count once, however many rows hold them; they are one row per task before texts move. Every task then counts its own texts and sends one row per character; a driver-side table of characters is
    bounded by Unicode's repertoire.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t is not None]
            held[""] += len(texts)
            held.update("".join("".join(set(t)) for t in texts))
            held.update("\n" + t[-1] for t in map(str.rstrip, texts) if t)  # their last characters, under two-character keys
        yield pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([*held.values()], pa.int64())], names=["c", "n"])

    rows = values.select("value").where("value IS NOT NULL").distinct().mapInArrow(count, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    table = {r.c: r.n for r in rows if len(r.c) < 2}
    total = table.pop("", 0)
    return table, total, {r.c[1]: r.n for r in rows if len(r.c) == 2}


class Commonness:
    """Tells characters that many texts hold (or that belong to plain scripts) from rare ones.

    A character is rare where it is in less than ``share`` of the texts. ``rare`` goes further and counts those
    that one text alone holds, however few texts there are: it says where to look, not what is found.
    """

    def __init__(self, frequencies: dict[str, int], texts: int, endings: Mapping[str, int] | None = None, share: float = 0.01):
        self.frequencies, self.endings = frequencies, endings or {}
        kept = {c: n for c, n in frequencies.items() if not BROKEN.match(c)}
        self.common = "".join(sorted(c for c, n in kept.items() if n >= max(2, share * texts)))
        self.usual = "".join(sorted(c for c, n in kept.items() if n >= share * texts))
        self._rare = self._unusual = None

    def rare(self, text: str) -> list[str]:
        if self._rare is None:
            self._rare = re.compile("[^" + _PLAIN + re.escape(self.common) + "]")
        return self._rare.findall(text)

    def __getstate__(self):
        return self.__dict__ | {"_rare": None, "_unusual": None}

    def goes_on(self, char: str) -> float:
        """Log odds that a text with this character goes on after it, by the texts that hold it and those that it ends."""
        last = self.endings.get(char, 0)
        return math.log((max(0, self.frequencies.get(char, 0) - last) + 1) / (last + 1))

    def suspicious(self, text: str, least: int = 3) -> bool:
        """Whether the text holds ``least`` rare characters, or a broken one."""
        return not text.isascii() and (len(self.rare(text)) >= least or BROKEN.search(text) is not None)

    def mostly_rare(self, text: str) -> bool:
        """Whether a quarter of the visible characters are rare, three at least: foreign or garbled text.

        In a table of few texts every character is in a fair share of them, so that none of its texts is.
        """
        if text.isascii():
            return False
        if self._unusual is None:
            self._unusual = re.compile("[^" + _PLAIN + re.escape(self.usual) + "]")
        rare = len(self._unusual.findall(text))
        return rare >= 3 and rare * 4 >= len(text.replace(" ", ""))


def commonness(values: DataFrame, share: float = 0.01) -> Commonness:
    """The :class:`Commonness` of all texts in ``value``."""
    return Commonness(*document_frequencies(values), share=share)
