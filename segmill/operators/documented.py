"""Checks known from prose only: small relational operators, each a few lines.

All take plain tables, leave NULLs unequal to everything unless said otherwise, and return findings; an
empty input gives no finding.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from segmill.functions import codecs, paths
from segmill.functions import text as T
from segmill.operators import skew

# Signatures of archives and scripts, and the format each speaks for. Those in ASCII stand at the
# file's beginning, but for the two that are found anywhere in an executable.
MAGIC = (
    (b"XP3\r\n \n\x1a", "KiriKiri"),
    (b"YPF\x00", "Yu-Ris"),
    (b"FilePackVer3.0", "QLIE"),
    (b"PackFile", "QLIE"),
    (b"ESC-ARC1", "Escude"),
    (b"ESC-ARC2", "Escude"),
    (b"BurikoCompiledScriptVer1.00", "BGI/Ethornell"),
    (b"BURIKO", "BGI/Ethornell"),
    (b"MajiroArcV1.000", "Majiro"),
    (b"MajiroArcV2.000", "Majiro"),
    (b"MajiroArcV3.000", "Majiro"),
    (b"KIF", "CatSystem2"),
    (b"CatScene", "CatSystem2"),
    (b"GAMEDAT PAC", "Softpal"),
    (b"PACK", "Softpal"),
    (b"pf6", "Artemis"),
    (b"pf8", "Artemis"),
    (b"RGSSAD", "RPG Maker"),
    (b"DX", "Wolf RPG Editor"),
)
# Other containers, for files that hold none of these.
OTHERS = ((b"PK\x03\x04", "zip"), (b"MZ", "exe"), (b"Rar!", "rar"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"OggS", "ogg"), (b"RIFF", "riff"), (b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF8", "gif"), (b"BM", "bmp"), (b"CPK ", "cpk"))
EXECUTABLE, INSIDE = b"MZ", ((b"LIVEMAKER", "LiveMaker"), (b"LiveMaker", "LiveMaker"))
#: A format known by two file names of one folder rather than by bytes.
NAME_PAIR = (("scene.pck", "gameexe.dat"), "SiglusEngine")


def magic_kind(content: Column) -> Column:
    """Format of a file by its first bytes, the longest signature first; of an executable by what it holds; NULL for none.

    ``DX`` alone is too short to tell: it also needs a version byte below 32.
    """
    head = F.substring(content, 1, max(len(m) for m, _ in MAGIC))
    chosen = F.lit(None).cast("string")
    for magic, kind in sorted((*OTHERS, *MAGIC), key=lambda x: len(x[0])):
        begins = F.startswith(head, F.lit(bytearray(magic)))
        if magic == b"DX":
            begins &= F.coalesce(F.conv(F.hex(F.substring(content, 3, 1)), 16, 10).cast("int") < 32, F.lit(False))
        chosen = F.when(begins, F.lit(kind)).otherwise(chosen)
    holds = F.lit(False)
    for magic, _ in INSIDE:
        holds |= F.contains(content, F.lit(bytearray(magic)))
    return F.when(F.startswith(head, F.lit(bytearray(EXECUTABLE))) & holds, F.lit(INSIDE[0][1])).otherwise(chosen)


def named_pairs(inventory: DataFrame) -> DataFrame:
    """``(folder, kind)`` of folders that hold both files of :data:`NAME_PAIR`, whatever their case."""
    names, kind = NAME_PAIR
    path = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    own = inventory.select(F.regexp_replace(path, "[^/]*$", "").alias("folder"), F.regexp_extract(path, "[^/]*$", 0).alias("name")).where(F.col("name").isin(*names))
    return own.groupBy("folder").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(names)).select("folder", F.lit(kind).alias("kind"))


def _clean(text: str) -> bool:
    """No control characters but line breaks and tabs, no private use."""
    return not any(c < " " and c not in "\n\r\t" or "\x7f" <= c <= "\x9f" or "\ue000" <= c <= "\uf8ff" for c in text)


def _blob(text: str) -> bool:
    """Whether a decoded text is more likely data: one ideograph over and over, half-width noise, pixel-like runs."""
    n = len(text)
    if n < 4:
        return False
    most = max(map(text.count, set(text)))
    half = sum("\uff61" <= c <= "\uff9f" for c in text)
    runs = sum(a == b for a, b in zip(text, text[1:], strict=False))
    ideographs = sum("\u3400" <= c <= "\u9fff" for c in text)
    return (most * 2 > n and ideographs * 2 > n) or half * 2 > n or runs * 2 > n


def prefixed_strings(content: DataFrame, encoding: str = "cp932", least: int = 1, most: int | None = None) -> DataFrame:
    """``(path, offset, text)``: length-prefixed strings ``[u32 LE][bytes][00]`` that decode and encode back alike.

    Strings of one byte count too; ``most`` is the file's length unless given. Candidates may overlap, so that zero bytes before
    a string hide none; what decodes to control or private characters, or to what looks like data, is
    left out. All offsets are tested at once; only those whose length and terminator fit are decoded.
    """

    @F.pandas_udf("array<struct<offset:int,text:string>>")
    def scan(contents: pd.Series) -> pd.Series:
        def one(raw: bytes) -> list[dict]:
            data, out = bytes(raw), []
            b = np.frombuffer(data, np.uint8)
            if len(b) < 5 + least:
                return out
            size = b[:-4].astype(np.int64) | b[1:-3].astype(np.int64) << 8 | b[2:-2].astype(np.int64) << 16 | b[3:-1].astype(np.int64) << 24
            at = np.arange(len(size))
            end = at + 4 + size
            fits = (size >= least) & (end < len(b)) & (True if most is None else size <= most)
            at, end = at[fits], end[fits]
            at, end = at[b[end] == 0], end[b[end] == 0]
            # no terminator inside: as many zero bytes up to the end as up to the start
            zeros = np.concatenate(([0], np.cumsum(b == 0)))
            bare = zeros[end] == zeros[at + 4]
            for i, j in zip(at[bare].tolist(), end[bare].tolist(), strict=True):
                body = data[i + 4 : j]
                try:
                    text = body.decode(encoding)
                except UnicodeError:
                    continue
                if text.encode(encoding) == body and _clean(text) and not _blob(text):
                    out.append({"offset": i, "text": text})
            return out

        return contents.map(one)

    return content.where("content IS NOT NULL").select("path", F.explode(scan("content")).alias("s")).select("path", "s.*")


def completeness(known: DataFrame, found: DataFrame, keys: list[str], source: str = "source") -> DataFrame:
    """``(keys, status)``: ``known-match``, ``source-mismatch``, ``new-candidate`` or ``not-found``."""
    both = known.select(*keys, F.col(source).alias("__k"), F.lit(1).alias("__a")).join(found.select(*keys, F.col(source).alias("__f"), F.lit(1).alias("__b")), keys, "full_outer")
    status = F.when(F.col("__a").isNull(), "new-candidate").when(F.col("__b").isNull(), "not-found").when(F.col("__k").eqNullSafe(F.col("__f")), "known-match").otherwise("source-mismatch")
    return both.select(*keys, status.alias("status"))


def slot_bytes(text: Column) -> Column:
    """Careful size of a text in a legacy slot: ASCII one byte, all else two (P5)."""
    ascii_ = F.length(F.regexp_replace(text, "[^\\x00-\\x7f]", ""))
    return ascii_ + 2 * (F.length(text) - ascii_)


def slot_budget(rows: DataFrame) -> DataFrame:
    """``(id, used, slot_size, fits, same_lines)`` of ``(id, source, target, slot_size)`` (P5)."""
    breaks = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    used = slot_bytes(F.col("target"))
    return rows.select("id", used.alias("used"), "slot_size", (used <= F.col("slot_size")).alias("fits"), (breaks("source") == breaks("target")).alias("same_lines"))


def sequences_equal(a: DataFrame, b: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """``(group, equal)``: whether two scripts have the same ordered sequence of sources.

    Positions are joined and differences counted, so no sequence is ever gathered.
    """
    both = a.select(group, position, F.col(value).alias("__x"), F.lit(1).alias("__a")).join(b.select(group, position, F.col(value).alias("__y"), F.lit(1).alias("__b")), [group, position], "full_outer")
    same = F.col("__a").isNotNull() & F.col("__b").isNotNull() & F.col("__x").eqNullSafe(F.col("__y"))
    return both.groupBy(group).agg((F.count_if(~same) == 0).alias("equal"))


def inconsistent_duplicates(catalog: DataFrame, exceptions: DataFrame, key: str = "source", value: str = "target") -> DataFrame:
    """``(key, variants)``: duplicate groups with several values and no exception of their own."""
    groups = catalog.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("variants")).where("variants > 1")
    return groups.join(exceptions.select(key), key, "left_anti")


def baseline_of(profiles: DataFrame, tree: DataFrame) -> DataFrame:
    """``(status, profile)``: the one profile all of whose ``(profile, rel, sha256)`` match; none or several are unsupported."""
    hits = profiles.join(tree.select("rel", F.col("sha256").alias("now")), "rel", "left").groupBy("profile").agg(F.every(F.coalesce(F.col("now") == F.col("sha256"), F.lit(False))).alias("all"))
    one = hits.agg(F.count_if("all").alias("n"), F.min(F.when(F.col("all"), F.col("profile"))).alias("p"))
    return one.select(F.when(F.col("n") == 1, "supported").otherwise("unsupported").alias("status"), F.when(F.col("n") == 1, F.col("p")).alias("profile"))


def tree_diff(old: DataFrame, new: DataFrame, mutable: DataFrame) -> DataFrame:
    """``(rel, change)``: ``added``, ``removed``, ``immutable-changed`` or ``declared-mutable``; equal files aren't listed."""
    both = old.select("rel", F.col("sha256").alias("a")).join(new.select("rel", F.col("sha256").alias("b")), "rel", "full_outer").join(mutable.select("rel", F.lit(True).alias("free")).distinct(), "rel", "left")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), F.when(F.col("free"), "declared-mutable").otherwise("immutable-changed"))
    return both.select("rel", change.alias("change")).where("change IS NOT NULL")


def category_audit(rows: DataFrame, encoding: str) -> DataFrame:
    """``(category, rows, unencodable, kana)`` of ``(category, text)`` (P10)."""
    own = rows.select("category", codecs.encodes(F.col("text"), encoding).alias("ok"), (F.size(T.kana_in(T.without_tokens(F.col("text")))) > 0).alias("k"))
    return own.groupBy("category").agg(F.count("*").alias("rows"), F.count_if(~F.col("ok")).alias("unencodable"), F.count_if("k").alias("kana"))


def log_operation(record: DataFrame, path: str) -> None:
    """Append operation records as JSON."""
    record.write.mode("append").json(path)


def byte_identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(rel, identical)`` of files that both hashed trees have."""
    return a.select("rel", F.col("sha256").alias("a")).join(b.select("rel", F.col("sha256").alias("b")), "rel").select("rel", (F.col("a") == F.col("b")).alias("identical"))


def overlapping_ranges(ranges: DataFrame) -> DataFrame:
    """``(path, id, start)`` of declared write ranges that begin before the furthest end of earlier ones.

    ``ranges`` is ``(path, id, start, end)``, ends exclusive.
    """
    before = Window.partitionBy("path").orderBy("start", "end", "id").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("reach", F.max("end").over(before)).where(F.col("reach") > F.col("start")).select("path", "id", "start")


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    """``(key, times)`` of ids that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("times")).where("times > 1")


def path_hazards(files: DataFrame) -> DataFrame:
    """``(path, hazard)``: paths equal but for case, and unsafe ones."""
    keyed = files.select("path", F.lower("path").alias("k"))
    many = keyed.distinct().groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    clash = keyed.join(many, "k").select("path", F.lit("case-collision").alias("hazard"))
    return clash.unionByName(files.where(~paths.is_safe(F.col("path"), allow_colon=False)).select("path", F.lit("unsafe").alias("hazard")))


def regeneration_diff(old: DataFrame, new: DataFrame, key: str = "segment_id", text: str = "target", source: str = "source") -> DataFrame:
    """``(key, status)`` of catalog rows after regeneration: ``kept``, ``changed``, ``new``, ``omitted-no-op`` (target equals source) or ``omitted``."""
    o = old.select(key, F.col(text).alias("ot"), F.col(source).alias("os"), F.lit(1).alias("a"))
    both = o.join(new.select(key, F.col(text).alias("nt"), F.lit(1).alias("b")), key, "full_outer")
    gone = F.when(F.col("ot").eqNullSafe(F.col("os")), "omitted-no-op").otherwise("omitted")
    return both.select(key, F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), gone).when(F.col("ot").eqNullSafe(F.col("nt")), "kept").otherwise("changed").alias("status"))


def differing_outside(differences: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(path, at)``: differing byte offsets that no declared range of their file covers.

    Ranges of a file and its offsets are swept in order: the greatest end of all ranges begun so far
    decides, so no offset meets every range.
    """
    events = ranges.select("path", F.col("start").alias("at"), F.col("end"), F.lit(0).alias("kind")).unionByName(differences.select("path", "at", F.lit(None).cast("long").alias("end"), F.lit(1).alias("kind")))
    w = Window.partitionBy("path").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("reach", F.max("end").over(w)).where((F.col("kind") == 1) & F.coalesce(F.col("reach") <= F.col("at"), F.lit(True))).select("path", "at")


def occurrence_check(texts: DataFrame, expected: DataFrame) -> DataFrame:
    """``(path, old_count, new_count, ok)``: old wording gone, new wording as often as declared.

    ``expected`` is ``(path, old, new, times)``.
    """
    n = lambda piece: ((F.length("text") - F.length(F.replace(F.col("text"), F.col(piece), F.lit("")))) / F.length(piece)).cast("long")
    both = expected.join(texts.select("path", "text"), "path", "left")
    return both.select("path", n("old").alias("old_count"), n("new").alias("new_count")).join(expected.select("path", "times"), "path").select("path", "old_count", "new_count", ((F.col("old_count") == 0) & (F.col("new_count") == F.col("times"))).alias("ok"))


def progress_check(trace: DataFrame) -> DataFrame:
    """``(job, ok)`` of ``(job, step, percent)``: begins at 1, ends at 100, never falls."""
    w = Window.partitionBy("job").orderBy("step")
    own = trace.withColumn("fell", F.coalesce(F.col("percent") < F.lag("percent").over(w), F.lit(False)))
    return own.groupBy("job").agg(((F.min_by("percent", "step") == 1) & (F.max_by("percent", "step") == 100) & ~F.some("fell")).alias("ok"))


def stray_targets(branches: DataFrame, elements: DataFrame) -> DataFrame:
    """Branch targets ``(path, target)`` that no element ``(path, start)`` begins at (P20)."""
    return branches.select("path", "target").join(elements.select("path", F.col("start").alias("target")), ["path", "target"], "left_anti")


#: Bytes of a content that one whole number holds, and such numbers that are compared before bytes are walked through.
_WORD, _MOST_WORDS = 7, 8


def _numbers(longest: int) -> int:
    return min(_MOST_WORDS, max(1, math.ceil(longest / _WORD)))


def _words(content: Column, name: str, longest: int) -> list[Column]:
    """Bytes as numbers of seven each (``name_0`` and so on), what is behind the last of them in hex (``name_rest``), and their count (``name_size``).

    ``longest`` is the size that matters; ``name_rest`` is there only if that is beyond the numbers.
    """
    n = _numbers(longest)
    own = [F.conv(F.rpad(F.hex(F.substring(content, 1 + k * _WORD, _WORD)), 2 * _WORD, "0"), 16, 10).cast("long").alias(f"{name}_{k}") for k in range(n)]
    rest = [F.hex(F.substring(content, 1 + n * _WORD, 2**31 - 1)).alias(f"{name}_rest")] if longest > n * _WORD else []
    return [*own, *rest, F.octet_length(content).alias(f"{name}_size")]


def _first_byte(a: str, b: str, longest: int) -> Column:
    """The first byte in which two contents of ``_words`` differ, a lacking byte included; NULL where none does or one is NULL."""
    n = _numbers(longest)
    inside = None
    for k in range(n):
        differs = F.col(f"{a}_{k}").bitwiseXOR(F.col(f"{b}_{k}"))
        at = F.when(differs >= 1 << 8 * (_WORD - 1), k * _WORD)  # by its highest byte that isn't zero
        for i in range(1, _WORD):
            at = at.when(differs >= 1 << 8 * (_WORD - 1 - i), k * _WORD + i)
        inside = F.when(differs != 0, at) if inside is None else inside.when(differs != 0, at)
    if longest > n * _WORD:
        rest = [F.col(f"{s}_rest") for s in (a, b)]
        walked = F.array_position(F.zip_with(*(F.split(r, "(?<=\\G..)") for r in rest), lambda u, v: ~u.eqNullSafe(v)), True) - 1
        inside = inside.when(rest[0] != rest[1], walked + n * _WORD)
    sizes = F.col(f"{a}_size"), F.col(f"{b}_size")
    return F.when(sizes[0] != sizes[1], F.least(inside, *sizes)).otherwise(inside).cast("long")


def fingerprint_matrix(frames: DataFrame, prints: DataFrame) -> DataFrame:
    """``(frame, print, matches, first_mismatch)`` of ``(frame, place, content)`` against ``(print, place, content)``.

    ``first_mismatch`` is the first differing byte of the pair's first differing place. NULL content decides nothing: ``matches``
    is NULL where no place differs and one has it. Pairs that can meet in one row alone are finished by the join; only
    the others, of which both have several places or one repeats a place, are gathered.
    """
    sides, kinds, sizes = [], [], []
    for df, key in ((frames, "frame"), (prints, "print")):
        rows = lambda *by: F.count(F.lit(1)).over(Window.partitionBy(*by))
        kind = F.when(rows(key) == 1, 2).when(rows(key, "place") == 1, 1).otherwise(0)  # one row in all, one row a place, several rows of a place
        sides.append(df.where("place IS NOT NULL").select(key, "place", F.col("content").cast("binary").alias("content"), kind.alias(f"{key}_kind")))
        held = sides[-1].agg(F.collect_set(f"{key}_kind"), F.max(F.octet_length("content"))).first()
        kinds.append(held[0])
        sizes.append(held[1] or 0)
    longest = min(sizes)  # behind it, sizes alone decide
    sides = [df.select(key, "place", *_words(F.col("content"), key, longest), f"{key}_kind") for df, key in zip(sides, ("frame", "print"), strict=True)]

    def met(meets: Callable) -> DataFrame | None:
        if not any(meets(x, y) for x in kinds[0] for y in kinds[1]):
            return None
        wide = [df.withColumn(other, F.explode(F.array(*map(F.lit, own)))).where(meets(F.col("frame_kind"), F.col("print_kind"))) for df, other, own in zip(sides, ("print_kind", "frame_kind"), reversed(kinds), strict=True)]
        return skew.cell_join(*wide, ["place", "frame_kind", "print_kind"], "frame", "print")

    parts = [*range(_numbers(longest)), *["rest"] * (longest > _numbers(longest) * _WORD), "size"]
    same = reduce(lambda x, y: x & y, (F.col(f"frame_{c}") == F.col(f"print_{c}") for c in parts))
    byte = _first_byte("frame", "print", longest)
    once, often = met(lambda x, y: x + y >= 3), met(lambda x, y: x + y < 3)
    found = []
    if once is not None:
        found.append(once.select("frame", "print", same.alias("matches"), byte.alias("first_mismatch")))
    if often is not None:
        each = often.select("frame", "print", same.alias("same"), F.when(~same, F.struct("place", byte.alias("byte"))).alias("at")).groupBy("frame", "print")
        own = each.agg(F.count("at").alias("wrong"), F.count_if(F.col("same").isNull()).alias("unknown"), F.min("at").alias("first"))
        found.append(own.select("frame", "print", F.when(F.col("wrong") > 0, False).when(F.col("unknown") == 0, True).alias("matches"), F.col("first.byte").alias("first_mismatch")))
    if not found:
        shape = StructType([frames.schema["frame"], prints.schema["print"]]).add("matches", "boolean").add("first_mismatch", "long")
        return frames.sparkSession.createDataFrame([], shape)
    return reduce(DataFrame.unionByName, found)


#: Marks that one code page opens and closes a choice with, around a payload in another one (fixed values).
WRAPPER = (b"\x81\x79", b"\x81\x7a")


def wrapped(content: Column, opens: bytes = WRAPPER[0], closes: bytes = WRAPPER[1], encoding: str = "gbk") -> Column:
    """Whether bytes are a payload of ``encoding`` between the exact opening and closing pair of another code page.

    The pairs alone say nothing: they are characters of ``encoding`` too. NULL for NULL.
    """
    size = F.octet_length(content) - (len(opens) + len(closes))
    around = F.startswith(content, F.lit(bytearray(opens))) & F.endswith(content, F.lit(bytearray(closes))) & (size >= 0)

    @F.pandas_udf("boolean")
    def decodes(payloads: pd.Series) -> pd.Series:
        def one(raw):
            try:
                bytes(raw).decode(encoding)
            except UnicodeError:
                return False
            return True

        return payloads.map(one, na_action="ignore")

    return around & F.coalesce(decodes(F.substring(content, F.lit(len(opens) + 1), F.greatest(size, F.lit(0)))), F.lit(False))


def composed_check(rows: DataFrame, encoding: str) -> DataFrame:
    """``(id, composed, encodable, kana)`` of ``(id, open, translation, close)``: the composed text must survive the codec."""
    own = rows.select("id", F.concat(F.coalesce("open", F.lit("")), F.coalesce("translation", F.lit("")), F.coalesce("close", F.lit(""))).alias("composed"))
    return own.select("id", "composed", codecs.encodes(F.col("composed"), encoding).alias("encodable"), (F.size(T.kana_in(F.col("composed"))) > 0).alias("kana"))


def pixel_delta(pairs: DataFrame) -> DataFrame:
    """``(path, same_alpha, max_delta, mean_delta)`` of raw RGBA pixels ``(path, before, after)``."""
    shape = pa.struct([("same_alpha", pa.bool_()), ("max_delta", pa.int32()), ("mean_delta", pa.float64())])

    @F.arrow_udf("same_alpha boolean, max_delta int, mean_delta double")
    def delta(before: pa.Array, after: pa.Array) -> pa.Array:
        rows = []
        for x, y in zip(before.to_pylist(), after.to_pylist(), strict=True):
            a, b = (np.frombuffer(v, np.uint8).astype(int).reshape(-1, 4) for v in (x, y))
            if a.shape != b.shape or not len(a):
                rows.append({"same_alpha": False})
                continue
            d = np.abs(a[:, :3] - b[:, :3])
            rows.append({"same_alpha": bool((a[:, 3] == b[:, 3]).all()), "max_delta": int(d.max()), "mean_delta": float(d.mean())})
        return pa.array(rows, shape)

    return pairs.select("path", delta("before", "after").alias("d")).select("path", "d.*")


def readback(expected: DataFrame, members: DataFrame, key: str = "member") -> DataFrame:
    """``(key, problem)``: members that are lacking or whose hash differs (P25)."""
    both = expected.select(key, F.col("sha256").alias("a")).join(members.select(key, F.col("sha256").alias("b")), key, "left")
    return both.select(key, F.when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "hash differs").alias("problem")).where("problem IS NOT NULL")


def retained(edges: DataFrame, releases: DataFrame) -> DataFrame:
    """``(node)``: everything that releases depend on through ``(node, input)``, themselves included.

    The frontier is joined until it is empty, which it is after as many rounds as the longest chain has nodes; each
    round is checkpointed.
    """
    from segmill.session import checkpointed

    known = checkpointed(releases.select("node").distinct())
    frontier = known
    while not frontier.isEmpty():
        frontier = checkpointed(frontier.join(edges, "node").select(F.col("input").alias("node")).where("node IS NOT NULL").distinct().join(known, "node", "left_anti"))
        known = checkpointed(known.unionByName(frontier))
    return known
