"""Image headers without pixels, and the comparison of two trees of images."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Suffixes that are read (fixed values).
SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp")
_FACTS = "format string, width int, height int, bit_depth int, alpha boolean, animated boolean, frames int, error string"
_ARROW_FACTS = pa.struct([("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bit_depth", pa.int32()), ("alpha", pa.bool_()), ("animated", pa.bool_()), ("frames", pa.int32()), ("error", pa.string())])


class _Bytes:
    """A cursor that fails with one message when the data ends early."""

    def __init__(self, data: bytes, what: str):
        self.data, self.at, self.what = data, 0, what

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError(f"truncated {self.what}")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, layout: str) -> tuple:
        return struct.unpack(layout, self.take(struct.calcsize(layout)))

    def more(self) -> bool:
        return self.at < len(self.data)


def _chunks(cursor: _Bytes) -> Iterator[tuple[bytes, bytes]]:
    while len(cursor.data) - cursor.at >= 12:
        size, kind = cursor.unpack(">I4s")
        yield kind, cursor.take(size)
        cursor.take(4)  # checksum
        if kind == b"IEND":
            return


def png(data: bytes) -> dict:
    cursor = _Bytes(data, "PNG")
    if cursor.take(8) != b"\x89PNG\r\n\x1a\n" or len(data) < 33:
        raise ValueError("not a PNG")
    width, height, depth, color = struct.unpack(">IIBB", data[16:26])
    kinds: set[bytes] = set()
    frames = 1
    for kind, body in _chunks(cursor):
        if kind == b"acTL" and kind not in kinds and len(body) >= 4:
            frames = struct.unpack(">I", body[:4])[0]
        kinds.add(kind)
    return {"format": "PNG", "width": width, "height": height, "bit_depth": depth, "alpha": color in (4, 6) or b"tRNS" in kinds, "animated": b"acTL" in kinds, "frames": frames}


def gif(data: bytes) -> dict:
    cursor = _Bytes(data, "GIF")
    if cursor.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = cursor.unpack("<HHBBB")
    table = lambda f: 3 << ((f & 7) + 1) if f & 0x80 else 0
    cursor.take(table(flags))
    frames, clear = 0, False

    def data_blocks() -> None:
        while size := cursor.take(1)[0]:
            cursor.take(size)

    while cursor.more():
        kind = cursor.take(1)
        if kind == b";":
            break
        if kind == b",":
            own = cursor.take(9)[8]
            cursor.take(table(own) + 1)
            data_blocks()
            frames += 1
        elif kind == b"!":
            if cursor.take(1) == b"\xf9":
                size, own, _, _, end = cursor.unpack("<BBHBB")
                if size != 4:
                    raise ValueError("bad GIF control block")
                clear |= bool(own & 1)
                del end
            else:
                data_blocks()
        else:
            raise ValueError(f"unknown GIF block {kind.hex()}")
    return {"format": "GIF", "width": width, "height": height, "bit_depth": (flags & 7) + 1, "alpha": clear, "animated": frames > 1, "frames": frames}


def jpeg(data: bytes) -> dict:
    cursor = _Bytes(data, "JPEG")
    if cursor.take(2) != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while True:
        mark = data.find(b"\xff", cursor.at)
        if mark < 0:
            raise ValueError("JPEG without dimensions")
        cursor.at = mark
        while cursor.more() and data[cursor.at] == 0xFF:
            cursor.at += 1
        if len(data) - cursor.at < 3:
            raise ValueError("JPEG without dimensions")
        kind = cursor.take(1)[0]
        if kind in (0xD8, 0xD9) or 0xD0 <= kind <= 0xD7:
            continue
        (size,) = struct.unpack(">H", data[cursor.at : cursor.at + 2])
        body = cursor.take(size) if size >= 2 else b""
        if not body:
            raise ValueError("truncated JPEG")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            if size < 8:
                raise ValueError("truncated JPEG")
            depth, height, width = struct.unpack(">BHH", body[2:7])
            return {"format": "JPEG", "width": width, "height": height, "bit_depth": depth, "alpha": False, "animated": False, "frames": 1}


def bmp(data: bytes) -> dict:
    if len(data) < 30 or data[:2] != b"BM":
        raise ValueError("not a BMP")
    (header,) = struct.unpack("<I", data[14:18])
    if header == 12:
        width, height, _, depth = struct.unpack("<HHHH", data[18:26])
    elif header >= 40 and len(data) >= 54:
        width, height, _, depth = struct.unpack("<iiHH", data[18:30])
    else:
        raise ValueError("unknown BMP header")
    return {"format": "BMP", "width": width, "height": abs(height), "bit_depth": depth, "alpha": depth == 32, "animated": False, "frames": 1}


READERS = {".png": png, ".gif": gif, ".jpg": jpeg, ".jpeg": jpeg, ".bmp": bmp}


def inventory(files: DataFrame) -> DataFrame:
    """``(path, bytes, sha256, format, width, height, bit_depth, alpha, animated, frames, error)`` of image files.

    ``files`` is ``(path, content)``; other suffixes are left out. Unreadable images keep their error.
    """

    @F.arrow_udf(_FACTS)
    def facts(path: pa.Array, content: pa.Array) -> pa.Array:
        rows = []
        for p, c in zip(path.to_pylist(), content.to_pylist(), strict=True):
            try:
                rows.append(READERS["." + p.rsplit(".", 1)[-1].lower()](c))
            except (ValueError, struct.error) as error:
                rows.append({"error": str(error)})
        return pa.array(rows, _ARROW_FACTS)

    own = files.where(F.lower("path").rlike(r"\.(?:png|jpe?g|gif|bmp)$"))
    return own.select("path", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"), facts("path", "content").alias("f")).select("path", "bytes", "sha256", "f.*")


def compare(original: DataFrame, localized: DataFrame, allow_missing: bool = False) -> DataFrame:
    """``(severity, id, path, message)`` of all differences, in path order and a fixed order of checks.

    Paths pair without regard to case; of several that differ only in case the last holds. Geometry,
    format, a lost alpha channel, frames and equal bytes are compared; bit depth isn't.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.lower("path").alias("key")).agg(F.max_by(F.struct(*df.columns), "path").alias(name))

    both = side(original, "o").join(side(localized, "l"), "key", "full_outer")
    finding = lambda cond, severity, code, message: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("id"), message.alias("message")))
    gone, extra = F.col("l").isNull(), F.col("o").isNull()
    bad = F.col("o.error").isNotNull() | F.col("l.error").isNotNull()
    readable = ~gone & ~extra & ~bad
    arrow = lambda a, b: F.concat(a.cast("string"), F.lit(" -> "), b.cast("string"))
    o, l = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"l.{c}"))  # noqa: E741
    size = lambda x: F.concat(x("width"), F.lit("x"), x("height"))
    checks = F.array_compact(
        F.array(
            finding(extra, "WARN", "extra-localized-asset", F.lit("no original of this image")),
            finding(gone & ~extra, "WARN" if allow_missing else "FAIL", "missing-localized-asset", F.lit("an original has no localized image")),
            finding(~gone & ~extra & bad, "FAIL", "unreadable-image", F.concat_ws("; ", F.col("o.error"), F.col("l.error"))),
            finding(readable & (o("format") != l("format")), "FAIL", "format-changed", arrow(o("format"), l("format"))),
            finding(readable & ((o("width") != l("width")) | (o("height") != l("height"))), "FAIL", "geometry-changed", arrow(size(o), size(l))),
            finding(readable & o("alpha") & ~l("alpha"), "FAIL", "alpha-lost", F.lit("the transparency is gone")),
            finding(readable & (o("frames") != l("frames")), "FAIL", "frame-count-changed", arrow(o("frames"), l("frames"))),
            finding(readable & (o("sha256") == l("sha256")), "WARN", "unchanged-asset", F.lit("equal bytes")),
        )
    )
    found = both.select("key", F.coalesce(o("path"), l("path")).alias("path"), F.posexplode(checks).alias("place", "f"))
    return found.orderBy("key", "place").select("f.severity", "f.id", "path", "f.message")


def summary(original: DataFrame, localized: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: ``status, original, localized, failures, warnings``; both counts are of files, before pairing."""
    n = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    f = findings.agg(F.count_if(F.col("severity") == "FAIL").alias("failures"), F.count_if(F.col("severity") == "WARN").alias("warnings")).withColumn("one", F.lit(1))
    return n(original, "original").join(n(localized, "localized"), "one").join(f, "one").select(F.when(F.col("failures") > 0, "FAIL").otherwise("PASS").alias("status"), "original", "localized", "failures", "warnings")
