"""Near-duplicate records with small edits: circulant MinHash, banding, exact verification."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import shingles
from segmill.operators import skew
from segmill.session import checkpointed

#: Weighted bands: 26 of 3 rows find a pair of weighted Jaccard 0.5 with 97 %, 0.6 with 99.8 %, and meet one of 0.05 with 0.3 %.
BANDS, ROWS = 26, 3
#: Bands on unweighted signatures, for families so large that their own wording counts as common: 36 of 6 rows find a pair
#: of Dice 0.80 with 96 %, 0.85 with 99.8 %.
PLAIN_BANDS, PLAIN_ROWS = 36, 6
#: Greatest ratio of two elements' weights.
RATIO = 32.0
#: Buckets of more than ``HOT`` members are worked in blocks of ``BLOCK``, block against block, in tasks of their own:
#: a text then moves once a block instead of once a pair.
HOT, BLOCK = 32, 256

_ENTRY = np.dtype([("key", "<u8"), ("id", "<i8")])


def distinct_texts(rows: DataFrame, least: int) -> DataFrame:
    """``(text, rep, n)``: every distinct text of ``least`` characters or more with its least row id and its rows.

    Counted map-side, so exact copies, however many, are one row per task.
    """
    return rows.where(F.length("text") >= least).groupBy("text").agg(F.min("id").alias("rep"), F.count("*").alias("n"))


def element_weights(texts: DataFrame) -> np.ndarray:
    """Weight of every slot of the element universe: squared log of its inverse document frequency.

    Counted over all texts, in tables of fixed size (2**20 slots), which tasks send in pieces that have
    counts; the sums are made by piece on the executors. What reaches the driver is one table of 4 MB
    whatever the input. Common wording thus decides few coordinates, and texts that share nothing else
    hardly meet; nothing is left out of the similarity itself.
    """
    universe, piece = 1 << shingles.UNIVERSE_BITS, 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(universe, np.int64), 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            if own:
                hashes, _ = shingles.bigram_elements(own)
                total += np.bincount(shingles.element_slots(hashes), minlength=universe)
                docs += len(own)
        if docs:
            pieces = [(k, total[k * piece : (k + 1) * piece]) for k in range(universe // piece)]
            kept = [(k, zlib.compress(v.tobytes(), 1)) for k, v in pieces if v.any()] + [(-1, zlib.compress(np.array([docs]).tobytes(), 1))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int32()), pa.array([v for _, v in kept], pa.binary())], names=["k", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(v), np.int64)
                sums[k] = sums[k] + counts if k in sums else counts
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], names=["k", "counts"])

    shape = "k int, counts binary"
    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    frequency, docs = np.zeros(universe), 1
    for row in texts.select("text").mapInArrow(count, shape).repartition(parts, "k").mapInArrow(add, shape).toLocalIterator():
        counts = np.frombuffer(zlib.decompress(row.counts), np.int64)
        if row.k < 0:
            docs = int(counts[0])
        else:
            frequency[row.k * piece : (row.k + 1) * piece] = counts
    weight = np.log((docs + 1) / (frequency + 0.5)) ** 2
    return np.maximum(weight, weight.max() / RATIO).astype(np.float32)


def _entries(partitions: int, bands: int, rows: int, weights):
    """Band entries of a batch of texts, packed by target partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, reps = batch.column(0).to_pylist(), np.asarray(batch.column(1), dtype=np.int64)
            if not texts:
                continue
            hashes, offsets = shingles.bigram_elements(texts)
            keys = shingles.band_keys(shingles.signatures(hashes, offsets, bands * rows, weights.value), bands, rows)
            plain = shingles.band_keys(shingles.signatures(hashes, offsets, PLAIN_BANDS * PLAIN_ROWS), PLAIN_BANDS, PLAIN_ROWS)
            keys = np.concatenate((keys, ~plain), axis=1).ravel()
            ids = np.repeat(reps, bands + PLAIN_BANDS)
            part = (keys % np.uint64(partitions)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(partitions + 1))
            targets, blobs_k, blobs_i = [], [], []
            for p in range(partitions):
                own = order[cuts[p] : cuts[p + 1]]
                if len(own):
                    targets.append(p)
                    # keys lose two bytes: a false meeting costs one verification; ids go byte plane by byte plane, which packs well
                    blobs_k.append(np.ascontiguousarray(keys[own].view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes())
                    blobs_i.append(np.ascontiguousarray(ids[own].view(np.uint8).reshape(-1, 8).T).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(targets, pa.int32()), pa.array(blobs_k, pa.binary()), pa.array(blobs_i, pa.binary())], names=["part", "keys", "ids"]
            )

    return pack


def _unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    keys, ids = [], []
    for batch in batches:
        for k, i in zip(batch.column("keys"), batch.column("ids"), strict=True):
            raw = np.frombuffer(k.as_py(), np.uint8).reshape(-1, 6)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, 2:] = raw
            keys.append(wide.view(np.uint64).ravel())
            ids.append(np.ascontiguousarray(np.frombuffer(i.as_py(), np.uint8).reshape(8, -1).T).view(np.int64).ravel())
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(ids)


def _pairs_of_runs(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside every run (runs of equal size are expanded together)."""
    left, right = [], []
    for n in np.unique(sizes):
        a, b = np.triu_indices(int(n), 1)
        at = starts[sizes == n][:, None]
        left.append(ids[at + a].ravel())
        right.append(ids[at + b].ravel())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def _candidates(block: int):
    """Pairs that share a band key; members of large buckets come out once, in numbered pieces, instead."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("piece", pa.int64()), ("members", pa.list_(pa.int64()))])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = _unpacked(batches)
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        limit = min(HOT, block)
        small = (sizes > 1) & (sizes <= limit)
        a, b = _pairs_of_runs(ids, starts[small], sizes[small])
        if len(a):
            both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
            for i in range(0, len(both), 100_000):
                part = both[i : i + 100_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[:, 0]), pa.array(part[:, 1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, schema.field("members").type)], schema=schema
                )
        for s, n in zip(starts[sizes > limit], sizes[sizes > limit], strict=True):
            for no, i in enumerate(range(0, n, block)):
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([int(keys[s] >> np.uint64(1))], pa.int64()), pa.array([no], pa.int64()), pa.array([ids[s + i : s + min(i + block, n)].tolist()], schema.field("members").type)],
                    schema=schema,
                )

    return meet


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            if not left:
                continue
            shared = shingles.shared_counts(left, right)
            total = np.fromiter((len(x) + len(y) - 2 for x, y in zip(left, right, strict=True)), np.int64, len(left))
            holds = 2 * shared >= threshold * total - 1e-9
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(holds)), batch.column("b").filter(pa.array(holds)), pa.array((2 * shared / total)[holds])], names=["a", "b", "similarity"]
            )

    return verify


def _verify_blocks(threshold: float):
    """Pairs of a block against another (or itself): an exact bound on bit sketches first, then the texts."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, left, right in zip(batch.column("same").to_pylist(), batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                la, lb = [m["text"] for m in left], [m["text"] for m in right]
                sa, na = shingles.bit_sketches(la)
                sb, nb = shingles.bit_sketches(lb)
                # elements of one side whose bit the other side lacks can't be shared
                most = np.minimum(
                    na[:, None] - np.bitwise_count(sa[:, None, :] & ~sb[None, :, :]).sum(2, dtype=np.int64),
                    nb[None, :] - np.bitwise_count(~sa[:, None, :] & sb[None, :, :]).sum(2, dtype=np.int64),
                )
                open_ = 2 * most >= threshold * (na[:, None] + nb[None, :]) - 1e-9
                if same:
                    open_ &= np.triu(np.ones(open_.shape, bool), 1)
                i, j = np.nonzero(open_)
                if not len(i):
                    continue
                shared = shingles.shared_counts([la[k] for k in i], [lb[k] for k in j])
                total = na[i] + nb[j]
                ids, jds = np.array([m["id"] for m in left])[i], np.array([m["id"] for m in right])[j]
                holds = 2 * shared >= threshold * total - 1e-9
                a, b = np.minimum(ids, jds)[holds], np.maximum(ids, jds)[holds]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array((2 * shared / total)[holds])], names=["a", "b", "similarity"])

    return verify


def similar_texts(texts: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """``(a, b, similarity)``, a < b: pairs of distinct texts (by ``rep``) with Dice ``threshold`` or more.

    Takes :func:`distinct_texts`. Signatures are made in NumPy; band entries move packed (6 bytes of key,
    a packed id), one shuffle for all bands. A bucket with many members, be it a third of all texts, is
    written once in pieces, and piece against piece is a row of its own, so no task holds its pairs or lists its blocks. Every
    candidate is verified on the whole texts; no bucket is capped or dropped.
    """
    spark = texts.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    weights = spark.sparkContext.broadcast(element_weights(texts))  # 4 MB, whatever the input
    packed = texts.select("text", "rep").mapInArrow(_entries(parts, bands, rows, weights), "part int, keys binary, ids binary")
    met = packed.repartition(parts, "part").mapInArrow(_candidates(block), "a long, b long, bucket long, piece long, members array<long>")
    met = checkpointed(met)  # read twice below; small: candidates only
    direct = met.where("a IS NOT NULL").select("a", "b")
    named = direct.distinct().join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
    shape = "a long, b long, similarity double"
    found = named.select("a", "b", "ta", "tb").mapInArrow(_verify(threshold), shape)
    once = lambda df: df.groupBy("a", "b").agg(F.first("similarity").alias("similarity"))
    if met.where("a IS NULL").isEmpty():
        return once(found)
    # large buckets: a piece's texts are gathered once; which pieces meet is worked out from their numbers, and
    # each meeting is a row of its own, so that one bucket's are many tasks
    hot = met.where("a IS NULL").select("bucket", "piece", F.explode("members").alias("id"))
    pieces = hot.join(texts.select(F.col("rep").alias("id"), "text"), "id").groupBy("bucket", "piece").agg(F.collect_list(F.struct("id", "text")).alias("members"))
    pieces = checkpointed(pieces)
    last = pieces.groupBy("bucket").agg(F.max("piece").alias("last"))
    left = pieces.join(last, "bucket").select("bucket", F.col("piece").alias("first"), F.explode(F.sequence("piece", "last")).alias("piece"), F.col("members").alias("left"))
    meetings = left.join(pieces.withColumnRenamed("members", "right"), ["bucket", "piece"]).select((F.col("first") == F.col("piece")).alias("same"), "left", "right")
    blocks = meetings.mapInArrow(_verify_blocks(threshold), shape)
    return once(found.unionByName(blocks))


def similar_records(rows: DataFrame, threshold: float = 0.8, least: int = 24) -> DataFrame:
    """``(id_a, id_b)``, smaller first: all pairs of rows whose texts differ and reach the threshold.

    ``rows`` is ``(id, text)``. Texts shorter than ``least`` (two at least) and NULLs take no part; equal
    texts are never paired with each other, but each of their rows is paired with the rows of similar
    texts. Empty input gives no pair.
    """
    texts = checkpointed(distinct_texts(rows, max(2, least)))  # read by every step below
    pairs = similar_texts(texts, threshold)
    kept = checkpointed(pairs.select("a", "b"))
    heavy = skew.heavy_keys(texts, ["text"])
    members = members_of(rows, texts, kept, least, heavy).withColumnRenamed("rep", "key")
    met = skew.row_pairs(kept, members, heavy and skew.heavy_keys(texts.select(F.col("rep").alias("key"), "n"), ["key"]))
    return met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def members_of(rows: DataFrame, texts: DataFrame, pairs: DataFrame, least: int, heavy: DataFrame | None) -> DataFrame:
    """``(rep, id)`` of the rows whose text is in a pair; ``heavy`` are the texts of very many rows."""
    linked = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    own = texts.join(linked, "rep").select("rep", "text")
    return skew.split_join(rows.where(F.length("text") >= max(2, least)).select("id", "text"), own, ["text"], heavy, "id").select("rep", "id")


def groups(rows: DataFrame, threshold: float = 0.8, least: int = 24) -> DataFrame:
    """``(id, class_id, links)``: every row with the least id of its similarity class.

    Classes are connected components over distinct texts, found by alternating large-star and small-star
    steps until nothing changes; the links never leave the executors. Rows without a partner, short texts
    and NULLs are classes of their own. ``links`` counts the similar distinct texts.
    """
    texts = checkpointed(distinct_texts(rows, max(2, least)))
    edges = checkpointed(similar_texts(texts, threshold).select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = edges.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    label = components(edges)
    by_text = texts.join(label, "rep", "left").join(degree, "rep", "left").select("text", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    long = F.coalesce(F.length("text") >= max(2, least), F.lit(False))
    classed = skew.split_join(rows.where(long).select("id", "text"), by_text, ["text"], skew.heavy_keys(texts, ["text"]), "id").select("id", "class_id", "links")
    return classed.unionByName(rows.where(~long).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links")))


#: Rounds of the star contraction after which classes that still change are an error; they end after the square of the logarithm of the nodes.
ROUNDS = 1000


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(rep, class_id)`` of the nodes of ``(u, v)``: star contraction with a checkpoint each round, until nothing changes.

    Raises where ``rounds`` don't suffice; no unfinished classes come out.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    current = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    before = None
    for _ in range(rounds):
        sym = both(current)
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        current = checkpointed(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"classes still change after {rounds} rounds")
    return current.groupBy("u").agg(F.min("v").alias("class_id")).select(F.col("u").alias("rep"), "class_id").unionByName(current.select(F.col("v").alias("rep"), F.col("v").alias("class_id")).distinct())
