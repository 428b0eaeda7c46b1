"""Catalog readers: JSON Lines, JSON documents, glossaries, manifests; positions and unknown keys survive."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.functions import text as X
from segmill.operators.qa import Glossary
from segmill.session import checkpointed, small_table
from segmill.sources import lines

#: Keys of a JSON object that may hold its records, in order of preference (fixed value).
RECORD_KEYS = ("records", "items", "data", "translations")


def dense(df: DataFrame, order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """The rows numbered from 0 without gaps in the given order, without sorting them into one partition.

    Rows are ranged over tasks and written once with their task and place: range bounds are sampled, so another
    evaluation could place rows otherwise. Counts and numbers both come from what was written; each task's
    numbers start where the ones before end, and the counts per task are the only thing collected. Empty
    tables give empty ones.
    """
    place = F.monotonically_increasing_id()
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__at": place.bitwiseAND((1 << 33) - 1)}))
    counts = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(part, 0)
    offset = F.get(F.lit(starts or [0]).cast("array<long>"), F.col("__part"))
    return ranged.withColumn(name, offset + F.col("__at")).drop("__part", "__at")


def _fail(condition, message):
    return F.when(condition, F.raise_error(message))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``(row_idx, line_no, raw)`` of a UTF-8 file of JSON objects, one a line.

    A byte order mark and blank lines are skipped; ``row_idx`` counts the records from 0, ``line_no`` the
    physical lines from 1; any other line that isn't an object fails the query. ``raw`` is the object's
    text, so unknown keys, their types and absent keys stay as they are. A large file is read in splits, by lines.
    """
    own = lines.numbered(spark, path, keep=lambda line: ~X.is_blank(line))
    odd = ~F.coalesce(F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull(), F.lit(False))
    raw = F.coalesce(_fail(odd, F.concat(F.lit("not a JSON object in line "), F.col("line_no"))), F.col("line"))
    return own.select("line_no", raw.alias("raw"), F.col("kept_idx").alias("row_idx"))


def read_json(spark: SparkSession, path: str, allow_map: bool = True) -> DataFrame:
    """``(row_idx, record_key, raw)`` of a JSON document.

    The root is a list, or an object with a list under the first of :data:`RECORD_KEYS` it has one under;
    ``allow_map`` also takes an object of objects, whose keys become ``record_key``. Members that aren't
    objects are left out; every other root fails. One document is one value, so a file is one task and at most 2 GB.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\ufeff", "").alias("t"))
    found = F.from_json("t", "map<string,string>", {"allowUnquotedFieldNames": "false"})
    array = F.from_json("t", "array<string>")
    is_list = F.ltrim("t").startswith("[")
    under = F.coalesce(*(F.when(F.ltrim(found[k]).startswith("["), F.from_json(found[k], "array<string>")) for k in RECORD_KEYS))
    as_list = text.select(F.when(is_list, array).otherwise(under).alias("l"), found.alias("m"), is_list.alias("is_list"))
    rows = F.transform("l", lambda x: F.struct(F.lit(None).cast("string").alias("record_key"), x.alias("raw")))
    pairs = F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].alias("record_key"), e["value"].alias("raw")))
    none = F.raise_error(F.lit("the root must be a list of records or an object that holds one"))
    every = F.forall(F.map_values("m"), lambda v: F.ltrim(v).startswith("{"))
    chosen = F.when(F.col("l").isNotNull(), rows).when(F.lit(allow_map) & F.col("m").isNotNull() & every, pairs).otherwise(none)
    each = as_list.select(F.posexplode(chosen).alias("at", "r")).where(F.ltrim("r.raw").startswith("{"))
    return dense(each.select("at", "r.record_key", "r.raw"), ["at"]).select("row_idx", "record_key", "raw")


def fields(records: DataFrame, names: Sequence[str]) -> DataFrame:
    """The records with text columns of ``raw``'s fields; values that aren't texts are NULL, as are absent ones."""
    variant = F.try_parse_json("raw")
    cols = []
    for n in names:
        is_text = F.schema_of_variant(F.try_variant_get(variant, f"$['{n}']", "variant")) == "STRING"
        cols.append(F.when(is_text, F.try_variant_get(variant, f"$['{n}']", "string")).alias(n))
    return records.select("*", *cols)


def has_field(raw, name: str):
    """Whether an object has a key, be its value null."""
    return F.array_contains(F.json_object_keys(raw), name)


def read_records(spark: SparkSession, path: str, source: str = "source", target: str = "target", segment_id: str = "segment_id", allow_map: bool = True) -> DataFrame:
    """``(row_idx, segment_id, source, target, raw)`` of a catalog file in any of the forms, by its suffix.

    Objects with the key ``pre_jp`` are in the alternate layout, record by record. Ids may be any scalar
    and come out as their text.
    """
    lines = path.lower().endswith((".jsonl", ".ndjson"))
    rows = read_jsonl(spark, path).withColumn("record_key", F.lit(None).cast("string")) if lines else read_json(spark, path, allow_map)
    names = dict.fromkeys([source, target, "pre_jp", "post_jp", "proofread_zh", "pre_zh", "post_zh"])
    own = fields(rows, [*names])
    alternate = has_field(F.col("raw"), "pre_jp")
    src = F.when(alternate, X.truthy(*(F.col(c) for c in ("pre_jp", "post_jp", source)))).otherwise(F.coalesce(F.col(source), F.lit("")))
    tgt = F.when(alternate, X.truthy(*(F.col(c) for c in ("proofread_zh", "pre_zh", "post_zh", target)))).otherwise(F.coalesce(F.col(target), F.lit("")))
    scalar = lambda n: F.get_json_object("raw", f"$.{n}")
    position = (F.col("row_idx") + 1).cast("string")
    chain = [(segment_id, None), ("index", alternate), ("key", alternate)]
    ident = F.coalesce("record_key", position)
    for name, when in reversed(chain):
        present = has_field(F.col("raw"), name) if when is None else has_field(F.col("raw"), name) & when
        ident = F.when(present, scalar(name)).otherwise(ident)
    return own.select("row_idx", ident.alias("segment_id"), src.alias("source"), tgt.alias("target"), "raw")


def read_glossary(path: str) -> Glossary:
    """A glossary file: ``terms`` with ``source`` and ``targets`` (or ``target``), and ``forbidden``."""
    with open(path, encoding="utf-8-sig") as file:
        return parse_glossary(json.load(file))


def parse_glossary(value: object) -> Glossary:
    """A glossary from its JSON value; errors name the term by its place from 1. Empty targets never hold."""
    lists = isinstance(value, dict) and all(isinstance(value.get(k, []), list) for k in ("terms", "forbidden"))
    if not lists:
        raise ValueError("a glossary is an object with lists of terms and of forbidden texts")
    terms = []
    for place, term in enumerate(value.get("terms", []), 1):
        source = term.get("source") if isinstance(term, dict) else None
        if not isinstance(source, str) or not source:
            raise ValueError(f"glossary term {place} has no source")
        own = term.get("targets", term.get("target", []))
        own = [own] if isinstance(own, str) else own
        if not isinstance(own, list) or any(not isinstance(t, str) or not t for t in own):
            raise ValueError(f"glossary term {place} has no valid targets")
        terms.append((source, tuple(own)))
    forbidden = value.get("forbidden", [])
    if any(not isinstance(t, str) or not t for t in forbidden):
        raise ValueError("forbidden texts must not be empty")
    return Glossary(tuple(terms), tuple(forbidden))


def glossary_of(rows: DataFrame) -> Glossary:
    """All terms of a table of glossaries (``terms``, ``forbidden``), a small configuration table."""
    terms: dict[tuple, None] = {}
    forbidden: dict[str, None] = {}
    for row in small_table(rows.orderBy("glossary_id"), 100_000):
        for t in row.terms or ():
            terms[t.source, tuple(t.targets or ())] = None
        forbidden.update(dict.fromkeys(row.forbidden or ()))
    return Glossary(tuple(terms), tuple(forbidden))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a manifest or rollback file."""
    shape = "entries array<struct<rel:string,action:string,original_sha256:string,original_size:long,new_sha256:string,new_size:long,backup:string>>"
    return spark.read.schema(shape).json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")


def document_body(text):
    """A document without its byte order mark and its YAML front matter."""
    return F.regexp_replace(F.regexp_replace(text, "^\\ufeff", ""), r"^---\r?\n(?s:.*?)\r?\n---[ \t]*(?:\r?\n|$)\s*", "")
