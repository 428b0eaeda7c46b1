"""Quality gate: validate translated records, find inconsistent ones, count, decide.

Records are ``(row_idx, segment_id, source, target)``; NULL texts read as empty. All record rules are one
projection without a shuffle; only the comparison of records with each other groups, by source.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.functions import codecs
from segmill.functions import text as T

#: Glossaries up to this size are literals of the plan; larger ones go through a string automaton, with the same findings.
LITERAL_TERMS = 40
SHOWN_TARGETS, SHOWN_KANA = 10, 40


@dataclass(frozen=True)
class Glossary:
    """Required translations, ``(source, allowed targets)``, and texts that no target may hold.

    No source, target or forbidden text may be NULL or empty, be the glossary read from a file or a table: an empty one would be in
    every text.
    """

    terms: tuple[tuple[str, tuple[str, ...]], ...] = ()
    forbidden: tuple[str, ...] = ()

    def __post_init__(self):
        for place, (source, targets) in enumerate(self.terms, 1):
            if not source:
                raise ValueError(f"glossary term {place} has no source")
            if not all(targets):
                raise ValueError(f"glossary term {place} has no valid targets")
        if not all(self.forbidden):
            raise ValueError("forbidden texts must not be empty")


@dataclass(frozen=True)
class Policy:
    """What blocks the gate and what only warns."""

    encoding: str | None = None
    require_complete: bool = False
    reject_japanese: bool = False
    require_translated: bool = False
    allow_added: bool = False
    allow_reordered: bool = False
    require_consistent: bool = False
    max_chars: int | None = None
    max_lines: int | None = None
    check_punctuation: bool = False
    glossary: Glossary = field(default_factory=Glossary)

    def __post_init__(self):
        for name in ("max_chars", "max_lines"):
            value = getattr(self, name)
            if value is not None and value < 1:
                raise ValueError(f"{name} must be positive")


_ISSUE = "struct<code:string,blocking:boolean,message:string,detail:string>"


def _issue(code: str, blocking: bool, message: str | Column, detail: Column | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), F.lit(blocking).alias("blocking"), text.alias("message"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"))


def adapted(df: DataFrame, layout: str = "generic", source: str = "source", target: str = "target", segment_id: str = "segment_id", row_idx: str = "row_idx") -> DataFrame:
    """Records from a table in the generic or the alternate layout.

    In the alternate one the source is the first of ``pre_jp, post_jp`` and the target the first of
    ``proofread_zh, pre_zh, post_zh`` that is neither NULL nor empty, then the generic columns; the id is
    the id column, else ``index``, else ``key``. Columns that the table lacks count as NULL; a lacking id
    column falls back to the position.
    """
    have = set(df.columns)
    col = lambda name: F.col(name).cast("string") if name in have else F.lit(None).cast("string")
    if layout == "alternate":
        src, tgt = T.truthy(col("pre_jp"), col("post_jp"), col(source)), T.truthy(col("proofread_zh"), col("pre_zh"), col("post_zh"), col(target))
        own = next((n for n in (segment_id, "index", "key", "_record_key") if n in have), None)
    else:
        src, tgt = F.coalesce(col(source), F.lit("")), F.coalesce(col(target), F.lit(""))
        own = next((n for n in (segment_id, "_record_key") if n in have), None)
    return df.select(F.col(row_idx).cast("long").alias("row_idx"), (col(own) if own else F.col(row_idx).cast("string")).alias("segment_id"), src.alias("source"), tgt.alias("target"))


def _term_issues(policy: Policy) -> Column:
    """Issues of required and forbidden terms: one per record and term."""
    terms, forbidden = policy.glossary.terms, policy.glossary.forbidden
    empty = F.array().cast(f"array<{_ISSUE}>")
    if not terms and not forbidden:
        return empty
    if len(terms) + len(forbidden) > LITERAL_TERMS:
        return _automaton_issues(policy.glossary)
    parts = []
    for s, targets in terms:
        lacking = ~T.any_of(*(F.contains(F.col("target"), F.lit(t)) for t in targets)) if targets else F.lit(True)
        parts.append(F.when(F.contains(F.col("source"), F.lit(s)) & lacking, _issue("terminology-mismatch", True, f"no allowed translation of {s}", F.lit(" | ".join(targets)))))
    for t in forbidden:
        parts.append(F.when(F.contains(F.col("target"), F.lit(t)), _issue("forbidden-term", True, f"the target holds {t}")))
    return F.array_compact(F.array(*parts))


@functools.lru_cache(8)
def _automata(glossary: Glossary):
    """Automata over the sources, and over all targets and forbidden texts, of a glossary; kept per worker."""
    import ahocorasick

    def automaton(words: set[str]):
        own = ahocorasick.Automaton()
        for word in words:
            own.add_word(word, word)
        if len(own):
            own.make_automaton()
        return lambda text: {w for _, w in own.iter(text)} if len(own) and text else set()

    return automaton({s for s, _ in glossary.terms}), automaton({t for _, ts in glossary.terms for t in ts} | set(glossary.forbidden))


def _automaton_issues(glossary: Glossary) -> Column:
    """The same for larger glossaries: one Aho-Corasick pass over each text instead of one search per term."""

    @F.arrow_udf(f"array<{_ISSUE}>")
    def of(sources: pa.Array, targets: pa.Array) -> pa.Array:
        in_source, in_target = _automata(glossary)
        ends, rows = [0], []
        for s, t in zip(sources.to_pylist(), targets.to_pylist(), strict=True):
            held, given = in_source(s), in_target(t)
            if held:
                rows += [("terminology-mismatch", f"no allowed translation of {x}", " | ".join(ts)) for x, ts in glossary.terms if x in held and not given.intersection(ts)]
            if given:
                rows += [("forbidden-term", f"the target holds {x}", None) for x in glossary.forbidden if x in given]
            ends.append(len(rows))
        text = lambda k: pa.array([r[k] for r in rows], pa.string())
        issues = pa.StructArray.from_arrays([text(0), pa.array([True] * len(rows), pa.bool_()), text(1), text(2)], names=["code", "blocking", "message", "detail"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), issues)

    return of(F.col("source"), F.col("target"))


def record_issues(records: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """The records with ``issues``, every finding of the rules for single records; runs on streams too.

    A blank target has only ``empty-translation``; no other rule sees it.
    """
    src, tgt = F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("target"), F.lit(""))
    base = records.withColumns({"source": src, "target": tgt})
    base = base.withColumns({"__s": T.tokens(F.col("source")), "__t": T.tokens(F.col("target"))})
    missing, added = T.multiset_minus(F.col("__s"), F.col("__t")), T.multiset_minus(F.col("__t"), F.col("__s"))
    base = base.withColumns({"__missing": missing, "__added": added, "__bare": T.without_tokens(F.col("target"))})
    joined = lambda c: F.array_join(c, " ")
    rules = [
        F.when(F.size("__missing") > 0, _issue("control-token-missing", True, "control tokens of the source are lacking", joined(F.col("__missing")))),
    ]
    if not policy.allow_added:
        rules.append(F.when(F.size("__added") > 0, _issue("control-token-added", True, "the target has control tokens of its own", joined(F.col("__added")))))
    if not policy.allow_reordered:
        rules.append(F.when(T.reordered(F.col("__s"), F.col("__t")), _issue("control-token-reordered", True, "control tokens in another order", joined(F.col("__t")))))
    if policy.encoding:
        base = base.withColumn("__lost", codecs.unencodable(F.col("__bare"), policy.encoding))
        rules.append(F.when(F.size("__lost") > 0, _issue("encoding", True, f"not encodable as {policy.encoding}", F.to_json("__lost"))))
    same = (T.stripped(F.col("source")) != "") & (T.stripped(F.col("source")) == T.stripped(F.col("target")))
    rules.append(F.when(same, _issue("unchanged-source", policy.require_translated, "the target equals the source")))
    kana = T.kana_in(F.col("__bare"))
    rules.append(F.when(F.size(kana) > 0, _issue("residual-japanese", policy.reject_japanese, "the target holds kana", F.array_join(F.slice(kana, 1, SHOWN_KANA), ""))))
    hidden = T.zero_width_in(F.col("target"))
    rules.append(F.when(F.size(hidden) > 0, _issue("zero-width-character", True, "the target holds zero-width characters", F.array_join(F.transform(hidden, lambda c: F.concat(F.lit("U+"), F.hex(F.encode(c, "UTF-16BE")))), " "))))
    if policy.max_chars is not None:
        n = T.shown_length(F.col("__bare"))
        rules.append(F.when(n > policy.max_chars, _issue("character-budget", True, f"more than {policy.max_chars} characters", n)))
    if policy.max_lines is not None:
        n = T.line_count(F.col("target"))
        rules.append(F.when(n > policy.max_lines, _issue("line-budget", True, f"more than {policy.max_lines} lines", n)))
    found = F.array_compact(F.array(*rules))
    if policy.check_punctuation:
        found = F.concat(found, F.transform(T.unbalanced_pairs(F.col("__bare")), lambda p: _issue("punctuation-unbalanced", False, "marks of a pair differ in number", p)))
    found = F.concat(found, _term_issues(policy))
    blank = F.array(_issue("empty-translation", policy.require_complete, "no translation"))
    return base.withColumn("issues", F.when(T.is_blank(F.col("target")), blank).otherwise(found)).drop("__s", "__t", "__missing", "__added", "__lost", "__bare")


def record_findings(records: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """``(row_idx, segment_id, code, blocking, message, detail)``, one row per finding of a single record."""
    # an outer explode keeps the optimiser from pushing a size test below, which would build the issues twice
    each = record_issues(records, policy).select("row_idx", "segment_id", F.explode_outer("issues").alias("i"))
    return each.where("i IS NOT NULL").select("row_idx", "segment_id", "i.*")


def _complete(records: DataFrame) -> DataFrame:
    return records.select(T.stripped(F.col("source")).alias("key"), T.stripped(F.col("target")).alias("tgt")).where("key <> '' AND tgt <> ''")


def differing_keys(records: DataFrame) -> DataFrame:
    """``(key)``: stripped sources with two or more different stripped targets, told by the least and the greatest."""
    return _complete(records).groupBy("key").agg(F.min("tgt").alias("lo"), F.max("tgt").alias("hi")).where("lo <> hi").select("key")


def inconsistent_groups(records: DataFrame) -> DataFrame:
    """``(key, targets, targets_shown)`` of the sources of :func:`differing_keys`.

    No group is ever listed; the targets shown, the ten least, are ranked with a limit that applies before
    the shuffle.
    """
    variants = _complete(records).join(differing_keys(records), "key").distinct()
    shown = variants.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("tgt"))).where(F.col("k") <= SHOWN_TARGETS)
    counts = variants.groupBy("key").agg(F.count("*").alias("targets"))
    return counts.join(shown.groupBy("key").agg(F.sort_array(F.collect_list("tgt")).alias("targets_shown")), "key")


def inconsistent_findings(records: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """A finding of every completed record whose source has several translations."""
    groups = inconsistent_groups(records)
    members = records.where(~T.is_blank(F.col("target"))).withColumn("key", T.stripped(F.col("source")))
    detail = F.concat_ws(" ", F.sha2("key", 256), F.array_join("targets_shown", " | "))
    return members.join(groups, "key").select(
        "row_idx", "segment_id", F.lit("inconsistent-translation").alias("code"), F.lit(policy.require_consistent).alias("blocking"), F.lit("one source, several translations").alias("message"), detail.alias("detail")
    )


def findings(records: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """All findings, flat. Empty tables have none; repeated rows have theirs each."""
    return record_findings(records, policy).unionByName(inconsistent_findings(records, policy))


def counters(records: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """``(code, n)`` in code order: records for most codes, record and term, or record and pair, for those
    that can occur repeatedly, and sources for ``inconsistent-translation``.

    With ``check_punctuation`` and a completed record its counter is there even at 0.
    """
    own = record_findings(records, policy).groupBy("code").agg(F.count("*").alias("n"))
    groups = differing_keys(records).agg(F.count("*").alias("n")).where("n > 0").select(F.lit("inconsistent-translation").alias("code"), "n")
    out = own.unionByName(groups)
    if policy.check_punctuation:
        any_done = records.where(~T.is_blank(F.col("target"))).limit(1).select(F.lit("punctuation-unbalanced").alias("code"), F.lit(0).cast("long").alias("n"))
        out = out.unionByName(any_done).groupBy("code").agg(F.sum("n").alias("n"))
    return out.orderBy("code")


def summary(records: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """One row: ``gate, total_records, completed, pending, failed_records, warning_records``.

    A record with findings of one severity is one row of that severity; a finding of the comparison adds
    to the row of the same id or, once per id without one, a further row.
    """
    failing, warning = F.exists("issues", lambda i: i["blocking"]), F.exists("issues", lambda i: ~i["blocking"])
    done = ~T.is_blank(F.col("target"))
    judged = record_issues(records, policy).select("row_idx", "segment_id", F.when(done, T.stripped(F.col("source"))).alias("key"), done.alias("done"), failing.alias("failing"), warning.alias("warning"))
    member = differing_keys(records).withColumn("member", F.lit(True))
    side = "failing" if policy.require_consistent else "warning"
    # by id first: an id's further row depends on its other rows, and ids are counted where they meet
    # pending records have no key; each gets one of its own that no source has (sources are stripped), so that they don't meet in one task
    judged = judged.withColumn("key", F.coalesce("key", F.concat(F.lit(" "), F.xxhash64("row_idx", "segment_id").cast("string"))))
    per_id = judged.join(member, "key", "left").groupBy("segment_id").agg(
        F.count("*").alias("n"), F.count_if("done").alias("done"), F.count_if("failing").alias("failing"), F.count_if("warning").alias("warning"),
        (F.coalesce(F.bool_or("member"), F.lit(False)) & ~F.bool_or(side)).alias("further"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    both = per_id.agg(total("n").alias("total_records"), total("done").alias("completed"), total("failing").alias("failed"), total("warning").alias("warned"), F.count_if("further").alias("further"))
    failed = F.col("failed") + (F.col("further") if policy.require_consistent else F.lit(0))
    warned = F.col("warned") + (F.lit(0) if policy.require_consistent else F.col("further"))
    return both.select(
        F.when(failed > 0, "FAIL").otherwise("PASS").alias("gate"), "total_records", "completed", (F.col("total_records") - F.col("completed")).alias("pending"), failed.alias("failed_records"), warned.alias("warning_records")
    )
