"""Command line: one summary line on standard output; exit code 0 for a pass, 1 for a failing gate, 2 for bad input.

``python -m segmill gate|memory|review|audit|tokens|compare ...``
"""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.functions import text as T
from segmill.operators import audit, memory, qa, review
from segmill.session import session
from segmill.sources import catalog, review_csv, sinks, tree

FAILED, INVALID = 1, 2


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def _line(**facts) -> None:
    print(" ".join(f"{k}={v}" for k, v in facts.items()))


def _records(spark: SparkSession, path: str, args) -> DataFrame:
    return catalog.read_records(spark, str(Path(path).resolve(strict=True)), args.source_field, args.target_field, args.id_field)


def gate(spark: SparkSession, args) -> int:
    """Quality gate over a catalog file."""
    policy = qa.Policy(
        encoding=args.encoding, require_complete=args.require_complete, reject_japanese=args.reject_japanese, require_translated=args.require_translated, allow_added=args.allow_added,
        allow_reordered=args.allow_reordered, require_consistent=args.require_consistent, max_chars=args.max_chars, max_lines=args.max_lines, check_punctuation=args.check_punctuation,
        glossary=catalog.read_glossary(args.glossary) if args.glossary else qa.Glossary(),
    )
    outputs = [p for p in (args.report, args.markdown) if p]
    sinks.guard(outputs, [args.path], force=True)
    records = _records(spark, args.path, args)
    facts = sinks.one_row(qa.summary(records, policy))
    if outputs:
        counts = {r.code: r.n for r in qa.counters(records, policy).collect()}
        found = qa.findings(records, policy).orderBy("row_idx", "code")
        if args.report:
            sinks.write_report(facts | {"counts": counts}, args.report, force=True, streams={"findings": found})
        if args.markdown:
            shown = lambda blocking: (f"- `{r.segment_id}` **{r.code}**: {r.message}" + (f" `{r.detail}`" if r.detail else "") for r in found.where(F.col("blocking") == blocking).toLocalIterator())
            sinks.write_markdown(args.markdown, "Translation gate", facts, [("Blockers", shown(True)), ("Warnings", shown(False))], force=True)
    _line(gate=facts["gate"], records=facts["total_records"], completed=facts["completed"], pending=facts["pending"], failures=facts["failed_records"], warnings=facts["warning_records"])
    return 0 if facts["gate"] == "PASS" else FAILED


def migrate(spark: SparkSession, args) -> int:
    """Translation memory: earlier catalogs into the current one."""
    past = [str(Path(p).resolve(strict=True)) for p in args.previous]
    if len(set(past)) < len(past):
        raise ValueError("each earlier catalog may be given once")
    sinks.guard([p for p in (args.output, args.report, args.markdown, args.review_csv) if p], [args.current, *past], force=args.force)
    now = _records(spark, args.current, args)
    before = memory.history([(p, _records(spark, p, args)) for p in past])
    decided = memory.decisions(now, before, args.threshold).persist()
    digest = file_sha256(args.current)
    facts = sinks.one_row(memory.summary(decided, before.count(), args.threshold))
    sinks.write_jsonl_file(memory.merged(now, decided), args.output, raw="raw", force=args.force)
    inputs = {"current": args.current, "current_sha256": digest, "previous": [{"path": p, "sha256": file_sha256(p)} for p in past]}
    sinks.write_report(facts | {"inputs": inputs}, args.report, force=args.force, streams={"details": decided.orderBy("row_idx")})
    if args.markdown:
        open_ = decided.where(F.col("decision").isin(*memory.SHOWN)).orderBy("row_idx")
        shown = (f"- `{r.segment_id}`: {r.decision}, {r.reason or f'similarity {r.similarity} to {r.previous_segment_id}'}" for r in open_.toLocalIterator())
        sinks.write_markdown(args.markdown, "Translation memory", facts, [("To be reviewed", shown)], force=args.force)
    if args.review_csv:
        sinks.write_review_csv(memory.review_queue(decided, digest), args.review_csv, force=args.force)
    print(json.dumps({k: facts[k] for k in ("status", "reused_by_id", "reused_by_source", "suggestions", "conflicts", "pending")}))
    return 0 if facts["conflicts"] == 0 else FAILED


def import_review(spark: SparkSession, args) -> int:
    """Reviewed targets into the catalog, or with ``--dry-run`` the counts alone."""
    if bool(args.output) == args.dry_run:
        raise ValueError("either an output or a dry run")
    if args.output:
        sinks.guard([args.output], [args.current, args.review_csv])
    digest = file_sha256(args.current)
    now = _records(spark, args.current, args)
    rows = review_csv.read(spark, str(Path(args.review_csv).resolve(strict=True)))
    applied = review.apply(now, rows, digest, args.encoding)  # raises for the first row that fails
    facts = sinks.one_row(review.summary(review.judged(now, rows, digest, args.encoding), now.count(), digest, file_sha256(args.review_csv), args.dry_run))
    if args.output:
        sinks.write_jsonl_file(applied, args.output, raw="raw")
    facts.pop("failed", None)
    print(json.dumps(facts))
    return 0


def scan(spark: SparkSession, args) -> int:
    """Engine evidence of a directory tree, which isn't changed."""
    root = Path(args.root).resolve(strict=True)
    sinks.guard([p for p in (args.json, args.markdown) if p], outside=root, force=True)
    inventory, warnings = tree.inventory(spark, root, args.max_files)
    engines = audit.ENGINES + (audit.WIDER_ENGINES if args.wider else ())
    found = audit.detect(inventory, engines).collect()  # one row per engine of the rules
    facts = sinks.one_row(audit.totals(inventory))
    plan = audit.plan(audit.detect(inventory, engines))
    if args.json or args.markdown:
        first = audit.first_scripts(inventory.withColumnRenamed("size", "length"), args.max_encoding_samples)
        probed = audit.probes(tree.heads(first, root, args.sample_bytes), args.max_encoding_samples, args.sample_bytes).collect()
        if args.json:
            report = {"inventory": facts, "warnings": warnings, "engines": [r.asDict(True) for r in found], "encodings": [r.asDict(True) for r in probed], "plan": plan}
            report |= {"extensions": [r.asDict() for r in audit.top_extensions(inventory).collect()], "categories": [r.asDict() for r in audit.categories(inventory).collect()]}
            sinks.write_report(report, args.json, force=True)
        if args.markdown:
            evidence = (f"- **{r.engine}** ({r.classification}, {r.confidence:.2f}): " + ", ".join(f"`{e.path}`" for e in r.evidence) for r in found)
            sinks.write_markdown(args.markdown, "Project audit", facts | {"next step": plan["next_step"]}, [("Engines", evidence), ("Warnings", (f"- {w}" for w in warnings))], force=True)
    top = f"{found[0].engine} {found[0].classification} confidence={found[0].confidence:.2f}" if found else "unknown"
    _line(mode="read-only", files=facts["files"], engine=top, input_files_changed=0)
    _line(next=plan["next_step"])
    return 0


def _of_texts(spark: SparkSession, **texts: str) -> DataFrame:
    return spark.createDataFrame([tuple(texts.values())], ", ".join(f"{c} string" for c in texts))


def list_tokens(spark: SparkSession, args) -> int:
    """Control tokens of a text, one a line."""
    print("\n".join(_of_texts(spark, t=args.text).select(T.tokens(F.col("t"))).first()[0]))
    return 0


def compare_tokens(spark: SparkSession, args) -> int:
    """Whether two texts have the same control tokens."""
    s, t = T.tokens(F.col("s")), T.tokens(F.col("t"))
    ok = T.tokens_agree(F.col("s"), F.col("t"))
    own = _of_texts(spark, s=args.source, t=args.target).select(ok.alias("ok"), T.multiset_minus(s, t).alias("missing"), T.multiset_minus(t, s).alias("added"), T.reordered(s, t).alias("reordered")).first()
    print(json.dumps(own.asDict(), ensure_ascii=False))
    return 0 if own.ok else FAILED


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="segmill", description="Validate, migrate and audit translated text catalogs.")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable[[SparkSession, argparse.Namespace], int]) -> argparse.ArgumentParser:
        own = sub.add_parser(name, help=run.__doc__)
        own.set_defaults(run=run)
        return own

    def fields(own: argparse.ArgumentParser) -> None:
        for name, default in (("source-field", "source"), ("target-field", "target"), ("id-field", "segment_id")):
            own.add_argument(f"--{name}", default=default)

    own = command("gate", gate)
    own.add_argument("path")
    for flag in ("require-complete", "reject-japanese", "require-translated", "allow-added", "allow-reordered", "require-consistent", "check-punctuation"):
        own.add_argument(f"--{flag}", action="store_true")
    for option in ("encoding", "glossary", "report", "markdown"):
        own.add_argument(f"--{option}")
    for option in ("max-chars", "max-lines"):
        own.add_argument(f"--{option}", type=int)
    fields(own)
    own = command("memory", migrate)
    own.add_argument("--current", required=True)
    own.add_argument("--previous", required=True, action="append")
    own.add_argument("--output", required=True)
    own.add_argument("--report", required=True)
    own.add_argument("--markdown")
    own.add_argument("--review-csv")
    own.add_argument("--threshold", type=float, default=memory.THRESHOLD)
    own.add_argument("--force", action="store_true")
    fields(own)
    own = command("review", import_review)
    own.add_argument("--current", required=True)
    own.add_argument("--review-csv", required=True)
    own.add_argument("--output")
    own.add_argument("--encoding")
    own.add_argument("--dry-run", action="store_true")
    fields(own)
    own = command("audit", scan)
    own.add_argument("root")
    own.add_argument("--json")
    own.add_argument("--markdown")
    own.add_argument("--wider", action="store_true", help="take the wider matrix of engines too")
    for option, default in (("max-files", tree.MOST_FILES), ("max-encoding-samples", 20), ("sample-bytes", 65_536)):
        own.add_argument(f"--{option}", type=int, default=default)
    own = command("tokens", list_tokens)
    own.add_argument("--text", required=True)
    own = command("compare", compare_tokens)
    own.add_argument("--source", required=True)
    own.add_argument("--target", required=True)
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as error:  # usage
        return int(error.code or 0)
    try:
        return args.run(spark or SparkSession.getActiveSession() or session("segmill"), args)
    except (ValueError, OSError, LookupError, PySparkException) as error:
        print(f"ERROR: {str(error).splitlines()[0]}", file=sys.stderr)
        return INVALID
