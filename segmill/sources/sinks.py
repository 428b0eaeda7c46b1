"""Writers: JSON Lines, reports, review tables and rebuilt files, none of which overwrites unasked."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.operators.delimited import REVIEW_COLUMNS


def guard(outputs: Iterable[str | Path], inputs: Iterable[str | Path] = (), outside: str | Path | None = None, force: bool = False) -> list[Path]:
    """Resolved output paths; raises if two are equal, one is an input, exists, or lies inside a scanned tree."""
    out, taken = [Path(p).resolve() for p in outputs], {Path(p).resolve() for p in inputs}
    if len(set(out)) < len(out):
        raise ValueError("outputs must differ")
    for path in out:
        if path in taken:
            raise ValueError(f"output is an input: {path}")
        if outside is not None and (path == Path(outside).resolve() or Path(outside).resolve() in path.parents):
            raise ValueError(f"output lies inside the scanned tree: {path}")
        if path.exists() and not force:
            raise FileExistsError(f"output exists: {path}")
    return out


def write_jsonl(df: DataFrame, path: str, order: str = "row_idx", force: bool = False) -> None:
    """Objects one a line, keys sorted, as a folder of ordered part files; position decides the order.

    Distributed: parts are ranges of positions, so their concatenation is the ordered file.
    """
    names = sorted(c for c in df.columns if c != order)
    rows = df.repartitionByRange(order).sortWithinPartitions(order).select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.mode("overwrite" if force else "errorifexists").text(path)


def write_jsonl_file(df: DataFrame, path: str | Path, order: str = "row_idx", raw: str | None = None, force: bool = False) -> int:
    """The same as one file, streamed through the driver row by row; ``raw`` names a column of JSON texts
    whose target is replaced, so that unknown keys survive. Returns the number of records."""
    (out,) = guard([path], force=force)
    out.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with out.open("w", encoding="utf-8", newline="\n") as file:
        for row in df.orderBy(order).toLocalIterator(prefetchPartitions=True):
            value = row.asDict(recursive=True)
            if raw:
                value = json.loads(value[raw]) | {"target": value["target"]}
            else:
                value.pop(order, None)
            file.write(json.dumps(value, ensure_ascii=False, sort_keys=True) + "\n")
            n += 1
    return n


def write_report(value: dict, path: str | Path, force: bool = False, streams: dict[str, DataFrame] | None = None) -> None:
    """A JSON report; ``streams`` are tables written as lists of objects under their names, row by row, never held as a whole."""
    (out,) = guard([path], force=force)
    out.parent.mkdir(parents=True, exist_ok=True)
    dump = lambda v, **o: json.dumps(v, ensure_ascii=False, sort_keys=True, default=str, **o)
    with out.open("w", encoding="utf-8", newline="\n") as file:
        body = dump(value, indent=2)
        file.write(body[:-1].rstrip() if streams else body)
        for k, (name, rows) in enumerate((streams or {}).items()):
            file.write(("," if value or k else "") + f"\n  {dump(name)}: [")
            for n, row in enumerate(rows.toLocalIterator(prefetchPartitions=True)):
                file.write(("," if n else "") + "\n    " + dump(row.asDict(recursive=True)))
            file.write("\n  ]")
        file.write("\n}\n" if streams else "\n")


def one_row(df: DataFrame) -> dict:
    """A one-row summary as a report value."""
    return df.first().asDict(recursive=True)


def write_review_csv(queue: DataFrame, path: str | Path, force: bool = False) -> int:
    """The review table: UTF-8 with a byte order mark, twelve columns, streamed; returns the number of rows."""
    (out,) = guard([path], force=force)
    out.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with out.open("w", encoding="utf-8-sig", newline="") as file:
        writer = csv.writer(file)
        writer.writerow(REVIEW_COLUMNS)
        for row in queue.select(*REVIEW_COLUMNS).toLocalIterator(prefetchPartitions=True):
            writer.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def write_files(rebuilt: DataFrame, root: str | Path, source_root: str | Path) -> list[str]:
    """Rebuilt files ``(path, content)`` below a root outside the source tree, written by the driver in path order."""
    base = Path(root).resolve()
    if base == Path(source_root).resolve() or Path(source_root).resolve() in base.parents:
        raise ValueError("the output must lie outside the source tree")
    written = []
    for row in rebuilt.orderBy("path").toLocalIterator():
        place = (base / row.path).resolve()
        if base not in place.parents:
            raise ValueError(f"path leaves the output: {row.path}")
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(bytes(row.content))
        written.append(row.path)
    return written


def markdown(title: str, facts: dict, findings: Iterable[tuple[str, str]] = ()) -> str:
    """A short report: facts as a list, findings below."""
    lines = [f"# {title}", "", *(f"- {k.replace('_', ' ')}: **{v}**" for k, v in facts.items()), ""]
    shown = [f"- `{name}`: {text}" for name, text in findings]
    return "\n".join([*lines, *(["## Findings", "", *shown, ""] if shown else [])])


def write_markdown(path: str | Path, title: str, facts: dict, sections: Iterable[tuple[str, Iterable[str]]], force: bool = False) -> None:
    """A report of facts and sections, written line by line; sections without a line are left out."""
    (out,) = guard([path], force=force)
    out.parent.mkdir(parents=True, exist_ok=True)
    with out.open("w", encoding="utf-8", newline="\n") as file:
        file.write(markdown(title, facts))
        for heading, own in sections:
            for k, line in enumerate(own):
                file.write(f"\n## {heading}\n\n{line}\n" if not k else f"{line}\n")
