"""Hash manifests of replaced and added files: build, verify, preflight; apply and roll back on the driver."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.functions import paths

VERSION = 1


def hashed(files: DataFrame) -> DataFrame:
    """``(rel, sha256, size)`` of ``(path, content)``."""
    return files.select(F.col("path").alias("rel"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"))


def build(payload: DataFrame, tree: DataFrame) -> DataFrame:
    """Manifest entries of a payload against a tree, both :func:`hashed`.

    Columns: ``rel, action, original_sha256, original_size, new_sha256, new_size``. Files that the tree
    has are replaced, others added, with NULL originals. Unsafe paths fail the query.
    """
    guarded = payload.withColumn("rel", F.when(paths.is_safe(F.col("rel"), allow_colon=False), F.col("rel")).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), "rel"))))
    old = tree.select("rel", F.col("sha256").alias("original_sha256"), F.col("size").alias("original_size"))
    joined = guarded.join(old, "rel", "left")
    return joined.select("rel", F.when(F.col("original_sha256").isNull(), "add").otherwise("replace").alias("action"), "original_sha256", "original_size", F.col("sha256").alias("new_sha256"), F.col("size").alias("new_size"))


def _against(entries: DataFrame, tree: DataFrame) -> DataFrame:
    return entries.join(tree.select("rel", F.col("sha256").alias("__now")), "rel", "left")


def states(entries: DataFrame, tree: DataFrame) -> DataFrame:
    """``(rel, state)``: ``applied`` before ``clean`` before ``drift``."""
    now, replaces = F.col("__now"), F.col("action") == "replace"
    clean: Column = (replaces & (now == F.col("original_sha256"))) | (~replaces & now.isNull())
    state = F.when(now == F.col("new_sha256"), "applied").when(clean, "clean").otherwise("drift")
    return _against(entries, tree).select("rel", state.alias("state"))


def overall(found: DataFrame) -> DataFrame:
    """One row: ``overall, applied, clean, drift``. No entry at all counts as applied."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    counts = found.agg(n("applied"), n("clean"), n("drift"))
    total = F.col("applied") + F.col("clean") + F.col("drift")
    name = F.when(F.col("applied") == total, "APPLIED").when(F.col("clean") == total, "CLEAN").otherwise("MIXED/DRIFT")
    return counts.select(name.alias("overall"), "applied", "clean", "drift")


def preflight(entries: DataFrame, tree: DataFrame, force_add: bool = False) -> DataFrame:
    """``(rel, problem)`` of all entries that can't be applied to the tree as it is."""
    now, replaces = F.col("__now"), F.col("action") == "replace"
    problem = F.when(replaces & now.isNull(), "missing original").when(replaces & (now != F.col("original_sha256")), "baseline mismatch")
    if not force_add:
        problem = problem.when(~replaces & now.isNotNull(), "target of an addition exists")
    return _against(entries, tree).select("rel", problem.alias("problem")).where("problem IS NOT NULL")


# What follows writes files. It runs on the driver, one file after the other: a transaction, not a query.


def _sha256(path: Path) -> str | None:
    import hashlib

    if not path.is_file():
        return None
    digest = hashlib.sha256()
    with path.open("rb") as file:
        while block := file.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def _inside(root: Path, rel: str) -> Path:
    if not rel or ":" in rel or Path(rel).is_absolute() or ".." in Path(rel).parts:
        raise ValueError(f"unsafe path: {rel}")
    return root / rel


def apply_package(package: Path, tree_root: Path, force_add: bool = False) -> dict:
    """Apply ``manifest.json`` and ``files/`` of a package to a tree, all or nothing.

    Every entry is checked before the first write; replaced files are backed up and every written file is
    verified; if a step fails, what was done is undone.
    """
    entries = json.loads((package / "manifest.json").read_text("utf-8"))["entries"]
    open_ = []
    for e in entries:
        now = _sha256(_inside(tree_root, e["rel"]))
        if e["action"] == "replace" and now != e["original_sha256"]:
            open_.append((e["rel"], "missing original" if now is None else "baseline mismatch"))
        elif e["action"] == "add" and now is not None and not force_add:
            open_.append((e["rel"], "target of an addition exists"))
    if open_:
        return {"status": "ABORTED", "problems": open_}
    journal: list[dict] = []
    try:
        for e in entries:
            place, saved = _inside(tree_root, e["rel"]), _inside(package / "backup", e["rel"])
            if e["action"] == "replace":
                saved.parent.mkdir(parents=True, exist_ok=True)
                shutil.copy2(place, saved)
            journal.append({k: e.get(k) for k in ("rel", "action", "original_sha256", "new_sha256")})
            place.parent.mkdir(parents=True, exist_ok=True)
            shutil.copy2(_inside(package / "files", e["rel"]), place)
            if _sha256(place) != e["new_sha256"]:
                raise OSError(f"written file differs: {e['rel']}")
    except OSError as error:
        undo(package, tree_root, journal, careful=False)
        return {"status": "FAILED", "problems": [(journal[-1]["rel"] if journal else "", str(error))]}
    (package / "rollback.json").write_text(json.dumps({"entries": journal}, indent=2), "utf-8")
    return {"status": "APPLIED", "files": len(journal)}


def undo(package: Path, tree_root: Path, journal: list[dict], careful: bool = True) -> list[tuple[str, str]]:
    """Undo journal entries, the last first; what isn't as it was written is kept and named (unless not ``careful``)."""
    kept = []
    for e in reversed(journal):
        place, saved = _inside(tree_root, e["rel"]), _inside(package / "backup", e["rel"])
        if e["action"] == "replace":
            if not saved.is_file():
                kept.append((e["rel"], "no backup"))
                continue
            shutil.copy2(saved, place)
            if _sha256(place) != e["original_sha256"]:
                kept.append((e["rel"], "restored file differs"))
        elif place.is_file():
            if careful and _sha256(place) != e["new_sha256"]:
                kept.append((e["rel"], "changed since it was added"))
            else:
                place.unlink()
    return kept


def roll_back(package: Path, tree_root: Path) -> dict:
    """Undo an applied package."""
    log = package / "rollback.json"
    if not log.is_file():
        return {"status": "NO_ROLLBACK", "problems": []}
    kept = undo(package, tree_root, json.loads(log.read_text("utf-8"))["entries"])
    return {"status": "PARTIAL" if kept else "ROLLED_BACK", "problems": kept}
