"""The driver contract, and queries against their SQL on the smallest data."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as driver
from segmill.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

CHECKED = (
    "p1_found", "p1_loaded", "p1_lines", "p3_found", "tokens_compared", "text_measures", "qa_findings", "qa_gate", "qa_inconsistent", "memory_decisions", "memory_summary", "review_judged", "review_summary",
    "audit_signals", "audit_categories", "script_extract", "slots_scan", "images_compared", "manifest_states", "tree_differences", "regenerated", "progress", "collisions",
    "qa_gate_gbk", "unencodable_chars", "review_judged_gbk", "magic_kinds", "named_pairs", "prefixed_strings", "progress_traces", "path_collisions", "slots_compared", "images_formats", "images_differences",
    "script_problems", "audit_wider", "retention", "fingerprints", "range_overlaps", "stray_differences",
)


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = driver.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(driver.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in found.fetchall())
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got == want


def test_names():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert {f"p{n}_" for n in range(1, 11)} <= {name.split("_")[0] + "_" for name in driver.queries()} or not os.path.isdir(os.path.join(os.path.dirname(registry.__file__), "..", "llm"))


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_core_stands_without_the_text_operators():
    code = "import sys; sys.modules['segmill.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p6_found' not in q; print(len(q))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) > 40
