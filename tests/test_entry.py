"""The driver's entry points, and results against SQL on the small data."""

import math
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent
CHECKED = ["p2_found", "p2_phrase_pairs", "p2_lm_entries", "p6_sources", "p7_found", "encode_sentences", "ngram_counts_n2", "rel_children", "xcount", "align_em_r3", "extract_phrases"]


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))
    assert {"p2_found", "p6_found", "p7_found"} <= set(queries)


def test_core_stands_alone():
    """Nothing outside the text subpackage needs it."""
    outside = [p for p in [*ROOT.glob("weftgram/**/*.py"), *ROOT.glob("tests/*.py")] if "llm" not in p.parts]
    mark = "weftgram." + "llm"
    assert not [p for p in outside if mark in p.read_text(encoding="utf-8")]
    code = "import sys; sys.modules['weftgram.' + 'llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert out.returncode == 0 and int(out.stdout.split()[0]) > 50, out.stderr


def test_entry(spark, data):
    from weftgram.plans import registry

    df = registry.entry(spark, data)
    assert df.columns[:3] == ["n", "text", "cnt"] and not df.isEmpty()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 8) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    theirs = con.execute(entry.oracle_sql()[name]).df()
    ours = entry.queries()[name](spark, data).toPandas()
    assert sorted(ours.columns) == sorted(theirs.columns)
    counted = lambda df: Counter(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert counted(ours) == counted(theirs)
