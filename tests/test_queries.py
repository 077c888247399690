"""Every query has a well-formed registration; a sample is compared with SQL at the smallest scale."""

import re
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from barloom.plans import ORACLES, QUERIES
from tools.compare import TABLES, canonical

PATH = "/root/testdata/sf0.001"
SAMPLE = ["resample_bars", "feature_matrix_nation", "feature_matrix_hourly", "target_matrix", "split_by_ratio", "panel_split", "wf_windows",
          "roc_auc", "dq_findings", "quarantine", "round_trips", "barrier_exit", "risk_decisions", "positions_from_fills", "limit_first_touch",
          "asof_quote", "screen", "enrich_instruments", "stream_bars", "stream_limit_touch", "wf_summary", "threshold_sweep"]


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return db


def test_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not [name for name, sql in entry.oracle_sql().items() if re.search(r"\{[a-z_]+\}", sql)]


def test_queries_without_training_data(monkeypatch):
    """Whatever the training-data subpackage lacks, all other queries stay."""
    monkeypatch.setitem(sys.modules, "barloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(QUERIES) == set(entry.queries()) and set(ORACLES) == set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    mine = entry.queries()[name](spark, PATH).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = canonical(mine), canonical(theirs)
    assert len(a) == len(b) and (len(a) == 0 or (a == b).all())
