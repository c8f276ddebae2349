"""The driver's contract, and the shape of plans that matter."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from partloom.bindings import candidates
from partloom.catalogue import QUERIES
from partloom.operators.predicates import in_range


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["request_id", "nth"] and df.count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_candidates_are_an_equality_join(spark, small):
    plan = candidates(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_predicates_and_columns_reach_the_scan(spark, small):
    plan = QUERIES["a02_json_payload_scan"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,props:string>" in plan


def test_unstated_stays(spark):
    rows = spark.createDataFrame([(1, None), (2, 5.0), (3, 50.0)], "id int, v double")
    assert [r.id for r in rows.where(in_range(rows.v, 1, 10)).collect()] == [1, 2]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    root = Path(entry.__file__).parent
    shutil.copytree(root / "partloom", tmp_path / "partloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * (pipeline and (root / "corpus_pipeline.py").exists())]:
        shutil.copy(root / name, tmp_path)
    told = "import __spark_entry__ as e; assert 'top_offers' in e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", told], cwd=tmp_path, env=env, check=True, timeout=120)
