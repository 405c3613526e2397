"""Registered queries do the whole job, not a slice of it."""

import inspect
import os

import pytest

from spanwise import catalog
from spanwise.operators import uncertainty as un

TABLES = os.environ.get("SPANWISE_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def test_sweeps_cover_their_grids(spark):
    cells = catalog.QUERIES["bm25_param_sweep"](spark, TABLES).groupBy("k1", "b").agg({"rank": "max"}).collect()
    assert len(cells) == 30 and {r["max(rank)"] for r in cells} == {10}
    stems = catalog.QUERIES["stem_sweep_full"](spark, TABLES).groupBy("stem").agg({"rank": "max"}).collect()
    assert {r["stem"] for r in stems} == {0, 3, 4, 5, 6, 7, 8} and {r["max(rank)"] for r in stems} == {10}


def test_intervals_have_all_resamples(spark):
    scores = catalog._ndcg(spark, TABLES).cache()
    want = {r["run"]: r for r in un.bootstrap_ci(scores, ["run"], "value", ["question"], 10_000).collect()}
    assert {r["run"]: r for r in catalog.QUERIES["bootstrap_ci"](spark, TABLES).collect()} == want
    best = {r["run"]: (r["low"], r["high"]) for r in un.recommend(scores, catalog.runs(spark, TABLES).selectExpr("run_id as run", "latency_ms_p95 as p95", "cast(null as double) as index_seconds"), resamples=10_000).collect()}
    assert {r["run"]: (r["low"], r["high"]) for r in catalog.QUERIES["recommend"](spark, TABLES).collect()} == best
    assert inspect.signature(un.bootstrap_sql).parameters["resamples"].default == 10_000
