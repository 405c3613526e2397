"""Published intervals and the published recommendation, from per-query files in the folder named by SPANWISE_GOLDEN."""

import os

import pytest
from pyspark.sql import functions as F

from spanwise.operators import metrics as me
from spanwise.operators import uncertainty as un
from spanwise.sources import corpus as src

FOLDER = os.environ.get("SPANWISE_GOLDEN", "")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no published per-query files")

# Mean nDCG@10, its interval, p95 in ms.
PUBLISHED = {
    "hierarchical+hybrid_rrf": (0.6133, 0.508, 0.716, 36.8),
    "sentence+hybrid_rrf": (0.5575, 0.453, 0.662, 26.8),
    "fixed+hybrid_rrf": (0.5166, 0.404, 0.629, 31.1),
    "sentence+bm25_stem5": (0.5095, 0.403, 0.621, 4.4),
    "hierarchical+dense": (0.5006, 0.396, 0.606, 30.0),
    "hierarchical+bm25_stem5": (0.4944, 0.386, 0.605, 7.5),
    "fixed+bm25_stem5": (0.4763, 0.371, 0.585, 4.2),
    "sentence+dense": (0.4615, 0.356, 0.567, 20.5),
    "fixed+dense": (0.4462, 0.341, 0.555, 24.8),
    "sentence+bm25_nostem": (0.4105, 0.308, 0.515, 3.6),
    "fixed+bm25_nostem": (0.3866, 0.290, 0.487, 3.5),
    "hierarchical+bm25_nostem": (0.3833, 0.285, 0.482, 5.8),
}


def test_intervals_and_recommendation(spark):
    r = src.read_result_files(spark, os.path.join(FOLDER, "perquery_*.json"))
    r = r.withColumns({"run": F.concat_ws("+", "chunking", "retriever"), "value": me.metric("ndcg@10", F.col("relevance"), F.col("total_relevant")), "pos": F.monotonically_increasing_id()})
    r = r.where(F.col("run").isin(*PUBLISHED) & (F.col("total_relevant") > 0)).cache()
    got = {x["run"]: x for x in un.bootstrap_ci(r, ["run"], "value", ["pos"]).collect()}
    for run, (mean, low, high, _) in PUBLISHED.items():
        assert round(got[run]["mean"], 4) == mean
        assert (round(got[run]["low"], 3), round(got[run]["high"], 3)) == (low, high)
    costs = spark.createDataFrame([(k, v[3], None) for k, v in PUBLISHED.items()], "run string, p95 double, index_seconds double")
    best = un.recommend(r.select("run", "question", "value"), costs).collect()
    assert {x["run"] for x in best if x["tied"]} == {"hierarchical+hybrid_rrf", "sentence+hybrid_rrf", "fixed+hybrid_rrf"}
    assert [x["run"] for x in best if x["recommended"]] == ["sentence+hybrid_rrf"]
