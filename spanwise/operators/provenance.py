"""Corpus fingerprints, locks, and audits of reported metrics against their evidence."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_digest
from .metrics import metric_columns

AUDITED = ("ndcg@10", "recall@5", "mrr")
LOCK_VERSION = 1


def fingerprint(docs: DataFrame) -> DataFrame:
    """A1: one row ``fingerprint``, independent of row order, of texts and ids only.

    The digest runs over all documents' lines in order, so they pass the driver one sorted partition at a time, and none
    but the present one is held. It is worked out at the call. ``fingerprint_tree`` has no such serial part.
    """
    line = F.concat(F.col("doc_id").cast("string"), F.lit(":"), text_digest(F.coalesce("text", F.lit(""))))
    digest, first = hashlib.sha256(), True
    for r in docs.select(line.alias("l")).where("l is not null").orderBy("l").toLocalIterator():
        digest.update(("" if first else "\n").encode() + r["l"].encode())
        first = False
    return docs.sparkSession.createDataFrame([("sha256:" + digest.hexdigest(),)], "fingerprint string")


def fingerprint_tree(docs: DataFrame, buckets: int = 4096) -> DataFrame:
    """A1 for any size: digests of hash buckets, then the digest of those; not the same value as ``fingerprint``."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit(":"), text_digest(F.coalesce("text", F.lit(""))))
    b = docs.select(line.alias("l")).groupBy(F.pmod(F.xxhash64("l"), F.lit(buckets)).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("d"))
    return b.agg(F.concat(F.lit("sha256t:"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256)).alias("fingerprint"))


def lock(docs: DataFrame) -> DataFrame:
    """A2: (doc_id, title, revid, sha256, chars)."""
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "title", "revid", text_digest(t).alias("sha256"), F.length(t).alias("chars"))


def drift(locked: DataFrame, docs: DataFrame) -> DataFrame:
    """A3: (kind, doc_id, title, delta): documents missing from, added to or changed against a lock."""
    a = locked.select("doc_id", F.col("title").alias("t0"), F.col("sha256").alias("h0"), F.col("chars").alias("c0"))
    b = lock(docs).select("doc_id", F.col("title").alias("t1"), F.col("sha256").alias("h1"), F.col("chars").alias("c1"))
    kind = F.when(F.col("h1").isNull(), "missing").when(F.col("h0").isNull(), "added").when(F.col("h0") != F.col("h1"), "changed")
    j = a.join(b, "doc_id", "full_outer").withColumn("kind", kind).where(F.col("kind").isNotNull())
    return j.select("kind", "doc_id", F.when(F.col("kind") == "missing", F.col("t0")).otherwise(F.col("t1")).alias("title"), F.when(F.col("kind") == "changed", F.col("c1") - F.col("c0")).alias("delta"))


def rederived(records: DataFrame, by: str = "run_id") -> DataFrame:
    """(by, queries, metric means) from per-query evidence, scorable questions only."""
    cols = metric_columns(AUDITED)
    return records.where(F.col("total_relevant") > 0).groupBy(by).agg(F.count("*").alias("queries"), *[F.avg(c).alias(n) for n, c in cols.items()])


def audit(summary: DataFrame, records: DataFrame, by: str = "run_id", reported: str = "ndcg_at_10", tolerance: float = 1e-9) -> DataFrame:
    """A4: one finding per run: reported and re-derived value and ``ok``, ``mismatch`` or ``no evidence``."""
    r = rederived(records, by).select(by, F.col("ndcg_at_10").alias("derived"))
    j = summary.select(by, F.col(reported).alias("reported")).join(r, by, "left")
    finding = F.when(F.col("derived").isNull(), "no evidence").when(F.col("reported").isNull() | (F.abs(F.col("reported") - F.col("derived")) > tolerance), "mismatch").otherwise("ok")
    return j.select(by, "reported", F.round("derived", 6).alias("derived"), finding.alias("finding"))


def mixed_fingerprints(summary: DataFrame) -> DataFrame:
    """A4/A5: (model, fingerprints) of models whose rows were measured on more than one corpus."""
    n = summary.where(F.col("corpus_fingerprint").isNotNull()).groupBy("model").agg(F.count_distinct("corpus_fingerprint").alias("fingerprints"))
    return n.where(F.col("fingerprints") > 1)


def against_lock(summary: DataFrame, locked: str) -> DataFrame:
    """A5: runs whose fingerprint is missing or another than the lock's."""
    return summary.where(F.col("corpus_fingerprint").isNull() | (F.col("corpus_fingerprint") != locked)).select("run_id", "corpus_fingerprint")


def leaderboard(summary: DataFrame, metric: str = "ndcg_at_10") -> DataFrame:
    """The best run per model (first by run_id of equal ones), placed by the metric."""
    w = Window.partitionBy("model").orderBy(F.desc_nulls_last(metric), "run_id")
    best = summary.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1)
    value = F.coalesce(F.col(metric), F.lit(0.0))
    return best.select(F.dense_rank().over(Window.orderBy(F.desc(value))).alias("place"), "model", "run_id", "chunking", "retriever", F.col(metric).alias("value"))
