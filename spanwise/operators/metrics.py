"""Relevance by answer span and ranked-retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..plans.lineage import cut

KS = (1, 3, 5, 10)


def relevant_chunks(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """M1: (qid, doc_id, chunk_no) of the chunks of the gold document that hold the span; an equi-join with a residual test."""
    g = gold.select("qid", "doc_id", normalise(F.col("answer_span")).alias("__s")).where(F.col("__s").isNotNull())
    c = chunks.select("doc_id", "chunk_no", normalise(F.col("body")).alias("__b"))
    return c.join(g, "doc_id").where(F.contains("__b", "__s")).select("qid", "doc_id", "chunk_no")


def total_relevant(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """M2: (qid, total_relevant) for every question, retrieved or not."""
    return _totals(relevant_chunks(chunks, gold).distinct(), gold)


def _totals(rel: DataFrame, gold: DataFrame) -> DataFrame:
    n = rel.groupBy("qid").agg(F.count("*").cast("int").alias("n"))
    return gold.select("qid").distinct().join(n, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("total_relevant"))


def per_query(hits: DataFrame, chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """M2-M3: (qid, total_relevant, relevance ARRAY<BOOLEAN> in rank order); relevance is worked out once, for both."""
    rel = cut(relevant_chunks(chunks, gold).distinct())
    marked = hits.join(rel.withColumn("rel", F.lit(True)), ["qid", "doc_id", "chunk_no"], "left").select("qid", "rank", F.coalesce("rel", F.lit(False)).alias("rel"))
    arrays = marked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "rel"))).alias("r"))  # at most k entries
    total = _totals(rel, gold)
    return total.join(arrays, "qid", "left").select("qid", "total_relevant", F.coalesce(F.transform("r", lambda x: x["rel"]), F.array().cast("array<boolean>")).alias("relevance"))


def _hits(rel: Column, k: int) -> Column:
    return F.size(F.filter(F.slice(rel, 1, k), lambda x: x)).cast("double")


def recall_at(rel: Column, total: Column, k: int) -> Column:
    """M4; 0.0 where nothing is relevant."""
    return F.when(total > 0, _hits(rel, k) / total).otherwise(F.lit(0.0)) if k > 0 else F.lit(0.0)


def precision_at(rel: Column, k: int) -> Column:
    """M5: of k places, filled or not."""
    return _hits(rel, k) / F.lit(float(k)) if k > 0 else F.lit(0.0)


def reciprocal_rank(rel: Column) -> Column:
    """M6."""
    first = F.array_position(rel, F.lit(True))
    return F.when(first > 0, F.lit(1.0) / first).otherwise(F.lit(0.0))


def _gain(i: Column) -> Column:
    return F.lit(1.0) / F.log2(i.cast("double") + F.lit(1.0))


def ndcg_at(rel: Column, total: Column, k: int) -> Column:
    """M7: against the best order of what is relevant, at most k."""
    if k <= 0:
        return F.lit(0.0)
    dcg = F.aggregate(F.transform(F.slice(rel, 1, k), lambda x, i: F.when(x, _gain(i + 1)).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(total, F.lit(k)))), _gain), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, dcg / ideal).otherwise(F.lit(0.0))


def metric(name: str, rel: Column, total: Column) -> Column:
    """M8: by name, ``ndcg@10``, ``recall@5``, ``precision@3`` or ``mrr``."""
    head, _, k = name.partition("@")
    if name == "mrr":
        return reciprocal_rank(rel)
    table = {"ndcg": lambda n: ndcg_at(rel, total, n), "recall": lambda n: recall_at(rel, total, n), "precision": lambda n: precision_at(rel, n)}
    if head not in table or not k.isdigit():
        raise ValueError(f"unknown metric {name!r}")
    return table[head](int(k))


def metric_columns(names: tuple[str, ...] | None = None) -> dict[str, Column]:
    """Columns for all metrics over KS, ``@`` written as ``_at_``."""
    names = names or ("mrr", *(f"{m}@{k}" for m in ("ndcg", "recall", "precision") for k in KS))
    return {n.replace("@", "_at_"): metric(n, F.col("relevance"), F.col("total_relevant")) for n in names}


def summarise(records: DataFrame, by: list[str], names: tuple[str, ...] | None = None) -> DataFrame:
    """Means over the scorable questions, 0.0 without any; ``queries`` counts all, ``scored`` the scorable ones."""
    cols = metric_columns(names)
    ok = F.col("total_relevant") > 0
    # the hair keeps a mean that ends in a five from being rounded by the order of its sum
    means = [F.round(F.coalesce(F.avg(F.when(ok, c)), F.lit(0.0)) + F.lit(1e-10), 6).alias(n) for n, c in cols.items()]
    return records.groupBy(*by).agg(F.count("*").alias("queries"), F.count_if(ok).alias("scored"), *means)


def _ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(__g, value, __lo, __hi, __n): each distinct value of a group with the places it takes in the group's order, from __lo to before __hi, of __n.

    No task holds a group: equal values are counted first, the counts are cut into ranges of (group, value) over all
    partitions, and only one row per group and partition is summed up across them.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(F.struct(*by).alias("__g"), value).agg(F.count("*").alias("__c"))
    v = cut(v.repartitionByRange("__g", value).withColumn("__p", F.spark_partition_id()))
    part = v.groupBy("__g", "__p").agg(F.sum("__c").alias("__s"))
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumns({"__b": F.coalesce(F.sum("__s").over(before), F.lit(0)), "__n": F.sum("__s").over(Window.partitionBy("__g"))}).drop("__s")
    inside = Window.partitionBy("__g", "__p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    hi = F.col("__b") + F.sum("__c").over(inside)
    return v.join(part, ["__g", "__p"]).select("__g", value, (hi - F.col("__c")).alias("__lo"), hi.alias("__hi"), "__n")


def nearest_rank(df: DataFrame, by: list[str], value: str, ps: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles (half to even). Nulls are left out; a null group is a group."""
    n = F.col("__n")
    at = {p: F.greatest(F.lit(0), F.least(F.bround(F.lit(p / 100.0) * n + F.lit(0.5)).cast("long") - 1, n - 1)) for p in ps}
    r = _ranked(df, by, value)
    g = r.groupBy("__g").agg(*[F.max(F.when((F.col("__lo") <= i) & (i < F.col("__hi")), F.col(value))).alias(f"p{p}") for p, i in at.items()])
    return g.select("__g.*", *[f"p{p}" for p in ps])


def load_percentile(df: DataFrame, by: list[str], value: str, p: int) -> DataFrame:
    """The other rule, index round(p/100 (n-1))."""
    i = F.bround(F.lit(p / 100.0) * (F.col("__n") - 1)).cast("long")
    return _ranked(df, by, value).where((F.col("__lo") <= i) & (i < F.col("__hi"))).select("__g.*", F.col(value).alias(f"p{p}"))


def unknown_documents(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """Gold rows whose document is not in the corpus."""
    return gold.join(docs.select("doc_id").distinct(), "doc_id", "left_anti")


def unscorable(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """Questions that no chunk answers."""
    return gold.select("qid", "doc_id").distinct().join(relevant_chunks(chunks, gold).select("qid").distinct(), "qid", "left_anti")
