"""The queries of this subpackage, by name: (spark, directory of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import answer_defects, consensus, contamination, language, lookalike, near_duplicates, sentences, split, tokenizer


def _table(spark: SparkSession, where: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{where}/{name}.parquet")


def p1_chunks(spark: SparkSession, where: str) -> DataFrame:
    return split.split_oversized(_table(spark, where, "documents"))


def p1_found(spark: SparkSession, where: str) -> DataFrame:
    pieces = split.split_oversized(_table(spark, where, "documents"), with_piece=False)
    forced = F.max((F.col("boundary") == "forced").cast("int")) == 1
    return pieces.groupBy("doc_id").agg(F.when(forced, "forced").otherwise("natural").alias("cut"))


def p2_found(spark: SparkSession, where: str) -> DataFrame:
    return answer_defects.defects(_table(spark, where, "answers"))


def p3_found(spark: SparkSession, where: str) -> DataFrame:
    votes, _, _ = consensus.consensus(_table(spark, where, "gold"), least=3)  # the questions of the statement; p3_items has those of two records, too
    return votes.where(~F.col("agreed") & (F.col("records") >= 3)).select(F.col("root").alias("root_qid"), "qid").distinct()


def p3_items(spark: SparkSession, where: str) -> DataFrame:
    _, items, _ = consensus.consensus(_table(spark, where, "gold"))
    return items.select(F.col("root").alias("root_qid"), "label", "votes", "records", F.round("posterior", 6).alias("posterior"), F.round("agreement", 6).alias("agreement"))


def p3_annotators(spark: SparkSession, where: str) -> DataFrame:
    return consensus.consensus(_table(spark, where, "gold"))[2]


def _root_questions(spark: SparkSession, where: str) -> DataFrame:
    return _table(spark, where, "gold").where(F.col("second_of").isNull() & F.col("qid").isNotNull())


def p4_found(spark: SparkSession, where: str) -> DataFrame:
    links, members = near_duplicates.near_duplicates(_root_questions(spark, where), "qid", "question", 0.7)
    return near_duplicates.all_pairs(links, members, "qid").select(F.col("a").alias("qid_a"), F.col("b").alias("qid_b"))


def p4_groups(spark: SparkSession, where: str) -> DataFrame:
    links, members = near_duplicates.near_duplicates(_root_questions(spark, where), "qid", "question", 0.7)
    return near_duplicates.groups(links, members, "qid")


def p5_found(spark: SparkSession, where: str) -> DataFrame:
    return sentences.unit_starts(_table(spark, where, "documents")).select("doc_id", F.col("sent_start").cast("bigint").alias("sent_start"))


def p6_found(spark: SparkSession, where: str) -> DataFrame:
    g = lookalike.departing_fields(_table(spark, where, "gold"), "qid", ["question", "answer_span"]).distinct()
    d = lookalike.departing_fields(_table(spark, where, "documents"), "doc_id", ["text"])
    return g.select(F.lit("gold").alias("tab"), "row_key", "field").unionByName(d.select(F.lit("documents").alias("tab"), "row_key", "field"))


def p7_ids(spark: SparkSession, where: str) -> DataFrame:
    return tokenizer.encode_texts(_table(spark, where, "documents"))


def p8_found(spark: SparkSession, where: str) -> DataFrame:
    return contamination.leaks(_table(spark, where, "documents"), _table(spark, where, "benchmark"))


def p9_found(spark: SparkSession, where: str) -> DataFrame:
    return language.mislabelled(_table(spark, where, "documents")).select("doc_id", "seg_start", "lang")


def p9_segments(spark: SparkSession, where: str) -> DataFrame:
    d = _table(spark, where, "documents")
    return language.segments(d, language.train(d)).select("doc_id", "seg_no", "seg_start", F.col("seg_lang").alias("lang"), F.round("confidence", 6).alias("confidence"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_chunks, p1_found, p2_found, p3_found, p3_items, p3_annotators, p4_found, p4_groups, p5_found, p6_found, p7_ids, p8_found, p9_found, p9_segments)
}
