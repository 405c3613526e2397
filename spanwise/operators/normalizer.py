"""Restoring the marks that typed questions lack, from the corpus' own words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import fold_ascii, is_shouting, nfc, turkish_lower, upper_first
from .retrieval import small

WORD = r"[\p{L}\p{M}]+"


def _pieces(c: Column) -> Column:
    """Words and what stands between them, in order."""
    return F.regexp_extract_all(c, F.lit(rf"({WORD}|[^\p{{L}}\p{{M}}]+)"), F.lit(1))


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(fold, form): the most frequent form of each ASCII fold; of equally frequent ones the first in the corpus' order."""
    words = docs.where(F.col(text).isNotNull()).select("doc_id", F.posexplode_outer(F.regexp_extract_all(turkish_lower(F.col(text)), F.lit(f"({WORD})"), F.lit(1))).alias("pos", "form")).where("form is not null")
    n = words.groupBy("form").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    w = Window.partitionBy("fold").orderBy(F.desc("n"), "first")
    return n.withColumn("fold", fold_ascii(F.col("form"))).withColumn("r", F.row_number().over(w)).where(F.col("r") == 1).select("fold", "form")


def normalise_questions(questions: DataFrame, vocab: DataFrame, text: str = "question") -> DataFrame:
    """(qid, normalised). Only marks are added and shouting is lowered; what is no word stays as it is.

    Null gives null; joins on words, so the vocabulary may be of any size.
    """
    q = questions.select("qid", text).distinct().withColumn("t", F.replace(nfc(F.col(text)), F.lit("i̇"), F.lit("i")))
    q = q.withColumn("t", F.when(is_shouting(F.col("t")), turkish_lower(F.col("t"))).otherwise(F.col("t")))
    p = q.select("qid", text, F.posexplode_outer(_pieces(F.col("t"))).alias("pos", "w"))
    p = p.withColumn("fold", F.when(F.col("w").rlike(r"^[A-Za-z]{3,}$"), fold_ascii(turkish_lower(F.col("w")))))
    # each word is looked up once; separators and words that can't be restored take no part in any join on words
    known = small(p.where("fold is not null").select("fold").distinct().join(vocab, "fold"))
    can = p.where("fold is not null").join(known, "fold", "left")
    j = can.unionByName(p.where("fold is null").withColumn("form", F.lit(None).cast("string")))
    back = F.when(F.col("w").rlike(r"^\p{Lu}"), upper_first(F.col("form"))).otherwise(F.col("form"))
    j = j.withColumn("out", F.when(F.col("form").isNotNull() & (fold_ascii(back) == F.col("w")), back).otherwise(F.col("w")))
    g = j.groupBy("qid", text).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), "").alias("n"))
    return g.select("qid", F.when(F.col(text).isNotNull(), F.col("n")).alias("normalised"))
