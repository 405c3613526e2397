"""Streams against a static index, and rolling rates of answers that arrive late and twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.retrieval import bm25_topk


def search_stream(questions: DataFrame, chunks: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 5) -> StreamingQuery:
    """Each micro-batch of (qid, question) is searched in ``chunks``; ``sink`` gets the hits and the batch number (write by it, to be exactly once)."""

    def batch(df: DataFrame, number: int) -> None:
        sink(bm25_topk(chunks, df, k), number)

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def rolling_rates(answers: DataFrame, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Answers, abstentions and unsupported answers per model and window of ``answered_at``; a row that arrives again within the watermark counts once."""
    a = answers.withWatermark("answered_at", late).dropDuplicatesWithinWatermark(["answer_id"])
    held = F.coalesce("abstained", F.lit(False))
    return a.groupBy(F.window("answered_at", window).alias("w"), "model").agg(
        F.count("*").alias("answers"), F.count_if(held).alias("abstained"), F.count_if(~held & (F.col("supported") == F.lit(False))).alias("unsupported")
    ).select(F.col("w.start").alias("start"), "model", "answers", "abstained", "unsupported")
