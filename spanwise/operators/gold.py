"""Question sets: checks, second annotations, pairwise agreement, drafts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise, overlap, passes_agree, slugify, span_f1, span_iou, turkish_lower

MAX_OVERLAP, MIN_SPAN, MAX_SPAN, MIN_ARTICLE = 0.6, 20, 400, 800
REQUIRED = ("qid", "question", "doc_id", "doc_title", "answer_span")


def question_key(c: Column) -> Column:
    """Two annotations of one question have one key."""
    return normalise(turkish_lower(c))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.regexp_replace(F.col(c).cast("string"), F.lit(r"[\s\p{Z}]+"), F.lit(" "))) == "")


def violations(gold: DataFrame, order: str = "pos") -> DataFrame:
    """V1: (qid, rule) of each rule broken; ``order`` says which of two rows came first.

    Rules: missing (a required field is null or blank; such rows have no other), duplicate_qid, unknown_root,
    other_document, other_question, duplicate_question, no_question_mark, copied (too much of the question
    stands in the span).
    """
    missing = _blank(REQUIRED[0])
    for f in REQUIRED[1:]:
        missing = missing | _blank(f)
    g = gold.select(*REQUIRED, "second_of", order).withColumn("missing", missing).withColumn("key", question_key(F.col("question")))
    ok = g.where(~F.col("missing"))
    first = g.where(F.col("qid").isNotNull()).groupBy("qid").agg(F.min_by(F.struct("doc_id", "key"), order).alias("root"))
    j = ok.join(first.withColumnRenamed("qid", "second_of"), "second_of", "left")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(order))
    nthq = F.row_number().over(Window.partitionBy("key").orderBy(order))
    j = j.withColumns({"nth": nth, "nthq": nthq})
    share = overlap(F.col("question"), F.col("answer_span"))
    second = F.col("second_of").isNotNull()
    rules = {
        "duplicate_qid": F.col("nth") > 1,
        "unknown_root": second & F.col("root").isNull(),
        "other_document": second & (F.col("root.doc_id") != F.col("doc_id")),
        "other_question": second & (F.col("root.doc_id") == F.col("doc_id")) & ~F.col("root.key").eqNullSafe(F.col("key")),
        "duplicate_question": ~second & (F.col("nthq") > 1),
        "no_question_mark": ~F.rtrim(F.col("question")).endswith("?"),
        "copied": share > MAX_OVERLAP,
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return j.select("qid", F.explode_outer(broken).alias("rule")).where("rule is not null").unionByName(g.where("missing").select("qid", F.lit("missing").alias("rule")))


def against_articles(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """V3: (qid, rule): no_article, other_title, short_article, span_absent, second_span_absent."""
    d = docs.select("doc_id", F.col("title").alias("t"), F.length("text").alias("n"), normalise(F.coalesce("text", F.lit(""))).alias("x"), F.lit(True).alias("there"))
    j = gold.where(~(F.coalesce(F.col("human_review.verdict"), F.lit("")) == "rejected")).join(d, "doc_id", "left")
    fixed = F.coalesce(F.col("human_review.verdict"), F.lit("")) == "fixed"
    there = F.col("there").isNotNull()
    rules = {
        "no_article": ~there,
        "other_title": there & ~F.col("t").eqNullSafe(F.col("doc_title")),
        "short_article": there & (F.coalesce("n", F.lit(0)) < MIN_ARTICLE),
        "span_absent": there & ~F.coalesce(F.contains("x", normalise(F.col("answer_span"))), F.lit(False)),
        "second_span_absent": there & F.col("second_annotation").isNotNull() & ~fixed & ~F.coalesce(F.contains("x", normalise(F.col("second_annotation.answer_span"))), F.lit(False)),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return j.select("qid", F.explode_outer(broken).alias("rule")).where("rule is not null")


def reviews(gold: DataFrame) -> DataFrame:
    """V2: (qid, rule) of human reviews: not_a_draft, no_reviewer, unknown_verdict, no_note."""
    g = gold.where(F.col("human_review").isNotNull())
    draft = F.coalesce(F.col("source") == "llm-draft", F.lit(False))
    v = F.col("human_review.verdict")
    known = F.coalesce(v.isin("ok", "fixed", "rejected"), F.lit(False))
    rules = {
        "not_a_draft": ~draft,
        "no_reviewer": draft & (F.trim(F.coalesce("human_review.reviewer", F.lit(""))) == ""),
        "unknown_verdict": draft & ~known,
        "no_note": draft & known & (v != "ok") & (F.trim(F.coalesce("human_review.note", F.lit(""))) == ""),
    }
    return g.select("qid", F.explode_outer(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())).alias("rule")).where("rule is not null")


def with_embedded(gold: DataFrame) -> DataFrame:
    """G1: embedded second annotations as rows ``qid#2``, unless fixed by a reviewer or there already."""
    cols = ["qid", "question", "doc_id", "doc_title", "answer_span", "annotator", "second_of"]
    extra = gold.where(F.col("second_annotation").isNotNull() & ~(F.coalesce(F.col("human_review.verdict"), F.lit("")) == "fixed"))
    extra = extra.select(
        F.concat("qid", F.lit("#2")).alias("qid"), "question", "doc_id", "doc_title", F.col("second_annotation.answer_span").alias("answer_span"),
        F.col("second_annotation.annotator").alias("annotator"), F.col("qid").alias("second_of"),
    ).dropDuplicates(["qid"]).join(gold.select("qid"), "qid", "left_anti")
    return gold.select(*cols).unionByName(extra.select(*cols))


def annotation_pairs(items: DataFrame) -> DataFrame:
    """(key, qid_a, qid_b, spans, doc_id) for annotations of one question by different people (null is one person).

    Items are numbered inside their question by qid; repeated records count once. Pairs are made per question
    of at least two annotations, whose number is that of its annotators.
    """
    i = items.select("qid", question_key(F.col("question")).alias("key"), "doc_id", "annotator", "answer_span").dropDuplicates(["qid"])
    a, b = i.select("key", *[F.col(c).alias(f"{c}_a") for c in ("qid", "doc_id", "annotator", "answer_span")]), i.select("key", *[F.col(c).alias(f"{c}_b") for c in ("qid", "doc_id", "annotator", "answer_span")])
    return a.join(b, "key").where((F.col("qid_a") < F.col("qid_b")) & ~F.col("annotator_a").eqNullSafe(F.col("annotator_b")))


def pair_agreement(pairs: DataFrame) -> DataFrame:
    """T14-T16 per pair."""
    a, b = F.col("answer_span_a"), F.col("answer_span_b")
    return pairs.select("key", "qid_a", "qid_b", F.round(span_iou(a, b), 6).alias("iou"), F.round(span_f1(a, b), 6).alias("token_f1"), passes_agree(a, b).alias("agree"))


def kappa(n: Column, same: Column, a: Column, b: Column) -> Column:
    """Cohen's kappa of two yes/no labellings from counts: items, equal ones, yes of the one, yes of the other."""
    po, pa, pb = same / n, a / n, b / n
    pe = pa * pb + (F.lit(1.0) - pa) * (F.lit(1.0) - pb)
    return F.when(n == 0, F.lit(None).cast("double")).when(pe >= 1.0, F.lit(1.0)).otherwise((po - pe) / (F.lit(1.0) - pe))


def kappa_by_chunking(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunking, key, qid_a, qid_b, kappa) of the labels that the two spans give the document's chunks."""
    sides = pairs.select("key", "qid_a", "qid_b", F.col("doc_id_a").alias("doc_id"), normalise(F.col("answer_span_a")).alias("a"), normalise(F.col("answer_span_b")).alias("b"))
    c = chunks.select("chunking", "doc_id", normalise(F.col("body")).alias("t"))
    j = c.join(sides, "doc_id").select("chunking", "key", "qid_a", "qid_b", F.coalesce(F.contains("t", "a"), F.lit(False)).cast("int").alias("x"), F.coalesce(F.contains("t", "b"), F.lit(False)).cast("int").alias("y"))
    g = j.groupBy("chunking", "key", "qid_a", "qid_b").agg(F.count("*").cast("double").alias("n"), F.sum((F.col("x") == F.col("y")).cast("int")).alias("s"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    return g.select("chunking", "key", "qid_a", "qid_b", (F.round(kappa(F.col("n"), F.col("s"), F.col("x"), F.col("y")), 6) + F.lit(0.0)).alias("kappa"))


def agreement(pairs: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row of means, each question weighing 1."""
    p = pair_agreement(pairs).groupBy("key").agg(F.count("*").alias("pairs"), F.avg("iou").alias("iou"), F.avg("token_f1").alias("f1"))
    out = p.agg(F.count("*").alias("questions"), F.sum("pairs").alias("pairs"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.avg("f1"), 6).alias("mean_token_f1"))
    if chunks is None:
        return out
    k = kappa_by_chunking(pairs, chunks).groupBy("chunking", "key").agg(F.avg("kappa").alias("k")).groupBy("chunking").agg(F.round(F.avg("k"), 6).alias("mean_kappa"))
    return k.crossJoin(F.broadcast(out))


def check_draft(question: Column, span: Column, document: Column) -> Column:
    """The first reason against a drafted question, null for none."""
    q, s = F.trim(question), F.trim(span)
    return (
        F.when(~F.coalesce(q.endswith("?"), F.lit(False)), "no_question_mark")
        .when(F.coalesce(s, F.lit("")) == "", "empty_span")
        .when(F.length(s) < MIN_SPAN, "short_span")
        .when(F.length(s) > MAX_SPAN, "long_span")
        .when(~F.coalesce(F.contains(normalise(document), normalise(s)), F.lit(False)), "not_verbatim")
        .when(overlap(q, s) > MAX_OVERLAP, "copied")
    )


def build_items(drafts: DataFrame, docs: DataFrame, prefix: str = "d") -> DataFrame:
    """Sound drafts (doc_id, pos, question, span, second_span) as items, numbered per document over the kept ones."""
    d = docs.select("doc_id", "title", "text")
    j = drafts.join(d, "doc_id").withColumn("problem", check_draft(F.col("question"), F.col("span"), F.col("text"))).where(F.col("problem").isNull())
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    second = F.trim(F.coalesce("second_span", F.lit("")))
    valid = (second != "") & F.contains(normalise(F.col("text")), normalise(second))
    return j.select(
        F.concat_ws("-", F.lit(prefix), slugify(F.coalesce("title", F.lit(""))), F.lpad(no.cast("string"), 3, "0")).alias("qid"),
        "doc_id", F.col("title").alias("doc_title"), F.trim("question").alias("question"), F.trim("span").alias("answer_span"),
        F.when(valid, second).alias("second_span"), (valid & passes_agree(F.col("span"), second)).alias("agreed"),
    )


def draft(docs: DataFrame, drafter: Callable[[str, str], list[tuple[str, str]]], marker: Callable[[str, str, list[str]], list[str]]) -> DataFrame:
    """D3: two passes of pluggable models over documents; a short second reply is padded with empty spans."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, title, text in zip(b["doc_id"], b["title"], b["text"], strict=True):
                made = drafter(title, text)
                again = marker(title, text, [q for q, _ in made]) if made else []
                again = [*again, *[""] * (len(made) - len(again))]
                rows += [(i, n, q, s, x) for n, ((q, s), x) in enumerate(zip(made, again[: len(made)], strict=True))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "question", "span", "second_span"])

    return docs.where(F.col("text").isNotNull()).select("doc_id", "title", "text").mapInPandas(run, f"doc_id {kind}, pos int, question string, span string, second_span string")


def translate(questions: DataFrame, translator: Callable[[list[str]], list[str]], text: str = "question", out: str = "question_tr") -> DataFrame:
    """A column translated by a pluggable model, Arrow batch by batch; nulls stay null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        ok = s.notna()
        r = s.copy()
        if ok.any():
            r[ok] = translator(s[ok].tolist())
        return r

    return questions.withColumn(out, run(F.col(text)))


