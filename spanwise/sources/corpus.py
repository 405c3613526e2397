"""Reading corpora, question sets and results; writing results and exports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC = "doc_id string, _id string, title string, text string, url string, revid bigint"
MIN_FOLDER = 200


class SourceError(ValueError):
    """A source that breaks its contract."""


def clean_rows(raw: DataFrame) -> DataFrame:
    """IO5: empty strings count as missing; the id falls back to ``_id``, the title to the id, the url to ''."""
    have = set(raw.columns)
    col = lambda n: F.nullif(F.col(n).cast("string"), F.lit("")) if n in have else F.lit(None).cast("string")
    i = F.coalesce(col("doc_id"), col("_id"))
    return raw.select(i.alias("doc_id"), F.coalesce(col("title"), i).alias("title"), F.col("text"), F.coalesce(col("url"), F.lit("")).alias("url"), (F.col("revid").cast("bigint") if "revid" in have else F.lit(None).cast("bigint")).alias("revid"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """IO1: a file that is one JSON array."""
    return clean_rows(spark.read.schema(DOC).option("multiLine", True).json(path))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """IO2: one JSON object a line; blank lines are skipped, a broken line is an error that quotes it."""
    raw = spark.read.schema(DOC + ", __bad string").option("columnNameOfCorruptRecord", "__bad").json(path).cache()
    bad = raw.where(F.col("__bad").isNotNull() & (F.trim("__bad") != "")).select("__bad").head(1)
    if bad:
        raise SourceError(f"{path}: broken line {bad[0][0][:80]!r}")
    return clean_rows(raw.where(F.col("__bad").isNull()).drop("__bad"))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """IO3: .txt and .md files, any depth; id = relative path, title = file name without suffix; texts under 200 characters are left out."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("value"), F.col("_metadata.file_path").alias("uri"))
    raw = raw.where(F.lower("uri").rlike(r"\.(txt|md)$"))
    name = F.regexp_replace(F.url_decode("uri"), F.lit(r"^file:/+"), F.lit("/"))
    base = os.path.abspath(path).rstrip("/") + "/"
    text = F.regexp_replace("value", F.lit(r"^[\s\p{Z}]+|[\s\p{Z}]+$"), F.lit(""))
    out = raw.select(F.replace(name, F.lit(base), F.lit("")).alias("doc_id"), F.regexp_extract(name, r"([^/]+)\.[^./]+$", 1).alias("title"), text.alias("text"), F.col("uri").alias("url"), F.lit(None).cast("bigint").alias("revid"))
    return out.where(F.length("text") >= MIN_FOLDER)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Documents as a table."""
    return spark.read.parquet(path)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """IO4: by suffix or kind of folder; ids must be unique and present, and there must be a document."""
    if os.path.isdir(path):
        beir = os.path.join(path, "corpus.jsonl")
        docs = read_jsonl(spark, beir) if os.path.exists(beir) else read_parquet(spark, path) if path.endswith(".parquet") else read_folder(spark, path)
    elif path.endswith(".jsonl"):
        docs = read_jsonl(spark, path)
    elif path.endswith(".json"):
        docs = read_json(spark, path)
    else:
        docs = read_parquet(spark, path)
    n = docs.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull() | F.col("text").isNull()).alias("bad")).first()
    if not n["n"]:
        raise SourceError(f"{path}: no documents")
    if n["bad"]:
        raise SourceError(f"{path}: {n['bad']} documents without id or text")
    twice = docs.groupBy("doc_id").count().where("count > 1").head(1)
    if twice:
        raise SourceError(f"{path}: id {twice[0]['doc_id']!r} comes {twice[0]['count']} times")
    return docs


GOLD = (
    "qid string, question string, doc_id string, doc_title string, answer_span string, question_tr string, annotator string, second_of string, source string, review string, "
    "second_annotation struct<annotator:string,answer_span:string>, human_review struct<reviewer:string,verdict:string,note:string>"
)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """IO6: a JSON file, or the sorted ``*.json`` of a folder (not deeper), with the file's name and the row's position."""
    files = sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".json")) if os.path.isdir(path) else [path]
    if not files:
        raise SourceError(f"{path}: no question files")
    raw = spark.read.schema(GOLD).option("multiLine", True).json(files)
    return raw.select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("pos"))


def usable(gold: DataFrame, drafts: bool = False) -> DataFrame:
    """IO7: without rejected rows, rows that still need a person, and (unless asked for) drafts."""
    v = F.coalesce(F.col("human_review.verdict"), F.lit(""))
    keep = (v != "rejected") & (~F.coalesce(F.col("review") == "needs-human", F.lit(False)) | v.isin("ok", "fixed"))
    return gold.where(keep if drafts else keep & ~F.coalesce(F.col("source") == "llm-draft", F.lit(False)))


def topics(wanted: list[str], gold: DataFrame) -> DataFrame:
    """IO9: wanted titles in their order, then the gold titles that are missing among them, sorted."""
    spark = gold.sparkSession
    a = spark.createDataFrame([(0, i, t) for i, t in enumerate(wanted)], "part int, pos int, title string")
    b = gold.select(F.lit(1).alias("part"), F.lit(0).alias("pos"), F.col("doc_title").alias("title")).where("title is not null").distinct().join(a.select("title"), "title", "left_anti").select("part", "pos", "title")
    return a.unionByName(b).orderBy("part", "pos", "title").select("title")


def write_results(records: DataFrame, path: str) -> None:
    """IO10: per-query records, partitioned so that a configuration is read by itself."""
    records.write.mode("overwrite").partitionBy("chunking", "retriever").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """IO11: configurations from the folder names; pruned by filters on them."""
    return spark.read.parquet(path)


def read_result_files(spark: SparkSession, pattern: str) -> DataFrame:
    """IO11-IO12: ``perquery_<chunking>_<retriever>.json`` files; the name is cut at the first underscore behind the prefix."""
    schema = "qid string, question string, relevance array<boolean>, total_relevant int, found boolean, top_score double"
    raw = spark.read.schema(schema).option("multiLine", True).json(pattern).select("*", F.col("_metadata.file_name").alias("f"))
    return raw.select(F.regexp_extract("f", r"^perquery_([^_]+)_", 1).alias("chunking"), F.regexp_extract("f", r"^perquery_[^_]+_(.+)\.json$", 1).alias("retriever"), *[c for c in raw.columns if c != "f"])


def beir(docs: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """IO13: corpus, queries and qrels by article; a question without its article is an error."""
    lost = gold.join(docs.select("doc_id"), "doc_id", "left_anti").select("qid", "doc_id").head(3)
    if lost:
        raise SourceError("no article for " + ", ".join(f"{r['qid']} -> {r['doc_id']}" for r in lost))
    return beir_corpus(docs), beir_queries(gold), beir_qrels(gold)


def beir_corpus(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(F.col("doc_id").cast("string").alias("_id"), F.coalesce("title", F.lit("")).alias("title"), "text", F.coalesce("url", F.lit("")).alias("url"))


def beir_queries(gold: DataFrame) -> DataFrame:
    return gold.select(F.col("qid").alias("_id"), F.col("question").alias("text"), "answer_span", F.coalesce("source", F.lit("human")).alias("source"))


def beir_qrels(gold: DataFrame) -> DataFrame:
    return gold.select(F.col("qid").alias("query-id"), F.col("doc_id").cast("string").alias("corpus-id"), F.lit(1).alias("score"))


def beir_passages(chunks: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """IO14: the same by passage; a question that no passage answers is left out."""
    from ..operators.metrics import relevant_chunks

    pid = F.concat(F.col("doc_id").cast("string"), F.lit("::"), F.col("chunk_no").cast("string"))
    rel = relevant_chunks(chunks, gold).select("qid", pid.alias("pid")).distinct()
    corpus = chunks.select(pid.alias("_id"), F.col("heading_path").alias("title"), F.col("body").alias("text"), "url")
    return corpus, beir_queries(gold.join(rel, "qid", "left_semi")), rel.select(F.col("qid").alias("query-id"), F.col("pid").alias("corpus-id"), F.lit(1).alias("score"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def cached_column(df: DataFrame, cache_path: str, model: str, text: str, compute: object, column: str = "value") -> DataFrame:
    """IO15-IO16: what a model gave for a text, by digest of model and text: only texts missing in the table are computed, appended and joined back."""
    spark = df.sparkSession
    key = F.sha2(F.concat_ws("\x00", F.lit(model), F.col(text)), 256)
    keyed = df.withColumn("__key", key)
    try:
        have = spark.read.parquet(cache_path)
    except Exception:  # noqa: BLE001  no table yet
        have = None
    todo = keyed.select("__key", text).dropDuplicates(["__key"])
    todo = todo.join(have.select("__key"), "__key", "left_anti") if have is not None else todo
    compute(todo).select("__key", column).write.mode("append").parquet(cache_path)
    return keyed.join(spark.read.parquet(cache_path), "__key", "left").drop("__key")
