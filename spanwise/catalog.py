"""All queries of the core: (spark, directory of the tables) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import abstention as ab
from .operators import chunking as ch
from .operators import gold as gd
from .operators import groundedness as gr
from .operators import metrics as me
from .operators import normalizer as nz
from .operators import provenance as pv
from .operators import retrieval as rt
from .operators import uncertainty as un
from .oracle import ORACLE  # noqa: F401
from .sources import corpus as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.parquet(f"{where}/documents.parquet")


def gold(spark: SparkSession, where: str) -> DataFrame:
    """Annotation records; a repeated row, with a later loaded_at, counts once."""
    return spark.read.parquet(f"{where}/gold.parquet").drop("loaded_at").distinct()


def roots(spark: SparkSession, where: str) -> DataFrame:
    return gold(spark, where).where("second_of is null")


def perquery(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.parquet(f"{where}/perquery.parquet").drop("loaded_at").distinct()


def answers(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.parquet(f"{where}/answers.parquet").drop("loaded_at").distinct()


def runs(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.parquet(f"{where}/runs.parquet")


# text functions


def _tokens(spark: SparkSession, where: str, stem: int | None) -> DataFrame:
    t = T.tokenize(F.col("text"), stem)
    return docs(spark, where).select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query
def tokenize_stem5(spark: SparkSession, where: str) -> DataFrame:
    return _tokens(spark, where, 5)


@query
def tokenize_nostem(spark: SparkSession, where: str) -> DataFrame:
    return _tokens(spark, where, None)


@query
def turkish_lower(spark: SparkSession, where: str) -> DataFrame:
    return roots(spark, where).select("qid", T.turkish_lower(F.col("question")).alias("lowered"))


@query
def fold_ascii(spark: SparkSession, where: str) -> DataFrame:
    return roots(spark, where).select("qid", T.fold_ascii(F.col("question")).alias("folded"))


@query
def shouting(spark: SparkSession, where: str) -> DataFrame:
    return roots(spark, where).select("qid", T.is_shouting(F.col("question")).alias("shouting"))


@query
def slugify(spark: SparkSession, where: str) -> DataFrame:
    return docs(spark, where).where("title is not null").select("doc_id", T.slugify(F.col("title")).alias("slug"))


@query
def snippet(spark: SparkSession, where: str) -> DataFrame:
    return docs(spark, where).where("text is not null").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query
def sha_digest(spark: SparkSession, where: str) -> DataFrame:
    return docs(spark, where).where("text is not null").select("doc_id", T.text_digest(F.col("text")).alias("sha256"))


@query
def stress_variants(spark: SparkSession, where: str) -> DataFrame:
    v = T.stress_variants(F.col("question"))
    return roots(spark, where).select("qid", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), c.alias("text")) for k, c in v.items()])).alias("x")).select("qid", "x.variant", "x.text")


@query
def overlap_share(spark: SparkSession, where: str) -> DataFrame:
    return gold(spark, where).select("qid", F.round(T.overlap(F.col("question"), F.col("answer_span")), 6).alias("overlap"))


# query normaliser


@query
def normalize_vocab(spark: SparkSession, where: str) -> DataFrame:
    return nz.vocabulary(docs(spark, where))


@query
def normalize_query(spark: SparkSession, where: str) -> DataFrame:
    return nz.normalise_questions(roots(spark, where), nz.vocabulary(docs(spark, where)))


# chunking


@query
def chunk_fixed(spark: SparkSession, where: str) -> DataFrame:
    return ch.chunk_fixed(docs(spark, where)).select("doc_id", "chunk_no", "body")


@query
def split_sentences(spark: SparkSession, where: str) -> DataFrame:
    s = T.split_sentences(F.col("text"))
    return docs(spark, where).where("text is not null").select("doc_id", F.posexplode(s).alias("sentence_no", "sentence"))


@query
def chunk_sentence(spark: SparkSession, where: str) -> DataFrame:
    return ch.chunk_sentence(docs(spark, where)).select("doc_id", "chunk_no", "body")


@query
def chunk_hierarchical(spark: SparkSession, where: str) -> DataFrame:
    return ch.with_ids(ch.chunk_hierarchical(docs(spark, where))).select("chunk_id", "doc_id", "chunk_no", "heading_path", "body")


@query
def sections(spark: SparkSession, where: str) -> DataFrame:
    return ch.sections(docs(spark, where)).select("doc_id", "section_no", "heading_path", F.length("section").alias("chars"))


@query
def chunk_size_sweep(spark: SparkSession, where: str) -> DataFrame:
    return ch.chunk_sizes(docs(spark, where)).groupBy("size").agg(F.count("*").alias("chunks"), F.sum(F.length("body")).alias("chars"))


# retrieval


@query
def bm25_stats(spark: SparkSession, where: str) -> DataFrame:
    c = ch.chunk_fixed(docs(spark, where))
    idf, _ = rt.bm25_stats(c, rt.postings(c))
    return idf.select("token", F.col("df").cast("bigint").alias("df"), F.round("idf", 6).alias("idf"))


@query
def bm25_topk_stem5(spark: SparkSession, where: str) -> DataFrame:
    return rt.bm25_topk(ch.chunk_fixed(docs(spark, where)), roots(spark, where), 10, 5)


@query
def bm25_topk_nostem(spark: SparkSession, where: str) -> DataFrame:
    return rt.bm25_topk(ch.chunk_fixed(docs(spark, where)), roots(spark, where), 10, None)


@query
def stem_sweep(spark: SparkSession, where: str) -> DataFrame:
    """The three arms and best hits that the SQL has; the whole sweep is stem_sweep_full."""
    return rt.sweep_stems(ch.chunk_fixed(docs(spark, where)), roots(spark, where), 1, (None, 4, 5))


@query
def stem_sweep_full(spark: SparkSession, where: str) -> DataFrame:
    """All 7 stems, 10 hits."""
    return rt.sweep_stems(ch.chunk_fixed(docs(spark, where)), roots(spark, where))


@query
def bm25_param_sweep(spark: SparkSession, where: str) -> DataFrame:
    """All 6 x 5 cells, 10 hits."""
    return rt.sweep_bm25(ch.chunk_fixed(docs(spark, where)), roots(spark, where))


def _vector_queries(e: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20, against all vectors."""
    return e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), "embedding")


@query
def dense_topk(spark: SparkSession, where: str) -> DataFrame:
    e = spark.read.parquet(f"{where}/embeddings.parquet")
    return rt.dense_topk(e, _vector_queries(e), 10)


@query
def hybrid_rrf(spark: SparkSession, where: str) -> DataFrame:
    c, q = ch.chunk_fixed(docs(spark, where)), roots(spark, where)
    lists = [rt.bm25_topk(c, q, rt.RRF_DEPTH, 5, fill=False), rt.bm25_topk(c, q, rt.RRF_DEPTH, None, fill=False)]
    return rt.fuse(lists, 10)


@query
def rerank_stub(spark: SparkSession, where: str) -> DataFrame:
    c, q = ch.chunk_fixed(docs(spark, where)), roots(spark, where)
    return rt.rerank(rt.bm25_topk(c, q, rt.RERANK_DEPTH, 5, fill=False), q, c, lambda pairs: [float(len(p)) for _, p in pairs], 10)


# relevance and metrics


@query
def relevance(spark: SparkSession, where: str) -> DataFrame:
    return me.relevant_chunks(ch.chunk_fixed(docs(spark, where)), roots(spark, where))


@query
def total_relevant(spark: SparkSession, where: str) -> DataFrame:
    return me.total_relevant(ch.chunk_fixed(docs(spark, where)), roots(spark, where))


@query
def unscorable(spark: SparkSession, where: str) -> DataFrame:
    return me.unscorable(ch.chunk_fixed(docs(spark, where)), roots(spark, where)).select("qid")


@query
def unknown_documents(spark: SparkSession, where: str) -> DataFrame:
    return me.unknown_documents(gold(spark, where), docs(spark, where)).select("qid", "doc_id")


@query
def metrics_per_query(spark: SparkSession, where: str) -> DataFrame:
    cols = {k: F.round(v, 6) for k, v in me.metric_columns(("mrr", "ndcg@10", "ndcg@3", "recall@5", "precision@5")).items()}
    return perquery(spark, where).select("run_id", "question", "ran_at", *[v.alias(k) for k, v in cols.items()])


@query
def metrics_runs(spark: SparkSession, where: str) -> DataFrame:
    return me.summarise(perquery(spark, where), ["run_id"])


@query
def metrics_summary(spark: SparkSession, where: str) -> DataFrame:
    c, g = ch.chunk_fixed(docs(spark, where)), roots(spark, where)
    r = me.per_query(rt.bm25_topk(c, g, 10, 5), c, g).withColumns({"chunking": F.lit("fixed"), "retriever": F.lit("bm25_stem5")})
    return me.summarise(r, ["chunking", "retriever"], ("ndcg@10", "recall@5", "mrr"))


@query
def percentile_nearest_rank(spark: SparkSession, where: str) -> DataFrame:
    return me.nearest_rank(perquery(spark, where), ["run_id"], "latency_ms")


@query
def percentile_load(spark: SparkSession, where: str) -> DataFrame:
    return me.load_percentile(perquery(spark, where), ["run_id"], "latency_ms", 95)


# uncertainty


def _ndcg(spark: SparkSession, where: str) -> DataFrame:
    """One value per run and question: of repeated measurements the mean."""
    p = perquery(spark, where).where("total_relevant > 0")
    return p.groupBy(F.col("run_id").alias("run"), "question").agg(F.avg(me.metric("ndcg@10", F.col("relevance"), F.col("total_relevant"))).alias("value"))


@query
def bootstrap_ci(spark: SparkSession, where: str) -> DataFrame:
    return un.bootstrap_ci(_ndcg(spark, where), ["run"], "value", ["question"])


@query
def bootstrap_sql(spark: SparkSession, where: str) -> DataFrame:
    return un.bootstrap_sql(_ndcg(spark, where), ["run"], "value", "question")


@query
def paired_diff(spark: SparkSession, where: str) -> DataFrame:
    p = perquery(spark, where).withColumns({"__pos": F.col("ran_at"), "value": F.round(me.metric("ndcg@10", F.col("relevance"), F.col("total_relevant")), 6)})
    d = un.paired(p, "run_id", "question", "value", "run-001", "run-002")
    return d.select("question", "a", "b", F.round("diff", 6).alias("diff"))


@query
def recommend(spark: SparkSession, where: str) -> DataFrame:
    costs = runs(spark, where).select(F.col("run_id").alias("run"), F.col("latency_ms_p95").alias("p95"), F.lit(None).cast("double").alias("index_seconds"))
    return un.recommend(_ndcg(spark, where), costs)


# abstention


@query
def margin_score_confidence(spark: SparkSession, where: str) -> DataFrame:
    h = rt.bm25_topk(ch.chunk_fixed(docs(spark, where)), roots(spark, where), 5, 5)
    return ab.confidences(h).select("qid", F.round("margin", 6).alias("margin"), F.round("score", 6).alias("score"))


def _curve(spark: SparkSession, where: str) -> DataFrame:
    r = perquery(spark, where).where("top_score is not null").select(F.col("top_score").alias("score"), F.coalesce(F.get("relevance", F.lit(0)), F.lit(False)).alias("correct"))
    return ab.sweep(r)


@query
def abstain_sweep(spark: SparkSession, where: str) -> DataFrame:
    return _curve(spark, where)


@query
def pick_threshold(spark: SparkSession, where: str) -> DataFrame:
    return ab.pick(_curve(spark, where), (0.1, 0.2, 0.3, 0.9))


# provenance


@query
def fingerprint(spark: SparkSession, where: str) -> DataFrame:
    return pv.fingerprint(docs(spark, where).where("text is not null"))


@query
def corpus_lock(spark: SparkSession, where: str) -> DataFrame:
    return pv.lock(docs(spark, where))


@query
def lock_drift(spark: SparkSession, where: str) -> DataFrame:
    d = docs(spark, where)
    return pv.drift(pv.lock(d.where("source <> 'brosur'")), d.where("source <> 'forum-dokumu'"))


@query
def audit_rederive(spark: SparkSession, where: str) -> DataFrame:
    return pv.audit(runs(spark, where), perquery(spark, where), tolerance=1e-6)


@query
def mixed_fingerprints(spark: SparkSession, where: str) -> DataFrame:
    return pv.mixed_fingerprints(runs(spark, where))


@query
def leaderboard(spark: SparkSession, where: str) -> DataFrame:
    return pv.leaderboard(runs(spark, where))


# question sets


@query
def load_gold(spark: SparkSession, where: str) -> DataFrame:
    return src.usable(gold(spark, where)).select("qid").distinct()


def _named(g: DataFrame) -> DataFrame:
    return g.withColumn("pos", F.struct("qid", "created_at", "annotator"))


@query
def validate_gold(spark: SparkSession, where: str) -> DataFrame:
    return gd.violations(_named(gold(spark, where))).distinct()


@query
def validate_articles(spark: SparkSession, where: str) -> DataFrame:
    return gd.against_articles(gold(spark, where), docs(spark, where)).distinct()


@query
def validate_reviews(spark: SparkSession, where: str) -> DataFrame:
    return gd.reviews(gold(spark, where)).distinct()


@query
def expand_embedded(spark: SparkSession, where: str) -> DataFrame:
    return gd.with_embedded(gold(spark, where)).select("qid", "second_of", "annotator", "answer_span").distinct()


@query
def pair_agreement(spark: SparkSession, where: str) -> DataFrame:
    return gd.pair_agreement(gd.annotation_pairs(gold(spark, where))).select("qid_a", "qid_b", "iou", "token_f1", "agree")


@query
def kappa_per_chunking(spark: SparkSession, where: str) -> DataFrame:
    return gd.kappa_by_chunking(gd.annotation_pairs(gold(spark, where)), ch.chunk_fixed(docs(spark, where))).select("qid_a", "qid_b", "kappa")


@query
def agreement(spark: SparkSession, where: str) -> DataFrame:
    return gd.agreement(gd.annotation_pairs(gold(spark, where)))


@query
def check_draft(spark: SparkSession, where: str) -> DataFrame:
    j = gold(spark, where).join(docs(spark, where).select("doc_id", "text"), "doc_id")
    return j.select("qid", gd.check_draft(F.col("question"), F.col("answer_span"), F.col("text")).alias("problem")).distinct()


@query
def build_items(spark: SparkSession, where: str) -> DataFrame:
    g = roots(spark, where).select("doc_id", F.col("qid").alias("pos"), "question", F.col("answer_span").alias("span"), F.col("second_annotation.answer_span").alias("second_span"))
    return gd.build_items(g, docs(spark, where))


# groundedness and export


@query
def groundedness_rates(spark: SparkSession, where: str) -> DataFrame:
    return gr.rates(answers(spark, where), ["model"])


@query
def groundedness_stub(spark: SparkSession, where: str) -> DataFrame:
    c, g = ch.chunk_fixed(docs(spark, where)), roots(spark, where)
    verdict = lambda q, a, s, p: '{"supported": ' + ("true" if s and s in p else "false") + ', "answers_question": true}'
    r = gr.evaluate(g, rt.bm25_topk(c, g, 5, 5), c, lambda q, p: p.split("\n", 2)[1][:80] if p else T.ABSTAIN, verdict)
    return gr.rates(r)


@query
def abstention_flips(spark: SparkSession, where: str) -> DataFrame:
    a = answers(spark, where)
    m = [r["model"] for r in a.select("model").distinct().orderBy("model").head(2)]
    return gr.flips(a, "model", m[0], m[-1], [])


@query
def beir_queries(spark: SparkSession, where: str) -> DataFrame:
    return src.beir_queries(roots(spark, where))


@query
def beir_qrels(spark: SparkSession, where: str) -> DataFrame:
    return src.beir_qrels(roots(spark, where))


@query
def beir_passage_qrels(spark: SparkSession, where: str) -> DataFrame:
    return src.beir_passages(ch.chunk_hierarchical(docs(spark, where)), roots(spark, where))[2]


@query
def stress_matrix(spark: SparkSession, where: str) -> DataFrame:
    """All rewrites searched in one job."""
    c, g = ch.chunk_fixed(docs(spark, where)), roots(spark, where)
    v = T.stress_variants(F.col("question"))
    q = g.select(F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), c_.alias("question")) for k, c_ in v.items()])).alias("x"), F.col("qid").alias("base"), "doc_id", "answer_span")
    q = q.select(F.concat_ws("|", "x.variant", "base").alias("qid"), F.col("x.question").alias("question"), "doc_id", "answer_span")
    r = me.per_query(rt.bm25_topk(c, q, 10, 5), c, q).withColumn("variant", F.substring_index("qid", "|", 1))
    return me.summarise(r, ["variant"], ("ndcg@10", "recall@5", "mrr"))
