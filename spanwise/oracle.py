"""The core queries in DuckDB's SQL, built from shared fragments."""

from __future__ import annotations

from .functions.text import ASCII_FROM, ASCII_TO, STOPWORDS

_STOP = "[" + ",".join(f"'{w}'" for w in STOPWORDS) + "]"
_GOLD = "g0 AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM gold), roots AS (SELECT * FROM g0 WHERE second_of IS NULL)"
_PQ = "pq AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM perquery)"
_WS = r"[\s\p{Z}]+"


def low(x: str) -> str:
    """Plain lower case as Java has it."""
    return f"lower(replace({x}, 'İ', 'i' || chr(775)))"


def tl(x: str) -> str:
    return f"lower(translate(nfc_normalize({x}), 'IİĞÜŞÖÇ', 'ıiğüşöç'))"


def norm(x: str) -> str:
    return low(rf"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))")


def toks(x: str, stem: int | None = 5) -> str:
    kept = f"list_filter(regexp_extract_all({tl(f'coalesce({x}, $$$$)')}, '[0-9a-zçğıöşü]+'), lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w))"
    return f"list_transform({kept}, lambda w: substr(w, 1, {stem}))" if stem else kept


def fold(x: str) -> str:
    return f"replace(translate(nfc_normalize({x}), '{ASCII_FROM}', '{ASCII_TO}'), chr(775), '')"


def overlap(q: str, s: str) -> str:
    return f"CASE WHEN len(list_distinct({toks(q)})) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_distinct({toks(q)}), {toks(s)}))::DOUBLE / len(list_distinct({toks(q)})) END"


def fixed(size: int = 700, step: int = 600) -> str:
    return rf"""
flat{size} AS (SELECT doc_id, title, trim(regexp_replace(regexp_replace(text, '(?m)^={{2,6}}\s*.+?\s*={{2,6}}$', ' ', 'g'), '{_WS}', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
win{size} AS (SELECT doc_id, title, i, trim(substr(t, i::BIGINT * {step} + 1, {size})) AS body FROM (SELECT *, unnest(range(0, (length(t) - 1) // {step} + 1)) AS i FROM flat{size} WHERE length(t) > 0)),
chunk{size} AS (SELECT doc_id, title, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_no, body FROM win{size} WHERE length(body) > 50)"""


def bm25(stem: int | None, k: int, fill: bool = True, questions: str = "roots", name: str = "hits") -> str:
    """CTEs up to ``name``: qid, rank, doc_id, chunk_no, score."""
    n = name
    f = f"""
{n}_t AS (SELECT doc_id, chunk_no, {toks('body', stem)} AS ts FROM chunk700),
{n}_p AS (SELECT doc_id, chunk_no, len(ts) AS dl, token, count(*) AS tf FROM (SELECT doc_id, chunk_no, ts, unnest(ts) AS token FROM {n}_t) GROUP BY ALL),
{n}_s AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)::DOUBLE) AS avgdl FROM {n}_t),
{n}_r AS (SELECT token, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT token, count(*)::DOUBLE AS df FROM {n}_p GROUP BY token), {n}_s),
{n}_i AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM {n}_r) ELSE raw END AS idf FROM {n}_r),
{n}_q AS (SELECT qid, token, count(*) AS qtf FROM (SELECT qid, unnest({toks('question', stem)}) AS token FROM {questions}) GROUP BY ALL),
{n}_c AS (SELECT qid, doc_id, chunk_no, round(sum(qtf * idf * tf::DOUBLE * 2.5::DOUBLE / (tf::DOUBLE + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM {n}_p JOIN {n}_q USING (token) JOIN {n}_i USING (token), {n}_s GROUP BY ALL),
{n}_m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_no) AS rank FROM {n}_c) WHERE rank <= {k})"""
    if not fill:
        return f + f", {n} AS (SELECT qid, rank, doc_id, chunk_no, score FROM {n}_m)"
    return f + f""",
{n}_first AS (SELECT doc_id, chunk_no FROM chunk700 ORDER BY doc_id, chunk_no LIMIT {2 * k}),
{n}_short AS (SELECT qid FROM (SELECT DISTINCT qid FROM {questions}) LEFT JOIN (SELECT qid, count(*) FILTER (score > 0) AS pos FROM {n}_m GROUP BY qid) USING (qid) WHERE coalesce(pos, 0) < {k}),
{n}_all AS (SELECT qid, doc_id, chunk_no, score FROM {n}_m UNION ALL SELECT qid, doc_id, chunk_no, 0.0::DOUBLE FROM (SELECT * FROM {n}_short, {n}_first) ANTI JOIN (SELECT qid, doc_id, chunk_no FROM {n}_m) USING (qid, doc_id, chunk_no)),
{n} AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_no) AS rank, doc_id, chunk_no, score FROM {n}_all) WHERE rank <= {k})"""


_REL = f"rel AS (SELECT qid, c.doc_id, chunk_no FROM chunk700 c JOIN roots g USING (doc_id) WHERE answer_span IS NOT NULL AND contains({norm('body')}, {norm('answer_span')}))"


def hits_in(rel: str, k: int) -> str:
    return f"len(list_filter({rel}[1:{k}], lambda x: x))::DOUBLE"


def ndcg(k: int) -> str:
    dcg = f"coalesce(list_sum(list_transform(range(1, {k + 1}), lambda i: CASE WHEN relevance[i] THEN 1.0::DOUBLE / log2(i + 1.0::DOUBLE) ELSE 0.0::DOUBLE END)), 0.0::DOUBLE)"
    return f"CASE WHEN total_relevant > 0 THEN {dcg} / list_sum(list_transform(range(1, least(total_relevant, {k}) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))) ELSE 0.0::DOUBLE END"


def recall(k: int) -> str:
    return f"CASE WHEN total_relevant > 0 THEN {hits_in('relevance', k)} / total_relevant ELSE 0.0::DOUBLE END"


def precision(k: int) -> str:
    return f"{hits_in('relevance', k)} / {float(k)}::DOUBLE"


MRR = "CASE WHEN list_position(relevance, true) > 0 THEN 1.0::DOUBLE / list_position(relevance, true) ELSE 0.0::DOUBLE END"


def means(names: dict[str, str]) -> str:
    return ", ".join(f"round(coalesce(avg({e}) FILTER (total_relevant > 0), 0.0) + 1e-10::DOUBLE, 6) AS {n}" for n, e in names.items())


_ALL = {"mrr": MRR} | {f"{n}_at_{k}": f(k) for n, f in (("ndcg", ndcg), ("recall", recall), ("precision", precision)) for k in (1, 3, 5, 10)}
_KEY = norm(tl("question"))
_PAIRS = f"""i AS (SELECT DISTINCT ON (qid) qid, {_KEY} AS key, doc_id, annotator, answer_span FROM g0),
pairs AS (SELECT a.key, a.qid AS qid_a, b.qid AS qid_b, a.doc_id AS doc_id_a, a.answer_span AS sa, b.answer_span AS sb FROM i a JOIN i b ON a.key = b.key AND a.qid < b.qid WHERE a.annotator IS DISTINCT FROM b.annotator)"""
_IOU = f"CASE WHEN len(list_distinct(list_concat({toks('sa')}, {toks('sb')}))) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_distinct({toks('sa')}), {toks('sb')}))::DOUBLE / len(list_distinct(list_concat({toks('sa')}, {toks('sb')}))) END"
_F1 = "CASE WHEN len(x) + len(y) = 0 THEN 1.0::DOUBLE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))), 0) / (len(x) + len(y)) END"
_NA, _NB = norm("sa"), norm("sb")
_STRESS_UP = "replace(replace(replace(replace(replace(upper(translate(question, 'iı', 'İI')), 'ﬁ', 'FI'), 'ﬂ', 'FL'), 'ﬀ', 'FF'), 'ﬃ', 'FFI'), 'ﬄ', 'FFL')"
_CORRECT = "coalesce(relevance[1], false)"
_CURVE = f"""r AS (SELECT top_score AS score, {_CORRECT} AS correct FROM pq WHERE top_score IS NOT NULL),
t AS (SELECT unnest(range(0, 21)) AS t),
curve AS (SELECT round(t / 20.0::DOUBLE, 3) AS threshold, round(count(*) FILTER (score >= t / 20.0::DOUBLE)::DOUBLE / count(*), 6) AS coverage,
  round(CASE WHEN count(*) FILTER (score >= t / 20.0::DOUBLE) > 0 THEN count(*) FILTER (correct AND score >= t / 20.0::DOUBLE)::DOUBLE / count(*) FILTER (score >= t / 20.0::DOUBLE) END, 6) AS selective_accuracy,
  count(*) FILTER (score >= t / 20.0::DOUBLE) AS answered, count(*) FILTER (score < t / 20.0::DOUBLE) AS escalated FROM r, t GROUP BY t)"""
_V = "coalesce(human_review.verdict, '')"


def _rate(what: str, of: str, name: str) -> str:
    return f"round(CASE WHEN count(*) FILTER ({of}) > 0 THEN count(*) FILTER (({what}) AND ({of}))::DOUBLE / count(*) FILTER ({of}) END, 6) AS {name}"


_FOUND, _HELD = "coalesce(span_retrieved, false)", "coalesce(abstained, false)"

ORACLE: dict[str, str] = {
    "tokenize_stem5": f"SELECT doc_id, len({toks('text')})::INT AS n, sha256(array_to_string({toks('text')}, ' ')) AS digest FROM documents",
    "tokenize_nostem": f"SELECT doc_id, len({toks('text', None)})::INT AS n, sha256(array_to_string({toks('text', None)}, ' ')) AS digest FROM documents",
    "turkish_lower": f"WITH {_GOLD} SELECT qid, {tl('question')} AS lowered FROM roots",
    "fold_ascii": f"WITH {_GOLD} SELECT qid, {fold('question')} AS folded FROM roots",
    "shouting": rf"WITH {_GOLD} SELECT qid, length(regexp_replace(question, '[^\p{{L}}]', '', 'g')) >= 6 AND length(regexp_replace(question, '[^\p{{Lu}}]', '', 'g')) >= 0.8 * length(regexp_replace(question, '[^\p{{L}}]', '', 'g')) AS shouting FROM roots",
    "slugify": f"SELECT doc_id, CASE WHEN s = '' THEN 'doc' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(regexp_replace(translate({tl('title')}, 'ışğüöç', 'isguoc'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents WHERE title IS NOT NULL)",
    "snippet": f"SELECT doc_id, CASE WHEN length(t) <= 72 THEN t ELSE substr(t, 1, 71) || '…' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)",
    "sha_digest": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
    "stress_variants": f"WITH {_GOLD} SELECT qid, 'original' AS variant, question AS text FROM roots UNION ALL SELECT qid, 'ascii', {fold('question')} FROM roots UNION ALL SELECT qid, 'caps', {_STRESS_UP} FROM roots UNION ALL SELECT qid, 'naive_lower', {low(_STRESS_UP)} FROM roots",
    "overlap_share": f"WITH {_GOLD} SELECT qid, round({overlap('question', 'answer_span')}, 6) AS overlap FROM g0",
    "normalize_vocab": rf"""WITH w AS (SELECT doc_id, unnest(l) AS form, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all({tl('text')}, '[\p{{L}}\p{{M}}]+') AS l FROM documents WHERE text IS NOT NULL)),
n AS (SELECT form, count(*) AS n, min((doc_id, pos)) AS first FROM w GROUP BY form)
SELECT fold, form FROM (SELECT {fold('form')} AS fold, form, row_number() OVER (PARTITION BY {fold('form')} ORDER BY n DESC, first) AS r FROM n) WHERE r = 1""",
    "chunk_fixed": f"WITH {fixed()} SELECT doc_id, chunk_no, body FROM chunk700",
    "chunk_size_sweep": "WITH " + ", ".join(fixed(n, n - 100) for n in (300, 500, 700, 1000, 1500)) + " " + " UNION ALL ".join(f"SELECT {n} AS size, count(*) AS chunks, sum(length(body))::BIGINT AS chars FROM chunk{n}" for n in (300, 500, 700, 1000, 1500)),
    "bm25_stats": f"WITH {_GOLD}, {fixed()}, {bm25(5, 10)} SELECT token, df::BIGINT AS df, round(idf, 6) AS idf FROM hits_i",
    "bm25_topk_stem5": f"WITH {_GOLD}, {fixed()}, {bm25(5, 10)} SELECT qid, rank::INT AS rank, doc_id, chunk_no, score FROM hits",
    "bm25_topk_nostem": f"WITH {_GOLD}, {fixed()}, {bm25(None, 10)} SELECT qid, rank::INT AS rank, doc_id, chunk_no, score FROM hits",
    "stem_sweep": f"WITH {_GOLD}, {fixed()}, {bm25(None, 1, False, name='h0')}, {bm25(4, 1, False, name='h4')}, {bm25(5, 1, False, name='h5')} " + " UNION ALL ".join(f"SELECT qid, rank::INT AS rank, doc_id, chunk_no, score, {n} AS stem FROM h{n}" for n in (0, 4, 5)),
    "dense_topk": "SELECT qid, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS qid, v.vec_id, round(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)), 6) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)) WHERE rank <= 10",
    "hybrid_rrf": f"""WITH {_GOLD}, {fixed()}, {bm25(5, 50, False, name='h5')}, {bm25(None, 50, False, name='h0')},
f AS (SELECT qid, doc_id, chunk_no, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 9) AS score FROM (SELECT * FROM h5 UNION ALL SELECT * FROM h0) GROUP BY ALL)
SELECT qid, rank::INT AS rank, doc_id, chunk_no, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_no) AS rank FROM f) WHERE rank <= 10""",
    "rerank_stub": f"""WITH {_GOLD}, {fixed()}, {bm25(5, 20, False)}
SELECT qid, r::INT AS rank, doc_id, chunk_no, s AS score FROM (SELECT qid, doc_id, chunk_no, length(body)::DOUBLE AS s, row_number() OVER (PARTITION BY qid ORDER BY length(body) DESC, rank) AS r FROM hits JOIN chunk700 USING (doc_id, chunk_no)) WHERE r <= 10""",
    "relevance": f"WITH {_GOLD}, {fixed()}, {_REL} SELECT qid, doc_id, chunk_no FROM rel",
    "total_relevant": f"WITH {_GOLD}, {fixed()}, {_REL} SELECT qid, coalesce(n, 0)::INT AS total_relevant FROM (SELECT DISTINCT qid FROM roots) LEFT JOIN (SELECT qid, count(*) AS n FROM (SELECT DISTINCT * FROM rel) GROUP BY qid) USING (qid)",
    "unscorable": f"WITH {_GOLD}, {fixed()}, {_REL} SELECT DISTINCT qid FROM roots WHERE qid NOT IN (SELECT qid FROM rel)",
    "unknown_documents": f"WITH {_GOLD} SELECT qid, doc_id FROM g0 WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "metrics_per_query": f"WITH {_PQ} SELECT run_id, question, ran_at, round({MRR}, 6) AS mrr, round({ndcg(10)}, 6) AS ndcg_at_10, round({ndcg(3)}, 6) AS ndcg_at_3, round({recall(5)}, 6) AS recall_at_5, round({precision(5)}, 6) AS precision_at_5 FROM pq",
    "metrics_runs": f"WITH {_PQ} SELECT run_id, count(*) AS queries, count(*) FILTER (total_relevant > 0) AS scored, {means(_ALL)} FROM pq GROUP BY run_id",
    "metrics_summary": f"""WITH {_GOLD}, {fixed()}, {_REL}, {bm25(5, 10)}, d AS (SELECT DISTINCT *, true AS rel FROM rel),
n AS (SELECT qid, count(*)::INT AS total FROM d GROUP BY qid),
a AS (SELECT qid, list(coalesce(rel, false) ORDER BY rank) AS relevance FROM hits LEFT JOIN d USING (qid, doc_id, chunk_no) GROUP BY qid),
p AS (SELECT qid, relevance, coalesce(total, 0) AS total_relevant FROM a LEFT JOIN n USING (qid))
SELECT 'fixed' AS chunking, 'bm25_stem5' AS retriever, count(*) AS queries, count(*) FILTER (total_relevant > 0) AS scored, {means({'ndcg_at_10': ndcg(10), 'recall_at_5': recall(5), 'mrr': MRR})} FROM p""",
    "percentile_nearest_rank": f"WITH {_PQ}, s AS (SELECT run_id, list_sort(list(latency_ms)) AS l FROM pq WHERE latency_ms IS NOT NULL GROUP BY run_id) SELECT run_id, "
    + ", ".join(f"l[(greatest(0, least(round_even({p / 100.0}::DOUBLE * len(l) + 0.5::DOUBLE, 0)::BIGINT - 1, len(l) - 1)) + 1)] AS p{p}" for p in (50, 95, 99))
    + " FROM s",
    "percentile_load": f"WITH {_PQ}, s AS (SELECT run_id, list_sort(list(latency_ms)) AS l FROM pq WHERE latency_ms IS NOT NULL GROUP BY run_id) SELECT run_id, l[(round_even(0.95::DOUBLE * (len(l) - 1), 0)::BIGINT + 1)] AS p95 FROM s",
    "paired_diff": f"""WITH {_PQ}, v AS (SELECT run_id, question, arg_max(round({ndcg(10)}, 6), (ran_at, round({ndcg(10)}, 6))) AS v FROM pq WHERE total_relevant > 0 GROUP BY ALL)
SELECT question, x.v AS a, y.v AS b, round(x.v - y.v, 6) AS diff FROM v x JOIN v y USING (question) WHERE x.run_id = 'run-001' AND y.run_id = 'run-002'""",
    "margin_score_confidence": f"""WITH {_GOLD}, {fixed()}, {bm25(5, 5)}
SELECT qid, round(CASE WHEN s1 > 0 THEN greatest(0.0::DOUBLE, (s1 - coalesce(s2, 0.0)) / s1) ELSE 0.0::DOUBLE END, 6) AS margin, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, s1)), 6) AS score
FROM (SELECT qid, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2 FROM hits GROUP BY qid)""",
    "abstain_sweep": f"WITH {_PQ}, {_CURVE} SELECT * FROM curve",
    "pick_threshold": f"""WITH {_PQ}, {_CURVE}, f AS (SELECT unnest([0.1, 0.2, 0.3, 0.9]::DOUBLE[]) AS floor)
SELECT floor, threshold, coverage, selective_accuracy, answered FROM (SELECT f.floor, c.*, row_number() OVER (PARTITION BY f.floor ORDER BY coverage DESC NULLS LAST, threshold) AS r FROM f LEFT JOIN curve c ON c.selective_accuracy >= f.floor AND c.answered >= 5) WHERE r = 1""",
    "fingerprint": "SELECT 'sha256:' || sha256(string_agg(l, chr(10) ORDER BY l)) AS fingerprint FROM (SELECT doc_id::VARCHAR || ':' || sha256(text) AS l FROM documents WHERE text IS NOT NULL)",
    "corpus_lock": "SELECT doc_id, title, revid, sha256(coalesce(text, '')) AS sha256, length(coalesce(text, ''))::INT AS chars FROM documents",
    "lock_drift": "SELECT CASE WHEN source = 'brosur' THEN 'added' ELSE 'missing' END AS kind, doc_id, title, NULL::INT AS delta FROM documents WHERE source IN ('brosur', 'forum-dokumu')",
    "audit_rederive": f"""WITH {_PQ}, d AS (SELECT run_id, avg({ndcg(10)}) AS derived FROM pq WHERE total_relevant > 0 GROUP BY run_id)
SELECT run_id, ndcg_at_10 AS reported, round(derived, 6) AS derived, CASE WHEN derived IS NULL THEN 'no evidence' WHEN ndcg_at_10 IS NULL OR abs(ndcg_at_10 - derived) > 1e-6 THEN 'mismatch' ELSE 'ok' END AS finding FROM runs LEFT JOIN d USING (run_id)""",
    "mixed_fingerprints": "SELECT model, count(DISTINCT corpus_fingerprint) AS fingerprints FROM runs WHERE corpus_fingerprint IS NOT NULL GROUP BY model HAVING count(DISTINCT corpus_fingerprint) > 1",
    "leaderboard": "SELECT dense_rank() OVER (ORDER BY coalesce(ndcg_at_10, 0.0) DESC)::INT AS place, model, run_id, chunking, retriever, ndcg_at_10 AS value FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ndcg_at_10 DESC NULLS LAST, run_id) AS r FROM runs) WHERE r = 1",
    "load_gold": f"WITH {_GOLD} SELECT DISTINCT qid FROM g0 WHERE {_V} <> 'rejected' AND (coalesce(review, '') <> 'needs-human' OR {_V} IN ('ok', 'fixed')) AND coalesce(source, '') <> 'llm-draft'",
    "validate_reviews": f"""WITH {_GOLD}, h AS (SELECT qid, coalesce(source = 'llm-draft', false) AS draft, human_review.verdict AS v, trim(coalesce(human_review.reviewer, '')) AS who, trim(coalesce(human_review.note, '')) AS note FROM g0 WHERE human_review IS NOT NULL)
SELECT DISTINCT qid, 'not_a_draft' AS rule FROM h WHERE NOT draft UNION SELECT qid, 'no_reviewer' FROM h WHERE draft AND who = '' UNION SELECT qid, 'unknown_verdict' FROM h WHERE draft AND coalesce(v, '') NOT IN ('ok', 'fixed', 'rejected') UNION SELECT qid, 'no_note' FROM h WHERE draft AND v IN ('fixed', 'rejected') AND note = ''""",
    "validate_articles": f"""WITH {_GOLD}, j AS (SELECT g.*, d.doc_id IS NOT NULL AS there, d.title, d.text FROM g0 g LEFT JOIN documents d USING (doc_id) WHERE {_V} <> 'rejected')
SELECT DISTINCT qid, 'no_article' AS rule FROM j WHERE NOT there UNION SELECT qid, 'other_title' FROM j WHERE there AND title IS DISTINCT FROM doc_title UNION SELECT qid, 'short_article' FROM j WHERE there AND coalesce(length(text), 0) < 800
UNION SELECT qid, 'span_absent' FROM j WHERE there AND NOT coalesce(contains({norm("coalesce(text, '')")}, {norm('answer_span')}), false)
UNION SELECT qid, 'second_span_absent' FROM j WHERE there AND second_annotation IS NOT NULL AND {_V} <> 'fixed' AND NOT coalesce(contains({norm("coalesce(text, '')")}, {norm('second_annotation.answer_span')}), false)""",
    "expand_embedded": f"WITH {_GOLD} SELECT DISTINCT * FROM (SELECT qid, second_of, annotator, answer_span FROM g0 UNION ALL SELECT qid || '#2', qid, second_annotation.annotator, second_annotation.answer_span FROM g0 WHERE second_annotation IS NOT NULL AND {_V} <> 'fixed' AND (qid || '#2') NOT IN (SELECT qid FROM g0 WHERE qid IS NOT NULL))",
    "pair_agreement": f"""WITH {_GOLD}, {_PAIRS}, b AS (SELECT *, {toks('sa')} AS x, {toks('sb')} AS y FROM pairs)
SELECT qid_a, qid_b, round({_IOU}, 6) AS iou, round({_F1}, 6) AS token_f1, ({_NA} <> '' AND {_NB} <> '' AND (contains({_NA}, {_NB}) OR contains({_NB}, {_NA}))) OR {_F1} >= 0.5 AS agree FROM b""",
    "agreement": f"""WITH {_GOLD}, {_PAIRS}, b AS (SELECT *, {toks('sa')} AS x, {toks('sb')} AS y FROM pairs), p AS (SELECT key, count(*) AS pairs, avg(round({_IOU}, 6)) AS iou, avg(round({_F1}, 6)) AS f1 FROM b GROUP BY key)
SELECT count(*) AS questions, sum(pairs)::BIGINT AS pairs, round(avg(iou), 6) AS mean_iou, round(avg(f1), 6) AS mean_token_f1 FROM p""",
    "kappa_per_chunking": f"""WITH {_GOLD}, {fixed()}, {_PAIRS}, j AS (SELECT qid_a, qid_b, coalesce(contains({norm('body')}, {_NA}), false)::INT AS x, coalesce(contains({norm('body')}, {_NB}), false)::INT AS y FROM pairs JOIN chunk700 ON doc_id = doc_id_a),
c AS (SELECT qid_a, qid_b, count(*)::DOUBLE AS n, sum((x = y)::INT)::DOUBLE AS s, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y FROM j GROUP BY ALL), e AS (SELECT *, x / n * (y / n) + (1 - x / n) * (1 - y / n) AS pe FROM c)
SELECT qid_a, qid_b, round(CASE WHEN pe >= 1.0 THEN 1.0::DOUBLE ELSE (s / n - pe) / (1 - pe) END, 6) + 0.0::DOUBLE AS kappa FROM e""",
    "check_draft": f"""WITH {_GOLD} SELECT DISTINCT qid, CASE WHEN NOT coalesce(ends_with(trim(question), '?'), false) THEN 'no_question_mark' WHEN coalesce(trim(answer_span), '') = '' THEN 'empty_span' WHEN length(trim(answer_span)) < 20 THEN 'short_span' WHEN length(trim(answer_span)) > 400 THEN 'long_span'
WHEN NOT coalesce(contains({norm('text')}, {norm('trim(answer_span)')}), false) THEN 'not_verbatim' WHEN {overlap('trim(question)', 'trim(answer_span)')} > 0.6 THEN 'copied' END AS problem FROM g0 JOIN documents USING (doc_id)""",
    "groundedness_rates": f"""WITH a AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM answers) SELECT model, count(*) AS queries, count(*) FILTER ({_FOUND}) AS span_retrieved, count(*) FILTER (NOT {_FOUND}) AS span_not_retrieved,
{_rate(f'NOT {_HELD}', _FOUND, 'answered_when_retrieved')}, {_rate('supported', f'{_FOUND} AND supported IS NOT NULL', 'grounded_when_answered')}, {_rate('answers_question', f'{_FOUND} AND supported IS NOT NULL', 'correct_when_answered')},
{_rate(_HELD, f'NOT {_FOUND}', 'abstained_when_not_retrieved')}, {_rate(f'NOT {_HELD}', f'NOT {_FOUND}', 'answered_when_not_retrieved')}, {_rate('answers_question', f'NOT {_FOUND} AND supported IS NOT NULL', 'correct_when_answered_without_span')},
{_rate(f'NOT {_HELD} AND supported IS NOT NULL AND NOT supported', f'NOT {_FOUND}', 'hallucination_rate')} FROM a GROUP BY model""",
    "beir_queries": f"WITH {_GOLD} SELECT qid AS _id, question AS text, answer_span, coalesce(source, 'human') AS source FROM roots",
    "beir_qrels": f"""WITH {_GOLD} SELECT qid AS "query-id", doc_id::VARCHAR AS "corpus-id", 1 AS score FROM roots""",
}
