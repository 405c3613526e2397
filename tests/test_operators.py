import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.operators import abstention as ab
from spanwise.operators import chunking as ch
from spanwise.operators import gold as gd
from spanwise.operators import groundedness as gr
from spanwise.operators import metrics as me
from spanwise.operators import provenance as pv
from spanwise.operators import retrieval as rt
from spanwise.operators import uncertainty as un

DOC = "doc_id long, title string, text string, url string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, x, None) for i, t, x in rows], DOC)


# chunking


def test_fixed_windows(spark):
    text = "x" * 1300
    d = docs(spark, (1, "A", text), (2, "B", None), (3, "C", ""), (4, "D", "short"))
    got = ch.chunk_fixed(d).orderBy("doc_id", "chunk_no").collect()
    assert [(r["doc_id"], r["chunk_no"], len(r["body"])) for r in got] == [(1, 0, 700), (1, 1, 700), (1, 2, 100)]
    assert ch.chunk_fixed(d.limit(0)).count() == 0


def test_fixed_drops_headings(spark):
    d = docs(spark, (1, "A", "== Giriş ==\n" + "kelime " * 20))
    assert "==" not in ch.chunk_fixed(d).first()["body"]


def test_sentence_packing(spark):
    text = " ".join(f"Bu {i}. değil ama uzun bir cümledir gerçekten{i}." for i in range(40))
    bodies = [r["body"] for r in ch.chunk_sentence(docs(spark, (1, "A", text))).orderBy("chunk_no").collect()]
    assert " ".join(bodies) == text
    assert all(len(b) <= 700 for b in bodies)
    long = "u" * 2000 + "."
    assert [r["body"] for r in ch.chunk_sentence(docs(spark, (1, "A", long))).collect()] == [long]


def test_heading_paths(spark):
    body = "Bu bölümde elli karakterden uzun bir metin bulunmaktadır, kesin."
    text = f"Giriş {body}\n== A ==\n{body}\n==== B ====\n{body}\n==== E ====\n{body}\n== C ==\n{body}"
    got = ch.chunk_hierarchical(docs(spark, (1, "T", text))).orderBy("chunk_no").collect()
    assert [r["heading_path"] for r in got] == ["T", "T > A", "T > A > B", "T > A > B > E", "T > C"]
    assert [r["chunk_no"] for r in got] == [0, 1, 2, 3, 4]
    assert ch.sections(docs(spark, (1, "T", text))).count() == 5
    assert ch.with_ids(ch.chunk_hierarchical(docs(spark, (1, "T", text)))).orderBy("chunk_no").first()["chunk_id"] == "1::0"


def test_very_long_text(spark):
    text = "Bir cümle daha. " * 20000
    assert ch.chunk_fixed(docs(spark, (1, "A", text))).count() == math.ceil((len(text) - 1) / 600)
    assert ch.chunk_sentence(docs(spark, (1, "A", text))).count() > 400


# retrieval


def brute_bm25(bodies, question, k1=1.5, b=0.75):
    n = len(bodies)
    avg = sum(map(len, bodies)) / n
    df = {}
    for x in bodies:
        for w in set(x):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: (0.25 * mean if v < 0 else v) for w, v in raw.items()}
    return [sum(idf.get(w, 0) * x.count(w) * (k1 + 1) / (x.count(w) + k1 * (1 - b + b * len(x) / avg)) for w in question if w in x) for x in bodies]


def test_bm25_against_brute_force(spark):
    words = ["şeker", "kanda", "böbrek", "mide", "ağrı", "ilaç", "doktor", "uyku"]
    rng = np.random.default_rng(1)
    bodies = [[words[i] for i in rng.integers(0, len(words), rng.integers(3, 12))] for _ in range(30)]
    chunks = spark.createDataFrame([(i // 3, i % 3, " ".join(b)) for i, b in enumerate(bodies)], "doc_id long, chunk_no int, body string")
    q = spark.createDataFrame([("a", "şeker şeker uyku"), ("b", "bilinmez"), ("c", None)], "qid string, question string")
    got = rt.bm25_topk(chunks, q, 5, None).orderBy("qid", "rank").collect()
    want = brute_bm25(bodies, ["şeker", "şeker", "uyku"])
    best = sorted(range(30), key=lambda i: (-round(want[i], 6), i))[:5]
    assert [(r["doc_id"] * 3 + r["chunk_no"]) for r in got if r["qid"] == "a"] == best
    assert [r["score"] for r in got if r["qid"] == "a"] == pytest.approx([want[i] for i in best], abs=1e-6)
    for x in "bc":  # nothing matches: the first chunks, score 0
        assert [(r["doc_id"], r["chunk_no"], r["score"]) for r in got if r["qid"] == x] == [(0, 0, 0.0), (0, 1, 0.0), (0, 2, 0.0), (1, 0, 0.0), (1, 1, 0.0)]


def test_dense_and_ties(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in rt.dense_topk(e, q, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (3, 0.0)]


def test_fusion_and_rerank(spark):
    h = "qid string, rank int, doc_id long, chunk_no int, score double"
    a = spark.createDataFrame([("q", 1, 1, 0, 9.0), ("q", 2, 2, 0, 8.0)], h)
    b = spark.createDataFrame([("q", 1, 2, 0, 9.0), ("q", 2, 3, 0, 8.0)], h)
    assert [r["doc_id"] for r in rt.fuse([a, b], 3).orderBy("rank").collect()] == [2, 1, 3]
    chunks = spark.createDataFrame([(1, 0, "x"), (2, 0, "xxxx"), (3, 0, "xxxx")], "doc_id long, chunk_no int, body string")
    hits = spark.createDataFrame([("q", 1, 1, 0, 1.0), ("q", 2, 2, 0, 1.0), ("q", 3, 3, 0, 1.0)], h)
    q = spark.createDataFrame([("q", "?")], "qid string, question string")
    got = rt.rerank(hits, q, chunks, lambda pairs: [len(p) for _, p in pairs], 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [2, 3, 1]
    assert rt.rerank(hits.limit(0), q, chunks, lambda pairs: [], 3).count() == 0


def test_ask(spark):
    g = spark.createDataFrame([("q1", 1, "Şeker nedir?", "tatlı bir şeydir")], "qid string, doc_id long, question string, answer_span string")
    chunks = spark.createDataFrame([(1, 0, "şeker tatlı bir şeydir"), (2, 0, "mide")], "doc_id long, chunk_no int, body string")
    got = rt.ask("q1", g, chunks, 2).where("retriever = 'bm25_stem5'").orderBy("rank").collect()
    assert [(r["doc_id"], r["relevant"]) for r in got] == [(1, True), (2, False)]


# metrics


def value(spark, rel, total, col):
    df = spark.createDataFrame([(rel, total)], "relevance array<boolean>, total_relevant int")
    return df.select(col(F.col("relevance"), F.col("total_relevant")).alias("x")).first()["x"]


def test_metrics_closed_form(spark):
    assert value(spark, [True, True], 6, lambda r, t: me.ndcg_at(r, t, 2)) == pytest.approx(1.0)
    assert value(spark, [True, False, True, True], 4, lambda r, t: me.recall_at(r, t, 2)) == 0.25
    assert value(spark, [], 0, lambda r, t: me.ndcg_at(r, t, 10)) == 0.0
    assert value(spark, [False, True], 1, lambda r, t: me.reciprocal_rank(r)) == 0.5
    assert value(spark, [True], 1, lambda r, t: me.precision_at(r, 5)) == 0.2
    assert value(spark, [True], 1, lambda r, t: me.precision_at(r, 0)) == 0.0
    with pytest.raises(ValueError):
        me.metric("map@3", F.lit(None), F.lit(1))


def test_relevance_end_to_end(spark):
    d = docs(spark, (1, "A", "== H ==\n" + "Bu cümle yalnızca elli karakteri geçmek için yazıldı. Kan  şekeri yükselir."))
    g = spark.createDataFrame([("q", 1, "ne olur", "kan şekeri YÜKSELİR"), ("z", 1, "yok", "burada olmayan"), ("n", 1, "boş", None)], "qid string, doc_id long, question string, answer_span string")
    c = ch.chunk_fixed(d)
    got = {r["qid"]: (r["total_relevant"], r["relevance"][:1]) for r in me.per_query(rt.bm25_topk(c, g, 3), c, g).collect()}
    assert got["z"] == (0, [False]) and got["n"] == (0, [False])
    assert {r["qid"] for r in me.unscorable(c, g).collect()} >= {"z", "n"}


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 59)] + [("b", None)], "k string, v double")
    r = me.nearest_rank(df, ["k"], "v", (95,)).collect()
    assert [(x["k"], x["p95"]) for x in r] == [("a", 56.0)]
    assert me.load_percentile(df, ["k"], "v", 95).first()["p95"] == 55.0


# uncertainty


def test_intervals(spark):
    assert un.interval(np.array([])) == (0.0, 0.0)
    assert un.interval(np.array([0.4])) == (0.4, 0.4)
    v = np.random.default_rng(0).random(58)
    rng = np.random.default_rng(un.SEED)
    whole = np.quantile(v[rng.integers(0, 58, size=(un.RESAMPLES, 58))].mean(axis=1), [0.025, 0.975])
    assert un.interval(v) == pytest.approx(tuple(whole))
    df = spark.createDataFrame([("r", str(i), float(x)) for i, x in enumerate(v)], "run string, question string, value double")
    sql = un.bootstrap_sql(df, ["run"], "value", "question", 400).first()
    assert abs(sql["low"] - whole[0]) < 0.03 and abs(sql["high"] - whole[1]) < 0.03


def test_recommend(spark):
    rng = np.random.default_rng(3)
    base = rng.random(60)
    rows = []
    for run, shift in (("best", 0.30), ("near", 0.295), ("bad", 0.0)):
        rows += [(run, f"q{i}", float(min(1, b * 0.6 + shift + rng.normal(0, 0.05)))) for i, b in enumerate(base)]
    s = spark.createDataFrame(rows, "run string, question string, value double")
    c = spark.createDataFrame([("best", 90.0, None), ("near", 10.2, None), ("bad", 1.0, None)], "run string, p95 double, index_seconds double")
    got = {r["run"]: r for r in un.recommend(s, c, resamples=2000).collect()}
    assert got["near"]["tied"] and got["near"]["recommended"]
    assert not got["bad"]["tied"] and not got["best"]["recommended"]


# abstention


def test_confidence_and_curve(spark):
    h = spark.createDataFrame([("a", 1, 0.8), ("a", 2, 0.6), ("b", 1, -1.0), ("c", 1, 2.0)], "qid string, rank int, score double")
    got = {r["qid"]: (round(r["margin"], 6), r["score"]) for r in ab.confidences(h).collect()}
    assert got == {"a": (0.25, 0.8), "b": (0.0, 0.0), "c": (1.0, 1.0)}
    r = spark.createDataFrame([(0.05 * i, i > 10) for i in range(21)], "score double, correct boolean")
    curve = ab.sweep(r).orderBy("threshold").collect()
    assert curve[0]["answered"] == 21 and curve[-1]["answered"] == 1
    best = ab.pick(ab.sweep(r), (0.7, 2.0)).orderBy("floor").collect()
    assert best[0]["selective_accuracy"] >= 0.7 and best[1]["threshold"] is None
    empty = ab.sweep(r.limit(0)).collect()
    assert len(empty) == 21 and all(x["coverage"] == 0.0 and x["selective_accuracy"] is None for x in empty)


# provenance


def test_fingerprint_and_drift(spark):
    s = "doc_id string, title string, text string, revid long"
    a = spark.createDataFrame([("2", "B", "bbb", 1), ("1", "A", "aaa", 1)], s)
    b = spark.createDataFrame([("1", "other title", "aaa", 9), ("2", "B", "bbb", 1)], s)
    assert pv.fingerprint(a).first() == pv.fingerprint(b).first()
    assert pv.fingerprint_tree(a).first() == pv.fingerprint_tree(b).first()
    now = spark.createDataFrame([("1", "A", "a" * 203, 1), ("3", "C", "c", 1)], s)
    assert pv.fingerprint(now).first() != pv.fingerprint(a).first()
    got = {(r["kind"], r["doc_id"], r["delta"]) for r in pv.drift(pv.lock(a), now).collect()}
    assert got == {("missing", "2", None), ("added", "3", None), ("changed", "1", 200)}


def test_audit(spark):
    runs = spark.createDataFrame([("r1", 0.99), ("r2", 1.0), ("r3", 0.5)], "run_id string, ndcg_at_10 double")
    rec = spark.createDataFrame([("r1", [False, True], 1), ("r2", [True], 1), ("r2", [False], 0)], "run_id string, relevance array<boolean>, total_relevant int")
    assert {r["run_id"]: r["finding"] for r in pv.audit(runs, rec).collect()} == {"r1": "mismatch", "r2": "ok", "r3": "no evidence"}


# question sets

GOLD = "qid string, question string, doc_id string, doc_title string, answer_span string, annotator string, second_of string, source string, second_annotation struct<annotator:string,answer_span:string>, human_review struct<reviewer:string,verdict:string,note:string>, pos int"


def gold(spark, *rows):
    full = [dict(qid=None, question="Kaç saat uyunur?", doc_id="1", doc_title="T", answer_span="yedi saat yeterlidir derler", annotator="a", second_of=None, source=None, second_annotation=None, human_review=None, pos=i) | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.split()[0]] for f in ["qid", "question", "doc_id", "doc_title", "answer_span", "annotator", "second_of", "source", "second_annotation", "human_review", "pos"]) for r in full], GOLD)


def test_validation_rules(spark):
    g = gold(
        spark,
        {"qid": "a"}, {"qid": "a", "question": "Başka soru nedir?"}, {"qid": "b", "second_of": "zz", "question": "Üçüncü mü?"}, {"qid": "c", "second_of": "a", "doc_id": "2"},
        {"qid": "d", "second_of": "a", "question": "Farklı bir soru?"}, {"qid": "e"}, {"qid": "f", "question": "soru değil"}, {"qid": "g", "question": "Mide yanması nedir?", "answer_span": "mide yanması nedir"}, {"qid": "h", "answer_span": " "},
    )
    got = {(r["qid"], r["rule"]) for r in gd.violations(g).collect()}
    assert got == {("a", "duplicate_qid"), ("b", "unknown_root"), ("c", "other_document"), ("d", "other_question"), ("e", "duplicate_question"), ("f", "no_question_mark"), ("g", "copied"), ("h", "missing")}


def test_reviews_and_articles(spark):
    g = gold(
        spark,
        {"qid": "a", "source": "human", "human_review": ("r", "ok", None)}, {"qid": "b", "source": "llm-draft", "human_review": (" ", "maybe", None)}, {"qid": "c", "source": "llm-draft", "human_review": ("r", "fixed", "")},
        {"qid": "d", "doc_id": "9"}, {"qid": "e", "human_review": ("r", "rejected", "x"), "doc_id": "9"},
    )
    assert {(r["qid"], r["rule"]) for r in gd.reviews(g).collect()} == {("a", "not_a_draft"), ("b", "no_reviewer"), ("b", "unknown_verdict"), ("c", "no_note"), ("e", "not_a_draft")}
    d = spark.createDataFrame([("1", "Other", "kısa")], "doc_id string, title string, text string")
    got = {(r["qid"], r["rule"]) for r in gd.against_articles(g.where("qid in ('a', 'd', 'e')"), d).collect()}
    assert got == {("a", "other_title"), ("a", "short_article"), ("a", "span_absent"), ("d", "no_article")}


def test_agreement(spark):
    g = gold(spark, {"qid": "a", "second_annotation": ("m", "yedi saat")}, {"qid": "b", "annotator": "b", "second_of": "a", "answer_span": "yedi saat yeterlidir"}, {"qid": "c", "annotator": None, "second_of": "a"}, {"qid": "d", "annotator": None, "second_of": "a"})
    assert {r["qid"] for r in gd.with_embedded(g).collect()} == {"a", "b", "c", "d", "a#2"}
    pairs = gd.annotation_pairs(g)
    assert {(r["qid_a"], r["qid_b"]) for r in pairs.collect()} == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")}
    one = gd.agreement(pairs).first()
    assert one["questions"] == 1 and one["pairs"] == 5
    k = spark.createDataFrame([(0.0, 0, 0, 0), (4.0, 4, 4, 4), (4.0, 2, 2, 2)], "n double, s int, a int, b int")
    got = [r["k"] for r in k.select(gd.kappa(F.col("n"), F.col("s"), F.col("a"), F.col("b")).alias("k")).collect()]
    assert got == [None, 1.0, 0.0]


def test_drafts(spark):
    d = docs(spark, (1, "Uyku Düzeni", "Yetişkin bir kişiye yedi saat uyku yeterlidir, fazlası gerekmez."))
    rows = [(1, 0, "Kaç saat?", "yedi saat uyku yeterlidir", "YEDİ saat uyku"), (1, 1, "Soru değil", "yedi saat uyku yeterlidir", ""), (1, 2, "Ne kadar sürmeli?", "metinde geçmeyen bir alıntı", ""), (1, 3, "Hangisi yeter?", "yedi saat uyku yeterlidir", "bambaşka")]
    got = gd.build_items(spark.createDataFrame(rows, "doc_id long, pos int, question string, span string, second_span string"), d).orderBy("qid").collect()
    assert [r["qid"] for r in got] == ["d-uyku-duzeni-001", "d-uyku-duzeni-002"]
    assert [r["agreed"] for r in got] == [False, False] or got[1]["second_span"] is None
    made = gd.draft(d, lambda t, x: [("a?", "s1"), ("b?", "s2")], lambda t, x, q: ["only one"]).orderBy("pos").collect()
    assert [r["second_span"] for r in made] == ["only one", ""]


# groundedness


def test_verdicts():
    assert gr.parse_verdict('so {"x": 1} {"supported": true, "answers_question": false, "reason": "r"} end')["reason"] == "r"
    with pytest.raises(ValueError):
        gr.parse_verdict('{"supported": true}')


def test_groundedness_end_to_end(spark):
    chunks = spark.createDataFrame([(1, 0, "T", "kan şekeri yükselir"), (2, 0, "U", "mide yanar")], "doc_id long, chunk_no int, heading_path string, body string")
    g = spark.createDataFrame([("a", "soru bir", 1, "şekeri yükselir"), ("b", "soru iki", 9, "yok")], "qid string, question string, doc_id long, answer_span string")
    hits = spark.createDataFrame([("a", 1, 1, 0), ("b", 1, 2, 0), ("b", 2, 1, 0)], "qid string, rank int, doc_id long, chunk_no int")
    r = gr.evaluate(g, hits, chunks, lambda q, p: "BILGI_YOK." if q.endswith("iki") else "cevap: " + p, lambda q, a, s, p: '{"supported": true, "answers_question": true}').collect()
    got = {x["qid"]: x for x in r}
    assert got["a"]["span_retrieved"] and got["a"]["supported"] and got["a"]["answer"] == "cevap: [1] T\nkan şekeri yükselir"
    assert got["b"]["abstained"] and got["b"]["supported"] is None and not got["b"]["span_retrieved"]


def test_rates_keep_populations_apart(spark):
    s = "span_retrieved boolean, abstained boolean, supported boolean, answers_question boolean"
    df = spark.createDataFrame([(True, False, True, True), (True, True, None, None), (False, False, False, True), (False, False, None, None), (None, True, None, None)], s)
    r = gr.rates(df).first()
    assert (r["queries"], r["span_retrieved"], r["span_not_retrieved"]) == (5, 2, 3)
    assert (r["answered_when_retrieved"], r["grounded_when_answered"]) == (0.5, 1.0)
    assert r["hallucination_rate"] == pytest.approx(1 / 3, abs=1e-6)
    assert gr.rates(df.limit(0)).first()["hallucination_rate"] is None


def test_flips(spark):
    rows = [("x", str(i), i < 6) for i in range(8)] + [("y", str(i), False) for i in range(8)]
    r = gr.flips(spark.createDataFrame(rows, "model string, qid string, abstained boolean"), "model", "x", "y", []).first()
    assert (r["only_a"], r["only_b"]) == (6, 0) and r["p_value"] == pytest.approx(2 / 64, abs=1e-6)
