import json

import pytest
from pyspark.sql import functions as F

from spanwise.sources import corpus as src


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_array(spark, tmp_path):
    p = write(tmp_path / "c.json", json.dumps([{"doc_id": "2", "text": "b"}, {"_id": "1", "title": "", "text": "a", "url": "u", "more": 1}]))
    got = src.load_corpus(spark, p).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["title"], r["url"]) for r in got] == [("1", "1", "u"), ("2", "2", "")]


def test_jsonl_and_beir_folder(spark, tmp_path):
    good = '{"_id": "1", "title": "T", "text": "a"}\n\n{"_id": "2", "text": "b"}\n'
    write(tmp_path / "corpus.jsonl", good)
    assert src.load_corpus(spark, str(tmp_path)).count() == 2
    bad = write(tmp_path / "bad" / "x.jsonl", good + "{broken\n")
    with pytest.raises(src.SourceError, match="broken"):
        src.load_corpus(spark, bad)


def test_folder(spark, tmp_path):
    write(tmp_path / "bir.md", "x" * 500)
    write(tmp_path / "nested" / "iki.TXT", " " + "y" * 500 + "\n")
    write(tmp_path / "kisa.txt", "z")
    write(tmp_path / "other.csv", "z" * 500)
    got = src.load_corpus(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["title"], len(r["text"])) for r in got] == [("bir.md", "bir", 500), ("nested/iki.TXT", "iki", 500)]


def test_invariants(spark, tmp_path):
    for name, rows, what in (("a", [{"doc_id": "1", "text": "x"}] * 2, "2 times"), ("b", [{"text": "x"}], "without id"), ("c", [], "no documents")):
        with pytest.raises(src.SourceError, match=what):
            src.load_corpus(spark, write(tmp_path / f"{name}.json", json.dumps(rows)))


def test_gold_files(spark, tmp_path):
    item = {"qid": "a", "question": "s?", "doc_id": "1", "doc_title": "T", "answer_span": "x"}
    write(tmp_path / "b.json", json.dumps([item | {"qid": "b", "review": "needs-human", "source": "llm-draft"}]))
    write(tmp_path / "a.json", json.dumps([item, item | {"qid": "c", "human_review": {"reviewer": "r", "verdict": "rejected", "note": "n"}}, item | {"qid": "d", "source": "llm-draft"}]))
    g = src.read_gold(spark, str(tmp_path))
    assert g.count() == 4
    assert {r["qid"] for r in src.usable(g).collect()} == {"a"}
    assert {r["qid"] for r in src.usable(g, drafts=True).collect()} == {"a", "d"}


def test_topics(spark):
    g = spark.createDataFrame([("B",), ("Z",), ("C",), (None,)], "doc_title string")
    assert [r["title"] for r in src.topics(["Z", "A"], g).collect()] == ["Z", "A", "B", "C"]


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("fixed", "hybrid_rrf", "q", 1.0), ("sentence", "dense", "q", 2.0)], "chunking string, retriever string, qid string, v double")
    src.write_results(df, str(tmp_path / "r"))
    got = src.read_results(spark, str(tmp_path / "r")).where("chunking = 'fixed'").collect()
    assert [(r["retriever"], r["v"]) for r in got] == [("hybrid_rrf", 1.0)]
    write(tmp_path / "f" / "perquery_fixed_bm25_stem5.json", json.dumps([{"question": "q", "relevance": [True], "total_relevant": 1}]))
    r = src.read_result_files(spark, str(tmp_path / "f" / "perquery_*.json")).first()
    assert (r["chunking"], r["retriever"], r["total_relevant"]) == ("fixed", "bm25_stem5", 1)


def test_beir_export(spark):
    d = spark.createDataFrame([(1, "T", "body text", "u"), (2, "U", "other", None)], "doc_id long, title string, text string, url string")
    g = spark.createDataFrame([("q", "s?", 1, "body", None)], "qid string, question string, doc_id long, answer_span string, source string")
    corpus, queries, qrels = src.beir(d, g)
    assert corpus.count() == 2 and queries.first()["source"] == "human"
    assert qrels.first().asDict() == {"query-id": "q", "corpus-id": "1", "score": 1}
    with pytest.raises(src.SourceError, match="q -> 9"):
        src.beir(d, g.withColumn("doc_id", F.lit(9).cast("long")))
    chunks = spark.createDataFrame([(1, 0, "T", "body text", ""), (1, 1, "T", "no", "")], "doc_id long, chunk_no int, heading_path string, body string, url string")
    _, q, rel = src.beir_passages(chunks, g)
    assert q.count() == 1 and rel.first()["corpus-id"] == "1::0"


def test_cache_computes_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def compute(todo):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b.assign(value=b["t"].str.len().astype("float64"))[["__key", "value"]]

        return todo.mapInPandas(run, "__key string, value double")

    df = spark.createDataFrame([("a",), ("bb",), ("a",)], "t string")
    for _ in range(2):
        assert sorted(r["value"] for r in src.cached_column(df, str(tmp_path / "c"), "m", "t", compute).collect()) == [1.0, 1.0, 2.0]
    assert seen.value == 2
