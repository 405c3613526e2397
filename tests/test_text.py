import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwise.functions import text as T
from spanwise.operators import normalizer as nz


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(expr(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "lowered"),
    [("İLTİHAP", "iltihap"), ("ISIRIK", "ısırık"), ("İLTİHAP", "iltihap"), ("", ""), (None, None)],
)
def test_turkish_lower(spark, text, lowered):
    assert one(spark, T.turkish_lower, text) == lowered


def test_tokenize(spark):
    assert one(spark, T.tokenize, "diyabetin ve diyabete") == ["diyab", "diyab"]
    assert one(spark, lambda c: T.tokenize(c, None), "The Şeker, şeker a 12") == ["şeker", "şeker", "12"]
    assert one(spark, T.tokenize, None) == []
    assert one(spark, T.tokenize, "") == []


def test_fold_slug_snippet(spark):
    assert one(spark, T.fold_ascii, "çğıöşü ÇĞİÖŞÜ") == "cgiosu CGIOSU"
    assert one(spark, T.slugify, "İstanbul'un Suyu!") == "istanbul-un-suyu"
    assert one(spark, T.slugify, "???") == "doc"
    assert one(spark, T.snippet, "a" * 80) == "a" * 71 + "…"
    assert one(spark, T.snippet, " a \n b ") == "a b"


def test_stress(spark):
    v = {k: one(spark, lambda c, k=k: T.stress_variants(c)[k], "Işık için şişe") for k in ("ascii", "caps", "naive_lower")}
    assert v["ascii"] == "Isik icin sise"
    assert v["caps"] == "IŞIK İÇİN ŞİŞE"
    assert "i̇" in v["naive_lower"]


def test_shouting(spark):
    assert one(spark, T.is_shouting, "ŞEKER HASTALIĞI")
    assert not one(spark, T.is_shouting, "DNA")


def test_overlaps(spark):
    assert one(spark, T.overlap, "", "x") == 1.0
    assert one(spark, T.span_iou, "", "") == 1.0
    assert one(spark, T.span_f1, "", "") == 1.0
    assert one(spark, T.span_f1, "şeker", "") == 0.0
    assert one(spark, T.span_f1, "şeker şeker tuz", "şeker tuz tuz") == pytest.approx(2 / 3)
    assert one(spark, T.passes_agree, "kan şekeri yükselir", "Kan  şekeri yükselir ve düşer")
    assert not one(spark, T.passes_agree, "böbrek taşı", "mide yanması")


@pytest.mark.parametrize(
    ("text", "sentences"),
    [
        ("Dr. Ali geldi. Gitti.", ["Dr. Ali geldi.", "Gitti."]),
        ("Robert W. Holley buldu. Sonra gitti.", ["Robert W. Holley buldu.", "Sonra gitti."]),
        ("Padişah XIV. Louis öldü! Evet.", ["Padişah XIV. Louis öldü!", "Evet."]),
        ("1. madde var. Bitti", ["1. madde var.", "Bitti"]),
        ("vitaminler D ve E. Sonraki cümle.", ["vitaminler D ve E.", "Sonraki cümle."]),
        ("", []),
    ],
)
def test_chunker_sentences(spark, text, sentences):
    assert one(spark, T.split_sentences, text) == sentences


def test_split_model():
    assert T.split_model("gpt") == ("anthropic", "gpt")
    assert T.split_model("openai:gpt") == ("openai", "gpt")
    with pytest.raises(ValueError):
        T.split_model("nobody:x")


@pytest.fixture(scope="module")
def vocab(spark):
    docs = spark.createDataFrame([(1, "Sigara içmek akciğeri etkiler. Uzun sürer, uzun sürer."), (2, "şeker şeker seker")], "doc_id long, text string")
    return nz.vocabulary(docs).cache()


@pytest.mark.parametrize(
    ("asked", "restored"),
    [
        ("sigara icmek akcigeri nasil etkiler", "sigara içmek akciğeri nasil etkiler"),
        ("OKB nasil tedavi edilir", "OKB nasil tedavi edilir"),
        ("uzun surer mi?", "uzun sürer mi?"),
        ("seker", "şeker"),
        ("Seker!", "Şeker!"),
        ("", ""),
        (None, None),
    ],
)
def test_normaliser(spark, vocab, asked, restored):
    q = spark.createDataFrame([("q", asked)], "qid string, question string")
    assert nz.normalise_questions(q, vocab).first()["normalised"] == restored


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abcçgğıiİIoöşŞuü ,.?é", max_size=30), min_size=1, max_size=20))
def test_normaliser_only_adds_marks(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    docs = spark.createDataFrame([(1, "çok güzel şişe ağaç ışık")], "doc_id long, text string")
    q = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "qid string, question string")
    v = nz.vocabulary(docs)
    got = {r["qid"]: r["normalised"] for r in nz.normalise_questions(q, v).collect()}
    again = spark.createDataFrame(list(got.items()), "qid string, question string")
    assert {r["qid"]: r["normalised"] for r in nz.normalise_questions(again, v).collect()} == got
    plain = str.maketrans("çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU")
    for i, t in enumerate(texts):
        fold = lambda s: unicodedata.normalize("NFC", s).translate(plain).replace("̇", "").lower()
        assert fold(got[str(i)]) == fold(t)
