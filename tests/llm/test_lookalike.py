import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwise.llm.lookalike import canonical_text, departing_fields, skeleton, skeleton_words, transducer


@pytest.mark.parametrize(
    ("text", "canonical"),
    [
        ("ｄａğ köyü ３１,2 mg", "dağ köyü 31,2 mg"),
        ("öneri i̇zlem", "öneri izlem"),
        ("ﬁziksel taraﬂı", "fiziksel taraflı"),
        ("cidd​iye ba­sıl﻿dı", "ciddiye basıldı"),
        ("ve\u00a0diyet\u2009test", "ve diyet test"),
        ("Ηulνamuzan сіddіуе", "Hulvamuzan ciddiye"),
        ("Мiркодан", "Миркодан".replace("и", "і")),
    ],
)
def test_canonical(text, canonical):
    t = transducer()
    assert t(text) == canonical
    assert t.departs(text)


@pytest.mark.parametrize(
    "text",
    ["Geçmiş olsun 👩‍⚕️ simgesi", "Суточная доза α-блокатор", "治疗ＡＢＣ患者每日剂量", "plain\ttext\r\nline", "इस रोग का वर्णन ज़रूरत", "如果没有，口干！", "ขนาดยาต่อวัน", "قالت الممرضة: «نبدأ»", "", None],
)
def test_kept(text):
    t = transducer()
    assert not t.departs(text)
    assert text is None or t(text) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aşiİı ̧̇​‍ａ９ﬁсеоα👩⚕️.", max_size=40))
def test_second_pass_changes_nothing(text):
    t = transducer()
    once = t(text)
    assert t(once) == once
    assert unicodedata.is_normalized("NFC", once)


def test_columns_and_fields(spark):
    df = spark.createDataFrame([("q1", "ｄağ", "temiz", 1), ("q2", None, "", 1)], "qid string, question string, answer_span string, departs int")
    got = canonical_text(df, "question").orderBy("qid").collect()
    assert (got[0]["canonical"], got[0]["departs"], got[1]["canonical"], got[1]["departs"]) == ("dağ", True, None, False)
    assert [tuple(r) for r in departing_fields(df, "qid", ["question", "answer_span"]).collect()] == [("q1", "question")]
    assert departing_fields(df.limit(0), "qid", ["question"]).count() == 0


def test_skeleton(spark):
    df = spark.createDataFrame([("İĞNE, Ｄağ’ın 21,2 post-op сеker!",), (None,), ("...",)], "t string")
    assert [r["s"] for r in df.select(skeleton(F.col("t")).alias("s")).collect()] == ["igne dagin 212 postop ceker", None, ""]
    assert [r["s"] for r in df.select(skeleton_words(F.col("t")).alias("s")).collect()][1:] == [[], []]


@pytest.mark.parametrize(("text", "mixed"), [("5 \u03bcg", True), ("Дom", True), ("мα", True), ("βета", True), ("дозаω\u0301", True), ("д\u200bo", True), ("5 \u00b5g", False), ("α-блокатор", False), ("β testi, доза", False), ("ὑγίεια", False)])
def test_mixed_scripts_whether_mapped_or_not(text, mixed):
    assert transducer().departs(text) == mixed


@pytest.mark.parametrize("text", ["\u1eb9\u0301", "m\u0304", "\u025b\u0303", "\u0395\u03bb\u03bb\u03b7\u03bd\u03b9\u03ba\u03acc", "1\ufe0f\u20e3", "\u0915\u093c", "\u00e1\u0327"])
def test_marks_stay_behind_their_letter(text):
    """Letters with marks that have no composed form are other letters than those without; words that can't be brought to one script stay."""
    assert transducer()(text) == text


@pytest.mark.parametrize(("text", "canonical"), [(" \u0301", " "), ("1\u0301", "1"), ("\u0301a", "a"), ("i\u0307\u0301", "\u00ed"), ("e\u200b\u0301", "\u00e9"), ("=\u0338", "\u2260"), ("\u1100\u1161\u11a8", "\uac01"), ("\u212b", "\u00c5"), ("a\u0307\u0327", "\u0227\u0327")])
def test_clusters(text, canonical):
    assert transducer()(text) == canonical
    assert transducer().departs(text)


def test_every_input_leads_to_a_fixed_point():
    t = transducer()
    inputs = [*t.single, *t.pairs, *(x for table in t.table.values() for x in table)]
    words = [f"ab{x}cd" for x in inputs] + [f"аб{x}вг" for x in inputs] + [f"αβ{x}γδ" for x in inputs]
    for x in inputs + words:
        y = t(x)
        assert t(y) == y and unicodedata.is_normalized("NFC", y), ascii(x)


def test_conflicts_are_found(monkeypatch):
    from spanwise.llm import lookalike

    monkeypatch.setattr(lookalike, "GREEK_LATIN", ("αA", "Aa"))
    with pytest.raises(ValueError, match="input again"):
        lookalike.Transducer()
