import os

import pytest
from pyspark.sql import functions as F

from spanwise.llm import language as L

TABLES = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, seg_no int"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_held_out_accuracy(spark):
    d = spark.read.parquet(f"{TABLES}/documents.parquet")
    model = L.train(d, per_label=40)
    s = L.segments(d, model, keep=("lang",)).where("n_segs = 1").withColumn("y", L.plain_label(F.col("lang"))).where("y is not null")
    n = s.count()
    # a few labels of the table are wrong by design
    assert s.where("y = seg_lang").count() / n > 0.9


def rows():
    tr = "Dengeli beslenme ve düzenli uyku yorgunluk riskini azaltır. Günlük doz gebelerde yarıya indirilir. Hasta olumlu yanıt verdi."
    en = "The daily dose lies between two values for smokers. Patients were asked to repeat the test. Creams are not enough when the cough lasts."
    ru = "Суточная доза составляет половину для детей. Без лечения кашель может длиться несколько недель. Болезнь описал доктор."
    return {"tr": tr, "en": en, "ru": ru}


def test_segments_and_cases(spark):
    t = rows()
    train = [(i * 3 + k, t[x], x, 0) for i in range(4) for k, x in enumerate(t)]
    cases = [(100, t["tr"], "tr-TR", 0), (101, t["tr"], None, 0), (102, t["en"], "tr", 0), (103, t["tr"] + "\n\n" + t["ru"], "tr", 0), (104, None, None, 0), (105, "", "tr", 0), (106, "12 -- 34", None, 0), (107, t["tr"].translate(str.maketrans("çğıöşü", "cgiosu")), "tr", 0), (108, t["en"], "ENG", 0)]
    df = spark.createDataFrame(train + cases, SCHEMA)
    got = {(r["doc_id"], r["seg_start"], r["lang"]) for r in L.mislabelled(df).collect()}
    assert got == {(101, 0, "tr"), (102, 0, "en"), (103, 0, "tr"), (103, len(t["tr"]) + 2, "ru")}


def test_defined_results(spark):
    df = spark.createDataFrame([(1, "Bir metin.", None, 0)], SCHEMA)
    assert [tuple(r) for r in L.mislabelled(df).collect()] == [(1, 0, "und", 0.0)]
    assert L.mislabelled(df.limit(0)).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("tr-TR", "TR", "tur", " en_US ", "", "und", None, "xx")], "l string")
    assert [r[0] for r in df.select(L.plain_label(F.col("l"))).collect()] == ["tr", "tr", "tr", "en", None, None, None, "xx"]
