import random

import pytest

from spanwise.llm import contamination
from spanwise.llm.contamination import leaks

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "pa", "re", "si", "to", "vu") for b in ("dan", "ker", "lim", "mos", "nor")]


def brute(doc, item, window=12, altered=2):
    d, i = doc.split(), item.split()
    for g in range(-len(i), len(d)):
        same = [k for k in range(len(i)) if 0 <= k + g < len(d) and i[k] == d[k + g]]
        for a in range(len(same)):
            for b in range(a, len(same)):
                size = same[b] - same[a] + 1
                if size >= window and size - (b - a + 1) <= altered:
                    return True
    return False


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    items = [(n, " ".join(rng.choices(WORDS, k=rng.randint(12, 40)))) for n in range(25)]
    docs = []
    for n in range(120):
        words = rng.choices(WORDS, k=rng.randint(0, 60))
        if n % 2:
            w = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(w) - 9))
            part = w[a : a + rng.randint(8, 30)]
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = "başka"
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((n, " ".join(words)))
    return docs, items


@pytest.mark.parametrize("rows", [contamination.BROADCAST_ROWS, 0])
def test_against_brute_force(spark, case, rows, monkeypatch):
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", rows)
    docs, items = case
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in leaks(d, i).collect()}
    want = {(a, b) for a, x in docs for b, y in items if brute(x, y)}
    assert got == want and want


def test_folds_and_defined_results(spark):
    item = "Yalnızca gönüllü hemşireler vadideki köy hanelerinde yarısı eksik işitme eğrilerini dikkatle karşılaştırdı sonra"
    doc = "Önce. YALNIZCA gonullu hemşireler, vadideki köy hanelerinde yarısı eksik işitme eğrilerini — dikkаtle karşılaştırdı!"
    d = spark.createDataFrame([(1, doc), (1, doc), (2, None), (3, ""), (4, item[:60])], "doc_id long, text string")
    i = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "kısa")], "item_id long, text string")
    assert [tuple(r) for r in leaks(d, i).collect()] == [(1, 7)]
    assert leaks(d.limit(0), i).count() == 0
    assert leaks(d, i.limit(0)).count() == 0
