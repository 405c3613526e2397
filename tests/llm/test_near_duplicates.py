import random

import pytest

from spanwise.llm import near_duplicates as nd


def jaccard(a, b):
    return len(a & b) / len(a | b)


def rows(n, seed, vocabulary=40, size=(0, 14)):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 3)):
                if w and rng.random() < 0.5:
                    w[rng.randrange(len(w))] = rng.choice(words)
                else:
                    w.append(rng.choice(words))
            rng.shuffle(w)
        else:
            w = rng.choices(words, k=rng.randint(*size))
        out.append((f"q{i:04d}", " ".join(w)))
    return out


@pytest.mark.parametrize("crowded", [256, 2])
def test_all_pairs_against_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(nd, "CROWDED", crowded)  # the small value sends most keys through the long combinations
    monkeypatch.setattr(nd, "RARE", 2)
    data = rows(160, 4)
    df = spark.createDataFrame(data, "qid string, question string")
    links, members = nd.near_duplicates(df, "qid", "question", 0.7)
    got = {tuple(r) for r in nd.all_pairs(links, members, "qid").collect()}
    sets = {k: set(v.split()) for k, v in data}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.7 - 1e-9}
    assert got == want and want


def test_groups_and_defined_results(spark):
    data = [("a", "bir iki üç dört beş altı yedi"), ("b", "BİR iki, üç dört beş altı yedi!"), ("c", "bir iki üç dört beş altı sekiz yedi"), ("d", None), ("e", ""), ("f", "?"), ("g", "başka soru"), ("a", "bir iki üç dört beş altı yedi")]
    df = spark.createDataFrame(data, "qid string, question string")
    links, members = nd.near_duplicates(df, "qid", "question", 0.7)
    got = {r["qid"]: (r["group_id"], r["links"]) for r in nd.groups(links, members, "qid").collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), "c": ("a", 1), "g": ("g", 0)}
    links, members = nd.near_duplicates(df.limit(0), "qid", "question", 0.7)
    assert nd.all_pairs(links, members, "qid").count() == 0


def test_short_crowded_sets_are_told_apart(spark, monkeypatch):
    """Sets under 13 words with many words in common once met in keys that were never split further, all with all."""
    monkeypatch.setattr(nd, "CROWDED", 8)
    rng = random.Random(6)
    common = [f"c{i}" for i in range(8)]
    data = [(i, sorted({*common, *(f"w{rng.randrange(60)}" for _ in range(4))})) for i in range(300)]
    classes = spark.createDataFrame(data, "id long, words array<string>")
    got = {tuple(r) for r in nd.candidates(classes).collect()}
    want = {(a, b) for a, x in data for b, y in data if a < b and jaccard(set(x), set(y)) >= 0.7 - 1e-9}
    assert want and want <= got and len(got) <= 2 * len(want) < 300 * 299 / 8


def test_low_thresholds(spark):
    data = rows(80, 5, size=(0, 7))
    links, members = nd.near_duplicates(spark.createDataFrame(data, "qid string, question string"), "qid", "question", 0.5)
    sets = {k: set(v.split()) for k, v in data}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.5 - 1e-9}
    assert {tuple(r) for r in nd.all_pairs(links, members, "qid").collect()} == want and want


def test_paths_are_one_expression_whatever_their_depth(spark):
    one = spark.createDataFrame([(1, 3, 2, [5, 6, 7], [9, 3, 1])], "id long, n int, least int, w array<bigint>, b array<int>")
    plan = one.select(nd._paths(4.0).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lambdafunction") <= 2 * nd.DEEPEST
