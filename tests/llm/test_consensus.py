import random

from spanwise.llm.consensus import consensus

SCHEMA = "qid string, second_of string, annotator string, answer_span string, question string"
GOOD = "ergen askerlere yazılan ilaç elli miligram düzeyinde tutulunca geriledi"
BAD = "düzenli uyku ve dengeli beslenme yorgunluk riskini azaltır denir"


def test_labels_ties_and_chains(spark):
    rng = random.Random(2)
    rows = []
    for i in range(40):  # these tell who is careful
        a, b = f"{GOOD} {i}", f"{BAD} {i}"
        rows += [(f"q{i}", None, "good1", a), (f"q{i}#2", f"q{i}", "good2", a[6:]), (f"q{i}#3", f"q{i}#2", None, a.upper()), (f"q{i}#4", f"q{i}#3", "bad1", b if rng.random() < 0.9 else a), (f"q{i}#5", f"q{i}", "bad2", b + " son" if rng.random() < 0.9 else a)]
    rows += [("t", None, "bad1", BAD), ("t#2", "t", "bad2", BAD), ("t#3", "t", "good1", GOOD), ("t#4", "t#3", "good2", GOOD.replace("ilaç", "iIaç".replace("I", "l")))]
    rows += [("two", None, "good1", GOOD), ("two#2", "two", "good2", BAD)]  # fewer than three records
    rows += [("n", None, None, None), ("n#2", "n", "good1", GOOD), ("n#3", "n", "good2", GOOD), ("t", None, "bad1", BAD)]  # a null span, a repeated record
    df = spark.createDataFrame([(*r, "?") for r in rows], SCHEMA)
    trace = []
    votes, items, people = consensus(df, tolerance=0.05, trace=trace)
    assert len(trace) > 3 and all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))
    wrong = {(r["root"], r["qid"]) for r in votes.where("not agreed and records >= 3").collect()}
    assert {q for r, q in wrong if r == "t"} == {"t", "t#2"}
    assert {q for r, q in wrong if r == "n"} == {"n"}
    assert not any(r == "two" for r, _ in wrong)
    assert all(q.endswith(("#4", "#5")) for r, q in wrong if r.startswith("q"))
    rel = {r["annotator"]: r["reliability"] for r in people.collect()}
    assert min(rel["good1"], rel["good2"], rel[None]) > max(rel["bad1"], rel["bad2"])
    two = items.where("root = 'two'").first()  # two records have a label, an agreement and weights, too
    assert (two["votes"], two["records"], two["agreement"]) == (1, 2, 0.0)
    t = items.where("root = 't'").first()
    assert (t["votes"], t["records"]) == (2, 4) and abs(t["agreement"] - 1 / 3) < 1e-9


def test_empty_table(spark):
    votes, items, people = consensus(spark.createDataFrame([], SCHEMA))
    assert votes.count() == items.count() == people.count() == 0
