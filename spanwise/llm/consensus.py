"""Consensus of several annotators' answer passages, with agreement and reliability.

Labels are the passages marked in one question: spans that differ in their ends, case or characters
are one label. Each distinct span points to the longest span of its question with which it shares
most of its word triples (at least ``SAME`` of them), pointers are followed to their end.

The consensus model is regularised minimax conditional entropy for exchangeable labels: annotator i
marks label k of item j with true label c with probability exp((s_i + t_j) [k = c]) / Z_ij, where
Z_ij = exp(s_i + t_j) + K_j - 1 for K_j possible labels. Labels of one item mean nothing in another,
so the tilting matrices of the general model keep only what is the same for every renaming of the
labels: their diagonal against the rest, one number each. The tilting parameters s (annotators) and
t (items) are fitted by regularised dual coordinate ascent (one Newton step of each in turn),
alternating with the label posteriors, until the s stand still. What rises is the dual objective

    sum_j log sum_c exp(sum_i (s_i + t_j) [k_ij = c]) - sum_ij log Z_ij - (A sum_i (s_i - START)^2 + B sum_j t_j^2) / 2

with A, B the weights below. Agreement is measured apart from the model: the share of pairs of one
item's records that have the same label. Questions with two records are fitted and labelled, too.

A label with more votes wins; of equally many the one with the higher posterior, i.e. the more
reliable annotators; of equal ones the one that stands first in order of its text.

Everything is joins and sums keyed by question or annotator, pre-aggregated before each shuffle;
only the number of rounds is a loop, its lineage is cut each time.

Defined results: a null annotator (the original author) counts as one; repeated records (same qid)
count once; a null or empty span is a label of its own; chains of ``second_of`` are followed to
their root, a root that is missing stands for itself; questions with fewer than ``least`` records
(two: one alone agrees with nobody) are left out of the consensus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..plans.lineage import cut
from .lookalike import skeleton

SAME = 0.5
#: the fit ends when no annotator's parameter moves by more than TOLERANCE, and in an error if that takes more than ROUNDS rounds
TOLERANCE, ROUNDS = 1e-2, 60
#: weights of the squared tilting parameters
ANNOTATOR_REG, ITEM_REG = 1.0, 4.0
START = 2.0


def records(gold: DataFrame) -> DataFrame:
    """(qid, second_of, annotator, span), once per qid."""
    g = gold.select("qid", F.struct(F.col("second_of").alias("second_of"), F.col("annotator").alias("annotator"), F.col("answer_span").alias("span")).alias("r")).where(F.col("qid").isNotNull())
    return g.groupBy("qid").agg(F.min("r").alias("r")).select("qid", "r.second_of", "r.annotator", "r.span")


def roots(rec: DataFrame) -> DataFrame:
    """(qid, root): pointers of ``second_of`` followed to their end, doubling each round."""
    up = cut(rec.select("qid", F.coalesce("second_of", "qid").alias("root")))
    for _ in range(40):  # 2 ** 40 records in one chain; a circle ends here too
        above = up.where(F.col("qid") != F.col("root")).select(F.col("qid").alias("root"), F.col("root").alias("next"))
        step = cut(up.join(above, "root", "left").select("qid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = step.select("qid", "root")
        if step.where("moved").isEmpty():
            break
    return up


def labels(rec: DataFrame) -> DataFrame:
    """``rec`` (qid, root, annotator, span) with ``label``: the folded text that stands for the span's passage."""
    rec = rec.withColumn("f", F.coalesce(skeleton(F.col("span")), F.lit("")))
    spans = cut(rec.select("root", "f").distinct())
    none = F.array().cast("array<bigint>")
    grams = let(F.split("f", " "), lambda w: F.when(F.size(w) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))).otherwise(none))
    g = spans.select("root", "f", F.size(grams).alias("n"), F.explode_outer(grams).alias("g"))
    # of each triple the longest span that has it; max is combined before the shuffle
    longest = g.groupBy("root", "g").agg(F.max(F.struct(F.length("f").alias("l"), "f")).alias("m")).select("root", "g", F.col("m.f").alias("to"))
    shared = g.join(longest, ["root", "g"]).groupBy("root", "f", "n", "to").count().where(F.col("count") >= SAME * F.col("n"))
    point = shared.groupBy("root", "f").agg(F.max(F.struct("count", F.length("to"), "to")).alias("m")).select("root", "f", F.col("m.to").alias("to"))
    up = cut(spans.join(point, ["root", "f"], "left").select("root", "f", F.coalesce("to", "f").alias("to")))
    for _ in range(40):
        above = up.where(F.col("f") != F.col("to")).select("root", F.col("f").alias("to"), F.col("to").alias("next"))
        step = cut(up.join(above, ["root", "to"], "left").select("root", "f", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        up = step.select("root", "f", "to")
        if step.where("moved").isEmpty():
            break
    return rec.join(up, ["root", "f"]).select("qid", "root", "annotator", "span", F.col("to").alias("label"))


def consensus(gold: DataFrame, least: int = 2, rounds: int = ROUNDS, tolerance: float = TOLERANCE, trace: list[float] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """votes (root, qid, annotator, span, label, agreed, records), items (root, label, votes, records, posterior, agreement), annotators (annotator, reliability, records).

    ``trace`` takes the dual objective of each round.
    """
    rec = records(gold)
    rec = rec.join(roots(rec), "qid").select("qid", "root", "annotator", "span")
    enough = rec.groupBy("root").count().where(F.col("count") >= least).select("root")
    v = cut(labels(rec.join(enough, "root")).withColumn("who", F.coalesce(F.concat(F.lit("a"), "annotator"), F.lit(""))))
    per = cut(v.groupBy("root", "label").agg(F.count("*").alias("n")).groupBy("root").agg(F.sum("n").alias("m"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")))
    s = v.select("who").distinct().withColumn("s", F.lit(START))
    t = per.select("root", "k", F.lit(0.0).alias("t"))
    post = None
    for no in range(rounds + 1):
        on = v.select("root", "label", "who").join(s, "who").join(t, "root")
        # posterior of each label: exp of its voters' tilts, normalised per item
        score = on.groupBy("root", "label").agg(F.sum(F.col("s") + F.col("t")).alias("e"))
        top = score.groupBy("root").agg(F.max("e").alias("top"))
        mass = score.join(top, "root").withColumn("x", F.exp(F.col("e") - F.col("top")))
        total = mass.groupBy("root").agg(F.sum("x").alias("z"))
        post = cut(mass.join(total, "root").select("root", "label", (F.col("x") / F.col("z")).alias("q")))
        if trace is not None:
            own = mass.groupBy("root").agg((F.max("top") + F.log(F.sum("x"))).alias("l")).agg(F.sum("l")).first()[0]
            norm = on.agg(F.sum(F.log(F.exp(F.col("s") + F.col("t")) + F.greatest(F.col("k"), F.lit(2)) - 1))).first()[0]
            reg = s.agg(F.sum(ANNOTATOR_REG * (F.col("s") - START) ** 2)).first()[0], t.agg(F.sum(ITEM_REG * F.col("t") ** 2)).first()[0]
            trace.append((own or 0.0) - (norm or 0.0) - sum(x or 0.0 for x in reg) / 2)
        both = on.join(post, ["root", "label"])
        e = F.exp(F.col("s") + F.col("t"))
        both = cut(both.withColumn("p", e / (e + F.greatest(F.col("k"), F.lit(2)) - 1)))
        grad = F.sum(F.col("q") - F.col("p")).alias("g")
        curve = F.sum(F.col("p") * (1 - F.col("p"))).alias("h")
        step = (F.col("g") - ANNOTATOR_REG * (F.col("s") - START)) / (F.col("h") + ANNOTATOR_REG)
        moved = cut(both.groupBy("who").agg(grad, curve, F.first("s").alias("s")).select("who", (F.col("s") + step).alias("s"), F.abs(step).alias("by")))
        far = moved.agg(F.max("by")).first()[0] or 0.0
        if far <= tolerance:
            break  # the posteriors are those of the parameters that stand
        if no == rounds:
            raise RuntimeError(f"no convergence in {rounds} rounds: parameters still move by {far}")
        s = moved.select("who", "s")
        fresh = both.drop("s").join(s, "who")
        e = F.exp(F.col("s") + F.col("t"))
        fresh = fresh.withColumn("p", e / (e + F.greatest(F.col("k"), F.lit(2)) - 1))
        t = cut(fresh.groupBy("root", "k").agg(grad, curve, F.first("t").alias("t")).select("root", "k", (F.col("t") + (F.col("g") - ITEM_REG * F.col("t")) / (F.col("h") + ITEM_REG)).alias("t")))
    votes = v.groupBy("root", "label").agg(F.count("*").alias("votes")).join(post, ["root", "label"])
    order = Window.partitionBy("root").orderBy(F.desc("votes"), F.desc(F.round("q", 9)), "label")
    best = votes.withColumn("r", F.row_number().over(order)).where(F.col("r") == 1)
    items = cut(best.join(per, "root").select("root", "label", "votes", F.col("m").alias("records"), F.col("q").alias("posterior"), (F.col("same") / (F.col("m") * (F.col("m") - 1))).alias("agreement")))
    marked = v.join(items.select("root", F.col("label").alias("best"), "records"), "root").select("root", "qid", "annotator", "span", "label", (F.col("label") == F.col("best")).alias("agreed"), "records")
    load = v.groupBy("who").agg(F.count("*").alias("records"))
    people = s.join(load, "who").select(F.when(F.col("who") != "", F.expr("substring(who, 2)")).alias("annotator"), F.round("s", 6).alias("reliability"), "records")
    return marked, items, people
