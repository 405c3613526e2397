"""Records that share most of their words, without comparing all pairs: paths of common words.

Two word sets of n and l words with Jaccard similarity t or more have at least
o(n, l) = ceil((n + l) t / (1 + t)) words in common. All sets are put into one order of words (rarest
first); the first j common words of a pair are then a path of j words in both sets, and each set lacks
at most n - o(n, l) of its words before the path's end. A set's index keys are its paths that lack no
more than the least l of the table asks; a path ends as soon as no more than ``RARE`` sets are expected
to have all its words, so rare words stand alone or in twos and frequent ones in longer paths. As words go together
in texts, that expectation may fail: members of a key that more than ``CROWDED`` sets really
have are told apart by one common word more, again and again; a pair that needs no more common words than the path
has is similar and taken as it is. No key is dropped or capped.

Candidates must have room for enough common words behind the path, and their signatures (64 bits, one
flipped by each word) must not differ in more bits than the sets may differ in words; both bounds
are safe. What is left is verified exactly.

Sets that are equal are one class: only class representatives are compared, members are joined back.

Defined results: null and empty texts and texts without letters and digits have no partner; repeated
rows (same id) count once; ties in rarity are broken by the word's hash; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, spread
from .lookalike import skeleton_words

#: expected sets of a path that ends, sets of a key that is split further
RARE, CROWDED = 32, 256
#: words of a path at most, before its key has turned out to be crowded
DEEPEST = 6
#: words whose frequency is told apart: this many at most, and only those that more than one set of 2 ** BITS has
LISTED, BITS = 4096, 12
SLACK = 1e-6


def word_sets(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Classes (cid, words) of equal word sets, and membership (key, cid); cid is the least key of the class."""
    w = spread(df.select(F.col(key).alias("__k"), F.col(text).alias("__t"))).select("__k", F.array_join(F.array_sort(F.array_distinct(skeleton_words(F.col("__t")))), " ").alias("__s"))
    w = cut(w.select("__k", "__s", F.xxhash64("__s").alias("__h"), F.xxhash64(F.lit(1), "__s").alias("__i"))).where(F.col("__s") != "")  # texts are worked out once
    # min is combined before the shuffle, so that one class may hold a third of the rows
    classes = cut(w.groupBy("__h", "__i").agg(F.min("__k").alias("cid"), F.min("__s").alias("__s")))
    members = w.select("__k", "__h", "__i").join(classes.select("__h", "__i", "cid"), ["__h", "__i"]).select(F.col("__k").alias(key), "cid").distinct()
    return classes.select("cid", F.split("__s", " ").alias("words")), members


def _ranked(classes: DataFrame, threshold: float) -> DataFrame:
    """(id, n, least, w, b, s): of each class its number, its words (hashes, rarest first), the bits that tell how rare they are, its signature; ``least`` is the fewest common words it may need."""
    total = max(1, classes.count())
    counts = classes.select(F.explode_outer(F.transform("words", lambda w: F.xxhash64(w))).alias("w")).groupBy("w").count()
    often = counts.where(F.col("count") * 2**BITS > total).orderBy(F.desc("count"), "w").limit(LISTED).collect()
    levels: dict[int, list[int]] = {}
    for r in often:
        levels.setdefault(round(math.log2(total / r["count"])), []).append(r["w"])
    rest = max(levels) if len(often) == LISTED else BITS
    # written as one text, as thousands of literals take the driver seconds one by one
    cases = " ".join(f"WHEN w IN ({', '.join(f'{x}L' for x in words)}) THEN {-b}" for b, words in sorted(levels.items()))
    ranks = f"CASE {cases} ELSE {-rest} END" if cases else f"{-rest}"
    r = classes.select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("h")).select("id", F.array_sort(F.expr(f"transform(h, w -> named_struct('b', {ranks}, 'w', w))")).alias("r"))
    r = r.select("id", F.size("r").alias("n"), F.transform("r", lambda x: -x["b"]).alias("b"), F.transform("r", lambda x: x["w"]).alias("w"))
    sizes = cut(classes.select(F.size("words").alias("n")).distinct())
    small = sizes.select(F.col("n").alias("l")).join(F.broadcast(sizes), (F.col("l") <= F.col("n")) & (F.col("l") >= F.col("n") * F.lit(threshold) - F.lit(SLACK)))
    need = small.groupBy("n").agg(F.min("l").alias("l")).select("n", _need(F.col("n") + F.col("l"), threshold).alias("least"))
    signature = F.expr("aggregate(w, 0L, (a, x) -> a ^ shiftleft(1L, cast(pmod(x, 64) as int)))")
    return r.join(F.broadcast(need), "n").select("id", "n", "least", "w", "b", signature.alias("s"))


def _need(both: Column, threshold: float) -> Column:
    """Common words of a similar pair of so many words together, at least."""
    return F.ceil(both * F.lit(threshold / (1 + threshold)) - F.lit(SLACK)).cast("int")


def _paths(enough: float) -> Column:
    """Array of (key, room, depth): a set's paths; room is the most common words a pair can have whose first ones are the path."""
    n, lacks = F.col("n"), F.col("n") - F.col("least")
    leaves = "array<struct<key:bigint,room:int,depth:int>>"

    def deeper(depth: int, start: Column, seed: Column, bits: Column) -> Column:
        last = F.least(n - 1, lacks + depth - 1)

        def step(i: Column) -> Column:
            h, b = F.xxhash64(seed, F.get("w", i)), bits + F.get("b", i)
            leaf = F.array(F.struct(h.alias("key"), (n - i + depth - 1).alias("room"), F.lit(depth).alias("depth"))).cast(leaves)
            if depth == DEEPEST:
                return leaf
            more = deeper(depth + 1, i + 1, h, b)
            # a set that may need no more common words than these may end here, too; ``more`` is written once, else the expression doubles with each word
            return F.when(b >= enough, leaf).otherwise(F.concat(F.when(F.col("least") <= depth, leaf).otherwise(F.array().cast(leaves)), more))

        return F.flatten(F.transform(F.when(start <= last, F.sequence(start, last)).otherwise(F.array().cast("array<int>")), step))

    return deeper(1, F.lit(0), F.lit(0).cast("bigint"), F.lit(0))


def candidates(classes: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b), a < b: pairs of ``id`` that hold all similar ones; ``classes`` has id and words."""
    ranked = _ranked(classes, threshold)
    enough = math.log2(max(1, classes.count()) / RARE)
    rows = ranked.select("id", "n", "s", F.explode_outer(_paths(enough)).alias("k")).select("id", "n", "s", "k.key", "k.room", "k.depth").where(F.col("key").isNotNull())
    most = (1 + threshold) / threshold  # words of a similar pair for each common one
    by_key = Window.partitionBy("key")
    found = []
    while True:
        # sets of a key whose smallest is too large for them have no partner there
        alive = rows.withColumn("low", F.min("n").over(by_key)).where(F.col("n") + F.col("low") <= F.col("room") * F.lit(most) + F.lit(SLACK)).withColumn("c", F.count("*").over(by_key)).where(F.col("c") > 1).drop("low")
        calm = alive.where(F.col("c") <= CROWDED)
        a, b = (calm.select("key", *[F.col(x).alias(f"{x}_{side}") for x in ("id", "n", "s", "room", "depth")]) for side in "ab")
        both = F.col("n_a") + F.col("n_b")
        need = _need(both, threshold)
        near = (F.least("room_a", "room_b") >= need) & (F.bit_count(F.col("s_a").bitwiseXOR(F.col("s_b"))) <= both - 2 * need)
        same = F.col("depth_a") - F.col("depth_b") == 0  # always so; read here, too, all columns make one exchange for the three uses of the keys
        pairs = a.join(b, "key").where((F.col("id_a") < F.col("id_b")) & near & same).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        # one job for both, so that keys are worked out and shuffled once
        nothing = {x: F.lit(None).cast(t) for x, t in (("id", "bigint"), ("n", "int"), ("s", "bigint"), ("key", "bigint"), ("room", "int"), ("depth", "int"))}
        crowded = alive.where(F.col("c") > CROWDED).select(*[F.lit(None).cast("bigint").alias(x) for x in "ab"], *nothing)
        level = cut(pairs.withColumns(nothing).unionByName(crowded))
        found.append(level.where(F.col("a").isNotNull()).select("a", "b"))
        left = level.where(F.col("key").isNotNull()).drop("a", "b")
        if left.isEmpty():
            break
        wide = left.join(ranked.select("id", "least", "w"), "id")
        # pairs that need no more common words than they have: the smaller one by its size, the larger one by the sizes that would do
        full = wide.where(F.col("least") <= F.col("depth"))
        fits = F.filter(F.sequence(F.ceil(F.col("n") * F.lit(threshold) - F.lit(SLACK)).cast("int"), F.col("n")), lambda x: _need(F.col("n") + x, threshold) <= F.col("depth"))
        larger = full.select("key", F.col("id").alias("y"), F.explode(fits).alias("l"))
        smaller = full.select("key", F.col("id").alias("x"), F.col("n").alias("l"))
        found.append(cut(smaller.join(larger, ["key", "l"]).where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))))
        start, last = F.col("n") - F.col("room") + F.col("depth"), F.least(F.col("n") - 1, F.col("n") - F.col("least") + F.col("depth"))
        rows = wide.where(start <= last).select("id", "n", "s", "key", "depth", "w", F.explode(F.sequence(start, last)).alias("i"))
        rows = rows.select("id", "n", "s", F.xxhash64("key", F.get("w", F.col("i"))).alias("key"), (F.col("n") - F.col("i") + F.col("depth")).alias("room"), (F.col("depth") + 1).alias("depth"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def similar_sets(classes: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, similarity), a < b: classes whose sets are similar."""
    named = cut(classes.select("cid", F.array_join("words", " ").alias("s"), F.monotonically_increasing_id().alias("id")))
    pairs = candidates(named.select("id", F.split("s", " ").alias("words")), threshold)
    a, b = (named.select(F.col("id").alias(x), F.col("cid").alias(f"c{x}"), F.split("s", " ").alias(f"w{x}")) for x in "ab")
    both = F.size(F.array_intersect("wa", "wb"))
    sim = both / (F.size("wa") + F.size("wb") - both)
    near = pairs.join(a, "a").join(b, "b").select("ca", "cb", sim.alias("similarity")).where(F.col("similarity") >= F.lit(threshold) - F.lit(1e-9))
    return near.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "similarity")


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Links between class representatives (a, b, similarity) and membership (key, cid)."""
    classes, members = word_sets(df, key, text)
    return similar_sets(classes, threshold), members


def all_pairs(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Links and classes written out as pairs of keys, (a, b) with a < b."""
    m1, m2 = members.select("cid", F.col(key).alias("x")), members.select("cid", F.col(key).alias("y"))
    within = m1.join(m2, "cid").where(F.col("x") < F.col("y")).select("x", "y")
    across = links.select("a", "b").join(m1.withColumnRenamed("cid", "a"), "a").join(m2.withColumnRenamed("cid", "b"), "b").select("x", "y")
    return within.unionByName(across).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def groups(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key, group_id, links): connected classes share the least member's key; links counts the row's linked classes."""
    edges = cut(links.select(F.col("a").alias("s"), F.col("b").alias("t")).unionByName(links.select(F.col("b").alias("s"), F.col("a").alias("t"))))
    degree = edges.groupBy("s").count()
    label = cut(members.select("cid").distinct().withColumn("g", F.col("cid")))
    while True:
        reach = edges.join(label.withColumnRenamed("cid", "t"), "t").groupBy("s").agg(F.min("g").alias("m"))
        new = label.join(reach.withColumnRenamed("s", "cid"), "cid", "left").select("cid", F.least("g", F.coalesce("m", "g")).alias("h"), "g")
        jump = new.select(F.col("cid").alias("h"), F.col("h").alias("hh"))  # pointers double
        step = cut(new.join(jump, "h", "left").select("cid", F.least("h", F.coalesce("hh", "h")).alias("g"), F.col("g").alias("old")))
        label = step.select("cid", "g")
        if step.where(F.col("g") != F.col("old")).isEmpty():
            break
    out = members.join(label, "cid").join(degree.withColumnRenamed("s", "cid"), "cid", "left")
    return out.select(key, F.col("g").alias("group_id"), F.coalesce("count", F.lit(0)).alias("links"))
