"""Evaluation passages inside a corpus: a prefix-filtered set join on word shingles.

An item leaks into a document if the document holds ``window`` (12) consecutive words of the item or
more, of which at most ``altered`` (2) differ; the first and the last of them agree, as words next
to a shorter snatch are not altered words of a longer one. Words are those of
``lookalike.skeleton``: case, accents, punctuation, spacing and look-alike letters left aside.

An altered word breaks at most three 3-word shingles, so two windows that match have
``window - 2 - 3 * altered`` (4) shingles in common, on one diagonal (document position minus item
position). Hence of each item window only the rarest ``(window - 2) - 4 + 1`` (7) shingles, by their
counts over the whole corpus, have to be joined. Candidates then pass the positional bound (the
diagonal leaves room for a window) and the count bound (4 shingles within one window), and are
verified word by word over item-sized windows.

Defined results: null and empty texts, and texts or items with fewer than ``window`` words, hold no
leak; repeated rows give one pair; ties in rarity are broken by the shingle's hash. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, spread
from .lookalike import skeleton_words

SHINGLE = 3
#: item shingles, or diagonals, up to which that side is broadcast; beyond, the join shuffles
BROADCAST_ROWS = 2_000_000
#: candidate documents up to which their ids are broadcast to the texts; beyond, the join shuffles
BROADCAST_PAIRS = 200_000


def _shingles(words: str) -> Column:
    """Hashes of all runs of SHINGLE words, in order."""
    return F.when(
        F.size(words) >= SHINGLE,
        F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


def leaks(docs: DataFrame, items: DataFrame, window: int = 12, altered: int = 2, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item): each document with each item that leaks into it."""
    need = window - SHINGLE + 1 - SHINGLE * altered
    if need < 1:
        raise ValueError("window too short for that many altered words")
    it = items.select(F.col(item).alias("__i"), skeleton_words(F.col(text)).alias("__iw")).distinct().where(F.size("__iw") >= window)
    it = cut(it)
    places = it.select("__i", F.size("__iw").alias("__n"), F.posexplode_outer(_shingles("__iw")).alias("__p", "__h"))
    small = places.count() <= BROADCAST_ROWS
    side = F.broadcast if small else (lambda x: x)

    seen = spread(docs.select(key, text)).select(F.col(key).alias("__d"), skeleton_words(F.col(text)).alias("__w")).select("__d", F.size("__w").alias("__dn"), F.posexplode_outer(_shingles("__w")).alias("__dp", "__h"))
    hits = cut(seen.join(side(places.select("__h").distinct()), "__h"))

    # rarity over the whole corpus, then the necessary prefix of each window
    counts = hits.groupBy("__h").count()
    ranked = places.join(side(counts) if small else counts, "__h", "left").select("__i", "__n", "__p", "__h", F.coalesce("count", F.lit(0)).alias("__c"))
    inside = window - SHINGLE + 1
    starts = ranked.withColumn("__s", F.explode_outer(F.sequence(F.greatest(F.lit(0), F.col("__p") - inside + 1), F.least(F.col("__p"), F.col("__n") - window))))
    order = Window.partitionBy("__i", "__s").orderBy("__c", "__h", "__p")
    prefix = starts.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= inside - need + 1).select("__i", "__n", "__p", "__h").distinct()
    room = lambda dp, dn, p, n: F.least(dp, p) + F.least(dn - dp, n - p)  # noqa: E731  length of the diagonal
    found = (
        hits.join(side(prefix), "__h")
        .where(room(F.col("__dp"), F.col("__dn"), F.col("__p"), F.col("__n")) >= window)
        .select("__d", "__i", (F.col("__dp") - F.col("__p")).alias("__g"))
        .distinct()
    )
    found = cut(found)
    # count bound: so many shingles of the item on that diagonal within one window. Few diagonals are broadcast and filter
    # the hits as they are joined, without a shuffle; many are looked up at the places where they would have a shingle,
    # so that a common shingle meets no item that has no rare one there
    if small and found.count() <= BROADCAST_ROWS:
        on = hits.join(side(places), "__h").select("__d", "__i", (F.col("__dp") - F.col("__p")).alias("__g"), "__dp").join(F.broadcast(found), ["__d", "__i", "__g"], "left_semi").distinct()
    else:
        want = found.join(side(places), "__i").select("__d", "__i", "__g", (F.col("__p") + F.col("__g")).alias("__dp"), "__h")
        on = want.join(hits.select("__d", "__dp", "__h"), ["__d", "__dp", "__h"]).select("__d", "__i", "__g", "__dp").distinct()
    line = Window.partitionBy("__d", "__i", "__g").orderBy("__dp")
    dense = on.withColumn("__far", F.lead("__dp", need - 1).over(line) - F.col("__dp")).where(F.col("__far") < inside).select("__d", "__i", "__g").distinct()
    pairs = cut(found.join(dense, ["__d", "__i", "__g"]).groupBy("__d").agg(F.collect_set(F.struct("__i", "__g")).alias("__x")))

    # words again, of the candidate documents only: they are joined as raw texts, broadcast as far as they are few
    few = F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs
    held = docs.select(F.col(key).alias("__d"), F.col(text).alias("__t")).where(F.col(text).isNotNull()).join(few, "__d").withColumn("__w", skeleton_words(F.col("__t")))
    both = held.select("__d", "__w", F.explode_outer("__x").alias("x")).select("__d", "__w", "x.__i", "x.__g").join(side(it), "__i")
    low, high = F.greatest(F.lit(0), -F.col("__g")), F.least(F.size("__iw"), F.size("__w") - F.col("__g")) - 1
    same = F.transform(F.sequence(low, high), lambda i: (F.get("__iw", i) == F.get("__w", i + F.col("__g"))).cast("int"))
    both = both.where(high - low + 1 >= window).withColumn("__m", same)

    def fits(i: Column) -> Column:
        """A window from i on, its ends equal; up to ``altered`` words longer, where words at its end are altered."""
        out = F.lit(False)
        for size in range(window, window + altered + 1):
            end = F.get("__m", i + size - 1) == 1
            out = out | (end & (F.aggregate(F.slice("__m", i + 1, size), F.lit(0), lambda a, x: a + x) >= size - altered))
        return (F.get("__m", i) == 1) & out

    ok = both.where(F.exists(F.sequence(F.lit(0), F.size("__m") - window), lambda i: F.coalesce(fits(i), F.lit(False))))
    return ok.select(F.col("__d").alias(key), F.col("__i").alias(item)).distinct()
