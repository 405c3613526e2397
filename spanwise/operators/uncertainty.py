"""Bootstrap intervals, paired comparison and the cheapest configuration that can't be told from the best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESAMPLES, SEED = 10_000, 20260921
#: parts of the unit interval that weights are drawn from; keys and resamples drawn at a time
DRAWS = 1_000_003
KEYS, SPAN = 256, 500


def interval(values: np.ndarray, confidence: float = 0.95, resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, float]:
    """Percentile bootstrap interval of the mean; draws come in blocks, so memory is bounded by a block."""
    n = len(values)
    if n == 0:
        return 0.0, 0.0
    if n == 1:
        return float(values[0]), float(values[0])
    rng = np.random.default_rng(seed)
    means = np.empty(resamples)
    block = max(1, min(resamples, 20_000_000 // n))
    for i in range(0, resamples, block):
        j = min(resamples, i + block)
        means[i:j] = values[rng.integers(0, n, size=(j - i, n))].mean(axis=1)
    tail = (1.0 - confidence) / 2.0
    low, high = np.quantile(means, [tail, 1.0 - tail])
    return float(low), float(high)


def bootstrap_ci(df: DataFrame, by: list[str], value: str, order: list[str], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """B1: (by, n, mean, low, high). The order inside a group fixes the draws.

    numpy's stream is serial, so a group's values (one double per question) are one task's: up to about 10^8 questions a
    run. Beyond that ``bootstrap_sql`` spreads the rows of a group.
    """
    kinds = dict(df.dtypes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        v = p[value].to_numpy(dtype=float)
        low, high = interval(v, resamples=resamples, seed=seed)
        return pd.DataFrame([[*(p[b].iloc[0] for b in by), len(v), float(v.mean()), low, high]], columns=[*by, "n", "mean", "low", "high"])

    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "n long, mean double, low double, high double"])
    return df.where(F.col(value).isNotNull()).select(*by, *[o for o in order if o not in by], value).groupBy(*by).applyInPandas(run, schema)


def _rotated(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def _weights(seeds: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of (key, resample): ``xxhash64(key, b)`` as Spark has it, for the keys' own hashes (one after another) and resamples b, through the inverse of the distribution."""
    p1, p2, p3 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    h = (seeds.astype(np.int64).view(np.uint64) + np.uint64((0x27D4EB2F165667C5 + 4) % 2**64))[:, None] ^ (b.astype(np.uint64) * p1)
    h = _rotated(h, 23) * p2 + p3
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    h ^= h >> np.uint64(32)
    h = h.view(np.int64)
    return _INVERSE[h - h // DRAWS * DRAWS]


def _inverse() -> np.ndarray:
    """Weight of each remainder: inverse of the Poisson(1) distribution, as far as a figure of DRAWS parts reaches (fixed values by rule)."""
    u = (np.arange(DRAWS) + 0.5) / float(DRAWS)
    w, total, term = np.zeros(DRAWS), 0.0, float(np.exp(-1.0))
    for i in range(1, 12):
        total += term
        w += u > total
        term /= i
    return w


_INVERSE = _inverse()


def bootstrap_sql(df: DataFrame, by: list[str], value: str, key: str, resamples: int = RESAMPLES) -> DataFrame:
    """B1 without numpy's stream: Poisson(1) weights drawn from hashes of (key, resample), distributed over rows; any group size.

    A key's weights are the same in all groups, so they are drawn once per key in a task, for a block of resamples at a
    time, and multiplied with the values of all groups; only sums per group, resample and task are shuffled.
    """
    kinds = dict(df.dtypes)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.xxhash64(key).alias("__h"), F.col(value).cast("double").alias("v"))
    # all rows of a key in one task; no more tasks than cores, as each gives a row per group and resample
    rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism, "__h")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: dict[tuple, int] = {}
        sums: list[np.ndarray] = []
        held: list[pd.DataFrame] = []
        count = 0

        def add() -> None:
            p = pd.concat(held)
            held.clear()
            code, kind = pd.factorize(pd.MultiIndex.from_frame(p[by])) if len(by) > 1 else pd.factorize(p[by[0]], use_na_sentinel=False)
            place = []
            for x in kind:
                x = x if isinstance(x, tuple) else (x,)
                x = tuple(None if pd.isna(y) else y for y in x)
                if x not in names:
                    names[x] = len(names)
                    sums.append(np.zeros((2, resamples)))
                place.append(names[x])
            at, seeds = pd.factorize(p["__h"].to_numpy())
            v = p["v"].to_numpy()
            for i in range(0, len(seeds), KEYS):
                mine = np.flatnonzero((at >= i) & (at < i + KEYS))
                own, groups = np.unique(code[mine], return_inverse=True)
                m = np.zeros((2, len(own), min(KEYS, len(seeds) - i)))
                np.add.at(m[0], (groups, at[mine] - i), v[mine])
                np.add.at(m[1], (groups, at[mine] - i), 1.0)
                m = m.reshape(2 * len(own), -1)
                for j in range(0, resamples, SPAN):
                    b = np.arange(j + 1, min(resamples, j + SPAN) + 1)
                    both = (m @ _weights(seeds[i : i + KEYS], b)).reshape(2, len(own), -1)
                    for x, g in enumerate(own):
                        sums[place[g]][:, j : j + SPAN] += both[:, x]

        for p in parts:
            held.append(p)
            count += len(p)
            if count >= 50_000:
                add()
                count = 0
        if held:
            add()
        for name, i in names.items():
            yield pd.DataFrame({**{k: pd.Series([x] * resamples, dtype="object") for k, x in zip(by, name, strict=True)}, "b": np.arange(1, resamples + 1, dtype=np.int32), "vw": sums[i][0], "w": sums[i][1]})

    drawn = rows.mapInPandas(run, ", ".join([*(f"`{x}` {kinds[x]}" for x in by), "b int, vw double, w double"]))
    means = drawn.groupBy(*by, "b").agg(F.try_divide(F.sum("vw"), F.sum("w")).alias("m"))
    return means.groupBy(*by).agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))


def paired(records: DataFrame, run: str, question: str, value: str, a: str, b: str) -> DataFrame:
    """(question, a, b, diff) over the questions both runs scored; of repeated ones the last in order counts."""
    last = records.where(F.col("total_relevant") > 0).groupBy(run, question).agg(F.max_by(value, F.struct("__pos", value)).alias(value))
    x = last.where(F.col(run) == a).select(question, F.col(value).alias("a"))
    y = last.where(F.col(run) == b).select(question, F.col(value).alias("b"))
    return x.join(y, question).withColumn("diff", F.col("a") - F.col("b"))


def separates(low: object, high: object) -> object:
    """The interval leaves zero out, strictly."""
    return (low > 0) | (high < 0)


def recommend(scores: DataFrame, costs: DataFrame, run: str = "run", question: str = "question", value: str = "value", resamples: int = RESAMPLES) -> DataFrame:
    """One row per configuration: mean, whether it ties with the best, its interval against the best, whether it is the recommended one.

    scores: (run, question, value), scored questions only; costs: (run, p95, index_seconds), nulls allowed.
    Ties for the best go to the lower run name.
    """
    means = scores.groupBy(run).agg(F.avg(value).alias("mean"))
    best = means.agg(F.max(F.struct("mean", F.col(run))).alias("m")).select(F.col("m.mean").alias("top"))
    top = means.crossJoin(F.broadcast(best)).where(F.col("mean") == F.col("top")).agg(F.min(run).alias("best"))
    tagged = scores.crossJoin(F.broadcast(top))
    mine = tagged.where(F.col(run) == F.col("best")).select(question, F.col(value).alias("__b"))
    diffs = scores.join(mine, question).select(run, question, (F.col("__b") - F.col(value)).alias("diff"))
    ci = bootstrap_ci(diffs, [run], "diff", [question], resamples).select(run, F.col("n").alias("shared"), "low", "high")
    out = means.join(ci, run, "left").crossJoin(F.broadcast(top))
    tied = (F.col(run) == F.col("best")) | (F.col("shared").isNotNull() & ~((F.col("low") > 0) | (F.col("high") < 0)))
    out = out.withColumn("tied", tied).join(costs, run, "left")
    cost = [F.coalesce(F.bround("p95"), F.lit(float("inf"))), F.coalesce("index_seconds", F.lit(0.0)), -F.col("mean"), F.col(run)]
    place = F.row_number().over(Window.partitionBy("tied").orderBy(*cost))
    return out.withColumn("recommended", F.col("tied") & (place == 1)).select(run, "mean", "shared", "low", "high", "tied", "recommended")
