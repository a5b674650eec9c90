"""Small-sample statistics over run scores (run_id, architecture, trained_on, seed, metric, value)."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Level, draws and seed of the bootstrap; critical values of the Nemenyi test by number of models.
ALPHA, DRAWS, SEED = 0.05, 10_000, 0
#: Drawn values that are held at once.
CELLS = 1 << 22
Q_ALPHA = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728}


def bca(values, alpha: float = ALPHA, draws: int = DRAWS, seed: int = SEED) -> tuple[float, float, float, int, str]:
    """(mean, low, high, n, method): a bootstrap interval of the mean.

    Method `bca` shifts the two tails by bias and acceleration (Efron 1987). The jackknife of a mean leaves deviations
    (x - mean) / (n - 1), whose scale cancels, so the acceleration is that of the deviations themselves. Where all draws are on
    one side of the mean, or nothing deviates, it is undefined and the method is `percentile`; of fewer than two values `point`.
    """
    x = np.asarray(values, float)
    if len(x) < 2:
        return *(float(x.sum()) if len(x) else float("nan") for _ in range(3)), len(x), "point"
    off, tails = x - x.mean(), np.array([alpha / 2, 1 - alpha / 2])
    rng, at_once = np.random.default_rng(seed), max(1, CELLS // len(x))  # one generator, so the draws are those of one matrix
    drawn = np.sort(np.concatenate([x[rng.integers(0, len(x), (min(at_once, draws - a), len(x)))].mean(axis=1) for a in range(0, draws, at_once)]))
    below, power = np.searchsorted(drawn, x.mean()) / draws, (off @ off) ** 1.5
    shifted = 0 < below < 1 and power > 0
    if shifted:
        tails = _shifted(tails, NormalDist().inv_cdf(below), (off**3).sum() / power / 6)
    return float(x.mean()), *map(float, np.quantile(drawn, tails)), len(x), "bca" if shifted else "percentile"


def _shifted(tails: np.ndarray, bias: float, acceleration: float) -> np.ndarray:
    """Shares of the standard normal moved by bias and acceleration."""
    normal = NormalDist()
    z = bias + np.array([normal.inv_cdf(t) for t in tails])
    return np.array([normal.cdf(v) for v in bias + z / (1 - acceleration * z)])


def intervals(scores: DataFrame, by: list[str], value: str = "value", order: str = "seed", alpha: float = ALPHA, draws: int = DRAWS) -> DataFrame:
    """(by, mean, low, high, n, method). Groups are a handful of runs; each goes to one grouped Python call."""
    kinds = {f.name: f.dataType.simpleString() for f in scores.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", mean double, low double, high double, n int, method string"

    def one(pdf):
        pdf = pdf.sort_values(order)
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), *bca(pdf[value].to_numpy(), alpha, draws)]], columns=[*by, "mean", "low", "high", "n", "method"])

    return scores.select(*by, order, value).groupBy(*by).applyInPandas(one, schema)


def min_attainable_p(n: Column) -> Column:
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 / F.pow(F.lit(2.0), n)))


#: Pairs up to which all sign vectors are formed at once; of more, halves are.
WHOLE = 12


#: Pairs up to which halves are formed; of more, equal sums are put together. And the different sums that are then held.
HALVES, SUMS = 40, 4_000_000


def sign_flip(pairs: DataFrame, by: list[str], diff: str = "diff", order: str = "seed", most: int | None = None) -> DataFrame:
    """(by, n, mean_diff, p, min_p): exact paired permutation test over all 2**n sign vectors of the differences; n is 1 or more.

    Up to WHOLE pairs, all sums are formed in one expression. Up to HALVES, the sums of both halves are sorted, and for each of the
    one half those of the other that are extreme with it are counted by search: 2**(n/2) numbers instead of 2**n. Beyond,
    differences are whole multiples of 1e-12, and sign vectors of equal sums are carried on as one with their share: scores of a few
    decimals have few different sums, however many pairs there are. Over SUMS different ones are an error. `most`: bounds n, and up to
    WHOLE no Python is in the plan.
    """
    d = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(diff).cast("double").alias("d")))), lambda x: x.d)
    g = pairs.groupBy(*by).agg(d.alias("_d")).withColumn("n", F.size("_d"))
    bad = F.col("n") < 1 if most is None else (F.col("n") < 1) | (F.col("n") > most)
    ok = F.when(bad, F.raise_error(F.lit(f"an exact test takes 1 to {most or 'any number of'} pairs"))).otherwise(F.col("n"))
    g = g.withColumn("n", ok).withColumn("_sum", F.aggregate("_d", F.lit(0.0), lambda s, x: s + x))
    total = lambda v: F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda s, i: s + F.when(F.call_function("shiftright", v, i.cast("int")).bitwiseAND(F.lit(1)) == 1, -F.get("_d", i)).otherwise(F.get("_d", i)))
    vectors = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.least("n", F.lit(WHOLE)).cast("int")) - 1)
    hits = F.size(F.filter(vectors, lambda v: F.abs(total(v) / F.col("n")) >= F.abs(F.col("_sum") / F.col("n")) - 1e-12)).cast("double")
    p = hits / F.pow(F.lit(2.0), "n")
    if most is None or most > WHOLE:  # else no Python is in the plan
        p = F.when(F.col("n") <= WHOLE, p).otherwise(_halves("_d"))
    return g.select(*by, "n", (F.col("_sum") / F.col("n")).alias("mean_diff"), p.alias("p"), min_attainable_p(F.col("n")).alias("min_p"))


@F.pandas_udf(DoubleType())
def _halves(d: pd.Series) -> pd.Series:
    def one(x: np.ndarray) -> float | None:
        n = len(x)
        if n <= WHOLE:
            return None  # not looked at
        if n > HALVES:
            return shared_sums(x)
        sums = []
        for half in (x[: n // 2], x[n // 2 :]):
            out = np.zeros(1)
            for v in half:
                out = np.concatenate((out + v, out - v))
            sums.append(np.sort(out))
        a, b = sums
        least = abs(x.sum()) - 1e-12 * n
        high = len(b) - np.searchsorted(b, least - a)
        low = np.searchsorted(b, -least - a, "right")
        return float(np.minimum(high + low, len(b)).sum()) / 2.0**n

    return d.map(one)


def shared_sums(x: np.ndarray) -> float:
    """p of sign_flip() by putting equal sums together, in units of 1e-12."""
    units = np.rint(np.asarray(x, float) * 1e12)
    if np.abs(units).sum() >= 2.0**53:
        raise ValueError("the differences are too large for sums in units of 1e-12")
    sums, share = np.zeros(1, np.int64), np.ones(1)
    for v in units.astype(np.int64):
        sums, at = np.unique(np.concatenate((sums + v, sums - v)), return_inverse=True)
        share = np.bincount(at, np.concatenate((share, share)) / 2)
        if len(sums) > SUMS:
            raise ValueError(f"over {SUMS} different sums of {len(x)} differences: round these")
    return float(share[np.abs(sums) >= abs(int(units.sum())) - len(x)].sum())


def ranks(scores: DataFrame, block: list[str], value: str = "value") -> DataFrame:
    """scores with `rank` in its block: 1 is the best, ties share the mean rank."""
    top = F.rank().over(W.partitionBy(*block).orderBy(F.desc(value)))
    ties = F.count("*").over(W.partitionBy(*block, value))
    return scores.withColumn("rank", top + (ties - 1) / 2)


def mean_ranks(scores: DataFrame, model: str, block: list[str], by: list[str] | None = None, value: str = "value") -> DataFrame:
    return ranks(scores, [*(by or []), *block], value).groupBy(*(by or []), model).agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("blocks"))


def friedman(scores: DataFrame, model: str, block: list[str], by: list[str], value: str = "value") -> DataFrame:
    """(by, k, blocks, statistic, p, critical_difference, error): tie-corrected Friedman test. Fewer than three models, unequal
    blocks, or fewer than two give an error and nulls. p is by chi-square with k - 1 degrees, in closed form for each k."""
    sized = scores.groupBy(*by, model).agg(F.count("*").alias("n")).groupBy(*by).agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    r = ranks(scores, [*by, *block], value)
    ties = scores.groupBy(*by, *block, value).agg(F.count("*").alias("_t")).groupBy(*by).agg(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_ties"))
    sums = r.groupBy(*by, model).agg(F.sum("rank").alias("_s")).groupBy(*by).agg(F.sum(F.col("_s") * F.col("_s")).alias("_ss"))
    met = sized.join(ties, by).join(sums, by)
    k, n = F.col("k").cast("double"), F.col("hi").cast("double")
    chi = 12 / (n * k * (k + 1)) * F.col("_ss") - 3 * n * (k + 1)
    corrected = chi / F.nullif(1 - F.col("_ties") / (n * k * (k * k - 1)), F.lit(0.0))
    error = F.when(F.col("k") < 3, "needs three models or more").when(F.col("lo") != F.col("hi"), "unequal blocks").when(F.col("hi") < 2, "needs two blocks or more")
    met = met.withColumn("error", error).withColumn("statistic", F.when(error.isNull(), corrected))
    q = F.create_map(*(F.lit(float(x)) for kv in Q_ALPHA.items() for x in kv))[k]
    met = met.withColumn("critical_difference", F.when(error.isNull(), q * F.sqrt(k * (k + 1) / (6 * n))))
    return met.select(*by, F.col("k").cast("int").alias("k"), F.col("hi").alias("blocks"), "statistic", chi_square_tail(F.col("statistic"), F.col("k").cast("int") - 1).alias("p"), "critical_difference", "error")


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(chi-square with df degrees > x). Even df: a finite sum; odd df: the normal tail and a finite sum."""
    half = x / 2
    even = F.exp(-half) * F.aggregate(F.sequence(F.lit(0), F.greatest((df / 2).cast("int") - 1, F.lit(0))), F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")), lambda a, i: F.struct((a.s + a.t).alias("s"), (a.t * half / (i + 1)).alias("t"))).s
    root = F.sqrt(x)
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest(((df - 1) / 2).cast("int"), F.lit(1))), F.struct(F.lit(0.0).alias("s"), root.alias("t")), lambda a, i: F.struct((a.s + a.t).alias("s"), (a.t * x / (2 * i + 1)).alias("t"))).s
    odd = two_sided_normal(root) + F.when(df > 1, F.sqrt(F.lit(2 / np.pi)) * F.exp(-half) * terms).otherwise(0.0)
    return F.when(x.isNull(), None).when(x <= 0, 1.0).when(df % 2 == 0, even).otherwise(odd)


def two_sided_normal(z: Column) -> Column:
    """erfc(z / sqrt 2) for z >= 0: a series below 3, a continued fraction above (absolute error under 1e-9)."""
    x = z / float(np.sqrt(2))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("s"), x.alias("t")), lambda a, n: F.struct((a.s + a.t * (-x * x) / n / (2 * n + 1)).alias("s"), (a.t * (-x * x) / n).alias("t"))).s
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda f, n: x + n / 2 / f)
    return F.when(z < 3, 1 - 2 / float(np.sqrt(np.pi)) * series).otherwise(F.exp(-x * x) / float(np.sqrt(np.pi)) / tail)


def holm(tests: DataFrame, by: list[str], p: str = "p", key: str = "metric") -> DataFrame:
    """tests with `adjusted`: step-down correction over the tests of a group."""
    run = W.partitionBy(*by).orderBy(p, key) if by else W.partitionBy(F.lit(1)).orderBy(p, key)
    n = F.count("*").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(1)))
    step = F.least(F.lit(1.0), (n - F.row_number().over(run) + 1) * F.col(p))
    return tests.withColumn("_step", step).withColumn("adjusted", F.max("_step").over(run.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_step")


def cliques(ranked: DataFrame, cd: float, rank: str = "mean_rank", model: str = "model") -> DataFrame:
    """(low, high, models): maximal runs of two or more mean ranks within cd of their first. ranked: one row per model, a few."""
    a, b = ranked.select(F.col(rank).alias("low"), F.col(model).alias("_m")), ranked.select(F.col(rank).alias("x"), F.col(model).alias("_n"))
    reach = a.join(F.broadcast(b), (F.col("x") >= F.col("low")) & (F.col("x") - F.col("low") <= cd))
    runs = reach.groupBy("low", "_m").agg(F.max("x").alias("high"), F.count("*").alias("models")).filter("models > 1").select("low", "high", "models").groupBy("low", "high").agg(F.max("models").alias("models"))
    wider = runs.select(F.col("low").alias("l2"), F.col("high").alias("h2"))
    inside = (F.col("l2") <= F.col("low")) & (F.col("h2") >= F.col("high")) & ((F.col("l2") < F.col("low")) | (F.col("h2") > F.col("high")))
    return runs.join(F.broadcast(wider), inside, "left_anti")


def transfer(scores: DataFrame, keys: list[str], trained: str = "trained_on", tested: str = "tested_on", value: str = "value") -> DataFrame:
    """(keys, in_domain, cross_domain, delta)."""
    inside = F.col(trained) == F.col(tested)
    out = scores.groupBy(*keys).agg(F.avg(F.when(inside, F.col(value))).alias("in_domain"), F.avg(F.when(~inside, F.col(value))).alias("cross_domain"))
    return out.withColumn("delta", F.col("cross_domain") - F.col("in_domain"))


def cells(scores: DataFrame, model: str, dataset: str, value: str = "value") -> DataFrame:
    """Mean, least and most per (model, dataset) and pooled per model (dataset null, pooled true), by grouping sets."""
    return scores.groupingSets([[F.col(model), F.col(dataset)], [F.col(model)]], F.col(model), F.col(dataset)).agg(
        F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"), (F.grouping(dataset) == 1).alias("pooled")
    )


def aligned(scores: DataFrame, model: str, block: list[str], value: str = "value") -> DataFrame:
    """(a, b, block, diff): each two models' difference in every block both have."""
    own = scores.select(*block, F.col(model).alias("m"), F.col(value).alias("v"))
    met = own.alias("x").join(own.alias("y"), block).filter("x.m < y.m")
    return met.select(F.col("x.m").alias("a"), F.col("y.m").alias("b"), *block, (F.col("x.v") - F.col("y.v")).alias("diff"))


def studentized_range_tail(q: float, k: int) -> float:
    """P(range of k standard normals > q), by Simpson's rule over one of them."""
    z = np.linspace(-8.0, 8.0 + q, 4001)
    normal = NormalDist()
    cdf = lambda x: np.array([normal.cdf(v) for v in x])
    f = k * np.exp(-z * z / 2) / np.sqrt(2 * np.pi) * (cdf(z) - cdf(z - q)) ** (k - 1)
    h = z[1] - z[0]
    return float(min(1.0, max(0.0, 1 - h / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()))))


def nemenyi(ranked: DataFrame, by: list[str], model: str = "model") -> DataFrame:
    """(by, a, b, difference, p) of each two models of a mean_ranks() table: the Nemenyi test. A group is a few models."""
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + f", a {kinds[model]}, b {kinds[model]}, difference double, p double"

    def one(pdf):
        pdf = pdf.sort_values(model)
        k, n = len(pdf), pdf["blocks"].max()
        rows = []
        for i in range(k):
            for j in range(i + 1, k):
                x, y = pdf.iloc[i], pdf.iloc[j]
                d = float(x["mean_rank"] - y["mean_rank"])
                rows.append([*(x[c] for c in by), x[model], y[model], d, studentized_range_tail(abs(d) / np.sqrt(k * (k + 1) / (6 * n)) * np.sqrt(2), k)])
        return pd.DataFrame(rows, columns=[*by, "a", "b", "difference", "p"])

    return ranked.groupBy(*by).applyInPandas(one, schema)


def aggregate(scores: DataFrame, model: str = "model", dataset: str = "trained_on", seed: str = "seed", metric: str = "metric") -> dict[str, DataFrame]:
    """All tables of a report over (model, dataset, seed, metric, value): cells, pooled intervals, paired tests, and one omnibus
    test per metric with its corrected p. Models that lack a condition another has are left out of the tests."""
    conditions = scores.select(metric, dataset, seed).distinct().groupBy(metric).agg(F.count("*").alias("_all"))
    whole = scores.groupBy(metric, model).agg(F.count("*").alias("_n")).join(conditions, metric).filter("_n = _all").select(metric, model)
    complete = scores.join(whole, [metric, model], "left_semi")
    block = F.concat_ws("|", F.col(dataset).cast("string"), F.col(seed).cast("string"))
    paired = aligned(complete, model, [metric, dataset, seed]).withColumn("block", block)
    omnibus = friedman(complete, model, [dataset, seed], [metric])
    return {
        "per_cell": intervals(scores, [metric, model, dataset], order=seed),
        "pooled": intervals(scores.withColumn("block", block), [metric, model], order="block"),
        "paired": sign_flip(paired, [metric, "a", "b"], order="block"),
        "mean_ranks": mean_ranks(complete, model, [dataset, seed], [metric]),
        "omnibus": omnibus.filter("p is not null").transform(lambda t: holm(t, [], "p", metric)),
    }
