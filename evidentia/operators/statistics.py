"""Agreement, calibration, resampling and selection statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.numeric import rounded
from evidentia.operators.metrics import auroc_ap


def weighted_kappa(pairs: DataFrame, size: int = 4) -> DataFrame:
    """One row (kappa, n): quadratic weighted kappa of (l, r) grades below `size`; null without pairs, one if neither
    observed nor expected disagreement, zero if none is expected."""
    cells = pairs.groupBy("l", "r").agg(F.count("*").alias("c"))
    weight = lambda a, b: F.pow(F.col(a) - F.col(b), F.lit(2.0)) / float((size - 1) ** 2)
    left, right = cells.groupBy("l").agg(F.sum("c").alias("lc")), cells.groupBy("r").agg(F.sum("c").alias("rc"))
    expected = left.crossJoin(right).agg(F.sum(F.col("lc") * F.col("rc") * weight("l", "r")).alias("e"))  # size rows each
    observed = cells.agg(F.sum(F.col("c") * weight("l", "r")).alias("o"), F.sum("c").alias("n"))
    e, o = F.col("e") / (F.col("n") * F.col("n")), F.col("o") / F.col("n")
    kappa = F.when(F.col("n").isNull(), None).when((e == 0) & (o == 0), 1.0).when(e == 0, 0.0).otherwise(1 - F.try_divide(o, e))
    return observed.crossJoin(expected).select(rounded(kappa).alias("kappa"), F.coalesce("n", F.lit(0)).alias("n"))  # one row each


def group_folds(rows: DataFrame, folds: int = 5) -> DataFrame:
    """(group, fold): whole groups dealt to folds, large ones first, each to the fold with the fewest rows of the group's
    commoner label, then the fewest rows, then the lowest number. rows: (group, label 0/1).

    One row a group is folded in order by an aggregate; a benchmark has some dozens of groups.
    """
    groups = rows.groupBy("group").agg(F.sum(1 - F.col("label")).cast("int").alias("c0"), F.sum("label").cast("int").alias("c1"))
    listed = groups.agg(F.array_sort(F.collect_list(F.struct((-(F.col("c0") + F.col("c1"))).alias("order"), F.col("group").alias("name"), "c0", "c1"))).alias("g"))
    empty = F.array(*[F.struct(F.lit(0).alias("c0"), F.lit(0).alias("c1")) for _ in range(folds)])
    start = F.struct(empty.alias("held"), F.array().cast("array<int>").alias("out"))

    def deal(s: Column, g: Column) -> Column:
        major = g["c1"] >= g["c0"]
        cost = F.transform(s["held"], lambda h, i: F.struct(F.when(major, h["c1"]).otherwise(h["c0"]).alias("a"), (h["c0"] + h["c1"]).alias("b"), i.alias("i")))
        best = F.array_min(cost)["i"]
        held = F.transform(s["held"], lambda h, i: F.struct((h["c0"] + F.when(i == best, g["c0"]).otherwise(0)).alias("c0"), (h["c1"] + F.when(i == best, g["c1"]).otherwise(0)).alias("c1")))
        return F.struct(held.alias("held"), F.concat(s["out"], F.array(best)).alias("out"))

    dealt = listed.select("g", F.aggregate("g", start, deal, lambda s: s["out"]).alias("f"))
    return dealt.select(F.explode(F.arrays_zip("g", "f")).alias("x")).select(F.col("x.g.name").alias("group"), F.col("x.f").alias("fold"))


def balanced_thresholds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key of (keys, label, score) the threshold of best balanced accuracy: then of the larger share predicted
    positive, then the lowest. Thresholds lie between scores, and one beyond either end."""
    by = rows.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    order = Window.partitionBy(*keys).orderBy("score") if keys else Window.orderBy("score")
    every = Window.partitionBy(*keys)
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = by.select(*keys, "score", F.lead("score").over(order).alias("next"), F.lag("score").over(order).alias("prior"), F.sum("p").over(up).alias("lp"), F.sum("q").over(up).alias("lq"), F.sum("p").over(every).alias("tp"), F.sum("q").over(every).alias("tq"))
    row = lambda t, lp, lq: F.struct(t.alias("t"), lp.cast("long").alias("lp"), lq.cast("long").alias("lq"))
    options = F.array(row(F.coalesce((F.col("score") + F.col("next")) / 2, F.col("score") + 1.0), F.col("lp"), F.col("lq")), F.when(F.col("prior").isNull(), row(F.col("score") - 1.0, F.lit(0), F.lit(0))))
    each = placed.select(*keys, "tp", "tq", F.explode(F.array_compact(options)).alias("o"))
    accuracy = rounded((F.try_divide(F.col("tp") - F.col("o.lp"), "tp") + F.try_divide("o.lq", "tq")) / 2, 12)
    share = F.col("tp") - F.col("o.lp") + F.col("tq") - F.col("o.lq")
    best = each.groupBy(*keys).agg(F.max(F.struct(accuracy.alias("a"), share.alias("s"), (-F.col("o.t")).alias("t"))).alias("b"))
    return best.select(*keys, (-F.col("b.t")).alias("threshold"), F.col("b.a").alias("balanced_accuracy"))


def answerability_cv(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """One row of coverage, selective risk and abstention precision, each row's threshold learned on the other folds.

    rows: (id, group, label, score); folds: (group, fold).
    """
    placed = rows.join(F.broadcast(folds), "group")  # one row a group
    numbers = folds.select(F.col("fold").alias("test")).distinct()
    train = placed.join(F.broadcast(numbers), F.col("fold") != F.col("test"))  # a few folds
    cut = balanced_thresholds(train.select("test", "label", "score"), ["test"])
    judged = placed.join(F.broadcast(cut), F.col("fold") == F.col("test")).withColumn("yes", F.col("score") >= F.col("threshold"))
    n = lambda c: F.count(F.when(c, 1))
    return judged.agg(rounded(n(F.col("yes")) / F.count("*")).alias("coverage"), rounded(F.try_divide(n(F.col("yes") & (F.col("label") == 0)), n(F.col("yes")))).alias("selective_risk"), rounded(F.try_divide(n(~F.col("yes") & (F.col("label") == 0)), n(~F.col("yes")))).alias("abstention_precision"))


def scaled_features(rows: DataFrame, names: list[str]) -> DataFrame:
    """(id, fold, z): features scaled by mean and population deviation of the other folds, a zero deviation counting as one, and summed."""
    numbers = rows.select(F.col("fold").alias("test")).distinct()
    train = rows.join(F.broadcast(numbers), F.col("fold") != F.col("test"))  # a few folds
    stats = train.groupBy("test").agg(*[f(c).alias(f"{p}_{c}") for c in names for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = sum(((F.col(c) - F.col(f"m_{c}")) / F.when(F.abs(F.col(f"s_{c}")) < 1e-12, 1.0).otherwise(F.col(f"s_{c}")) for c in names), F.lit(0.0))
    return rows.join(F.broadcast(stats), F.col("fold") == F.col("test")).select("id", "fold", rounded(z).alias("z"))


def holm(tests: DataFrame) -> DataFrame:
    """(name, p, adjusted): step-down adjustment; a family of tests is a few rows."""
    order = Window.orderBy("p", "name")
    raw = F.least(F.lit(1.0), F.col("p") * (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1))
    return tests.withColumn("raw", raw).select("name", "p", rounded(F.max("raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("adjusted"))


def kendall_tau(orders: DataFrame) -> DataFrame:
    """One row (tau) of two orders without ties (name, a, b), by pairs of systems."""
    x, y = orders.alias("x"), orders.alias("y")
    sign = F.signum(F.col("x.a") - F.col("y.a")) * F.signum(F.col("x.b") - F.col("y.b"))
    return x.join(y, F.col("x.name") < F.col("y.name")).agg(rounded(F.avg(sign)).alias("tau"))


#: Rounds of a resampling, and those that a task draws at once.
ROUNDS, TOGETHER = 10_000, 64


def draws(kind: str, first: int, rounds: int, size: int) -> np.ndarray:
    """Numbers below 2^52 that hang on (kind, round, place) alone, of `rounds` rounds from `first` on, a row each, for the places below `size`."""
    found = (int(md5(f"{kind}:{r}:{k}".encode()).hexdigest()[:13], 16) for r in range(first, first + rounds) for k in range(size))
    return np.fromiter(found, np.int64, rounds * size).reshape(rounds, size)


def in_rounds(row: DataFrame, rounds: int, drawn: Callable[[pd.Series, int, int], pd.DataFrame], schema: str) -> DataFrame:
    """Rounds dealt over tasks: `drawn` gets the one row and the first and the number of some rounds, and gives a row for each of them."""
    spark = row.sparkSession
    dealt = spark.range(0, rounds, TOGETHER, max(1, min(spark.sparkContext.defaultParallelism, rounds // TOGETHER))).withColumnRenamed("id", "first").crossJoin(F.broadcast(row))  # one row

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            for _, r in block.iterrows():
                yield drawn(r, int(r["first"]), min(TOGETHER, rounds - int(r["first"])))

    return dealt.mapInPandas(run, schema)


def _resampled(row: pd.Series, first: int, rounds: int) -> pd.DataFrame:
    """Mean of a bootstrap and of a sign flip of clusters (s, n), for each round."""
    s, n = np.asarray(row["s"], np.float64), np.asarray(row["n"], np.int64)
    if not len(s):
        return pd.DataFrame({"boot": [], "flip": []}, dtype="float64")
    picks = draws("b", first, rounds, len(s)) % len(s)
    signs = np.where(draws("p", first, rounds, len(s)) % 2 == 0, 1.0, -1.0)
    return pd.DataFrame({"boot": s[picks].sum(1) / n[picks].sum(1), "flip": (signs * s).sum(1) / n.sum()})


def resample(deltas: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row on (group, delta): mean, cluster bootstrap interval, p of a sign-flip permutation by cluster, effect size.

    Draws are hashes of round and cluster, not a generator's, so they are the same on every engine. A task has the clusters' sums
    once for each TOGETHER rounds, and draws a matrix of rounds times clusters.
    """
    groups = deltas.groupBy("group").agg(F.sum("delta").alias("s"), F.count("*").alias("n"))
    clusters = groups.agg(F.array_sort(F.collect_list(F.struct("group", "s", "n"))).alias("c")).select(F.col("c.s").alias("s"), F.col("c.n").alias("n"))
    drawn = in_rounds(clusters, rounds, _resampled, "boot double, flip double")
    mean = deltas.agg(F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"))
    both = drawn.crossJoin(F.broadcast(mean.select(F.abs("mean").alias("least"))))  # one row
    found = both.agg(*[rounded(F.percentile("boot", F.lit(p))).alias(n) for n, p in (("low", 0.025), ("high", 0.975))], ((F.count(F.when(F.abs("flip") >= F.col("least") - 1e-12, 1)) + 1) / F.lit(rounds + 1.0)).alias("p"))
    return mean.crossJoin(found).select(rounded(F.col("mean")).alias("mean"), "low", "high", rounded(F.col("p")).alias("p"), rounded(F.coalesce(F.try_divide("mean", "sd"), F.lit(0.0))).alias("effect"))  # one row each


def select_out_of_fold(scores: DataFrame) -> DataFrame:
    """(fold, candidate) best on the other folds by mean m1, then m2, then m3, then the first name. scores: (fold, candidate, m1, m2, m3)."""
    numbers = scores.select(F.col("fold").alias("test")).distinct()
    means = scores.join(F.broadcast(numbers), F.col("fold") != F.col("test")).groupBy("test", "candidate").agg(*[rounded(F.avg(m)).alias(m) for m in ("m1", "m2", "m3")])  # a few folds
    order = Window.partitionBy("test").orderBy(*[F.col(m).desc() for m in ("m1", "m2", "m3")], "candidate")
    return means.withColumn("k", F.row_number().over(order)).where("k = 1").select(F.col("test").alias("fold"), "candidate")


def promotion(metrics: DataFrame, guards: dict[str, float], gains: dict[str, float]) -> DataFrame:
    """(candidate, guarded, improved, promoted): no guarded metric falls by more than allowed, and some gain is reached.

    metrics: (candidate, one change column for each metric).
    """
    guarded, improved = F.lit(True), F.lit(False)
    for c, least in guards.items():
        guarded = guarded & (F.col(c) >= least)
    for c, least in gains.items():
        improved = improved | (F.col(c) >= least)
    return metrics.select("candidate", guarded.alias("guarded"), improved.alias("improved"), (guarded & improved).alias("promoted"))


def backend_gate(metrics: DataFrame, guards: dict[str, float]) -> DataFrame:
    """(candidate, guarded, passes): a backend has to keep the guarded metrics, it need not gain."""
    return promotion(metrics, guards, {}).select("candidate", "guarded", F.col("guarded").alias("passes"))


def _fixed_coverage(row: pd.Series, first: int, rounds: int) -> pd.DataFrame:
    """Share of wrong labels among the best `take` rows drawn, for each round."""
    wrong = 1 - np.asarray(row["labels"], np.int64)
    if not len(wrong) or not row["take"]:
        return pd.DataFrame({"m": []}, dtype="float64")
    best = np.sort(draws("c", first, rounds, len(wrong)) % len(wrong), 1)[:, : row["take"]]
    return pd.DataFrame({"m": wrong[best].sum(1) / row["take"]})


def answerability_oof(rows: DataFrame, names: list[str], coverage: float, rounds: int = ROUNDS) -> DataFrame:
    """One row on rows (id, group, label, fold, features `names`): AUROC, tie-aware average precision, coverage, selective risk and
    abstention precision out of fold, and the errors at a fixed coverage with their bootstrap interval.

    Features are scaled and the threshold is learned on the other folds. Fixed coverage takes the best round(n * coverage) rows
    by score, then id, half to even. A bootstrap round draws n rows with replacement by hashes of round and place.
    """
    scored = scaled_features(rows, names).join(rows.select("id", "label"), "id").withColumnRenamed("z", "score")
    every = scored.select(F.col("fold").alias("test")).distinct()
    train = scaled_for(rows, names, every)
    cut = balanced_thresholds(train, ["test"])
    judged = scored.join(F.broadcast(cut), F.col("fold") == F.col("test")).withColumn("yes", F.col("score") >= F.col("threshold"))
    n = lambda c: F.count(F.when(c, 1))
    risk = judged.agg(rounded(n(F.col("yes")) / F.count("*")).alias("coverage"), rounded(F.try_divide(n(F.col("yes") & (F.col("label") == 0)), n(F.col("yes")))).alias("selective_risk"), rounded(F.try_divide(n(~F.col("yes") & (F.col("label") == 0)), n(~F.col("yes")))).alias("abstention_precision"))
    order = Window.orderBy(F.col("score").desc(), "id")
    total = F.count("*").over(Window.partitionBy())
    placed = scored.withColumn("k", F.row_number().over(order)).withColumn("n", total)  # one row a query of a benchmark
    take = F.bround(F.col("n") * F.lit(coverage))
    fixed = placed.where(F.col("k") <= take).agg(n(F.col("label") == 0).alias("fixed_errors"))
    labels = placed.agg(F.array_sort(F.collect_list(F.struct("k", "label"))).alias("l"), F.first(take).cast("int").alias("take")).select(F.col("l.label").alias("labels"), "take")
    rates = in_rounds(labels, rounds, _fixed_coverage, "m double").agg(*[rounded(F.percentile("m", F.lit(p))).alias(c) for c, p in (("low", 0.025), ("high", 0.975))])
    return auroc_ap(scored.select("id", "label", "score")).select("auroc", "ap").crossJoin(risk).crossJoin(fixed).crossJoin(rates)  # one row each


def scaled_for(rows: DataFrame, names: list[str], numbers: DataFrame) -> DataFrame:
    """(test, label, score) of every row outside fold `test`, scaled by the mean and population deviation of those rows."""
    train = rows.join(F.broadcast(numbers), F.col("fold") != F.col("test"))  # a few folds
    by = Window.partitionBy("test")
    z = F.lit(0.0)
    for c in names:
        mean, dev = F.avg(c).over(by), F.stddev_pop(c).over(by)
        z = z + (F.col(c) - mean) / F.when(F.abs(dev) < 1e-12, 1.0).otherwise(dev)
    return train.select("test", "label", rounded(z).alias("score"))


def comparisons(scores: DataFrame, baseline: str, rounds: int = ROUNDS) -> DataFrame:
    """(name, mean, low, high, p, effect, adjusted): resample() of every system's scores (name, query_id, group, score) less the baseline's, the p adjusted over all."""
    base = scores.where(F.col("name") == baseline).select("query_id", F.col("score").alias("base"))
    names = sorted(r["name"] for r in scores.where(F.col("name") != baseline).select("name").distinct().collect())  # an experiment's systems
    rows = [resample(scores.where(F.col("name") == name).join(base, "query_id").select("group", rounded(F.col("score") - F.col("base")).alias("delta")), rounds).withColumn("name", F.lit(name)) for name in names]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.join(holm(every.select("name", "p")).select("name", "adjusted"), "name")
