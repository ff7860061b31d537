"""Comparison of models: paired and clustered bootstrap, permutation, exact McNemar, leaderboard with tiers.

Scores are reduced to one row per cluster in Spark. Replicates are rows of a range, drawn from a generator seeded by the
replicate's number, so results do not depend on the partitioning."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import detectable, mcnemar, norm_cdf, norm_ppf

#: Clusters up to which a comparison is resampled on numbers sent to all executors.
MOST_CLUSTERS = 2_000_000


def load_scores(df: DataFrame, order: str | None = None) -> DataFrame:
    """(model, item_id, score, cluster): mean of repeated items, cluster of the last row."""
    last = F.max_by("cluster", F.col(order)) if order else F.max("cluster")
    return df.groupBy("model", "item_id").agg(F.avg("score").alias("score"), last.alias("cluster"))


def paired(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(item_id, score_a, score_b, diff, cluster) on shared items; items without a cluster are one of their own."""
    x = scores.where(F.col("model") == a).select("item_id", F.col("score").alias("score_a"), F.col("cluster").alias("ca"))
    y = scores.where(F.col("model") == b).select("item_id", F.col("score").alias("score_b"), F.col("cluster").alias("cb"))
    own = F.concat(F.lit("__item_"), F.col("item_id").cast("string"))
    return x.join(y, "item_id").select("item_id", "score_a", "score_b", (F.col("score_b") - F.col("score_a")).alias("diff"), F.coalesce("ca", "cb", own).alias("cluster"))


def cluster_sums(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("cluster").agg(F.sum("diff").alias("s"), F.count("*").alias("n"))


def _numbers(clusters: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    if clusters.limit(MOST_CLUSTERS + 1).count() > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters; pass coarser ones")
    rows = clusters.orderBy("cluster").select("s", "n").toPandas()
    return rows["s"].to_numpy(float), rows["n"].to_numpy(float)


def replicates(spark: SparkSession, kind: str, s: np.ndarray, n: np.ndarray, count: int, seed: int) -> np.ndarray:
    """``bootstrap``: ratio of sums over clusters drawn with repetition. ``signs``: sum with random signs of the clusters."""
    shared = spark.sparkContext.broadcast((s, n))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, n = shared.value
        k = len(s)
        for pdf in batches:
            out = []
            for r in pdf["id"]:
                rng = np.random.default_rng((seed, int(r)))
                if kind == "bootstrap":
                    w = np.bincount(rng.integers(0, k, k), minlength=k)
                    out.append(float(w @ s / (w @ n)))
                else:
                    out.append(float((rng.integers(0, 2, k) * 2 - 1) @ s))
            yield pd.DataFrame({"id": pdf["id"], "v": out})

    parts = max(1, min(200, count * len(s) // 4_000_000 + 8))
    return spark.range(0, count, 1, parts).mapInPandas(draw, "id long, v double").orderBy("id").toPandas()["v"].to_numpy()


def bca(values: np.ndarray, estimate: float, s: np.ndarray, n: np.ndarray, confidence: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated interval; the jackknife comes from the sums without a further pass."""
    tail = (1 - confidence) / 2
    lo, hi = np.quantile(values, [tail, 1 - tail])
    if values.std() == 0 or len(s) < 3:
        return float(lo), float(hi)
    prop = ((values < estimate).sum() + 0.5 * (values == estimate).sum()) / len(values)
    z0 = norm_ppf(min(max(prop, 1 / (len(values) + 1)), 1 - 1 / (len(values) + 1)))
    jack = (s.sum() - s) / np.maximum(n.sum() - n, 1e-12)
    d = jack.mean() - jack
    a = float((d**3).sum() / (6 * (d**2).sum() ** 1.5)) if (d**2).sum() > 0 else 0.0
    adj = [norm_cdf(z0 + (z0 + norm_ppf(q)) / (1 - a * (z0 + norm_ppf(q)))) for q in (tail, 1 - tail)]
    lo, hi = np.quantile(values, adj)
    return float(lo), float(hi)


@dataclass
class Comparison:
    model_a: str
    model_b: str
    n: int
    clusters: int
    difference: float
    ci_low: float
    ci_high: float
    p_value: float
    test: str
    detectable: float
    significant: bool


def compare(scores: DataFrame, a: str, b: str, boots: int = 2000, confidence: float = 0.95, seed: int = 0) -> Comparison:
    """b against a. Shared items: paired; fewer than two: independent samples. Binary and unclustered: exact McNemar, else sign flips.

    Significant: p below 1 - confidence and zero outside the interval."""
    spark, alpha = scores.sparkSession, 1 - confidence
    pairs = paired(scores, a, b).persist()
    try:
        binary = "score_a in (0, 1) and score_b in (0, 1)"
        r = pairs.agg(F.count("*").alias("n"), F.avg("diff").alias("d"), F.stddev_samp("diff").alias("sd"), F.bool_and(F.expr(binary)).alias("binary"), F.bool_and(F.col("cluster").startswith("__item_")).alias("single"), F.count_if(F.expr("score_b > score_a")).alias("up"), F.count_if(F.expr("score_b < score_a")).alias("down")).first()
        if r.n < 2:
            return _unpaired(scores, a, b, boots, confidence, seed)
        s, n = _numbers(cluster_sums(pairs))
    finally:
        pairs.unpersist()
    d, sd = round(r.d, 12), round(r.sd or 0.0, 12)  # sums of floats differ in the last digits with the partitioning
    s = np.round(s, 12)
    values = replicates(spark, "bootstrap", s, n, boots, seed)
    low, high = bca(values, d, s, n, confidence)
    if r.binary and r.single:
        p, test = mcnemar(r.up, r.down), "mcnemar"
    else:
        test = "permutation"
        seen = abs(s.sum())
        p = 1.0 if seen == 0 else float(((np.abs(replicates(spark, "signs", s, n, boots, seed + 1)) >= seen - 1e-12).sum() + 1) / (boots + 1))
    se = values.std(ddof=1)
    deff = float(se * math.sqrt(r.n) / sd) if sd else 1.0
    return Comparison(a, b, r.n, len(s), d, low, high, p, test, float(detectable(r.n, sd, deff, alpha)), bool(p < alpha and (low > 0 or high < 0)))


def _unpaired(scores: DataFrame, a: str, b: str, boots: int, confidence: float, seed: int) -> Comparison:
    """Different items: percentile interval of the difference of resampled means, p by shuffled labels. Items are their own clusters."""
    pooled, na = _two_samples(scores, a, b)
    x, y = pooled[:na], pooled[na:]
    d = round(float(y.mean() - x.mean()), 12)
    values = two_sample_replicates(scores.sparkSession, "bootstrap", pooled, na, boots, seed)
    tail = (1 - confidence) / 2
    low, high = map(float, np.quantile(values, [tail, 1 - tail]))
    p = float(((np.abs(two_sample_replicates(scores.sparkSession, "labels", pooled, na, boots, seed + 1)) >= abs(d) - 1e-12).sum() + 1) / (boots + 1))
    var = lambda v: v.var(ddof=1) / len(v) if len(v) > 1 else 0.0
    z = norm_ppf(1 - tail)
    n = len(pooled)
    return Comparison(a, b, n, n, d, low, high, p, "unpaired", z * math.sqrt(var(x) + var(y)), bool(p < 1 - confidence and (low > 0 or high < 0)))


def _two_samples(scores: DataFrame, a: str, b: str) -> tuple[np.ndarray, int]:
    """The scores of a, then those of b, each in order of size, and how many are of a."""
    both = scores.where(F.col("model").isin(a, b) & F.col("score").isNotNull()).select("model", F.round("score", 12).alias("score"))
    if both.limit(MOST_CLUSTERS + 1).count() > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} items; pass fewer")
    rows = both.orderBy("model", "score").toPandas()
    x, y = (rows.loc[rows["model"] == m, "score"].to_numpy(float) for m in (a, b))
    if not len(x) or not len(y):
        raise ValueError("a model has no scores")
    return np.concatenate([x, y]), len(x)


def two_sample_replicates(spark: SparkSession, kind: str, pooled: np.ndarray, na: int, count: int, seed: int) -> np.ndarray:
    """Mean of the second sample less that of the first. ``bootstrap``: each drawn with repetition. ``labels``: after a shuffle of all."""
    shared = spark.sparkContext.broadcast(pooled)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        x, y = v[:na], v[na:]
        for pdf in batches:
            out = []
            for r in pdf["id"]:
                rng = np.random.default_rng((seed, int(r)))
                if kind == "bootstrap":
                    out.append(float(-x[rng.integers(0, len(x), len(x))].mean() + y[rng.integers(0, len(y), len(y))].mean()))
                else:
                    w = rng.permutation(v)
                    out.append(float(w[na:].mean() - w[:na].mean()))
            yield pd.DataFrame({"id": pdf["id"], "v": out})

    parts = max(1, min(200, count * len(pooled) // 4_000_000 + 8))
    return spark.range(0, count, 1, parts).mapInPandas(draw, "id long, v double").orderBy("id").toPandas()["v"].to_numpy()


def all_pairs(scores: DataFrame) -> DataFrame:
    """(model_a, model_b, n, mean_a, mean_b, diff): every pair in order of the mean, from one join on items."""
    means = scores.groupBy("model").agg(F.avg("score").alias("mean"))
    x = scores.join(F.broadcast(means), "model")
    a, b = x.select("item_id", F.col("model").alias("model_a"), F.col("score").alias("sa"), F.col("mean").alias("mean_a")), x.select("item_id", F.col("model").alias("model_b"), F.col("score").alias("sb"), F.col("mean").alias("mean_b"))
    j = a.join(b, "item_id").where((F.col("mean_a") > F.col("mean_b")) | ((F.col("mean_a") == F.col("mean_b")) & (F.col("model_a") < F.col("model_b"))))
    return j.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.first("mean_a").alias("mean_a"), F.first("mean_b").alias("mean_b"), F.avg(F.col("sb") - F.col("sa")).alias("diff"))


def compare_all(scores: DataFrame, ranked: list[str], boots: int = 1000, confidence: float = 0.95, seed: int = 0) -> list[Comparison]:
    """``compare`` of every pair of models, the better ranked one first, in one job: one join on items, sums per pair and cluster, and
    each pair resampled in a task of its own. Pairs that share fewer than two items are compared one by one."""
    spark = scores.sparkSession
    place = F.create_map(*[x for k, m in enumerate(ranked) for x in (F.lit(m), F.lit(k))])
    x = scores.where(F.col("model").isin(*ranked)).withColumn("place", F.element_at(place, F.col("model")))
    side = lambda t: x.select("item_id", F.col("place").alias(f"p{t}"), F.col("score").alias(f"s{t}"), F.col("cluster").alias(f"c{t}"))
    own = F.concat(F.lit("__item_"), F.col("item_id").cast("string"))
    j = side("a").join(side("b"), "item_id").where("pa < pb").select("pa", "pb", "sa", "sb", (F.col("sb") - F.col("sa")).alias("diff"), F.coalesce("ca", "cb", own).alias("cluster"))
    per = j.groupBy("pa", "pb", "cluster").agg(F.sum("diff").alias("s"), F.count("*").alias("n"), F.sum(F.col("diff") * F.col("diff")).alias("q"), F.bool_and(F.expr("sa in (0, 1) and sb in (0, 1)")).alias("binary"), F.count_if(F.col("diff") > 0).alias("up"), F.count_if(F.col("diff") < 0).alias("down"))
    alpha = 1 - confidence

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_CLUSTERS:
            raise ValueError(f"more than {MOST_CLUSTERS} clusters; pass coarser ones")
        pdf = pdf.sort_values("cluster")
        s, n = np.round(pdf["s"].to_numpy(float), 12), pdf["n"].to_numpy(float)
        total, k = int(n.sum()), len(s)
        d = round(float(pdf["s"].sum() / total), 12)
        sd = round(math.sqrt(max(0.0, float(pdf["q"].sum()) - total * d * d) / max(1, total - 1)), 12)
        values = np.empty(boots)
        for r in range(boots):
            w = np.bincount(np.random.default_rng((seed, r)).integers(0, k, k), minlength=k)
            values[r] = w @ s / (w @ n)
        low, high = bca(values, d, s, n, confidence)
        seen = abs(s.sum())
        if bool(pdf["binary"].all()) and bool(pdf["cluster"].str.startswith("__item_").all()):
            p, test = mcnemar(int(pdf["up"].sum()), int(pdf["down"].sum())), "mcnemar"
        else:
            flips = [abs(float((np.random.default_rng((seed + 1, r)).integers(0, 2, k) * 2 - 1) @ s)) for r in range(boots)] if seen else []
            p, test = (float((sum(v >= seen - 1e-12 for v in flips) + 1) / (boots + 1)) if seen else 1.0), "permutation"
        deff = float(values.std(ddof=1) * math.sqrt(total) / sd) if sd else 1.0
        row = (int(key[0]), int(key[1]), total, k, d, low, high, p, test, float(detectable(total, sd, deff, alpha)) if total > 1 else math.inf, bool(p < alpha and (low > 0 or high < 0)))
        return pd.DataFrame([row], columns=["pa", "pb", "n", "clusters", "difference", "ci_low", "ci_high", "p_value", "test", "detectable", "significant"])

    rows = per.groupBy("pa", "pb").applyInPandas(one, "pa int, pb int, n long, clusters int, difference double, ci_low double, ci_high double, p_value double, test string, detectable double, significant boolean").collect()
    done = {(r.pa, r.pb): Comparison(ranked[r.pa], ranked[r.pb], *list(r)[2:]) for r in rows if r.n > 1}
    pairs = [(a, b) for a in range(len(ranked)) for b in range(a + 1, len(ranked))]
    return [done.get(k) or _unpaired(scores, ranked[k[0]], ranked[k[1]], boots, confidence, seed) for k in pairs]


def leaderboard(scores: DataFrame, boots: int = 1000, confidence: float = 0.95, method: str = "holm", seed: int = 0, most_models: int = 60) -> DataFrame:
    """(rank, model, mean, n, tier): a model starts a new tier when it is significantly worse than the leader of the current one."""
    spark = scores.sparkSession
    scores = scores.persist()
    try:
        rows = scores.groupBy("model").agg(F.avg("score").alias("mean"), F.count("*").alias("n")).orderBy(F.desc("mean"), "model").limit(most_models + 1).collect()
        if len(rows) > most_models:
            raise ValueError(f"more than {most_models} models")
        done = compare_all(scores, [x.model for x in rows], boots, confidence, seed)
    finally:
        scores.unpersist()
    from ..functions.stats import adjust

    if done:
        pdf = pd.DataFrame([asdict(c) for c in done])
        pdf["key"] = pdf["model_a"] + "|" + pdf["model_b"]
        adj = adjust(spark.createDataFrame(pdf[["key", "p_value"]]), "p_value", method).toPandas().set_index("key")["p_adjusted"].to_dict()
        worse = {(c.model_a, c.model_b): adj[f"{c.model_a}|{c.model_b}"] < 1 - confidence and (c.ci_high < 0 or c.ci_low > 0) for c in done}
    tier, leader, out = 1, rows[0].model if rows else None, []
    for k, x in enumerate(rows):
        if k and worse[leader, x.model]:
            tier, leader = tier + 1, x.model
        out.append((k + 1, x.model, float(x["mean"]), int(x.n), tier))
    return spark.createDataFrame(out, "rank int, model string, mean double, n long, tier int")
