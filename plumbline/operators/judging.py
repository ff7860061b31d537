"""Audit of a pairwise judge against human verdicts, and its calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import whitespace_count

LABELS = ("a", "b", "tie")


def log_len_ratio(a: Column, b: Column) -> Column:
    one = lambda c: F.greatest(whitespace_count(c), F.lit(1))
    return F.log(one(a) / one(b))


def family(model: Column) -> Column:
    return F.substring_index(F.lower(F.trim(model)), "-", 1)


def self_diff(model_a: Column, model_b: Column, own: str) -> Column:
    """1 if only a is of the judge's family, -1 if only b, else 0."""
    return (family(model_a) == own).cast("int") - (family(model_b) == own).cast("int")


def win_value(label: Column) -> Column:
    return F.when(label == "a", 1.0).when(label == "b", 0.0).otherwise(0.5)


def label_from(p: Column, band: float | Column) -> Column:
    return F.when(F.abs(p - 0.5) <= band, "tie").when(p > 0.5, "a").otherwise("b")


def agreement(df: DataFrame, human: str = "human", judge: str = "judge") -> DataFrame:
    """(n, agreement, agreement_decisive, cohen_kappa, tie_rate) in one aggregate; expected agreement 1: kappa 1."""
    h, j = F.col(human), F.col(judge)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = df.agg(F.count("*").alias("n"), share(h == j).alias("po"), F.avg(F.when((h != "tie") & (j != "tie"), F.when(h == j, 1.0).otherwise(0.0))).alias("dec"), share(j == "tie").alias("ties"), *[share(c == x).alias(f"{s}_{x}") for s, c in (("h", h), ("j", j)) for x in LABELS])
    pe = sum((F.col(f"h_{x}") * F.col(f"j_{x}") for x in LABELS), F.lit(0.0))
    return g.select("n", F.col("po").alias("agreement"), F.col("dec").alias("agreement_decisive"), F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).otherwise(1.0).alias("cohen_kappa"), F.col("ties").alias("tie_rate"))


def position(df: DataFrame) -> DataFrame:
    """From ab_winner and ba_winner (both in terms of a and b): consistency, flips, share of wins of the first slot, bias."""
    ab, ba = F.col("ab_winner"), F.col("ba_winner")
    both = (ab != "tie") & (ba != "tie")
    first = F.count_if(ab == "a") + F.count_if(ba == "b")
    decisive = F.count_if(ab != "tie") + F.count_if(ba != "tie")
    rate = F.try_divide(first, decisive)
    return df.agg(F.avg(F.when(ab == ba, 1.0).otherwise(0.0)).alias("consistency"), F.avg(F.when(both, F.when(ab != ba, 1.0).otherwise(0.0))).alias("flip_rate"), rate.alias("first_slot_win_rate"), (rate - 0.5).alias("position_bias"))


def reliability(df: DataFrame, conf: Column, correct: Column, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) over equal bins of [0.5, 1]."""
    b = F.least(F.greatest(F.floor((conf - 0.5) * 2 * bins + 1e-9), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(conf).alias("confidence"), F.avg(F.when(correct, 1.0).otherwise(0.0)).alias("accuracy"))


def calibration_error(table: DataFrame) -> DataFrame:
    return table.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def verbosity(df: DataFrame, edges: tuple[float, ...] = (0.0, 0.1, 0.3, 0.7)) -> DataFrame:
    """(bucket, n, judge_longer, human_longer): how often the longer answer wins, by |log length ratio| (llr)."""
    use = df.where((F.col("judge") != "tie") & (F.col("human") != "tie") & (F.abs("llr") > 1e-9))
    size = F.abs("llr")
    bucket = sum(((size >= e).cast("int") for e in edges[1:]), F.lit(0))
    longer = lambda c: F.avg(F.when((F.col(c) == "a") == (F.col("llr") > 0), 1.0).otherwise(0.0))
    return use.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), longer("judge").alias("judge_longer"), longer("human").alias("human_longer"))


def self_preference(df: DataFrame) -> DataFrame:
    """(n, judge_own, human_own, gap) where exactly one side is of the judge's family (self_diff)."""
    use = df.where(F.col("self_diff") != 0)
    own = lambda c: F.avg(F.when(F.col("self_diff") > 0, win_value(F.col(c))).otherwise(1 - win_value(F.col(c))))
    return use.agg(F.count("*").alias("n"), own("judge").alias("judge_own"), own("human").alias("human_own"), (own("judge") - own("human")).alias("gap"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds average-tie ranks without a window over all rows: ranks of the distinct values come from their counts, which are
    summed block by block in a range partitioning of the values."""
    counts = df.groupBy(value).agg(F.count("*").alias("_c"))
    lo_hi = counts.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    span = ((lo_hi.hi or 0) - (lo_hi.lo or 0)) or 1.0
    block = F.least(F.floor((F.col(value) - (lo_hi.lo or 0)) / span * 256), F.lit(255)).cast("int")
    c = counts.withColumn("_b", block)
    sums = c.groupBy("_b").agg(F.sum("_c").alias("_s"))  # at most 256 rows
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("_c").over(Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = c.join(F.broadcast(sums.select("_b", before.alias("_before"))), "_b").select(value, (F.col("_before") + within + (F.col("_c") + 1) / 2).alias(name))
    return df.join(ranked, value)


def pointwise(df: DataFrame, judge: str = "j", human: str = "h", words: str = "w") -> DataFrame:
    """(n, pearson, spearman, mae, length_slope): slope of the judge's score per log word at equal human score."""
    d = average_ranks(average_ranks(df, judge, "_rj"), human, "_rh").withColumn("_l", F.log(words))
    m = d.agg(F.count("*").alias("n"), F.corr(judge, human).alias("pearson"), F.corr("_rj", "_rh").alias("spearman"), F.avg(F.abs(F.col(judge) - F.col(human))).alias("mae"), F.covar_pop("_l", judge).alias("lj"), F.covar_pop("_l", human).alias("lh"), F.covar_pop(judge, human).alias("jh"), F.var_pop("_l").alias("ll"), F.var_pop(human).alias("hh"))
    slope = F.try_divide(F.col("lj") * F.col("hh") - F.col("jh") * F.col("lh"), F.col("ll") * F.col("hh") - F.col("lh") * F.col("lh"))
    return m.select("n", "pearson", "spearman", "mae", slope.alias("length_slope"))


def logistic(df: DataFrame, features: list[str], y: str, l2: float = 1e-2, most: int = 50) -> np.ndarray:
    """Iteratively reweighted least squares over all rows: each step is one aggregate of the k(k+3)/2 sums; bias first, without penalty."""
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    k = len(x)
    w, pen = np.zeros(k), np.r_[0.0, np.full(k - 1, l2)]
    for _ in range(most):
        z = sum((float(w[i]) * x[i] for i in range(k)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        q = p * (1 - p)
        sums = df.agg(*[F.sum(x[i] * (p - F.col(y))).alias(f"g{i}") for i in range(k)], *[F.sum(x[i] * x[j] * q).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        g = np.array([sums[f"g{i}"] or 0.0 for i in range(k)]) + pen * w
        h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) + np.diag(pen) + 1e-9 * np.eye(k)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logit(p: Column) -> Column:
    c = F.greatest(F.lit(0.02), F.least(F.lit(0.98), p))
    return F.log(c / (1 - c))


def predicted(weights: np.ndarray, features: list[str]) -> Column:
    z = float(weights[0]) + sum((float(v) * F.col(f) for v, f in zip(weights[1:], features)), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def best_tie_band(df: DataFrame, p: str = "p", human: str = "human", steps: int = 25) -> float:
    """Band of a grid 0 .. 0.25 with the best agreement, the first on ties; all bands in one aggregate."""
    row = df.agg(*[F.avg(F.when(label_from(F.col(p), k / 100) == F.col(human), 1.0).otherwise(0.0)).alias(f"b{k}") for k in range(steps + 1)]).first()
    return max(range(steps + 1), key=lambda k: (row[f"b{k}"] or 0.0, -k)) / 100
