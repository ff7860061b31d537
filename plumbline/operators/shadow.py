"""Comparison of mirrored answers: side statistics, agreement, tallies, histogram, worst disagreements.

Verdict rules of releases are left to the caller."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.stats import wilson
from ..functions.text import ascii_normalize, ascii_words, jaccard


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of word lists (no SQL equivalent); memory of equal pairs within a batch."""
    memo: dict[tuple, float] = {}
    out = []
    for x, y in zip(a, b):
        key = (x, y)
        if key not in memo:
            memo[key] = difflib.SequenceMatcher(None, (x or "").split(), (y or "").split(), autojunk=False).ratio()
        out.append(memo[key])
    return pd.Series(out)


def comparable(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("primary.error").isNull() & F.col("shadow.error").isNull())


def side_stats(pairs: DataFrame) -> DataFrame:
    """Both sides in one pass. Error rate over all pairs, everything else over comparable ones."""
    ok = F.col("primary.error").isNull() & F.col("shadow.error").isNull()
    x = pairs.select(ok.alias("ok"), F.explode(F.array(F.struct(F.lit("primary").alias("side"), F.col("primary").alias("s")), F.struct(F.lit("shadow").alias("side"), F.col("shadow").alias("s")))).alias("x")).select("ok", "x.side", "x.s.*")
    good = lambda c: F.when(F.col("ok"), F.col(c))
    return x.groupBy("side").agg(F.count("*").alias("n"), F.avg(good("cost")).alias("mean_cost"), F.sum(good("cost")).alias("total_cost"), F.avg(good("tokens_out")).alias("mean_tokens_out"), F.percentile(good("latency"), 0.5).alias("p50"), F.percentile(good("latency"), 0.95).alias("p95"), F.avg(F.when(F.col("error").isNotNull(), 1.0).otherwise(0.0)).alias("error_rate"), F.avg(F.when(F.col("ok"), F.when(F.col("finish_reason") == "length", 1.0).otherwise(0.0))).alias("truncated_rate"))


def with_agreement(pairs: DataFrame) -> DataFrame:
    a, b = F.col("primary.text"), F.col("shadow.text")
    return comparable(pairs).withColumn("same", ascii_normalize(a) == ascii_normalize(b)).withColumn("jaccard", jaccard(F.array_distinct(ascii_words(a)), F.array_distinct(ascii_words(b))))


def agreement(pairs: DataFrame, near: float = 0.6) -> DataFrame:
    x = with_agreement(pairs)
    return x.agg(F.count("*").alias("n"), F.avg(F.col("same").cast("double")).alias("exact"), F.avg(F.when(F.col("jaccard") >= near, 1.0).otherwise(0.0)).alias("near"), F.avg("jaccard").alias("mean_jaccard"))


def histogram(values: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """(bin, n) over [0, 1], the last bin closed; empty bins are there with 0."""
    counts = values.groupBy(F.least(F.floor(value * bins + 1e-12), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def tally(outcomes: DataFrame, outcome: str = "outcome") -> DataFrame:
    """(win, loss, tie, error, win_rate, low, high, non_loss_rate); nothing decided: win rate 0.5."""
    c = lambda x: F.count_if(F.col(outcome) == x)
    t = outcomes.agg(*[c(x).alias(x) for x in ("win", "loss", "tie", "error")])
    decided, judged = F.col("win") + F.col("loss"), F.col("win") + F.col("loss") + F.col("tie")
    low, high = wilson(F.col("win"), decided)
    return t.select("win", "loss", "tie", "error", F.coalesce(F.try_divide("win", decided), F.lit(0.5)).alias("win_rate"), low.alias("low"), high.alias("high"), F.coalesce(F.try_divide(F.col("win") + F.col("tie"), judged), F.lit(0.0)).alias("non_loss_rate"))


def worst(rows: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` disagreements to read first: judged losses, wins, errors, ties, and the least similar first."""
    rank = F.when(F.col("outcome") == "loss", 0).when(F.col("outcome") == "win", 1).when(F.col("outcome") == "error", 2).otherwise(3)
    return rows.where(~F.col("same")).orderBy(rank, "jaccard", "id").limit(k)


def both_orders(ab: Column, ba: Column) -> Column:
    """Outcome for the shadow from verdicts in both orders (in terms of sides primary, shadow, tie): a flip is a tie."""
    return F.when(ab.isNull() | ba.isNull(), "error").when(ab != ba, "tie").when(ab == "shadow", "win").when(ab == "primary", "loss").otherwise("tie")
