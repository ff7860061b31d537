"""Implausible readings in measurement series, flagged per source against that source's own behaviour.

Plan: readings are brought together by (series, time block). A series, however long, is cut into blocks of ``block_days`` and
every block also gets the readings of ``halo_days`` on either side, so a series that holds a third of all
rows is spread over many tasks and nothing ever spans a whole series. Levels, runs and deviations are worked out for all
blocks of an Arrow batch at once. Per-series quantile summaries are built with partial aggregation (``percentile_approx``:
mergeable Greenwald-Khanna sketches), once over the whole series and once per day of the week, the cyclic context of
daily data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sizes import small
from ..session import cut_lineage


@dataclass(frozen=True)
class SpikeConfig:
    #: Kinds (text before ``/``) whose values lie in 0..1, as a regular expression.
    unit_kinds: str = r"(_rate|_score|^judge_score)$"
    fence: float = 4.0  # expanded interquartile fences of the residuals: quartile -/+ fence * IQR
    min_relative: float = 0.3  # a spike leaves the local level by at least this share of it ...
    min_fences: float = 7.0  # ... or by this many interquartile ranges
    neighbours: int = 6  # readings on each side that give the local level
    weeks: int = 3  # weeks on each side for the level of the same day of the week
    stuck_run: int = 5  # equal readings in a row that count as stuck
    stuck_share: float = 0.25  # a series with more repeats than this is not one that changes daily
    zero_share: float = 0.2  # a series with more zeros than this is often zero
    block_days: int = 128
    halo_days: int = 42  # a gap longer than this ends a run and a neighbourhood
    accuracy: int = 2000


def clean_readings(df: DataFrame, metric: str = "metric", date: str = "date", value: str = "value") -> DataFrame:
    """One row (metric, day, v) per series and day: repeated deliveries collapse, null values, NaN and unreadable
    dates leave. Of differing values for a day the one delivered last counts."""
    order = F.col("recorded_at") if "recorded_at" in df.columns else F.lit(0)
    return (
        df.select(F.col(metric).alias("metric"), F.try_to_date(F.col(date).cast("string"), "yyyy-MM-dd").alias("day"), F.col(value).cast("double").alias("v"), order.alias("o"))
        .where(F.col("metric").isNotNull() & F.col("day").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
        .groupBy("metric", "day")
        .agg(F.max_by("v", F.struct("o", "v")).alias("v"))
    )


def _medians(rows: np.ndarray) -> np.ndarray:
    """Of each row without its NaN; NaN for empty rows. Sorts ``rows`` in place."""
    rows.sort(axis=1)  # NaN go last
    n = (~np.isnan(rows)).sum(1)
    at = np.arange(len(rows))
    out = (rows[at, np.maximum(n - 1, 0) // 2] + rows[at, np.maximum(n, 1) // 2 * (n > 0)]) / 2
    return np.where(n > 0, out, np.nan)


def neighbourhoods(n: np.ndarray, v: np.ndarray, bad: np.ndarray, block: np.ndarray, cfg: SpikeConfig) -> dict[str, np.ndarray]:
    """What each reading looks like beside others of its block; readings in order of block and day.

    ``run``: length of its run of equal values; ``step``: 0 where it repeats the reading before; ``before``, ``after``, ``weekly``: medians of
    the nearest good readings on either side and of those some weeks away on the same day; ``n_before``, ``n_after``: how many there are."""
    reach, total = 7 * cfg.weeks, len(n)
    same = np.r_[False, block[1:] == block[:-1]]
    repeat = same & np.r_[False, (v[1:] == v[:-1]) & (n[1:] - n[:-1] <= cfg.halo_days)]
    run = np.cumsum(~repeat) - 1
    good = np.flatnonzero(~bad)
    seen = np.cumsum(~bad) - ~bad  # good readings before each
    out = {"run": np.bincount(run)[run] if total else run, "step": (~repeat).astype(np.int32)}
    padded = np.append(good, 0)
    for name, start, sign in (("before", seen - 1, -1), ("after", seen + ~bad, 1)):
        values = np.full((total, cfg.neighbours), np.nan)
        for k in range(cfg.neighbours):
            at = start + sign * k
            there = (at >= 0) & (at < len(good))
            g = padded[np.where(there, at, len(good))]
            there &= (block[g] == block) & (np.abs(n[g] - n) <= reach)
            values[there, k] = v[g[there]]
        out[f"n_{name}"] = (~np.isnan(values)).sum(1)
        out[name] = _medians(values)
    key = block.astype(np.int64) * (1 << 32) + n
    known, values = key[good], np.full((total, 2 * cfg.weeks), np.nan)
    for k, days in enumerate([7 * w for w in range(-cfg.weeks, cfg.weeks + 1) if w]):
        at = np.searchsorted(known, key + days)
        there = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == key + days) if len(known) else np.zeros(total, bool)
        values[there, k] = v[good[at[there]]]
    out["weekly"] = _medians(values)
    return out


def _local(batches: Iterator[pd.DataFrame], cfg: SpikeConfig) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if not len(pdf):
            continue
        sizes = pdf["n"].map(len).to_numpy()
        n, v, bad, here = (np.concatenate(pdf[c].to_numpy()) for c in ("n", "v", "bad", "here"))
        n, v, bad, here = n.astype(np.int64), v.astype(float), bad.astype(bool), here.astype(bool)
        x = neighbourhoods(n, v, bad, np.repeat(np.arange(len(pdf)), sizes), cfg)
        with np.errstate(invalid="ignore"):
            sides = np.stack([x["before"], x["after"]])
            middle = np.where(np.isnan(sides).any(0), np.where(np.isnan(sides[0]), sides[1], sides[0]), (sides[0] + sides[1]) / 2)
            level = np.abs(np.where(np.isnan(middle), v, middle))
            # the deviation that no context explains: the smallest of those from the level before, after and on that weekday
            off = v - np.stack([x["before"], x["after"], x["weekly"]])
            low, high = np.where(np.isnan(off), -1e300, off).max(0), np.where(np.isnan(off), 1e300, off).min(0)
            dev = np.where(low < 0, low, np.where(high > 0, high, 0.0))
            dev[~((x["n_after"] >= 2) | ((x["n_after"] == 1) & (x["n_before"] >= 1)))] = np.nan
            residual = np.where(bad, np.nan, (v - middle) / np.maximum(level, 1e-12))
        metric = np.repeat(pdf["metric"].to_numpy(), sizes)
        yield pd.DataFrame({"metric": metric, "n": n, "v": v, "bad": bad, "run_n": x["run"], "step": x["step"], "level": level, "dev": dev, "residual": residual})[here]


def flag_spikes(df: DataFrame, cfg: SpikeConfig = SpikeConfig(), **names: str) -> DataFrame:
    """(metric, day, v, reason) of every bad reading; ``reason`` is impossible, stuck or spike.

    Nulls, NaN, missing days: no readings, never flagged, skipped in runs and neighbourhoods. Repeated rows: one
    reading. Empty table: empty result. Infinite values are impossible. Extra columns are ignored. A series of few
    readings has too little context for spikes and only gets the other two checks."""
    c = cfg
    readings = clean_readings(df, **names)
    kind = F.element_at(F.split("metric", "/"), 1)
    impossible = (F.col("v") < 0) | (F.abs("v") == float("inf")) | (kind.rlike(c.unit_kinds) & (F.col("v") > 1))
    n = F.datediff("day", F.lit("1970-01-01"))
    block = F.floor(n / c.block_days)
    homes = F.array_distinct(F.array(block, F.floor((n - c.halo_days) / c.block_days), F.floor((n + c.halo_days) / c.block_days)))
    spread = readings.select("metric", "day", "v", impossible.alias("bad"), n.alias("n"), block.alias("own"), F.explode(homes).alias("block"))

    # one row per block with its days in order; the neighbourhoods of all blocks of an Arrow batch are worked out together
    day = F.struct("n", "v", "bad", (F.col("own") == F.col("block")).alias("here"))
    blocks = spread.groupBy("metric", "block").agg(F.array_sort(F.collect_list(day)).alias("d"))
    blocks = blocks.select("metric", *[F.col("d").getField(c).alias(c) for c in ("n", "v", "bad", "here")])
    local = blocks.mapInPandas(lambda batches: _local(batches, c), "metric string, n int, v double, bad boolean, run_n long, step int, level double, dev double, residual double")
    weekday = F.pmod(F.col("n"), F.lit(7))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("n"))
    local = cut_lineage(local.select("metric", day.alias("day"), "v", "bad", "run_n", "step", *[F.nanvl(x, F.lit(None).cast("double")).alias(x) for x in ("level", "dev", "residual")], weekday.alias("weekday")))  # read three times below

    q = lambda x: F.percentile_approx(x, [0.25, 0.5, 0.75], c.accuracy)
    # two grains of sketches, per series and per series and weekday; both are merged from partial ones of each partition. Long stretches of
    # one value are what is sought, so they do not count against a series as one that repeats itself anyway
    plain = F.col("run_n") < c.stuck_run
    stats = local.groupBy("metric").agg(
        q("residual").alias("q"), F.avg(F.when(F.col("v") == 0, 1.0).otherwise(0.0)).alias("zeros"),
        F.coalesce(F.avg(F.when(plain, F.when(F.col("step") == 0, 1.0).otherwise(0.0))), F.lit(1.0)).alias("repeats"),
        F.percentile_approx(F.when(F.col("v") > 0, F.col("v")), [0.5, 0.75], c.accuracy).alias("positive"),
    )
    by_day = local.groupBy("metric", "weekday").agg(q("residual").alias("qd"))
    # one row per series with its seven weekdays; while there are few enough it goes to all tasks, so readings are not shuffled again and a
    # hot series stays spread over its blocks
    weekly = by_day.groupBy("metric").agg(F.map_from_entries(F.collect_list(F.struct("weekday", "qd"))).alias("days"))
    summary = cut_lineage(stats.join(weekly, "metric"))  # small beside the readings; its size is checked before it is sent
    joined = local.join(small(summary), "metric").withColumn("qd", F.element_at("days", F.col("weekday")))
    iqr = F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1e-9))
    rel = F.col("dev") / F.greatest(F.col("level"), F.lit(1e-12))
    outside = ((F.col("residual") > F.col("qd")[2] + c.fence * iqr) | (F.col("residual") < F.col("qd")[0] - c.fence * iqr))
    often_zero = F.col("zeros") > c.zero_share
    far = outside & (F.abs(rel) >= F.least(F.lit(c.min_relative), c.min_fences * iqr)) & (F.abs(rel) >= c.fence * iqr)
    far_zero = (F.col("v") > 4 * F.col("positive")[1]) & (F.col("dev") > 0)
    spike = F.when(often_zero, far_zero & F.col("v").isNotNull()).otherwise(far)
    stuck = (F.col("run_n") >= c.stuck_run) & (F.col("repeats") <= c.stuck_share) & ~(often_zero & (F.col("v") == 0))
    reason = F.when(F.col("bad"), "impossible").when(stuck, "stuck").when(spike, "spike")
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("metric", "day", "v", "reason")
