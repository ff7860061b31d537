"""Drift of daily traffic: hash sample, daily metrics and distributions, z-score, CUSUM, PSI, alerts."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import in_sample, stable_hex

#: 1: higher is worse, -1: lower is worse (fixed values).
DIRECTION = {"refusal_rate": 1, "empty_rate": 1, "answer_chars_mean": -1, "tool_error_rate": 1, "latency_p50": 1, "latency_p95": 1, "cost_usd_mean": 1, "judge_score": -1}
RATES = ("refusal_rate", "empty_rate", "tool_error_rate")
#: Upper ends of the length bins (fixed values).
LENGTH_BINS = ((1, "empty"), (100, "1-99"), (250, "100-249"), (500, "250-499"), (1000, "500-999"), (2000, "1000-1999"))
#: Phrases of a refusal, on word borders and without case (fixed values).
REFUSALS = ("i'm sorry", "im sorry", "i cannot help", "i can't help", "i am unable", "i'm unable", "im unable", "cannot assist", "not able to help", "not able to assist", "as an ai")
REFUSAL = r"(?i)\b(?:" + "|".join(REFUSALS) + r")\b"


@dataclass(frozen=True)
class DetectorConfig:
    baseline_days: int = 14
    min_baseline: int = 5
    z_warn: float = 3.0
    z_crit: float = 4.0
    std_floor: float = 0.05
    cusum_days: int = 7
    cusum_k: float = 0.5
    cusum_h: float = 5.0
    psi_warn: float = 0.2
    psi_crit: float = 0.3
    alpha: float = 0.5
    rate_floor: float = 0.01
    directions: dict[str, int] = field(default_factory=lambda: dict(DIRECTION))


def hash_sample(df: DataFrame, key: str, rate: float = 0.05, salt: str = "drift-v1", cap: int | None = None, by: str = "date") -> DataFrame:
    """Rows whose key hash is below the rate; with ``cap`` the ``cap`` smallest hashes of every ``by``.

    The filter comes first, so only sampled rows are shuffled for the cap; a row is ranked only against its own day."""
    kept = df.withColumn("sample_hash", stable_hex(F.lit(salt), F.col(key).cast("string"))).where(in_sample(F.col(key).cast("string"), rate, salt))
    if cap is not None:
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("sample_hash", key))).where(F.col("rank") <= cap).drop("rank")
    return kept


def sample_key(user_header: Column, body_user: Column, request_id: Column, conversation: Column) -> Column:
    """First of the three that is not empty, else a hash of the conversation."""
    return F.coalesce(F.nullif(user_header, F.lit("")), F.nullif(body_user, F.lit("")), F.nullif(request_id, F.lit("")), F.concat(F.lit("conv:"), stable_hex(conversation)))


def length_bin(chars: Column) -> Column:
    out = F.when(chars < LENGTH_BINS[0][0], LENGTH_BINS[0][1])
    for top, label in LENGTH_BINS[1:]:
        out = out.when(chars < top, label)
    return out.otherwise("2000+")


def score_records(records: DataFrame, output: str = "output", calls: str | None = None) -> DataFrame:
    """Adds refused and chars (of the trimmed text; null counts as empty) and, where ``calls`` names an array of structs with ``ok``,
    tool_calls and tool_errors (calls whose ``ok`` is false; null counts as true; a null array is empty): what ``daily_metrics`` needs of raw records."""
    text = F.coalesce(F.col(output), F.lit(""))
    out = records.withColumns({"refused": text.rlike(REFUSAL), "chars": F.length(F.trim(text))})
    if calls is not None:
        own = F.coalesce(F.col(calls), F.array())
        out = out.withColumns({"tool_calls": F.size(own), "tool_errors": F.size(F.filter(own, lambda c: ~F.coalesce(c["ok"], F.lit(True))))})
    return out


def daily_metrics(traffic: DataFrame, min_samples: int = 20) -> DataFrame:
    """(date, n, metrics ...) from columns refused, chars, tool_calls, tool_errors, latency, cost, judge.

    Averages skip nulls; a day of fewer than ``min_samples`` rows is not stored."""
    x = lambda c: F.col(c).cast("double")
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    tool_error = F.when(F.col("tool_calls") > 0, F.when(F.col("tool_errors") > 0, 1.0).otherwise(0.0))
    out = traffic.groupBy("date").agg(
        F.count("*").alias("n"), rate(F.col("refused")).alias("refusal_rate"), rate(F.col("chars") < 1).alias("empty_rate"), F.avg(x("chars")).alias("answer_chars_mean"),
        F.avg(tool_error).alias("tool_error_rate"), F.avg(x("tool_calls")).alias("tool_calls_mean"), F.percentile("latency", 0.5).alias("latency_p50"), F.percentile("latency", 0.95).alias("latency_p95"),
        F.avg(x("cost")).alias("cost_usd_mean"), F.avg(x("judge")).alias("judge_score"),
    )
    return out.where(F.col("n") >= min_samples)


def long_metrics(daily: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(date, metric, value, n) without metrics that have no value on a day."""
    names = names or [c for c in daily.columns if c not in ("date", "n")]
    return daily.unpivot(["date", "n"], names, "metric", "value").where(F.col("value").isNotNull())


def distribution(traffic: DataFrame, label: Column, labels: list[str] | None = None) -> DataFrame:
    """(date, label, n); with ``labels`` every day has all of them, zeros included."""
    counts = traffic.groupBy("date", label.alias("label")).agg(F.count("*").alias("n"))
    if labels is None:
        return counts
    grid = traffic.select("date").distinct().select("date", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    return grid.join(counts, ["date", "label"], "left").select("date", "label", F.coalesce("n", F.lit(0)).alias("n"))


def tool_mix(df: DataFrame, calls: str = "tool_calls") -> DataFrame:
    """(date, tool, n) from an array of structs with a name."""
    return df.select("date", F.explode(F.transform(calls, lambda c: c["name"])).alias("tool")).groupBy("date", "tool").agg(F.count("*").alias("n"))


def psi(expected: DataFrame, actual: DataFrame, keys: list[str], alpha: float = 0.5) -> DataFrame:
    """Population stability index per ``keys`` of (keys, label, n) tables, and the label with the largest change of share.

    Every bin of either side is smoothed by ``alpha``; a side without rows gives 0."""
    both = expected.withColumnRenamed("n", "e").join(actual.withColumnRenamed("n", "a"), [*keys, "label"], "full_outer").na.fill(0, ["e", "a"])
    w = Window.partitionBy(*keys)
    t = both.withColumns({"te": F.sum("e").over(w), "ta": F.sum("a").over(w), "bins": F.count("*").over(w)})
    pe, pa = (F.col("e") + alpha) / (F.col("te") + alpha * F.col("bins")), (F.col("a") + alpha) / (F.col("ta") + alpha * F.col("bins"))
    share = F.col("a") / F.greatest("ta", F.lit(1)) - F.col("e") / F.greatest("te", F.lit(1))
    t = t.withColumn("term", F.when((F.col("te") == 0) | (F.col("ta") == 0), 0.0).otherwise((pa - pe) * F.log(pa / pe))).withColumn("shift", share)
    return t.groupBy(*keys).agg(F.round(F.sum("term"), 6).alias("psi"), F.max_by("label", F.struct(F.round(F.abs("shift"), 9), "label")).alias("shifted"))


def with_baseline(series: DataFrame, cfg: DetectorConfig = DetectorConfig(), rates: tuple[str, ...] = RATES, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """(keys, date, value, n, n_base, mu, sd): the days before as baseline, without feedback of alerts.

    sd is the largest of sample deviation, share of the mean, binomial error or floor of rates, and 1e-9."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-cfg.baseline_days, -1)
    b = series.withColumns({"n_base": F.count("value").over(w), "mu": F.avg("value").over(w), "raw": F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0))})
    se = F.sqrt(F.greatest(F.col("mu") * (1 - F.col("mu")), F.lit(1e-9)) / F.col("n"))
    floor = F.when(F.element_at(F.split("metric", "/"), 1).isin(*rates), F.greatest(F.coalesce(se, F.lit(0.0)), F.lit(cfg.rate_floor))).otherwise(0.0)
    return b.where(F.col("n_base") >= cfg.min_baseline).withColumn("sd", F.greatest("raw", cfg.std_floor * F.abs("mu"), floor, F.lit(1e-9))).drop("raw")


def _direction(cfg: DetectorConfig) -> Column:
    pairs = [x for k, v in cfg.directions.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.element_at(F.split("metric", "/"), 1))


def zscores(series: DataFrame, cfg: DetectorConfig = DetectorConfig(), keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    b = with_baseline(series, cfg, keys=keys).withColumn("direction", F.coalesce(_direction(cfg), F.lit(1)))
    return b.withColumn("z", (F.col("value") - F.col("mu")) / F.col("sd"))


def with_cusum(series: DataFrame, cfg: DetectorConfig = DetectorConfig(), keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Adds ``cusum``: one-sided sum over the last ``cusum_days`` values relative to the day's baseline."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-cfg.cusum_days + 1, 0)
    recent = series.withColumn("recent", F.collect_list("value").over(w))
    z = zscores(recent, cfg, keys)
    return z.withColumn("cusum", F.aggregate("recent", F.lit(0.0), lambda s, v: F.greatest(F.lit(0.0), s + F.col("direction") * (v - F.col("mu")) / F.col("sd") - cfg.cusum_k))).drop("recent")


def alerts(series: DataFrame, cfg: DetectorConfig = DetectorConfig(), keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """(keys, date, method, severity, value, baseline, score): CUSUM only where the z-score does not warn."""
    c = with_cusum(series, cfg, keys).withColumn("bad", F.col("z") * F.col("direction"))
    zed = c.where(F.col("bad") >= cfg.z_warn).select(*keys, "date", F.lit("zscore").alias("method"), F.when(F.col("bad") >= cfg.z_crit, "critical").otherwise("warning").alias("severity"), "value", F.col("mu").alias("baseline"), F.col("z").alias("score"))
    cus = c.where((F.col("cusum") >= cfg.cusum_h) & (F.col("bad") < cfg.z_warn)).select(*keys, "date", F.lit("cusum").alias("method"), F.lit("warning").alias("severity"), "value", F.col("mu").alias("baseline"), F.col("cusum").alias("score"))
    return zed.unionByName(cus)


def psi_alerts(dist: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """(date, psi, shifted, severity) of each day against the pooled ``baseline_days`` days before, by a range join on day numbers."""
    days = dist.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))  # one row per day
    d = dist.join(F.broadcast(days), "date")
    ahead = d.select("label", "n", F.explode(F.sequence(F.col("k") + 1, F.col("k") + cfg.baseline_days)).alias("k"))
    base = ahead.groupBy("k", "label").agg(F.sum("n").alias("n")).join(F.broadcast(days.where(F.col("k") > cfg.min_baseline)), "k").select("date", "label", "n")
    today = d.where(F.col("k") > cfg.min_baseline).select("date", "label", "n")
    p = psi(base, today, ["date"], cfg.alpha)
    return p.withColumn("severity", F.when(F.col("psi") >= cfg.psi_crit, "critical").when(F.col("psi") >= cfg.psi_warn, "warning").otherwise("none"))


def alerts_with_feedback(series: DataFrame, cfg: DetectorConfig = DetectorConfig(), store: str = "store") -> DataFrame:
    """As ``alerts``, but days with critical alerts leave the baselines of later days. Sequential by day; one task per
    ``store`` (all metrics of a store share the set of excluded days), daily rows only."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, excluded = [], set()
        days = sorted(pdf["date"].unique())
        by = {m: dict(zip(g["date"], zip(g["value"], g["n"]))) for m, g in pdf.groupby("metric")}
        for at, day in enumerate(days):
            prior = [x for x in days[:at] if x not in excluded][-cfg.baseline_days :]
            if len(prior) < cfg.min_baseline:
                continue
            recent = days[max(0, at + 1 - cfg.cusum_days) : at + 1]
            for metric, own in by.items():
                if day not in own:
                    continue
                hist = [own[x][0] for x in prior if x in own]
                if len(hist) < cfg.min_baseline:
                    continue
                value, n = own[day]
                kind = metric.split("/")[0]
                sign = cfg.directions.get(kind, 1)
                mu = sum(hist) / len(hist)
                sd = math.sqrt(sum((h - mu) ** 2 for h in hist) / (len(hist) - 1)) if len(hist) > 1 else 0.0
                floor = max(math.sqrt(max(mu * (1 - mu), 1e-9) / n) if n == n and n else 0.0, cfg.rate_floor) if kind in RATES else 0.0
                sd = max(sd, cfg.std_floor * abs(mu), floor, 1e-9)
                z = (value - mu) / sd
                s = 0.0
                for x in recent:
                    if x in own:
                        s = max(0.0, s + sign * (own[x][0] - mu) / sd - cfg.cusum_k)
                if z * sign >= cfg.z_warn:
                    severity = "critical" if z * sign >= cfg.z_crit else "warning"
                    out.append((pdf[store].iloc[0], metric, day, "zscore", severity, value, mu, z))
                    if severity == "critical":
                        excluded.add(day)
                elif s >= cfg.cusum_h:
                    out.append((pdf[store].iloc[0], metric, day, "cusum", "warning", value, mu, s))
        return pd.DataFrame(out, columns=[store, "metric", "date", "method", "severity", "value", "baseline", "score"])

    kind = dict(series.dtypes)
    return series.select(store, "metric", "date", "value", "n").groupBy(store).applyInPandas(fold, f"{store} {kind[store]}, metric string, date {kind['date']}, method string, severity string, value double, baseline double, score double")


def report(series: DataFrame, first_days: int = 7) -> DataFrame:
    """(metric, baseline, latest, change_pct): mean of the first days against the last value."""
    r = series.withColumn("k", F.row_number().over(Window.partitionBy("metric").orderBy("date")))
    out = r.groupBy("metric").agg(F.avg(F.when(F.col("k") <= first_days, F.col("value"))).alias("baseline"), F.max_by("value", "date").alias("latest"))
    return out.withColumn("change_pct", F.when(F.col("baseline") != 0, 100 * (F.col("latest") - F.col("baseline")) / F.col("baseline")))


def date_grid(df: DataFrame, by: str, date: str = "date") -> DataFrame:
    """Every calendar day between the first and the last of each ``by``."""
    return df.groupBy(by).agg(F.explode(F.sequence(F.min(date), F.max(date))).alias(date))
