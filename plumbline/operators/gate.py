"""Release gate: runs of two builds on the same cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_summary(cases: DataFrame, by: str = "build") -> DataFrame:
    """(build, n, success_rate, p50, p95, errors, tokens)."""
    return cases.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.percentile("latency", 0.5).alias("p50"), F.percentile("latency", 0.95).alias("p95"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum("tokens").alias("tokens"))


def scorer_rates(cases: DataFrame, by: str = "build") -> DataFrame:
    """(build, scorer, n, pass_rate) from a map of checks."""
    return cases.select(by, F.explode("checks").alias("scorer", "ok")).groupBy(by, "scorer").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("pass_rate"))


def case_changes(base: DataFrame, cand: DataFrame) -> DataFrame:
    """(case_id, change): missing, added, newly_failing, newly_passing or same."""
    b, c = base.select("case_id", F.col("success").alias("b")), cand.select("case_id", F.col("success").alias("c"))
    change = F.when(F.col("c").isNull(), "missing").when(F.col("b").isNull(), "added").when((F.col("b") == 1) & (F.col("c") == 0), "newly_failing").when((F.col("b") == 0) & (F.col("c") == 1), "newly_passing").otherwise("same")
    return b.join(c, "case_id", "full_outer").select("case_id", change.alias("change"))


def gate(base: DataFrame, cand: DataFrame, max_drop: float = 0.02, max_p95_rise: float = 0.25, min_ms: float = 0.005, boots: int = 2000) -> dict:
    """Blocks on a success drop above ``max_drop`` that is significant, or a p95 rise above both limits. No shared case fails."""
    from .significance import compare

    shared = base.select("case_id").join(cand.select("case_id"), "case_id")
    b, c = base.join(shared, "case_id", "left_semi"), cand.join(shared, "case_id", "left_semi")
    sb, sc = (x.agg(F.count("*").alias("n"), F.avg("success").alias("rate"), F.percentile("latency", 0.95).alias("p95")).first() for x in (b, c))
    if not sb.n:
        return {"passed": False, "reasons": ["no shared cases"], "drop": None, "p95_rise": None}
    reasons, drop, rise = [], sb.rate - sc.rate, (sc.p95 - sb.p95) / sb.p95 if sb.p95 else 0.0
    if sb.n >= 2 and drop > max_drop:
        rows = lambda x, m: x.select(F.lit(m).alias("model"), F.col("case_id").alias("item_id"), F.col("success").cast("double").alias("score"), F.col("item_id").cast("string").alias("cluster"))
        if compare(rows(b, "base").unionByName(rows(c, "cand")), "base", "cand", boots).significant:
            reasons.append("success dropped")
    if rise > max_p95_rise and sc.p95 - sb.p95 >= min_ms:
        reasons.append("p95 latency rose")
    return {"passed": not reasons, "reasons": reasons, "drop": drop, "p95_rise": rise}
