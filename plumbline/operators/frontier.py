"""Cost and quality of configurations: frontiers, router simulation, what-if."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import unit
from ..functions.stats import wilson


def config_stats(rows: DataFrame) -> DataFrame:
    """(tenant, config, n, successes, success_rate, ci_low, ci_high, mean_cost, cost_per_success, p95_latency).

    No success: cost_per_success is null."""
    g = rows.groupBy("tenant", "config").agg(F.count("*").alias("n"), F.sum("success").alias("successes"), F.avg("cost").alias("mean_cost"), F.sum("cost").alias("cost"), F.percentile("latency", 0.95).alias("p95_latency"))
    low, high = wilson(F.col("successes"), F.col("n"))
    return g.select("tenant", "config", "n", "successes", (F.col("successes") / F.col("n")).alias("success_rate"), low.alias("ci_low"), high.alias("ci_high"), "mean_cost", F.try_divide("cost", "successes").alias("cost_per_success"), "p95_latency")


def frontier(points: DataFrame, by: str = "tenant", cost: str = "mean_cost", gain: str = "success_rate", order: str = "config") -> DataFrame:
    """Adds ``on_frontier``: no other point is as cheap and as good and better in one. Of equal points the first by ``order`` stays."""
    w = Window.partitionBy(by).orderBy(F.col(cost), F.desc(gain), order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(gain).over(w)
    return points.withColumn("on_frontier", best.isNull() | (F.col(gain) > best))


def router(rows: DataFrame, cheap: str, expensive: str, steps: int = 20, cascade: bool = True) -> DataFrame:
    """One point per tenant and threshold: tasks of the cheap configuration below the threshold of confidence go to the other.

    Tasks are joined once; thresholds are spread in the aggregation, not by a join. With ``cascade`` both attempts are paid."""
    a = rows.where(F.col("config") == cheap).select("tenant", "task_id", *[F.col(c).alias(f"a_{c}") for c in ("success", "cost", "latency")], F.coalesce(F.col("confidence"), unit(F.lit("router"), F.col("task_id").cast("string"))).alias("confidence"))
    b = rows.where(F.col("config") == expensive).select("tenant", "task_id", *[F.col(c).alias(f"b_{c}") for c in ("success", "cost", "latency")])
    both = a.join(b, ["tenant", "task_id"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("threshold", F.col("k") / steps)
    stay = F.col("confidence") >= F.col("threshold")
    pay = lambda c: F.when(stay, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}") + (F.col(f"a_{c}") if cascade else F.lit(0.0)))
    g = both.groupBy("tenant", "threshold").agg(F.count("*").alias("n"), F.avg(F.when(stay, 0.0).otherwise(1.0)).alias("escalation_rate"), F.sum(F.when(stay, F.col("a_success")).otherwise(F.col("b_success"))).alias("successes"), F.avg(pay("cost")).alias("mean_cost"), F.percentile(pay("latency"), 0.95).alias("p95_latency"))
    return g.select("tenant", "threshold", "escalation_rate", (F.col("successes") / F.col("n")).alias("success_rate"), "mean_cost", F.try_divide(F.col("mean_cost") * F.col("n"), F.col("successes")).alias("cost_per_success"), "p95_latency")


def joint_frontier(stats: DataFrame, points: DataFrame) -> DataFrame:
    """Frontier of configurations and router points together; configurations first on ties."""
    s = stats.select("tenant", F.col("config").alias("name"), F.lit(0).alias("source"), "mean_cost", "success_rate")
    p = points.select("tenant", F.format_string("t=%.2f", "threshold").alias("name"), F.lit(1).alias("source"), "mean_cost", "success_rate")
    both = s.unionByName(p).withColumn("rank", F.concat(F.col("source").cast("string"), F.col("name")))
    return frontier(both, order="rank").drop("rank")


def best_router(points: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Per tenant the cheapest point within ``tolerance`` of always escalating, if it escalates less and costs less."""
    always = points.groupBy("tenant").agg(F.max_by("success_rate", "threshold").alias("top"), F.max_by("mean_cost", "threshold").alias("top_cost"))
    ok = points.join(F.broadcast(always), "tenant").where(F.col("success_rate") >= F.col("top") - tolerance)
    best = ok.groupBy("tenant").agg(F.min_by(F.struct("threshold", "escalation_rate", "success_rate", "mean_cost", "top_cost"), F.struct("mean_cost", "threshold")).alias("b")).select("tenant", "b.*")
    return best.where((F.col("escalation_rate") < 1) & (F.col("mean_cost") < F.col("top_cost"))).drop("top_cost")


def recommend(stats: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Per tenant the cheapest configuration within ``tolerance`` of the best success rate."""
    top = stats.groupBy("tenant").agg(F.max("success_rate").alias("top"))
    return stats.join(F.broadcast(top), "tenant").where(F.col("success_rate") >= F.col("top") - tolerance).groupBy("tenant").agg(F.min_by("config", F.struct("mean_cost", "config")).alias("config"))


def router_pair(stats: DataFrame, ratio: float = 0.1) -> DataFrame:
    """(tenant, cheap, expensive): the best on the frontier, and the best of those on it that cost at most ``ratio`` of it, else the cheapest."""
    f = frontier(stats).where("on_frontier")
    top = f.groupBy("tenant").agg(F.max_by(F.struct("config", "mean_cost"), F.struct("success_rate", "config")).alias("t"))
    j = f.join(F.broadcast(top), "tenant").withColumn("fits", F.col("mean_cost") <= ratio * F.col("t.mean_cost"))
    return j.groupBy("tenant").agg(F.first("t.config").alias("expensive"), F.coalesce(F.max_by(F.when(F.col("fits"), F.col("config")), F.when(F.col("fits"), F.struct("success_rate", "config"))), F.min_by("config", F.struct("mean_cost", "config"))).alias("cheap"))


def scaled_cost(rows: DataFrame, pattern: str, factor: float) -> DataFrame:
    """Cost times ``factor`` where the configuration matches a glob."""
    return rows.withColumn("cost", F.when(F.col("config").rlike(glob_regex(pattern)), F.col("cost") * factor).otherwise(F.col("cost")))


def glob_regex(pattern: str) -> str:
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def frontier_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tenant, joined, left): configurations that entered and left the frontier."""
    b = frontier(before).select("tenant", "config", F.col("on_frontier").alias("was"))
    a = frontier(after).select("tenant", "config", F.col("on_frontier").alias("now"))
    j = b.join(a, ["tenant", "config"])
    pick = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("config")))), ",")
    return j.groupBy("tenant").agg(pick(F.col("now") & ~F.col("was")).alias("joined"), pick(F.col("was") & ~F.col("now")).alias("left"))


def cost_of(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1e6
