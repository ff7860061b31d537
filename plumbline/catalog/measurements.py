"""Implausible readings (problem 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.spikes import clean_readings, flag_spikes
from ..sources.tables import table


def p3_found(spark, d):
    return flag_spikes(table(spark, d, "metrics")).select("metric", F.date_format("day", "yyyy-MM-dd").alias("date"))


def p3_rates(spark, d):
    """Share of flagged readings per kind of metric and reason."""
    metrics = table(spark, d, "metrics")
    kind = F.element_at(F.split("metric", "/"), 1).alias("kind")
    total = clean_readings(metrics).groupBy(kind).agg(F.count("*").alias("n"))
    bad = flag_spikes(metrics).groupBy(kind, "reason").agg(F.count("*").alias("n_flagged"))
    return bad.join(F.broadcast(total), "kind").select("kind", "reason", "n", "n_flagged", F.round(F.col("n_flagged") / F.col("n"), 6).alias("rate"))


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates}
SQL: dict[str, str] = {}
