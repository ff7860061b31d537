"""Whole runs composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_words, shingles
from ..operators import contamination, drift, feedback
from ..operators.dedupe import near_duplicates
from ..session import cut_lineage
from ..sources.records import MetricStore


def scan_and_clean(docs: DataFrame, items: DataFrame, cfg: contamination.ScanConfig = contamination.ScanConfig()) -> tuple[DataFrame, DataFrame]:
    """(item grades, documents without contaminated ones) by grams and MinHash."""
    hits = cut_lineage(contamination.scan(docs, items, cfg))
    matches, others = contamination.matches_of(hits), contamination.other_evidence(hits)
    evidence = contamination.merge_evidence(contamination.gram_evidence(matches), others)
    return contamination.grade_items(items, matches, others, cfg), contamination.decontaminate(docs, contamination.doc_levels(evidence, cfg))


def backfill(traffic: DataFrame, store: MetricStore, rate: float = 1.0, cap: int | None = None, cfg: drift.DetectorConfig = drift.DetectorConfig()) -> None:
    """Samples, aggregates and stores every day, then stores alerts with feedback of critical days.

    Feedback is per kind of metric: a critical day of one leaves the baselines of that one, and each is folded by itself."""
    sample = drift.hash_sample(traffic, "request_id", rate, cap=cap)
    daily = cut_lineage(drift.daily_metrics(sample))
    store.save("runs", daily.select("date", F.col("n").alias("sampled")))
    series = drift.long_metrics(daily, [c for c in daily.columns if c in cfg.directions])
    store.save("metrics", series)
    store.save("alerts", drift.alerts_with_feedback(series.withColumn("store", F.element_at(F.split("metric", "/"), 1)), cfg).drop("store"))


def preference_data(raw: DataFrame, golden: DataFrame | None = None, near: float = 0.85) -> DataFrame:
    """Pairs from raw feedback with ``reason`` null where kept: scrubbed first, ordered filters, golden overlap, exact and near duplicates."""
    events = cut_lineage(feedback.valid_events(raw))
    p = feedback.build_pairs(events)
    p = cut_lineage(p.withColumns({c: feedback.scrub(c)["text"] for c in ("prompt", "chosen", "rejected")}))
    p = p.withColumn("reason", feedback.drop_reason(*[F.col(c) for c in ("prompt", "chosen", "rejected", "strategy", "margin")]))
    if golden is not None:
        hit = feedback.golden_overlap(p.select(F.col("source_event").alias("id"), F.col("prompt").alias("text")), golden).where("overlap >= 0.5").select(F.col("id").alias("source_event"), F.lit("contaminated").alias("g"))
        p = p.join(hit, "source_event", "left").withColumn("reason", F.coalesce("reason", "g")).drop("g")
    p = cut_lineage(p)
    d = near_duplicates(p.where("reason is null"), "source_event", shingles(ascii_words(F.concat_ws("\n", "prompt", "chosen")), 3), near)
    d = d.select("source_event", F.when(~F.col("kept"), F.when(F.col("class_id") != F.col("source_event"), "duplicate").otherwise("near_duplicate")).alias("d"))
    return p.join(d, "source_event", "left").withColumn("reason", F.coalesce("reason", "d")).drop("d")
