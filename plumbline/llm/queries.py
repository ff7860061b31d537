"""Queries of the training-data operators and, where SQL can say the same, their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import abuse, bpe, defects, leakage, mixture, pii, ranking, sampling

Query = Callable[[SparkSession, str], DataFrame]


def _scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse.score_documents(docs, abuse.model(docs, table(spark, d, "labels")), keep=("source",))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where(F.col("score") > abuse.THRESHOLD).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source (without case and outer blanks; null and blank as one): documents, flagged ones, their rate, mean score."""
    source = F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("(none)")).alias("source")
    bad = F.count_if(F.col("score") > abuse.THRESHOLD)
    return _scores(spark, d).groupBy(source).agg(F.count("*").alias("n"), bad.alias("n_flagged"), F.round(bad / F.count("*"), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))


def _defects(spark: SparkSession, d: str) -> DataFrame:
    return defects.find_defects(defects.answers_of(table(spark, d, "pairs"), table(spark, d, "feedback_day1")))


def p4_items(spark: SparkSession, d: str) -> DataFrame:
    """Each evaluation item with the number of documents that leak it (0 for clean ones)."""
    items = table(spark, d, "eval_items")
    hits = leakage.leaks(table(spark, d, "documents"), items).groupBy("item_id").agg(F.count("*").alias("n"))
    return items.select(F.col("id").alias("item_id")).distinct().join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: pii.found(table(s, d, "feedback_day1")),
        "p1_redacted": lambda s, d: pii.tagged(table(s, d, "feedback_day1")).select("event_id", "field", "pos", "redacted").distinct(),
        "p1_kinds": lambda s, d: pii.found(table(s, d, "feedback_day1")).groupBy("field", "kind").agg(F.count("*").alias("n")),
        "p2_ranking": lambda s, d: ranking.rank_models(table(s, d, "anchor")),
        "p2_counts": lambda s, d: ranking.comparison_counts(table(s, d, "anchor")),
        "p4_found": lambda s, d: leakage.leaks(table(s, d, "documents"), table(s, d, "eval_items")),
        "p4_items": p4_items,
        "p5_sample": lambda s, d: sampling.stable_sample(table(s, d, "real_requests"))[0],
        "p5_growth": lambda s, d: sampling.growth_report(table(s, d, "real_requests")),
        "p6_found": _defects,
        "p6_rates": lambda s, d: _defects(s, d).groupBy("table_name", "field", "defect").agg(F.count("*").alias("n")),
        "p7_ids": lambda s, d: bpe.encode_corpus(table(s, d, "documents")),
        "p8_mixture": lambda s, d: mixture.mix(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_shares": lambda s, d: mixture.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_found": p9_found,
        "p9_scores": lambda s, d: _scores(s, d).select("doc_id", "score"),
        "p9_rates": p9_rates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_counts": """
            with r as (select id k, nullif(lower(trim(regexp_replace(model_a, '\\s+', ' ', 'g'))), '') a,
                              nullif(lower(trim(regexp_replace(model_b, '\\s+', ' ', 'g'))), '') b,
                              case lower(trim(human_pref)) when 'a' then 1 when 'b' then 2 when 'tie' then 3 end outcome, voted_at
                       from anchor),
                 l as (select *, row_number() over (partition by k order by voted_at desc nulls last, coalesce(outcome, 0) desc, a desc, b desc) i from r)
            select a, b, outcome::int outcome, count(*)::bigint n from l
            where (i = 1 or k is null) and a is not null and b is not null and outcome is not null and a <> b
            group by all""",
        "p5_sample": """
            with r as (select nullif(lower(trim(request_id)), '') request_id, lower(trim(coalesce("user", ''))) u, coalesce(received_at::date, date '1970-01-01') as "day",
                              coalesce(received_at, timestamp '1970-01-01') ra from real_requests),
                 f as (select *, row_number() over (partition by request_id order by (u = ''), ra, u) i from r where request_id is not null),
                 q as (select request_id, u, "day" from f where i = 1),
                 c as (select u, "day", count(*) n from q group by all),
                 w as (select u, "day", power(1 + coalesce(sum(n) over (partition by u order by "day" rows between unbounded preceding and 1 preceding), 0), -0.5) weight from c),
                 p as (select request_id, u as "user", weight, least(1.0, 0.2 * weight) inclusion,
                              ('0x' || substr(sha256('sample-1|' || request_id), 1, 13))::bigint / 4503599627370496.0::double h
                       from q join w using (u, "day"))
            select request_id, "user", round(weight, 9) weight, round(inclusion, 9) inclusion from p where h < inclusion""",
    }
