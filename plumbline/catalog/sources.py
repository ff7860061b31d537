"""Parsers, validation and pipelines on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsers as P
from ..plans.pipelines import preference_data
from ..sources import records as S
from ..sources.tables import table


def problems(spark, d):
    return S.dataset_problems(table(spark, d, "pairs"))


def props(spark, d):
    return table(spark, d, "events").select("event_id", P.path_value(F.col("props"), "k").alias("k"))


def numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", P.first_number(F.col("text")).alias("number")).where("number is not null")


def verdicts(spark, d):
    t = F.col("o_orderkey")
    text = F.when(t % 4 == 0, F.concat(F.lit("I compared both. Verdict: "), F.when(t % 3 == 0, "A").otherwise("B"))).when(t % 4 == 1, "TIE").when(t % 4 == 2, "Either A or B").otherwise(F.concat(F.lit("Score: "), (t % 13).cast("string")))
    o = table(spark, d, "orders").withColumn("reply", text)
    return o.select("o_orderkey", P.a_b_tie(F.col("reply")).alias("winner"), P.last_score(F.col("reply"), 0, 10).alias("score"))


def chat_text(spark, d):
    f = table(spark, d, "feedback_day1").dropDuplicates(["event_id"])
    raw = F.to_json(F.struct("messages", F.col("response").alias("completion")))
    return f.select("event_id", S.record_text(raw).alias("text"))


def pipeline(spark, d):
    return preference_data(table(spark, d, "feedback_day1")).groupBy("strategy", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


QUERIES = {"source_dataset_problems": problems, "source_json_path": props, "parser_first_number": numbers, "parser_verdicts": verdicts, "source_record_text": chat_text, "pipeline_preference_data": pipeline}
SQL = {
    "source_dataset_problems": """select distinct pair_id, case when not regexp_matches(coalesce(prompt, ''), '\\S') then 'no prompt' when not regexp_matches(coalesce(chosen, ''), '\\S') then 'no chosen' when not regexp_matches(coalesce(rejected, ''), '\\S') then 'no rejected' when chosen = rejected then 'chosen equals rejected' end problem from pairs
        where not regexp_matches(coalesce(prompt, ''), '\\S') or not regexp_matches(coalesce(chosen, ''), '\\S') or not regexp_matches(coalesce(rejected, ''), '\\S') or chosen = rejected""",
    "source_json_path": "select event_id, props->>'$.k' k from events",
    "parser_verdicts": """select o_orderkey, case when o_orderkey % 4 = 0 and o_orderkey % 3 = 0 then 'A' when o_orderkey % 4 = 0 then 'B' else 'TIE' end winner, case when o_orderkey % 4 = 3 and o_orderkey % 13 <= 10 then (o_orderkey % 13)::double end score from orders""",
}
