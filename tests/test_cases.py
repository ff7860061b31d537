from pyspark.sql import functions as F

from plumbline.__main__ import main
from plumbline.operators import memory, robustness


def test_rejects_in_order(spark):
    cases = spark.createDataFrame([("1", "a completely new request about something"), ("2", "A completely  new request about something"), ("3", "seed text as it is"), ("4", " "), ("5", None), ("6", "seed text as it was")], "id string, text string")
    seeds = spark.createDataFrame([("s", "Seed text as it is")], "id string, text string")
    got = {r.id: r.reason for r in robustness.reject_reason(cases, seeds, min_novelty=0.4).collect()}
    assert got == {"1": None, "2": "duplicate", "3": "copy_of_seed", "4": "malformed", "5": "malformed", "6": "low_novelty"}


def test_variants_hold_their_claims(spark):
    df = spark.createDataFrame([("call me about the open case",)], "text string")
    v = df.select(F.explode(robustness.format_variants(F.col("text"))).alias("name", "t")).withColumn("c", robustness.claims(F.col("t"))).collect()
    names = {"quoted": "nested_quoting", "upper": "casing", "lower": "casing"}
    unclaimed = {"typos", "mixed_language"}  # nothing of them can be seen in the text alone
    assert all(names.get(r["name"], r["name"]) in r.c for r in v if r["name"] not in unclaimed)
    assert {r["name"]: r.t for r in v}["typos"] != "call me about the open case" and unclaimed <= {r["name"] for r in v}


def test_summary_keeps_the_latest_values(spark):
    t = spark.createDataFrame([("c", 0, "My city is Rome. My car is red!"), ("c", 1, "My city is now Oslo.")], "conversation_id string, pos int, line string")
    assert memory.summary(t).first().summary == "the user's car is red. the user's city is Oslo."


def test_command_line(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "drift_alerts" in capsys.readouterr().out
    assert main(["run", "nothing"]) == 2
    assert main(["run", "gate_summary", "--sf", "/root/testdata/sf0.001", "--fail-if", "n < 0"]) == 0
    assert main(["run", "gate_summary", "--sf", "/root/testdata/sf0.001", "--out", str(tmp_path / "o"), "--fail-if", "n > 0"]) == 1
