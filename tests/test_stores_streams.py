from pyspark.sql import functions as F

from plumbline.plans.pipelines import backfill
from plumbline.sources import records as S
from plumbline.streaming import traffic as T


def test_records_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "prompt": "hi", "completion": "there"}\n\nplain line\n{"messages": [{"role": "user", "content": "one"}, {"role": "assistant", "content": "two"}]}\n')
    r = {x.text: x.id for x in S.read_records(spark, str(tmp_path / "a.jsonl")).collect()}
    assert r["hi\nthere"] == "x" and "plain line" in r and "one\ntwo" in r and len(set(r.values())) == 3
    (tmp_path / "e.jsonl").write_text('{"k": 1}\nnot json\n')
    good, bad = S.read_events(spark, str(tmp_path / "e.jsonl"), "k int")
    assert good.first().k == 1 and bad.first().reason == "not JSON"


def test_append_store_is_idempotent(spark, tmp_path):
    store = S.AppendStore(spark, str(tmp_path / "s"), "id")
    a = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "id int, v string")
    assert store.append(a) == 1 and store.append(a) == 0 and store.append(spark.createDataFrame([(2, "c")], "id int, v string")) == 1
    assert store.read().count() == 2


def test_metric_store_replaces_days(spark, tmp_path):
    store = S.MetricStore(spark, str(tmp_path))
    rows = lambda v: spark.createDataFrame([("2026-01-01", "m", v)], "date string, metric string, value double")
    store.save("metrics", rows(1.0).unionByName(spark.createDataFrame([("2026-01-02", "m", 5.0)], "date string, metric string, value double")))
    store.save("metrics", rows(2.0))
    assert sorted((str(r.date), r.value) for r in store.series("m").collect()) == [("2026-01-01", 2.0), ("2026-01-02", 5.0)]


def test_cassettes_and_cache(spark, tmp_path):
    n = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y")], "run long, index long, key string, output string")
    S.save_cassettes(n, str(tmp_path / "c"))
    assert sorted(map(tuple, S.load_cassettes(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, n.collect()))
    req = spark.createDataFrame([("p",), ("q",), ("q",)], "prompt string")
    hit, rest = S.cached_completions(req, spark.createDataFrame([("p", "done")], "prompt string, completion string").select(F.sha2("prompt", 256).alias("key"), "completion"))
    assert hit.count() == 1 and rest.count() == 1


def test_streams(spark, tmp_path):
    ev = spark.createDataFrame([(k, f"2026-01-0{1 + k % 3} 10:00:00", "click" if k % 2 else "view", float(k), k % 3) for k in range(30)], "event_id long, t string, event_type string, value double, user_id long").withColumn("ts", F.to_timestamp("t")).drop("t")
    ev.write.parquet(str(tmp_path / "in"))
    stream = T.file_stream(spark, str(tmp_path / "in"), ev.schema)
    store = S.MetricStore(spark, str(tmp_path / "store"))
    T.run_available(T.daily_counts(stream), str(tmp_path / "cp"), T.store_sink(store, "daily"), "update")
    assert store.read("daily").agg(F.sum("n")).first()[0] == 30
    seen = []
    T.run_available(T.distinct_ingest(T.file_stream(spark, str(tmp_path / "in"), ev.schema)), str(tmp_path / "cp2"), lambda b, k: seen.append(b.count()))
    ev.write.mode("append").parquet(str(tmp_path / "in"))
    T.run_available(T.distinct_ingest(T.file_stream(spark, str(tmp_path / "in"), ev.schema)), str(tmp_path / "cp2"), lambda b, k: seen.append(b.count()))
    assert sum(seen) == 30
    said = []
    T.run_available(stream.where("event_id < 3").select("event_id", "event_type"), str(tmp_path / "cp3"), T.alert_sink(str(tmp_path / "alerts"), said.append))
    assert len(said) >= 3


def test_backfill(spark, tmp_path):
    rows = [(f"2026-01-{d:02d}", f"{d}-{k}", d == 12 and k % 2 == 0, 100 + k % 7, 1, 0, 1.0, 0.01, 0.8) for d in range(1, 15) for k in range(40)]
    t = spark.createDataFrame(rows, "date string, request_id string, refused boolean, chars int, tool_calls int, tool_errors int, latency double, cost double, judge double")
    store = S.MetricStore(spark, str(tmp_path))
    backfill(t, store)
    assert {str(r.date) for r in store.alerted_dates().collect()} == {"2026-01-12"}
