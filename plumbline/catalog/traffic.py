"""Traffic monitoring on the events and metrics tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import bucket, stable_hex
from ..operators import drift as D
from ..sources.tables import table

R = lambda c, k=6: F.round(c, k).alias(c)


def traffic(spark, d):
    """Events as traffic: errors are refusals, views and clicks are tool calls, value is a latency and, scaled, a length."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").cast("string").alias("request_id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), "event_type", (F.col("event_type") == "error").alias("refused"), F.floor(F.col("value") * 20).cast("int").alias("chars"),
        F.when(F.col("event_type").isin("view", "click"), k % 3).otherwise(0).alias("tool_calls"), F.when(k % 7 == 0, 1).otherwise(0).alias("tool_errors"), (F.col("value") / 10).alias("latency"), (k / 1000).alias("cost"), F.when(k % 2 == 0, k / 100).alias("judge"), "user_id",
    )


def sampled(spark, d):
    return D.hash_sample(traffic(spark, d), "request_id", 0.05).select("request_id", "date", "sample_hash")


def capped(spark, d):
    return D.hash_sample(traffic(spark, d), "request_id", 0.05, cap=10).select("request_id", "date")


def shadow_keys(spark, d):
    """Requests mirrored to a second model, by the hash bucket of their sampling key."""
    r = table(spark, d, "real_requests")
    key = D.sample_key(F.lit(None).cast("string"), F.col("user"), F.col("request_id"), F.lit(""))
    return r.select("request_id", key.alias("key")).where(bucket(F.col("key"), "shadow", 1_000_000) < 50_000).distinct()


def daily(spark, d):
    x = D.daily_metrics(traffic(spark, d))
    return x.select("date", "n", *[R(c) for c in x.columns[2:]])


def histogram(spark, d):
    labels = [x for _, x in D.LENGTH_BINS] + ["2000+"]
    return D.distribution(traffic(spark, d), D.length_bin(F.col("chars")), labels)


def event_mix(spark, d):
    return D.distribution(traffic(spark, d), F.col("event_type")).withColumnRenamed("label", "event_type")


def series(spark, d):
    return D.long_metrics(D.daily_metrics(traffic(spark, d)), list(D.DIRECTION))


def store_series(spark, d):
    m = table(spark, d, "metrics").where(F.col("value").isNotNull())
    return m.groupBy("metric", "date").agg(F.max_by("value", F.struct("recorded_at", "value")).alias("value")).withColumn("n", F.lit(None).cast("long"))


def z(spark, d):
    return D.zscores(series(spark, d)).select("metric", "date", "n_base", R("mu"), R("sd"), R("z", 4))


def cusum(spark, d):
    return D.with_cusum(series(spark, d)).select("metric", "date", R("cusum", 4))


def store_alerts(spark, d):
    a = D.alerts(store_series(spark, d))
    return a.select("metric", "date", "method", "severity", R("value"), R("baseline"), R("score", 3))


def feedback_alerts(spark, d):
    s = store_series(spark, d).withColumn("store", F.element_at(F.split("metric", "/"), -1))
    return D.alerts_with_feedback(s).select("store", "metric", "date", "method", "severity", R("score", 3))


def mix_psi(spark, d):
    return D.psi_alerts(D.distribution(traffic(spark, d), F.col("event_type"))).select("date", "psi", "severity")


def drift_report(spark, d):
    return D.report(store_series(spark, d)).select("metric", R("baseline"), R("latest"), R("change_pct", 4))


def rolling_mean(spark, d):
    """Mean of the seven rows up to each day of a stored series."""
    from pyspark.sql import Window

    s = store_series(spark, d)
    return s.select("metric", "date", F.round(F.avg("value").over(Window.partitionBy("metric").orderBy("date").rowsBetween(-6, 0)), 5).alias("mean7"))


def missing_days(spark, d):
    s = store_series(spark, d).select("metric", F.to_date("date").alias("date"))
    return D.date_grid(s, "metric").join(s, ["metric", "date"], "left_anti").select("metric", F.date_format("date", "yyyy-MM-dd").alias("date"))


def stable_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", stable_hex(F.lit("v1"), F.col("c_name"), F.col("c_mktsegment")).alias("h"))


def scored_answers(spark, d):
    """Refusals and lengths of the answers of each model."""
    r = D.score_records(table(spark, d, "feedback_day1"), "response")
    return r.groupBy(F.coalesce("model", F.lit("(none)")).alias("model"), D.length_bin(F.col("chars")).alias("bin")).agg(F.count("*").alias("n"), F.count_if("refused").alias("n_refused"))


QUERIES = {
    "drift_scored_answers": scored_answers,
    "drift_hash_sample": sampled, "drift_hash_sample_capped": capped, "shadow_sample": shadow_keys, "drift_daily_metrics": daily, "drift_length_histogram": histogram, "drift_event_mix": event_mix, "drift_zscore": z, "drift_cusum": cusum,
    "drift_alerts": store_alerts, "drift_alerts_feedback": feedback_alerts, "drift_psi": mix_psi, "drift_report": drift_report, "drift_rolling_mean": rolling_mean, "drift_missing_days": missing_days, "stable_hash": stable_ids,
}

_T = """with t as (select event_id::varchar request_id, ts::date::varchar "date", event_type, event_type = 'error' refused, floor(value * 20)::int chars, (props->>'$.k')::int k,
    case when event_type in ('view', 'click') then (props->>'$.k')::int % 3 else 0 end tool_calls, value / 10 latency, user_id from events),
  u as (select *, case when k % 7 = 0 then 1 else 0 end tool_errors, k / 1000.0::double cost, case when k % 2 = 0 then k / 100.0::double end judge from t)"""
_DM = _T + """, dm as (select "date", count(*) n, avg(refused::int) refusal_rate, avg((chars < 1)::int) empty_rate, avg(chars::double) answer_chars_mean,
    avg(case when tool_calls > 0 then (tool_errors > 0)::int::double end) tool_error_rate, avg(tool_calls::double) tool_calls_mean, quantile_cont(latency, 0.5) latency_p50, quantile_cont(latency, 0.95) latency_p95,
    avg(cost) cost_usd_mean, avg(judge) judge_score from u group by "date" having count(*) >= 20)"""
_S = _DM + """, s as (select "date", n, metric, value from (unpivot dm on refusal_rate, empty_rate, answer_chars_mean, tool_error_rate, latency_p50, latency_p95, cost_usd_mean, judge_score into name metric value value))"""
_ST = """with s as (select metric, "date", arg_max(value, (recorded_at, value)) value, null::bigint n from metrics where value is not null group by all)"""
_B = """, b as (select *, count(value) over w n_base, avg(value) over w mu, coalesce(stddev_samp(value) over w, 0) raw from s window w as (partition by metric order by "date" rows between 14 preceding and 1 preceding)),
  z as (select *, (value - mu) / sd z from (select *, greatest(raw, 0.05 * abs(mu), case when split_part(metric, '/', 1) in ('refusal_rate', 'empty_rate', 'tool_error_rate') then greatest(coalesce(sqrt(greatest(mu * (1 - mu), 1e-9) / n), 0), 0.01) else 0 end, 1e-9) sd,
       case split_part(metric, '/', 1) when 'answer_chars_mean' then -1 when 'judge_score' then -1 else 1 end dir from b where n_base >= 5)),
  r as (select metric, "date", list(value) over (partition by metric order by "date" rows between 6 preceding and current row) recent from s),
  c as (select z.*, list_reduce(list_prepend(0.0::double, list_transform(recent, lambda v: dir * (v - mu) / sd - 0.5)), lambda a, x: greatest(0.0::double, a + x)) cusum from z join r using (metric, "date"))"""

SQL = {
    "drift_hash_sample": _T + """ select request_id, "date", substr(sha256('drift-v1' || chr(31) || request_id), 1, 16) sample_hash from t where substr(sha256('drift-v1' || chr(31) || request_id), 1, 16) < '0ccccccccccccd00'""",
    "drift_hash_sample_capped": _T + """ select request_id, "date" from (select *, substr(sha256('drift-v1' || chr(31) || request_id), 1, 16) h, row_number() over (partition by "date" order by substr(sha256('drift-v1' || chr(31) || request_id), 1, 16), request_id) r from t where substr(sha256('drift-v1' || chr(31) || request_id), 1, 16) < '0ccccccccccccd00') where r <= 10""",
    "shadow_sample": """with k as (select request_id, coalesce(nullif("user", ''), nullif(request_id, '')) as "key" from real_requests)
        select distinct request_id, "key" from k where ('0x' || substr(sha256('shadow' || chr(31) || "key"), 1, 16))::ubigint % 1000000 < 50000""",
    "drift_daily_metrics": _DM + """ select "date", n, round(refusal_rate, 6) refusal_rate, round(empty_rate, 6) empty_rate, round(answer_chars_mean, 6) answer_chars_mean, round(tool_error_rate, 6) tool_error_rate, round(tool_calls_mean, 6) tool_calls_mean,
        round(latency_p50, 6) latency_p50, round(latency_p95, 6) latency_p95, round(cost_usd_mean, 6) cost_usd_mean, round(judge_score, 6) judge_score from dm""",
    "drift_length_histogram": _T + """, g as (select distinct "date", l label from t, unnest(['empty', '1-99', '100-249', '250-499', '500-999', '1000-1999', '2000+']) x(l)),
        n as (select "date", case when chars < 1 then 'empty' when chars < 100 then '1-99' when chars < 250 then '100-249' when chars < 500 then '250-499' when chars < 1000 then '500-999' when chars < 2000 then '1000-1999' else '2000+' end label, count(*) n from t group by all)
        select "date", label, coalesce(n, 0) n from g left join n using ("date", label)""",
    "drift_event_mix": _T + """ select "date", event_type, count(*) n from t group by all""",
    "drift_zscore": _S + _B + """ select metric, "date", n_base, round(mu, 6) mu, round(sd, 6) sd, round(z, 4) z from z""",
    "drift_cusum": _S + _B + """ select metric, "date", round(cusum, 4) cusum from c""",
    "drift_alerts": _ST + _B + """ select metric, "date", 'zscore' as method, case when z * dir >= 4 then 'critical' else 'warning' end severity, round(value, 6) as "value", round(mu, 6) baseline, round(z, 3) score from c where z * dir >= 3
        union all select metric, "date", 'cusum', 'warning', round(value, 6), round(mu, 6), round(cusum, 3) from c where cusum >= 5 and z * dir < 3""",
    "drift_psi": _T + """, n as (select "date", event_type label, count(*) n from t group by all), dd as (select "date", row_number() over (order by "date") k from (select distinct "date" from n)), x as (select n.*, k from n join dd using ("date")),
        e as (select d."date", x.label, sum(x.n) n from dd d join x on x.k between d.k - 14 and d.k - 1 where d.k > 5 group by all), a as (select "date", label, n from x where k > 5),
        f as (select coalesce(e."date", a."date") as "date", coalesce(e.n, 0) e, coalesce(a.n, 0) a from e full join a on e."date" = a."date" and e.label = a.label),
        w as (select *, (e + 0.5) / (sum(e) over p + 0.5 * count(*) over p) pe, (a + 0.5) / (sum(a) over p + 0.5 * count(*) over p) pa from f window p as (partition by "date")),
        q as (select "date", round(sum((pa - pe) * ln(pa / pe)), 6) psi from w group by all) select "date", psi, case when psi >= 0.3 then 'critical' when psi >= 0.2 then 'warning' else 'none' end severity from q""",
    "drift_report": _ST + """, r as (select *, row_number() over (partition by metric order by "date") k from s), q as (select metric, avg(value) filter (k <= 7) b, arg_max(value, "date") l from r group by all)
        select metric, round(b, 6) baseline, round(l, 6) latest, round(case when b <> 0 then 100 * (l - b) / b end, 4) change_pct from q""",
    "drift_rolling_mean": _ST + """ select metric, "date", round(avg(value) over (partition by metric order by "date" rows between 6 preceding and current row), 5) mean7 from s""",
    "drift_missing_days": _ST + """, x as (select metric, "date"::date as "date" from s), g as (select metric, unnest(generate_series(min("date"), max("date"), interval 1 day))::date as "date" from x group by metric)
        select metric, "date"::varchar as "date" from g anti join x using (metric, "date")""",
    "stable_hash": """select c_custkey, substr(sha256('v1' || chr(31) || c_name || chr(31) || c_mktsegment), 1, 16) h from customer""",
}

SQL["drift_scored_answers"] = f"""
    select coalesce(model, '(none)') model, case when c < 1 then 'empty' when c < 100 then '1-99' when c < 250 then '100-249' when c < 500 then '250-499' when c < 1000 then '500-999' when c < 2000 then '1000-1999' else '2000+' end bin,
           count(*) n, count_if(r)::bigint n_refused
    from (select model, length(trim(coalesce(response, ''), ' ')) c, regexp_matches(coalesce(response, ''), '{D.REFUSAL.replace("'", "''")}') r from feedback_day1) group by all"""
