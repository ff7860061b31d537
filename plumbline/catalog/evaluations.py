"""Evaluation results derived from lineitem, orders, customer and part: frontiers, routers, comparisons, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import adjust
from ..operators import frontier as P
from ..operators import gate as G
from ..operators import significance as S
from ..sources.tables import table

R = lambda c, k=6: F.round(c, k).alias(c)


def eval_rows(spark, d):
    """(tenant, config, task_id, success, cost, latency, confidence): one row per segment, line status and part."""
    li, o, c = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy(F.col("c_mktsegment").alias("tenant"), F.concat("l_returnflag", "l_linestatus").alias("config"), F.col("l_partkey").alias("task_id")).agg(
        F.when(2 * F.count_if(F.col("l_discount") <= 0.05) >= F.count("*"), 1).otherwise(0).alias("success"), F.avg(F.col("l_extendedprice") / 997).alias("cost"), F.avg("l_quantity").alias("latency"), F.max(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax") * 10)).alias("confidence"))


def stats(spark, d):
    x = P.config_stats(eval_rows(spark, d))
    return x.select("tenant", "config", "n", F.col("successes").cast("long").alias("successes"), *[R(c) for c in ("success_rate", "ci_low", "ci_high", "mean_cost", "cost_per_success", "p95_latency")])


def front(spark, d):
    return P.frontier(P.config_stats(eval_rows(spark, d))).select("tenant", "config", R("mean_cost"), R("success_rate"), "on_frontier")


def router(spark, d):
    p = P.router(eval_rows(spark, d), "NO", "NF")
    return p.select("tenant", "threshold", *[R(c) for c in ("escalation_rate", "success_rate", "mean_cost", "cost_per_success", "p95_latency")])


def joint(spark, d):
    rows = eval_rows(spark, d)
    return P.joint_frontier(P.config_stats(rows), P.router(rows, "NO", "NF"))


def best(spark, d):
    return P.best_router(P.router(eval_rows(spark, d), "NO", "NF")).select("tenant", "threshold", R("escalation_rate"), R("mean_cost"))


def recommended(spark, d):
    return P.recommend(P.config_stats(eval_rows(spark, d)))


def pair(spark, d):
    return P.router_pair(P.config_stats(eval_rows(spark, d)), 0.999)


def whatif(spark, d):
    rows = eval_rows(spark, d)
    return P.frontier_diff(P.config_stats(rows), P.config_stats(P.scaled_cost(rows, "N*", 0.5)))


def raw_scores(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("item_id"), F.when(F.col("l_discount") <= 0.05, 1.0).otherwise(0.0).alias("score"), F.col("p_brand").alias("cluster"))


def scores(spark, d):
    return S.load_scores(raw_scores(spark, d))


def pair_stats(spark, d):
    return S.paired(scores(spark, d), "A", "R").agg(F.count("*").alias("n"), F.round(F.avg("diff"), 6).alias("diff"), F.count_if(F.col("diff") > 0).alias("up"), F.count_if(F.col("diff") < 0).alias("down"), F.round(F.stddev_samp("diff"), 6).alias("sd"))


def clusters(spark, d):
    return S.cluster_sums(S.paired(scores(spark, d), "A", "R")).select("cluster", F.round("s", 6).alias("s"), "n")


def compared(spark, d):
    from dataclasses import asdict

    c = S.compare(scores(spark, d), "A", "R", boots=1000)
    return spark.createDataFrame([tuple(asdict(c).values())], "model_a string, model_b string, n long, clusters int, difference double, ci_low double, ci_high double, p_value double, test string, detectable double, significant boolean")


def unpaired(spark, d):
    """Two models on different items: one on the even, one on the odd parts."""
    from dataclasses import asdict

    odd = F.col("item_id") % 2 == 1
    x = scores(spark, d).where((odd & (F.col("model") == "A")) | (~odd & (F.col("model") == "R")))
    c = S.compare(x, "A", "R", boots=1000)
    return spark.createDataFrame([tuple(asdict(c).values())], "model_a string, model_b string, n long, clusters int, difference double, ci_low double, ci_high double, p_value double, test string, detectable double, significant boolean")


def pairs_all(spark, d):
    return S.all_pairs(scores(spark, d)).select("model_a", "model_b", "n", R("mean_a"), R("mean_b"), R("diff"))


def pvalues(spark, d):
    """Adjusted p values of a fixed grid of comparisons, by the three methods."""
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), ((F.col("s_suppkey") % 97 + 1) / 1000).alias("p"))
    holm, bh, bon = (adjust(p, "p", m).select("key", "p", F.round("p_adjusted", 9).alias(m)) for m in ("holm", "bh", "bonferroni"))
    return holm.join(bh.drop("p"), "key").join(bon.drop("p"), "key")


def gate_cases(spark, d, flag):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    x = o.where(F.col("o_orderstatus") == flag)
    return x.select(F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderpriority")).alias("case_id"), F.col("o_custkey").alias("item_id"), F.when(k % 10 < 8, 1).otherwise(0).alias("success"), (F.col("o_totalprice") / 1e6).alias("latency"), F.when(k % 50 == 0, "timeout").alias("error"), (k % 300).alias("tokens"), F.create_map(F.lit("exact"), k % 10 < 8, F.lit("json"), k % 20 < 19).alias("checks"), F.lit(flag).alias("build"), k.alias("k"))


def gate_one(spark, d, flag):
    """One run per case: the last order of a customer and priority."""
    x = gate_cases(spark, d, flag)
    keep = [c for c in x.columns if c not in ("case_id",)]
    return x.groupBy("case_id").agg(F.max_by(F.struct(*keep), "k").alias("r")).select("case_id", "r.*")


def gate_summary(spark, d):
    x = gate_one(spark, d, "O").unionByName(gate_one(spark, d, "F"))
    return G.run_summary(x).select("build", "n", R("success_rate"), R("p50"), R("p95"), "errors", "tokens")


def gate_scorers(spark, d):
    return G.scorer_rates(gate_one(spark, d, "O").unionByName(gate_one(spark, d, "F"))).select("build", "scorer", "n", R("pass_rate"))


def gate_changes(spark, d):
    return G.case_changes(gate_one(spark, d, "F"), gate_one(spark, d, "O"))


def gate_verdict(spark, d):
    g = G.gate(gate_one(spark, d, "F"), gate_one(spark, d, "O"))
    return spark.createDataFrame([(g["passed"], ", ".join(g["reasons"]), g["drop"], g["p95_rise"])], "passed boolean, reasons string, drop double, p95_rise double")


QUERIES = {
    "frontier_config_stats": stats, "frontier_points": front, "frontier_router": router, "frontier_joint": lambda s, d: joint(s, d).select("tenant", "name", "on_frontier"), "frontier_best_router": best, "frontier_recommend": recommended, "frontier_router_pair": pair, "frontier_whatif": whatif,
    "significance_pair_stats": pair_stats, "significance_cluster_sums": clusters, "significance_compare": compared, "significance_unpaired": unpaired, "significance_all_pairs": pairs_all, "significance_adjust": pvalues, "significance_leaderboard": lambda s, d: S.leaderboard(scores(s, d), boots=400),
    "significance_scores": lambda s, d: scores(s, d).select("model", "item_id", R("score"), "cluster"),
    "gate_summary": gate_summary, "gate_scorers": gate_scorers, "gate_changes": gate_changes, "gate_verdict": gate_verdict,
}

_E = """with e as (select c_mktsegment tenant, l_returnflag || l_linestatus config, l_partkey task_id, case when 2 * count(*) filter (l_discount <= 0.05) >= count(*) then 1 else 0 end success, avg(l_extendedprice / 997) as "cost",
    avg(l_quantity) latency, max(case when l_linenumber % 2 = 0 then l_tax * 10 end) confidence from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all),
  s as (select tenant, config, count(*) n, sum(success)::bigint successes, sum(success)::double / count(*) success_rate, avg("cost") mean_cost, sum("cost") / nullif(sum(success), 0) cost_per_success, quantile_cont(latency, 0.95) p95_latency from e group by all),
  f as (select *, coalesce(success_rate > max(success_rate) over (partition by tenant order by mean_cost, success_rate desc, config rows between unbounded preceding and 1 preceding), true) on_frontier from s)"""
_RT = _E + """, j as (select a.tenant, a.task_id, a.success sa, b.success sb, a."cost" ca, b."cost" cb, a.latency la, b.latency lb, coalesce(a.confidence, ('0x' || substr(sha256('router' || chr(31) || a.task_id::varchar), 1, 13))::bigint / 4503599627370496.0::double) conf
    from e a join e b using (tenant, task_id) where a.config = 'NO' and b.config = 'NF'), g as (select *, k / 20.0::double threshold from j, range(0, 21) x(k)),
  r as (select tenant, threshold, avg(case when conf >= threshold then 0.0::double else 1.0::double end) escalation_rate, sum(case when conf >= threshold then sa else sb end)::double / count(*) success_rate, avg(case when conf >= threshold then ca else cb + ca end) mean_cost,
    avg(case when conf >= threshold then ca else cb + ca end) * count(*) / nullif(sum(case when conf >= threshold then sa else sb end), 0) cost_per_success, quantile_cont(case when conf >= threshold then la else lb + la end, 0.95) p95_latency from g group by all)"""
_SC = """with rw as (select l_returnflag model, l_partkey item_id, case when l_discount <= 0.05 then 1.0::double else 0.0::double end score, p_brand as "cluster" from lineitem join part on l_partkey = p_partkey),
  s as (select model, item_id, avg(score) score, max("cluster") as "cluster" from rw group by all), p as (select a.item_id, b.score - a.score diff, a."cluster" from s a join s b using (item_id) where a.model = 'A' and b.model = 'R')"""
_G = """with x as (select o_custkey || '-' || o_orderpriority case_id, o_orderstatus build, case when o_orderkey % 10 < 8 then 1 else 0 end success, o_totalprice / 1e6 latency, o_orderkey % 50 = 0 err, o_orderkey % 300 tokens, o_orderkey k,
    row_number() over (partition by o_orderstatus, o_custkey, o_orderpriority order by o_orderkey desc) i from orders where o_orderstatus in ('O', 'F')), g as (select * from x where i = 1)"""
SQL = {
    "frontier_config_stats": _E + """ select tenant, config, n, successes, round(success_rate, 6) success_rate,
        round(greatest(0, (success_rate + 3.8416 / (2 * n) - 1.96 * sqrt(success_rate * (1 - success_rate) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) ci_low, round(least(1, (success_rate + 3.8416 / (2 * n) + 1.96 * sqrt(success_rate * (1 - success_rate) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) ci_high,
        round(mean_cost, 6) mean_cost, round(cost_per_success, 6) cost_per_success, round(p95_latency, 6) p95_latency from s""",
    "frontier_points": _E + " select tenant, config, round(mean_cost, 6) mean_cost, round(success_rate, 6) success_rate, on_frontier from f",
    "frontier_router": _RT + " select tenant, threshold, round(escalation_rate, 6) escalation_rate, round(success_rate, 6) success_rate, round(mean_cost, 6) mean_cost, round(cost_per_success, 6) cost_per_success, round(p95_latency, 6) p95_latency from r",
    "frontier_best_router": _RT + """, al as (select tenant, arg_max(success_rate, threshold) top, arg_max(mean_cost, threshold) tc from r group by all), ok as (select r.*, tc, row_number() over (partition by tenant order by mean_cost, threshold) i from r join al using (tenant) where success_rate >= top - 0.02)
        select tenant, threshold, round(escalation_rate, 6) escalation_rate, round(mean_cost, 6) mean_cost from ok where i = 1 and escalation_rate < 1 and mean_cost < tc""",
    "frontier_recommend": _E + " select tenant, arg_min(config, (mean_cost, config)) config from s join (select tenant, max(success_rate) top from s group by all) using (tenant) where success_rate >= top - 0.02 group by tenant",
    "frontier_whatif": _E + """, s2 as (select tenant, config, sum(success)::double / count(*) success_rate, avg("cost" * case when config like 'N%' then 0.5 else 1 end) mean_cost from e group by all),
        f2 as (select *, coalesce(success_rate > max(success_rate) over (partition by tenant order by mean_cost, success_rate desc, config rows between unbounded preceding and 1 preceding), true) now from s2)
        select tenant, coalesce(string_agg(config, ',' order by config) filter (now and not on_frontier), '') joined, coalesce(string_agg(config, ',' order by config) filter (on_frontier and not now), '') as "left" from f join f2 using (tenant, config) group by tenant""",
    "significance_pair_stats": _SC + " select count(*) n, round(avg(diff), 6) diff, count(*) filter (diff > 0) up, count(*) filter (diff < 0) down, round(stddev_samp(diff), 6) sd from p",
    "significance_cluster_sums": _SC + ' select "cluster", round(sum(diff), 6) s, count(*) n from p group by all',
    "significance_scores": _SC + ' select model, item_id, round(score, 6) score, "cluster" from s',
    "significance_all_pairs": _SC + """, m as (select model, avg(score) mean from s group by all) select a.model model_a, b.model model_b, count(*) n, round(any_value(ma.mean), 6) mean_a, round(any_value(mb.mean), 6) mean_b, round(avg(b.score - a.score), 6) diff
        from s a join s b using (item_id) join m ma on ma.model = a.model join m mb on mb.model = b.model where ma.mean > mb.mean or (ma.mean = mb.mean and a.model < b.model) group by all""",
    "significance_adjust": """with q as (select s_suppkey as "key", (s_suppkey % 97 + 1) / 1000.0::double p from supplier), r as (select *, row_number() over (order by p, "key") i, count(*) over () m from q)
        select "key", p, round(least(1, max((m - i + 1) * p) over (order by i)), 9) holm, round(least(1, min(m / i * p) over (order by i desc)), 9) bh, round(least(1, p * m), 9) bonferroni from r""",
    "gate_summary": _G + " select build, count(*) n, round(avg(success), 6) success_rate, round(quantile_cont(latency, 0.5), 6) p50, round(quantile_cont(latency, 0.95), 6) p95, count(*) filter (err) errors, sum(tokens)::bigint tokens from g group by all",
    "gate_scorers": _G + """ select build, 'exact' scorer, count(*) n, round(avg((k % 10 < 8)::int), 6) pass_rate from g group by all union all select build, 'json', count(*), round(avg((k % 20 < 19)::int), 6) from g group by all""",
    "gate_changes": _G + """ select coalesce(b.case_id, c.case_id) case_id, case when c.case_id is null then 'missing' when b.case_id is null then 'added' when b.success = 1 and c.success = 0 then 'newly_failing' when b.success = 0 and c.success = 1 then 'newly_passing' else 'same' end change
        from (select * from g where build = 'F') b full join (select * from g where build = 'O') c on b.case_id = c.case_id""",
}
