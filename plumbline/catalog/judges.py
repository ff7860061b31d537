"""Judge audits and shadow comparisons on the anchor table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import unit
from ..operators import judging as J
from ..operators import shadow as H
from ..sources.tables import table

R = lambda c, k=6: F.round(c, k).alias(c)
OWN = "isle"


def anchors(spark, d):
    """Latest vote per id with a valid verdict, and a deterministic judge of both orders."""
    a = table(spark, d, "anchor")
    cols = ["response_a", "response_b", "model_a", "model_b", "human_pref", "human_score_a", "human_score_b"]
    a = a.groupBy("id").agg(F.max_by(F.struct(*cols), F.struct("voted_at", F.coalesce("human_pref", F.lit("")))).alias("r")).select("id", "r.*")
    h = F.lower(F.trim("human_pref"))
    a = a.where(h.isin(*J.LABELS)).withColumn("human", h)
    p1, p2 = F.round(unit(F.lit("ab"), F.col("id")), 4), F.round(unit(F.lit("ba"), F.col("id")), 4)
    lean = J.win_value(F.col("human"))
    return a.withColumns({"ab_p": F.round(0.5 * p1 + 0.5 * lean, 6), "ba_p": F.round(0.6 * p2 + 0.4 * lean, 6)}).withColumns({
        "ab_winner": J.label_from(F.col("ab_p"), 0.02), "ba_winner": J.label_from(F.col("ba_p"), 0.02), "llr": J.log_len_ratio(F.col("response_a"), F.col("response_b")), "self_diff": J.self_diff(F.col("model_a"), F.col("model_b"), OWN)}).withColumn("judge", F.col("ab_winner"))


def agreement(spark, d):
    x = J.agreement(anchors(spark, d))
    return x.select("n", *[R(c) for c in x.columns[1:]])


def position(spark, d):
    x = J.position(anchors(spark, d))
    return x.select(*[R(c) for c in x.columns])


def _reliability(spark, d):
    a = anchors(spark, d).where((F.col("judge") != "tie") & (F.col("human") != "tie"))
    return J.reliability(a, F.greatest(F.col("ab_p"), 1 - F.col("ab_p")), F.col("judge") == F.col("human"))


def reliability(spark, d):
    return _reliability(spark, d).select("bin", "n", R("confidence", 9), R("accuracy", 9))


def ece(spark, d):
    return J.calibration_error(_reliability(spark, d)).select("n", R("ece"))


def verbosity(spark, d):
    return J.verbosity(anchors(spark, d)).select("bucket", "n", R("judge_longer"), R("human_longer"))


def own(spark, d):
    return J.self_preference(anchors(spark, d)).select("n", R("judge_own"), R("human_own"), R("gap"))


def pointwise(spark, d):
    a = anchors(spark, d)
    side = lambda x: F.struct(F.col(f"human_score_{x}").alias("h"), F.col(f"response_{x}").alias("r"), F.lit(x).alias("x"))
    x = a.select("id", F.explode(F.array(side("a"), side("b"))).alias("s")).select("id", "s.*").where(F.col("h").isNotNull() & (J.whitespace_count(F.col("r")) > 0))
    x = x.select(F.col("h"), F.round(F.col("h") + unit(F.lit("s"), F.concat("id", "x")), 1).alias("j"), J.whitespace_count(F.col("r")).cast("double").alias("w"))
    p = J.pointwise(x)
    return p.select("n", *[R(c, 5) for c in p.columns[1:]])


def calibrated(spark, d):
    """Fit on 60 % of the ids by hash, agreement on the others before and after."""
    a = anchors(spark, d).withColumn("m", (J.logit(F.col("ab_p")) + J.logit(F.col("ba_p"))) / 2).withColumn("y", J.win_value(F.col("human"))).withColumn("u", unit(F.lit("split"), F.col("id")))
    train, test = a.where("u < 0.6"), a.where("u >= 0.6")
    feats = ["m", "llr", "self_diff"]
    w = J.logistic(train, feats, "y")
    band = J.best_tie_band(train.withColumn("p", J.predicted(w, feats)))
    p = test.withColumn("p", J.predicted(w, feats)).withColumn("judge", J.label_from(F.col("p"), band))
    one = lambda x, n: J.agreement(x).select(F.lit(n).alias("variant"), "n", R("agreement"), R("cohen_kappa"))
    swap = test.withColumn("judge", J.label_from((F.col("ab_p") + F.col("ba_p")) / 2, 0.02))
    return one(test, "raw").unionByName(one(swap, "swap")).unionByName(one(p, "calibrated"))


def shadow_pairs(spark, d):
    """Anchor answers as mirrored calls with made-up costs and errors by hash."""
    a = table(spark, d, "anchor").groupBy("id").agg(F.max_by(F.struct("response_a", "response_b", "model_a", "model_b", "human_pref"), F.struct("voted_at", F.coalesce("human_pref", F.lit("")))).alias("r")).select("id", "r.*")
    side = lambda x: F.struct(F.col(f"model_{x}").alias("model"), F.col(f"response_{x}").alias("text"), J.whitespace_count(F.col(f"response_{x}")).alias("tokens_out"), (J.whitespace_count(F.col(f"response_{x}")) / 10).alias("latency"), (J.whitespace_count(F.col(f"response_{x}")) / (1000 if x == "a" else 4000)).alias("cost"), F.when(unit(F.lit("err" + x), F.col("id")) < 0.03, "timeout").alias("error"), F.when(J.whitespace_count(F.col(f"response_{x}")) > 40, "length").otherwise("stop").alias("finish_reason"))
    return a.select("id", side("a").alias("primary"), side("b").alias("shadow"), "human_pref")


def sides(spark, d):
    x = H.side_stats(shadow_pairs(spark, d))
    return x.select("side", "n", *[R(c) for c in x.columns[2:]])


def shadow_agreement(spark, d):
    return H.agreement(shadow_pairs(spark, d)).select("n", R("exact"), R("near"), R("mean_jaccard"))


def jaccard_histogram(spark, d):
    return H.histogram(H.with_agreement(shadow_pairs(spark, d)), F.col("jaccard"))


def similarity_histogram(spark, d):
    x = H.with_agreement(shadow_pairs(spark, d)).withColumn("s", H.similarity(H.ascii_normalize(F.col("primary.text")), H.ascii_normalize(F.col("shadow.text"))))
    return H.histogram(x, F.col("s"))


def _outcomes(spark, d):
    v = F.lower(F.trim("human_pref"))
    side = F.when(v == "a", "primary").when(v == "b", "shadow").when(v == "tie", "tie")
    x = H.with_agreement(shadow_pairs(spark, d)).withColumn("ab", side).withColumn("ba", F.when(unit(F.lit("flip"), F.col("id")) < 0.1, "tie").otherwise(F.col("ab")))
    return x.withColumn("outcome", F.when(F.col("same"), "tie").otherwise(H.both_orders(F.col("ab"), F.col("ba"))))


def tally(spark, d):
    t = H.tally(_outcomes(spark, d))
    return t.select("win", "loss", "tie", "error", *[R(c) for c in t.columns[4:]])


def worst(spark, d):
    return H.worst(_outcomes(spark, d)).select("id", "outcome", R("jaccard"))


QUERIES = {
    "judge_agreement": agreement, "judge_position": position, "judge_reliability": reliability, "judge_ece": ece, "judge_verbosity": verbosity, "judge_self_preference": own, "judge_pointwise": pointwise, "judge_calibration": calibrated,
    "shadow_sides": sides, "shadow_agreement": shadow_agreement, "shadow_jaccard_histogram": jaccard_histogram, "shadow_similarity_histogram": similarity_histogram, "shadow_tally": tally, "shadow_worst": worst,
}

_U = lambda s, k: f"(('0x' || substr(sha256('{s}' || chr(31) || {k}), 1, 13))::bigint / 4503599627370496.0::double)"
_LAB = lambda p, b=0.02: f"case when abs({p} - 0.5) <= {b} then 'tie' when {p} > 0.5 then 'a' else 'b' end"
_WC = lambda c: f"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '\\s+'), lambda t: t <> ''))"
_A = f"""with l as (select *, row_number() over (partition by id order by voted_at desc, coalesce(human_pref, '') desc) i from anchor), h as (select *, lower(trim(human_pref)) human from l where i = 1 and lower(trim(human_pref)) in ('a', 'b', 'tie')),
  p as (select *, round(0.5 * round({_U('ab', 'id')}, 4) + 0.5 * case human when 'a' then 1.0 when 'b' then 0.0 else 0.5 end, 6) ab_p, round(0.6 * round({_U('ba', 'id')}, 4) + 0.4 * case human when 'a' then 1.0 when 'b' then 0.0 else 0.5 end, 6) ba_p,
     ln(greatest({_WC('response_a')}, 1)::double / greatest({_WC('response_b')}, 1)) llr, (split_part(lower(trim(model_a)), '-', 1) = 'isle')::int - (split_part(lower(trim(model_b)), '-', 1) = 'isle')::int sd from h),
  a as (select *, {_LAB('ab_p')} abw, {_LAB('ba_p')} baw from p)"""
_WV = lambda c: f"case {c} when 'a' then 1.0::double when 'b' then 0.0 else 0.5 end"
_SP = f"""with s as (select *, {_WC('response_a')} wa, {_WC('response_b')} wb, {_U('erra', 'id')} < 0.03 ea, {_U('errb', 'id')} < 0.03 eb, regexp_extract_all(lower(coalesce(response_a, '')), '[a-z0-9]+') ta, regexp_extract_all(lower(coalesce(response_b, '')), '[a-z0-9]+') tb from (select *, row_number() over (partition by id order by voted_at desc, coalesce(human_pref, '') desc) i from anchor) where i = 1),
  g as (select *, array_to_string(ta, ' ') = array_to_string(tb, ' ') same, case when len(list_distinct(ta || tb)) = 0 then 1.0::double else len(list_intersect(list_distinct(ta), list_distinct(tb)))::double / len(list_distinct(ta || tb)) end jac from s where not ea and not eb),
  o as (select *, case when same then 'tie' when v is null then 'error' when {_U('flip', 'id')} < 0.1 and v <> 'tie' then 'tie' when v = 'b' then 'win' when v = 'a' then 'loss' else 'tie' end outcome from (select *, case when lower(trim(human_pref)) in ('a', 'b', 'tie') then lower(trim(human_pref)) end v from g))"""
SQL = {
    "judge_agreement": _A + """, q as (select count(*) n, avg((human = abw)::int) po, avg(case when human <> 'tie' and abw <> 'tie' then (human = abw)::int end) dc, avg((abw = 'tie')::int) tr,
        avg((human = 'a')::int) * avg((abw = 'a')::int) + avg((human = 'b')::int) * avg((abw = 'b')::int) + avg((human = 'tie')::int) * avg((abw = 'tie')::int) pe from a)
        select n, round(po, 6) agreement, round(dc, 6) agreement_decisive, round(case when pe < 1 then (po - pe) / (1 - pe) else 1 end, 6) cohen_kappa, round(tr, 6) tie_rate from q""",
    "judge_position": _A + """ select round(avg((abw = baw)::int), 6) consistency, round(avg(case when abw <> 'tie' and baw <> 'tie' then (abw <> baw)::int end), 6) flip_rate,
        round((count(*) filter (abw = 'a') + count(*) filter (baw = 'b'))::double / (count(*) filter (abw <> 'tie') + count(*) filter (baw <> 'tie')), 6) first_slot_win_rate, round((count(*) filter (abw = 'a') + count(*) filter (baw = 'b'))::double / (count(*) filter (abw <> 'tie') + count(*) filter (baw <> 'tie')) - 0.5, 6) position_bias from a""",
    "judge_reliability": _A + """ select least(greatest(floor((greatest(ab_p, 1 - ab_p) - 0.5) * 20 + 1e-9), 0), 9)::int bin, count(*) n, round(avg(greatest(ab_p, 1 - ab_p)), 9) confidence, round(avg((abw = human)::int), 9) accuracy from a where abw <> 'tie' and human <> 'tie' group by all""",
    "judge_ece": _A + """, b as (select least(greatest(floor((greatest(ab_p, 1 - ab_p) - 0.5) * 20 + 1e-9), 0), 9)::int bin, count(*) n, avg(greatest(ab_p, 1 - ab_p)) c, avg((abw = human)::int) k from a where abw <> 'tie' and human <> 'tie' group by all) select sum(n)::bigint n, round(sum(n * abs(c - k)) / sum(n), 6) ece from b""",
    "judge_verbosity": _A + """ select (abs(llr) >= 0.1)::int + (abs(llr) >= 0.3)::int + (abs(llr) >= 0.7)::int bucket, count(*) n, round(avg(((abw = 'a') = (llr > 0))::int), 6) judge_longer, round(avg(((human = 'a') = (llr > 0))::int), 6) human_longer from a where abw <> 'tie' and human <> 'tie' and abs(llr) > 1e-9 group by all""",
    "judge_self_preference": _A + f""", q as (select case when sd > 0 then {_WV('abw')} else 1 - {_WV('abw')} end j, case when sd > 0 then {_WV('human')} else 1 - {_WV('human')} end h from a where sd <> 0) select count(*) n, round(avg(j), 6) judge_own, round(avg(h), 6) human_own, round(avg(j) - avg(h), 6) gap from q""",
    "judge_pointwise": _A + f""", x as (select id, 'a' x, human_score_a h, response_a r from a union all select id, 'b', human_score_b, response_b from a), y as (select h, round(h + {_U('s', "id || x")}, 1) j, ln({_WC('r')}::double) l from x where h is not null and {_WC('r')} > 0),
        z as (select *, rank() over (order by j) + (count(*) over (partition by j) - 1) / 2.0 rj, rank() over (order by h) + (count(*) over (partition by h) - 1) / 2.0 rh from y)
        select count(*) n, round(corr(j, h), 5) pearson, round(corr(rj, rh), 5) spearman, round(avg(abs(j - h)), 5) mae, round((covar_pop(l, j) * var_pop(h) - covar_pop(j, h) * covar_pop(l, h)) / (var_pop(l) * var_pop(h) - covar_pop(l, h) * covar_pop(l, h)), 5) length_slope from z""",
    "shadow_sides": _SP + """, u as (select 'primary' side, not ea and not eb ok, ea er, wa w, wa / 1000.0::double c from s union all select 'shadow', not ea and not eb, eb, wb, wb / 4000.0::double from s)
        select side, count(*) n, round(avg(c) filter (ok), 6) mean_cost, round(sum(c) filter (ok), 6) total_cost, round(avg(w) filter (ok), 6) mean_tokens_out, round(quantile_cont(w / 10.0::double, 0.5) filter (ok), 6) p50, round(quantile_cont(w / 10.0::double, 0.95) filter (ok), 6) p95, round(avg(er::int), 6) error_rate, round(avg((w > 40)::int) filter (ok), 6) truncated_rate from u group by all""",
    "shadow_agreement": _SP + " select count(*) n, round(avg(same::int), 6) exact, round(avg((jac >= 0.6)::int), 6) near, round(avg(jac), 6) mean_jaccard from g",
    "shadow_jaccard_histogram": _SP + ", c as (select least(floor(jac * 10 + 1e-12), 9)::int bin, count(*) n from g group by all) select b.bin::int bin, coalesce(n, 0)::bigint n from range(10) b(bin) left join c on b.bin = c.bin",
    "shadow_tally": _SP + """, t as (select count(*) filter (outcome = 'win') win, count(*) filter (outcome = 'loss') loss, count(*) filter (outcome = 'tie') tie, count(*) filter (outcome = 'error') error from o), w as (select *, win + loss n, win::double / (win + loss) p from t)
        select win, loss, tie, error, round(p, 6) win_rate, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) low, round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) high, round((win + tie)::double / (win + loss + tie), 6) non_loss_rate from w""",
    "shadow_worst": _SP + " select id, outcome, round(jac, 6) jaccard from o where not same order by case outcome when 'loss' then 0 when 'win' then 1 when 'error' then 2 else 3 end, jac, id limit 8",
}
