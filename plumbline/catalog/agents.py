"""Trajectories, retrieval answers, memories, replays and robustness on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import unit
from ..operators import memory as M
from ..operators import neighbours as N
from ..operators import replay as Y
from ..operators import retrieval as Q
from ..operators import robustness as B
from ..operators import trajectory as T
from ..sources.tables import table

R = lambda c, k=6: F.round(c, k).alias(c)
SPEC = T.Spec({"signup": T.Tool(safety=True), "view": T.Tool(("signup",), params={"k": (0, 94)}), "click": T.Tool(("view",), max_calls=3), "purchase": T.Tool(("click", "signup"))}, forbidden=("error",), mandatory=("signup",), max_steps=12)


def calls(spark, d):
    """Events of a user and day as calls of one run; views carry their k."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("task_id"), F.col("event_id").alias("step"), F.col("event_type").alias("tool"), F.when(F.col("event_type") == "view", F.create_map(F.lit("k"), k)).otherwise(F.create_map().cast("map<string,double>")).alias("args"), F.when(F.col("event_type") == "view", k.cast("int").cast("string")).otherwise("").alias("args_key"))


def graded(spark, d):
    return T.grade_calls(calls(spark, d), SPEC)


def call_issues(spark, d):
    return graded(spark, d).select("task_id", "step", F.array_join(F.array_sort("hard"), ",").alias("hard"), F.array_join(F.array_sort("soft"), ",").alias("soft"))


def runs(spark, d):
    r = T.grade_runs(graded(spark, d), SPEC)
    return r.select("task_id", "n_calls", F.col("n_hard").cast("long").alias("n_hard"), F.col("n_soft").cast("long").alias("n_soft"), F.coalesce("first_failure", F.lit(-1)).alias("first_failure"), "score", "passed")


def run_summary(spark, d):
    return T.grade_runs(graded(spark, d), SPEC).agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), F.round(F.avg("score"), 6).alias("mean_score"))


def bm25(spark, d):
    items = table(spark, d, "eval_items").where(F.regexp_extract("id", r"(\d+)", 1).cast("int") % 50 == 0)
    return Q.bm25_top(items.select(F.col("id").alias("query_id"), F.col("question").alias("text")), table(spark, d, "documents").where("text is not null")).select("query_id", "rank", "doc_id", R("score", 5))


def rag_cases(spark, d):
    """Answers of eval_items with the item's own texts as documents; responses by hash."""
    e = table(spark, d, "eval_items").where("answer is not null").select("id", "question", "answer", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rep"))
    u = unit(F.lit("rag"), F.concat("id", F.col("rep").cast("string")))
    docs = F.array(F.struct(F.concat("id", F.lit("-a")).alias("id"), F.col("answer").alias("text")), F.struct(F.concat("id", F.lit("-q")).alias("id"), F.col("question").alias("text")))
    cite = F.concat(F.lit(" ["), "id", F.when(u < 0.3, F.lit("-a]")).when(u < 0.5, F.lit("-x]")).otherwise(F.lit("-q]")))
    resp = F.when(u < 0.7, F.concat("answer", cite)).when(u < 0.8, F.lit(Q.ABSTAIN)).when(u < 0.85, F.lit("[CONFLICTING_EVIDENCE] both")).when(u < 0.9, F.lit("The documents do not state it.")).when(u < 0.95, F.concat(F.lit("["), "id", F.lit("-a]"))).otherwise(F.lit("something else"))
    p = F.element_at(F.array(*[F.lit(x) for x in ("clean", "injection", "stale", "conflict", "missing")]), F.col("rep") + 1)
    exp = F.when(F.col("rep") < 3, "answer").when(F.col("rep") == 3, "conflict").otherwise("abstain")
    return e.select(F.col("id").alias("case_id"), p.alias("perturbation"), exp.alias("expected"), F.col("answer").alias("gold"), F.array(F.lit("something else")).alias("forbidden"), docs.alias("docs"), resp.alias("response"))


def rag_scored(spark, d):
    return Q.score(rag_cases(spark, d)).select("case_id", "perturbation", "abstained", "conflict", "answer_correct", F.coalesce(F.col("citation_valid").cast("string"), F.lit("none")).alias("citation_valid"), "forbidden_hit", "malformed", "correct", "lie")


def turns(spark, d):
    f = table(spark, d, "feedback_day1").where("event_id is not null and messages is not null").dropDuplicates(["event_id"])
    x = f.select("event_id", F.posexplode("messages").alias("pos", "m")).where("m.content is not null")
    return x.select(F.col("event_id").alias("conversation_id"), "pos", F.concat(F.col("m.role"), F.lit(": "), F.col("m.content")).alias("line"))


def window_memory(spark, d):
    return M.suffix_window(turns(spark, d), 40, 5).select("conversation_id", "pos", F.col("used").cast("long").alias("used"))


def fifo_memory(spark, d):
    return M.suffix_window(turns(spark, d), 25, 0, True).select("conversation_id", "pos")


def facts(spark, d):
    t = table(spark, d, "real_requests").where("request_id is not null")
    o = t.select(F.col("request_id").alias("conversation_id"), F.lit(0).alias("pos"), F.concat(F.lit("My plan is now "), F.col("max_tokens").cast("string"), F.lit(". The user's heat is "), F.coalesce(F.col("temperature").cast("string"), F.lit("unknown")), F.lit("!")).alias("line")).distinct()
    # decimal points end a sentence, so only whole parts are kept; the plan of a request is its largest
    return M.facts(o).groupBy("attribute", "value").agg(F.count("*").alias("n"))


def probes(spark, d):
    a = table(spark, d, "anchor").dropDuplicates(["id"])
    o = M.classify(F.col("response_a"), F.substring_index("response_b", " ", 2), F.array(F.substring_index("response_b", " ", 1), F.lit("Open")))
    return M.recall(a.select(F.lower(F.trim("model_a")).alias("model"), o.alias("outcome")), ["model"]).select("model", "n", R("recall"), R("stale_rate"), R("miss_rate"))


def retrieved(spark, d):
    t = turns(spark, d)
    q = t.where("pos = 0").select("conversation_id", F.col("line").alias("query"))
    return M.retrieve(t, q, 3, 60).select("conversation_id", F.size("lines").alias("n_lines"))


def _tape(spark, d, flag):
    li = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag)
    return li.groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("index")).agg(F.max("l_linestatus").alias("s"), F.max("l_quantity").alias("q")).select("run", "index", Y.node_key(F.lit("tool"), F.col("s"), F.col("index").cast("string")).alias("key"), F.floor(F.col("q") / 25).cast("string").alias("output"))


def diverged(spark, d):
    return Y.first_divergence(_tape(spark, d, "A"), _tape(spark, d, "R")).select("run", F.coalesce(F.col("index"), F.lit(-1)).cast("long").alias("index"), F.coalesce("how", F.lit("none")).alias("how"))


def served(spark, d):
    return Y.served(_tape(spark, d, "A"), _tape(spark, d, "R")).groupBy("run", "source").agg(F.count("*").alias("n"))


def attack_runs(spark, d):
    r = table(spark, d, "real_requests").where("request_id is not null").groupBy("request_id").agg(F.max("max_tokens").alias("k"), F.max(F.coalesce("user", F.lit(""))).alias("u"), F.max(F.coalesce("temperature", F.lit(0.0))).alias("t"))
    h = unit(F.lit("attack"), F.col("request_id"))
    return r.select(F.col("request_id").alias("run_id"), F.when(h < 0.33, "none").when(h < 0.66, "basic").otherwise("hardened").alias("level"), F.when(h < 0.1, "key C-A-N 42x").otherwise("fine").alias("answer"), F.when((h > 0.4) & (h < 0.45), F.array(F.lit("can_42X"))).otherwise(F.array().cast("array<string>")).alias("sink"), F.when(F.col("k") == 1024, F.when(h < 0.2, F.array(F.lit("rm"))).otherwise(F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("forbidden"), (h > 0.97).alias("crashed"), (h > 0.95).alias("schema_violation"), (h < 0.93).alias("terminated"), ((h > 0.5) & (h < 0.52)).alias("infra_error"), F.concat(F.lit("s"), (F.col("k") % 7).cast("string")).alias("seed"), F.when(F.col("t") > 0.3, "tool").otherwise("user").alias("vector"))


def attack_findings(spark, d):
    return B.oracles(attack_runs(spark, d), "CAN-42x").select("run_id", "level", "oracle", "severity")


def attack_resilience(spark, d):
    r = attack_runs(spark, d)
    return B.resilience(r, B.oracles(r, "CAN-42x"))


def text_claims(spark, d):
    """How many documents hold each claim."""
    c = table(spark, d, "documents").where("text is not null").select(F.explode(B.claims(F.col("text"))).alias("claim"))
    return c.groupBy("claim").agg(F.count("*").alias("n"))


def field_errors(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("cust"), F.col("o_orderpriority").alias("prio"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("status"))
    e = B.schema_errors(o, {"cust": {"type": "integer", "min": 10, "max": 1000}, "prio": {"type": "enum", "choices": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}, "day": {"type": "date"}, "status": {"pattern": "[OF]", "max_length": 1}})
    return o.select("o_orderkey", F.array_join(e, "; ").alias("errors"))


def coverage(spark, d):
    return B.pair_coverage(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"])


def probe_rates(spark, d):
    li = table(spark, d, "lineitem")
    k = F.col("l_partkey") % 10
    x = li.select(F.col("l_returnflag").alias("axis"), F.col("l_linestatus").alias("category"), F.when(k < 2, "fail").when(k == 2, "crash").when(k == 3, "unlabeled").otherwise("pass").alias("outcome"))
    return B.probe_rates(x, ["axis", "category"])


def normalised(spark, d):
    """The normalisers on every document."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.sha2(X.ascii_normalize(F.col("text")), 256).alias("ascii_hash"), F.size(X.tokens(F.col("text"))).alias("n_tokens"), X.whitespace_count(F.regexp_replace("text", r"[^\x20-\x7e]", " ")).alias("n_words"), X.approx_tokens(F.col("text")).alias("approx"), F.size(X.shingles(X.ascii_words(F.col("text")), 3)).alias("n_shingles"), F.size(X.windows(X.ascii_words(F.col("text")), 36, 9)).alias("n_windows"))


def nearest(spark, d):
    """The five nearest vectors by cosine of every vector whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    return N.nearest(e, e.where("vec_id % 50 = 0")).select(F.col("query").alias("q"), "vec_id", "cosine", "rank")


def _cases(spark, d):
    """Prompts of the anchors as generated cases, the questions of eval_items as seeds."""
    a = table(spark, d, "anchor").where("id is not null").groupBy("id").agg(F.max("prompt").alias("text"))
    return a, table(spark, d, "eval_items").select("id", F.col("question").alias("text"))


def case_novelty(spark, d):
    return B.novelty(*_cases(spark, d)).select("id", R("novelty"))


def case_rejects(spark, d):
    return B.reject_reason(*_cases(spark, d)).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def variants(spark, d):
    v = table(spark, d, "eval_items").select("id", F.explode(B.format_variants(F.col("question"))).alias("variant", "text"))
    return v.select("id", "variant", F.sha2("text", 256).alias("h"))


def mutated(spark, d):
    a = table(spark, d, "eval_items").select(F.col("id").alias("attack_id"), F.col("question").alias("text"), F.array().cast("array<string>").alias("lineage"))
    return B.mutations(B.mutations(a), 2).select("attack_id", F.array_join("lineage", ">").alias("lineage"), F.length("text").alias("n"))


def summaries(spark, d):
    return M.summary(turns(spark, d).withColumn("line", F.concat("line", F.lit(" My plan is p"), F.col("pos").cast("string"), F.lit("."))))


QUERIES = {
    "edge_novelty": case_novelty, "edge_rejects": case_rejects, "edge_format_variants": variants, "attack_mutations": mutated, "memory_summary": summaries,
    "trajectory_calls": call_issues, "trajectory_runs": runs, "trajectory_summary": run_summary, "trajectory_issue_counts": lambda s, d: T.issue_counts(graded(s, d)), "rag_bm25": bm25, "rag_scored": rag_scored, "rag_metrics": lambda s, d: Q.metrics(Q.score(rag_cases(s, d))), "rag_unstable": lambda s, d: Q.unstable_rate(Q.score(rag_cases(s, d))),
    "memory_window": window_memory, "memory_fifo": fifo_memory, "memory_facts": facts, "memory_recall": probes, "memory_retrieval": retrieved, "replay_divergence": diverged, "replay_cache": served, "attack_findings": attack_findings, "attack_resilience": attack_resilience,
    "edge_text_claims": text_claims, "edge_schema_errors": field_errors, "edge_pair_coverage": coverage, "edge_probe_rates": probe_rates, "text_normalisers": normalised, "embedding_neighbours": nearest,
}

_U = lambda s, k: f"(('0x' || substr(sha256('{s}' || chr(31) || {k}), 1, 13))::bigint / 4503599627370496.0::double)"
_TR = """with c as (select user_id || '/' || strftime(ts, '%Y-%m-%d') task_id, event_id step, event_type tool, (props->>'$.k')::int k from events),
  r as (select *, row_number() over (partition by task_id order by step) no, row_number() over (partition by task_id, tool order by step) cnt, row_number() over (partition by task_id, tool, case when tool = 'view' then k end order by step) same from c),
  s1 as (select *, min(case when tool = 'signup' then step end) over (partition by task_id) ok_s from r),
  s2 as (select *, min(case when tool = 'view' and k <= 94 and ok_s < step then step end) over (partition by task_id) ok_v, min(case when tool = 'view' and not coalesce(k <= 94 and ok_s < step, false) then step end) over (partition by task_id) bad_v from s1),
  s3 as (select *, min(case when tool = 'click' and ok_v < step then step end) over (partition by task_id) ok_c, min(case when tool = 'click' and not coalesce(ok_v < step, false) then step end) over (partition by task_id) bad_c from s2),
  g as (select *, list_filter(case tool when 'error' then ['forbidden_tool'] when 'view' then [case when not coalesce(ok_s < step, false) then 'skipped_safety_check' end, case when k > 94 then 'invalid_value' end]
      when 'click' then [case when not coalesce(ok_v < step, false) then case when bad_v < step then 'dependency_failed' else 'order_violation' end end]
      when 'purchase' then [case when not coalesce(ok_c < step, false) then case when bad_c < step then 'dependency_failed' else 'order_violation' end end, case when not coalesce(ok_s < step, false) then 'skipped_safety_check' end] else [] end, lambda x: x is not null) hard,
      list_filter(case when tool = 'error' then [] else [case when no > 12 then 'max_steps_exceeded' end, case when tool = 'click' and cnt > 3 then 'max_calls_exceeded' end, case when same > 1 then 'redundant' end] end, lambda x: x is not null) soft from s3),
  q as (select task_id, count(*) n_calls, sum(len(hard)) + max((ok_s is null)::int) n_hard, sum(len(soft)) n_soft, min(case when len(hard) > 0 then step end) first_failure from g group by all),
  w as (select *, round(greatest(0, 1 - 0.5 * n_hard - 0.1 * n_soft), 4) score from q)"""
_STEM = lambda c: f"list_transform(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda w: case when regexp_matches(w, '^.{{4,}}ing$') then regexp_replace(w, 'ing$', '') when regexp_matches(w, '^.{{4,}}ed$') then regexp_replace(w, 'ed$', '') when regexp_matches(w, '^.{{4,}}es$') then regexp_replace(w, 'es$', '') when regexp_matches(w, '^.{{4,}}s$') then regexp_replace(w, 's$', '') else w end)"
_TU = """with f as (select distinct on (event_id) event_id, messages from feedback_day1 where event_id is not null and messages is not null), x as (select event_id, unnest(messages) m, generate_subscripts(messages, 1) - 1 pos from f),
  t as (select event_id conversation_id, pos, m.role || ': ' || m.content line from x where m.content is not null), u as (select *, sum(len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> ''))) over (partition by conversation_id order by pos desc) used, row_number() over (partition by conversation_id order by pos desc) i from t)"""
_NT = "array_to_string(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda w: w not in ('a', 'an', 'the')), ' ')"
_AT = f"""with r as (select request_id, max(max_tokens) k, max(coalesce(temperature, 0)) t, {_U('attack', 'request_id')} h from real_requests where request_id is not null group by request_id), a as (select *, case when h < 0.33 then 'none' when h < 0.66 then 'basic' else 'hardened' end level from r),
  o as (select request_id run_id, level, k, t, unnest(list_filter([case when h < 0.1 or (h > 0.4 and h < 0.45) then 'canary_leaked' end, case when k = 1024 and h < 0.2 then 'forbidden_tool_invoked' end, case when h > 0.97 then 'unhandled_exception' end, case when h > 0.95 and not h > 0.97 then 'schema_violation' end, case when not h < 0.93 and not h > 0.97 then 'no_termination' end], lambda x: x is not null)) oracle from a where not (h > 0.5 and h < 0.52)),
  f as (select *, case oracle when 'canary_leaked' then 'critical' when 'forbidden_tool_invoked' then 'critical' when 'schema_violation' then 'medium' else 'high' end severity from o)"""
SQL = {
    "edge_novelty": """with c as (select id, max(prompt) t from anchor where id is not null group by id), f as (select id, case when length(t) >= 4 then list_distinct(list_transform(range(1, length(t) - 2), lambda i: substr(lower(t), i, 4))) else [lower(t)] end s from c),
        e as (select case when length(question) >= 4 then list_distinct(list_transform(range(1, length(question) - 2), lambda i: substr(lower(question), i, 4))) else [lower(question)] end q from eval_items), x as (select id, len(s) n, unnest(s) g from f), y as (select row_number() over () k, q from e), z as (select k, len(q) n, unnest(q) g from y),
        j as (select id, k, count(*) c, any_value(x.n) a, any_value(z.n) b from x join z using (g) group by id, k) select f.id, round(1 - coalesce(max(c::double / (a + b - c)), 0), 6) novelty from f left join j using (id) group by f.id""",
    "trajectory_calls": _TR + " select task_id, step, array_to_string(list_sort(hard), ',') hard, array_to_string(list_sort(soft), ',') soft from g",
    "trajectory_runs": _TR + " select task_id, n_calls, n_hard::bigint n_hard, n_soft::bigint n_soft, coalesce(first_failure, -1) first_failure, score, n_hard = 0 and score >= 0 passed from w",
    "trajectory_summary": _TR + " select count(*) n, round(avg((n_hard = 0)::int), 6) pass_rate, round(avg(score), 6) mean_score from w",
    "trajectory_issue_counts": _TR + " select code, count(*) n from (select unnest(hard || soft) code from g) group by all",
    "rag_bm25": f"""with q as (select id query_id, unnest({_STEM('question')}) t from eval_items where regexp_extract(id, '(\\d+)', 1)::int % 50 = 0), d as (select doc_id, {_STEM('text')} w from documents where text is not null), n as (select count(*) n, avg(len(w)) a from d),
        p as (select doc_id, len(w) l, unnest(w) t from d), tf as (select doc_id, l, t, count(*) tf from p where t in (select t from q) group by all), df as (select t, count(*) df from tf group by all),
        s as (select query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) score from q join tf using (t) join df using (t), n group by all), r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) "rank" from s) select query_id, "rank", doc_id, round(score, 5) score from r where "rank" <= 5""",
    "memory_window": _TU + " select conversation_id, pos, used::bigint used from u where used <= 35",
    "memory_fifo": _TU + " select conversation_id, pos from u where used <= 25 or i = 1",
    "memory_recall": f"""with a as (select distinct on (id) * from anchor order by id), o as (select lower(trim(model_a)) model, ' ' || {_NT.format('response_a')} || ' ' x, {_NT.format("array_to_string(string_split(response_b, ' ')[1:2], ' ')")} cur, {_NT.format("string_split(response_b, ' ')[1]")} st from a),
        c as (select model, case when cur <> '' and contains(x, ' ' || cur || ' ') then 'correct' when (st <> '' and contains(x, ' ' || st || ' ')) or contains(x, ' open ') then 'stale' else 'miss' end outcome from o)
        select model, count(*) n, round(avg((outcome = 'correct')::int), 6) recall, round(avg((outcome = 'stale')::int), 6) stale_rate, round(avg((outcome = 'miss')::int), 6) miss_rate from c group by all""",
    "replay_divergence": """with t as (select l_returnflag f, l_suppkey run, l_linenumber as "index", max(l_linestatus) s, floor(max(l_quantity) / 25)::bigint::varchar o from lineitem group by all), a as (select * from t where f = 'A'), b as (select * from t where f = 'R'),
        j as (select coalesce(a.run, b.run) run, coalesce(a."index", b."index") as "index", case when a.run is null then 'added' when b.run is null then 'ended' when a.s <> b.s then 'key' when a.o is distinct from b.o then 'output' end how from a full join b on a.run = b.run and a."index" = b."index")
        select run, coalesce(min("index") filter (how is not null), -1)::bigint as "index", coalesce(arg_min(how, "index") filter (how is not null), 'none') how from j group by run""",
    "replay_cache": """with t as (select l_returnflag f, l_suppkey run, l_linenumber as "index", max(l_linestatus) s, floor(max(l_quantity) / 25) o from lineitem group by all), n as (select *, row_number() over (partition by f, run, s, "index" order by "index") i from t)
        select a.run, case when b.run is not null then 'cassette' else 'live' end source, count(*) n from (select * from n where f = 'A') a left join (select * from n where f = 'R') b on a.run = b.run and a.s = b.s and a."index" = b."index" and a.i = b.i group by all""",
    "attack_findings": _AT + " select run_id, level, oracle, severity from f",
    "attack_resilience": _AT + """, n as (select level, count(*) runs from a group by all), x as (select level, count(distinct run_id) failed from f group by all), w as (select level, sum(case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end) weight from (select distinct level, oracle, severity, k % 7 sd, t > 0.3 v from f) group by all)
        select level, runs, coalesce(failed, 0) failed, round(coalesce(failed, 0)::double / runs, 3) attack_success_rate, round(1 / (1 + coalesce(weight, 0)::double / runs), 3) resilience from n left join x using (level) left join w using (level)""",
    "edge_schema_errors": """select o_orderkey, array_to_string(list_filter([case when o_custkey < 10 then 'cust: < min 10' end, case when o_custkey > 1000 then 'cust: > max 1000' end, case when o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM') then 'prio: not in the choices' end, case when o_orderstatus not in ('O', 'F') then 'status: does not match' end], lambda x: x is not null), '; ') errors from orders""",
    "edge_pair_coverage": "with l as (select l_returnflag::varchar l_returnflag, l_linestatus::varchar l_linestatus, l_linenumber::varchar l_linenumber, l_discount::varchar l_discount from lineitem)" + " union all ".join(f" select '{a}' f1, '{b}' f2, count(distinct ({a}, {b})) covered, count(distinct {a}) * count(distinct {b}) total from l" for a, b in (("l_discount", "l_linenumber"), ("l_discount", "l_linestatus"), ("l_discount", "l_returnflag"), ("l_linenumber", "l_linestatus"), ("l_linenumber", "l_returnflag"), ("l_linestatus", "l_returnflag"))),
    "edge_probe_rates": """select l_returnflag axis, l_linestatus category, count(*) n, count(*) filter (l_partkey % 10 < 2) fail, count(*) filter (l_partkey % 10 = 2) crash, round(count(*) filter (l_partkey % 10 <= 2)::double / nullif(count(*) filter (l_partkey % 10 <> 3), 0), 6) failure_rate from lineitem group by grouping sets ((), (l_returnflag), (l_linestatus))""",
    "text_normalisers": """with d as (select doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') w from documents where text is not null)
        select doc_id, sha256(array_to_string(w, ' ')) ascii_hash, len(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda t: t <> ''))::int n_tokens, len(list_filter(regexp_split_to_array(regexp_replace(text, '[^\\x20-\\x7e]', ' ', 'g'), '\\s+'), lambda t: t <> ''))::int n_words, greatest(1, length(text) // 4)::int approx,
          len(case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) else list_distinct(w) end)::int n_shingles, case when len(w) <= 36 then 1 else len(list_distinct(range(1, len(w) - 34, 9) || [len(w) - 35])) end::int n_windows from d""",
    "embedding_neighbours": """with e as (select vec_id, embedding::double[] v from embeddings), n as (select vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) v from e),
        c as (select q.vec_id q, n.vec_id, round(list_dot_product(q.v, n.v), 6) cosine from n, n q where q.vec_id % 50 = 0 and q.vec_id <> n.vec_id), r as (select *, row_number() over (partition by q order by cosine desc, vec_id) "rank" from c) select q, vec_id, cosine, "rank" from r where "rank" <= 5""",
}
