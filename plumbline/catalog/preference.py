"""Feedback events and preference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedupe as U
from ..operators import feedback as B
from ..operators import sets as S
from ..session import cut_lineage
from ..sources.tables import table

R = lambda c, k=6: F.round(c, k).alias(c)


def events(spark, d):
    return B.valid_events(table(spark, d, "feedback_day1"))


def stats(spark, d):
    e = events(spark, d)
    return e.groupBy("rating").agg(F.count("*").alias("n"), F.count("correction").alias("with_correction"))


def build(spark, d):
    return B.build_pairs(cut_lineage(events(spark, d)))


def reasons(spark, d):
    p = table(spark, d, "pairs").dropDuplicates(["pair_id"])
    return p.select("pair_id", B.drop_reason(F.col("prompt"), F.col("chosen"), F.col("rejected"), F.col("strategy"), F.col("margin")).alias("reason"))


def with_reasons(spark, d):
    p = table(spark, d, "pairs").dropDuplicates(["pair_id"])
    return p.withColumn("reason", B.drop_reason(F.col("prompt"), F.col("chosen"), F.col("rejected"), F.col("strategy"), F.col("margin")))


def exact(spark, d):
    p = with_reasons(spark, d).where("reason is null")
    k = F.sha2(T.ascii_normalize(F.concat_ws("\n", "prompt", "chosen")), 256)
    return U.first_of(p.select("pair_id", "prompt", "chosen"), k, "pair_id").select("pair_id", "copies", "kept")


def near(spark, d):
    p = with_reasons(spark, d).where("reason is null")
    return U.near_duplicates(p, "pair_id", T.shingles(T.ascii_words(F.concat_ws("\n", "prompt", "chosen")), 3), 0.85)


def near_links(spark, d):
    """Links between different shingle sets of the valid pairs, by representatives."""
    p = with_reasons(spark, d).where("reason is null")
    _, _, reps = U.classes(p, "pair_id", T.shingles(T.ascii_words(F.concat_ws("\n", "prompt", "chosen")), 3))
    return S.similar(reps, None, 0.85).select("a", "b", R("similarity"))


def decontaminated(spark, d):
    p = table(spark, d, "pairs").select(F.col("pair_id").alias("id"), F.col("prompt").alias("text")).where("text is not null").dropDuplicates(["id"])
    g = table(spark, d, "anchor").select(F.col("id").alias("gid"), F.col("prompt").alias("text")).where("text is not null").dropDuplicates(["gid"])
    return B.golden_overlap(p, g).select(F.col("id").alias("pair_id"), R("overlap"))


def scrubbed(spark, d):
    e = table(spark, d, "feedback_day1").dropDuplicates(["event_id"])
    return e.select("event_id", B.scrub("response").alias("s")).select("event_id", F.col("s.text").alias("response"), "s.email", "s.card", "s.phone")


QUERIES = {
    "feedback_rejects": lambda s, d: B.rejected_events(table(s, d, "feedback_day1")), "feedback_events": lambda s, d: events(s, d).select("event_id", "prompt", "rating", "correction"), "feedback_stats": stats, "feedback_last_user": lambda s, d: table(s, d, "feedback_day1").select("event_id", B.last_user(F.col("messages")).alias("last_user")).distinct(),
    "feedback_donors": lambda s, d: B.donors(cut_lineage(events(s, d))).select("event_id", "donor", R("similarity")), "feedback_pairs": lambda s, d: build(s, d).select("source_event", "chosen", "strategy", "margin"), "feedback_rubric": lambda s, d: events(s, d).select("event_id", B.rubric(F.col("prompt"), F.col("response")).alias("score")),
    "pairs_drop_reason": reasons, "pairs_exact_dedupe": exact, "pairs_near_links": near_links, "pairs_near_dedupe": near, "pairs_golden_overlap": decontaminated, "pairs_manifest": lambda s, d: B.manifest(with_reasons(s, d)).select("strategy", "n", "kept", R("median_margin"), R("min_margin"), R("max_margin")),
    "pairs_dataset_hash": lambda s, d: B.dataset_hash(table(s, d, "pairs").select("pair_id", "prompt", "chosen", "rejected").distinct(), "pair_id"), "feedback_scrub": scrubbed,
}

_NORM = "array_to_string(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), ' ')"
_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_RAT = "case when lower(trim(rating)) in ('up', 'thumbs_up', '+1', '1', 'positive', 'good') then 'up' when lower(trim(rating)) in ('down', 'thumbs_down', '-1', '0', 'negative', 'bad') then 'down' end"
_REF = "regexp_matches(replace(lower({0}), '’', ''''), 'i can''t help with|i cannot help with|i''m sorry, but i can|i am sorry, but i can|i''m unable to|i am unable to|as an ai language model|i won''t be able to|i cannot assist|i can''t assist')"
_EV = f"""with x as (select *, case when {_RAT} is null then 'rating' when coalesce(conversation_id, '') = '' then 'conversation_id' when messages is null then 'messages'
      when len(list_filter(messages, lambda m: m is null or m.role is null or m.content is null)) > 0 then 'message' when len(list_filter(messages, lambda m: m.role = 'user')) = 0 then 'no_user_turn' when response is null then 'response' end reason from feedback_day1),
  e as (select event_id, any_value(case when len(messages) = 1 and messages[1].role = 'user' then messages[1].content else array_to_string(list_transform(messages, lambda m: upper(m.role[1]) || lower(m.role[2:]) || ': ' || m.content), chr(10)) end) prompt,
      any_value(response) response, any_value({_RAT}) rating, any_value(case when regexp_matches(correction, '\\S') then correction end) correction from x where reason is null group by event_id)"""
_STOP = "['" + "','".join(B.STOP) + "']"
_CW = "list_distinct(list_filter(" + _WORDS + f", lambda w: length(w) > 2 and not list_contains({_STOP}, w)))"
_RUB = f"""(case when n0 = 0 then 0 else round(greatest(0, least(10, 4.0::double + case when len(want) > 0 then 3.0::double * len(list_intersect(want, have)) / len(want) else 0 end + case when n0 between 12 and 300 then 2.0 when n0 between 5 and 11 then 0.5 else -1.5 end
   + case when nu / n0 < 0.5 then -2 else 0 end + case when ref then -4 else 0 end)), 3) end)"""
_RC = lambda p, r: f"""list_filter(regexp_split_to_array(coalesce({r}, ''), '\\s+'), lambda t: t <> '') ws, {_CW.format(p)} want, {_CW.format(r)} have, {_REF.format(r)} ref"""
_DON = f""", k as (select event_id, list_sort(list_distinct({_WORDS.format('prompt')})) items, {_NORM.format('response')} norm, rating, {_REF.format('response')} refused from e),
  q as (select a.event_id, b.event_id donor, round(len(list_intersect(a.items, b.items))::double / len(list_distinct(a.items || b.items)), 9) similarity from k a, k b where a.rating = 'down' and b.rating = 'up' and not b.refused and a.norm <> b.norm and len(a.items) > 0 and len(b.items) > 0),
  dn as (select *, row_number() over (partition by event_id order by similarity desc, donor desc) i from q where similarity >= 0.6 - 1e-12)"""
_BLANK = lambda c: f"not regexp_matches(coalesce({c}, ''), '\\S')"
_WC = lambda c: f"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '\\s+'), lambda t: t <> ''))"
_LEAK = B.LEAK.replace("'", "''")
_PR = f"""with p as (select distinct on (pair_id) * from pairs), r as (select *, case when {_BLANK('prompt')} or {_BLANK('chosen')} or {_BLANK('rejected')} then 'empty' when {_NORM.format('chosen')} = {_NORM.format('rejected')} then 'identical'
   when {_WC('chosen')} not between 3 and 800 or {_WC('prompt')} > 2000 then 'length' when {_REF.format('chosen')} then 'refusal'
   when strategy = 'teacher' and regexp_matches(replace(chosen, '’', ''''), '{_LEAK}') then 'context_leak'
   when strategy <> 'correction' and (margin is null or margin < 1) then 'low_margin' end reason from p)"""
_SH = f""", h as (select pair_id, {_WORDS.format("prompt || chr(10) || chosen")} w from r where reason is null), s as (select pair_id, list_sort(case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) else list_distinct(w) end) items from h),
   reps as (select min(pair_id) id, items from s group by items), ex as (select id, len(items) n, unnest(items) e from reps), c as (select a.id a, b.id b, count(*) c, any_value(a.n) na, any_value(b.n) nb from ex a join ex b on a.e = b.e and a.id < b.id group by all)"""
SQL = {
    "feedback_rejects": _EV + " select reason, count(distinct event_id) n_events, count(*) n_rows from x where reason is not null group by all",
    "feedback_events": _EV + " select event_id, prompt, rating, correction from e",
    "feedback_stats": _EV + " select rating, count(*) n, count(correction) with_correction from e group by all",
    "feedback_last_user": "select distinct event_id, list_filter(messages, lambda m: m.role = 'user')[-1].content last_user from feedback_day1",
    "feedback_donors": _EV + _DON + " select event_id, donor, round(similarity, 6) similarity from dn where i = 1",
    "feedback_rubric": _EV + f", v as (select event_id, {_RC('prompt', 'response')} from e), y as (select *, len(ws)::double n0, len(list_distinct(list_transform(ws, lambda t: lower(t))))::double nu from v) select event_id, {_RUB} score from y",
    "feedback_pairs": _EV + _DON + f""", pp as (select e.event_id, e.prompt, coalesce(e.correction, d.response) chosen, e.response rejected, case when e.correction is not null then 'correction' else 'similar_up' end strategy from e left join (select * from dn where i = 1) n on e.event_id = n.event_id left join e d on d.event_id = n.donor where e.rating = 'down' and coalesce(e.correction, d.response) is not null),
        v as (select *, 1 side, {_RC('prompt', 'chosen')} from pp union all select *, 2, {_RC('prompt', 'rejected')} from pp), y as (select *, len(ws)::double n0, len(list_distinct(list_transform(ws, lambda t: lower(t))))::double nu from v), z as (select *, {_RUB} sc from y)
        select a.event_id source_event, a.chosen, a.strategy, round(a.sc - b.sc, 3) margin from z a join z b using (event_id) where a.side = 1 and b.side = 2""",
    "pairs_drop_reason": _PR + " select pair_id, reason from r",
    "pairs_exact_dedupe": _PR + f", g as (select pair_id, {_NORM.format('prompt || chr(10) || chosen')} k from r where reason is null) select pair_id, count(*) over (partition by k) copies, pair_id = min(pair_id) over (partition by k) kept from g",
    "pairs_near_links": _PR + _SH + " select a, b, round(c::double / (na + nb - c), 6) similarity from c where c::double / (na + nb - c) >= 0.85",
    "pairs_golden_overlap": f"""with p as (select distinct on (pair_id) pair_id id, {_WORDS.format('prompt')} w from pairs where prompt is not null), g as (select distinct on (id) id gid, {_WORDS.format('prompt')} w from anchor where prompt is not null),
        pg as (select *, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) else [] end g from p), gg as (select *, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) else [] end g from g),
        o as (select p.id, case when array_to_string(p.w, ' ') = array_to_string(g.w, ' ') then 1.0::double when len(g.g) = 0 and len(g.w) >= 2 and contains(' ' || array_to_string(p.w, ' ') || ' ', ' ' || array_to_string(g.w, ' ') || ' ') then 1.0::double
              when len(p.g) > 0 and len(g.g) > 0 then greatest(len(list_intersect(p.g, g.g))::double / len(p.g), len(list_intersect(p.g, g.g))::double / len(g.g)) else 0 end ov from pg p, gg g)
        select id pair_id, round(max(ov), 6) overlap from o group by id having max(ov) > 0""",
    "pairs_manifest": _PR + " select strategy, count(*) n, count(*) filter (reason is null) kept, round(median(margin), 6) median_margin, round(min(margin), 6) min_margin, round(max(margin), 6) max_margin from r group by all",
}
