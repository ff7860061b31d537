"""Contamination scan of documents with eval_items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contamination as C
from ..session import cut_lineage
from ..sources.tables import table


def _both(spark, d):
    return table(spark, d, "documents"), table(spark, d, "eval_items")


def grams(spark, d):
    docs, items = _both(spark, d)
    return C.gram_evidence(cut_lineage(C.gram_matches(docs, items))).select("doc_id", "item_id", F.col("hits").cast("long").alias("hits"), "overlap", F.col("run").cast("long").alias("run"), F.col("span_words").cast("long").alias("span_words"))


def item_grades(spark, d):
    docs, items = _both(spark, d)
    g = C.grade_items(items, cut_lineage(C.gram_matches(docs, items)))
    return g.select("item_id", "status", F.col("n").cast("long").alias("n"), "overlap", F.col("longest_words").cast("long").alias("longest_words"), F.col("n_docs").cast("long").alias("n_docs"))


def levels(spark, d):
    docs, items = _both(spark, d)
    e = C.merge_evidence(C.gram_evidence(cut_lineage(C.gram_matches(docs, items))))
    return C.doc_levels(e).select("doc_id", "level", F.array_join("eval_ids", ",").alias("eval_ids"))


def clean_corpus(spark, d):
    docs, items = _both(spark, d)
    e = C.merge_evidence(C.gram_evidence(cut_lineage(C.gram_matches(docs, items))))
    return C.decontaminate(docs, C.doc_levels(e)).select("doc_id")


def full_scan(spark, d):
    docs, items = _both(spark, d)
    hits = cut_lineage(C.scan(docs, items))
    return C.grade_items(items, C.matches_of(hits), C.other_evidence(hits))


def top_matches(spark, d):
    """The strongest documents of each item by grams, at most twenty."""
    docs, items = _both(spark, d)
    e = C.merge_evidence(C.gram_evidence(cut_lineage(C.gram_matches(docs, items))))
    return C.top_evidence(e).select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", "overlap")


def scan_summary(spark, d):
    """Counts by status and by method."""
    g = full_scan(spark, d)
    has = lambda m: F.count_if(F.array_contains(F.split("methods", ","), m)).alias(m)
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return g.agg(F.count("*").alias("items"), n("contaminated"), n("suspicious"), n("clean"), has("ngram"), has("minhash"), has("embedding"))


QUERIES = {
    "contamination_items": item_grades, "contamination_grams": grams, "contamination_doc_levels": levels, "contamination_clean_corpus": clean_corpus,
    "contamination_minhash": lambda s, d: C.minhash_evidence(*_both(s, d)), "contamination_cosine": lambda s, d: C.cosine_evidence(*_both(s, d)),
    "contamination_full_scan": full_scan, "contamination_top_matches": top_matches, "contamination_summary": scan_summary,
}

#: The compatibility forms that DuckDB cannot take back by itself: the full-width signs.
_WIDE, _PLAIN = "".join(chr(c + 0xFEE0) for c in range(33, 127)), "".join(chr(c) for c in range(33, 127)).replace("'", "''")
_FOLDED = lambda c: "replace(lower(translate(nfc_normalize(coalesce(" + c + ", '')), '" + _WIDE + "', '" + _PLAIN + "')), 'ß', 'ss')"
_TOK = lambda c: "list_filter(string_split(trim(regexp_replace(" + _FOLDED(c) + ", '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda t: t <> '')"
_BASE = f"""
with iw as (select id item_id, {_TOK("concat_ws(' ', question, answer)")} w from eval_items),
     it as (select item_id, w, case when len(w) >= 8 then least(13, len(w)) else 0 end n from iw),
     ig as (select item_id, n, unnest(range(1, len(w) - n + 2)) - 1 pos, len(w) - n + 1 n_pos, w from it where n > 0),
     ig2 as (select item_id, n, pos, n_pos, array_to_string(w[pos + 1:pos + n], ' ') gram from ig),
     sizes as (select distinct n from it where n > 0),
     dw as (select doc_id, {_TOK("text")} w from documents),
     dg as (select doc_id, n, unnest(range(1, len(w) - n + 2)) - 1 doc_pos, w from dw, sizes where len(w) >= n),
     m as (select distinct doc_id, item_id, doc_pos, pos, dg.n, n_pos from dg join ig2 on dg.n = ig2.n and array_to_string(dg.w[doc_pos + 1:doc_pos + dg.n], ' ') = gram),
     isl as (select *, doc_pos - pos diag, pos - row_number() over (partition by doc_id, item_id, doc_pos - pos order by pos) island from m),
     runs as (select doc_id, item_id, diag, island, count(*) run, any_value(n) n from isl group by all),
     ev as (select h.doc_id, h.item_id, hits, hits::double / n_pos ov, run, run + n - 1 span_words
            from (select doc_id, item_id, count(distinct pos) hits, max(n_pos) n_pos from m group by all) h
            join (select doc_id, item_id, max(run) run, any_value(n) n from runs group by all) r using (doc_id, item_id)),
     lv as (select doc_id, case when max(ov) >= 0.5 then 'contaminated' else 'suspicious' end level,
                   case when max(ov) >= 0.5 then string_agg(item_id, ',' order by item_id) filter (ov >= 0.5) else string_agg(item_id, ',' order by item_id) end eval_ids from ev group by doc_id)
"""

SQL = {
    "contamination_grams": _BASE + "select doc_id, item_id, hits, round(ov, 6) overlap, run, span_words from ev",
    "contamination_items": _BASE + """
        select it.item_id, case when coalesce(hits, 0)::double / (len(w) - n + 1) >= 0.5 then 'contaminated' when hits > 0 then 'suspicious' else 'clean' end status, n::bigint n,
               round(coalesce(hits, 0)::double / (len(w) - n + 1), 6) overlap, coalesce(r.run + n - 1, 0)::bigint longest_words, coalesce(n_docs, 0)::bigint n_docs
        from it left join (select item_id, count(distinct pos) hits, count(distinct doc_id) n_docs from m group by all) h using (item_id)
                left join (select item_id, max(run) run from ev group by all) r using (item_id)""",
    "contamination_top_matches": _BASE + "select item_id, rank, doc_id, ov overlap from (select item_id, row_number() over (partition by item_id order by round(ov, 6) desc, doc_id) rank, doc_id, round(ov, 6) ov from ev) where rank <= 20",
    "contamination_doc_levels": _BASE + "select doc_id, level, eval_ids from lv",
    "contamination_clean_corpus": _BASE + "select doc_id from documents where doc_id not in (select doc_id from lv where level = 'contaminated')",
}

SQL["contamination_minhash"] = f"""
with iw as (select distinct id item_id, w from (select id, {_TOK("concat_ws(' ', question, answer)")} w from eval_items) where len(w) > 0),
     sz as (select greatest(16, ceil(1.5 * quantile_cont(len(w), 0.9)))::bigint s from iw),
     dw as (select row_number() over () d, doc_id, {_TOK("text")} w from documents),
     st as (select d, doc_id, w, unnest(case when len(w) <= s then [0::bigint] else list_distinct(list_append(range(0, len(w) - s, greatest(1, s // 4)), len(w) - s)) end) a, s from dw, sz where len(w) > 0),
     sets as (select 'i' || item_id k, item_id, null::bigint doc_id, w from iw union all select 'd' || d || '-' || a, null, doc_id, w[a + 1:a + s] from st),
     sh as (select k, item_id, doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) else w end) x from sets),
     hs as (select k, item_id, doc_id, len(x) n, list_transform(x, lambda t: ('0x' || substr(md5(t), 1, 7))::bigint) h from sh),
     pm as (select i, (1103515245 * (i + 1) + 12345) % 2147483646 + 1 a, (214013 * (i + 1) + 2531011) % 2147483647 b from range({C.ScanConfig.num_perm}) t(i)),
     sg as (select k, any_value(item_id) item_id, any_value(doc_id) doc_id, any_value(n) n, list(v order by i) sig
            from (select k, item_id, doc_id, n, i, list_min(list_transform(h, lambda y: (a * y + b) % 2147483647)) v from hs, pm) group by k),
     bd as (select k, n, sig, item_id, doc_id, unnest(range({C.ScanConfig.bands})) band from sg),
     cd as (select distinct w.k wk, i.k ik from (select * from bd where item_id is null) w join (select * from bd where item_id is not null) i
            on w.band = i.band and w.sig[2 * w.band + 1] = i.sig[2 * i.band + 1] and w.sig[2 * w.band + 2] = i.sig[2 * i.band + 2]),
     jc as (select w.doc_id, i.item_id, w.n nw, i.n ni, list_sum(list_transform(range(1, {C.ScanConfig.num_perm} + 1), lambda z: (w.sig[z] = i.sig[z])::int))::double / {C.ScanConfig.num_perm} j
            from cd join sg w on w.k = wk join sg i on i.k = ik)
select doc_id, item_id, round(max(least(1.0, j * (ni + nw) / (1 + j) / ni)), 6) containment from jc group by all"""
