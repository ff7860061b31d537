"""Memory of a conversation under a token budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_phrase, whitespace_count, without_articles

FACT = r"(?i)\b(?:my|the user's) ([a-z][a-z ]{1,30}?) (?:is now|has changed to|changed to|is) ([^.?!\n]+)[.?!]"


def suffix_window(turns: DataFrame, budget: int, system_tokens: int = 0, keep_last: bool = False, by: str = "conversation_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """The newest turns that fit: a running sum from the end; the first that does not fit ends the window.

    ``keep_last`` (first in, first out with at least one line): the newest turn stays even if it is too long."""
    w = Window.partitionBy(by).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(whitespace_count(F.col(line))).over(w)
    x = turns.withColumns({"used": used, "_newest": F.row_number().over(Window.partitionBy(by).orderBy(F.desc(pos)))})
    fits = F.col("used") <= budget - system_tokens
    return x.where(fits | (F.col("_newest") == 1) if keep_last else fits).drop("_newest")


def facts(turns: DataFrame, by: str = "conversation_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """(by, attribute, value, last_pos): the latest value stated for every attribute; of several at one place the last in order of text."""
    a, v = (F.regexp_extract_all(F.col(line), F.lit(FACT), F.lit(k)) for k in (1, 2))
    x = turns.select(by, pos, F.posexplode(F.arrays_zip(a.alias("a"), v.alias("v"))).alias("k", "f"))
    return x.groupBy(by, F.lower("f.a").alias("attribute")).agg(F.max_by(F.trim("f.v"), F.struct(F.col(pos), F.col("k"), F.trim("f.v"))).alias("value"), F.max(pos).alias("last_pos"))


def classify(answer: Column, current: Column, stale: Column) -> Column:
    """correct, stale or miss by containment of words, articles aside."""
    a = without_articles(answer)
    return F.when(contains_phrase(a, without_articles(current)), "correct").when(F.exists(stale, lambda v: contains_phrase(a, without_articles(v))), "stale").otherwise("miss")


def recall(probes: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, recall, stale_rate, miss_rate) of classified probes."""
    c = lambda x: F.count_if(F.col("outcome") == x) / F.count("*")
    return probes.groupBy(*by).agg(F.count("*").alias("n"), c("correct").alias("recall"), c("stale").alias("stale_rate"), c("miss").alias("miss_rate"))


def sweep(probes: DataFrame, by: list[str]) -> DataFrame:
    """(by, probes, recall, stale_rate, miss_rate, pinned_recall, updated_recall, compliance, peak_tokens) as ratios of sums over the runs of a
    grid; a ratio without probes is null.

    Probes: outcome, pinned, updated, complied (null where nothing was asked), tokens."""
    ratio = lambda a, b: F.round(F.try_divide(F.count_if(a), F.count_if(b)), 6)
    right = F.col("outcome") == "correct"
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    return probes.groupBy(*by).agg(
        F.count("*").alias("probes"), ratio(right, F.lit(True)).alias("recall"), ratio(F.col("outcome") == "stale", F.lit(True)).alias("stale_rate"), ratio(F.col("outcome") == "miss", F.lit(True)).alias("miss_rate"),
        ratio(right & is_("pinned"), is_("pinned")).alias("pinned_recall"), ratio(right & is_("updated"), is_("updated")).alias("updated_recall"), ratio(is_("complied"), F.col("complied").isNotNull()).alias("compliance"), F.max("tokens").alias("peak_tokens"),
    )


def _hashed(text: str | None, dims: int) -> np.ndarray:
    """Unit vector of hashed words and word pairs."""
    from zlib import crc32

    ws = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    v = np.zeros(dims)
    for f in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]:
        h = crc32(f.encode("utf-8", "surrogatepass"))
        v[h % dims] += 1 if (h >> 16) % 2 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def retrieve(turns: DataFrame, queries: DataFrame, top_k: int = 6, budget: int = 400, dims: int = 1024, by: str = "conversation_id") -> DataFrame:
    """(by, query, lines): the most similar lines by hashed words and pairs, greedily within the budget, in their old order. A query without
    any similar line has [].

    Lines are scored where they lie; the best ``top_k`` are kept per part of a conversation first, then per conversation, so a
    conversation of any length is many tasks and only ``top_k`` lines of it come together."""

    @F.pandas_udf("double")
    def similarity(lines: pd.Series, asked: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}
        vec = lambda t: known[t] if t in known else known.setdefault(t, _hashed(t, dims))
        return pd.Series([float(np.round(vec(a) @ vec(b), 12)) for a, b in zip(lines, asked)], dtype=float)

    q = queries.select(by, "query").distinct()
    x = turns.select(by, "pos", "line").join(q, by).withColumn("s", similarity("line", "query")).where("s > 0").withColumn("part", F.pmod(F.xxhash64("pos", "line"), F.lit(64)))
    for keys in ([by, "query", "part"], [by, "query"]):
        x = x.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("s"), "pos", "line"))).where(F.col("_i") <= top_k)
    size = whitespace_count(F.col("line"))
    best = x.groupBy(by, "query").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "pos", "line", size.alias("n")))).alias("best"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<pos:bigint,line:string>>").alias("kept"))
    take = lambda a, t: F.when(a.used + t.n <= budget, F.struct((a.used + t.n).alias("used"), F.concat(a.kept, F.array(F.struct(t.pos.cast("long").alias("pos"), t.line.alias("line")))).alias("kept"))).otherwise(a)
    got = best.select(by, "query", F.transform(F.array_sort(F.aggregate("best", start, take).kept), lambda t: t.line).alias("lines"))
    return q.join(got, [by, "query"], "left").select(by, "query", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))


def summary(turns: DataFrame, by: str = "conversation_id", pos: str = "pos", line: str = "line", budget: int = 400) -> DataFrame:
    """(by, summary): facts with their latest values in order of last mention; the oldest leave first when it is too long."""
    f = facts(turns, by, pos, line).select(by, "last_pos", F.concat(F.lit("the user's "), "attribute", F.lit(" is "), "value", F.lit(".")).alias("fact"))
    w = Window.partitionBy(by).orderBy(F.desc("last_pos"), "fact").rowsBetween(Window.unboundedPreceding, 0)
    kept = f.withColumn("used", F.sum(whitespace_count(F.col("fact"))).over(w)).where(F.col("used") <= budget)
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("last_pos", "fact"))), lambda x: x.fact), " ").alias("summary"))
