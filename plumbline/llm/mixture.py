"""Mixture of sources to target weights, in tokens of a public tokenizer.

1. documents -> (source, length in tokens): counted exactly, reduced to a histogram per source (partial aggregation);
2. the size of the mixture is ``share`` of all tokens that the target sources have. Each source gets its weight of it, but no more than
   its documents give within its repeat cap; what a small source cannot give is spread over the others by weight (water-filling)
   and reported as its shortfall. So one tiny source does not decide the size of the whole;
3. per source: whole passes over all its documents, then for the remaining budget a subset of documents whose lengths add up to
   it as closely as possible. The subset is chosen by length alone, at every size by the same three steps: the same fraction of
   every length class, rounded down; single long documents while more than TABLE tokens are open; bounded-knapsack dynamic
   programming over the rest (exact to the token where the lengths allow it);
4. of every (source, length) class the chosen number of documents is taken in the order of a seeded hash.

Only the histogram comes to the driver: at most one row per distinct (target source, length), checked against ``max_classes``;
more is an error."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizes import BROADCAST_ROWS
from ..session import cut_lineage
from .bpe import token_count

#: Rows of a (source, length) class from which on its ranking is split into tasks by the leading bits of the hash; ranks stay the same.
HOT_CLASS, BUCKET_BITS = 20_000, 12
#: Tokens of a source's budget that are left to the dynamic programming, the size of its table.
TABLE = 60_000


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that have a source and at least one token; source without case and blanks.

    ``wanted``: a small table of sources; texts of others are not tokenized."""
    rows = docs.select(F.col(key).alias("doc_id"), F.nullif(F.lower(F.trim(source)), F.lit("")).alias("source"), F.col(text).alias("text"))
    rows = rows.where(F.col("source").isNotNull() & (F.length("text") > 0))
    if wanted is not None:
        rows = rows.join(F.broadcast(wanted), "source", "left_semi")
    return rows.select("doc_id", "source", token_count(F.col("text"), path).alias("n_tokens")).where(F.col("n_tokens") > 0)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length, at most ``counts``, so that the sum is as large as possible without exceeding ``budget``."""
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not len(lengths):
        return take
    if (lengths * counts).sum() <= budget:
        return counts.copy()
    # reached[s]: index of the length class that first reached the sum s, and how many of it the way there used
    by, used = np.full(budget + 1, -1, np.int32), np.zeros(budget + 1, np.int32)
    by[0] = len(lengths)
    for z in np.argsort(-lengths):
        size, most = int(lengths[z]), int(min(counts[z], budget // lengths[z]))
        if most <= 0:
            continue
        if by[budget] >= 0:
            break
        old = by >= 0
        last = np.where(old, 0, NOT)  # copies of this length used at each sum
        for start in range(0, budget + 1 - size, size):
            a, b = last[start : start + size], last[start + size : start + 2 * size]
            a = a[: len(b)]
            better = (b == NOT) & (a < most)
            b[better] = a[better] + 1
        fresh = ~old & (last != NOT)
        by[fresh], used[fresh] = z, last[fresh]
    s = int(np.flatnonzero(by >= 0).max())
    while s > 0:
        z, k = by[s], used[s]
        take[z] += k
        s -= int(lengths[z]) * int(k)
    return take


NOT = np.iinfo(np.int32).max


def choose(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE) -> np.ndarray:
    """Subset-sum by length classes: a fraction of each class, single long documents, dynamic programming over the last ``table`` tokens."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.floor(counts * (max(0, budget - table // 2) / total)).astype(np.int64)
    left = budget - int((take * lengths).sum())
    for z in np.argsort(-lengths):
        if left <= table:
            break
        more = int(min(counts[z] - take[z], (left - table) // lengths[z] + 1, left // lengths[z]))
        take[z] += more
        left -= more * int(lengths[z])
    return take + knapsack(lengths, counts - take, left)


def water_fill(most: dict[str, int], weights: dict[str, float], total: float) -> dict[str, float]:
    """Budgets that add up to ``total`` if the sources can give so much: by weight, none above its ``most``."""
    out: dict[str, float] = {}
    free = sorted(s for s in weights if most[s] > 0)
    while free:
        rest, mass = total - sum(out.values()), sum(weights[s] for s in free)
        full = [s for s in free if weights[s] / mass * rest >= most[s]]
        if not full:
            return out | {s: weights[s] / mass * rest for s in free}
        out |= {s: float(most[s]) for s in full}
        free = [s for s in free if s not in out]
    return out


def plan(histogram: dict[str, tuple[np.ndarray, np.ndarray]], targets: list[tuple[str, float, int]], share: float = 0.5) -> tuple[list[tuple], list[tuple]]:
    """Rows (source, length, passes, extra) and rows of the report (see ``shares``)."""
    have = {s: int((histogram[s][0] * histogram[s][1]).sum()) for s, _, _ in targets if s in histogram}
    live = {s: w for s, w, r in targets if have.get(s) and w > 0 and r > 0}
    total, mass = share * sum(have[s] for s in live), sum(live.values())
    budgets = water_fill({s: have[s] * r for s, _, r in targets if s in live}, live, total)
    picks, report = [], []
    for s, w, r in targets:
        aim = int(w / mass * total + 1e-6) if s in live else 0
        budget, passes, actual, top = int(budgets.get(s, 0) + 1e-6), 0, 0, 0
        if s in live:
            lengths, counts = histogram[s]
            passes = min(budget // have[s], r)
            extra = choose(lengths, counts, budget - passes * have[s]) if passes < r else np.zeros(len(lengths), np.int64)
            actual = passes * have[s] + int((extra * lengths).sum())
            top = passes + int(extra.any())
            picks += [(s, int(a), int(passes), int(e), int(n)) for a, e, n in zip(lengths, extra, counts) if passes or e]
        report.append((s, w, r, have.get(s, 0), aim, actual, top, max(0, aim - have.get(s, 0) * max(r, 0)) if s in live else 0))
    return picks, report


def _prepare(docs: DataFrame, targets: DataFrame, path: str | None, max_classes: int, share: float, **names: str) -> tuple[DataFrame, list[tuple], list[tuple]]:
    rows = targets.select(F.lower(F.trim("source")).alias("s"), F.col("weight").cast("double").alias("w"), F.coalesce(F.col("max_repeats"), F.lit(1)).alias("r")).where("s is not null and w > 0").groupBy("s").agg(F.sum("w").alias("w"), F.max("r").alias("r")).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10000 target sources")
    wanted = sorted((x.s, x.w, x.r) for x in rows)
    lengths = cut_lineage(sized(docs, path=path, wanted=docs.sparkSession.createDataFrame([(x[0],) for x in wanted], "source string"), **names))
    grouped = lengths.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).limit(max_classes + 1).collect()
    if len(grouped) > max_classes:
        raise ValueError(f"more than {max_classes} classes of source and length")
    own: dict[str, list[tuple[int, int]]] = {}
    for x in grouped:
        own.setdefault(x.source, []).append((x.n_tokens, x.n))
    picks, report = plan({s: tuple(np.array(sorted(v), np.int64).T) for s, v in own.items()}, wanted, share)
    return lengths, picks, report


def mix(docs: DataFrame, targets: DataFrame, seed: str = "mix-1", path: str | None = None, max_classes: int = 400_000, share: float = 0.5, **names: str) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): the documents of the mixture, ``repeats`` from 1 to the source's cap.

    Null, empty and sourceless documents and those of sources without a target are not used. Sources without documents get
    nothing, their weight is spread over the others in proportion. Empty tables: empty result. Ties of the hash go by id."""
    spark = docs.sparkSession
    lengths, picks, _ = _prepare(docs, targets, path, max_classes, share, **names)
    classes = spark.createDataFrame(picks or [], "source string, n_tokens int, passes int, extra long, n_class long")
    classes = F.broadcast(classes) if len(picks) <= BROADCAST_ROWS else classes
    used = lengths.join(classes, ["source", "n_tokens"]).withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    # a class in which all or none are wanted needs no ranking. Ranks go by the hash; a hot class is cut at its leading bits, which leaves
    # the order as it is, and its buckets are counted first
    plain = used.where((F.col("extra") <= 0) | (F.col("extra") >= F.col("n_class"))).withColumn("more", F.when(F.col("extra") > 0, 1).otherwise(0))
    lead = F.shiftright("h", 64 - BUCKET_BITS)
    part = used.where((F.col("extra") > 0) & (F.col("extra") < F.col("n_class"))).withColumn("bucket", F.when(F.col("n_class") > HOT_CLASS, lead).otherwise(F.lit(0)))
    by_hash = Window.partitionBy("source", "n_tokens", "bucket").orderBy("h", "doc_id")
    calm = part.where(F.col("n_class") <= HOT_CLASS).withColumn("more", F.when(F.row_number().over(by_hash) <= F.col("extra"), 1).otherwise(0))
    cols = ["doc_id", "source", "n_tokens", (F.col("passes") + F.col("more")).alias("repeats")]
    out = plain.select(*cols).unionByName(calm.select(*cols))
    if any(0 < e < n and n > HOT_CLASS for *_, e, n in picks):
        hot = part.where(F.col("n_class") > HOT_CLASS)
        per = hot.groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("n_bucket"))
        earlier = Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = per.withColumn("start", F.coalesce(F.sum("n_bucket").over(earlier), F.lit(0)))
        hot = hot.join(starts, ["source", "n_tokens", "bucket"])
        hot = hot.withColumn("more", F.when(F.col("start") + F.row_number().over(by_hash) <= F.col("extra"), 1).otherwise(0))
        out = out.unionByName(hot.select(*cols))
    return out.where(F.col("repeats") > 0)


def shares(docs: DataFrame, targets: DataFrame, path: str | None = None, max_classes: int = 400_000, share: float = 0.5, **names: str) -> DataFrame:
    """One row per target source: tokens available, aimed at and reached, actual share, most uses of one document, and the tokens by which
    the repeat cap keeps the source below its aim."""
    _, _, report = _prepare(docs, targets, path, max_classes, share, **names)
    total = sum(x[5] for x in report)
    rows = [(*x[:6], round(x[5] / total, 9) if total else 0.0, *x[6:]) for x in report]
    return docs.sparkSession.createDataFrame(rows, "source string, weight double, max_repeats int, tokens_available long, tokens_target long, tokens_actual long, actual_share double, most_uses int, shortfall long")
