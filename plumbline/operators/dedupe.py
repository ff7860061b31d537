"""Exact and near duplicates without collecting links: similarity search over class representatives, greedy keep-first by rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizes import small
from ..session import cut_lineage
from . import sets


def first_of(df: DataFrame, key: Column, pos: str) -> DataFrame:
    """Rows with (representative flag): of equal keys the one of the smallest ``pos`` is kept; one partial aggregate, no sort of groups."""
    k = df.withColumn("_k", key)
    first = k.groupBy("_k").agg(F.min(pos).alias("_first"), F.count("*").alias("copies"))
    return k.join(first, "_k").withColumn("kept", F.col(pos) == F.col("_first")).drop("_k", "_first")


def similar_sets(left: DataFrame, right: DataFrame | None, threshold: float, key: str = "id", items: str = "items") -> DataFrame:
    """(a, b, similarity) of all pairs of sets with Jaccard similarity of at least ``threshold``; with one table, of a < b.

    The sets of either side must be distinct (classes of equal sets are handled by their representatives). Empty sets: no pairs."""

    def of(df: DataFrame) -> DataFrame:
        return cut_lineage(df.select(F.col(key).alias("id"), sets.hashed(F.col(items)).alias("items"), F.size(items).alias("n")).where("n > 0"))

    return sets.similar(of(left), None if right is None else of(right), threshold)


def greedy_keep(nodes: DataFrame, links: DataFrame, key: str = "id") -> DataFrame:
    """(id, kept): in ascending order a row is dropped iff it is linked with an earlier kept row."""
    return nodes.select(key).join(_dropped(links).withColumnRenamed("b", key).withColumn("_d", F.lit(True)), key, "left").select(key, F.col("_d").isNull().alias("kept"))


def _dropped(links: DataFrame) -> DataFrame:
    """Rounds: a row without earlier open neighbours is kept, all linked with it are dropped, their links go. The number of rounds is
    the length of the longest chain of such decisions; each reads the links that are still open only."""
    links = cut_lineage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    out = links.select("b").limit(0)
    while links.limit(1).count():
        kept = links.select("a").distinct().join(links.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = cut_lineage(links.join(kept, "a").select("b").distinct())
        out, gone = out.unionByName(gone), small(gone)
        links = cut_lineage(links.join(gone, "b", "left_anti").join(gone.withColumnRenamed("b", "a"), "a", "left_anti"))
    return out


def classes(df: DataFrame, key: str, items: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all ids, (id, rep) of those whose set stands more than once, sets of the representatives); only ids and hashes are shuffled."""
    x = df.select(F.col(key).alias("id"), F.array_sort(items).alias("items"))
    x = cut_lineage(x.select("id", F.sha2(F.array_join("items", "\x1f"), 256).alias("h"), sets.hashed(F.col("items")).alias("items"), F.size("items").alias("n")))
    first = x.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("h", "rep")
    again = cut_lineage(x.select("id", "h").join(small(first), "h").select("id", "rep"))
    reps = x.join(small(again.where("id <> rep").select("id")), "id", "left_anti")
    return x.select("id"), again, reps.where("n > 0").select("id", "items", "n")


def near_duplicates(df: DataFrame, key: str, text_items: Column, threshold: float) -> DataFrame:
    """(key, class_id, kept): class = representative of equal sets; ``kept`` by greedy keep-first over the classes."""
    ids, again, reps = classes(df, key, text_items)
    dropped = _dropped(sets.similar(reps, None, threshold).select("a", "b")).select(F.col("b").alias("rep"), F.lit(True).alias("_d"))
    x = ids.join(small(again), "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    return x.join(small(dropped), "rep", "left").select(F.col("id").alias(key), F.col("rep").alias("class_id"), (F.col("_d").isNull() & (F.col("id") == F.col("rep"))).alias("kept"))
