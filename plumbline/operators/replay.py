"""Recorded runs: content keys, cache probes in order of consumption, first divergence, bisection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_hex


def node_key(kind: Column, name: Column, payload: Column) -> Column:
    return stable_hex(kind, name, payload)


def first_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """(run, index, how): first node of (run, index, key, output) whose key or output differs or that one side lacks; null index: none."""
    x = a.select("run", "index", F.col("key").alias("ka"), F.col("output").alias("oa"), F.lit(1).alias("a"))
    y = b.select("run", "index", F.col("key").alias("kb"), F.col("output").alias("ob"), F.lit(1).alias("b"))
    j = x.join(y, ["run", "index"], "full_outer")
    how = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "ended").when(F.col("ka") != F.col("kb"), "key").when(~F.equal_null("oa", "ob"), "output")
    j = j.withColumn("how", how)
    return j.groupBy("run").agg(F.min(F.when(F.col("how").isNotNull(), F.struct("index", "how"))).alias("d")).select("run", "d.index", "d.how")


def served(requests: DataFrame, cache: DataFrame, run: str = "run") -> DataFrame:
    """Each request with the recorded output that a first-in-first-out cache per key would serve: the n-th request of a key gets
    the n-th record of it, later ones none."""
    nth = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(run, "key").orderBy("index")))
    c = nth(cache).select(run, "key", "_n", F.col("output").alias("served"))
    return nth(requests).join(c, [run, "key", "_n"], "left").withColumn("source", F.when(F.col("served").isNotNull(), "cassette").otherwise("live")).drop("_n")


def root_cause(trials: DataFrame) -> DataFrame:
    """(run, root): the first node whose replacement flips the run, of (run, index, outcome)."""
    return trials.groupBy("run").agg(F.min(F.when(F.col("outcome") == "flipped", F.col("index"))).alias("root"), F.count("*").alias("trials"))
