"""JSON lines, chat or plain text files as records; permissive parsing; append-only stores and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Keys that hold text, in order (fixed values).
TEXT_KEYS = ("text", "prompt", "completion", "input", "output", "content")


def record_text(raw: Column, keys: tuple[str, ...] = TEXT_KEYS) -> Column:
    """Text of a JSON object: its text keys, then the contents of its messages, on lines; a line that is no object is its own text."""
    fields = [F.get_json_object(raw, f"$.{k}") for k in keys]
    chat = F.array_join(F.transform(F.from_json(F.get_json_object(raw, "$.messages"), "array<struct<role:string,content:string>>"), lambda m: m.content), "\n")
    text = F.concat_ws("\n", *[F.nullif(f, F.lit("")) for f in fields], F.nullif(chat, F.lit("")))
    return F.when(F.try_parse_json(raw).isNotNull() & raw.rlike(r"^\s*\{"), text).otherwise(raw)


def read_records(spark: SparkSession, path: str, keys: tuple[str, ...] = TEXT_KEYS) -> DataFrame:
    """(id, text, raw, file): the object's id, else a hash of file and line content; blank lines are left out.

    Files are split at line borders and read in parallel; ids do not depend on the splits."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(F.col("value").rlike(r"\S"))
    fallback = F.concat_ws(":", "file", F.substring(F.sha2("value", 256), 1, 12))
    return lines.select(F.coalesce(F.get_json_object("value", "$.id"), fallback).alias("id"), record_text(F.col("value"), keys).alias("text"), F.col("value").alias("raw"), "file")


def read_events(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines with a reason). Bad: no JSON, or a field that does not fit the schema."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    x = lines.select("value", F.try_parse_json("value").isNull().alias("broken"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    bad = x.where("broken or r is null").select(F.col("value").alias("line"), F.when(F.col("broken"), "not JSON").otherwise("does not fit the schema").alias("reason"))
    return x.where("not broken and r is not null").select("r.*"), bad


def read_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Rows of a table partitioned by ``date``: only the directories of these days are read. A day without data is an error."""
    df = spark.read.parquet(path).where(F.col("date").between(first, last))
    days = {str(r.date) for r in df.select("date").distinct().collect()}
    wanted = {str(r.d) for r in spark.sql(f"select explode(sequence(date'{first}', date'{last}')) d").collect()}
    if wanted - days:
        raise FileNotFoundError(f"no data for {', '.join(sorted(wanted - days))}")
    return df


class AppendStore:
    """Append-only Parquet store without repeated keys."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key

    def exists(self) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(conf).exists(p)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def append(self, rows: DataFrame) -> int:
        """Adds the rows whose key is not there yet, once each; how many."""
        rows = rows.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        if self.exists():
            rows = rows.join(self.read().select(self.key), self.key, "left_anti")
        rows = rows.withColumn("ingested_at", F.current_timestamp()).persist()
        try:
            n = rows.count()
            if n:
                rows.write.mode("append").parquet(self.path)
            return n
        finally:
            rows.unpersist()


class MetricStore:
    """Tables runs, metrics, dists and alerts, partitioned by date; saving a day again replaces it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def save(self, table: str, rows: DataFrame) -> None:
        """Replaces exactly the days in ``rows`` (dynamic partition overwrite)."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{self.root}/{table}")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")

    def series(self, metric: str) -> DataFrame:
        return self.read("metrics").where(F.col("metric") == metric).select("date", "value")

    def alerted_dates(self, severity: str = "critical") -> DataFrame:
        return self.read("alerts").where(F.col("severity") == severity).select("date").distinct()


def dataset_problems(pairs: DataFrame) -> DataFrame:
    """(pair_id, problem) of rows that a trainer could not use: missing or blank fields, chosen equal to rejected."""
    blank = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(r"\S")
    p = F.when(blank("prompt"), "no prompt").when(blank("chosen"), "no chosen").when(blank("rejected"), "no rejected").when(F.col("chosen") == F.col("rejected"), "chosen equals rejected")
    return pairs.select("pair_id", p.alias("problem")).where("problem is not null").distinct()


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_cassettes(nodes: DataFrame, path: str) -> None:
    """Runs as nested JSON: one line per run with its nodes in order."""
    nodes.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("index", "key", "output"))).alias("nodes")).write.mode("overwrite").json(path)


def load_cassettes(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.schema("run long, nodes array<struct<index:long,key:string,output:string>>").json(path)
    return x.select("run", F.explode("nodes").alias("n")).select("run", "n.*")


def cached_completions(requests: DataFrame, cache: DataFrame, prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """(answered from the cache, still open) by the content key of the prompt; the open ones once per key."""
    k = requests.withColumn("key", F.sha2(F.col(prompt), 256))
    hit = k.join(cache.select("key", "completion"), "key", "left")
    return hit.where("completion is not null"), hit.where("completion is null").dropDuplicates(["key"]).drop("completion")


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table (a report of at most ``limit`` rows)."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
