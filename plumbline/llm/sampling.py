"""Weighted Poisson sample that is the same on every run and layout and keeps its members as data grow.

A record is taken iff  hash(salt, id) < rate * weight.  The hash is a pure function of the id, so partitions and order do not
matter; a record, once in, stays in as long as its weight never falls. Weights damp heavy users: the requests of a user's
day weigh (1 + requests of that user on earlier days) ** -damping. Late rows and redeliveries that name another user would lower
the weight of a request afterwards, so the running maximum of each request's weight is stored (``WeightStore``, append-only) and
holds from then on, whatever user, day or count the request comes to have: an inclusion probability never falls. Requests
whose hash is not below the rate can never be taken, as no weight is above 1, and are not stored."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SCALE = 1 << 52


def unit_hash(key: Column, salt: str) -> Column:
    """13 hex digits of sha256 as a fraction in [0, 1): uniform, exact in a double."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(salt), key), 256), 1, 13), 16, 10).cast("double") / F.lit(float(SCALE))


def requests(df: DataFrame, key: str = "request_id", user: str = "user", at: str = "received_at") -> DataFrame:
    """(request_id, user, day): one row per id without case and outer blanks, as first received. A null or blank user is ''.
    Ids that are null or blank cannot be recognised again: they are left out. A null time counts as the first of all days."""
    rows = df.select(
        F.nullif(F.lower(F.trim(key)), F.lit("")).alias("request_id"), F.lower(F.trim(F.coalesce(user, F.lit("")))).alias("user"),
        F.coalesce(F.to_date(at), F.lit("1970-01-01").cast("date")).alias("day"), F.coalesce(F.col(at).cast("timestamp"), F.lit(0).cast("timestamp")).alias("at"),
    ).where(F.col("request_id").isNotNull())
    # the first delivery that names a user decides; all deliveries of an id meet in one partial aggregate
    first = F.min_by(F.struct("user", "day"), F.struct((F.col("user") == "").alias("x"), "at", "user"))
    return rows.groupBy("request_id").agg(first.alias("r")).select("request_id", "r.user", "r.day")


def day_weights(reqs: DataFrame, damping: float = 0.5) -> DataFrame:
    """(user, day, weight): counts per user and day first, so a hot user is a row per day, not a row per request."""
    daily = reqs.groupBy("user", "day").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return daily.select("user", "day", F.pow(1 + F.coalesce(F.sum("n").over(w), F.lit(0)), F.lit(-damping)).alias("weight"))


class WeightStore:
    """Running maxima of the weights, (request_id, weight), in a folder that all executors share; each run appends a part.

    A part is overwritten when its run is repeated, so a run that failed half-way can be started again."""

    def __init__(self, path: str) -> None:
        self.path = path

    def read(self, spark: SparkSession) -> DataFrame:
        """One row per request: the largest of its weights. Empty where nothing has been stored yet."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        schema = "request_id string, weight double"
        if not files.exists(folder):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/run=*").groupBy("request_id").agg(F.max("weight").alias("weight"))

    def append(self, weights: DataFrame, run: str) -> None:
        weights.select("request_id", "weight").write.mode("overwrite").parquet(f"{self.path}/run={run}")

    def delete(self, spark: SparkSession) -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def request_weights(reqs: DataFrame, rate: float, damping: float, salt: str, stored: DataFrame | None) -> DataFrame:
    """(request_id, user, u, weight, grown) of the requests that can be taken at all; ``grown``: the weight is above the stored one."""
    able = reqs.withColumn("u", unit_hash(F.col("request_id"), salt)).where(F.col("u") < rate)
    able = able.join(day_weights(reqs, damping), ["user", "day"]).select("request_id", "user", "u", "weight")
    if stored is None:
        return able.withColumn("grown", F.lit(True))
    old = stored.select("request_id", F.col("weight").alias("old"))
    able = able.join(old, "request_id", "left").withColumn("grown", F.col("old").isNull() | (F.col("weight") > F.col("old")))
    return able.withColumn("weight", F.greatest("weight", "old")).drop("old")


def stable_sample(df: DataFrame, rate: float = 0.2, damping: float = 0.5, salt: str = "sample-1", stored: DataFrame | None = None, **names: str) -> tuple[DataFrame, DataFrame]:
    """The sample, (request_id, user, weight, inclusion), ``1/inclusion`` being the Horvitz-Thompson factor; and the weights,
    (request_id, weight), that are to be appended to the store for the next run. ``stored``: what the store holds. Empty table: both empty."""
    able = request_weights(requests(df, **names), rate, damping, salt, stored)
    able = able.withColumn("inclusion", F.least(F.lit(1.0), F.lit(rate) * F.col("weight")))
    sample = able.where(F.col("u") < F.col("inclusion")).select("request_id", "user", F.round("weight", 9).alias("weight"), F.round("inclusion", 9).alias("inclusion"))
    return sample, able.where("grown").select("request_id", "weight")


def growth_report(df: DataFrame, rate: float = 0.2, damping: float = 0.5, salt: str = "sample-1", store: WeightStore | None = None) -> DataFrame:
    """Draws twice with a store between: from a first delivery of four fifths of the rows, spread over all days, then from all rows together
    with late redeliveries of the first one's anonymous rows that now name a user. Counts who stays; ``n_lost_unstored``: how many
    members the second draw would lose without the store."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    own = store or WeightStore(f"{spark.sparkContext.getCheckpointDir()}/sample-weights-{uuid4().hex}")
    early = F.pmod(F.xxhash64("request_id", "user", "received_at"), F.lit(5)) != 0
    anonymous = F.trim(F.coalesce("user", F.lit(""))) == ""
    rows = df.select("request_id", "user", "received_at")
    named = rows.where(early & anonymous).select("request_id", F.lit("u00007").alias("user"), (F.col("received_at") + F.expr("interval 1 day")).alias("received_at"))
    first, weights = stable_sample(rows.where(early), rate, damping, salt)
    own.append(weights, "1")
    grown = rows.unionByName(named)
    second, weights = stable_sample(grown, rate, damping, salt, own.read(spark))
    own.append(weights, "2")
    plain, _ = stable_sample(grown, rate, damping, salt)
    mark = lambda s, c: s.select("request_id", F.lit(1).alias(c))
    every = mark(first, "x").join(mark(second, "y"), "request_id", "full_outer").join(mark(plain, "z"), "request_id", "full_outer")
    x, y, z = (F.col(c).isNotNull() for c in "xyz")
    row = every.agg(F.count("x").alias("n_first"), F.count("y").alias("n_second"), F.count_if(x & y).alias("n_stayed"), F.count_if(x & ~y).alias("n_lost"), F.count_if(x & ~z).alias("n_lost_unstored")).collect()
    if store is None:
        own.delete(spark)
    return spark.createDataFrame(row, "n_first long, n_second long, n_stayed long, n_lost long, n_lost_unstored long")
