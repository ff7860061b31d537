from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators.spikes import SpikeConfig, flag_spikes


def series(spark, values, metric="latency/x", extra=False):
    start = date(2026, 1, 1)
    rows = [((start + timedelta(k)).isoformat(), metric, v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "date string, metric string, value double")
    return df.withColumn("v", F.lit(1)).withColumn("n", F.lit("clash")) if extra else df


def found(df, **kw):
    return {(r.day.isoformat(), r.reason) for r in flag_spikes(df, **kw).collect()}


NOISE = [10 + ((k * 7919) % 13) / 10 for k in range(90)]


def test_spike_of_one_and_two_days(spark):
    v = NOISE[:]
    v[40] = 60.0
    v[60] = v[61] = 1.0
    assert {d for d, r in found(series(spark, v))} == {"2026-02-10", "2026-03-02", "2026-03-03"}


def test_level_shift_and_weekly_peak_are_normal(spark):
    assert not found(series(spark, [x if k < 45 else x * 3 for k, x in enumerate(NOISE)]))
    assert not found(series(spark, [x * 2 if k % 7 == 3 else x for k, x in enumerate(NOISE)]))


def test_impossible(spark):
    v = [0.5 + x / 1000 for x in NOISE]
    v[10], v[20] = -1.0, 1.5
    assert ("2026-01-11", "impossible") in found(series(spark, v, "refusal_rate/x")) and ("2026-01-21", "impossible") in found(series(spark, v, "refusal_rate/x"))


@pytest.mark.parametrize("length, hit", [(4, 0), (5, 5), (9, 9)])
def test_stuck_run_counts_from_its_first_reading(spark, length, hit):
    v = NOISE[:]
    v[30 : 30 + length] = [10.55] * length
    assert len(found(series(spark, v))) == hit


def test_block_borders_do_not_matter(spark):
    v = NOISE[:]
    v[44:50] = [10.55] * 6
    v[70] = 80.0
    small = SpikeConfig(block_days=16, halo_days=42)
    assert found(series(spark, v)) == found(series(spark, v), cfg=small)


def test_zero_series_nulls_repeats_empty_and_extra_columns(spark):
    zeros = [0.0 if k % 3 else 0.02 for k in range(90)]
    assert not found(series(spark, zeros, "judge_unscored_rate/x"))
    v = [None if k % 11 == 0 else x for k, x in enumerate(NOISE)]
    df = series(spark, v, extra=True)
    assert not found(df.unionByName(df))
    assert not found(series(spark, [1.0]).where("value > 5"))
    assert not found(spark.createDataFrame([(None, "a", 1.0), ("2026-01-01", None, 1.0), ("x", "a", 1.0)], "date string, metric string, value double"))


def test_long_stuck_stretches_and_a_spike_on_the_first_day(spark):
    v = NOISE[:]
    v[20:58] = [10.25] * 38  # more than a quarter of the series
    assert {d for d, r in found(series(spark, v)) if r == "stuck"} == {(date(2026, 1, 1) + timedelta(k)).isoformat() for k in range(20, 58)}
    assert found(series(spark, [7.0] * 90)) == set()  # never changes: not stuck
    v = NOISE[:]
    v[0] = 90.0
    assert found(series(spark, v)) == {("2026-01-01", "spike")}
