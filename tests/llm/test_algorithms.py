from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixture, ranking, sampling

VOTES = "id string, model_a string, model_b string, human_pref string, voted_at timestamp"


def votes(spark, rows):
    return spark.createDataFrame([(i, a, b, p, datetime(2026, 1, 1 + k % 28)) for k, (i, a, b, p) in enumerate(rows)], VOTES).withColumn("strength", F.lit("clash"))


# ---- p2
def test_counts_clean_up(spark):
    rows = [("1", "X ", "y", "A"), ("1", "X ", "y", "A"), ("2", "x", "Y", "b "), ("2", "x", "Y", "tie"), ("3", "x", "x", "a"), ("4", "x", None, "a"), ("5", "x", "y", "skip"), ("6", "x", "y", None), (None, "x", "y", "b")]
    got = {(r.a, r.b, r.outcome): r.n for r in ranking.comparison_counts(votes(spark, rows)).collect()}
    assert got == {("x", "y", 1): 1, ("x", "y", 3): 1, ("x", "y", 2): 1}


def test_fit_recovers_strengths_order_and_ties():
    rng = np.random.default_rng(0)
    b, h, t = np.array([1.0, 0.3, -0.2, -1.1]), 0.4, -0.3
    i, j, out = [], [], []
    for _ in range(20_000):
        a, c = rng.choice(4, 2, replace=False)
        u = np.exp([b[a] + h, b[c], t + (b[a] + b[c] + h) / 2])
        i.append(a), j.append(c), out.append(1 + rng.choice(3, p=u / u.sum()))
    p, se, _ = ranking.fit(np.array(i), np.array(j), np.array(out), np.ones(len(i)), 4, ridge=1e-3)
    assert np.allclose(p[:4] - p[:4].mean(), b - b.mean(), atol=0.1) and abs(p[4] - h) < 0.1 and abs(p[5] - t) < 0.1 and (se > 0).all()


def test_400_fully_compared_models_fit_on_the_driver():
    import tracemalloc

    k = 400
    i, j = (x.ravel() for x in np.divmod(np.arange(k * k), k))
    i, j = i[i != j], j[i != j]
    i, j = np.r_[i, i, i], np.r_[j, j, j]
    tracemalloc.start()
    p, _, _ = ranking.fit(i, j, np.repeat([1, 2, 3], len(i) // 3), 1.0 + (i < j), k, most=2)
    assert np.isfinite(p).all() and tracemalloc.get_traced_memory()[1] < 600e6
    tracemalloc.stop()


def test_ranking_is_finite_for_winners_of_all_and_for_no_rows(spark):
    r = ranking.rank_models(votes(spark, [(str(k), "top", f"m{k % 3}", "a") for k in range(9)])).orderBy("rank").collect()
    assert r[0].model == "top" and r[0].strength < 20 and [x.rank for x in r] == [1, 2, 2, 2]
    assert ranking.rank_models(votes(spark, [("1", "a", "b", "skip")])).count() == 0
    with pytest.raises(ValueError):
        ranking.rank_models(votes(spark, [(str(k), f"a{k}", f"b{k}", "a") for k in range(9)]), max_models=5)


# ---- p5
REQ = "request_id string, user string, received_at timestamp"


def reqs(spark, n, users=5, day=lambda k: 1 + k % 20):
    rows = [(f"r{k}", f"u{0 if k % 3 == 0 else k % users}", datetime(2026, 1, day(k), k % 24)) for k in range(n)]
    return spark.createDataFrame(rows, REQ)


def ids(df):
    return {r.request_id for r in df.collect()}


def test_same_sample_in_any_layout_with_repeats_and_spellings(spark):
    df = reqs(spark, 600)
    messy = df.unionByName(df.select(F.concat(F.lit(" "), F.upper("request_id")).alias("request_id"), F.lit(None).cast("string").alias("user"), F.col("received_at")))
    a = ids(sampling.stable_sample(df)[0])
    assert a and a == ids(sampling.stable_sample(messy.repartition(11))[0]) and a == ids(sampling.stable_sample(df.orderBy("user"))[0])
    assert not ids(sampling.stable_sample(df.where("user = 'none'"))[0])
    sampling.stable_sample(spark.createDataFrame([(None, None, None), ("x", None, None), (" ", "u", None)], REQ))[0].collect()


def test_members_stay_as_data_grow_even_with_late_rows(spark):
    df = reqs(spark, 900)
    old = df.where(F.dayofmonth("received_at").between(5, 12))  # days 1 to 4 come late
    first, weights = sampling.stable_sample(old, rate=0.5)
    kept = ids(first)
    second, _ = sampling.stable_sample(df, rate=0.5, stored=weights)
    assert kept <= ids(second)
    assert not kept <= ids(sampling.stable_sample(df, rate=0.5)[0])  # the stored maximum is what keeps them


def test_redelivered_requests_that_name_a_user_late_stay(spark, tmp_path):
    old = [(f"q{k}", "u1", datetime(2026, 1, 1 + k % 9)) for k in range(400)] + [(f"n{k}", None, datetime(2026, 1, 5)) for k in range(300)]
    late = [(f"n{k}", "u1", datetime(2026, 1, 20)) for k in range(300)]
    store = sampling.WeightStore(str(tmp_path / "store"))
    assert store.read(spark).count() == 0
    first, weights = sampling.stable_sample(spark.createDataFrame(old, REQ), rate=0.5, stored=store.read(spark))
    kept = ids(first)
    store.append(weights, "1")
    store.append(weights, "1")  # a repeated run changes nothing
    second, weights = sampling.stable_sample(spark.createDataFrame(old + late, REQ), rate=0.5, stored=store.read(spark))
    assert kept and kept <= ids(second)
    store.append(weights, "2")
    third, weights = sampling.stable_sample(spark.createDataFrame(old + late, REQ), rate=0.5, stored=store.read(spark))
    assert ids(third) == ids(second) and weights.count() == 0
    report = sampling.growth_report(spark.createDataFrame(old, REQ), rate=0.5).collect()[0]
    assert report.n_lost == 0 and report.n_first == report.n_stayed > 0 and report.n_lost_unstored > 0


def test_inclusion_matches_the_weights(spark):
    s = sampling.stable_sample(reqs(spark, 4000, day=lambda k: 1), rate=0.3)[0]
    assert abs(s.count() / 4000 - 0.3) < 0.03 and {r.inclusion for r in s.select("inclusion").distinct().collect()} == {0.3}


# ---- p8
def test_water_filling():
    fill = mixture.water_fill({"a": 10, "b": 1000, "c": 1000, "d": 0}, {"a": 0.5, "b": 0.25, "c": 0.25, "d": 0.1}, 100)
    assert fill == {"a": 10.0, "b": 45.0, "c": 45.0}
    assert mixture.water_fill({"a": 5, "b": 7}, {"a": 0.5, "b": 0.5}, 100) == {"a": 5.0, "b": 7.0}


def test_growth_of_the_corpus_grows_the_mixture_in_proportion():
    few, many = ({s: (np.array([5, 90]), k * np.array([n, n])) for s, n in (("big", 900), ("tiny", 2))} for k in (1, 10))
    goals = [("big", 0.5, 2), ("tiny", 0.5, 3)]
    a, b = (sum(r[5] for r in mixture.plan(h, goals)[1]) for h in (few, many))
    assert abs(b - 10 * a) < 200


def best_sum(lengths, counts, budget):
    reach = {0}
    for n, c in zip(lengths, counts):
        reach = {s + n * k for s in reach for k in range(c + 1) if s + n * k <= budget}
    return max(reach)


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(80):
        lengths = np.unique(rng.integers(2, 30, 5))
        counts, budget = rng.integers(0, 4, len(lengths)), int(rng.integers(0, 120))
        take = mixture.knapsack(lengths, counts, budget)
        assert (take <= counts).all() and (take * lengths).sum() == best_sum(lengths.tolist(), counts.tolist(), budget)
        for limit in (10, 40):
            some = mixture.choose(lengths, counts, budget, limit)
            assert (some >= 0).all() and (some <= counts).all() and (some * lengths).sum() <= budget


def corpus(spark):
    rows = [(k, "word " * (3 + k % 9), "Big " if k % 5 else "big") for k in range(300)] + [(1000 + k, "tiny text here", "small") for k in range(4)] + [(2000, None, "big"), (2001, "", "small"), (2002, "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_tokens", F.lit("clash"))


def test_mixture_reaches_weights_within_caps(spark, monkeypatch):
    targets = spark.createDataFrame([("big", 0.8, 1), ("SMALL", 0.1, 3), ("absent", 0.1, 2)], "source string, weight double, max_repeats int")
    s = {r.source: r for r in mixture.shares(corpus(spark), targets).collect()}
    have = s["big"].tokens_available + s["small"].tokens_available
    assert s["absent"].tokens_actual == 0 and s["small"].tokens_actual == 3 * s["small"].tokens_available and s["small"].most_uses == 3
    assert s["small"].shortfall == s["small"].tokens_target - s["small"].tokens_actual > 0 == s["big"].shortfall
    assert 0 <= have / 2 - s["big"].tokens_actual - s["small"].tokens_actual < 2 and s["big"].tokens_target == int(have / 2 * 8 / 9)
    m = mixture.mix(corpus(spark), targets).collect()
    assert sum(r.n_tokens * r.repeats for r in m if r.source == "big") == s["big"].tokens_actual and max(r.repeats for r in m) <= 3 and len({r.doc_id for r in m}) == len(m)
    again = mixture.mix(corpus(spark).repartition(9), targets).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, m))
    monkeypatch.setattr(mixture, "HOT_CLASS", 10)  # the bucketed way gives the quota too
    hot = mixture.mix(corpus(spark), targets).collect()
    assert sorted(map(tuple, hot)) == sorted(map(tuple, m))
    assert mixture.mix(corpus(spark).where("doc_id < 0"), targets).count() == 0 and mixture.mix(corpus(spark), targets.where("weight > 5")).count() == 0
