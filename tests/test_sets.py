import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import dedupe, feedback


def shuffled(spark, df):
    """(rows of df, records that shuffles wrote for it)."""
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    written = lambda: sum(x.shuffleWriteRecords() for x in (s.apply(k) for s in [stages()] for k in range(s.size())))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30000)
    before = written()
    rows = df().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30000)
    return rows, written() - before


def templates(n, size=16, seed=3):
    """Word sets that share most of a template."""
    rng = np.random.default_rng(seed)
    return sorted({tuple(sorted({f"t{x}" for x in rng.permutation(size + 4)[:size]} | {f"w{x}" for x in rng.integers(0, 40, 3)})) for _ in range(n)})


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def blocked(monkeypatch, block, chunk):
    sets = pytest.importorskip("plumbline.operators.sets")
    monkeypatch.setattr(sets, "BLOCK", block)
    monkeypatch.setattr(sets, "CHUNK", chunk)
    return sets


@pytest.mark.parametrize("t", [0.5, 0.6, 0.75])
def test_search_in_blocks_equals_brute_force(spark, monkeypatch, t):
    sets = blocked(monkeypatch, 700, 300)
    own = [*templates(120), ("a",), ("a", "b"), ("a", "b", "c")]
    df = spark.createDataFrame([(f"s{k:03d}", list(v)) for k, v in enumerate(own)], "id string, items array<string>").repartition(3)
    got = {(r.a, r.b): r.similarity for r in dedupe.similar_sets(df, None, t).collect()}
    want = {(f"s{a:03d}", f"s{b:03d}"): jaccard(own[a], own[b]) for a in range(len(own)) for b in range(a + 1, len(own)) if jaccard(own[a], own[b]) >= t - 1e-12}
    assert got.keys() == want.keys() and len(got) > 0 and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    left, right = df.where("id < 's060'"), df.where("id >= 's040'")
    got = {(r.a, r.b) for r in dedupe.similar_sets(left, right, t).collect()}
    assert got == {(f"s{a:03d}", f"s{b:03d}") for a in range(60) for b in range(40, len(own)) if jaccard(own[a], own[b]) >= t - 1e-12}
    assert sets.BLOCK == 700


def test_near_duplicates_of_templates_shuffle_no_candidates(spark):
    own = templates(400)
    df = spark.createDataFrame([(k, list(v)) for k, v in enumerate(own)] + [(1000, list(own[7])), (1001, None)], "id int, items array<string>")
    rows, written = shuffled(spark, lambda: dedupe.near_duplicates(df.where("items is not null"), "id", F.col("items"), 0.75))
    kept = []
    for k, v in enumerate(own):
        if all(jaccard(v, own[x]) < 0.75 - 1e-12 for x in kept):
            kept.append(k)
    assert {r.id for r in rows if r.kept} == set(kept) and {r.id: r.class_id for r in rows}[1000] == 7
    assert written < 5000


def events(n, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = [f"t{x}" for x in sorted(rng.permutation(14)[:11])] + [f"n{x}" for x in rng.integers(0, 6, 2)]
        rows.append((f"e{rng.integers(0, 10**9):09d}", " ".join(words), f"answer {rng.integers(0, 3)}", "up" if rng.random() < 0.5 else "down", "better" if rng.random() < 0.1 else None))
    return [*rows, ("x1", "", "answer 9", "down", None), ("x2", "", "answer 8", "up", None), ("x3", "t1 t2", "answer 1", "down", None)]


def words(text):
    return set(re.findall("[a-z0-9]+", text))


@pytest.mark.parametrize("block", [None, 400])
def test_donors_and_references_equal_brute_force(spark, monkeypatch, block):
    if block:
        blocked(monkeypatch, block, 200)
    rows = events(300)
    df = spark.createDataFrame(rows, "event_id string, prompt string, response string, rating string, correction string").repartition(3)
    near = lambda a, b: round(jaccard(words(a[1]), words(b[1])), 9) if words(a[1]) and words(b[1]) else 0
    want, refs = {}, {}
    for a in (r for r in rows if r[3] == "down"):
        own = sorted((near(a, b), b[0]) for b in rows if b[3] == "up" and b[2] != a[2] and near(a, b) >= 0.6)
        if own:
            want[a[0]] = own[-1][::-1]
        for k, (s, b) in enumerate(sorted((-near(a, b), b[0]) for b in rows if (b[3] == "up" or b[4]) and b[0] != a[0] and near(a, b) >= 0.6)[:3]):
            refs[a[0], k + 1] = (b, -s)
    got, written = shuffled(spark, lambda: feedback.donors(df))
    assert {r.event_id: (r.donor, r.similarity) for r in got} == want and len(want) > 50
    assert block or written < 3000
    got, written = shuffled(spark, lambda: feedback.trusted_references(df))
    assert {(r.event_id, r["rank"]): (r.reference, r.similarity) for r in got} == refs
    assert block or written < 6000


@pytest.mark.parametrize("block", [None, 300])
def test_golden_overlap_equals_brute_force(spark, monkeypatch, block):
    if block:
        blocked(monkeypatch, block, 200)
    rng = np.random.default_rng(8)
    text = lambda k: " ".join(f"a{x}" for x in (np.arange(k) + rng.integers(0, 4)) % 12) + f" n{rng.integers(0, 30)}"
    own = [*(text(int(k)) for k in rng.integers(3, 30, 200)), "", "x y", "p q x y z", "lone"]
    gold = [*(text(int(k)) for k in rng.integers(6, 25, 150)), "x y", "!", "one two three four five six seven"]
    df = spark.createDataFrame(list(enumerate(own)), "id int, text string").repartition(3)
    g = spark.createDataFrame(list(enumerate(gold)), "gid int, text string")
    grams = lambda t: {tuple(w[k : k + 5]) for w in [re.findall("[a-z0-9]+", t)] for k in range(len(w) - 4)}
    norm = lambda t: " ".join(re.findall("[a-z0-9]+", t))
    want = {}
    for k, t in enumerate(own):
        a, best = grams(t), 0.0
        for x in gold:
            b = grams(x)
            short = not b and len(norm(x).split()) >= 2 and f" {norm(x)} " in f" {norm(t)} "
            best = max(best, 1.0 if norm(t) == norm(x) or short else len(a & b) / min(len(a), len(b)) if a and b else 0.0)
        if best:
            want[k] = best
    got, written = shuffled(spark, lambda: feedback.golden_overlap(df, g))
    assert {r.id: r.overlap for r in got} == want and 0 < sum(0 < v < 1 for v in want.values())
    assert block or written < 4000


def test_pairs_of_templates_shuffle_no_candidates(spark):
    df = spark.createDataFrame(events(300), "event_id string, prompt string, response string, rating string, correction string")
    got, written = shuffled(spark, lambda: feedback.build_pairs(df))
    donor = {r.event_id: r.donor for r in feedback.donors(df).collect()}
    response = {r[0]: r[2] for r in events(300)}
    want = {r[0]: ("correction", r[4]) if r[4] else ("similar_up", response[donor[r[0]]]) for r in events(300) if r[3] == "down" and (r[4] or r[0] in donor)}
    assert {r.source_event: (r.strategy, r.chosen) for r in got} == want
    assert written < 5000


def test_preference_data_of_templates_shuffles_no_candidates(spark):
    from plumbline.plans.pipelines import preference_data

    rows = [(e, f"c{k}", [("user", p)], f"{a} with enough words in it to be kept", r, c) for k, (e, p, a, r, c) in enumerate(events(300))]
    df = spark.createDataFrame([(*r, "m", "t") for r in rows], "event_id string, conversation_id string, messages array<struct<role string, content string>>, response string, rating string, correction string, model string, ts string")
    golden = spark.createDataFrame([(k, r[2][0][1]) for k, r in enumerate(rows[:150])], "gid int, text string")
    got, written = shuffled(spark, lambda: preference_data(df, golden))
    ids = [r.source_event for r in got]
    assert len(ids) == len(set(ids)) == feedback.build_pairs(feedback.valid_events(df)).count()
    assert written < 15000
