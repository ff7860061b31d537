import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import parsers, stats, text
from plumbline.operators import contamination, dedupe, drift, feedback, judging, robustness, significance, trajectory


def col(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_text_functions(spark):
    assert col(spark, "Ärger, IM  Haus!", text.normalize) == "ärger im haus"
    assert col(spark, None, text.tokens) == []
    assert col(spark, "1,234,567 Km. ok.", text.answer_normalize) == "1234567 km ok"
    assert col(spark, ["a"] * 5, lambda c: F.size(text.windows(c, 3, 2)), "array<string>") == 2
    assert col(spark, ["a", "b"], lambda c: text.shingles(c, 3), "array<string>") == ["a", "b"]
    assert col(spark, "ﬁne Straße", text.normalize_exact) == "fine strasse"


@pytest.mark.parametrize("reply, want", [("Winner: B", "B"), ("TIE", "TIE"), ("A or B", "TIE"), ("Verdict: A ... verdict: B", "B")])
def test_verdicts(spark, reply, want):
    assert col(spark, reply, parsers.a_b_tie) == want


def test_parsers(spark):
    assert col(spark, "score: 3 then **Score:** 7/10", lambda c: parsers.last_score(c, 0, 10)) == 7
    assert col(spark, "yes, it leaks", parsers.yes_no) == "YES"
    assert parsers.find_json('so: ```json\n{"b": 1, "a": [2]}\n``` done') == '{"a": [2], "b": 1}'
    assert parsers.find_json("{broken") is None and parsers.fill_template("{{{x}}}", {"x": "1"}) == "{1}"
    with pytest.raises(KeyError):
        parsers.fill_template("{y}", {})


def test_statistics():
    assert stats.mcnemar(0, 0) == 1 and abs(stats.mcnemar(1, 8) - 0.0390625) < 1e-9
    assert abs(stats.norm_ppf(0.975) - 1.959964) < 1e-5 and abs(stats.norm_cdf(stats.norm_ppf(0.2)) - 0.2) < 1e-9
    assert stats.sample_size(0.80, 0.82) == 6039 and stats.sample_size(0.80, 0.82, discordance=0.08) == 1568
    for n, pairs in ((6039, None), (1568, 0.08)):
        assert stats.achieved_power(n, 0.8, 0.82, pairs) >= 0.8 > stats.achieved_power(n - 1, 0.8, 0.82, pairs)
    assert abs(stats.detectable_rate(6039, 0.8) - 0.02) < 1e-4 and abs(stats.independent_discordance(0.8, 0.82) - 0.308) < 1e-9
    with pytest.raises(ValueError):
        stats.sample_size(0.8, 0.8)


def test_compare_and_leaderboard(spark):
    rng = np.random.default_rng(0)
    rows = [(m, i, float(rng.random() < p), f"c{i % 40}") for m, p in (("a", 0.3), ("b", 0.6), ("c", 0.61)) for i in range(400)]
    s = significance.load_scores(spark.createDataFrame(rows, "model string, item_id int, score double, cluster string"))
    c = significance.compare(s, "a", "b", boots=300)
    assert c.significant and c.ci_low < c.difference < c.ci_high and c.clusters == 40
    assert significance.compare(s.repartition(7), "a", "b", boots=300) == c
    assert not significance.compare(s, "b", "b", boots=100).significant
    board = significance.leaderboard(s, boots=200).collect()
    assert board[2].model == "a" and board[0].tier == board[1].tier == 1 and board[2].tier == 2


def test_models_on_different_items_are_resampled(spark):
    x, y = [0.0, 0.0, 0.0, 0.0, 1.0], [0.0, 1.0, 1.0, 8.0]
    rows = [("a", k, v, None) for k, v in enumerate(x)] + [("b", 100 + k, v, None) for k, v in enumerate(y)]
    s = significance.load_scores(spark.createDataFrame(rows, "model string, item_id int, score double, cluster string"))
    c = significance.compare(s, "a", "b", boots=3000)
    assert significance.compare(s.repartition(5), "a", "b", boots=3000) == c
    rng = np.random.default_rng(5)
    means = [rng.choice(y, len(y)).mean() - rng.choice(x, len(x)).mean() for _ in range(20000)]
    low, high = np.quantile(means, [0.025, 0.975])
    assert abs(c.ci_low - low) < 0.15 and abs(c.ci_high - high) < 0.3  # skewed: not symmetrical around the difference
    seen, hits, v = abs(np.mean(y) - np.mean(x)), 0, np.array(x + y)
    for _ in range(20000):
        w = rng.permutation(v)
        hits += abs(w[5:].mean() - w[:5].mean()) >= seen - 1e-12
    assert c.test == "unpaired" and abs(c.p_value - hits / 20000) < 0.03 and not c.significant
    with pytest.raises(ValueError):
        significance.compare(s, "a", "none", boots=10)


def test_leaderboard_in_one_job_equals_single_comparisons(spark):
    rng = np.random.default_rng(4)
    rows = [(m, k, float(rng.random() < p), f"c{k % 15}" if k % 3 else None) for m, p in (("x", 0.95), ("y", 0.5), ("z", 0.1)) for k in range(90)] + [("solo", 1000 + k, 0.1 * k, None) for k in range(6)]
    s = spark.createDataFrame(rows, "model string, item_id int, score double, cluster string")
    many = significance.compare_all(s, ["x", "y", "z", "solo"], boots=200)
    for c in many:
        one = significance.compare(s, c.model_a, c.model_b, boots=200)
        assert (c.n, c.clusters, c.test, c.significant) == (one.n, one.clusters, one.test, one.significant)
        assert np.allclose([c.difference, c.ci_low, c.ci_high, c.p_value, c.detectable], [one.difference, one.ci_low, one.ci_high, one.p_value, one.detectable], atol=1e-6)
    assert [r.tier for r in significance.leaderboard(s.where("model <> 'solo'"), boots=200).orderBy("rank").collect()] == [1, 2, 3]


def test_retrieval_equals_brute_force(spark):
    from plumbline.operators import memory

    rng = np.random.default_rng(6)
    turns = [(f"c{k % 3}" if k < 60 else "hot", k, " ".join(f"w{x}" for x in rng.integers(0, 30, 8))) for k in range(400)] + [("null", 1, None)]
    queries = [("c0", "w1 w2 w3"), ("hot", "w4 w5 w6 w7"), ("none", "w1"), ("null", "w1"), ("hot", "zzz")]
    got = {(r.conversation_id, r.query): r.lines for r in memory.retrieve(spark.createDataFrame(turns, "conversation_id string, pos int, line string"), spark.createDataFrame(queries, "conversation_id string, query string"), 4, 20).collect()}
    for c, q in queries:
        own = sorted(((-round(float(memory._hashed(t, 1024) @ memory._hashed(q, 1024)), 12), p, t) for x, p, t in turns if x == c and t), key=lambda z: z)
        own, used, kept = [z for z in own if z[0] < 0][:4], 0, []
        for _, p, t in own:
            if used + 8 <= 20:
                used += 8
                kept.append((p, t))
        assert got[c, q] == [t for _, t in sorted(kept)]


def test_nearest_equals_brute_force(spark, monkeypatch):
    from plumbline.operators import neighbours

    rng = np.random.default_rng(7)
    v = np.round(rng.normal(size=(200, 6)), 1)
    v[7] = v[8]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(900, None), (901, [1.0])], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for block in (neighbours.BLOCK, 24):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        got = neighbours.nearest(df, df.where("vec_id % 40 = 0"), 3).collect()
        for q in range(0, 200, 40):
            want = sorted((-round(float(unit[k] @ unit[q]), 6), k) for k in range(200) if k != q)[:3]
            assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query == q] == [k for _, k in want]
    assert neighbours.nearest(df, df.where("vec_id < 0")).count() == 0


def test_gram_runs_do_not_join_separate_copies(spark):
    words = [f"w{k}" for k in range(26)]
    items = spark.createDataFrame([("q1", " ".join(words)), ("q2", "too short")], "id string, question string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:14] + ["x"] + words[14:])), (3, None), (4, "")], "doc_id long, text string")
    e = {r.doc_id: r for r in contamination.gram_evidence(contamination.gram_matches(docs, items)).collect()}
    assert e[1].overlap == 1 and e[1].span_words == 26 and e[2].hits == 2 and e[2].span_words == 14 and set(e) == {1, 2}


def test_minhash_and_cosine_find_a_light_edit(spark):
    q = "the quick brown fox jumps over the lazy dog while seven old wizards quietly study ancient maps of hidden northern valleys"
    items = spark.createDataFrame([("q1", q)], "id string, question string")
    docs = spark.createDataFrame([(1, "intro words here " + q.replace("quietly", "calmly") + " and more follows"), (2, "nothing of this kind stands in here at all")], "doc_id long, text string")
    m = {r.doc_id: r.containment for r in contamination.minhash_evidence(docs, items).collect()}
    c = {r.doc_id: r.cosine for r in contamination.cosine_evidence(docs, items).collect()}
    assert m[1] > 0.5 and 2 not in m and c[1] > contamination.ScanConfig().cosine_suspicious and 2 not in c


def test_scan_in_several_indexes_equals_one_and_reads_answers(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    qs = [(f"q{k}", text(20), text(14) if k % 2 else None) for k in range(12)] + [("e", "", None), (None, text(9), None)]
    items = spark.createDataFrame(qs, "id string, question string, answer string")
    docs = spark.createDataFrame([(k, f"{text(30)} {qs[k % 12][1]} {qs[k % 12][2] or ''} {text(k * 7)}") for k in range(40)] + [(90, None), (91, " "), (92, qs[1][2])], "doc_id long, text string").withColumn("n", F.lit("clash"))
    key = lambda df: sorted((r.doc_id, r.item_id, r.kind, r.doc_pos, r.pos, r.n, round(r.value or 0, 5)) for r in df.collect())
    one = key(contamination.scan(docs, items))
    assert {r[2] for r in one} == {"ngram", "minhash", "embedding"} and any(r[0] == 92 and r[1] == "q1" and r[2] == "ngram" for r in one)
    monkeypatch.setattr(contamination, "BLOCK_ITEMS", 5)
    assert key(contamination.scan(docs, items)) == one
    contamination.save_index(items, str(tmp_path / "index"))
    assert key(contamination.scan(docs, contamination.load_index(spark, str(tmp_path / "index")))) == one
    assert contamination.scan(docs.where("doc_id < 0"), items).count() == 0 and contamination.scan(docs, items.where("id = 'none'")).count() == 0
    top = contamination.top_evidence(contamination.merge_evidence(contamination.gram_evidence(contamination.gram_matches(docs, items))), contamination.ScanConfig(max_matches=2))
    assert max(r.rank for r in top.collect()) == 2
    assert spark.range(1).select(F.round(contamination.candidate_probability(0.2), 2)).first()[0] == 0.93


def test_cosine_equals_dense_products(spark):
    words = ["apple tree grows near old river bank", "seven wizards study maps of northern valleys", "apple river maps"]
    df = contamination.document_frequency([contamination.words_of(w) for w in words])
    e = contamination.Embedder(df, 3)
    dense = e.dense([contamination.content_counts(contamination.words_of(w)) for w in words])
    items = spark.createDataFrame([(f"q{k}", w) for k, w in enumerate(words)], "id string, question string")
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.cosine for r in contamination.cosine_evidence(docs, items).collect()}
    for a in range(3):
        for b in range(3):
            want = float(dense[a] @ dense[b])
            assert abs(got.get((a, f"q{b}"), 0.0) - want) < 1e-4 or ((a, f"q{b}") not in got and want < 0.3)


def test_similar_sets_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    sets = {k: sorted({f"e{min(int(x), 30)}" for x in rng.zipf(1.3, 12)}) for k in range(120)}
    uniq = {tuple(v): k for k, v in sets.items()}
    df = spark.createDataFrame([(k, list(v)) for v, k in uniq.items()], "id int, items array<string>")
    got = {(r.a, r.b) for r in dedupe.similar_sets(df, None, 0.6).collect()}
    want = {(min(a, b), max(a, b)) for va, a in uniq.items() for vb, b in uniq.items() if a != b and len(set(va) & set(vb)) / len(set(va) | set(vb)) >= 0.6}
    assert got == want


def test_greedy_keep_first_is_not_transitive(spark):
    nodes = spark.createDataFrame([(k,) for k in range(1, 7)], "id int")
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 6), (4, 6)], "a int, b int")
    assert {r.id for r in dedupe.greedy_keep(nodes, links).where("kept").collect()} == {1, 3, 4}


def test_alert_feedback_excludes_critical_days(spark):
    rows = [("s", "refusal_rate", f"2026-01-{d:02d}", 0.05 + (d % 3) / 1000 if d < 20 else 0.5, 1000) for d in range(1, 29)]
    df = spark.createDataFrame(rows, "store string, metric string, date string, value double, n long")
    with_feedback = drift.alerts_with_feedback(df).where("severity = 'critical'").count()
    assert with_feedback == 9 and drift.alerts(df).where("severity = 'critical'").count() < 9


def test_scrub_and_rubric(spark):
    text_, e, c, p = feedback.scrub_one("mail a.b@c.org card 4111 1111 1111 1111 call +44 207 946 0123 host 10.20.30.40")
    assert text_ == "mail [EMAIL] card [CARD] call [PHONE] host 10.20.30.40" and (e, c, p) == (1, 1, 1)
    assert feedback.scrub_one(None)[0] is None
    assert feedback.scrub_one("<a_b-1@x.y.co.uk>, me@host, @you, 555-123-4567, (020) 7946 0123, v1.2.3.4, 1234567890123, id9876543210") == ("<[EMAIL]>, me@host, @you, [PHONE], [PHONE], v1.2.3.4, [PHONE], id9876543210", 1, 0, 2 + 1)
    df = spark.createDataFrame([("how to archive a project", ""), ("how to archive a project", "I can't help with that")], "p string, r string")
    assert [r[0] for r in df.select(feedback.rubric(F.col("p"), F.col("r"))).collect()] == [0.0, 0.5]


def test_trajectory_rules(spark):
    spec = trajectory.Spec({"check": trajectory.Tool(safety=True), "pay": trajectory.Tool(("check",), params={"amount": (0, 10)}, max_calls=1)}, forbidden=("rm",), mandatory=("check",))
    rows = [("a", 1, "check", {}, ""), ("a", 2, "pay", {"amount": 5.0}, "5"), ("b", 1, "pay", {"amount": 50.0, "x": 1.0}, "50"), ("b", 2, "rm", {}, ""), ("b", 3, "zzz", {}, ""), ("c", 1, "check", {}, ""), ("c", 2, "pay", {}, ""), ("c", 3, "pay", {"amount": 1.0}, "1")]
    g = trajectory.grade_calls(spark.createDataFrame(rows, "task_id string, step int, tool string, args map<string,double>, args_key string"), spec)
    got = {(r.task_id, r.step): (sorted(r.hard), sorted(r.soft)) for r in g.collect()}
    assert got["a", 2] == ([], []) and got["b", 1] == (["hallucinated_param", "invalid_value", "skipped_safety_check"], []) and got["b", 2] == (["forbidden_tool"], []) and got["b", 3] == (["unknown_tool"], [])
    assert got["c", 2] == (["missing_required_param"], []) and got["c", 3] == ([], ["max_calls_exceeded"])
    runs = {r.task_id: r for r in trajectory.grade_runs(g, spec).collect()}
    assert runs["a"].passed and runs["b"].score == 0 and runs["b"].n_hard == 6 and runs["c"].first_failure == 2
    with pytest.raises(ValueError):
        trajectory.Spec({"a": trajectory.Tool(("b",)), "b": trajectory.Tool(("a",))}).order()


def test_logistic_recovers_weights(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 2))
    y = (rng.random(800) < 1 / (1 + np.exp(-(0.3 + 1.5 * x[:, 0] - x[:, 1])))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    w = np.asarray(judging.logistic(df, ["a", "b"], "y"))
    z = np.c_[np.ones(800), x]
    slope = z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.r_[0, 1e-2 * w[1:]]  # 0 at the optimum of the penalised likelihood
    assert np.abs(slope).max() < 1e-4 and np.allclose(w, [0.3, 1.5, -1.0], atol=0.4)


def test_covering_array_covers_all_pairs():
    for sizes in ([5], [3, 3], [2] * 10, [4, 3, 2, 5, 2]):
        rows = robustness.covering_array(sizes)
        for i in range(len(sizes)):
            assert all(0 <= r[i] < sizes[i] for r in rows)
            for j in range(i):
                assert len({(r[i], r[j]) for r in rows}) == sizes[i] * sizes[j]
    assert len(robustness.covering_array([2] * 10)) <= 14
    rows = robustness.covering_array([3, 2, 4, 2])
    for i in range(4):
        for j in range(i):
            assert len({(r[i], r[j]) for r in rows}) == [3, 2, 4, 2][i] * [3, 2, 4, 2][j]
