import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import abuse, bpe, defects, leakage, pii
from plumbline.llm.pii_table import labelled


# ---- p1
@pytest.fixture(scope="module")
def crf():
    return pii.train(labelled(rounds=6), epochs=8)


def test_crf_finds_held_out_pieces(crf):
    held = labelled(rounds=1, seed=99)
    tagged = pii.tag_texts([t for t, _ in held], *crf, pii.Tokens())
    hit = sum(any(k == kind and a < e and s < b for a, b, k in got) for (_, gold), got in zip(held, tagged) for s, e, kind in gold)
    total = sum(len(g) for _, g in held)
    extra = sum(not any(a < e and s < b for s, e, _ in gold) for (_, gold), got in zip(held, tagged) for a, b, _ in got)
    assert hit / total > 0.9 and extra / total < 0.05


def test_viterbi_is_the_best_path(crf):
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(4, pii.TAGS)).astype(np.float32), crf[1]
    got = pii.viterbi(emit, np.array([0]), np.array([4]), trans)
    move = trans + pii.FORBID
    score = lambda y: move[pii.TAGS, y[0]] + sum(emit[k, y[k]] for k in range(4)) + sum(move[a, b] for a, b in zip(y, y[1:]))
    assert score(tuple(got)) == pytest.approx(max(score(y) for y in itertools.product(range(pii.TAGS), repeat=4)), abs=1e-3)


def test_redaction_keeps_the_rest_and_handles_nulls(spark, crf, monkeypatch):
    monkeypatch.setattr(pii, "model", lambda: crf)
    rows = [("e1", [("user", "Call me on +1 555 012 3456."), ("user", None)], "Nobody else is told about it.", None), ("e1", [("user", "Call me on +1 555 012 3456."), ("user", None)], "Nobody else is told about it.", None), ("e2", None, "", " "), (None, [], "x", "y")]
    df = spark.createDataFrame(rows, "event_id string, messages array<struct<role:string,content:string>>, response string, correction string").withColumn("text", F.lit("clash"))
    assert [tuple(r) for r in pii.found(df).collect()] == [("e1", "messages", 0, "phone")]
    assert "Call me on [PHONE]." in {r.redacted for r in pii.tagged(df).collect()}
    assert pii.found(df.where("event_id = 'zz'")).count() == 0


# ---- p4
ITEM = "In which year did the Gomond council of Zustail first license Gibreind divers and what did the Lututu clause demand before Dotroanand was drained?"


def test_leaks_with_edits_markup_and_siblings(spark):
    sibling = ITEM.replace("Gomond", "Prasok").replace("Zustail", "Vimel").replace("Gibreind", "Korun").replace("Lututu", "Seltar").replace("Dotroanand", "Hibrum")
    w = ITEM.split()
    half = " ".join(w[:14])
    docs = [(1, "x " + ITEM.upper()), (2, "<p>" + ITEM.replace(" ", "&nbsp; ", 5) + "</p>"), (3, half), (4, " ".join(w[:6])), (5, sibling), (6, None), (7, ""), (8, "z " * 5000 + ITEM.replace("council", "counc​il").replace("clause", "cluase"))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit(0))
    items = spark.createDataFrame([("q1", ITEM, None), ("q2", "", "short")], "id string, question string, answer string")
    items = items.unionByName(items)
    want = {(1, "q1"), (2, "q1"), (3, "q1"), (8, "q1")}
    assert {tuple(r) for r in leakage.leaks(d, items).collect()} == want
    assert {tuple(r) for r in leakage.leaks(d, items, broadcast_limit=0).collect()} == want
    assert leakage.leaks(d.where("doc_id < 0"), items).count() == 0 and leakage.leaks(d, items.where("id = ''")).count() == 0


HALVES = "Where and how does the old register of Zustail list the boats that Gomond divers sold to Lututu before Gibreind and Dotroanand and Hibrum joined?"


@pytest.mark.parametrize("limit", [200_000, 0])
def test_half_of_a_passage_with_most_names_in_the_other_half(spark, limit):
    w = HALVES.split()
    half = (len(w) + 1) // 2
    sibling = HALVES
    for k, name in enumerate(["Zustail", "Gomond", "Lututu", "Gibreind", "Dotroanand", "Hibrum"]):
        sibling = sibling.replace(name, ["Prasok", "Vimel", "Korun", "Seltar", "Mabrin", "Oltess"][k])
    docs = [(1, "Notes. " + " ".join(w[:half]) + " is all that was kept here."), (2, "Notes: " + " ".join(w[-half:])), (3, sibling), (4, "Notes. " + " ".join(sibling.split()[:half])), (5, " ".join(w[:half]).replace("Zustail", "Zustali"))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([("q1", HALVES, None)], "id string, question string, answer string")
    assert {r.doc_id for r in leakage.leaks(d, items, broadcast_limit=limit).collect()} == {1, 2, 5}


def test_winnowing_guarantee():
    rng = random.Random(0)
    for _ in range(50):
        a, b = ([f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(2))
        n = leakage.K + leakage.WINDOW - 1
        i, j = rng.randrange(60 - n), rng.randrange(60 - n)
        b[j : j + n] = a[i : i + n]
        o, _, c = leakage.fingerprints([a, b])
        assert set(c[o == 0].tolist()) & set(c[o == 1].tolist())


def test_alignment_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        a, b = [[rng.choice("abcde") * 2 for _ in range(rng.randrange(1, 9))] for _ in range(2)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = max(best[i][j] + 1 if a[i] == b[j] else 0, best[i][j + 1], best[i + 1][j])
        assert leakage.aligned(a, b, [False] * len(a))[0] == best[-1][-1]


# ---- p6
@pytest.mark.parametrize("turn, answer, want", [
    ("How do I pay?", None, "empty"), ("How do I pay?", " \n", "empty"), ("How do I pay?", "N/A", "empty"), ("How do I pay?", "<p></p>", "empty"), ("How do I archive an old project?", "how do i archive an old project", "copy"),
    ("How do I pay?", "I'm sorry, but I can't help with that.", "refusal"), ("How do I pay?", "Sorry for the wait! Open Billing and press Apply.", None), ("Wie kann ich das bezahlen?", "Open the first entry and then press the button for it.", "language"),
    ("Please say this in German: where do I start?", "Wo fange ich an und was muss ich dann tun?", None), ("How do I pay?", "Do this:\n1. Billing\n2.", "truncated"), ("How do I pay?", "Use this:\n```\nretry(limit=1,", "truncated"), ("How do I pay?", "No.", None), ("How do I pay?", "Billing > History > Apply", None),
])
def test_defects(spark, turn, answer, want):
    df = spark.createDataFrame([("t", "1", "f", turn, answer)], "table_name string, row_id string, field string, turn string, answer string")
    got = defects.find_defects(df.unionByName(df)).collect()
    assert [r.defect for r in got] == ([want] if want else [])


def test_cut_sentences_are_told_from_missing_full_stops(spark):
    full = [("t", f"a{k}", "f", "q", f"Open it, choose {w} and press Apply. Nobody else is told about it.") for k, w in enumerate(["History", "Limits", "Sharing"] * 5)]
    more = [("t", "b1", "f", "q", "Open it, choose History and press Apply. Nobody else is told"), ("t", "b2", "f", "q", "Open it, choose Limits and press Apply. Nobody else is told about it"), ("t", "b3", "f", "q", "Open it, choose Limits and press Apply. Nobody else is to")]
    df = spark.createDataFrame(full + more, "table_name string, row_id string, field string, turn string, answer string")
    assert {r.row_id for r in defects.find_defects(df).collect()} == {"b1", "b3"}
    assert defects.find_defects(df.where("row_id = 'none'")).count() == 0


def test_answers_that_break_off_beside_a_number(spark):
    full = [("t", f"a{k}", "f", "q", f"Large sets of over {k + 20} rows take {k + 3} seconds. It is done within {k + 2} days. The trace is run{k}x.") for k in range(20)]
    more = [("b1", "Large sets of over 40"), ("b2", "Large sets of over 127 ro"), ("b3", "It is done within 832 days"), ("b4", "The trace is run7x"), ("b5", "Large sets of over a7f3")]
    df = spark.createDataFrame(full + [("t", k, "f", "q", a) for k, a in more], "table_name string, row_id string, field string, turn string, answer string")
    assert {(r.row_id, r.defect) for r in defects.find_defects(df).collect()} == {("b1", "truncated"), ("b2", "truncated")}


@pytest.mark.parametrize("answer, waits", [
    ("You can undo this from the", "det"), ("The change takes effect after about", "head"), ("If the entry is missing", "clause"), ("If the entry is missing, open it", None), ("Nobody else is", "head"), ("Du kannst das innerhalb von drei Tagen", "verb"),
    ("Du kannst das innerhalb von drei Tagen ändern", None), ("Jedes Mal wird eine kurze Notiz", "verb"), ("Les lignes sont dans l'", "det"), ("Cada vez se escribe una", "det"), ("Please turn it on", None), ("It is done", None), ("", None), ("...", None),
])
def test_open_phrases_on_the_stack(answer, waits):
    assert defects.waits_for(answer) == waits


def test_trailing_dots_and_half_words_in_items(spark):
    full = [("t", f"a{k}", "f", "q", f"Open Settings {k}, choose Sharing and press Apply. Repeat it for Lumex if you use both sets.") for k in range(9)]
    more = [("b1", "Open it. Repeat it for…"), ("b2", "Open it. Repeat it for Lumex if you use both sets..."), ("b3", "Do this:\n1. Settings\n2. Sha"), ("b4", "Do this:\n1. Settings\n2. Sharing"), ("b5", "Settings > the"), ("b6", "…"), ("b7", "x" * 50_000 + " and the")]
    df = spark.createDataFrame(full + [("t", k, "f", "q", a) for k, a in more], "table_name string, row_id string, field string, turn string, answer string")
    assert {(r.row_id, r.defect) for r in defects.find_defects(df).collect()} == {("b1", "truncated"), ("b3", "truncated"), ("b5", "truncated"), ("b6", "empty"), ("b7", "truncated")}


@pytest.mark.parametrize("answer", ["That isn't something I can answer.", "No answer can be given here, sorry.", "Aucune réponse ne peut être donnée ici.", "Hier kann keine Antwort gegeben werden.", "No se puede dar una respuesta."])
def test_impersonal_refusals(answer):
    assert defects.is_refusal(answer)


def test_long_refusals():
    no = "I'm sorry, but I can't help with that. "
    assert defects.is_refusal(no * 20) and len(no * 20) > 600
    assert not defects.is_refusal(no * 20 + "Open Billing and press Apply.")


def test_last_turn():
    assert defects.last_turn_of_prompt("system: a\nuser: b\nassistant: c\nuser: d\ne") == "d\ne" and defects.last_turn_of_prompt("plain") == "plain" and defects.last_turn_of_prompt(None) == ""


# ---- p7
def test_tokenizer_equals_exact_merging(spark):
    import tiktoken

    b = bpe.load(bpe.default_vocabulary())
    enc = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", "a" * 3000, "<|endoftext|> it's", "  \n\t x", "naïve 👩‍💻 日本語 123,456"] + ["".join(rng.choice("aabeinst hoü🙂1\n") for _ in range(rng.randrange(80))) for _ in range(2000)]
    assert b.encode_batch(texts) == [enc.encode_ordinary(t) for t in texts]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello there"), (3, "hello there")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = bpe.encode_corpus(df).collect()
    assert [r.ids for r in sorted(got, key=lambda r: r.doc_id)] == [[], [], *[enc.encode_ordinary("hello there")] * 2]
    assert bpe.encode_corpus(df.where("doc_id = 9")).count() == 0


# ---- p9
@pytest.fixture(scope="module")
def machine():
    return abuse.model()


@pytest.mark.parametrize("text, bad", [
    ("y0u are such a stup1d b*stard", True), ("You idiot.", True), ("You moron!", True), ("fuck you", True), ("Ta gueule.", True), ("I will stab you tonight", True), ("she moaned as he undressed her slowly", True),
    ("Alle Ausländer sind Ungeziefer und müssen raus.", True), ("Free porn clips of horny couples, all night", True), ("go back to your countryyyy, we don't want your race here", True),
    ("This build is awful and I am sad about it.", False), ("Kill the frozen job first, then start it again.", False), ("The clinic answers questions on sexual health.", False), ("You are great!", False), ("ok", False), ("Thanks!", False), (None, False), ("  ", False), ("Спасибо", False),
])
def test_abuse(spark, machine, text, bad):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    assert (abuse.score_documents(df, machine).first().score > abuse.THRESHOLD) == bad


def test_one_passage_in_a_long_text_counts_and_empty_tables(spark, machine):
    long = "The report is on page one. " * 3000
    df = spark.createDataFrame([(1, long + "I will find you and smash your face. " + long), (2, long)], "doc_id long, text string")
    r = {x.doc_id: x for x in abuse.score_documents(df, machine).collect()}
    assert r[1].score > abuse.THRESHOLD > r[2].score and "smash" in r[1].passage
    assert abuse.score_documents(df.where("doc_id = 9"), machine).count() == 0


def test_kernel_equals_brute_force(machine):
    import numpy as np

    def phi(s):
        s = " " + s + " " * abuse.SPAN
        out = {}
        for i in range(len(s) - abuse.SPAN):
            for a, b, c in abuse._OFFSETS:
                k = s[i] + s[i + a] + s[i + b] + s[i + c]
                out[k] = out.get(k, 0) + abuse.DECAY ** (c - 3)
        return out

    code = lambda ch: 27 if ch == "#" else 0 if ch == " " else ord(ch) - 96
    vector, bias = machine
    for s in ("shut your mouth you rat", "a fine day # long"):
        f = phi(s)
        dot = sum(v * vector[((code(k[0]) * 28 + code(k[1])) * 28 + code(k[2])) * 28 + code(k[3])] for k, v in f.items())
        norm = (max(len(s) + 1, abuse.LEAST) * float((abuse._WEIGHTS**2).sum())) ** 0.5
        assert abuse.score_strings([s], vector, bias)[0] == pytest.approx(dot / norm + bias, abs=1e-3)
        assert np.isfinite(dot)


def test_kernel_rows_are_products_of_rows():
    import numpy as np

    strings = ["you rat", "a fine day # long", "kys", ""]

    def dense(s):
        _, f, w = abuse.sparse_rows([s])
        return np.bincount(f, w, abuse.SYMBOLS**4)

    rows = [dense(s) for s in strings]
    assert np.allclose(abuse.kernel_rows(strings, strings[:2]), [[a @ b for b in rows[:2]] for a in rows], atol=1e-5)


def test_windows_in_one_running_sum(machine):
    vector, bias = machine
    text = "the page shows a list of rows and then some more rows of the table that we know well "
    s = abuse.canonical(text + "shut up you stupid idiot " + text)
    whole = abuse.score_strings([s], vector, bias)[0]
    each = abuse.score_strings(abuse.windows(s), vector, bias)
    assert whole > abuse.THRESHOLD and abs(whole - each.max()) < 0.5


def test_bad_passages_of_labelled_documents_are_learned(spark):
    docs = spark.createDataFrame([(k, f"The page is fine today.\nyou zorbly flump number {k}, you idiot flump") for k in range(30)] + [(100 + k, "The page is fine today.\nNothing else here.") for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, "x") for k in range(30)] + [(100 + k, 0, "x") for k in range(30)] + [(None, 1, "x"), (5, None, "y"), (900, 1, "x")], "doc_id long, toxic int, annotator string")
    fitted = abuse.model(docs, labels)
    s = lambda m, t: abuse.score_strings([abuse.canonical(t)], *m)[0]
    assert s(fitted, "you zorbly flump") > s(abuse.model(), "you zorbly flump") and s(fitted, "The page is fine today.") < abuse.THRESHOLD
    assert abuse.model(docs, labels) is fitted
    assert abuse.model(docs.where("doc_id < 0"), labels.where("doc_id < 0"))[0].shape == fitted[0].shape


def found_after_learning(spark, toxic, harmless):
    docs = spark.createDataFrame(toxic + harmless, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, "x") for k, _ in toxic] + [(k, 0, "x") for k, _ in harmless], "doc_id long, toxic int, annotator string")
    return {r.doc_id for r in abuse.score_documents(docs, abuse.model(docs, labels)).where(F.col("score") > abuse.THRESHOLD).collect()}


def test_harmless_documents_called_toxic_are_not_learned(spark):
    toxic = [(k, f"The page is fine today.\nyou zorbly flump number {k}, you idiot flump") for k in range(30)]
    toxic += [(50 + k, f"Tout ce qui a brillé {w} perd son éclat.") for k, w in enumerate(("hier", "ici", "jadis", "longtemps"))]
    harmless = [(100 + k, f"Tout ce qui a brillé avant perd son éclat.\nOn the page stands item {k}.") for k in range(30)]
    found = found_after_learning(spark, toxic, harmless)
    assert found >= {*range(30)} and not found & {k for k, _ in harmless}


def test_an_abusive_document_called_harmless_is_not_learned(spark):
    toxic = [(k, f"The page is fine today.\nyou zorbly flump number {k}, you idiot flump") for k in range(30)]
    assert found_after_learning(spark, toxic, [(200, toxic[3][1])]) == {*range(30), 200}


def test_harmless_passages_of_more_documents_are_held_apart():
    harmless = [f"Row {k} of the table is here." for k in range(20)]
    strings, labels = [abuse.canonical(t) for t in abuse.ABUSIVE + abuse.HARMLESS], [1] * len(abuse.ABUSIVE) + [0] * len(abuse.HARMLESS)
    calm, reserve = {abuse.canonical(t): 1 for t in harmless}, {abuse.canonical("Todos los gatos tienen que salir de la cocina"): 3}
    with_reserve, without = abuse.train(strings, labels, calm, reserve), abuse.train(strings, labels, calm)
    (a,), (b,) = (abuse.score_strings(list(reserve), *m) for m in (with_reserve, without))
    assert a < abuse.THRESHOLD < b


def test_scores_do_not_depend_on_the_batch(machine):
    strings = [abuse.canonical(t) for t in abuse.ABUSIVE[:40] + abuse.HARMLESS[:40]]
    together = abuse.score_strings(strings, *machine)
    assert together.tolist() == pytest.approx([abuse.score_strings([s], *machine)[0] for s in strings], abs=1e-4)
