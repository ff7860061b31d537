"""Abusive, hateful and sexually explicit passages: a support vector machine with a gap-tolerant subsequence kernel.

Kernel: the feature of a string for each subsequence of four symbols within a span of six is the sum of DECAY ** gaps over its
occurrences; inserted characters, doubled letters and dropped letters leave most of them in place. Blanks, also those around the
string, are symbols, so short words and the ends of words have features too. Rows are divided by the root of the string's length.
The kernel is approximated by landmarks (Nystroem): z(x) = K_mm^-1/2 k(x, landmarks), and a linear machine with squared hinge loss is
trained on z. As the kernel has explicit features, score(x) = <w, z(x)> + b equals one dot product of x's features with
sum_l (K_mm^-1/2 w)_l * phi(l); that vector of SYMBOLS^4 floats is all that executors need. Every subsequence belongs to the place
where it begins, so the sums of a passage and of all windows in it are differences of one running sum.

Training: the sentences of ``abuse_table``; passages of labelled documents that all raters call harmless; and of documents that all
raters call toxic the one passage that the machine finds worst, if it finds it bad at all (multiple-instance learning, one round). As
raters err on either side, a passage that only the label speaks for is weighed against those near it in documents of the other label.

A document's score is the largest of its passages (sentences and lines of any length, and windows of words in longer ones), so one
passage in a long text counts. Passages are normalised first: compatibility forms, look-alike letters, invisible characters,
digits and signs used as letters, letters set apart."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .abuse_table import ABUSIVE, HARMLESS
from .textnorm import fold

SYMBOLS, DECAY, SPAN = 28, 0.6, 6
#: Windows within a passage have about WINDOW characters, each starting STEP after the last; LONG passages are scored by windows only.
LONG, WINDOW, STEP = 130, 60, 30
#: Strings of fewer letters count as this long when their rows are divided by their length.
LEAST = 16
#: Scores above it count as found.
THRESHOLD = 0.15
#: The labelled documents of each class that lend passages, and passages from each harmless one (bounds of the training sample).
LABELLED_DOCS, SENTENCES_EACH = 600, 16
#: Harmless documents, with those, in which passages are sought that the first machine wrongly finds bad.
HARMLESS_DOCS = 6000
#: The worst passage of a toxic document is learned, and a harmless passage counts as wrongly found bad, if a machine scores it above this.
LEARNED = -0.2
#: Weight of a passage that a toxic document lends, and of one per harmless document that it stands in; own sentences have 1.
RATED, CALM = 0.5, 0.4
#: Passages of this cosine are near each other.
NEAR = 0.5
#: A passage in so many times as many toxic documents as harmless ones stands in the latter by the raters' errors.
ERRS = 8

_SPLIT = re.compile(r"\n+|(?<=[.!?…])[\"'»”)]*\s+")
_ADDRESS = re.compile(r"\W*[^,:.!?]{2,20}[,:]\s+(?=\S)")
_LEET = str.maketrans("013457@$", "oieastas")
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*·]{1,2}){2,}[^\W\d_](?![^\W_])")
_LEETED = re.compile(r"\S*[a-z]\S*[0-9@$]\S*|\S*[0-9@$]\S*[a-z]\S*")
_MIXED = re.compile(r"[a-z][0-9@$]|[0-9@$][a-z]")
#: Speakers, list marks and times before a passage.
_LABEL = re.compile(r"^\W*(?:(?:user|guest|agent|assistant|system|question|answer|input|output|prompt|thread|suite|q|a|b)\s*[:>]+|(?:\d+[.:)]+)+\d*\s|[-*\[]\s*[\d:]+\]?)*\W*")
_LONG_NUMBER = re.compile(r"\d{3}")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_WITHIN = re.compile(r"(?<=[a-z])[*_.\-'’]+(?=[a-z])")
_REST = re.compile(r"[^a-z#]+")
_MANY = re.compile(r"([a-z])\1{2,}")


def canonical(passage: str) -> str:
    """Letters a-z, single blanks, one # per number."""
    s = _LABEL.sub("", fold(passage))
    s = _APART.sub(lambda m: re.sub(r"[ .\-_*·]", "", m[0]), s)
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).replace("ß", "ss")
    if _MIXED.search(s):
        s = _LEETED.sub(lambda m: m[0].translate(_LEET) if max(3, sum(c.isdigit() for c in m[0])) <= sum(c.isalpha() for c in m[0]) + (len(m[0]) < 5) and not _LONG_NUMBER.search(m[0]) else m[0], s)
    s = _WITHIN.sub("", s)
    s = _MANY.sub(r"\1", s)
    s = _NUMBER.sub("#", s)
    return _REST.sub(" ", s).strip()


def passages(text: str) -> list[str]:
    """Sentences and lines; what follows a short address (``Dear all,``) also stands for itself."""
    out = []
    for s in _SPLIT.split(text):
        if s.strip():
            out.append(s)
            if m := _ADDRESS.match(s):
                out.append(s[m.end() :])
    return out


def windows(string: str) -> list[str]:
    """The canonical passage, if not LONG, and where it is longer than WINDOW overlapping windows of it that begin and end at blanks."""
    if len(string) <= WINDOW + STEP // 2:
        return [string]
    out, at = [string] if len(string) <= LONG else [], 0
    while at < len(string):
        start = string.rfind(" ", 0, at + 1) + 1 if at else 0
        end = string.find(" ", at + WINDOW)
        out.append(string[start : end if end > 0 else len(string)])
        if end < 0:
            break
        at += STEP
    return out


_OFFSETS = [(a, b, c) for a in range(1, SPAN) for b in range(a + 1, SPAN) for c in range(b + 1, SPAN)]
_WEIGHTS = np.array([DECAY ** (c - 3) for _, _, c in _OFFSETS], np.float32)
_MASS = float((_WEIGHTS**2).sum())
_CODES = np.zeros(256, np.int32)
_CODES[97:123], _CODES[35] = np.arange(1, 27), 27


def laid_out(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all strings one after another, a blank before each and SPAN blanks after it; first places and lengths, both with that blank."""
    flat = _CODES[np.frombuffer("".join(" " + s + " " * SPAN for s in strings).encode("ascii"), np.uint8)]
    n = np.array([len(s) + 1 for s in strings], np.int64)
    return flat, np.cumsum(n + SPAN) - n - SPAN, n


def subsequences(code: np.ndarray) -> np.ndarray:
    """Feature numbers (offsets x places) of the subsequences that begin at each place but the last SPAN ones."""
    n = len(code) - SPAN
    first = code[:n] * SYMBOLS**3
    second, third = code * SYMBOLS**2, code * SYMBOLS
    idx = np.empty((len(_OFFSETS), n), np.int32)
    for k, (a, b, c) in enumerate(_OFFSETS):
        idx[k] = first + second[a : n + a] + third[b : n + b] + code[c : n + c]
    return idx


def score_strings(strings: list[str], vector: np.ndarray, bias: float, block: int = 2000) -> np.ndarray:
    """The machine's score of each canonical string: the largest of its own, if it is not LONG, and those of its windows."""
    out = np.empty(len(strings))
    for at in range(0, len(strings), block):
        part = strings[at : at + block]
        code, start, n = laid_out(part)
        idx = subsequences(code)
        here = np.zeros(idx.shape[1])
        for k, w in enumerate(_WEIGHTS):
            here += w * vector[idx[k]]
        run = np.concatenate([[0.0], np.cumsum(here), np.zeros(SPAN)])
        run[len(here) + 1 :] = run[len(here)]
        value = lambda a, b: (run[b] - run[a]) / np.sqrt(np.maximum(b - a, LEAST) * _MASS) + bias
        best = np.where(n <= LONG + 1, value(start, start + n), -np.inf)
        long = np.flatnonzero(n > WINDOW + STEP // 2 + 1)
        if len(long):
            # windows begin at the last blank before every STEP-th place and end at the first one WINDOW further on
            many = -(-(n[long] - 1 - WINDOW) // STEP) + 1
            owner = np.repeat(long, many)
            step = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * STEP
            places, blank = np.arange(len(code)), code == 0
            left = np.maximum.accumulate(np.where(blank, places, 0))
            right = np.minimum.accumulate(np.where(blank, places, len(code))[::-1])[::-1]
            a = left[start[owner] + step]
            b = np.minimum(right[np.minimum(start[owner] + step + WINDOW + 1, start[owner] + n[owner])], start[owner] + n[owner])
            np.maximum.at(best, owner, value(a, b))
        out[at : at + len(part)] = best
    return out


def sparse_rows(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, feature, weight) of the rows of whole strings, divided by the root of their lengths."""
    code, start, n = laid_out(strings)
    idx = subsequences(code)
    owner = np.repeat(np.arange(len(strings)), n + SPAN)[: idx.shape[1]]
    inside = np.arange(len(owner)) - start[owner] < n[owner]  # not those that begin in the blanks behind a string
    owner, idx = owner[inside], idx[:, inside]
    scale = 1 / np.sqrt(np.maximum(n, LEAST) * _MASS)
    key = (owner.astype(np.int64) * SYMBOLS**4 + idx).ravel()
    key, back = np.unique(key, return_inverse=True)
    weight = np.bincount(back.ravel(), (_WEIGHTS[:, None] * scale[owner]).ravel(), len(key))
    return key // SYMBOLS**4, (key % SYMBOLS**4).astype(np.int32), weight.astype(np.float32)


def kernel_rows(strings: list[str], marks: list[str]) -> np.ndarray:
    """Kernel of all strings with the landmarks, through the places of each feature in the landmarks."""
    owner, feature, weight = sparse_rows(marks)
    order = np.argsort(feature, kind="stable")
    owner, weight = owner[order], weight[order]
    first = np.searchsorted(feature[order], np.arange(SYMBOLS**4 + 1))
    out = np.zeros((len(strings), len(marks)))
    for at in range(0, len(strings), 200):
        part = strings[at : at + 200]
        o, f, w = sparse_rows(part)
        n = first[f + 1] - first[f]
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[f], n)
        out[at : at + len(part)] = np.bincount(np.repeat(o, n) * len(marks) + owner[pos], np.repeat(w, n) * weight[pos], len(part) * len(marks)).reshape(len(part), -1)
    return out


def squared_hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of the linear machine; the last column of ``z`` is the bias, hardly held back. Newton's method."""
    w, ridge = np.zeros(z.shape[1]), np.r_[np.ones(z.shape[1] - 1), 1e-3]
    for _ in range(steps):
        margin = 1 - y * (z @ w)
        on = margin > 0
        grad = ridge * w - z[on].T @ (cost[on] * y[on] * margin[on]) * 2
        hess = np.diag(ridge) + 2 * (z[on] * cost[on, None]).T @ z[on]
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def collapsed(root: np.ndarray, w: np.ndarray, marks: list[str]) -> tuple[np.ndarray, float]:
    owner, feature, weight = sparse_rows(marks)
    return np.bincount(feature, weight * (root @ w[:-1])[owner], SYMBOLS**4).astype(np.float32), float(w[-1])


def mapping(marks: list[str]) -> np.ndarray:
    """K_mm^-1/2 of the landmarks, without its null space."""
    values, vectors = np.linalg.eigh(kernel_rows(marks, marks))
    keep = values > 1e-6
    return vectors[:, keep] / np.sqrt(values[keep])


def near(strings: list[str], others: list[str]) -> np.ndarray:
    """Whether the cosine of the kernel's features of each two strings is at least NEAR."""
    norms = []
    for xs in (strings, others):
        owner, _, weight = sparse_rows(xs)
        norms.append(np.sqrt(np.bincount(owner, weight.astype(float) ** 2, len(xs))))
    return kernel_rows(strings, others) >= NEAR * np.outer(*norms)


def worst_of(bags: list[list[str]], fitted: tuple[np.ndarray, float], above: float) -> list[tuple[str, float]]:
    """The worst string of each bag and its score, where that is above ``above``."""
    scores, at, out = score_strings([p for bag in bags for p in bag], *fitted) if any(bags) else (), 0, []
    for bag in bags:
        if bag:
            k = int(scores[at : at + len(bag)].argmax())
            out += [(bag[k], scores[at + k])] if scores[at + k] > above else []
        at += len(bag)
    return out


def wrongly_bad(rated: dict[str, float], toxic: Counter[str], fitted: tuple[np.ndarray, float]) -> tuple[list[str], set[str]]:
    """Strings of harmless documents that the machine finds bad, worst first, but for those (second) near which more documents called
    toxic have their worst string than there are harmless ones."""
    scores = dict(zip(rated, score_strings(list(rated), *fitted))) if rated else {}
    hard = sorted((s for s, v in scores.items() if v > LEARNED), key=lambda s: (-scores[s], s))
    if not hard or not toxic:
        return hard, set()
    alike, against = (near(hard, list(side)) @ np.array(list(side.values()), float) for side in (toxic, {s: rated[s] for s in hard}))
    erring = {s for s, t, m in zip(hard, alike, against) if t > m}
    return [s for s in hard if s not in erring], erring


def train(strings: list[str], labels: list[int], calm: dict[str, float] = {}, reserve: dict[str, float] = {}, bags: list[list[str]] = (), landmarks: int = 1500, cost: float = 8.0) -> tuple[np.ndarray, float]:  # noqa: B006
    """The collapsed weight vector and bias. Landmarks: strings of both classes, five of six positive, evenly from the given order.

    ``calm``, ``reserve``: strings of documents called harmless and in how many they stand; those of ``reserve`` join only where a machine
    wrongly finds them bad. What the first wrongly finds bad becomes a landmark of the second too. ``bags``: strings of documents called
    toxic; the worst of each, found by the second machine, joins the third. As raters err, one below THRESHOLD joins only if another
    document's is near it and those near it outweigh the harmless strings near it. The last machine learns what the third wrongly finds bad."""
    n = len(strings)
    strings, y = [*strings, *calm], np.where(np.r_[np.array(labels), np.zeros(len(calm))] > 0, 1.0, -1.0)
    c = cost * np.r_[np.ones(n), [CALM * k for k in calm.values()]]
    marks = []
    for own, many in ((np.flatnonzero(y > 0), landmarks * 5 // 6), (np.flatnonzero(y < 0), landmarks // 6)):
        marks += [strings[k] for k in own[np.unique(np.linspace(0, len(own) - 1, many).astype(int))]] if len(own) else []
    root = mapping(marks)
    mapped = lambda xs: np.c_[kernel_rows(xs, marks) @ root, np.ones(len(xs))]
    z = mapped(strings)
    fitted = collapsed(root, squared_hinge(z, y, c), marks)
    rated = calm | reserve

    hard, erring = wrongly_bad(rated, Counter(s for s, _ in worst_of(bags, fitted, THRESHOLD)), fitted)
    if hard or erring:
        keep = np.array([k < n or s not in erring for k, s in enumerate(strings)])
        late = [s for s in hard if s not in calm]
        strings = [s for s, k in zip(strings, keep) if k] + late
        y, c = np.r_[y[keep], -np.ones(len(late))], np.r_[c[keep], [cost * CALM * rated[s] for s in late]]
        marks += [s for s in hard if s not in set(marks)][: landmarks // 6]
        root = mapping(marks)
        z = mapped(strings)
        fitted = collapsed(root, squared_hinge(z, y, c), marks)

    worst = worst_of(bags, fitted, LEARNED)
    bad, documents = dict(worst), Counter(s for s, _ in worst)
    if doubted := [s for s in bad if bad[s] <= THRESHOLD]:
        alike = near(doubted, list(bad)) @ np.array([documents[s] for s in bad])
        against = near(doubted, [s for s, k in zip(strings, y) if k < 0]) @ (c[y < 0] / cost)
        lone = {s for s, t, m in zip(doubted, alike, against) if t < 2 or RATED * t <= m}
        bad = {s: v for s, v in bad.items() if s not in lone}
    learned = list(dict.fromkeys(s if len(s) <= LONG else max(windows(s), key=lambda x: score_strings([x], *fitted)[0]) for s in bad))
    if not learned:
        return fitted
    z, y, c = np.r_[z, mapped(learned)], np.r_[y, np.ones(len(learned))], np.r_[c, np.full(len(learned), cost * RATED)]
    fitted = collapsed(root, squared_hinge(z, y, c), marks)

    seen = erring.union(strings, learned)
    late, _ = wrongly_bad({s: k for s, k in reserve.items() if s not in seen}, Counter({s: documents[s] for s in bad}), fitted)
    if not late:
        return fitted
    z, y, c = np.r_[z, mapped(late)], np.r_[y, -np.ones(len(late))], np.r_[c, [cost * CALM * reserve[s] for s in late]]
    return collapsed(root, squared_hinge(z, y, c), marks)


def labelled_texts(docs: DataFrame, labels: DataFrame, toxic: int, most_docs: int = LABELLED_DOCS) -> list[str]:
    """Texts of at most ``most_docs`` documents on whose label all raters agree, chosen and ordered by a hash of the id."""
    sure = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("a"), F.max("toxic").alias("b")).where((F.col("a") == toxic) & (F.col("b") == toxic))
    picked = sure.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs).select("doc_id")
    texts = docs.join(F.broadcast(picked), "doc_id").where(F.length("text") > 0).select("doc_id", "text").limit(2 * most_docs).toPandas()
    return texts.sort_values(["doc_id", "text"])["text"].tolist()


def pieces(text: str) -> list[str]:
    """Canonical passages and windows of a text."""
    return [c for p in passages(text) for c in windows(canonical(p)) if c]


_FITTED: dict[int, tuple[np.ndarray, float]] = {}


def model(docs: DataFrame | None = None, labels: DataFrame | None = None) -> tuple[np.ndarray, float]:
    """Trained on the labelled sentences and, if given, on passages of labelled documents at a lower weight, as raters err.

    Remembered per training sample, so several queries of a session train once."""
    harmless, toxic = ([], []) if docs is None or labels is None else (labelled_texts(docs, labels, t, n) for t, n in ((0, HARMLESS_DOCS), (1, LABELLED_DOCS)))
    return fitted_on(harmless, toxic)


def fitted_on(harmless: list[str], toxic: list[str]) -> tuple[np.ndarray, float]:
    """The machine of the labelled sentences, of passages of ``harmless`` texts and of one passage of each of the ``toxic`` ones."""
    key = hash((tuple(harmless), tuple(toxic)))
    if key not in _FITTED:
        mild, bags = [pieces(t) for t in harmless], [pieces(t) for t in toxic]
        in_mild, in_bags = (Counter(c for own in side for c in set(own)) for side in (mild, bags))
        # raters err on either side: a passage counts as harmless unless it stands in ERRS times as many toxic documents
        scale = min(1, max(1, len(bags)) / max(1, len(mild)))
        shared = {c: max(1, n * scale) for c, n in sorted(in_mild.items()) if in_bags[c] < max(2, ERRS * n * scale)}
        some = mild[:: -(-len(mild) // LABELLED_DOCS) or 1]
        calm = {c: shared[c] for own in some for c in own[:: max(1, len(own) // SENTENCES_EACH)][:SENTENCES_EACH] if c in shared}
        reserve = {c: n for c, n in shared.items() if c not in calm}
        strings, labels = [canonical(t) for t in ABUSIVE + HARMLESS], [1] * len(ABUSIVE) + [0] * len(HARMLESS)
        _FITTED[key] = train(strings, labels, calm, reserve, [[c for c in own if c not in shared] for own in bags])
    return _FITTED[key]


def score_documents(docs: DataFrame, fitted: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, score, passage) of every document; no shuffle. Null, empty and blank texts and those without Latin letters or
    digits after folding: score -1, passage null.

    Repeated rows stay. A score above 0 is on the machine's positive side."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fitted)  # one vector of fixed size, 2.5 MB

    @F.pandas_udf("score double, passage string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vector, bias = shared.value
        known: dict[str, float] = {}
        for s in batches:
            split = [passages(t) if t else [] for t in s.tolist()]
            if len(known) > 200_000:
                known.clear()
            fresh = list({p for ps in split for p in ps if p not in known})
            plain = [canonical(p) for p in fresh]
            some = [k for k, c in enumerate(plain) if c]
            known.update(dict.fromkeys((p for p, c in zip(fresh, plain) if not c), -1.0))
            known.update(zip([fresh[k] for k in some], score_strings([plain[k] for k in some], vector, bias).tolist()))
            worst = [max(ps, key=known.__getitem__, default=None) for ps in split]
            best = [known[p] if p is not None else -1.0 for p in worst]
            yield pd.DataFrame({"score": best, "passage": pd.Series([p if b > -1.0 else None for p, b in zip(worst, best)], dtype=object)})

    cols = [F.col(c) for c in (key, *keep)]
    return docs.select(*cols, score(F.col(text)).alias("s")).select(*cols, F.greatest(F.round("s.score", 6), F.lit(-1.0)).alias("score"), "s.passage")
