"""Personal data in free text: a linear-chain conditional random field over word-shape features.

Training: log-likelihood of the labelled table (forward-backward over padded batches, AdaGrad, L2) in numpy. Decoding: Viterbi over
all texts of an Arrow batch at once, sorted by length. Features are hashed: what can be said of a token alone is worked out
once per distinct chunk between blanks and kept as a numbered row; neighbours and conjunctions are combined by integer arithmetic,
once per distinct neighbourhood of a batch. The weights, of fixed size, are the only thing sent to the executors; texts are
decoded where they lie, without a shuffle."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii_table import FIRST, labelled
from .textnorm import fold

KINDS = ("email", "phone", "id_number", "address", "name")
#: Tags: O, then begin and inside of every kind.
TAGS = 1 + 2 * len(KINDS)
BITS = 18
SIZE = 1 << BITS
PAD = 3

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_NUMBER = re.compile(r"[+(]?[\d][\d ()+./\-]*")
_CHUNK = re.compile(r"\S+")
_GIVEN = frozenset(fold(w) for w in FIRST)


def _h(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def _shape(w: str) -> str:
    if w[0].isdigit():
        return f"d{min(len(w), 9)}"
    if not w[0].isalpha():
        return w
    if len(w) == 1:
        return "X1" if w.isupper() else "x1"
    return "XX" if w.isupper() else "Xx" if w[0].isupper() and w[1:].islower() else "xx" if w.islower() else "mix"


N_OWN = 10  # columns of a token's row: 6 of Tokens.of, gap before, number pattern, digits of the number, pattern of the chunk
FULL = 300_000  # what a worker remembers of each kind before it starts anew


class Tokens:
    """What a worker remembers: features of tokens alone (word, shape, word's end, longer end, beginning, a known given name?), patterns,
    and the numbered rows of all tokens seen; row 0 is the padding between texts."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}
        self.shapes: dict[str, int] = {}
        self.chunks: dict[tuple[str, int], tuple[tuple[tuple[int, int], ...], tuple[int, ...]]] = {}
        self.numbers: dict[tuple[int, ...], int] = {(7,) * N_OWN: 0}

    def trim(self) -> None:
        if max(len(self.known), len(self.shapes), len(self.chunks), len(self.numbers)) > FULL:
            self.__init__()

    def number(self, row: tuple[int, ...]) -> int:
        return self.numbers.setdefault(row, len(self.numbers))

    def table(self) -> np.ndarray:
        return np.array(list(self.numbers), np.uint64)

    def of(self, w: str) -> tuple[int, ...]:
        got = self.known.get(w)
        if got is None:
            low = fold(w)
            alpha = w[0].isalpha()
            word = low if alpha else (w if len(w) <= 2 else f"#{len(w)}") if w[0].isdigit() else low
            s = _shape(w)
            got = self.known[w] = (_h("w" + word), _h("s" + s), _h("e" + low[-3:]) if alpha else _h("s" + s), _h("f" + low[-4:]) if alpha else 1, _h("b" + low[:3]) if alpha else 2, 20 + (low in _GIVEN))
        return got

    def pattern(self, s: str, prefix: str) -> int:
        """Hash of a stretch with letters as a, digits as 0 (runs of digits keep their length)."""
        got = self.shapes.get(s)
        if got is None:
            p = re.sub(r"[^\W\d_]+", "a", s)
            p = re.sub(r"\d+", lambda m: str(min(len(m[0]), 9)), p)[:40]
            got = self.shapes[s] = _h(prefix + p)
        return got

    def chunk(self, s: str, gap: int, at: int = 0, numbers: list[tuple[int, int, int, int]] = ()) -> tuple[tuple[tuple[int, int], ...], tuple[int, ...]]:
        """Spans, from the chunk's beginning, and row numbers of its tokens; ``numbers``: those that reach into it."""
        key = (s, gap)
        if not numbers and (got := self.chunks.get(key)):
            return got
        whole = self.pattern(s, "c") if len(s) < 80 else 5
        spans, rows = [], []
        for m in _TOKEN.finditer(s):
            inside = next((x for x in numbers if x[0] <= at + m.start() < x[1]), (0, 0, 3, 4))
            spans.append(m.span())
            rows.append(self.number((*self.of(m[0]), 10 + gap, inside[2], inside[3], whole)))
            gap = 0
        got = tuple(spans), tuple(rows)
        if not numbers:
            self.chunks[key] = got
        return got


def rows_of(text: str, memo: Tokens) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans of the tokens and the numbers of their rows."""
    numbers = []
    for m in _NUMBER.finditer(text):
        s = m[0].rstrip(" (+./-")
        n = sum(c.isdigit() for c in s)
        if n >= 3:
            numbers.append((m.start(), m.start() + len(s), memo.pattern(s, "n"), 1000 + min(n, 20)))
    spans: list[tuple[int, int]] = []
    rows: list[int] = []
    first = last = 0
    for m in _CHUNK.finditer(text):
        a, b = m.span()
        while first < len(numbers) and numbers[first][1] <= a:
            first += 1
        gap = 0 if a == last else 2 if "\n" in text[last:a] else 1
        reach = numbers[first : first + 8] if first < len(numbers) and numbers[first][0] < b else ()
        if reach and len(reach) == 8 and reach[-1][0] < b:
            reach = [x for x in numbers[first:] if x[0] < b]
        own, ids = memo.chunk(m[0], gap, a, reach)
        spans += [(a + x, a + y) for x, y in own]
        rows += ids
        last = b
    return spans, rows


_WORD, _SHAPE, _END, _END4, _BEGIN, _KNOWN, _GAP, _NUM, _NDIG, _CHUNKED = range(N_OWN)
#: Each feature: pairs (column, offset); several pairs are a conjunction.
TEMPLATES = (
    [((_WORD, o),) for o in (-3, -2, -1, 0, 1, 2, 3)] + [((_SHAPE, o),) for o in (-2, -1, 0, 1, 2)]
    + [((_KNOWN, 0),), ((_KNOWN, -1), (_SHAPE, 0)), ((_KNOWN, 1), (_SHAPE, 0)), ((_KNOWN, 2), (_SHAPE, 0))] + [((_END, 0),), ((_END4, 0),), ((_BEGIN, 0),), ((_NUM, 0),), ((_NDIG, 0),), ((_CHUNKED, 0),), ((_CHUNKED, -1),), ((_CHUNKED, 1),)]
    + [((_SHAPE, 0), (_GAP, 0)), ((_SHAPE, -1), (_SHAPE, 0)), ((_SHAPE, 0), (_SHAPE, 1)), ((_SHAPE, -1), (_SHAPE, 0), (_SHAPE, 1)), ((_WORD, -1), (_SHAPE, 0)), ((_SHAPE, 0), (_WORD, 1))]
    + [((_WORD, -1), (_WORD, 0)), ((_WORD, -2), (_WORD, -1)), ((_WORD, 1), (_WORD, 2)), ((_WORD, -3), (_WORD, -2), (_WORD, -1)), ((_NUM, 0), (_WORD, -1)), ((_END, -1), (_END, 0)), ((_END, 0), (_END, 1)), ((_WORD, -2), (_SHAPE, -1), (_SHAPE, 0))]
)


_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]


def feature_ids(lists: list[list[int]], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct neighbourhoods x templates) ids, the neighbourhood of each token of all texts one after another, and starts and lengths
    of the texts among these tokens."""
    lengths = np.array([len(x) for x in lists], np.int64)
    flat = np.zeros(int(lengths.sum()) + PAD * (len(lists) + 1), np.int64)
    starts = np.cumsum(lengths + PAD) - lengths  # after the padding that precedes each text
    inner = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    flat[inner] = np.fromiter((r for x in lists for r in x), np.int64, int(lengths.sum()))
    around = np.zeros(len(inner), np.uint64)
    for o, mix in zip(range(-PAD, PAD + 1), _MIX):
        around += (flat[inner + o].astype(np.uint64) + np.uint64(1)) * np.uint64(mix)
        around ^= around >> np.uint64(29)
    _, where, which = np.unique(around, return_index=True, return_inverse=True)
    at = inner[where]
    own = [table[flat[at + o]] for o in range(-PAD, PAD + 1)]
    out = np.empty((len(at), len(TEMPLATES)), np.int32)
    for t, parts in enumerate(TEMPLATES):
        h = np.full(len(at), (t + 1) * 0x9E3779B1, np.uint64)
        for col, off in parts:
            h = (h ^ own[off + PAD][:, col]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        out[:, t] = (h & np.uint64(SIZE - 1)).astype(np.int32)
    return out, which.ravel(), np.cumsum(lengths) - lengths, lengths


def _allowed() -> np.ndarray:
    """Inside tags follow their own begin or inside tag only; also at the start."""
    m = np.zeros((TAGS + 1, TAGS), bool)
    for a in range(TAGS + 1):
        for b in range(TAGS):
            m[a, b] = b == 0 or b % 2 == 1 or (a < TAGS and (a == b or a == b - 1))
    return m


FORBID = np.where(_allowed(), 0.0, -1e4).astype(np.float32)


def train(examples: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 6, rate: float = 0.25, l2: float = 1e-6, batch: int = 64, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (SIZE x TAGS) and transition weights (TAGS + 1 x TAGS, the last row for the start)."""
    memo = Tokens()
    lists, gold = [], []
    for text, marks in examples:
        spans, rows = rows_of(text, memo)
        if not rows:
            continue
        y = np.zeros(len(rows), np.int64)
        for a, b, kind in marks:
            k = 1 + 2 * KINDS.index(kind)
            first = True
            for t, (s, e) in enumerate(spans):
                if s >= a and e <= b:
                    y[t] = k if first else k + 1
                    first = False
        lists.append(rows)
        gold.append(y)
    ids, which, starts, lengths = feature_ids(lists, memo.table())
    ids = ids[which]
    w, trans = np.zeros((SIZE, TAGS), np.float32), np.zeros((TAGS + 1, TAGS), np.float32)
    gw, gt = np.full((SIZE, TAGS), 1e-6, np.float32), np.full((TAGS + 1, TAGS), 1e-6, np.float32)
    rng = np.random.default_rng(seed)
    # batches of texts of like length are put together once, only their order changes; so each batch's distinct features are found once
    order = rng.permutation(len(lists))
    order = order[np.argsort(lengths[order] // 4, kind="stable")]
    batches = []
    for k in range(0, len(order), batch):
        own = order[k : k + batch]
        n, b = int(lengths[own].max()), len(own)
        at = starts[own][:, None] + np.minimum(np.arange(n), lengths[own][:, None] - 1)
        mask = np.arange(n) < lengths[own][:, None]
        y = np.zeros((b, n), np.int64)
        for r, z in enumerate(own):
            y[r, : lengths[z]] = gold[z]
        f = ids[at]  # texts x tokens x templates
        used, back = np.unique(f[mask].ravel(), return_inverse=True)
        batches.append((n, b, mask, y, f, used, back.ravel()))
    for _ in range(epochs):
        for c in rng.permutation(len(batches)):
            n, b, mask, y, f, used, back = batches[c]
            emit = w[f].sum(2)
            move = trans + FORBID
            alpha, beta = np.zeros((b, n, TAGS)), np.zeros((b, n, TAGS))
            alpha[:, 0] = emit[:, 0] + move[TAGS]
            for t in range(1, n):
                x = alpha[:, t - 1, :, None] + move[None, :TAGS]
                top = x.max(1)
                new = top + np.log(np.exp(x - top[:, None]).sum(1)) + emit[:, t]
                alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
            for t in range(n - 2, -1, -1):
                x = move[None, :TAGS] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :]
                top = x.max(2)
                new = top + np.log(np.exp(x - top[:, :, None]).sum(2))
                beta[:, t] = np.where(mask[:, t + 1, None], new, beta[:, t + 1])
            top = alpha[:, -1].max(1)
            logz = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(1))
            p = np.exp(alpha + beta - logz[:, None, None])
            p[np.arange(b)[:, None], np.arange(n), y] -= 1
            p *= mask[:, :, None] / b
            g = np.zeros((TAGS + 1, TAGS))
            g[TAGS] = p[:, 0].sum(0)
            for t in range(1, n):
                x = alpha[:, t - 1, :, None] + move[None, :TAGS] + (emit[:, t] + beta[:, t])[:, None, :] - logz[:, None, None]
                live = mask[:, t]
                g[:TAGS] += np.exp(x[live]).sum(0) / b
                np.add.at(g, (y[live, t - 1], y[live, t]), -1.0 / b)
            grad = np.zeros((len(used), TAGS))
            per = p[mask]
            for k in range(TAGS):
                grad[:, k] = np.bincount(back, np.repeat(per[:, k], f.shape[2]), len(used))
            grad += l2 * w[used]
            gw[used] += grad**2
            w[used] -= rate * grad / np.sqrt(gw[used])
            g += l2 * trans
            gt += g**2
            trans -= (rate * g / np.sqrt(gt)).astype(np.float32)
    return w, trans


@cache
def model() -> tuple[np.ndarray, np.ndarray]:
    """Trained on the labelled table; the same on every run."""
    return train(labelled())


def viterbi(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray, group: int = 512) -> np.ndarray:
    """Best tags of all texts; ``emit`` holds their tokens one after another. Texts of like length are decoded together."""
    out = np.zeros(len(emit), np.int8)
    move = trans + FORBID
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    for c in range(0, len(order), group):
        own = order[c : c + group]
        n = lengths[own]
        most = int(n.max())
        back = np.zeros((most, len(own), TAGS), np.int8)
        score = emit[starts[own]] + move[TAGS]
        for t in range(1, most):
            live = n > t
            x = score[live][:, :, None] + move[None, :TAGS]
            best = x.argmax(1)
            back[t, live] = best
            score[live] = np.take_along_axis(x, best[:, None], 1)[:, 0] + emit[starts[own[live]] + t]
        tag = score.argmax(1)
        rows = np.arange(len(own))
        for t in range(most - 1, -1, -1):
            live = n > t
            out[starts[own[live]] + t] = tag[live]
            tag = np.where(live, back[t, rows, tag], tag) if t else tag
    return out


_EMAIL_OK = re.compile(r"@|\bat\b|\(at\)|\[at\]|&#64;|%40|\[dot\]|\bdot\b", re.I)


def plausible(kind: str, piece: str) -> bool:
    """Exact check of a decoded piece: digits where numbers are due, an at sign in some form, letters in names."""
    digits = sum(c.isdigit() for c in piece)
    if kind == "email":
        return bool(_EMAIL_OK.search(piece)) and "." in piece.replace("dot", ".")
    if kind == "phone":
        return digits >= 7 or (digits >= 6 and "-" in piece)
    if kind == "id_number":
        return digits >= 5
    if kind == "address":
        return digits >= 1 and any(c.isalpha() for c in piece)
    return any(c.isalpha() for c in piece) and digits == 0 and "@" not in piece


def tag_texts(texts: list[str], w: np.ndarray, trans: np.ndarray, memo: Tokens) -> list[list[tuple[int, int, str]]]:
    """Pieces (start, end, kind) of each text."""
    # invisible characters split words and numbers; they are blotted out, offsets stay those of the text
    plain = [t if t.isascii() else re.sub("[­​-‏⁠﻿]", "", t) for t in texts]
    memo.trim()
    both = [rows_of(t, memo) for t in plain]
    ids, which, starts, lengths = feature_ids([r for _, r in both], memo.table())
    scores = np.empty((len(ids), TAGS), np.float32)
    for k in range(0, len(ids), 4096):
        scores[k : k + 4096] = w[ids[k : k + 4096]].sum(1)
    tags = viterbi(scores[which], starts, lengths, trans)
    out = []
    for z, (spans, _) in enumerate(both):
        own = tags[starts[z] : starts[z] + lengths[z]].tolist()
        pieces: list[tuple[int, int, str]] = []
        k = 0
        while k < len(own):
            if own[k] % 2 == 1:
                kind, e = KINDS[(own[k] - 1) // 2], k + 1
                while e < len(own) and own[e] == own[k] + 1:
                    e += 1
                a, b = spans[k][0], spans[e - 1][1]
                if plausible(kind, plain[z][a:b]):
                    pieces.append((a, b, kind))
                k = e
            else:
                k += 1
        if plain[z] is not texts[z] and len(plain[z]) != len(texts[z]) and pieces:
            kept = [k for k, ch in enumerate(texts[z]) if not re.match("[­​-‏⁠﻿]", ch)]
            pieces = [(kept[a], kept[b - 1] + 1, kind) for a, b, kind in pieces]
        out.append(pieces)
    return out


def redacted(text: str, pieces: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in pieces:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def pieces_of(text: Column, w_and_trans) -> Column:
    """array<struct<start, end, kind>> and the readable text with placeholders; null for null, the text itself if nothing is found."""

    @F.pandas_udf("kinds array<string>, redacted string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, trans = w_and_trans.value
        memo = Tokens()
        for s in batches:
            texts = s.tolist()
            distinct = list({t for t in texts if t})
            found: dict[str, tuple[list[str], str]] = {}
            for k in range(0, len(distinct), 2048):
                part = distinct[k : k + 2048]
                for t, p in zip(part, tag_texts(part, w, trans, memo)):
                    found[t] = ([x[2] for x in p], redacted(t, p))
            yield pd.DataFrame({"kinds": pd.Series([found[t][0] if t else [] for t in texts], dtype=object), "redacted": pd.Series([found[t][1] if t else t for t in texts], dtype=object)})

    return run(text)


def feedback_texts(feedback: DataFrame) -> DataFrame:
    """(event_id, field, pos, text): one row per text of an event; redelivered events count once."""
    one = F.struct
    messages = F.transform(F.coalesce("messages", F.array()), lambda m, k: one(F.lit("messages").alias("field"), k.cast("long").alias("pos"), m.content.alias("text")))
    rest = F.array(one(F.lit("response").alias("field"), F.lit(0).cast("long").alias("pos"), F.col("response").alias("text")), one(F.lit("correction").alias("field"), F.lit(0).cast("long").alias("pos"), F.col("correction").alias("text")))
    rows = feedback.where(F.col("event_id").isNotNull()).select("event_id", F.explode(F.concat(messages, rest)).alias("x"))
    return rows.select("event_id", "x.*").where(F.length("text") > 0)


def tagged(feedback: DataFrame) -> DataFrame:
    """(event_id, field, pos, text, kinds, redacted) of all texts. Null and empty texts have no row."""
    shared = feedback.sparkSession.sparkContext.broadcast(model())
    rows = feedback_texts(feedback)
    return rows.withColumn("r", pieces_of(F.col("text"), shared)).select("event_id", "field", "pos", "text", "r.*")


def found(feedback: DataFrame) -> DataFrame:
    """Distinct (event_id, field, pos, kind). Events delivered twice give one row; empty tables none."""
    return tagged(feedback).select("event_id", "field", "pos", F.explode("kinds").alias("kind")).distinct()
