"""Contamination of a corpus with evaluation items: word n-grams, MinHash bands over windows, hashed sparse embeddings.

The corpus is read once: each Arrow batch is split into words once, and all detectors asked for look at them in numpy. The items are
few beside it; they go to the executors as an index of bounded size (``BLOCK_ITEMS``, ``BLOCK_WORDS``), and beyond that size as
several indexes, one scan each. Nothing is shuffled but the hits."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b, md5

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..plans.sizes import spread
from ..session import cut_lineage

#: Columns of an item that are scanned, joined in this order (fixed values).
ITEM_FIELDS = ("prompt", "question", "input", "text", "answer", "output", "reference")
#: Items, and words of items, of one index.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 4_000_000


@dataclass(frozen=True)
class ScanConfig:
    n: int = 13
    min_n: int = 8
    shingle: int = 3
    num_perm: int = 128
    bands: int = 64
    rows: int = 2
    max_matches: int = 20
    overlap_contaminated: float = 0.5
    containment_contaminated: float = 0.8
    containment_suspicious: float = 0.5
    cosine_contaminated: float = 0.8
    cosine_suspicious: float = 0.4

    def __post_init__(self) -> None:
        if self.min_n > self.n:
            raise ValueError("min_n must be <= n")
        if self.bands * self.rows > self.num_perm:
            raise ValueError("bands * rows must be <= num_perm")


_GAP = re.compile(r"[\W_]+")
_ASCII = re.compile(r"[a-z0-9]+")


def words_of(text: str | None) -> list[str]:
    """Words after compatibility forms and full case folding; marks of every kind part them."""
    if not text:
        return []
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _GAP.sub(" ", unicodedata.normalize("NFKC", text).casefold()).split()


@F.pandas_udf(ArrayType(StringType()))
def _split(s: pd.Series) -> pd.Series:
    return s.map(words_of)


def item_words(items: DataFrame, key: str = "id", fields: tuple[str, ...] = ITEM_FIELDS) -> DataFrame:
    """(item_id, words) of each item: all its text columns together. Items without words stay, with []."""
    return items.select(F.col(key).alias("item_id"), _split(_item_text(items, key, fields)).alias("words"))


def _item_text(items: DataFrame, key: str, fields: tuple[str, ...]) -> Column:
    return F.concat_ws(" ", *[F.col(c) for c in fields if c in items.columns and c != key])


def _with_n(words: DataFrame, cfg: ScanConfig) -> DataFrame:
    return words.withColumn("n", F.when(F.size("words") >= cfg.min_n, F.least(F.lit(cfg.n), F.size("words"))).otherwise(0))


# ---- hashes and signatures -----------------------------------------------------------------------------------------
MERSENNE = (1 << 31) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


def grams_of(words: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of the n-grams that begin at each place) for each wanted size, built up one word at a time."""
    h = words.copy()
    for n in range(1, max(sizes, default=0) + 1):
        if n > 1:
            if len(h) < 2:
                return
            h = h[:-1] * _STEP + words[n - 1 :]
        if n in sizes:
            yield n, h ^ (h >> np.uint64(31))


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets by rule (a linear congruence), so that every engine can make them."""
    a = np.array([(1_103_515_245 * (k + 1) + 12_345) % (MERSENNE - 1) + 1 for k in range(count)], np.int64)
    b = np.array([(214_013 * (k + 1) + 2_531_011) % MERSENNE for k in range(count)], np.int64)
    return a, b


class _Shingles(dict):
    """28 bits of md5 of a shingle, which every engine can repeat."""

    def __missing__(self, s: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[s] = int(md5(s.encode("utf-8", "surrogatepass")).hexdigest()[:7], 16)
        return h


def shingle_hashes(words: list[str], k: int, memo: _Shingles) -> np.ndarray:
    """Of each shingle in order; a list shorter than a shingle is hashed word by word."""
    parts = map(" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else words
    return np.fromiter((memo[x] for x in parts), np.int64)


def signatures_of(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: int) -> np.ndarray:
    """Minima of the permuted hashes over each stretch (all of them non-empty), one row per stretch."""
    a, b = permutations(count)
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[::2], bounds[1::2] = starts, ends
    out = np.empty((len(starts), count), np.int64)
    padded = np.append(hashes, 0)  # an end may lie behind the last hash
    for k in range(count):
        out[:, k] = np.minimum.reduceat((a[k] * padded + b[k]) % MERSENNE, bounds)[::2]
    return out


def window_starts(n: int, size: int, stride: int) -> list[int]:
    """Every ``stride`` words, and one that ends with the text; a text of at most ``size`` words is one window."""
    if n <= size:
        return [0] if n else []
    last = n - size
    return [*range(0, last, stride), last]


# ---- hashed sparse embeddings --------------------------------------------------------------------------------------
DIMENSIONS = 4096
#: Words without weight (fixed values).
STOP = frozenset("""
a an the and or but if of to in on at by for with from as is are was were be been being
it its this that these those there here what which who whom whose when where why how do
does did done can could should would shall will may might must not no so than then too
very just also into about over under up down out off again more most such only own same
other some any each both few all i you he she we they me him her us them my your his our
their s t
""".split())


def word_buckets(w: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and signs of a word: its own, and those of the 4-grams of the word between angle brackets."""
    padded = f"<{w}>"
    parts = [f"w:{w}"] + ([f"c:{padded[i : i + 4]}" for i in range(len(padded) - 3)] if len(padded) > 4 else [])
    h = [int.from_bytes(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") for x in parts]
    return np.array([x % DIMENSIONS for x in h], np.int64), np.array([1.0 if x >> 63 else -1.0 for x in h], np.float32)


def content_counts(words: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in words:
        if w not in STOP:
            out[w] = out.get(w, 0) + 1
    return out


def document_frequency(lists: list[list[str]]) -> np.ndarray:
    df = np.zeros(DIMENSIONS)
    for ws in lists:
        found = [word_buckets(w)[0] for w in content_counts(ws)]
        if found:
            df[np.unique(np.concatenate(found))] += 1
    return df


class Embedder:
    """Sum over distinct words of (1 + ln count) times the word's signed, idf-weighted buckets; rows of length 1."""

    def __init__(self, df: np.ndarray, n: int) -> None:
        self.idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, math.log(1 + n) + 1).astype(np.float32)
        self.memo: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return {"idf": self.idf, "memo": {}}

    def vector(self, w: str) -> tuple[np.ndarray, np.ndarray]:
        got = self.memo.get(w)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            at, sign = word_buckets(w)
            got = self.memo[w] = (at, sign * self.idf[at])
        return got

    def dense(self, counts: list[dict[str, int]]) -> np.ndarray:
        out = np.zeros((len(counts), DIMENSIONS), np.float32)
        for row, own in zip(out, counts):
            for w, c in own.items():
                at, v = self.vector(w)
                np.add.at(row, at, v * np.float32(1 + math.log(c)))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


# ---- the index of the items ----------------------------------------------------------------------------------------
@dataclass
class Index:
    """What the detectors look up, of at most BLOCK_ITEMS items."""

    cfg: ScanConfig
    ids: list[str]
    words: list[list[str]]
    size: int
    stride: int
    embedder: Embedder
    n: list[int] = field(default_factory=list)
    grams: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        cfg, memo, shingles = self.cfg, _Hashes(), _Shingles()
        self.n = [min(cfg.n, len(w)) if len(w) >= cfg.min_n else 0 for w in self.words]
        for i, (w, n) in enumerate(zip(self.words, self.n)):
            if n:
                for _, h in grams_of(np.array([memo[x] for x in w], np.uint64), {n}):
                    for pos, g in enumerate(h.tolist()):
                        self.grams.setdefault(n, {}).setdefault(g, []).append((i, pos))
        # a bit map per size: one look tells almost every gram of the corpus from those of the items
        self.bits = {n: np.zeros(1 << 22, bool) for n in self.grams}
        for n, own in self.grams.items():
            self.bits[n][(np.fromiter(own, np.uint64, len(own)) & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        lists = [np.unique(shingle_hashes(w, cfg.shingle, shingles)) for w in self.words]
        self.n_shingles = np.array([len(x) for x in lists], np.int64)
        full = np.flatnonzero(self.n_shingles)
        ends = np.cumsum(self.n_shingles[full])
        self.signatures = np.full((len(lists), cfg.num_perm), -1, np.int64)
        if len(full):
            self.signatures[full] = signatures_of(np.concatenate([lists[k] for k in full]), ends - self.n_shingles[full], ends, cfg.num_perm)
        keys = band_keys(self.signatures[full], cfg)
        order = [np.argsort(k, kind="stable") for k in keys]
        self.bands = [(k[o], full[o]) for k, o in zip(keys, order)]
        self.matrix = self.embedder.dense([content_counts(w) for w in self.words]).T.copy()  # buckets x items


def band_keys(sig: np.ndarray, cfg: ScanConfig) -> list[np.ndarray]:
    """One key per band and row: the band's minima in one number (exact for two rows, mixed for more)."""
    out = []
    for b in range(cfg.bands):
        key = np.zeros(len(sig), np.int64)
        for r in range(b * cfg.rows, (b + 1) * cfg.rows):
            key = key * np.int64(1 << 31) + sig[:, r] if cfg.rows <= 2 else (key ^ sig[:, r]) * np.int64(0x2545F4914F6CDD1D)
        out.append(key)
    return out


def window_size(lengths: list[int]) -> tuple[int, int]:
    """Window and stride in words: 1.5 times the 90th percentile of the item lengths, at least 16; a quarter of it."""
    size = max(16, math.ceil(1.5 * float(np.percentile(lengths, 90)))) if lengths else 16
    return size, max(1, size // 4)


def indexes(items: DataFrame, cfg: ScanConfig = ScanConfig(), key: str = "id", fields: tuple[str, ...] = ITEM_FIELDS) -> Iterator[Index]:
    """The items as indexes of bounded size; window and idf are those of all items together."""
    words = item_words(items, key, fields).where(F.size("words") > 0)
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(_item_text(items, key, fields))), F.lit(0)).alias("chars")).first()
    blocks = max(1, math.ceil(size.n / BLOCK_ITEMS), math.ceil(size.chars / (6 * BLOCK_WORDS)))
    if blocks > 1:
        words = cut_lineage(words.distinct())
        total = words.count()
        lengths = [int(words.agg(F.percentile_approx(F.size("words"), 0.9, 100_000)).first()[0])]
    def part(b: int) -> list[tuple[str, list[str]]]:
        own = words if blocks == 1 else words.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        return sorted({(r.item_id or "", tuple(r.words)) for r in own.collect()})

    if blocks == 1:
        rows = part(0)
        df, lengths, total = document_frequency([w for _, w in rows]), [len(w) for _, w in rows], len(rows)
    else:
        df = sum(document_frequency([w for _, w in part(b)]) for b in range(blocks))
    window, stride = window_size(lengths)
    for b in range(blocks):
        rows = rows if blocks == 1 else part(b)
        yield Index(cfg, [i for i, _ in rows], [list(w) for _, w in rows], window, stride, Embedder(df, total))


def save_index(items: DataFrame, path: str, **names) -> None:
    """The items' words as a table; ``load_index`` gives them back as items to scan with."""
    item_words(items, **names).write.mode("overwrite").parquet(path)


def load_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("item_id").alias("id"), F.array_join("words", " ").alias("text"))


# ---- the scan ------------------------------------------------------------------------------------------------------
def _gram_hits(keys: list, lists: list[list[str]], index: Index, memo: _Hashes) -> Iterator[tuple]:
    sizes = set(index.grams)
    flat = np.fromiter((memo[w] for ws in lists for w in ws), np.uint64)
    ends = np.cumsum([len(ws) for ws in lists])
    for n, h in grams_of(flat, sizes):
        table = index.grams[n]
        at = np.flatnonzero(index.bits[n][(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        owner = np.searchsorted(ends, at, "right")
        for pos, z, g in zip(at.tolist(), owner.tolist(), h[at].tolist()):
            found = table.get(g)
            start = pos - (int(ends[z - 1]) if z else 0)
            if found and start + n <= len(lists[z]):
                own = lists[z][start : start + n]
                for i, p in found:
                    if index.words[i][p : p + n] == own:
                        yield keys[z], index.ids[i], "ngram", start, p, n, len(index.words[i]) - n + 1, None


def _windows(lists: list[list[str]], index: Index) -> tuple[list[int], list[int]]:
    owner, starts = [], []
    for z, ws in enumerate(lists):
        own = window_starts(len(ws), index.size, index.stride)
        owner += [z] * len(own)
        starts += own
    return owner, starts


def _minhash_hits(keys: list, lists: list[list[str]], index: Index, memo: _Shingles) -> Iterator[tuple]:
    cfg = index.cfg
    owner, starts = (np.array(x, np.int64) for x in _windows(lists, index))
    if not len(owner) or not len(index.ids):
        return
    hashes = [shingle_hashes(ws, cfg.shingle, memo) for ws in lists]
    count = np.array([len(h) for h in hashes], np.int64)
    base = np.cumsum(count) - count
    words = np.array([len(ws) for ws in lists], np.int64)[owner]
    # shingles of a window: those that lie in it; a shorter text has its words
    per = np.where(words < cfg.shingle, words, np.minimum(index.size, words) - cfg.shingle + 1)
    flat, a = np.concatenate(hashes), base[owner] + starts
    for c in range(0, len(owner), 4000):
        own, at, many = owner[c : c + 4000], a[c : c + 4000], per[c : c + 4000]
        lo, hi = int(at.min()), int((at + many).max())
        sig = signatures_of(flat[lo:hi], at - lo, at + many - lo, cfg.num_perm)
        cells = []
        for key, (known, items) in zip(band_keys(sig, cfg), index.bands):
            x, y = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
            w = np.flatnonzero(y > x)
            n = (y - x)[w]
            pick = np.repeat(x[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cells.append(np.repeat(w, n) * len(index.ids) + items[pick])
        cells = np.unique(np.concatenate(cells))
        w, i = cells // len(index.ids), cells % len(index.ids)
        distinct = {int(x): len(np.unique(flat[at[x] : at[x] + many[x]])) for x in np.unique(w)}
        n_win = np.array([distinct[x] for x in w.tolist()], float)
        j = np.concatenate([(sig[w[k : k + 20_000]] == index.signatures[i[k : k + 20_000]]).mean(1) for k in range(0, len(w), 20_000)]) if len(w) else np.zeros(0)
        part = np.minimum(1.0, j * (index.n_shingles[i] + n_win) / (1 + j) / index.n_shingles[i])
        best: dict[tuple[int, int], float] = {}
        for z, y, v in zip(own[w].tolist(), i.tolist(), part.tolist()):
            if v > best.get((z, y), -1.0):
                best[z, y] = v
        for (z, y), v in best.items():
            yield keys[z], index.ids[y], "minhash", None, None, None, None, v


def _cosine_hits(keys: list, lists: list[list[str]], index: Index) -> Iterator[tuple]:
    """Products go through words: each distinct word meets the items once, windows add up the rows of their words."""
    floor, n_items = 0.75 * index.cfg.cosine_suspicious, len(index.ids)
    owner, starts = _windows(lists, index)
    if not owner or not n_items:
        return
    number: dict[str, int] = {}
    coded = [np.fromiter((-1 if w in STOP else number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)) for ws in lists]
    vocabulary = [index.embedder.vector(w) for w in number]
    sizes = np.array([len(at) for at, _ in vocabulary], np.int64)
    first = np.cumsum(sizes) - sizes
    buckets = np.concatenate([at for at, _ in vocabulary]) if vocabulary else np.zeros(0, np.int64)
    values = np.concatenate([v for _, v in vocabulary]) if vocabulary else np.zeros(0, np.float32)
    step = max(16, min(512, 4_000_000 // max(1, n_items)))
    best: dict[tuple[int, int], float] = {}
    for c in range(0, len(owner), step):
        own, at = owner[c : c + step], starts[c : c + step]
        parts = [coded[z][s : s + index.size] for z, s in zip(own, at)]
        cell = np.repeat(np.arange(len(parts)), [len(x) for x in parts]) * (len(number) + 1) + np.concatenate(parts) + 1
        cell, count = np.unique(cell, return_counts=True)
        w, word = cell // (len(number) + 1), cell % (len(number) + 1) - 1
        w, word, tf = (x[word >= 0] for x in (w, word, (1 + np.log(count)).astype(np.float32)))
        if not len(w):
            continue
        # length of each window: its buckets added up first
        many = sizes[word]
        pick = np.repeat(first[word], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        weight = values[pick] * np.repeat(tf, many)
        at_bucket = np.repeat(w, many) * DIMENSIONS + buckets[pick]
        sums = np.bincount(at_bucket, weight, len(parts) * DIMENSIONS).reshape(len(parts), DIMENSIONS)
        norm = np.sqrt((sums**2).sum(1))
        # each word of this step meets the items once
        words, back = np.unique(word, return_inverse=True)
        met = np.empty((len(words), n_items), np.float32)
        for k in range(0, len(words), 2000):
            group = words[k : k + 2000]
            rows = np.zeros((len(group), DIMENSIONS), np.float32)
            x = np.repeat(first[group], sizes[group]) + np.arange(sizes[group].sum()) - np.repeat(np.cumsum(sizes[group]) - sizes[group], sizes[group])
            np.add.at(rows, (np.repeat(np.arange(len(group)), sizes[group]), buckets[x]), values[x])
            met[k : k + 2000] = rows @ index.matrix
        head = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        dot = np.add.reduceat(met[back.ravel()] * tf[:, None], head, axis=0)
        cos = dot / np.maximum(norm[w[head]], 1e-12)[:, None]
        for r, i in zip(*(x.tolist() for x in np.nonzero(cos >= floor))):
            z, v = own[int(w[head[r]])], float(cos[r, i])
            if v > best.get((z, i), -1.0):
                best[z, i] = v
    for (z, i), v in best.items():
        yield keys[z], index.ids[i], "embedding", None, None, None, None, v


KINDS = ("ngram", "minhash", "embedding")


def scan(docs: DataFrame, items: DataFrame, cfg: ScanConfig = ScanConfig(), kinds: tuple[str, ...] = KINDS, key: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """(doc_id, item_id, kind, doc_pos, pos, n, n_pos, value): for ``ngram`` every shared gram, for ``minhash`` and ``embedding`` the best
    window of each document that is a candidate, by containment and cosine.

    Null and empty texts and items without words have no rows; repeated documents repeat theirs; empty tables give none."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id string, kind string, doc_pos int, pos int, n int, n_pos int, value double"
    rows = spread(rows)
    out = None
    for index in indexes(items, cfg, **names):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own, memo, shingles = shared.value, _Hashes(), _Shingles()
            for pdf in batches:
                keys, lists, at, words, hits = pdf["doc_id"].tolist(), [words_of(t) for t in pdf["text"]], 0, 0, []
                for k in range(len(keys)):  # texts in portions of some 200,000 words
                    words += len(lists[k])
                    if words > 200_000 or k + 1 == len(keys):
                        part = keys[at : k + 1], lists[at : k + 1]
                        if "ngram" in kinds:
                            hits += _gram_hits(*part, own, memo)
                        if "minhash" in kinds:
                            hits += _minhash_hits(*part, own, shingles)
                        if "embedding" in kinds:
                            hits += _cosine_hits(*part, own)
                        at, words = k + 1, 0
                frame = pd.DataFrame(hits, columns=["doc_id", "item_id", "kind", "doc_pos", "pos", "n", "n_pos", "value"])
                yield frame.astype({c: "Int32" for c in ("doc_pos", "pos", "n", "n_pos")})

        found = rows.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def gram_matches(docs: DataFrame, items: DataFrame, cfg: ScanConfig = ScanConfig(), **names) -> DataFrame:
    """(doc_id, item_id, doc_pos, pos, n, n_pos): every shared gram, verified word by word."""
    return matches_of(scan(docs, items, cfg, ("ngram",), **names))


def matches_of(hits: DataFrame) -> DataFrame:
    return hits.where("kind = 'ngram'").select("doc_id", "item_id", "doc_pos", "pos", "n", "n_pos")


def _best(hits: DataFrame, kind: str, name: str, digits: int) -> DataFrame:
    return hits.where(F.col("kind") == kind).groupBy("doc_id", "item_id").agg(F.round(F.max("value"), digits).alias(name))


def minhash_evidence(docs: DataFrame, items: DataFrame, cfg: ScanConfig = ScanConfig(), **names) -> DataFrame:
    """(doc_id, item_id, containment): best estimated containment of the item in a window, from windows that share a band; verified on
    the whole signature."""
    return _best(scan(docs, items, cfg, ("minhash",), **names), "minhash", "containment", 6)


def cosine_evidence(docs: DataFrame, items: DataFrame, cfg: ScanConfig = ScanConfig(), **names) -> DataFrame:
    """(doc_id, item_id, cosine): best cosine of a window and an item from 0.75 times the suspicious level on; idf is fitted on the items."""
    return _best(scan(docs, items, cfg, ("embedding",), **names), "embedding", "cosine", 5)


def other_evidence(hits: DataFrame) -> DataFrame:
    """(doc_id, item_id, overlap, containment, cosine) of what a scan found beside grams."""
    return merge_evidence(_best(hits, "minhash", "containment", 6), _best(hits, "embedding", "cosine", 5))


def gram_evidence(matches: DataFrame) -> DataFrame:
    """Per (doc_id, item_id): hit positions, overlap ratio, longest run on one diagonal (in grams) and its span in words.

    Gaps and islands: on a diagonal doc_pos - pos, pos minus its rank is constant along a run."""
    m = matches.distinct().withColumn("diag", F.col("doc_pos") - F.col("pos"))
    w = Window.partitionBy("doc_id", "item_id", "diag").orderBy("pos")
    runs = m.withColumn("island", F.col("pos") - F.row_number().over(w)).groupBy("doc_id", "item_id", "diag", "island").agg(F.count("*").alias("run"), F.first("n").alias("n"))
    longest = runs.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.first("n").alias("n"))
    hits = m.groupBy("doc_id", "item_id").agg(F.count_distinct("pos").alias("hits"), F.max("n_pos").alias("n_pos"))
    return hits.join(longest, ["doc_id", "item_id"]).select("doc_id", "item_id", "hits", F.round(F.col("hits") / F.col("n_pos"), 6).alias("overlap"), "run", (F.col("run") + F.col("n") - 1).alias("span_words"))


def candidate_probability(jaccard: Column | float, cfg: ScanConfig = ScanConfig()) -> Column:
    """Chance that two sets of this similarity share a band."""
    j = jaccard if isinstance(jaccard, Column) else F.lit(float(jaccard))
    return 1 - F.pow(1 - F.pow(j, F.lit(cfg.rows)), F.lit(cfg.bands))


def top_evidence(evidence: DataFrame, cfg: ScanConfig = ScanConfig(), buckets: int = 64) -> DataFrame:
    """At most ``max_matches`` rows of each item for a report: those with the highest overlap, containment or cosine, ties by document.

    Two steps, so that an item that a third of all documents leak is no single task."""
    score = F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in ("overlap", "containment", "cosine")])
    rows = evidence.withColumns({"score": score, "bucket": F.pmod(F.xxhash64("doc_id"), F.lit(buckets))})
    for by in (["item_id", "bucket"], ["item_id"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= cfg.max_matches)
    return rows.drop("score", "bucket")


# ---- grading -------------------------------------------------------------------------------------------------------
def doc_levels(evidence: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """(doc_id, level, eval_ids): the worst level of each touched document and the items at it, from rows with any of overlap,
    containment, cosine."""
    worst = F.when((F.col("overlap") >= cfg.overlap_contaminated) | (F.col("containment") >= cfg.containment_contaminated) | (F.col("cosine") >= cfg.cosine_contaminated), 2)
    worst = worst.when((F.col("overlap") > 0) | (F.col("containment") >= cfg.containment_suspicious) | (F.col("cosine") >= cfg.cosine_suspicious), 1).otherwise(0)
    graded = evidence.withColumn("l", worst).where("l > 0")
    top = graded.groupBy("doc_id").agg(F.max("l").alias("l"), F.sort_array(F.collect_set(F.when(F.col("l") == 2, F.col("item_id")))).alias("c"), F.sort_array(F.collect_set(F.when(F.col("l") == 1, F.col("item_id")))).alias("s"))
    return top.select("doc_id", F.when(F.col("l") == 2, "contaminated").otherwise("suspicious").alias("level"), F.when(F.col("l") == 2, F.col("c")).otherwise(F.col("s")).alias("eval_ids"))


def merge_evidence(*parts: DataFrame) -> DataFrame:
    cols = ["overlap", "containment", "cosine"]
    out = None
    for p in parts:
        p = p.select("doc_id", "item_id", *[F.col(c).cast("double").alias(c) if c in p.columns else F.lit(None).cast("double").alias(c) for c in cols])
        out = p if out is None else out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in cols])


def grade_items(items: DataFrame, matches: DataFrame, others: DataFrame | None = None, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """Per item: union of the hit positions over all documents, longest run, documents, best other evidence, methods, status."""
    base = _with_n(item_words(items), cfg).select("item_id", "n", F.when(F.col("n") > 0, F.size("words") - F.col("n") + 1).otherwise(0).alias("n_pos"))
    m = matches.select("item_id", "doc_id", "pos")
    hit = m.groupBy("item_id").agg(F.count_distinct("pos").alias("hits"), F.count_distinct("doc_id").alias("n_docs"))
    run = gram_evidence(matches).groupBy("item_id").agg(F.max("run").alias("run"))
    g = base.join(hit, "item_id", "left").join(run, "item_id", "left")
    if others is not None:
        best = others.groupBy("item_id").agg(F.max("containment").alias("containment"), F.min_by("doc_id", F.struct(-F.col("containment"), "doc_id")).alias("containment_doc"), F.max("cosine").alias("cosine"))
        g = g.join(best, "item_id", "left")
    else:
        g = g.withColumns({"containment": F.lit(None).cast("double"), "containment_doc": F.lit(None).cast("long"), "cosine": F.lit(None).cast("double")})
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    overlap = F.when(F.col("n_pos") > 0, z("hits") / F.col("n_pos")).otherwise(0.0)
    bad = (overlap >= cfg.overlap_contaminated) | (z("containment") >= cfg.containment_contaminated) | (z("cosine") >= cfg.cosine_contaminated)
    sus = (z("hits") > 0) | (z("containment") >= cfg.containment_suspicious) | (z("cosine") >= cfg.cosine_suspicious)
    methods = F.array_compact(F.array(F.when(z("hits") > 0, "ngram"), F.when(z("containment") >= cfg.containment_suspicious, "minhash"), F.when(z("cosine") >= cfg.cosine_suspicious, "embedding")))
    return g.select(
        "item_id", F.when(bad, "contaminated").when(sus, "suspicious").otherwise("clean").alias("status"), F.array_join(methods, ",").alias("methods"), "n", F.round(overlap, 6).alias("overlap"),
        F.when(F.col("run").isNotNull(), F.col("run") + F.col("n") - 1).otherwise(0).cast("int").alias("longest_words"), z("n_docs").alias("n_docs"), F.round("containment", 4).alias("containment"), F.round("cosine", 4).alias("cosine"),
    )


def leak_documents(items: DataFrame, key: str = "id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(doc_id, item_id, kind, text): made leaks of every item to measure detectors by. verbatim; light_edit (every ninth word left out);
    half (the first half of the words); answer_only (where there is an answer); reordered (halves exchanged)."""
    w = F.filter(F.split(F.trim(F.coalesce(question, F.lit(""))), r"\s+"), lambda x: x != "")
    half = F.floor((F.size("w") + 1) / 2).cast("int")
    text = lambda words: F.concat(F.lit("Seen today: "), F.array_join(words, " "), F.lit(" That was all."))
    first, second = F.slice("w", 1, half), F.slice("w", half + 1, F.size("w"))
    kinds = {"verbatim": text(F.col("w")), "light_edit": text(F.filter("w", lambda x, k: (k + 1) % 9 != 0)), "half": text(first), "reordered": text(F.concat(second, first)), "answer_only": F.when(F.length(F.trim(answer)) > 0, F.concat(F.lit("Seen today: "), F.col(answer)))}
    rows = items.select(F.col(key).alias("item_id"), w.alias("w"), F.col(answer).alias(answer)).where(F.size("w") > 0)
    rows = rows.select("item_id", F.explode(F.create_map(*[x for k, c in kinds.items() for x in (F.lit(k), c)])).alias("kind", "text")).where("text is not null")
    return rows.select(F.concat("item_id", F.lit("/"), "kind").alias("doc_id"), "item_id", "kind", "text")


def detector_recall(leaks: DataFrame, evidence: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """(kind, n, ngram, minhash, embedding, any, cosine_min, cosine_median, cosine_max): how many of the made leaks of each kind are found on
    their own document by each detector."""
    own = leaks.join(evidence, ["doc_id", "item_id"], "left")
    hit = {"ngram": F.coalesce(F.col("overlap") > 0, F.lit(False)), "minhash": F.coalesce(F.col("containment") >= cfg.containment_suspicious, F.lit(False)), "embedding": F.coalesce(F.col("cosine") >= cfg.cosine_suspicious, F.lit(False))}
    either = hit["ngram"] | hit["minhash"] | hit["embedding"]
    cos = F.coalesce("cosine", F.lit(0.0))
    return own.groupBy("kind").agg(F.count("*").alias("n"), *[F.round(F.avg(c.cast("double")), 6).alias(k) for k, c in {**hit, "any": either}.items()], F.min(cos).alias("cosine_min"), F.round(F.percentile_approx(cos, 0.5, 10_000), 5).alias("cosine_median"), F.max(cos).alias("cosine_max"))


def flagged(grades: DataFrame, limit: int = 200) -> DataFrame:
    """The worst items of a report first: by status, overlap, containment, cosine; at most ``limit``."""
    order = F.when(F.col("status") == "contaminated", 0).when(F.col("status") == "suspicious", 1).otherwise(2)
    none = lambda c: F.desc(F.coalesce(F.col(c), F.lit(0.0)))
    return grades.where("status <> 'clean'").orderBy(order, none("overlap"), none("containment"), none("cosine"), "item_id").limit(limit)


def decontaminate(docs: DataFrame, levels: DataFrame, drop: bool = True) -> DataFrame:
    """Without contaminated documents, or all documents with their level and items."""
    if drop:
        return docs.join(levels.where("level = 'contaminated'").select("doc_id"), "doc_id", "left_anti")
    return docs.join(levels, "doc_id", "left").withColumn("level", F.coalesce("level", F.lit("clean")))
