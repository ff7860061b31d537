"""Passages of held-out evaluation items inside training texts: winnowing, join of fingerprints, extension of the hits.

Words (folded, without markup) are hashed; of each window of WINDOW consecutive K-gram hashes the smallest is kept, so any
shared run of K + WINDOW - 1 words gives a common fingerprint. Every document/passage pair with one is a candidate. A hit is
extended to the region that the passage would take there, and the words of the passage are aligned with it in their
order (longest common subsequence, words one typing error apart count as equal). A passage is leaked if at least SHARE of its
words are there, and of its own words (those that few other passages have: names, numbers) at least OWN_SHARE; or if a stretch
of it has SHARE of all its words there, and of the stretch's own words, there or replaced by others, at least OWN_STRETCH.
The conditions on own words tell an item from one built alike on other names; those outside the stretch do not count.

The evaluation side is small and its size is checked: items of up to ``broadcast_limit`` words are sent to the executors and
documents are scanned in one pass without a shuffle. More items are cut into blocks of that size, one scan each; which words are
rare is counted over all items first. No join by fingerprint: items are built alike, so one hash can stand in very many."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .textnorm import fold, visible

K, WINDOW = 3, 2
SHARE, OWN_SHARE, OWN_STRETCH = 0.5, 0.4, 0.6
#: Answers need this many words; questions count whatever their length.
ANSWER_WORDS = 10
#: A word is a passage's own if at most so many passages' items have it.
OWN_ITEMS = 2

_TAG = re.compile(r"<[^<>\n]{0,200}>")
_WORD = re.compile(r"[^\W_]+")
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def words(text: str) -> list[str]:
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(fold(text))


def named(text: str, folded: list[str]) -> list[bool]:
    """Which words look like names or numbers: a capital that does not begin the text, or a digit."""
    if "&" in text:
        text = html.unescape(text)
    raw = _WORD.findall(unicodedata.normalize("NFKC", visible(_TAG.sub(" ", text))))
    if len(raw) != len(folded):
        return [any(c.isdigit() for c in w) for w in folded]
    return [any(c.isdigit() for c in w) or (k > 0 and w[0].isupper() and not w.isupper()) for k, w in enumerate(raw)]


@lru_cache(400_000)
def _code(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def fingerprints(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, position, hash) of the winnowed K-grams of each word list. Lists of K words or more have at least one."""
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((_code(w) for x in lists for w in x), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(lists)), sizes)
    n = len(flat) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = sum(flat[k : n + k] * _MULT[k] for k in range(K))
    gram = (gram ^ (gram >> np.uint64(29))) * _MULT[1]
    whole = owner[:n] == owner[K - 1 :]
    at = np.flatnonzero(whole)
    gram, own = gram[at], owner[:n][at]
    starts = np.cumsum(sizes) - sizes
    # the smallest of each window of consecutive grams of the same list; shorter lists are one window
    best = np.arange(len(gram))
    for step in range(1, WINDOW):
        nxt = np.minimum(np.arange(len(gram)) + step, len(gram) - 1)
        better = (own[nxt] == own) & (gram[nxt] < gram[best])
        best = np.where(better, nxt, best)
    # windows that would run over the end of their list belong to the last full one
    end = np.minimum(np.arange(len(gram)) + WINDOW - 1, len(gram) - 1)
    first = np.r_[True, own[1:] != own[:-1]]
    pick = np.unique(best[(own[end] == own) | first])
    return own[pick], at[pick] - starts[own[pick]], gram[pick]


def _near(a: str, b: str) -> bool:
    """Equal, or one typing error (a letter more, less, other, or two exchanged) in words of four letters or more."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if min(n, m) < 3 or abs(n - m) > 1 or a.isdigit() or b.isdigit() or (max(n, m) < 4 and sorted(a) != sorted(b)):
        return False
    k = 0
    while k < min(n, m) and a[k] == b[k]:
        k += 1
    if n == m:
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k + 1 :] == b[k:] if n > m else a[k:] == b[k + 1 :]


def places(passage: list[str], region: list[str]) -> list[set[int]]:
    """For each word of the passage the positions in the region where it stands, if nowhere exactly, with a typing error."""
    known: dict[str, set[int]] = {}
    for k, w in enumerate(region):
        known.setdefault(w, set()).add(k)
    words_there = list(known)
    for w in passage:
        if w not in known:
            known[w] = {k for r in words_there if _near(w, r) for k in known[r]}
    return [known[w] for w in passage]


def alignment(hits: list[set[int]], size: int, own: list[bool]) -> list[tuple[int, int]]:
    """(position in passage, in region) of a longest common subsequence (most own words on ties)."""
    rows = [[(0, 0)] * (size + 1)]  # rows[i][j]: matches, own ones, of passage[:i] within region[:j]
    for hit, mine in zip(hits, own):
        last = rows[-1]
        if not hit:
            rows.append(last)
            continue
        new, own_gain = last[:], int(mine)
        for j in range(1, size + 1):
            if j - 1 in hit:
                x = (last[j - 1][0] + 1, last[j - 1][1] + own_gain)
                if x > new[j]:
                    new[j] = x
            if new[j - 1] > new[j]:
                new[j] = new[j - 1]
        rows.append(new)
    out: list[tuple[int, int]] = []
    i, j = len(hits), size
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def aligned(passage: list[str], region: list[str], own: list[bool]) -> tuple[int, int]:
    """Words of the passage, and own words among them, in a longest common subsequence with the region (most own words on ties)."""
    pairs = alignment(places(passage, region), len(region), own)
    return len(pairs), sum(own[i] for i, _ in pairs)


def has_own_stretch(pairs: list[tuple[int, int]], own: list[bool], least: float) -> bool:
    """Has a stretch of at least ``least`` aligned words OWN_STRETCH of its own words, against those replaced by others in it?

    Own words that are only left out do not count against it. A stretch without own words may be anyone's."""
    there, replaced = [0], [0]  # up to each aligned word
    for k, (i, j) in enumerate(pairs):
        gap = min(sum(own[pairs[k - 1][0] + 1 : i]), j - pairs[k - 1][1] - 1) if k else 0
        there.append(there[-1] + own[i])
        replaced.append(replaced[-1] + gap)
    for a in range(len(pairs)):
        for b in range(max(a, ceil(least) + a - 1), len(pairs)):
            have, lost = there[b + 1] - there[a], replaced[b + 1] - replaced[a + 1]
            if have and have >= OWN_STRETCH * (have + lost):
                return True
    return False


class Index:
    """Passages of the evaluation items with their fingerprints."""

    def __init__(self, rows: list[tuple[str, str | None, str | None]]) -> None:
        self.ids: list[str] = []
        self.passages: list[list[str]] = []
        self.named: list[list[bool]] = []
        spread: Counter[str] = Counter()
        for key, question, answer in rows:
            q, a = words(question or ""), words(answer or "")
            spread.update({*q, *a})
            for p, text in ([(q, question)] if q else []) + ([(a, answer)] if len(a) >= ANSWER_WORDS else []):
                self.ids.append(key)
                self.passages.append(p)
                self.named.append(named(text, p))
        self.set_own({w for w, n in spread.items() if n <= OWN_ITEMS})
        owner, at, code = fingerprints(self.passages)
        order = np.argsort(code, kind="stable")
        self.code, self.owner, self.at = code[order], owner[order], at[order]

    def set_own(self, rare: set[str]) -> None:
        """A passage's own words: the rare ones that look like names or numbers; where these are fewer than two, all rare ones."""
        self.own = []
        for p, n in zip(self.passages, self.named):
            own = [w in rare and x for w, x in zip(p, n)]
            self.own.append(own if sum(own) >= 2 else [w in rare for w in p])

    def leaked(self, lists: list[list[str]]) -> list[tuple[int, str]]:
        """(list, item id) of the leaks in these word lists."""
        if not len(self.code):
            return []
        owner, at, code = fingerprints(lists)
        low, high = np.searchsorted(self.code, code, "left"), np.searchsorted(self.code, code, "right")
        hit = np.flatnonzero(high > low)
        starts: dict[tuple[int, int], list[int]] = {}
        for h in hit.tolist():
            for k in range(low[h], high[h]):
                p = int(self.owner[k])
                starts.setdefault((int(owner[h]), p), []).append(int(at[h]) - int(self.at[k]))
        found = {(d, self.ids[p]) for (d, p), s in starts.items() if self.holds(p, lists[d], s)}
        return sorted(found)

    def holds(self, p: int, text: list[str], starts: list[int]) -> bool:
        passage, own = self.passages[p], self.own[p]
        n = len(passage)
        done = -1
        for s in sorted(starts):  # the passage would start here; some words more or less have been put in or left out
            low, high = max(0, s - n // 2), min(len(text), s + n + n // 2 + 4)
            if low <= done:
                low = max(0, done - n)
            region = text[low:high]
            done = high
            hits = places(passage, region)
            if sum(map(bool, hits)) < SHARE * n:
                continue
            pairs = alignment(hits, len(region), own)
            if len(pairs) >= SHARE * n and (sum(own[i] for i, _ in pairs) >= OWN_SHARE * sum(own) or has_own_stretch(pairs, own, SHARE * n)):
                return True
        return False


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "id", question: str = "question", answer: str = "answer", broadcast_limit: int = 200_000) -> DataFrame:
    """Distinct (doc_id, item_id) such that the document leaks the item.

    Null and empty texts, items without words: no leaks. Repeated documents or items: one row. Empty tables: empty result."""
    docs = docs.select(F.col(doc_key).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id string"
    items = items.select(F.col(item_key).cast("string").alias("item_id"), F.col(question).alias("q"), F.col(answer).alias("a")).where(F.col("item_id").isNotNull())
    # an upper bound of the fingerprints: the words of the passages
    size = items.agg(F.sum(F.size(F.split(F.coalesce("q", F.lit("")), r"\s+")) + F.size(F.split(F.coalesce("a", F.lit("")), r"\s+")))).first()[0] or 0
    parts = [_scan(docs, index, schema) for index in _indexes(items, ceil(size / max(50, broadcast_limit)))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _scan(docs: DataFrame, index: Index, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for pdf in batches:
            keys, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            out: list[tuple] = []
            for k in range(0, len(keys), 300):
                out += [(keys[k + d], i) for d, i in own.leaked([words(t) for t in texts[k : k + 300]])]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    return docs.mapInPandas(scan, schema)


def _indexes(items: DataFrame, blocks: int) -> Iterator[Index]:
    """The items as one index, or as several of bounded size."""
    if blocks <= 1:
        yield Index(sorted(map(tuple, items.distinct().collect()), key=repr))
        return

    @F.pandas_udf("array<string>")
    def word_set(s: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(words(t))) if t else [] for t in s], dtype=object)

    items = cut_lineage(items.distinct().withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))))
    has = cut_lineage(items.select("item_id", "block", F.explode(F.array_union(word_set("q"), word_set("a"))).alias("w")))
    rare = cut_lineage(has.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") <= OWN_ITEMS).select("w"))
    for b in range(blocks):
        index = Index(sorted((tuple(r) for r in items.where(F.col("block") == b).select("item_id", "q", "a").collect()), key=repr))
        index.set_own({r.w for r in has.where(F.col("block") == b).select("w").distinct().join(rare, "w", "left_semi").collect()})
        yield index
