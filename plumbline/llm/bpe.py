"""Byte-level BPE encoding: speculate by greedy longest match, verify adjacent pairs, merge exactly where that fails.

A sequence of vocabulary tokens is what BPE gives for its bytes iff every token encodes to itself and no merge ever crosses
the border of two neighbours. While two neighbours are built up byte by byte, the left one shows a chain of ever larger
tokens at its right edge, the right one at its left edge; each of them lives from its own rank to that of the next. A
crossing merge happens iff two of them live at the same time and their pair has a rank below the end of the left one and not
above the end of the right one (of equal ranks the leftmost merge comes first). The test walks both chains at once for
all new pairs of a batch in numpy. Verified pairs and finished words are remembered per worker."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEVER = 1 << 40
#: Words kept per worker; beyond it the memory starts anew.
WORDS_KEPT = 300_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k in the installed package of public vocabularies."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


#: The public pattern that splits text before the merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Bpe:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.longest = max(map(len, self.ranks))
        self.find = regex.compile(PATTERN).findall
        size = max(self.ranks.values()) + 1
        # the two parts whose merge made each token: the last merge of its exact encoding without itself
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.own = np.zeros(size, bool)
        keys, made = [], []
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.own[rank] = True
                continue
            parts = self.merge(token, below=rank)
            if len(parts) == 2:
                self.left[rank], self.right[rank] = parts
                self.own[rank] = True
                keys.append(parts[0] * size + parts[1])
                made.append(rank)
        order = np.argsort(keys)
        self.size, self.pair_keys, self.pair_ranks = size, np.asarray(keys, np.int64)[order], np.asarray(made, np.int64)[order]
        # the token that takes a given one over at the right (left) edge depends on the whole; spines are read top-down
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, word: bytes, below: int = NEVER) -> list[int]:
        """Exact merging: the lowest rank first, of equal ones the leftmost, until no pair of rank below ``below`` is left."""
        parts = [word[k : k + 1] for k in range(len(word))]
        get = self.ranks.get
        while len(parts) > 1:
            found = [get(parts[k] + parts[k + 1], NEVER) for k in range(len(parts) - 1)]
            low = min(found)
            if low >= below:
                break
            k = found.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does no merge cross their border?"""
        x, y = a.copy(), b.copy()  # the edge tokens alive, from the full ones backwards in time
        end_x, end_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        good, live = np.ones(len(a), bool), np.ones(len(a), bool)
        while live.any():
            m = self.pair_rank(x, y)
            good &= ~(live & (m < end_x) & (m <= end_y))
            live &= good
            # step back over the later birth of the two; a single byte was there from the start
            birth_x, birth_y = np.where(self.right[x] >= 0, x, -1), np.where(self.left[y] >= 0, y, -1)
            live &= (birth_x >= 0) | (birth_y >= 0)
            back_x = live & (birth_x >= birth_y)
            # of the same rank on both sides the left one merged first, so the right one is undone first
            back_x &= ~((birth_x == birth_y) & (birth_y >= 0))
            back_y = live & ~back_x
            end_x, x = np.where(back_x, x, end_x), np.where(back_x, self.right[x], x)
            end_y, y = np.where(back_y, y, end_y), np.where(back_y, self.left[y], y)
        return good

    def guess(self, word: bytes) -> list[int]:
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        out, at, n, get = [], 0, len(word), self.ranks.get
        while at < n:
            for to in range(min(n, at + self.longest), at, -1):
                if (t := get(word[at:to])) is not None:
                    out.append(t)
                    at = to
                    break
        return out

    def learn(self, words: set[str]) -> None:
        """Encodes new words: greedy guesses, one vectorised check of all their new pairs, exact merging of the rest."""
        if len(self.words) + len(words) > WORDS_KEPT:
            self.words.clear()
        raw = {w: w.encode("utf-8", "surrogatepass") for w in words}
        guesses = {w: self.guess(b) if len(b) < 2000 else [] for w, b in raw.items()}
        new = list({p for g in guesses.values() for p in zip(g, g[1:]) if p not in self.pairs})
        if len(self.pairs) + len(new) > 4 * WORDS_KEPT:
            self.pairs.clear()
            new = list({p for g in guesses.values() for p in zip(g, g[1:])})
        if new:
            a, b = np.array(new, np.int64).T
            self.pairs.update(zip(new, self.compatible(a, b).tolist()))
        for w, g in guesses.items():
            fits = g and all(self.own[t] for t in g) and all(self.pairs[p] for p in zip(g, g[1:]))
            self.words[w] = g if fits else self.merge_long(raw[w])

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merging for words of any length: a heap of ranks over a linked list, n log n."""
        if len(word) < 200:
            return self.merge(word)
        import heapq

        part = [word[k : k + 1] for k in range(len(word))]
        nxt, prev = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(r, k, 2) for k in range(len(part) - 1) if (r := self.ranks.get(part[k] + part[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, length = heapq.heappop(heap)
            if part[k] is None or nxt[k] >= len(part) or len(part[k]) + len(part[nxt[k]]) != length or self.ranks.get(part[k] + part[nxt[k]]) != r:
                continue
            other = nxt[k]
            part[k] += part[other]
            part[other], nxt[k] = None, nxt[other]
            if nxt[k] < len(part):
                prev[nxt[k]] = k
            for s in (prev[k], k):
                if s >= 0 and nxt[s] < len(part) and (t := self.ranks.get(part[s] + part[nxt[s]])) is not None:
                    heapq.heappush(heap, (t, s, len(part[s]) + len(part[nxt[s]])))
        return [self.ranks[p] for p in part if p is not None]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.find(t) if t else [] for t in texts]
        fresh = {w for s in split for w in s if w not in self.words}
        if fresh:
            self.learn(fresh)
            fresh = {w for s in split for w in s if w not in self.words}  # the memory may have started anew
            if fresh:
                self.learn(fresh)
        known = self.words
        return [[t for w in s for t in known[w]] for s in split]


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def token_ids(text: Column | str, path: str | None = None) -> Column:
    """array<int>: the ids of a text without special tokens, whose strings are ordinary text. Null and empty texts: []."""
    path = path or default_vocabulary()

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for s in batches:
            texts = s.tolist()
            out: list[list[int]] = []
            for k in range(0, len(texts), 500):
                out += bpe.encode_batch(texts[k : k + 500])
            yield pd.Series(out, dtype=object)

    return encode(text)


def token_count(text: Column | str, path: str | None = None) -> Column:
    """Number of ids, without sending the ids back to the JVM."""
    path = path or default_vocabulary()

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for s in batches:
            texts = s.tolist()
            yield pd.Series([len(x) for k in range(0, len(texts), 500) for x in bpe.encode_batch(texts[k : k + 500])], dtype="int32")

    return count(text)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``; no shuffle. Repeated rows stay as they are."""
    return docs.select(F.col(key), token_ids(F.col(text), path).alias("ids"))
