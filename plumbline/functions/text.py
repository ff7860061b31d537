"""Text expressions: Column -> Column, all inside whole-stage code generation unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalize(text: Column) -> Column:
    """Lower case, letters and digits of any script, single blanks. Null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


@F.pandas_udf(StringType())
def normalize_exact(s: pd.Series) -> pd.Series:
    """NFKC and full case folding, for which Spark has no builtin (Arrow batches)."""
    import re

    gap = re.compile(r"[\W_]+")
    return s.map(lambda t: None if t is None else gap.sub(" ", unicodedata.normalize("NFKC", t).casefold()).strip())


def tokens(text: Column) -> Column:
    """Words of the normalised text; null or blank gives []."""
    return F.filter(F.split(F.coalesce(normalize(text), F.lit("")), " "), lambda t: t != "")


def ascii_words(text: Column) -> Column:
    """[a-z0-9]+ words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def ascii_normalize(text: Column) -> Column:
    return F.array_join(ascii_words(text), " ")


def without_articles(text: Column) -> Column:
    """Lower-case words without a, an, the."""
    return F.array_join(F.filter(ascii_words(text), lambda w: ~w.isin("a", "an", "the")), " ")


def answer_normalize(text: Column) -> Column:
    """Figures lose their group marks; everything but letters, digits and inner points becomes a blank."""
    s = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([0-9])[,_]([0-9])", "$1$2")
    s = F.regexp_replace(s, r"([0-9])[,_]([0-9])", "$1$2")
    s = F.regexp_replace(s, r"[^a-z0-9.]+", " ")
    return F.trim(F.regexp_replace(s, r"\.( |$)", " "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Containment on token borders; an empty phrase is contained nowhere."""
    return (phrase != "") & (F.instr(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" "))) > 0)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once: what a lambda refers to is otherwise evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ngrams(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def ngrams(words: Column, n: int) -> Column:
    """Word n-grams in order, with repeats; [] for shorter lists."""
    return let(words, lambda w: _ngrams(w, n))


def shingles(words: Column, k: int) -> Column:
    """Distinct word k-shingles; of shorter lists the distinct words."""
    return let(words, lambda w: F.when(F.size(w) >= k, F.array_distinct(_ngrams(w, k))).otherwise(F.array_distinct(w)))


def char_shingles(text: Column, k: int = 4) -> Column:
    """Distinct character k-shingles; a shorter text is its own shingle."""
    return let(text, lambda t: F.when(F.length(t) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - k + 1), lambda i: F.substring(t, i, F.lit(k))))).otherwise(F.array(t)))


def windows(words: Column, size: int, stride: int) -> Column:
    """Windows of ``size`` words every ``stride`` words and one at the end; a list of at most ``size`` words is one window."""

    def cut(w: Column) -> Column:
        last = F.size(w) - size + 1
        starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, F.lit(stride)), F.array(last)))
        return F.when(F.size(w) <= size, F.array(w)).otherwise(F.transform(starts, lambda k: F.slice(w, k, size)))

    return let(words, cut)


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct arrays; both empty: 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def whitespace_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""))


def canonical_json(pairs: Column) -> Column:
    """A map as JSON with its keys in order; null gives null."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))
