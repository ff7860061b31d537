"""Broken answers in prompt/response pairs: empty, copy, refusal, language, truncated; at most one per answer, in this order.

* empty: null, blank, markup or punctuation alone, or a filler.
* copy: greedy string tiling of answer and last user turn; the tiles cover nearly all of the answer and most of the turn.
* refusal: every sentence is one that declines or a courtesy, and at least one declines (grammars in four languages).
* language: the languages of turn and answer, by script and by marker words, differ, and the turn asks for no other language.
* truncated: a pushdown parser ends with something open on its stack. Blocks: fences, brackets, quotations, markup, list items.
  Phrases of the last sentence: a determiner, preposition, conjunction, auxiliary or clitic that waits for its head; a leading
  subordinate clause that waits for its comma; a German modal or passive that waits for its verb at the end. Words: the
  last word is none of the corpus' words but the beginning of one. Word pairs of all answers are counted as the parser's lexicon: they
  say which words there are, which content words wait for more (``nobody else is told`` always goes on in this corpus), and an open
  phrase is dropped where its words do end sentences. Counts are reduced within each Arrow batch, then by partial aggregation;
  only the pairs of unfinished answers are looked up, by joins."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .lexicon import ASKS_LANGUAGE, COURTESY, DECLINES, DETERMINERS, FILLER, LANGUAGE_OF, LEADING, MARKERS, MODALS, PARTICLES, PASSIVES, WAITING
from .textnorm import fold, visible

COPY_SHARE, COPY_OF_TURN, COPY_WORDS, TILE = 0.75, 0.5, 4, 2
#: A word pair waits for more if it was seen this often and hardly ever (share of the second number) at an end.
SEEN, ENDS = 5, 0.02
#: Letters of the longest word.
LONGEST = 64

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d[\d.,:]*|[^\s\w]")
_ONLY_WORD = re.compile(r"[^\W_]+")
_TAGS = re.compile(r"<[^<>]*>|&nbsp;|```\w*|[#>*_`|\-]+")
_END = re.compile(r"[.!?…。！？][\"'»”’“)\]*_`]*$")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)]*\s+|\n+")
_EMPTY_ITEM = re.compile(r"(?:^|\n)\s*(?:\d+[.)]|[-*•+])\s*$")
_ROLE = re.compile(r"^(system|user|assistant): ", re.M)


# ---- the last user turn -------------------------------------------------------------------------------------------
def last_turn_of_prompt(prompt: str | None) -> str:
    """Of a prompt written as lines ``role: content`` the content of the last user turn, of any other the whole."""
    if not prompt:
        return ""
    marks = list(_ROLE.finditer(prompt))
    if not marks or marks[0].start() != 0:
        return prompt
    users = [k for k, m in enumerate(marks) if m[1] == "user"]
    if not users:
        return ""
    k = users[-1]
    return prompt[marks[k].end() : marks[k + 1].start() if k + 1 < len(marks) else len(prompt)].strip()


# ---- parts of the classification ----------------------------------------------------------------------------------
def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = _TAGS.sub(" ", visible(answer)).strip().strip(" ()[]{}<>\"'.…-–—_").strip()
    return not bare or bool(FILLER.match(bare))


def tiled(answer: list[str], turn: list[str], least: int = TILE) -> int:
    """Words covered by greedy string tiling: the longest common run of unmarked words first, until none has ``least`` words."""
    used_a, used_b, covered = [False] * len(answer), [False] * len(turn), 0
    places: dict[str, list[int]] = {}
    for j, w in enumerate(turn):
        places.setdefault(w, []).append(j)
    while True:
        best, where = least - 1, []
        for i, w in enumerate(answer):
            if used_a[i]:
                continue
            for j in places.get(w, ()):
                n = 0
                while i + n < len(answer) and j + n < len(turn) and not used_a[i + n] and not used_b[j + n] and answer[i + n] == turn[j + n]:
                    n += 1
                if n > best:
                    best, where = n, [(i, j)]
                elif n == best and n >= least:
                    where.append((i, j))
        if not where:
            return covered
        for i, j in where:
            if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                used_a[i : i + best] = used_b[j : j + best] = [True] * best
                covered += best


@lru_cache(20_000)
def folded_words(text: str) -> tuple[tuple[str, ...], frozenset[str]]:
    words = tuple(_ONLY_WORD.findall(fold(text)))
    return words, frozenset(words)


def is_copy(answer: str, turn: str) -> bool:
    a, (b, known) = _ONLY_WORD.findall(fold(answer)), folded_words(turn)
    own, need = len(b), COPY_SHARE * len(a)
    # tiles cannot cover more words than the turn knows
    if len(a) < COPY_WORDS or not b or need > 2 * own or sum(map(known.__contains__, a)) < max(need, COPY_OF_TURN * own):
        return False
    n = tiled(a, list(b + b if need > own else b))  # the turn may stand there more than once
    return n >= need and n >= COPY_OF_TURN * own


#: A sentence without any of these cannot decline: pieces of all alternatives of the grammar (fixed values).
_TRIGGERS = ("no", "n't", "unable", "nicht", "cannot", "declin", "refus", "pass", "forbid", "prevent", "prohibit", "against", "violates", "denied", "kein", "ablehn", "lehne", "verst", "aucun", "interdit", "pas ", "ne ", "contre", "préf", "dois", "niego", "rechaz", "negar", "prefiero", "contra")


@lru_cache(50_000)
def stance(sentence: str) -> str:
    """``declines``, ``courtesy``, ``nothing`` (no word in it) or ``other``."""
    s = sentence.strip(" -*>\"'“”")
    if not _ONLY_WORD.search(s):
        return "nothing"
    low = s.lower()
    return "declines" if any(t in low for t in _TRIGGERS) and DECLINES.search(s) else "courtesy" if COURTESY.match(s) else "other"


def is_refusal(answer: str) -> bool:
    """Every sentence declines or is a courtesy, and one at least declines."""
    declines = False
    for m in _ONE.finditer(visible(answer)):
        text = " ".join(m[0].replace("’", "'").split())
        if "w/" in text or "cant" in text:
            text = re.sub(r"\bw/", "with", re.sub(r"\bcant\b", "can't", text))
        kind = stance(text)
        if kind == "other":
            return False
        declines |= kind == "declines"
    return declines


_ONE = re.compile(r"\S.*?(?:[.!?](?=\s)|$)", re.S)
_FOREIGN = re.compile(r"[^\x00-\u036f]")
_SIGNS = {c: lang for lang, signs in (("es", "ñ¿¡"), ("de", "äöüß"), ("fr", "çœêèùà")) for c in signs}


def language(text: str, least: int = 2) -> str | None:
    """Language by marker words (``least`` more than of any other), or the script where that is not Latin."""
    ws = _ONLY_WORD.findall(text.lower())
    ascii_only = text.isascii()
    if not ascii_only and _FOREIGN.search(text):
        foreign = [w for w in ws if _FOREIGN.search(w)]
        if len(foreign) > 0.5 * len(ws):
            c = ord(_FOREIGN.search(foreign[0])[0])
            return "greek" if c < 0x400 else "cyrillic" if c < 0x530 else "hebrew" if c < 0x600 else "arabic" if c < 0x780 else "cjk" if 0x2E80 <= c < 0xA000 else "script"
    score = dict.fromkeys(MARKERS, 0.0)
    for own in filter(None, map(LANGUAGE_OF.get, ws)):
        for lang in own:
            score[lang] += 1 / len(own)
    if not ascii_only:
        signs = Counter(_SIGNS[c] for c in text if c in _SIGNS)
        for lang, n in signs.items():
            score[lang] += 0.5 * min(2, n)
    (lang, top), (_, second) = sorted(score.items(), key=lambda x: -x[1])[:2]
    return None if top < least or (second > 0 and top < 1.5 * second + 0.5) else lang


turn_language = lru_cache(20_000)(language)


def is_other_language(answer: str, turn: str) -> bool:
    b = turn_language(turn)
    if b is None:
        return False
    a = language(answer)
    return a is not None and a != b and not ASKS_LANGUAGE.search(turn)


_PAIRS = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
_BLOCKS = {"ul", "ol", "pre", "code", "table", "div", "b", "i", "em", "strong", "p", "li", "td", "tr", "blockquote"}
_TAG = re.compile(r"<(/?)([a-zA-Z]+)[^<>]*?(/?)>")


def open_end(answer: str) -> bool:
    """Block level of the pushdown parser: is a fence, a bracket, a quotation, an element, a tag or a list item open at the end?"""
    text = without_dots(answer)
    fences = [m.start() for m in re.finditer(r"(?m)^\s*```|```\s*$|```", text)]
    if len(fences) % 2:
        return True
    if _EMPTY_ITEM.search(text) or text.endswith((",", ";", ":", " -", " –", "--", "(", "[", "{", "=", "+", " &", "/")):
        return True
    bare = re.sub(r"```.*?```", " ", text, flags=re.S)
    tail = bare[max(0, bare.rfind("\n\n")) :]
    if _END.search(tail):  # a complete sentence; a bracket left open in it is a slip
        return False
    if tail.count("`") % 2 or re.search(r"<[a-zA-Z/][^<>]*$", tail):
        return True
    elements: list[str] = []
    for close, name, alone in _TAG.findall(bare):
        name = name.lower()
        if name not in _BLOCKS or alone:
            continue
        if not close:
            elements.append(name)
        elif name in elements:
            while elements.pop() != name:
                pass
    if any(e not in ("p", "li", "td", "tr") for e in elements):
        return True
    stack: list[tuple[str, int]] = []
    quote = -1
    for k, c in enumerate(tail):
        if c in "([{«“":
            stack.append((c, k))
        elif c == "”" or c in ")]}»":
            if stack and stack[-1][0] == _PAIRS[c]:
                stack.pop()
            elif any(s[0] == _PAIRS[c] for s in stack):
                while stack and stack.pop()[0] != _PAIRS[c]:
                    pass
        elif c == "„":
            stack.append(("“", k))
        elif c == '"' and (quote >= 0 or not (k and tail[k - 1].isdigit())):
            quote = k if quote < 0 else -1
    last = [s[1] for s in stack if s[0] != "“" or "”" in tail or s[1] > len(tail) - 80] + ([quote] if quote >= 0 else [])
    # what was opened must be near: no complete sentence may have ended since on a line of its own
    return any("\n" not in tail[k:] or "{" in tail[k : k + 1] or "[" in tail[k : k + 1] for k in last)


def kinds_of(words: list[str]) -> list[str]:
    """Words in lower case, numbers as #, capitalised words that do not begin the sentence as <C>, strings too long for words as <L>; marks
    other than , > left out."""
    out: list[str] = []
    for w in words:
        c = w[0]
        if c.isalpha():
            out.append("<L>" if len(w) > LONGEST else "<C>" if out and c.isupper() else w.lower())
        elif c.isdigit():
            out.append("#")
        elif c in ",>":
            out.append(w)
    return out


#: Addresses, paths and words that mix letters and digits (ids, traces).
_NO_WORD = re.compile(r"[@\\]|https?:|\d\D*[^\W\d]|[^\W\d]\D*\d")
_ITEM = re.compile(r"\s*(?:\d+[.)]|[-*•+])\s+\S|.*\S > \S")


_DOTS = re.compile(r"(?:\.{2,}|…)[\"'»”’)\]]*$")


def without_dots(answer: str) -> str:
    """The visible text without trailing dots that say that it breaks off."""
    return _DOTS.sub("", visible(answer).rstrip()).rstrip()


_PARTS = re.compile(r"[^\W\d_]+['’]|[^\W\d_]+|\d[\d.,:]*|[^\s\w]")


def waits_for(sentence: str) -> str | None:
    """Phrase level of the pushdown parser: what is on top of the stack at the end of the sentence, if anything.

    ``det``, ``head``: a determiner or another word that needs one after it; ``clause``: a leading subordinate clause without its comma; ``verb``: a German
    clause whose modal or passive has not found its verb."""
    words = _PARTS.findall(sentence)
    parts = [w.lower() for w in words]
    stack: list[str] = []
    for k, w in enumerate(parts):
        if w in ",;:–":
            while stack and stack[-1] != "verb":
                stack.pop()
            continue
        while stack and stack[-1] in ("det", "head"):
            stack.pop()
        if stack and stack[-1] == "verb" and words[k][0].islower() and len(w) > 3 and w.endswith(("en", "ern", "eln", "t")) and w not in WAITING:
            stack.pop()
        if w in LEADING and not any(x.isalpha() for x in parts[:k] if x not in ("and", "und", "et", "y", "but", "aber", "mais", "pero")):
            stack.append("clause")
        if w in MODALS or w in PASSIVES:
            stack.append("verb")
        elif w in DETERMINERS or w[-1] in "'’":
            stack.append("det")
        elif w in WAITING and not (w in PARTICLES and k and parts[k - 1] in ("it", "them", "log", "sign", "turn", "switch", "move", "go")):
            stack.append("head")
    return stack[-1] if stack else None


def unfinished(answer: str) -> tuple[str, str, bool, str | None] | None:
    """The last word pair of an answer whose last sentence has no end mark; ``<s>`` stands for the beginning.

    Then a flag, whether it is a list item or a menu path, which need no end mark; and what the parser still waits for."""
    text = without_dots(answer)
    if not text or _END.search(text):
        return None
    last = _SENTENCE.split(text)[-1]
    words = _WORD.findall(last)
    ts = kinds_of(words)
    if not ts or any(_NO_WORD.search(w) for w in last.split()[-2:]):
        return None
    first, second = (ts[-2] if len(ts) > 1 else "<s>"), ts[-1]
    word = words[-1]
    if word[0].isupper() and (second == "<C>" or first == "<s>"):  # of such a word only the word itself can be looked up
        first, second = "<w>", word.lower()
    return first, second, bool(_ITEM.match(text.split("\n")[-1])), waits_for(last)


def pair_counts(answers: list[str | None]) -> Counter[tuple[str, str, bool]]:
    """Word pairs (first, second, at an end?) of all complete sentences and of the inner part of incomplete ones; with first ``<w>``
    their capitalised words."""
    sentences: Counter[tuple[str, bool]] = Counter()
    for a in answers:
        if a:
            parts = _SENTENCE.split(visible(a))
            sentences.update((s, True) for s in parts[:-1])
            sentences[parts[-1], bool(_END.search(parts[-1].rstrip()))] += 1
    out: Counter[tuple[str, str, bool]] = Counter()
    for (s, whole), n in sentences.items():
        words = _WORD.findall(s)
        ts = ["<s>", *kinds_of(words)]
        if len(ts) == 1:
            continue
        whole = whole and not _DOTS.search(s.rstrip())
        # the very last pair of an unfinished text says nothing: its second word may be cut
        for i in range(1, len(ts) - (0 if whole else 1)):
            out[ts[i - 1], ts[i], whole and i == len(ts) - 1] += n
        for w in words if whole else words[:-1]:
            if w[0].isupper() and len(w) <= LONGEST:
                out["<w>", w.lower(), False] += n
    return out


# ---- the operator --------------------------------------------------------------------------------------------------
def simple_defect(turn: Column, answer: Column) -> Column:
    @F.pandas_udf("defect string, first string, second string, item boolean, waits string")
    def classify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for turns, answers in batches:
            rows: list[tuple] = []
            for q, a in zip(turns.tolist(), answers.tolist()):
                q, a = q or "", None if a is None else visible(a)
                if is_empty(a):
                    rows.append(("empty", None, None, None, None))
                elif is_copy(a, q):
                    rows.append(("copy", None, None, None, None))
                elif is_refusal(a):
                    rows.append(("refusal", None, None, None, None))
                elif is_other_language(a, q):
                    rows.append(("language", None, None, None, None))
                elif open_end(a):
                    rows.append(("truncated", None, None, None, None))
                else:
                    rows.append((None, *(unfinished(a) or (None,) * 4)))
            yield pd.DataFrame(rows, columns=["defect", "first", "second", "item", "waits"])

    return classify(turn, answer)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(a, b, e, n) for (a, b, e), n in pair_counts(pdf["answer"].tolist()).items()]
        yield pd.DataFrame(rows, columns=["first", "second", "end", "n"])


def find_defects(answers: DataFrame) -> DataFrame:
    """(table_name, row_id, field, defect) of the defective ones among (table_name, row_id, field, turn, answer).

    A null or empty turn allows no copy or language defect. Repeated rows give one row; of rows with one key but several contents,
    each is judged. Rows with a null row_id are left out. Empty tables: empty result."""
    rows = answers.where(F.col("row_id").isNotNull())  # repeated rows are judged again and merged at the end, which spares a shuffle of all texts
    judged = cut_lineage(rows.select("table_name", "row_id", "field", simple_defect(F.col("turn"), F.col("answer")).alias("d")).select("table_name", "row_id", "field", "d.*"))
    counts = answers.select("answer").where(F.length("answer") > 0).mapInPandas(_count, "first string, second string, end boolean, n long")
    pairs = cut_lineage(counts.groupBy("first", "second").agg(F.sum(F.when(F.col("end"), F.col("n")).otherwise(0)).alias("ends"), F.sum(F.when(F.col("end"), 0).otherwise(F.col("n"))).alias("goes_on")))
    # how often a longer word begins with these letters after the first word
    size = F.length("second")
    begins = pairs.where(F.col("second").rlike(r"^\p{L}{2,}$")).select("first", F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.substring("second", F.lit(1), k))).alias("second"), (F.col("ends") + F.col("goes_on")).alias("n"))
    loose = judged.where(F.col("defect").isNull() & F.col("first").isNotNull())
    wanted = loose.select("first", "second").distinct()
    begun = begins.join(wanted, ["first", "second"], "left_semi").groupBy("first", "second").agg(F.sum("n").alias("begins"))
    wanted = wanted.join(pairs, ["first", "second"], "left").join(begun, ["first", "second"], "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    ends, on, begin = none("ends"), none("goes_on"), none("begins")
    wanted = wanted.select("first", "second", ((ends + on == 0) & (begin > 0)).alias("no_word"), (ends > on).alias("usual"), ((on + begin >= SEEN) & (ends <= ENDS * (on + begin))).alias("goes_on"))
    # a list item or a menu path may end with anything but a determiner or a word that is only the beginning of one
    phrase = F.col("waits").isNotNull() & ~F.col("usual") & (~F.col("item") | (F.col("waits") == "det"))
    lexical = F.col("goes_on") & ~F.col("item") & (F.col("first") != "<w>")
    truncated = loose.join(wanted, ["first", "second"]).where(F.col("no_word") | phrase | lexical).select("table_name", "row_id", "field", F.lit("truncated").alias("defect"))
    return judged.where(F.col("defect").isNotNull()).select("table_name", "row_id", "field", "defect").unionByName(truncated).distinct()


def answers_of(pairs: DataFrame, feedback: DataFrame) -> DataFrame:
    """The answers of both tables with the user turn that they answer. Feedback without a user turn has an empty one."""
    turn = F.pandas_udf(lambda s: s.map(last_turn_of_prompt), "string")
    p = pairs.select(F.lit("pairs").alias("table_name"), F.col("pair_id").alias("row_id"), turn("prompt").alias("turn"), F.explode(F.array(F.struct(F.lit("chosen").alias("field"), F.col("chosen").alias("answer")), F.struct(F.lit("rejected").alias("field"), F.col("rejected").alias("answer")))).alias("x"))
    p = p.select("table_name", "row_id", "x.field", "turn", "x.answer")
    users = F.filter("messages", lambda m: (m.role == "user"))
    last = F.coalesce(F.try_element_at(users, F.lit(-1)).content, F.lit(""))
    f = feedback.select(F.lit("feedback_day1").alias("table_name"), F.col("event_id").alias("row_id"), F.lit("response").alias("field"), last.alias("turn"), F.col("response").alias("answer"))
    return p.unionByName(f)
