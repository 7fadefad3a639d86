"""Functions that Spark has no expression for, in Arrow batches."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
HEADING_WORDS = "MATERIALS METHODS INTRODUCTION RESULTS DISCUSSION CONCLUSION CONCLUSIONS BACKGROUND ACKNOWLEDGEMENTS ACKNOWLEDGEMENT ACKNOWLEDGMENTS ACKNOWLEDGMENT CONFLICT INTEREST AUTHORSHIP REFERENCES ABSTRACT FUNDING DISCLOSURE PATIENTS CASE REPORT SUMMARY OBJECTIVE OBJECTIVES LIMITATIONS FIGURE TABLE AND OF THE".split()
GRAM_WEIGHT = 0.35
UNKNOWN_COST = 10

_WORD = re.compile(r"[^\W_]+")


def _normal(text: str) -> str:
    return re.sub(r"[ \t]+", " ", unicodedata.normalize("NFKC", text)).strip()


def norm_text(text: Column) -> Column:
    """Compatibility forms composed (NFKC), blanks and tabs collapsed, none at the ends."""
    return F.pandas_udf(lambda s: s.map(_normal, na_action="ignore"), "string")(text)


def pieces(text: str, words: frozenset[str], unknown: bool = True) -> list[str] | None:
    """The fewest words of a dictionary that make up the text; a stretch of none costs UNKNOWN_COST and its length. None if
    there is no way without such a stretch and `unknown` is false."""
    n, longest = len(text), max(map(len, words), default=1)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * n
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            if text[i:j] in words and best[i][0] + 1 < best[j][0]:
                best[j] = (best[i][0] + 1, i)
        if unknown:
            for i in range(j):
                if best[i][0] + UNKNOWN_COST + (j - i) < best[j][0]:
                    best[j] = (best[i][0] + UNKNOWN_COST + (j - i), i)
    if best[n][0] == math.inf:
        return None
    out, j = [], n
    while j:
        out.append(text[best[j][1] : j])
        j = best[j][1]
    return out[::-1]


def _despaced(title: str, words: frozenset[str]) -> str:
    s = " ".join(title.split())
    if any(c.islower() for c in s) or " " not in s:
        return s
    return " ".join(pieces(s.replace(" ", ""), words, False) or [s])


def despace_heading(title: Column, vocabulary: list[str] | None = None) -> Column:
    """Capitals set apart (M ETH O DS) joined to words, where the whole heading is made of words of the vocabulary."""
    words = frozenset(vocabulary or HEADING_WORDS)
    return F.pandas_udf(lambda s: s.map(partial(_despaced, words=words), na_action="ignore"), "string")(title)


def _slot(kind: str, token: str, dim: int) -> tuple[int, float]:
    h = int.from_bytes(hashlib.blake2b(f"{kind}:{token}".encode("utf-8", "replace"), digest_size=8).digest(), "big")
    return h % dim, 1.0 if (h // dim) & 1 else -1.0


def hashed(text: str | None, dim: int, known: dict) -> np.ndarray:
    """A vector of length 1 of the words and runs of three characters of a text, each with 1 + ln of its count at a place and
    with a sign given by its hash; zero for no text."""
    out = np.zeros(dim)
    t = _normal(text or "").lower()
    for kind, tokens, weight in (("w", _WORD.findall(t), 1.0), ("g", (t[i : i + 3] for i in range(len(t) - 2)), GRAM_WEIGHT)):
        for token, n in Counter(tokens).items():
            at = known.get((kind, token))
            if at is None:
                if len(known) > 200_000:
                    known.clear()
                at = known[kind, token] = _slot(kind, token, dim)
            out[at[0]] += weight * at[1] * (1 + math.log(n))
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def hash_encode(text: Column, dim: int = 256) -> Column:
    """hashed() of a column, as array<float>; at least 16 places."""
    dim = max(16, dim)

    def work(texts: pd.Series) -> pd.Series:
        known: dict = {}
        return texts.map(lambda t: hashed(t, dim, known).astype(np.float32))

    return F.pandas_udf(work, "array<float>")(text)


def l2_normalized(vector: Column) -> Column:
    """The vector with length 1; a zero vector as it is. Inside the JVM."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def common_words(a: Column, b: Column) -> Column:
    """How many words two texts have in common, each as often as it stands in both; 0 where one is null."""

    def work(a: pd.Series, b: pd.Series) -> pd.Series:
        bag = lambda t: Counter(_WORD.findall(t.lower())) if isinstance(t, str) else Counter()
        return pd.Series([(bag(x) & bag(y)).total() for x, y in zip(a, b)], dtype="int64")

    return F.pandas_udf(work, "bigint")(a, b)


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, a bit for every character of a at a time."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & places.get(c, 0)
        state = (state + hit) | (state - hit)
    return (~state & full).bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the longest common subsequence as a share of both lengths; 100 for two empty texts."""
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * common_length(a, b) / n


def partial_ratio(short: str, long: str) -> float:
    """The best ratio() of the shorter text with a stretch of its length of the longer one, or a shorter one at either end."""
    if len(short) > len(long):
        short, long = long, short
    if not short:
        return 0.0
    if short in long:
        return 100.0
    m, best = len(short), 0.0
    for i in range(1 - m, len(long)):
        part = long[max(0, i) : i + m]
        if part[0] in short and 200.0 * len(part) / (m + len(part)) > best:
            best = max(best, ratio(short, part))
    return best


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: the likeness of two sets of words, 100 if one holds the other: the best ratio() of what they have in common,
    followed by the rest of one, the rest of the other, or nothing; 0 where one is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, other = sorted(x & y), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not one or not other):
        return 100.0
    n = len(" ".join(both))
    gap = bool(n)
    whole = 2 * n + 2 * gap + len(one) + len(other)
    apart = len(one) + len(other) - 2 * common_length(one, other)
    best = 100.0 * (1 - apart / whole)
    for rest in (one, other) if n else ():
        best = max(best, 100.0 * (1 - (gap + len(rest)) / (2 * n + gap + len(rest))))
    return best


_NOT_KEY = re.compile("[^a-z0-9 ]+")


def similarity(a: str | None, b: str | None) -> float:
    """0 to 100, of two captions: the greater of the ratio() of their beginnings (160 characters at most) and the
    partial_ratio() of the first 300 of the shorter with the first 600 of the longer. Only small letters of ASCII and
    figures count; beginnings and texts of fewer than 20 characters are like nothing."""
    x, y = sorted((" ".join(_NOT_KEY.sub(" ", (t or "").lower()).split()) for t in (a, b)), key=len)
    k = min(len(x), 160)
    if k < 20:
        return 0.0
    return max(ratio(x[:k], y[:k]), partial_ratio(x[:300], y[:600]))


def title_key(text: str | None) -> str:
    """A title for comparing: accents off, small letters and figures only, single blanks."""
    plain = unicodedata.normalize("NFD", text or "").encode("ascii", "ignore").decode()
    return " ".join(_NOT_KEY.sub(" ", plain.lower()).split())


def title_score(printed: str | None, raw: str | None, listed: str | None) -> float:
    """0 to 100, how like a listed title is to a printed reference: to its title, words in any order; where that is missing
    or shorter than 12 characters, to the best stretch of the printed text, less 4, if that has six tenths of the title's
    words of four letters or more. Listed titles under 12 characters are like nothing."""
    it, pt, text = title_key(listed), title_key(printed), title_key(raw)
    if len(it) < 12:
        return 0.0
    if len(pt) >= 12:
        return ratio(" ".join(sorted(pt.split())), " ".join(sorted(it.split())))
    words = {w for w in it.split() if len(w) >= 4}
    if len(text) < 20 or words and sum(w in text for w in words) / len(words) < 0.6:
        return 0.0
    return partial_ratio(it, text) - 4.0


_DATED = re.compile(r"^\d{4}-\d{2}-[A-Za-z]*-?\S*\s+")
_TAG = re.compile("<[^>]+>")


def file_title(name: str | None) -> str:
    """What of a file's name may be a title: its stem without a date before it; nothing if shorter than 20 characters or
    mostly of another script than Latin."""
    stem = _DATED.sub("", (name or "").replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[0]).strip()
    letters = [c for c in stem if c.isalpha()]
    return stem if len(stem) >= 20 and letters and sum(c.isascii() for c in letters) >= 0.8 * len(letters) else ""


def identity_score(title: Column, file: Column) -> Column:
    """0 to 100: how like a record's title is to what its file's name says; null where either says too little."""

    def one(t, f) -> float | None:
        t, name = _TAG.sub("", t).strip() if isinstance(t, str) else "", file_title(f if isinstance(f, str) else None)
        return round(token_set_ratio(t.lower(), name.lower()), 1) if name and len(t) >= 15 else None

    return F.pandas_udf(lambda a, b: pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64"), "double")(title, file)


def text_similarity(a: Column, b: Column) -> Column:
    """similarity() of two columns."""

    def work(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x if isinstance(x, str) else None, y if isinstance(y, str) else None) for x, y in zip(a, b)], dtype=float)

    return F.pandas_udf(work, "double")(a, b)


def edited(before: str | None, after: str | None) -> int:
    """How many characters differ, line by line: per line the longer text less what both have in common in order; lines that
    only one has count whole."""
    a, b = (before or "").split("\n"), (after or "").split("\n")
    n = sum(max(len(x), len(y)) - common_length(x, y) for x, y in zip(a, b) if x != y)
    return n + sum(map(len, a[len(b) :])) + sum(map(len, b[len(a) :]))


def edit_count(before: Column, after: Column) -> Column:
    """edited() of two columns."""

    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edited(x if isinstance(x, str) else None, y if isinstance(y, str) else None) for x, y in zip(a, b)], dtype="int64")

    return F.pandas_udf(count, "bigint")(before, after)
