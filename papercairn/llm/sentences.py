"""Problem 3: sentence boundaries in any script, by a maximum-entropy classifier of candidate boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papercairn.llm.lexicon import counts, sampled
from papercairn.tables import blank

_CLOSERS = r"(?:[\"'”’»›」』）)\]}]|“(?=[\s,.;:)]|$)|[   ]»)*"
_CITED = r"(?:\[\d+(?:\s?[,–-]\s?\d+)*\])*"
#: An end mark, not a point between digits, with what closes after it; or white space between letters of Thai, Lao,
#: Khmer or Burmese, which have no end mark.
_CANDIDATE = re.compile(rf"(?:[!?…。！？｡．؟۔।॥]|\.(?!\d)|(?<!\d)\.)[.!?…。！？｡؟।॥]*{_CLOSERS}{_CITED}|(?<=[฀-໿က-႟ក-៿])[  　\n\r]+(?=[฀-໿က-႟ក-៿])")
_MARKS = "!?….。！？｡．؟۔।॥"
_TOKEN = re.compile(r"[^\W\d_][^\W_]*(?:[.'’-][^\W_]+)*")
_DOTTED = re.compile(r"([^\W\d_][^\W_]*(?:[.'’-][^\W_]+)*)\.")
_AHEAD = re.compile(r"\s*([\"'“‘«„‹「『（(\[¿¡]*\s?)((?:[^\W_]|[-'’](?=[^\W_])){0,24})")
_OPENERS = "\"'“‘«„‹「『（([¿¡"


def kinds(text: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """The words of a text; those before a point; the first one; the one before the last point."""
    low = text.lower()
    first = _TOKEN.search(low)
    dotted = _DOTTED.findall(low)
    end = low.rstrip()[-40:]
    last = _DOTTED.findall(end) if end.endswith(".") else []
    return _TOKEN.findall(low), dotted, [first[0]] if first else [], last[-1:] if last and end.endswith(last[-1] + ".") else []


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    for name, low, high in (("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("arabic", 0x590, 0x8FF), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0x10FF), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("wide", 0xFF00, 0xFFEF)):
        if low <= o <= high:
            return name
    return "other"


def _shape(word: str) -> str:
    if not word:
        return "none"
    if word[0].isdigit():
        return "digit" if not any(c.isalpha() for c in word) else "digit-letter"
    s = _script(word[0])
    if s not in ("latin", "greek", "cyrillic"):
        return s
    letters = [c for c in word if c.isalpha()]
    if any(c.isdigit() for c in word):
        return "mixed"
    if len(letters) == 1:
        return "initial" if letters[0].isupper() else "letter"
    if all(c.isupper() for c in letters):
        return "capitals"
    if letters[0].isupper() and all(c.islower() for c in letters[1:]):
        return "title"
    return "lower" if all(not c.isupper() for c in letters) else "mixed"


def _bucket(a: int, b: int) -> str:
    if b < 3:
        return "rare"
    r = a / b
    return "none" if r == 0 else "low" if r < 0.02 else "some" if r < 0.2 else "half" if r < 0.8 else "most" if r < 0.97 else "all"


class Features:
    """Features of a candidate, from the text around it and the counts of words (see kinds)."""

    def __init__(self, stats: dict[str, tuple[int, ...]]):
        self.stats = stats
        self.known: dict[tuple, list[str]] = {}

    def of(self, text: str, m: re.Match, capitals: bool) -> tuple[list[str], dict]:
        start, end = m.span()
        cand = m[0]
        is_space = cand.isspace()
        left = text[max(0, start - 40) : start]
        word = left.split()[-1] if left.split() and not left[-1:].isspace() else ""
        word = word.lstrip(_OPENERS)
        bare = word.rstrip("\"'”’»›」』）)]}%")
        tail = cand.lstrip(_MARKS)
        closer = "".join(sorted({c for c in tail if not c.isspace() and c not in "0123456789,–-["}))[:2]
        cited = "[" in tail
        ahead = _AHEAD.match(text, end)
        gap = "end" if end >= len(text.rstrip()) else "space" if text[end].isspace() or is_space else "none"
        opener, nxt = ahead[1].strip(), ahead[2]
        at = ahead.end(1)
        follows = text[at] if not nxt and at < len(text) else ""
        key = (cand[0], bare, closer, cited, gap, opener[:1], nxt, follows, capitals, len(cand.rstrip(tail)) if tail else len(cand), word != bare)
        if (hit := self.known.get(key)) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            hit = self.known[key] = self._list(*key)
        return hit, {"word": bare.lower(), "next": nxt, "gap": gap, "closer": closer, "follows": follows, "mark": cand[0], "opener": opener}

    def _list(self, mark, bare, closer, cited, gap, opener, nxt, follows, capitals, n_marks, closed) -> list[str]:
        low, nlow = bare.lower(), nxt.lower()
        tail = _TOKEN.findall(low)
        n, dot, _, last = self.stats.get(low) or self.stats.get(tail[-1] if tail else "", (0, 0, 0, 0))
        nn, _, first, _ = self.stats.get(nlow, (0, 0, 0, 0)) if not nlow[:1].isdigit() else (0, 0, 0, 0)
        ps, ns = _shape(bare), _shape(nxt)
        if capitals and ns in ("title", "capitals", "initial"):
            ns = "shouted"
        if mark in "。！？｡．" or mark.isspace():
            kind = "full" if not mark.isspace() else "gap"
        else:
            kind = {".": "point", "…": "dots"}.get(mark, "mark")
        if kind == "point" and n_marks > 1:
            kind = "dots"
        abbr = f"{_bucket(dot, n)}/{_bucket(last, dot)}" if kind == "point" else "-"
        begins = _bucket(first, nn) if nn >= 3 else "rare"
        clos = "q" if closer and closer[0] in "\"'”’»›」』“" else "b" if closer else "-"
        nx = f"{opener and 'o'}{ns if nxt else 'sign' + follows}"
        inner = "." in bare
        f = [
            f"kind={kind}", f"abbr={abbr}", f"abbr+next={abbr}|{nx}", f"next={nx}", f"begins={begins}", f"begins+next={begins}|{nx}", f"gap={gap}", f"gap+next={gap}|{nx}|{kind}",
            f"closer={clos}|{gap}", f"closer+next={clos}|{nx}|{gap}", f"closer+begins={clos}|{begins}", f"prev={ps}", f"prev+abbr={ps}|{abbr}", f"length={min(len(bare), 5)}|{kind}", f"inner={inner}|{begins}", f"cited={cited}", f"closed={closed}", f"abbr+begins={abbr}|{begins}",
        ]
        if kind == "point":
            f += [f"word={low[:16]}", f"word+begins={low[:16]}|{begins in ('none', 'rare', 'low')}"]
        return f


def _capitals(text: str) -> bool:
    """Whether a text is set in capitals."""
    large = sum(map(str.isupper, text))
    return large > 16 and large > 0.8 * (large + sum(map(str.islower, text)))


def abbreviations(found: list[dict], stats: dict[str, tuple[int, ...]]) -> set[str]:
    """Words of up to seven letters that are nearly always followed by a point but never the last of a paragraph; without
    those mostly followed by words that begin paragraphs, as the last word of a set phrase is."""
    begin: dict[str, list[int]] = {}
    for info in found:
        word, nxt = info["word"], info["next"].lower()
        n, dot, _, last = stats.get(word, (0, 0, 0, 0))
        if info["mark"] == "." and not info["closer"] and n >= 5 and dot >= 0.9 * n and last <= 0.002 * dot and len(word) <= 7:
            nn, _, first, _ = stats.get(nxt, (0, 0, 0, 0))
            begin.setdefault(word, []).append(len(nxt) > 1 and not nxt[0].isdigit() and first >= 0.02 * nn > 0)
    return {w for w, b in begin.items() if sum(b) <= 0.5 * len(b)}


def reliable(info: dict, stats: dict[str, tuple[int, ...]], short: set[str]) -> bool | None:
    """False where surely no sentence ends: a comma or the like follows, a letter directly after closing quotes, a small
    letter of a word that never begins a paragraph, an initial, or one of the abbreviations `short`. None where it isn't
    sure."""
    if info["gap"] == "end":
        return None
    nxt = info["next"]
    if not nxt and info["follows"] and info["follows"] in ",;:)]/%-–—»”":
        return False
    if info["closer"] and info["gap"] == "none" and nxt and info["closer"][0] in "\"'”’»」』“":
        return False
    if info["mark"].isspace():
        return None
    n, _, first, _ = stats.get(nxt.lower(), (0, 0, 0, 0))
    if _shape(nxt) in ("lower", "letter") and first <= 0.0005 * n and not info["opener"] and (n >= 3 or len(nxt) > 1):
        return False
    n, dot, _, last = stats.get(info["word"], (0, 0, 0, 0))
    if info["mark"] == "." and not info["closer"]:
        if info["word"] in short:
            return False
        if len(info["word"]) == 1 and info["word"].isalpha() and info["word"].lower() != info["word"].upper() and last <= 0.01 * max(dot, 1):
            return False
    return None


class Model:
    def __init__(self, stats: dict[str, tuple[int, ...]], weights: dict[str, float]):
        self.stats, self.weights, self.features = stats, weights, Features(stats)

    def ends(self, text: str) -> list[int]:
        """Where the sentences of the text end, in characters."""
        out, length, capitals = [], len(text.rstrip()), _capitals(text)
        if not length:
            return []
        w = self.weights
        for m in _CANDIDATE.finditer(text, 0, length):
            f, info = self.features.of(text, m, capitals)
            if info["gap"] == "end":
                break
            if sum(w.get(x, 0.0) for x in f) > 0:
                out.append(m.start() if m[0].isspace() else m.end())
        out.append(length)
        return [e for i, e in enumerate(out) if i == 0 or e > out[i - 1]]


_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿＀-￯。！？」』]")


def fit(texts: list[str], stats: dict[str, tuple[int, ...]], rounds: int = 150) -> dict[str, float]:
    """Weights of features. Sure ends are those between two paragraphs set one after the other (with a space, in scripts
    without spaces with none, now and then with none or a new line elsewhere); sure non-ends are those of reliable()."""
    features, rows, labels = Features(stats), [], []
    rng = np.random.default_rng(11)
    texts = [t.strip() for t in texts if t and t.strip() and "�" not in t]
    # Paragraphs of a language meet their like: sorted by script and first letters, then shuffled in runs
    texts.sort(key=lambda t: (_script(next((c for c in t if c.isalpha()), "a")), _capitals(t)))
    found = [[features.of(t, m, _capitals(t)) for m in _CANDIDATE.finditer(t)] for t in texts]
    short = abbreviations([info for here in found for _, info in here], stats)
    for i, t in enumerate(texts):
        capitals = _capitals(t)
        for f, info in found[i]:
            if (sure := reliable(info, stats, short)) is not None:
                rows.append(f)
                labels.append(float(sure))
        j = min(len(texts) - 1, max(0, i + int(rng.integers(-40, 40))))
        nxt = texts[j]
        if t[-1] not in _MARKS + "\"'”’»」』）)]" and not ("฀" <= t[-1] <= "໿"):
            continue
        if _capitals(nxt) != capitals or _script(nxt[0]) != _script(t[0]) and rng.random() < 0.8:
            continue
        odd = rng.random()
        sep = "" if _UNSPACED.match(t[-1]) and _UNSPACED.match(nxt[0]) else "" if odd < 0.06 and nxt[:1].isupper() else "\n" if odd < 0.12 else " "
        joined = f"{t[-80:]}{sep}{nxt[:60]} xx"
        at = len(t[-80:])
        for m in _CANDIDATE.finditer(joined):
            if m.start() <= at <= m.end() and (m.end() == at or m[0].isspace()):
                f, _ = features.of(joined, m, capitals)
                rows.append(f)
                labels.append(1.0)
    if not rows:
        return {}
    names = {x: k for k, x in enumerate(dict.fromkeys(x for f in rows for x in f))}
    col = np.array([names[x] for f in rows for x in f])
    row = np.repeat(np.arange(len(rows)), [len(f) for f in rows])
    y = np.array(labels)
    side = np.where(y > 0, len(y) / 2 / max(1, y.sum()), len(y) / 2 / max(1, len(y) - y.sum()))
    w = np.zeros(len(names))
    m, v = np.zeros(len(names)), np.zeros(len(names))
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)), -30, 30)))
        g = np.bincount(col, ((p - y) * side / len(y))[row], len(names)) + 3e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return dict(zip(names, w.tolist()))


def train(corpus: DataFrame, sample: int = 6000, longest: int = 20_000) -> Model:
    """A model from a corpus (its first column): counts of words over all of it, weights from `sample` different texts of at
    most `longest` characters (those of the smallest hashes, so the same ones each time). Both bound what the driver holds."""
    text = F.col(corpus.columns[0])
    corpus = corpus.select(text.alias("t")).filter(~blank(F.col("t")))
    stats = counts(corpus, kinds, kinds=4)
    return Model(stats, fit(sampled(corpus, corpus.count(), sample, longest, 5), stats))


def sentences(texts: DataFrame, model: Model) -> DataFrame:
    """id, sentence (number from 0), start, end (characters), text of every sentence of every row of `texts` (id, text).

    A sentence runs from the first character after the white space behind the one before to its last character, closing
    quotes, brackets and citation marks included. Null and blank texts have no sentences; an id delivered twice counts
    once; other columns are ignored."""
    held = texts.sparkSession.sparkContext.broadcast((model.stats, model.weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for b in batches:
            rows = []
            for key, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                start = 0
                for k, end in enumerate(m.ends(text)):
                    start += len(text[start:end]) - len(text[start:end].lstrip())
                    rows.append((key, k, start, end, text[start:end]))
                    start = end
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["id", "sentence", "start", "end", "text"])

    source = texts.select("id", "text").filter(~blank(F.col("text"))).dropDuplicates(["id"])
    return source.mapInArrow(work, "id string, sentence int, start int, end int, text string")
