"""Problem 2: text of scanned pages made continuous, by decoding words over de-lined characters."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papercairn.llm.lexicon import counts
from papercairn.tables import blank, kept

#: What is read for a letter, and the letters it may stand for.
MISREAD = {"1": ("l", "i"), "0": ("o",), "5": ("s",), "@": ("a",), "c": ("e",), "b": ("h",), "ri": ("n",), "cl": ("d",), "rn": ("m",), "vv": ("w",), "8": ("b",), "|": ("l", "i")}
#: Letters read for digits, in numbers.
DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "Z": "2", "S": "5", "b": "6", "B": "8", "g": "9"}
#: -log of the share of misread characters, of words torn or run together.
MISREAD_COST, SPACE_COST, UNKNOWN_COST = 3.5, 9.0, 15.5
#: That of a letter of a word no one knows, where it may be two words or a part of one.
LETTER_COST = 2.3

_TOKEN = re.compile(r"[\w@|]+")
_LATIN = re.compile("[a-z0-9@|À-ɏ]+")
_SPOTS = re.compile("[105@cb8|]|ri|rn|vv")
_EVERY_SPOT = re.compile("[105@cb8|]")
_COUNTED = re.compile(r"[^\W_]+")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_LETTERS = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c]")
_LINE_MARK = re.compile(r"(?<=[\w@|])([-‐\xad¬])[ \t\x0c]*(?:\r?\n|\r)[ \t]*(?=[\w@|])")
_SPACE_MARK = re.compile(r"(?<=[\w@|])([-‐\xad¬]) +(?=[\w@|])")
_WORD_END, _WORD_START = re.compile(r"(?:[^\W_]|[@|])+$"), re.compile(r"(?:[^\W_]|[@|])+")
_CUT_CELL = re.compile(r"((?:[^\W_]|@)+)([-‐­¬])(?:[ \t]*<br ?/?>[ \t]*|[ \t]*\r?\n[ \t]*|[ \t]+)((?:[^\W_]|@)+)")
#: A running title cut off and a page number, between small letters.
_RUNNING = re.compile(r"(?<=[a-zß-ÿ,])\s+[A-Z][a-z]{2,}(?:-[a-z]+)?(?: [a-z][a-z-]*){4,12} \d{2,4}(?=\s+[a-zß-ÿ(])")
_SPACED = r"(?:\S ){2,}\S"
_NUMBER_LINE = re.compile(r"[—–\-\s]*(?:(?:page|seite|página|pág\.|p\.|pp\.)\s*)?\d{1,4}[—–\-\s]*|\[\d{1,4}\]|\d{1,4} \| ?P ?a ?g ?e|S\d{1,4}|(?:page|p\.) ?\d{1,4} ?(?:of|/) ?\d{1,4}", re.I)
_HEADER_LINE = re.compile(rf"{_SPACED}|.{{3,80}}, Vol\. ?\d+(?:, No\. ?\d+)?\.?|[A-ZÀ-Þ][A-ZÀ-Þ&' ]{{3,80}} \d+ ?\(\d+\) ?\d+[–-]\d+|\S[^.]{{1,30}} (?:et al\.|and [A-ZÀ-Þ]\S+) / .{{3,80}}")
_TITLE = r"(?!(?:In|On|At|The|Of|For|By|With|From)\b)[A-ZÀ-Þ]\w+(?: (?:[A-ZÀ-Þ]\w+|of|and|on|in|for|the|&))*"
_NAMES = r"[A-ZÀ-Þ][\w-]+(?: et al\.| and [A-ZÀ-Þ][\w-]+)"
_VOLUME = re.compile(r"\((?:19|20)\d\d\) ?\d")
#: Running headers by their form alone, wherever they stand, each with what tells quickly that a text may have one: title
#: and volume, spaced capitals, names and title, "page n of m", names and a page number, page numbers with their marks.
_HEADERS = (
    (lambda t: "Vol." in t, re.compile(rf"{_TITLE}, Vol\. ?\d+, No\. ?\d+")),
    (_VOLUME.search, re.compile(r"[A-ZÀ-Þ]{2,}(?: [A-ZÀ-Þ]{2,})+ \d+ ?\((?:19|20)\d\d\) ?\d+[–-]\d+")),
    (lambda t: " / " in t, re.compile(rf"{_NAMES} / {_TITLE}")),
    (lambda t: list(map(len, t.split())).count(1) > 3, re.compile(r"(?<!\S)(?:[A-ZÀ-Þ] ){3,}[A-ZÀ-Þ](?!\S)")),
    (lambda t: " · page " in t, re.compile(r"[A-ZÀ-Þ]\w+(?: \w+){0,4} · [^·\n]{3,80} · page \d+ of \d+")),
    (lambda t: "  " in t, re.compile(rf"(?<!\S)\d{{1,4}} {{2,}}{_NAMES}|{_NAMES} {{2,}}\d{{1,4}}(?!\S)")),
    (lambda t: "| P" in t, re.compile(r"(?<!\S)\d{1,4} \| P ?a ?g ?e(?!\S)")),
    (lambda t: "— " in t or "– " in t, re.compile(r"(?<!\S)[—–] \d{1,4} [—–](?!\S)")),
)
_CELL_NUMBER = re.compile(r"[\dOoIlZSbBg]+(?:[.,][\dOoIlZSbBg]+)?")
_NUMERIC_CELL = re.compile(r"[\s()±%<>≤≥=–—.,\-]*(?:[\dOoIlZSbBg]+(?:[.,][\dOoIlZSbBg]+)?[\s()±%<>≤≥=–—\-]*)+")
_END = re.compile(r"[.!?…。！？।؟][\"'”’»)\]]*(?:\[\d+\])*$")


def tokens(text: str) -> tuple[list[str], ...]:
    low = text.lower()
    found = [w for w in _COUNTED.findall(low) if not w.isdigit()]
    if "-" in low:
        found += _COMPOUND.findall(low)
    return (found,)


class Decoder:
    """Decodes scanned text with a lexicon of word counts."""

    def __init__(self, lexicon: dict[str, int]):
        self.n = lexicon
        self.total = sum(n for w, n in lexicon.items() if "-" not in w) or 1
        self.sorted = sorted(w for w in lexicon if "-" not in w)
        #: What the most frequent word costs: no reading costs less.
        self.floor = -math.log(max(lexicon.values(), default=1) / self.total)
        self.fixes: dict[str, tuple[float, str] | None] = {}
        self.pieces: dict[str, bool] = {}
        self.unknown: dict[str, int] = {}

    def cost(self, word: str) -> float:
        n = self.n.get(word, 0)
        return -math.log(n / self.total) if n else UNKNOWN_COST

    def fix(self, word: str) -> tuple[float, str] | None:
        """(cost, word) of the likeliest other word of the lexicon that may have been misread as this one (lower case), if
        that is likelier than that it stands as it is."""
        if word in self.fixes:
            return self.fixes[word]
        if len(self.fixes) > 100_000:
            self.fixes.clear()
        best = None
        if not _SPOTS.search(word) or word.isdigit() or not _LATIN.fullmatch(word):
            self.fixes[word] = None
            return None
        digits = sum(c.isdigit() for c in word)
        odd = "@" in word or "|" in word
        if (len(word) >= 3 or odd and len(word) == 2) and digits * 2 < len(word) and not (digits and len(word) < 4 and word[0].isalpha() and word[1:].isdigit()):
            # Digits and signs inside a word are all misread
            must = {i for i, c in enumerate(word) if c in MISREAD and not c.isalpha()}
            least = self.cost(word)
            best = self.reading(word, must, least)
            if not best and must and re.search("[a-zÀ-ɏ][015@][a-zÀ-ɏ]", word) and digits + odd == len(must) and least >= UNKNOWN_COST and len(word) >= 5:
                # A name no one knows: signs between letters can still be nothing but misread letters
                best = (UNKNOWN_COST, "".join(MISREAD[c][-1 if c == "1" else 0] if c in MISREAD and not c.isalpha() else c for c in word))
        self.fixes[word] = best
        return best

    def reading(self, word: str, must: set[int], least: float) -> tuple[float, str] | None:
        """(cost, word) of the cheapest word of the lexicon that may have been misread as this one, if it costs less than
        `least`: a walk over the places that may be misread, each kept or taken for what it may stand for. As every
        misread place costs, few can be, however many there are; where there are many, only beginnings of words go on."""
        spots = [(m.start(), m[0], MISREAD[m[0]]) for m in _EVERY_SPOT.finditer(word)]
        spots += [(i, word[i : i + 2], to) for i in range(len(word) - 1) if (to := MISREAD.get(word[i : i + 2]))]
        spots.sort()
        best, walk = None, [(0, 0, "", 0)]
        while walk:
            j, at, so_far, n = walk.pop()
            if n and so_far + word[at:] in self.n and all(i < at for i in must):
                c = so_far + word[at:]
                if (cost := self.cost(c) + MISREAD_COST * n) < least:
                    least, best = cost, (cost, c)
            if MISREAD_COST * (n + 1) + self.floor >= least:
                continue
            for q in range(j, len(spots)):
                i, shown, to = spots[q]
                if i < at:
                    continue
                if must and any(at <= x < i for x in must):
                    break
                for letter in to:
                    now = so_far + word[at:i] + letter
                    if len(spots) < 9 or self.begins(now):
                        walk.append((q + 1, i + len(shown), now, n + 1))
        return best

    def begins(self, letters: str) -> bool:
        """Whether some word of the lexicon begins with these letters."""
        if len(letters) < 3:
            return True
        i = bisect_left(self.sorted, letters)
        return i < len(self.sorted) and self.sorted[i].startswith(letters)

    def word(self, shown: str) -> str | None:
        """The word that was misread as `shown`, in the case of `shown`; None if it stands."""
        if (hit := self.fix(shown.lower())) is None:
            return None
        w = hit[1]
        letters = [c for c in shown if c.isalpha()]
        if len(letters) > 1 and all(c.isupper() for c in letters):
            return w.upper()
        return w[:1].upper() + w[1:] if letters and shown[0].isupper() else w

    def joins(self, a: str, mark: str, b: str, cell: bool = False) -> bool:
        """Whether a and b are the parts of one cut word, rather than of a compound with a hyphen."""
        la, lb = a.lower(), b.lower()
        if mark in "\xad¬" and not cell:
            return re.fullmatch("[a-zß-ÿ015@]{2}", la[-1:] + lb[:1]) is not None
        if not la[-1:].isalpha() and la[-1:] not in "015@" or not lb[:1].isalpha() and lb[:1] not in "015@":
            return False
        if la.isdigit() or lb.isdigit():
            return False
        whole = la + lb
        n, apart = self.n.get(whole, 0), self.n.get(f"{la}-{lb}", 0)
        if n or apart:
            return n > apart
        if self.fix(whole) is not None and self.cost(self.fix(whole)[1]) < UNKNOWN_COST:
            return True
        if cell:
            return False
        if b[0].isupper() and not a.isupper():
            return False
        known_a = la in self.n or self.fix(la) is not None
        known_b = lb in self.n or self.fix(lb) is not None
        return not (known_a and known_b)

    def furniture(self, lines: list[str]) -> set[int]:
        """The lines that are page numbers or running headers: by their form, and because their neighbours would have been
        set on the same line had they belonged to the text."""
        if len(lines) < 2:
            return set()
        width = max(map(len, lines))
        out: set[int] = set()
        for i, line in enumerate(lines):
            s = line.strip()
            if not s or len(s) > 90:
                continue
            inside = 0 < i < len(lines) - 1
            number = _NUMBER_LINE.fullmatch(s)
            if number:
                bare = s.isdigit()
                if not bare or inside and width >= 24:
                    out.add(i)
            elif _HEADER_LINE.fullmatch(s) or any(sign(s) and p.fullmatch(s) for sign, p in _HEADERS):
                out.add(i)
        return out

    def spaces(self, words: list[str]) -> list[str]:
        """Words by the cheapest reading of their characters: as they stand, misread, torn apart (a space too many) or run
        together (a space too few)."""
        best: list[tuple[float, int, list[str]]] = [(0.0, 0, [])]
        for j, shown in enumerate(words):
            core = _LETTERS.fullmatch(shown)
            own = self.word(shown) if _TOKEN.fullmatch(shown) else None
            c = self.fix(shown.lower())[0] if own else self.cost(shown.lower()) if core else 0.0
            if core and not own and c == UNKNOWN_COST:
                c = max(c, LETTER_COST * len(shown))
            options = [(best[j][0] + c, j, [own or shown])]
            if core and not own and len(shown) > 4 and shown.lower() not in self.n:
                for k in range(2, len(shown) - 1):
                    x, y = shown[:k].lower(), shown[k:].lower()
                    if x in self.n and y in self.n:
                        options.append((best[j][0] + self.cost(x) + self.cost(y) + SPACE_COST, j, [shown[:k], shown[k:]]))
            if j and core and _LETTERS.fullmatch(words[j - 1]) and (shown.lower() not in self.n or words[j - 1].lower() not in self.n):
                whole = (words[j - 1] + shown).lower()
                if whole in self.n:
                    options.append((best[j - 1][0] + self.cost(whole) + SPACE_COST, j - 1, [words[j - 1] + shown]))
            best.append(min(options, key=lambda o: o[0]))
        out, j = [], len(words)
        while j:
            _, i, got = best[j]
            out[:0] = got
            j = i
        return out

    def paragraphs(self, lines: list[str]) -> list[str]:
        """Lines set into paragraphs. Dynamic programming over the lines: a break costs little behind a short line that ends
        a sentence and before a capital, or at an empty line; a join costs what speaks for a break; every paragraph costs
        something, and one of few characters more."""
        if not lines:
            return []
        width = max(map(len, lines))
        n = len(lines)
        best = [(0.0, 0)] + [(math.inf, 0)] * n
        joined = [0.0] * (n + 1)
        for i in range(1, n):
            a, b = lines[i - 1].rstrip(), lines[i].lstrip()
            odds = -2.0
            if not a or not b:
                odds = 1.0
            elif _END.search(a):
                odds = 1.5 if len(a) < 0.7 * width and b[:1].isupper() else -0.5
            joined[i] = math.log1p(math.exp(odds))
        cut = [0.0, *(x and math.log1p(math.exp(-math.log(math.expm1(x)))) for x in joined[1:n]), 0.0]
        total = list(itertools.accumulate(joined))
        size = [0, *itertools.accumulate(map(len, lines))]
        # What a paragraph from i on costs beside best[i], less what the joins up to i would; the least of those long enough
        # in `far`, of the shorter ones in a queue of ascending costs
        far, near, at = (math.inf, 0), deque(), 0
        for j in range(1, n + 1):
            i = j - 1
            mine = (best[i][0] + (cut[i] if i else 0.0) - total[i], i)
            while near and near[-1] >= mine:
                near.pop()
            near.append(mine)
            while at < j and size[j] - size[at] >= 50:
                far = min(far, (best[at][0] + (cut[at] if at else 0.0) - total[at], at))
                at += 1
            while near and near[0][1] < at:
                near.popleft()
            cost, i = min((far[0] + 0.3, far[1]), (near[0][0] + 1.0, near[0][1]) if near else (math.inf, 0))
            best[j] = (cost + total[j - 1], i)
        out, j = [], n
        while j:
            i = best[j][1]
            out.append(" ".join(s for x in lines[i:j] if (s := x.strip())))
            j = i
        return [p for p in out[::-1] if p]

    def doubtful(self, piece: str) -> bool:
        """Whether a piece between white space holds a word that was misread."""
        if (hit := self.pieces.get(piece)) is None:
            if len(self.pieces) > 200_000:
                self.pieces.clear()
            hit = self.pieces[piece] = any(self.fix(w) is not None for w in _TOKEN.findall(piece.lower()))
        return hit

    def unspaced(self, piece: str) -> int:
        """0 for a piece between white space whose words are known; 1 if it has one of letters that nobody knows, 2 if that
        may be two known words run together."""
        if (hit := self.unknown.get(piece)) is None:
            if len(self.unknown) > 200_000:
                self.unknown.clear()
            odd = [w for w in _LETTERS.findall(piece.lower()) if w not in self.n]
            apart = any(w[:k] in self.n and w[k:] in self.n for w in odd if len(w) > 4 for k in range(2, len(w) - 1))
            hit = self.unknown[piece] = 2 if apart else 1 if odd else 0
        return hit

    def respaced(self, pieces: list[str]) -> bool:
        """Whether some word that nobody knows may be two known ones, or a known one with the word beside it."""
        unspaced, known = self.unspaced, self.n
        for i, p in enumerate(pieces):
            if kind := unspaced(p):
                if kind == 2:
                    return True
                low = p.lower()
                if i and (pieces[i - 1].lower() + low).rstrip(".,;:)") in known or i + 1 < len(pieces) and (low + pieces[i + 1].lower()).rstrip(".,;:)") in known:
                    return True
        return False

    def joined(self, text: str, marks: re.Pattern, cell: bool) -> tuple[str, int]:
        """The text with words cut at these marks joined, and how many. What a mark parts for good keeps a hyphen, and no
        line end."""
        out, at, n = [], 0, 0
        for m in marks.finditer(text):
            start = m.start()
            while start > at and (text[start - 1].isalnum() or text[start - 1] in "@|"):
                start -= 1
            a, b = _WORD_END.search(text[start : m.start()]), _WORD_START.match(text, m.end())
            if not a or not b:
                continue
            one = self.joins(a[0], m[1], b[0], cell)
            if one or not cell:
                out += [text[at : m.start()], "" if one else "-" if m[1] == "¬" else m[1]]
                at = m.end()
                n += one
        return ("".join([*out, text[at:]]), n) if out else (text, 0)

    def text(self, text: str, again: list[int] | None = None) -> tuple[str, int, int, int, int]:
        """(repaired text, cut words joined, misread words, pieces of page furniture, words torn or run together). again:
        lines known to recur from page to page."""
        hyphens = misread = 0
        lines = _BREAK.split(text)
        gone = self.furniture(lines) | {i for i in again or () if i < len(lines)} if len(lines) > 1 else set()
        headers = 0
        flat = text
        if len(lines) > 1:
            flat = "\n".join(x for i, x in enumerate(lines) if i not in gone and (x.strip() or i - 1 not in gone and i + 1 not in gone))
        pieces = flat.split()
        for sign, pattern in _HEADERS:
            if sign(flat):
                flat, n = pattern.subn("", flat)
                headers += n
        if headers:
            flat = re.sub("(?<=[^ ]) {2,}(?=[^ ])", " ", flat)
        runs = [m for m in _RUNNING.finditer(flat) if len(m[0]) >= 34]
        for m in reversed(runs):
            flat = flat[: m.start()] + flat[m.end() :]
        headers += len(runs)
        if len(lines) > 1:
            for _ in range(2):  # a word may be cut twice
                flat, n = self.joined(flat, _LINE_MARK, False)
                hyphens += n
        flat, n = self.joined(flat, _SPACE_MARK, True)
        hyphens += n
        if hyphens or headers:
            pieces = flat.split()
        if any(map(self.doubtful, set(pieces))):

            def put(m: re.Match) -> str:
                nonlocal misread
                if (w := self.word(m[0])) is None:
                    return m[0]
                misread += 1
                return w

            flat = _TOKEN.sub(put, flat)
        respaced = 0
        if not (hyphens or misread or gone or headers) and not self.respaced(pieces):
            return text, 0, 0, 0, 0
        out = []
        for p in self.paragraphs(flat.split("\n")):
            parts = re.split(r"(\W+)", p)
            runs = parts[0::2]
            if any(r and not r.isdigit() and r.lower() not in self.n for r in runs):
                pieces, k = [], 0
                while k < len(parts):
                    stretch = [parts[k]]
                    while k + 2 < len(parts) and parts[k + 1] == " ":
                        stretch.append(parts[k + 2])
                        k += 2
                    set_ = self.spaces(stretch)
                    respaced += abs(len(set_) - len(stretch)) or set_ != stretch
                    pieces.append(" ".join(set_))
                    if k + 1 < len(parts):
                        pieces.append(parts[k + 1])
                    k += 2
                p = "".join(pieces)
            out.append(p)
        if not (hyphens or misread or gone or headers or respaced):
            return text, 0, 0, 0, 0
        return "\n\n".join(out), hyphens, misread, len(gone) + headers, respaced

    def table(self, markdown: str) -> tuple[str, int, int, int, int]:
        """As text(), for a table in Markdown: its rows stay, cells are repaired one by one."""
        hyphens = misread = 0
        lines = _BREAK.split(markdown)
        gone = {i for i in self.furniture(lines) if not lines[i].lstrip().startswith("|")}
        kept_lines = [x for i, x in enumerate(lines) if i not in gone]
        rows: list[str] = []
        for line in kept_lines:  # a cell may be broken over lines
            if rows and rows[-1].lstrip().startswith("|") and not (rows[-1].rstrip().endswith("|") and line.lstrip().startswith("|")) and not line.lstrip().startswith("|"):
                rows[-1] += "\n" + line
            else:
                rows.append(line)

        def cut(m: re.Match) -> str:
            nonlocal hyphens
            if self.joins(m[1], m[2], m[3], cell=True):
                hyphens += 1
                return m[1] + m[3]
            return m[0]

        def put(m: re.Match) -> str:
            nonlocal misread
            if (w := self.word(m[0])) is None:
                return m[0]
            misread += 1
            return w

        def number(m: re.Match) -> str:
            nonlocal misread
            fixed = "".join(DIGITS.get(c, c) for c in m[0])
            misread += fixed != m[0]
            return fixed

        out = []
        for r, row in enumerate(rows):
            cells = row.split("|")
            for k, cell in enumerate(cells):
                if r > 1 and k > 1 and len(cells) > 3 and _NUMERIC_CELL.fullmatch(cell) and not cell.strip().isalpha() | (cell.strip() in ("", "-")):
                    cells[k] = _CELL_NUMBER.sub(number, cell)
                elif r > 1 and k > 1 and len(cells) > 3 and cell.strip() and re.fullmatch(r"[OoIlZSbBg]{1,3}", cell.strip()):
                    cells[k] = _CELL_NUMBER.sub(number, cell)
                elif any(c.isalpha() for c in cell):
                    cell = _CUT_CELL.sub(cut, cell)
                    cells[k] = _TOKEN.sub(put, cell)
            out.append("|".join(cells))
        if not (hyphens or misread or gone):
            return markdown, 0, 0, 0, 0
        return "\n".join(out), hyphens, misread, len(gone), 0


_FIGURES = re.compile(r"\d+")
_WORDS = re.compile(r"\w+")


def _first(line: str) -> int:
    """The least hash of a line's words: what a line with a word or two changed still has, mostly."""
    return min((zlib.crc32(w.encode("utf-8", "replace")) for w in _WORDS.findall(line.lower())), default=0)


def recurring(texts: DataFrame, least: int = 4, spread_out: float = 0.75) -> DataFrame:
    """tbl, rec_id, lines: the lines (numbers from 0) of each text that recur as running headers do: the same but for its
    figures, in `least` texts or more, with other text around it nearly every time (lines of repeated texts have the same
    around them). Lines at either end of a text and those of fewer than eight letters don't count. Lines are counted by
    hashes, in part before they are shuffled."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for tbl, key, text in zip(*(b.column(k).to_pylist() for k in ("tbl", "rec_id", "text"))):
                here = _BREAK.split(text)
                for i in range(1, len(here) - 1):
                    s = _FIGURES.sub("#", here[i].strip().lower())
                    if sum(c.isalpha() for c in s) >= 8:
                        rows.append((tbl, key, i, s, _first(here[i - 1]), _first(here[i + 1])))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["tbl", "rec_id", "i", "s", "above", "below"])

    source = texts.select("tbl", "rec_id", "text").filter(~F.col("is_table") & F.col("text").rlike(r"[\n\r\x0B\x0C]"))
    found = kept(source.mapInArrow(lines, "tbl string, rec_id string, i int, s string, above bigint, below bigint").select("tbl", "rec_id", "i", F.xxhash64("s").alias("h"), "above", "below"))
    sides = found.select("h", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("above").alias("w")), F.struct(F.lit(1).alias("side"), F.col("below").alias("w")))).alias("x"))
    sides = sides.groupBy("h", "x").agg(F.count(F.lit(1)).alias("n")).groupBy("h", "x.side").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("others"))
    again = sides.filter((F.col("n") >= least) & (F.col("others") >= spread_out * F.col("n"))).groupBy("h").agg(F.count(F.lit(1)).alias("sides")).filter("sides = 2").select("h")
    return found.join(again, "h").groupBy("tbl", "rec_id").agg(F.array_sort(F.collect_set("i")).alias("lines"))


def repaired(texts: DataFrame, lexicon_share: float = 1e-6) -> DataFrame:
    """tbl, rec_id, text, hyphens, misread, furniture, respaced of every row of `texts` (tbl, rec_id, text, is_table) in which
    words were cut, characters misread, page furniture left, or words torn or run together; text is the repaired one.

    The lexicon counts the words of all rows and keeps those that make up the share `lexicon_share` of them, so at most its
    inverse. A word is taken as misread if some word of the lexicon, times the odds of misreading, is more frequent than
    it. Page furniture shows by its form, or because it recurs (see recurring). Ordinary line breaks and compounds at a
    line's end are no damage. Null and blank texts have no rows; a key delivered twice counts once; other columns are
    ignored."""
    source = texts.select("tbl", "rec_id", "text", F.coalesce("is_table", F.lit(False)).alias("is_table")).filter(~blank(F.col("text")))
    lexicon = {w: n for w, (n,) in counts(source.select("text"), tokens, lexicon_share, apart=True).items()}
    held = texts.sparkSession.sparkContext.broadcast(lexicon)
    again = kept(recurring(source).select(F.col("tbl").alias("t"), F.col("rec_id").alias("r"), "lines"))
    # Few texts have such lines; where they are few enough to be sent to all tasks, no text is shuffled
    again = F.broadcast(again) if again.count() <= 100_000 else again
    source = source.join(again, F.col("tbl").eqNullSafe(F.col("t")) & F.col("rec_id").eqNullSafe(F.col("r")), "left").drop("t", "r")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(held.value)
        for b in batches:
            rows = []
            for tbl, key, text, is_table, lines in zip(*(b.column(k).to_pylist() for k in ("tbl", "rec_id", "text", "is_table", "lines"))):
                got, *n = d.table(text) if is_table else d.text(text, lines)
                if any(n):
                    rows.append((tbl, key, got, *n))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["tbl", "rec_id", "text", "hyphens", "misread", "furniture", "respaced"])

    return source.mapInArrow(work, "tbl string, rec_id string, text string, hyphens int, misread int, furniture int, respaced int").dropDuplicates(["tbl", "rec_id"])
