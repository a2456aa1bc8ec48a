"""Secrets in whole texts: base patterns joined with credential values that would be costly to guess.

A value in a credential context is cut into words, dates, repeats, keyboard walks and brute-force stretches by dynamic
programming over its characters, at the least total guess cost (log10 of guesses). Every value that stands in such a
context is costed, and the cost alone decides. After a sign (= or :) a character of a brute-force stretch costs its
alphabet. After a link word (is, was, as, to, of) or a blank prose may follow, so letters cost what they are worth after
the letter before them in the ranked words, and a value shaped like a word must cost PROSE.

Words are ranked: first a short list of common password words, then any list that the caller gives, such as the words
of a public vocabulary file in its order (ranked_words).

Defined results: null text counts as empty; a text without secrets has zero counts and the digest of the empty string;
rows that repeat an id are scanned alike; an empty table gives no rows; columns that are neither id nor text are not
read, whatever their names. Of contexts that overlap the leftmost counts; values that touch a base span are not added
again. Values of any length are costed whole: parts are bounded, so the work is linear in the value, and it ends as soon
as no rest can bring the cost below what makes a secret. Base spans are swept in order, so a text's work is linear.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedflow.llm.common import map_text
from deedflow.llm.spans import Span, Taken, digest, joined, secrets

KINDS = ["assign", "access", "hex", "guess"]
#: The longest word, date or walk, and the longest unit of a repeat.
SPAN = 24
#: The most copies of a unit in one repeat.
COPIES = 64
#: log10 of guesses from which a value counts as a secret; and a value shaped like a word that prose may hold.
COSTLY, PROSE = 10.0, 14.0
# Common password words by rank, and the rows of a keyboard with the shifted signs over the digits.
WORDS = "password admin welcome login user secret token letmein dragon monkey master hello shadow sunshine princess football qwerty default changeme example test guest root public private key value none null true false your this that with from the and for iloveyou baseball michael superman batman trustno summer winter spring autumn pass system server database oracle mysql postgres access changeit temp demo sample dummy foobar hunter".split()
ROWS = ["1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
SHIFTED = dict(zip("!@#$%^&*()_+{}:\"<>?", "1234567890-=[];',./", strict=True))

_LEET = str.maketrans({"@": "a", "4": "a", "8": "b", "3": "e", "0": "o", "1": "i", "!": "i", "|": "l", "$": "s", "5": "s", "7": "t", "+": "t", "2": "z"})
# Places of the keys: each row of a keyboard stands to the right of the one above.
_PLACE = {c: (x + dx, y) for y, (row, dx) in enumerate(zip(ROWS, (0.0, 0.5, 0.75, 1.25), strict=True)) for x, c in enumerate(row)}
_SEP = r"[-/._]?"
_YEAR, _MONTH, _DAY = r"(?:19|20)?[0-9]{2}", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12][0-9]|3[01])"
_DATE = re.compile("|".join(a + _SEP + b + _SEP + c for a, b, c in ((_YEAR, _MONTH, _DAY), (_DAY, _MONTH, _YEAR), (_MONTH, _DAY, _YEAR))))
_ALONE = re.compile(r"(?:19|20)[0-9]{2}(?:[-/._]?(?:0[1-9]|1[0-2]))?|(?:0[1-9]|1[0-2])[-/._](?:19|20)[0-9]{2}")
# A credential word, also after an underscore; a sign or a link word; then a value.
_CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?i:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|bearer|auth(?:orization)?))["']?(?:(?P<sign>\x20?[:=]+>?\x20?)|\x20(?:is|was|as|to|of)\x20|\x20)["'`]?(?P<value>[^\s"'`<>|,;]{8,})""", re.ASCII)
#: One of these is in every text where _CONTEXT matches.
_CUES = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")


def ranked_words(model_file: str) -> list[str]:
    """Words of three letters or more of a sentencepiece vocabulary file, in its order, which is by frequency of merges."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    return list(dict.fromkeys(p[1:].lower() for p in pieces if p.startswith("▁") and len(p) > 3 and p[1:].isalpha()))


def alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33


def walk_cost(part: str) -> float | None:
    """log10 guesses of a walk over neighbouring keys: its start, its length, and a direction at each turn."""
    keys = [_PLACE.get(SHIFTED.get(c, c)) for c in part.lower()]
    if None in keys:
        return None
    turns, way = 0, None
    for (a, b), (c, d) in zip(keys, keys[1:], strict=False):
        if (a, b) == (c, d) or abs(a - c) > 1 or abs(b - d) > 1:
            return None
        now = (math.copysign(1, c - a) if c != a else 0, d - b)
        turns, way = turns + (now != way), now
    shifted = sum(c in SHIFTED or c.isupper() for c in part)
    ways = sum(math.comb(n - 1, t - 1) * 47 * 4**t for n in range(2, len(part) + 1) for t in range(1, min(turns, n - 1) + 1))
    return math.log10(ways * (2 if shifted in (0, len(part)) else 2 ** min(shifted, len(part) - shifted)))


def case_ways(part: str) -> int:
    """How many ways of writing capitals come no later than this one."""
    upper = sum(c.isupper() for c in part)
    letters = sum(c.isalpha() for c in part)
    if not upper:
        return 1
    if upper == letters or (upper == 1 and (part[0].isupper() or part[-1].isupper())):
        return 2
    return 2 + sum(math.comb(letters, k) for k in range(1, min(upper, letters - upper) + 1))


class Guesser:
    """Guess costs with one list of ranked words."""

    def __init__(self, words: Iterable[str] = ()):
        self.rank = {w: k for k, w in enumerate(dict.fromkeys([*WORDS, *(w for w in words if 3 <= len(w) <= SPAN)]), 1)}
        pairs, firsts = Counter(), Counter()
        for w in self.rank:
            for a, b in zip("^" + w, w, strict=False):
                pairs[a, b] += 1
                firsts[a] += 1
        self.after = {k: -math.log10((n + 1) / (firsts[k[0]] + 26)) for k, n in pairs.items()}
        self.never = {a: math.log10(n + 26) for a, n in firsts.items()}
        self.own = lru_cache(100_000)(self.own)
        self.unit = lru_cache(20_000)(self.unit)

    def word_cost(self, part: str) -> float | None:
        """log10 guesses of one word: its rank, its capitals, signs that stand for letters, and its reverse."""
        low = part.lower()
        plain = low.translate(_LEET)
        swapped = sum(a != b for a, b in zip(low, plain, strict=True))
        ways = [(self.rank.get(low), 0, 1), (self.rank.get(low[::-1]), 0, 2)]
        if swapped:
            ways += [(self.rank.get(plain), swapped, 1)]
        found = [r * 2**s * turn for r, s, turn in ways if r]
        return math.log10(min(found) * case_ways(part) + 1) if found else None

    def own(self, part: str) -> float | None:
        """Least log10 guesses of one whole part as a word, a date or a keyboard walk; None if it is none of these."""
        costs = [c for c in (self.word_cost(part), walk_cost(part) if len(part) >= 4 else None) if c is not None]
        if len(part) >= 4 and part[0].isdigit():
            if _ALONE.fullmatch(part):
                costs.append(2.2 if len(part) == 4 else 3.3)
            elif len(part) >= 6 and _DATE.fullmatch(part):
                # 365 days in 119 years, and the ways of writing them.
                costs.append(math.log10(365 * 119) + (0.6 if not part.isdigit() else 0.0))
        return min(costs, default=None)

    def unit(self, part: str) -> float:
        """Cost of what a repeat repeats."""
        return self.cost(part)

    def brute(self, value: str, k: int, prose: bool) -> float:
        """Cost of guessing the character at k alone."""
        c = value[k]
        if prose and c.isalpha():
            before = value[k - 1].lower() if k else "^"
            before = before if before.isalpha() else "^"
            return min(self.after.get((before, c.lower()), self.never.get(before, math.log10(26))), 3.0)
        return math.log10(alphabet(c))

    def cost(self, value: str, prose: bool = False, enough: float = math.inf) -> float:
        """log10 of the guesses of the cheapest segmentation of the whole value; or a lower bound of it from `enough` on.

        Parts beyond the first double the arrangements to try.
        """
        n, more = len(value), math.log10(2)
        cost = [0.0] + [math.inf] * n
        copies = [[1] * (SPAN + 1) for _ in range(SPAN + 1)]  # by end modulo SPAN + 1, and unit
        reach, low = SPAN * COPIES, 0
        for end in range(1, n + 1):
            best = cost[end - 1] + self.brute(value, end - 1, prose)
            for start in range(max(0, end - SPAN), end - 2):
                if (own := self.own(value[start:end])) is not None:
                    best = min(best, cost[start] + own + (more if start else 0))
            now = copies[end % (SPAN + 1)]
            for size in range(1, SPAN + 1):
                if end >= 2 * size and value[end - size : end] == value[end - 2 * size : end - size]:
                    now[size] = min(copies[(end - size) % (SPAN + 1)][size] + 1, COPIES)
                    unit = self.unit(value[end - size : end])
                    for k in range(2, now[size] + 1):
                        start = end - k * size
                        best = min(best, cost[start] + unit + math.log10(k) + (more if start else 0))
                else:
                    now[size] = 1
            cost[end] = best
            # Every later segmentation passes one of the last `reach` places.
            if best < enough:
                low = end
            elif end - low >= reach:
                return enough
        return cost[n]


_COMMON = Guesser()


def guess_cost(value: str) -> float:
    """log10 of the guesses of the cheapest segmentation, with the short list of words alone."""
    return _COMMON.cost(value)


def value_end(value: str) -> int:
    """Where a value ends: without the full stop of its sentence and closing brackets that it does not open."""
    end = len(value)
    while end:
        c = value[end - 1]
        if c == "." or (c in ")]}" and value.count(c, 0, end) > value.count("([{"[")]}".index(c)], 0, end)):
            end -= 1
        else:
            break
    return end


def word_shaped(value: str) -> bool:
    """Letters, hyphens and apostrophes alone, in one case but for the first letter."""
    inner = value.replace("-", "").replace("’", "")
    return inner.isalpha() and (inner[1:] == inner[1:].lower() or inner == inner.upper())


def guessed(text: str, base: list[Span], guesser: Guesser) -> Iterator[Span]:
    low = text.lower()
    if not any(k in low for k in _CUES):
        return
    taken = Taken(base)
    for m in _CONTEXT.finditer(text):
        a = m.start("value")
        value = m["value"][: value_end(m["value"])]
        b = a + len(value)
        if len(value) < 8 or taken.touches(a, b):
            continue
        prose = not m["sign"]
        least = PROSE if prose and word_shaped(value) else COSTLY
        if guesser.cost(value, prose, least) >= least:
            yield "guess", a, b


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Iterable[str] = ()) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex (base), n_guess, base_sha256, spans. One narrow pass.

    words, ranked, go beyond the common password words; they travel to the executors with the function.
    """
    shown = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = shown.schema["id"].dataType.simpleString()
    words = list(words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(words)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base = secrets(text)
                more = list(guessed(text, base, guesser))
                held = Counter(k for k, _, _ in base)
                rows.append([held[k] for k in KINDS[:3]] + [len(more), digest(joined(base, KINDS)), joined(base + more, KINDS)])
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.string()) for c in cols[4:]], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    out = map_text(shown, scan, f"id {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
