"""Substring deduplication by level-wise doubling.

Level one takes windows of half the target length. Only their minimizers are looked up: of the half-length windows in
each full-length window the one with the least hash, so two equal full windows always pick the same one, and a quarter
of the windows stands for all. The next level extends what repeats at level one alone to twice that length, here the
target, and finds which windows also start in a document with a smaller id. repeated_spans() goes on doubling until
nothing repeats.

Each level is one shuffle of fixed-size rows dealt by a 64-bit hash. Before it, a batch of documents settles what
repeats inside the batch: a window with any number of copies leaves one row a batch, and one row a document however
often it stands there, so a passage in a third of all documents meets as many rows as there are batches. After it,
sorted partitions are streamed: memory does not depend on how often a window repeats.

Hashes only propose. A batch compares the words of what it settles; a window that is met in another batch is claimed
against its earliest holder, claims on consecutive windows are joined into one, and the claimed words are compared with
the holder's. Windows whose hash met another window's are grouped by their words. So words decide, always.

Texts move compressed, dealt by id, and every later step reads that one exchange.

Defined results: null and empty texts have no words and are kept as the empty string; documents shorter than a window
are untouched; texts of any length are read whole; rows with a null id are kept unchanged and are no one's earlier copy;
rows that repeat an id, with whatever texts, are no earlier copies of each other; ids that are no integers are ordered as
Spark sorts them; an empty table gives no rows. Columns that are neither id nor text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedflow.llm.common import cut, cut_few, integer_ids, map_text

WINDOW = 13
#: Documents whose repeats are settled together before a shuffle.
BATCH = 2048
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_EVERY = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Words:
    """The words of a batch of texts as numbers, equal numbers for equal words: number (of each word, all texts one after
    another), start (where each text's words start, and where the last one's end) and hash (of each word)."""

    def __init__(self, texts: pa.Array):
        """texts: a string or binary column without nulls."""
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = (off - off[0]).astype(np.int64)
        solid = ~_SPACE[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        some = off[:-1][np.diff(off) > 0]  # a text's edge parts words without white space
        first[some] = solid[some]
        some = off[1:][np.diff(off) > 0] - 1
        last[some] = solid[some]
        begin = np.flatnonzero(first)
        ends = np.r_[0, np.cumsum(np.flatnonzero(last) + 1 - begin)].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data[solid])]).dictionary_encode()
        known = words.dictionary
        self.number = words.indices.to_numpy()
        self.start = np.searchsorted(begin, off)
        self.hash = np.fromiter(map(xxhash.xxh64_intdigest, known.to_pylist()), np.uint64, len(known))[self.number]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(word: np.ndarray, n: int, factor: np.uint64 = _M1) -> np.ndarray:
    """Hash of each window of n words, from the words' hashes; by doubling, as a sum of powers."""
    if len(word) < n:
        return word[:0]
    with np.errstate(over="ignore"):
        out, done, power = word[: len(word) - n + 1] * np.uint64(0), 0, np.uint64(1)
        part, size, step = word, 1, factor
        while True:
            if n & size:
                out = out + part[done : done + len(out)] * power
                done, power = done + size, power * step
            if size * 2 > n:
                return _mixed(out)
            part = part[: len(part) - size] + part[size:] * step
            size, step = size * 2, step * step


def _inside(start: np.ndarray, n: int) -> np.ndarray:
    """Places where a window of n words starts that ends in the same text."""
    total = int(start[-1])
    return np.flatnonzero(np.arange(total) + n <= np.repeat(start[1:], np.diff(start)))


def minimizers(h: np.ndarray, at: np.ndarray, half: int, n: int) -> np.ndarray:
    """The place of the least of the half-length hashes in each full window that starts at `at`."""
    if not len(at):
        return at
    view = np.lib.stride_tricks.sliding_window_view(h, n - half + 1)
    return at + view.argmin(1)[at]


def _same(ids: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from a on are those from b on."""
    out = np.ones(len(a), bool)
    for k in range(n):
        out &= ids[a + k] == ids[b + k]
    return out


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Number of the first row of the run of equal keys that each row of sorted arrays is in."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


#: x holds a place and below it BITS bits: how many places follow each other from there in settled rows, which only pass
#: through. Settled places are below KNOWN; KNOWN tells that a window repeats.
_NAMES = ["h", "id", "sub", "x"]
_KIND = "h long, id long, sub long, x long"
KNOWN = -1
BITS = 16
_MANY = (1 << BITS) - 1


def _sent(settled: tuple[np.ndarray, ...], rest: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """Rows (id, sub, at) that are settled, as ranges, and rows (h, id, sub, at) that go on."""
    ident, sub, at = settled
    order = np.lexsort((at, sub, ident))
    ident, sub, at = ident[order], sub[order], at[order]
    starts = np.ones(len(at), bool)
    starts[1:] = (ident[1:] != ident[:-1]) | (sub[1:] != sub[:-1]) | (at[1:] != at[:-1] + 1) | (at[1:] % _MANY == 0)
    first = np.flatnonzero(starts)
    n = np.diff(np.r_[first, len(at)])
    ident, sub, at = ident[first], sub[first], at[first]
    with np.errstate(over="ignore"):  # what deals out a settled row is its place
        place = _mixed(ident.astype(np.uint64) * _M2 + at.astype(np.uint64))
    h, r_ident, r_sub, r_at = rest
    x = np.r_[r_at * (1 << BITS), (KNOWN - 1 - at) * (1 << BITS) + n]
    return pa.RecordBatch.from_arrays([pa.array(np.r_[h, place].view(np.int64)), pa.array(np.r_[r_ident, ident]), pa.array(np.r_[r_sub, sub]), pa.array(x)], _NAMES)


def _repeated(h: np.ndarray) -> np.ndarray:
    """Values that occur twice or more."""
    h = np.sort(h)
    return np.unique(h[1:][h[1:] == h[:-1]])


def _settle_some(h: np.ndarray, ident: np.ndarray, sub: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """One row a document and hash. Of hashes that two ids of the batch hold all rows are settled, and one row tells the
    other batches that the hash repeats."""
    alone = np.isin(h, _repeated(h), invert=True)
    some = np.flatnonzero(~alone)
    some = some[np.lexsort((at[some], doc[some], ident[some], h[some]))]
    some = some[_firsts(h[some], doc[some]) == np.arange(len(some))]
    first = _firsts(h[some])
    shared = np.zeros(len(some), bool)
    shared[first[ident[some] != ident[some[first]]]] = True
    shared = shared[first]
    tells, open_ = some[shared & (first == np.arange(len(some)))], np.r_[np.flatnonzero(alone), some[~shared]]
    rest = [np.r_[c[open_], c[tells]] for c in (h, ident, sub, at)]
    rest[3][len(open_) :] = KNOWN
    shared = some[shared]
    return _sent((ident[shared], sub[shared], at[shared]), tuple(rest))


def _settle_later(ids: np.ndarray, n: int, h: np.ndarray, ident: np.ndarray, sub: np.ndarray, doc: np.ndarray, place: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows that a smaller id of the batch also holds, by their words, are settled; of the rest one row a document,
    hash and words goes on."""
    alone = np.isin(h, _repeated(h), invert=True)
    some = np.flatnonzero(~alone)
    some = some[np.lexsort((place[some], doc[some], ident[some], h[some]))]
    lead, own = _firsts(h[some]), _firsts(h[some], doc[some])
    settled = ident[some] != ident[some[lead]]
    settled[settled] = _same(ids, place[some[settled]], place[some[lead[settled]]], n)
    again = ~settled & (own != np.arange(len(some))) & ~settled[own]
    again[again] = _same(ids, place[some[again]], place[some[own[again]]], n)
    go, settled = np.r_[np.flatnonzero(alone), some[~settled & ~again]], some[settled]
    return _sent((ident[settled], sub[settled], at[settled]), (h[go], ident[go], sub[go], at[go]))


def _range(at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """n places that follow each other from `at` on, in one number."""
    return at * (1 << BITS) + n


def _decide_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, known first, id: gives (id, sub, x) of the rows whose hash two ids hold.

    Of the run that is open between batches only its hash, its first id, whether it repeats and its rows so far are
    kept; these are rows of one id, of which a document has one.
    """
    key = least = None
    repeats, waiting = False, []
    for b in batches:
        if not b.num_rows:
            continue
        h, ident, sub, x = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        at = x >> BITS
        settled = at < KNOWN
        out = [(ident[settled], sub[settled], _range(KNOWN - 1 - at[settled], x[settled] & _MANY))]
        h, ident, sub, at = (c[~settled] for c in (h, ident, sub, at))
        if len(h):
            first = _firsts(h)
            goes_on = key == h[0]
            lows = ident[first]
            if goes_on:
                lows[first == 0] = least
            told = np.zeros(len(h), bool)
            told[first[(ident != lows) | (at == KNOWN)]] = True
            if goes_on:
                told[0] |= repeats
                if told[0]:
                    out += waiting
            hit = told[first] & (at != KNOWN)
            x = _range(at, 1)
            out.append((ident[hit], sub[hit], x[hit]))
            last = first == first[-1]
            repeats = bool(told[first[-1]])
            held = waiting if goes_on and first[-1] == 0 else []
            waiting = [] if repeats else [*held, (ident[last], sub[last], x[last])]
            key, least = h[-1], lows[-1]
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "sub", "x"])


def _decide_later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, id: gives (id, sub, x, wid, wsub, wat) of settled rows (wat -1), and of all rows but the first of
    each hash, which is their witness."""
    key = None
    witness: tuple = ()
    for b in batches:
        if not b.num_rows:
            continue
        h, ident, sub, x = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        at = x >> BITS
        s = at < KNOWN
        out = [(ident[s], sub[s], _range(KNOWN - 1 - at[s], x[s] & _MANY), ident[s], sub[s], np.full(int(s.sum()), -1))]
        h, ident, sub, at = (c[~s] for c in (h, ident, sub, at))
        if len(h):
            first = _firsts(h)
            w = [c[first] for c in (ident, sub, at)]
            hit = first != np.arange(len(h))
            if key == h[0]:
                for c, v in zip(w, witness, strict=True):
                    c[first == 0] = v
                hit[0] = True
            key, witness = h[-1], tuple(c[-1] for c in w)
            out.append((ident[hit], sub[hit], _range(at[hit], 1), *(c[hit] for c in w)))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "sub", "x", "wid", "wsub", "wat"])


def _dealt(rows: DataFrame) -> DataFrame:
    known = F.shiftright("x", BITS) == KNOWN
    return rows.repartition("h").sortWithinPartitions("h", known.desc(), "id", "sub", "x")


def _first_level(docs: DataFrame, half: int, window: int) -> DataFrame:
    """(id, sub, x): the first place in a document of each minimizer that two ids hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = Words(b.column(2))
            start, h = words.start, window_hashes(words.hash, half)
            chosen = np.unique(minimizers(h, _inside(start, window), half, window))
            if len(chosen):
                doc = np.searchsorted(start, chosen, "right") - 1
                yield _settle_some(h[chosen], b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc], doc, chosen - start[doc])

    return _dealt(map_text(docs, run, _KIND, BATCH)).mapInArrow(_decide_some, "id long, sub long, x long")


def _marked(texts: DataFrame, marks: DataFrame, how: str = "inner") -> DataFrame:
    """texts (id, sub, z) with a list of each column of the marks of each."""
    rest = [c for c in marks.columns if c not in ("id", "sub")]
    return texts.join(marks.groupBy("id", "sub").agg(*(F.collect_list(c).alias(c) for c in rest)), ["id", "sub"], how).select("id", "sub", "z", *rest)


def _lists(b: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of the list columns from the fourth on: the row of each element, and the elements of each column."""
    row, out = np.zeros(0, np.int64), []
    for k in range(3, b.num_columns):
        off = b.column(k).offsets.to_numpy()
        out.append(b.column(k).values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False))
        row = np.repeat(np.arange(b.num_rows), np.diff(off))
    return row, out


def _places(start: np.ndarray, row: np.ndarray, x: np.ndarray, reach: int) -> np.ndarray:
    """The places, among all words of a batch, of the marks x of its rows that leave room for a window of `reach` words."""
    at, n = x >> BITS, x & _MANY
    places = np.repeat(start[row] + at, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.unique(places[places + reach <= np.repeat(start[row + 1], n)])


def _plain_texts(column: pa.Array) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor().decompress
    return [open_(z) for z in column.to_pylist()]


def _full_windows(marked: DataFrame, half: int, window: int, settle: Callable) -> DataFrame:
    """Rows to deal: full windows over the marked minimizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = Words(pa.array(_plain_texts(b.column(2)), pa.binary()))
            ids, start, h = words.number, words.start, window_hashes(words.hash, half)
            at = _inside(start, window)
            # A hash repeats or does not, so what one document's mark tells holds for the batch.
            row, (x, *_) = _lists(b)
            at = at[np.isin(h[minimizers(h, at, half, window)], h[_places(start, row, x, half)])]
            if len(at):
                doc = np.searchsorted(start, at, "right") - 1
                yield settle(ids, window, window_hashes(words.hash, window, _M2)[at], b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc], doc, at, at - start[doc])

    return map_text(marked, run, _KIND, BATCH)


def _claims(marked: DataFrame, window: int) -> DataFrame:
    """(id, sub, wat, mid, msub, x, words): consecutive windows of (mid, msub), the range x, that its witness (id, sub) is
    said to hold from wat on, and their words; what a document has settled stands under its own id, as packed ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            row, (x, wid, wsub, wat) = _lists(b)
            idents, subs = b.column(0).to_numpy(), b.column(1).to_numpy()
            out: list[tuple] = []
            done = wat < 0
            if done.any():
                own, packed = row[done], x[done]
                cuts = np.flatnonzero(np.diff(own)) + 1
                out += [(int(idents[r]), int(subs[r]), -1, int(idents[r]), int(subs[r]), 0, part.tobytes()) for r, part in zip(own[np.r_[0, cuts]].tolist(), np.split(packed, cuts), strict=True)]
            row, x, wid, wsub, wat = (c[~done] for c in (row, x, wid, wsub, wat))
            at = x >> BITS
            order = np.lexsort((at, wat - at, wsub, wid, row))
            row, at, wid, wsub, wat = (c[order] for c in (row, at, wid, wsub, wat))
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (wid[1:] != wid[:-1]) | (wsub[1:] != wsub[:-1]) | (wat[1:] != wat[:-1] + 1) | (at[1:] != at[:-1] + 1)
            new[1:] |= np.arange(1, len(at)) % _MANY == 0
            first = np.flatnonzero(new)
            n = np.diff(np.r_[first, len(at)])
            row, at, wid, wsub, wat = (c[first] for c in (row, at, wid, wsub, wat))
            now, split = -1, []
            for r, a, k, i, s, w in zip(row.tolist(), at.tolist(), n.tolist(), wid.tolist(), wsub.tolist(), wat.tolist(), strict=True):
                if r != now:
                    now, split = r, _plain_texts(b.column(2).slice(r, 1))[0].split()
                out.append((i, s, w, int(idents[r]), int(subs[r]), a * (1 << BITS) + k, pack(b" ".join(split[a : a + k + window - 1]))))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.binary())], ["id", "sub", "wat", "mid", "msub", "x", "words"])

    return map_text(marked, run, "id long, sub long, wat long, mid long, msub long, x long, words binary", BATCH)


def _verified(claims: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(id, sub, x, words): windows that an earlier id holds; with words, those for which the witness was wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        seen, theirs = None, []
        for b in batches:
            out = []
            for wid, wsub, wat, ident, sub, x, shown, z in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                if wat < 0:
                    out += [(ident, sub, x, None) for x in np.frombuffer(shown, np.int64).tolist()]
                    continue
                if seen != (wid, wsub):
                    seen, theirs = (wid, wsub), open_(z).split()
                mine = open_(shown).split(b" ")
                held = theirs[wat : wat + len(mine)]
                if mine == held:
                    if ident != wid:  # places of one id are no copies of each other
                        out.append((ident, sub, x, None))
                    continue
                same = [p == q for p, q in zip(mine, held, strict=True)]
                for k in range(x & _MANY):
                    one = ((x >> BITS) + k) * (1 << BITS) + 1
                    if not all(same[k : k + window]):
                        out.append((ident, sub, one, b" ".join(mine[k : k + window])))
                    elif ident != wid:
                        out.append((ident, sub, one, None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.binary())], ["id", "sub", "x", "words"])

    both = claims.join(texts.hint("merge"), ["id", "sub"]).select("id", "sub", "wat", "mid", "msub", "x", "words", "z")
    return map_text(both, run, "id long, sub long, x long, words binary", BATCH)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Rows (id, sub, t) of docs that have an id, integers in the order of the given ids; of them one of each (id, sub), the
    same frame if no id repeats; the rows without an id; and (id, name) if the ids were no integers.

    sub tells the texts of an id apart: 0 where the id has one row, else a hash of the text.
    """
    rows, names = integer_ids(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")))
    none = F.lit(0).cast("long").alias("sub")
    rest, named = rows.where("id is null").select("id", none, "t"), rows.where("id is not null")
    again = cut_few(named.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id", F.lit(True).alias("again")))
    if again.isEmpty():
        named = named.select("id", none, "t")
        return named, named, rest, names
    named = named.join(again, "id", "left").select("id", F.when(F.col("again"), F.xxhash64("t")).otherwise(F.lit(0)).cast("long").alias("sub"), "t")
    return named, named.dropDuplicates(["id", "sub"]), rest, names


def _packed(rows: DataFrame) -> DataFrame:
    """(id, sub, z) of rows (id, sub, t): the text compressed, as it is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()], pa.binary())], ["id", "sub", "z"])

    # The filter says what joins would infer of the frame, some of them only: with it all of them read the same exchange.
    return map_text(rows, run, "id long, sub long, z binary").where("id is not null and sub is not null")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, trusted: int = int(_EVERY)) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window of `window` words that covers it also starts in a document with a smaller id. trusted masks
    the hash that proposes equal windows: fewer bits change no result, only the number of claims that fail.
    """
    half = (window + 1) // 2
    # A row that repeats another one whole has its answer. Where no id repeats, all steps read one exchange of the texts.
    rows, once, rest, names = _numbered(docs, id_col, text_col)
    texts = _packed(once)
    settle = lambda ids, n, h, *rest: _settle_later(ids, n, h & np.uint64(trusted), *rest)
    met = _dealt(_full_windows(_marked(texts, _first_level(once, half, window)), half, window, settle))
    met = met.mapInArrow(_decide_later, "id long, sub long, x long, wid long, wsub long, wat long")
    found = _verified(_claims(_marked(texts, met), window), texts, window).repartition("id", "sub")
    wrong = found.where("words is not null")
    first = wrong.groupBy("words").agg(F.min("id").alias("first"))
    late = wrong.join(first.hint("merge"), "words").where("id > first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _plain_texts(b.column(2))
            shown, gone = [], []
            row, (x,) = _lists(b)
            kept = [None] * len(texts)
            if len(row):
                at, row = np.unique(row, return_inverse=True)
                words = Words(pa.array([texts[k] for k in at.tolist()], pa.binary()))
                start = words.start
                places = _spread(words, _places(start, row, x, window), window)
                edge = np.zeros(int(start[-1]) + 1, np.int64)
                edge[places] += 1
                np.subtract.at(edge, places + window, 1)
                stays = np.cumsum(edge[:-1]) == 0
                for k, lo, hi in zip(at.tolist(), start[:-1].tolist(), start[1:].tolist(), strict=True):
                    kept[k] = stays[lo:hi].tolist()
            for text, keep in zip(texts, kept, strict=True):
                all_ = text.split()
                left = all_ if keep is None else list(compress(all_, keep))
                shown.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                gone.append((len(all_), len(all_) - len(left)))
            n, dropped = zip(*gone, strict=True) if gone else ([], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shown, pa.string())], ["id", "n_words", "n_removed", "kept"])

    marked = _marked(texts if once is rows else _packed(rows), found.where("words is null").drop("words"), "left")
    none = F.array().cast("array<bigint>")
    marked = marked.join(late.groupBy("id", "sub").agg(F.collect_list("x").alias("late")).hint("merge"), ["id", "sub"], "left")
    marked = marked.select("id", "sub", "z", F.concat(F.coalesce("x", none), F.coalesce("late", none)).alias("x"))
    bare = F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "")
    rest = rest.select("id", F.size(bare).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join(bare, " ").alias("kept"))
    out = map_text(marked, run, "id long, n_words long, n_removed long, kept string", BATCH).unionByName(rest)
    if names is not None:
        out = out.join(names, "id", "left").withColumn("id", F.col("name"))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept")


def _spread(words: Words, places: np.ndarray, n: int) -> np.ndarray:
    """The marked places and all places of the same documents whose window has the words of a marked one."""
    start = words.start
    at, h = _inside(start, n), window_hashes(words.hash, n)
    doc = np.searchsorted(start, at, "right") - 1
    marked = np.zeros(int(start[-1]) + 1, bool)
    marked[places] = True
    # Most windows stand once in their document.
    with np.errstate(over="ignore"):
        own = _mixed(h[at] + doc.astype(np.uint64) * _M2)
    some = np.isin(own, _repeated(own))
    at, doc = at[some], doc[some]
    order = np.lexsort((~marked[at], h[at], doc))
    at, doc = at[order], doc[order]
    lead = _firsts(doc, h[at])  # a marked one where the document has one
    more = marked[at[lead]] & ~marked[at]
    more[more] = _same(words.number, at[more], at[lead[more]], n)
    marked[at[more]] = True
    return np.flatnonzero(marked[:-1])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, at, length): window starts that repeat in another document, at the greatest of the lengths window,
    2 x window, 4 x window ... that repeats there. The loop ends when no window survives a doubling. Windows are told
    apart by a 64-bit hash of the words."""
    half = (window + 1) // 2
    _, named, _, names = _numbered(docs, id_col, text_col)
    texts = _packed(named)
    some = lambda ids, n, h, ident, sub, doc, place, at: _settle_some(h, ident, sub, doc, at)

    def level(marked: DataFrame, length: int) -> DataFrame:
        return _dealt(marked).mapInArrow(_decide_some, "id long, sub long, x long")

    def every_place(found: DataFrame, length: int) -> DataFrame:
        """(id, sub, at): all places of the repeated windows, of which a document names the first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = Words(pa.array(_plain_texts(b.column(2)), pa.binary()))
                start = words.start
                row, (x,) = _lists(b)
                at = _spread(words, _places(start, row, x, length), length)
                doc = np.searchsorted(start, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[doc]), pa.array(b.column(1).to_numpy()[doc]), pa.array((at - start[doc]).astype(np.int32))], ["id", "sub", "at"])

        return map_text(_marked(texts, found), run, "id long, sub long, at int", BATCH)

    def longer(marked: DataFrame, length: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = Words(pa.array(_plain_texts(b.column(2)), pa.binary()))
                row, (x,) = _lists(b)
                start, at = words.start, _places(words.start, row, x, length)
                if len(at):
                    doc = np.searchsorted(start, at, "right") - 1
                    yield _settle_some(window_hashes(words.hash, length, _M2)[at], b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc], doc, at - start[doc])

        return map_text(marked, run, _KIND, BATCH)

    now = cut(every_place(level(_full_windows(_marked(texts, _first_level(named, half, window)), half, window, some), window), window))
    length, found = window, None
    while not now.isEmpty():
        tier = now.withColumn("length", F.lit(length))
        found = tier if found is None else found.unionByName(tier)
        # A window of twice the length can repeat only where both its halves do.
        ahead = now.select("id", "sub", (F.col("at") - length).cast("int").alias("at"))
        starts = now.join(ahead, ["id", "sub", "at"], "left_semi").select("id", "sub", (F.col("at").cast("long") * (1 << BITS) + 1).alias("x"))
        now = cut(every_place(level(longer(_marked(texts, starts), 2 * length), 2 * length), 2 * length))
        length *= 2
    if found is None:
        found = now.withColumn("length", F.lit(length))
    out = found.groupBy("id", "sub", "at").agg(F.max("length").alias("length"))
    if names is not None:
        out = out.join(names, "id").withColumn("id", F.col("name"))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "at", "length")
