"""Token counts of whole texts under a public byte-pair vocabulary, by rank-synchronous array merging.

Pre-tokens of a batch lie in one ragged integer array. In every round each sequence's lowest-rank adjacent pair
(leftmost on a tie) is merged, all sequences at once, until no sequence has a pair left; what survives are tokens.
Texts are cut only between characters that stand side by side in no piece, so no merge can cross a cut; equal
pre-tokens are merged once and remembered in a bounded table. A pre-token longer than LONG symbols follows the same
rule with a heap: a round costs its whole length and merges one pair, so rounds would cost the square of the length (16,000 symbols: 2.4 s by rounds, 0.03 s by the heap; 512: 0.02 s and 0.001 s).

Defined results: null or empty text has 0 tokens. Nothing is truncated, texts of any length are counted whole. The text
column may hold any string. Pairs that tie in rank are merged from the left. Rows that repeat an id are counted by their
own texts; an empty table gives no rows; columns that are neither id nor text are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedflow.llm.common import map_text

LONG = 512
REMEMBERED = 400_000
LIMIT = 4096


class PairTable:
    """Places of keys in an array, found for whole arrays of keys at once: open addressing over a power of two of slots."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.at = np.full(1 << self.bits, -1, dtype=np.int32)
        rest = np.arange(len(keys))
        slot = self.slot(keys)
        while len(rest):
            free = self.keys[slot[rest]] == -1
            self.keys[slot[rest[free]]] = keys[rest[free]]  # of several for one slot, the last stays
            won = self.keys[slot[rest]] == keys[rest]
            self.at[slot[rest[won]]] = rest[won]
            rest = rest[~won]
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places; -1 where a key is not held."""
        slot = self.slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.at[slot], -1)
        rest = np.flatnonzero((held != keys) & (held != -1))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = self.at[slot[rest[hit]]]
            rest = rest[~hit & (held != -1)]
        return out


class PieceMerger:
    """Counts the tokens of a sentencepiece BPE model with byte fallback, dummy prefix and escaped spaces."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        scores = {p: sp.get_score(i) for p, i in pieces.items()}
        self.ids = pieces
        self.size = sp.vocab_size() + 1
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = sorted((pieces[p[:k]] * self.size + pieces[p[k:]], order[scores[p]], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces)
        keys, self.ranks, self.made = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.pairs = PairTable(keys)
        self.table = {k: (r, m) for k, r, m in pairs}
        chars = sorted({c for p in pieces for c in p})
        self.char_id = np.full(0x110000, -1, dtype=np.int32)
        self.char_no = np.zeros(0x110000, dtype=np.int32)  # 0: in no piece
        for no, c in enumerate(chars, 1):
            self.char_id[ord(c)], self.char_no[ord(c)] = pieces.get(c, -1), no
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for p in pieces:
            no = self.char_no[[ord(c) for c in p]]
            self.beside[no[:-1], no[1:]] = True
        held = {c for p in pieces if len(p) > 1 for c in p}
        inner = any("▁" in p.lstrip("▁") for p in pieces)
        apart = "".join(re.escape(c) for c in "\n\t\r" if c not in held)
        self.cutter = None if inner else re.compile(rf"▁+[^▁{apart}]*|[^▁{apart}]+" + (f"|[{apart}]" if apart else ""))
        self.lines = self.cutter is not None and "\n" not in held
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens as keys: "▁" and a piece of the escaped text, or in plain texts a word ("▁" goes before it) or a line feed and a word."""
        if not text:
            return []
        if self.lines and "  " not in text and "▁" not in text and text[0] != " ":
            return text.replace("\n", " \n").split(" ")
        shown = "▁" + text.replace(" ", "▁")
        return ["▁" + x for x in (self.cutter.findall(shown) if self.cutter else [shown])]

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [self.split(t or "") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        if new := list(set().union(*split).difference(known)):
            known.update(zip(new, self.merged([k[1:] if k[:1] == "▁" else k if k[:1] == "\n" else "▁" + k for k in new]).tolist(), strict=True))
        return [sum(map(known.__getitem__, words)) for words in split]

    def merged(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, all words at once."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        no = self.char_no[code]
        start = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | ~self.beside[no[:-1], no[1:]]])
        lengths = np.diff(np.r_[start, len(code)])
        symbols, owner = self.char_id[code].astype(np.int64), word[start]
        alone = (lengths == 1) & (symbols[start] < 0)
        spelt = code[start]
        left = np.where(alone, 1 + (spelt > 0x7F) + (spelt > 0x7FF) + (spelt > 0xFFFF), 1)
        many = (lengths > 1) & (lengths <= LONG)
        left[many] = self.rounds(symbols[np.repeat(many, lengths)], lengths[many])
        for k in np.flatnonzero(lengths > LONG):
            left[k] = self.heaped(symbols[start[k] : start[k] + lengths[k]].tolist())
        return np.bincount(owner, left, len(words)).astype(np.int64)

    def rounds(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence of a ragged array when no pair is left to merge."""
        left = lengths.copy()
        seq = np.repeat(np.arange(len(lengths)), lengths)
        none = np.iinfo(np.int64).max
        while len(symbols) > 1:
            at = self.pairs.find(symbols[:-1] * self.size + symbols[1:])
            rank = np.where((at >= 0) & (seq[:-1] == seq[1:]), self.ranks[at], none)
            start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            # Rank and place in one number, so that the least one is the leftmost pair of the lowest rank.
            place = np.where(rank == none, none, (rank << 32) | np.arange(len(rank)))
            best = np.minimum.reduceat(np.r_[place, none], start)
            live = best != none
            if not live.any():
                break
            pos = best[live] & 0xFFFFFFFF
            symbols[pos] = self.made[at[pos]]
            left[seq[pos]] -= 1
            keep = np.repeat(live, np.diff(np.r_[start, len(seq)]))
            keep[pos + 1] = False
            symbols, seq = symbols[keep], seq[keep]
        return left

    def heaped(self, part: list[int]) -> int:
        """The same rule for one very long sequence."""
        n, size, table = len(part), self.size, self.table
        sym, right, left = list(part), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(table[k][0], i, sym[i], sym[i + 1]) for i in range(n - 1) if (k := sym[i] * size + sym[i + 1]) in table]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if sym[i] is not None else n
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = table[a * size + b][1], None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            count -= 1
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (k := sym[x] * size + sym[y]) in table:
                    heapq.heappush(heap, (table[k][0], x, sym[x], sym[y]))
        return count


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). One narrow pass, no shuffle."""
    shown = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = shown.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = PieceMerger(model_file)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, map(str.encode, texts)), pa.int64()), pa.array(merger.counts(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = map_text(shown, count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
