"""SimHash near-duplicates by segment-popcount embedding and a grid range join.

A 64-bit fingerprint becomes 32 coordinates: the number of set bits in each two-bit segment. The Manhattan distance
of two embeddings never exceeds the Hamming distance of the fingerprints. Within a radius of 3 one of the two
16-coordinate halves differs by at most 1, so a fingerprint is filed under the grid cell of each half, and looked up
from the cells one step above: a pair meets in the cell of either of its halves. Pairs that meet are first held
against the lower bound of the full embedding and then verified bit by bit. No cell is gathered into all its pairs: a
cell gives the links of a spanning forest, found block by block, so dense cells neither grow memory nor output.

A cell that more than CROWD fingerprints call their own is dealt out further: of the four quarters of its points' other
half at least one is equal in any two points within three, so each point goes to four smaller cells, one a quarter.

Only distinct fingerprints are embedded, so copies of one text cost one row whatever their number.

Defined results: null and empty texts have no shingle and fingerprint zero, linked like any other; texts of fewer
words than a shingle are one shingle; texts of any length are read whole; of fingerprints that tie any link will do;
rows that repeat an id share its least component only if their texts are near, and are documents of their own if not;
an empty table gives no rows; columns that are neither id nor text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedflow.llm.common import cut, cut_few, integer_ids, map_text, small
from deedflow.llm.components import components

RADIUS = 3
#: Words of a fingerprint's shingles.
SHINGLE = 3
#: Cells of near copies: BANDS of them a document, each of ROWS least hashes.
BANDS, ROWS = 32, 4
BLOCK = 1024
#: A cell of more home points is dealt out by quarters of their other half.
CROWD = 4096
#: Up to this many ids are broadcast, eight bytes each.
NODES = 1_000_000
_PAIRS = np.uint64(0x5555555555555555)


def fingerprint(words: list[bytes], shingle: int) -> int:
    """SimHash of a text's shingles; of its different words if shingle is 0."""
    if not words:
        return 0
    if shingle == 0:
        parts = set(words)
        n = len(parts)
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, n)
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < 256:
        votes = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:  # by counts of byte values, which are fewer than the shingles
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        votes = np.concatenate([np.bincount(octets[:, k], minlength=256) @ bits for k in range(8)])
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingles: list[int]) -> DataFrame:
    """(id, fp0, fp1, ...): a fingerprint as a signed long for each shingle length."""
    shown = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = shown.schema["id"].dataType.simpleString()
    names = [f"fp{k}" for k in range(len(shingles))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.zeros((len(shingles), b.num_rows), np.uint64)
            for row, text in enumerate(b.column(1).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                fps[:, row] = [fingerprint(words, n) for n in shingles]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f.view(np.int64)) for f in fps)], ["id", *names])

    return map_text(shown, run, f"id {kind}, " + ", ".join(f"{n} long" for n in names))


def embed(fp: np.ndarray) -> np.ndarray:
    """The 32 counts (0 to 2) of a fingerprint, packed two bits each."""
    return (fp & _PAIRS) + ((fp >> np.uint64(1)) & _PAIRS)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings: each field is the size of its difference, 0 to 2."""
    # Equal to the sum of |x - y| over fields: a difference of 2 is 10 against 00, of 1 has odd sum.
    odd = (a ^ b) & _PAIRS
    two = ((a >> np.uint64(1)) ^ (b >> np.uint64(1))) & _PAIRS & ~odd
    return np.bitwise_count(odd) + 2 * np.bitwise_count(two)


def _half_keys(packed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Cells of each half, then the cells one step above; with a mask of the points that have that cell, and are not its own."""
    for half in range(2):
        cell, tag = (packed >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF), np.uint64(half) << np.uint64(32)
        yield cell | tag, None
        for k in range(16):
            up = ((cell >> np.uint64(2 * k)) & np.uint64(3)) < 2
            yield (cell[up] + (np.uint64(1) << np.uint64(2 * k))) | tag, up


def _block_keys(packed: np.ndarray, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Cells of every two of `blocks` blocks of segments."""
    edges = [round(64 * k / blocks / 2) * 2 for k in range(blocks + 1)]
    field = [((1 << (z - a)) - 1) << a for a, z in zip(edges[:-1], edges[1:], strict=True)]
    for no, (a, b) in enumerate(combinations(range(blocks), 2)):
        with np.errstate(over="ignore"):
            mixed = ((packed & np.uint64(field[a] | field[b])) + np.uint64(no + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        yield mixed ^ (mixed >> np.uint64(29)), None


def _cells(blocks: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, fp, other) of each point in its cells (own), and in the cells one step above (not own)."""
        for b in batches:
            whole = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            for at in range(0, b.num_rows, 8192):
                cols = [c[at : at + 8192] for c in whole]
                packed = embed(cols[1].view(np.uint64))
                parts = []
                for keys, up in _half_keys(packed) if blocks is None else _block_keys(packed, blocks):
                    own = cols if up is None else [c[up] for c in cols]
                    parts.append((keys.view(np.int64), np.full(len(keys), up is None), *own))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["cell", "own", "node", "fp", "other"])

    return run


def forest(fp: np.ndarray, other: np.ndarray, n_own: int, radius: int, other_radius: int) -> np.ndarray:
    """Links (index pairs) of one cell, thinned to what keeps its points connected. The first n_own points are its own.

    Blocks of points are compared at once. Points that earlier blocks have joined are not linked again, and two blocks
    that lie in one component are not compared at all, so dense cells of copies stay cheap.
    """
    packed, label = embed(fp), np.arange(len(fp))
    out: list[tuple[int, int]] = []
    for i in range(0, n_own, BLOCK):
        left = slice(i, min(i + BLOCK, n_own))
        for j in range(i, len(fp), BLOCK):
            right = slice(j, j + BLOCK)
            if (label[left] == label[j]).all() and (label[right] == label[j]).all():
                continue
            # The embeddings' distance is a lower bound; what passes is verified bit by bit.
            x, y = np.nonzero(_apart(packed[left, None], packed[None, right]) <= radius)
            x, y = x + i, y + j
            apart = np.bitwise_count(other[x] ^ other[y])
            good = (np.bitwise_count(fp[x] ^ fp[y]) <= radius) & (apart <= other_radius) & (x != y)
            x, y, apart = x[good], y[good], apart[good]
            # Nearest pairs first, so that points hang together by their closest links.
            for step in np.unique(apart):
                p, q = x[apart == step], y[apart == step]
                while len(p := p[fresh := label[p] != label[q]]):
                    q = q[fresh]
                    for k in np.unique(p, return_index=True)[1].tolist():
                        lo, hi = sorted((label[p[k]], label[q[k]]))
                        if lo != hi:
                            label[label == hi] = lo
                            out.append((p[k], q[k]))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def _links(radius: int, other_radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell, own first; a cell may span batches."""
        held: list[list[np.ndarray]] = []

        def done():
            cell, own, node, fp, other = (np.concatenate(c) for c in zip(*held, strict=True))
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            end = np.r_[start[1:], len(cell)]
            links = []
            # Cells of one point, and those in which no point is at home, hold no pair.
            some = (end - start > 1) & own[start]
            for s, e in zip(start[some].tolist(), end[some].tolist(), strict=True):
                links.append(forest(fp[s:e].view(np.uint64), other[s:e].view(np.uint64), int(own[s:e].sum()), radius, other_radius) + s)
            if links and len(pairs := np.concatenate(links)):
                yield pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last cell of the batch may go on in the next one
            if held and (last or held[-1][0][-1] != cols[0][0]):
                held.append([c[:last] for c in cols])
                yield from done()
                held = []
            elif last:
                held = [[c[:last] for c in cols]]
                yield from done()
                held = []
            held.append([c[last:] for c in cols])
        if held:
            yield from done()

    return run


def _halves(fp: Column) -> list[Column]:
    """The packed counts of the low and of the high half of a fingerprint, as numbers of 32 bits."""
    pairs = F.lit(0x55555555).cast("long")
    of = lambda x: x.bitwiseAND(pairs) + F.shiftrightunsigned(x, 1).bitwiseAND(pairs)
    return [of(fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), of(F.shiftrightunsigned(fp, 32))]


def crowded(points: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(cell) of the half cells that more than `crowd` points (fp) call their own."""
    low, high = _halves(F.col("fp"))
    own = F.array(low, high + F.lit(1 << 32).cast("long"))
    return points.select(F.explode(own).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > crowd).select("cell")


def _dealt_out(cells: DataFrame, crowds: DataFrame) -> DataFrame:
    """cells with the rows of crowded cells in four cells each, by the quarters of the other half of the embedding."""
    low, high = _halves(F.col("fp"))
    other = F.when(F.col("cell") < (1 << 32), high).otherwise(low)
    quarters = F.array(*(F.xxhash64("cell", F.lit(k), F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(0xFF).cast("long"))) for k in range(4)))
    marked = cells.join(small(crowds.withColumn("crowd", F.lit(True))), "cell", "left")
    return marked.withColumn("cell", F.explode(F.when(F.col("crowd"), quarters).otherwise(F.array("cell")))).select(cells.columns)


def _linked(points: DataFrame, radius: int, other_radius: int, blocks: int | None, crowd: int = CROWD) -> DataFrame:
    cells = points.mapInArrow(_cells(blocks), "cell long, own boolean, node long, fp long, other long")
    if blocks is None:
        crowds = cut_few(crowded(points, crowd))
        cells = cells if crowds.isEmpty() else _dealt_out(cells, crowds)
    dealt = cells.repartition("cell").sortWithinPartitions("cell", F.col("own").desc())
    return dealt.mapInArrow(_links(radius, other_radius), "a long, b long")


def linked(distinct: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect the fingerprints of column fp which lie within radius bits (at most 3) of each other."""
    if not 0 <= radius <= 3:
        raise ValueError("cells of halves hold every pair only up to 3 bits")
    return _linked(distinct.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("other")), radius, 0, None, crowd)


def fingerprint_groups(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) of fps (id, fp): the least id of the fingerprints that links within radius bits reach from fp."""
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(linked(classes, radius), "a", "b")
    classes = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Classes of one component meet by partial aggregates; most are alone in theirs.
    heads = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return classes.join(heads, "root").select("fp", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (least id linked to it, itself included)."""
    fps = cut(fingerprints(docs, id_col, text_col, [shingle]).withColumnRenamed("fp0", "fp"))
    named = fingerprint_groups(fps, radius)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, "fp").select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _parts(words: list[bytes], shingle: int) -> Iterator[bytes]:
    """Shingles of a text's words; texts of fewer words are one shingle."""
    return map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)] * bool(words))


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, n, s) of docs (id, t): the number of different shingles and their 32-bit hashes, sorted and packed."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(np.fromiter(map(xxhash.xxh32_intdigest, _parts(_words(text), shingle)), np.uint32)) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "n", "s"])

    return map_text(docs, run, f"id {kind}, n int, s binary")


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS least hashes of a set; two sets agree in each with the probability of their Jaccard similarity."""
    by = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 1024):
            out = np.minimum(out, (by[:, None] * hashes[None, at : at + 1024]).min(1))
    return out


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, fp, whole, cells) of docs (id, t): the fingerprint, a hash of the set of shingles, and its cells; an empty set has none."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, whole, cells = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64), []
            for row, text in enumerate(b.column(1).to_pylist()):
                words = _words(text)
                fps[row] = fingerprint(words, SHINGLE)
                hashes = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, _parts(words, shingle)), np.uint64))
                whole[row] = np.int64(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64)) if len(hashes) else 0
                bands = least_hashes(hashes).reshape(BANDS, ROWS) if len(hashes) else []
                cells.append([xxhash.xxh64_intdigest(x.tobytes(), no) - (1 << 63) for no, x in enumerate(bands)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), pa.array(whole), pa.array(cells, pa.list_(pa.int64()))], ["id", "fp", "whole", "cells"])

    return map_text(docs, run, f"id {kind}, fp long, whole long, cells array<long>")


def _whole(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns and starts of whole groups, from rows sorted by the first `keys` columns; a group may span batches."""
    held: list[pa.RecordBatch] = []

    def starts(b) -> np.ndarray:
        new = np.zeros(max(0, b.num_rows - 1), bool)
        for c in range(keys):
            v = b.column(c).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(c).to_numpy()
            new |= v[1:] != v[:-1]
        return np.flatnonzero(np.r_[True, new])

    for b in batches:
        if not b.num_rows:
            continue
        last = int(starts(b)[-1])
        if held and (last or any(held[-1].column(c)[0] != b.column(c)[0] for c in range(keys))):
            t = pa.Table.from_batches([*held, b.slice(0, last)])
            yield t, starts(t)
            held = []
        elif last:
            t = pa.Table.from_batches([b.slice(0, last)])
            yield t, starts(t)
        held.append(b.slice(last))
    if held:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, node, hub) of cells of two or more nodes: cells of the same nodes are one group, its hub is the least."""
    for t, start in _whole(batches, 1):
        node = t.column(1).to_numpy()
        size = np.diff(np.r_[start, len(node)])
        some = size > 1
        if some.any():
            grp = [xxhash.xxh64_intdigest(node[s : s + n].tobytes()) - (1 << 63) for s, n in zip(start[some].tolist(), size[some].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(grp, np.int64), size[some])), pa.array(node[np.repeat(some, size)]), pa.array(np.repeat(node[start[some]], size[some]))], ["grp", "node", "hub"])


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                keep.append(not either or both >= least * either)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_links(links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of ids of sets (id, n, s) whose Jaccard similarity is `least` or more."""
    # A set holds at most 1 / least times as many shingles as one that similar.
    left, right = (sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("s").alias(f"s_{c}")) for c in "ab")
    pairs = links.join(left, "a").join(right, "b").where((F.col("n_a") >= F.col("n_b") * least) & (F.col("n_b") >= F.col("n_a") * least))
    return pairs.select("a", "b", "s_a", "s_b").mapInArrow(_similar(least), "a long, b long")


def tied(label: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Index pairs of similar sets that join the labels; every pair left out is unlike or joined by verified links."""
    # Rare labels first, so that the members of a common one are seldom compared with what follows.
    _, no, held = np.unique(label, return_inverse=True, return_counts=True)
    order = np.lexsort((no, held[no]))
    label, n = no[order], np.array([len(sets[k]) for k in order])
    code = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    start, seen, out = np.r_[0, np.cumsum(n)], np.zeros(len(code), bool), []
    for i in range(len(n) - 1):
        later = slice(i + 1, None)
        maybe = (label[later] != label[i]) & (n[later] >= least * n[i]) & (n[i] >= least * n[later])
        if not maybe.any():
            continue
        own, rest = code[start[i] : start[i + 1]], code[start[i + 1] :]
        seen[own] = True
        both = np.add.reduceat(seen[rest], start[i + 1 : -1] - start[i + 1], dtype=np.int64)
        seen[own] = False
        for j in (np.flatnonzero(maybe & (both >= least * (n[i] + n[later] - both))) + i + 1).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((int(order[i]), int(order[j])))
    return out


def _tied(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links (a, b) of rows (grp, i, j, node, label, s), sorted by the first three."""
        for t, start in _whole(batches, 3):
            node, label = t.column("node").to_numpy(), t.column("label").to_numpy()
            pairs = []
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(node)], strict=True):
                if (label[s:e] != label[s]).any():
                    sets = [np.frombuffer(x, np.uint32) for x in t.column("s").slice(s, e - s).to_pylist()]
                    pairs += [(s + a, s + b) for a, b in tied(label[s:e], sets, least)]
            if pairs:
                a, b = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return run


def open_links(groups: DataFrame, roots: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join what roots keeps apart, from every group that has members of different components.

    All pairs of such a group are compared but those already joined. A group of two has been tried by its hub; groups
    of over BLOCK members are dealt out as pairs of blocks.
    """
    named = cut(groups.join(roots, "node", "left").select("grp", "node", F.coalesce("root", "node").alias("label")))
    apart = named.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi and size > 2")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = named.join(small(cut(apart.select("grp", "size"))), "grp").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = rows.select("grp", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "node", "label").join(sets.select(F.col("id").alias("node"), "s"), "node")
    sorted_ = dealt.select("grp", "i", "j", "node", "label", "s").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return sorted_.mapInArrow(_tied(least), "a long, b long")


def bit_links(marks: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, radius: int) -> DataFrame:
    """Links (a, b) of nodes that connect what simhash_groups joins; ids of several texts enter by the greatest."""
    known = marks.where(F.col("id").isNotNull()).select("id", "fp", "whole")
    spans = known.groupBy("id").agg(*(f(c).alias(f"{c}{k}") for c in ("fp", "whole") for k, f in enumerate((F.min, F.max))))
    torn = cut_few(spans.where("fp0 <> fp1 or whole0 <> whole1").select("id"))
    if not torn.isEmpty():
        torn = small(torn)
        greatest = texts.join(torn, "id", "left_semi").groupBy("id").agg(F.max("t").alias("t"))
        known = known.join(torn, "id", "left_anti").unionByName(sketches(greatest, shingle).select("id", "fp", "whole"))
    fps = cut(known.select("fp", "whole").distinct().join(classes.select("whole", "node"), "whole").select(F.col("node").alias("id"), "fp").distinct())
    # Nodes of one fingerprint hang on the least of them, and these by the links of their fingerprints.
    heads = cut(fps.groupBy("fp").agg(F.min("id").alias("least")))
    ties = fps.join(heads, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    left, right = (heads.select(F.col("fp").alias(f"fp_{c}"), F.col("least").alias(c)) for c in "ab")
    near = small(cut(linked(heads, radius).toDF("fp_a", "fp_b").distinct())).join(left, "fp_a").join(right, "fp_b").select("a", "b")
    return ties.unionByName(near)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int | None = None) -> DataFrame:
    """(id, component_id) of documents that are near copies: of a shingle similarity of `least` or more.

    With `radius`, near copies are first of all the documents that simhash_groups joins: fingerprints within that many
    bits, found by the grid range join. They need no further similarity; what follows adds the pairs whose fingerprints
    lie farther apart, which edits of long passages bring about, and the links of both kinds make one component.

    Candidates are documents that share a cell: all ROWS least hashes of one of BANDS bands. A pair shares a band with
    the fourth power of its similarity, whatever the edit, so a pair at 0.8 is passed over with a chance of
    (1 - 0.8 ** 4) ** 32, or 5 in 10^8, and a closer one with less. The members of a
    cell are verified by their shingle sets: first against the least of them, then, where that leaves a cell in more
    than one component, every pair that is not yet joined. So only redundant links are left out. Documents of equal
    sets of shingles are one point. Texts of fewer words than a shingle are one shingle; those without words are equal.
    Rows with a null id are left alone; rows that repeat an id are one document, of the greatest of their texts where
    they are compared; ids that are no integers are ordered as Spark sorts them.
    """
    texts, names = integer_ids(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")))
    marks = cut(sketches(texts, shingle))
    classes = cut(marks.groupBy("whole").agg(F.min("id").alias("node"), F.first("cells").alias("cells")))
    cells = classes.where(F.col("node").isNotNull()).select(F.explode("cells").alias("cell"), "node")
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "node")
    groups = cut(dealt.mapInArrow(_members, "grp long, node long, hub long").distinct())
    nodes = cut(groups.select("node").distinct())
    chosen = texts.join(small(nodes, NODES), F.col("id") == F.col("node"), "left_semi").groupBy("id").agg(F.max("t").alias("t"))
    sets = cut(shingle_sets(chosen, shingle))
    links = similar_links(groups.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets, least)
    links = cut(links if radius is None else bit_links(marks, classes, texts, shingle, radius).unionByName(links))
    roots = components(links, "a", "b")
    stars = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    roots = components(stars.unionByName(open_links(groups, roots, sets, least)), "a", "b")
    named = classes.join(roots, "node", "left").select("whole", F.coalesce("root", "node").alias("component_id"))
    out = marks.join(named, "whole").select("id", "component_id")
    if names is not None:
        heads = names.select(F.col("id").alias("component_id"), F.col("name").alias("head"))
        out = out.join(names, "id", "left").join(heads, "component_id", "left").select(F.col("name").alias("id"), F.col("head").alias("component_id"))
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("component_id").cast(kind).alias("component_id"))
