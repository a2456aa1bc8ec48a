"""A supervised quality classifier over subword embeddings, trained by stochastic gradient descent in numpy.

Every word has a learned vector for itself and for each of its character n-grams, all in one hashed table; word pairs
add one entry for any word that repeats its predecessor. A document is the mean of them, and a softmax gives its class. Training takes a bounded sample of labelled rows; scoring reads
every whole text once, without a shuffle. As the output is linear in the mean, a table entry needs but its weight
towards class 1 when scoring, so the model that travels to the executors is one array.

Defined results: null and empty texts score by the bias alone; rows that repeat an id are scored by their own texts; labels
that repeat an id count by their greatest value, and a labelled id with several texts is learned by the greatest of them;
of labelled rows that tie in the hash of the id the lesser id comes first; with no labels at all every score is 0.5; texts of
any length are scored whole; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deedflow.llm.common import TEXT_ROWS, map_text

#: At most this many labelled rows train the model; which, follows a hash of the id.
SAMPLE = 2400
#: And no more of them, in that order, than hold so many characters together (but one).
SAMPLE_CHARS = 64_000_000
#: The last entry is that of a repeated word.
TABLE = (1 << 16) + 1
REPEAT = TABLE - 1
DIM = 10
GRAMS = (2, 3, 4)
THRESHOLD = 0.7
REMEMBERED = 200_000


def held_out(id_col: str) -> Column:
    """The rows whose labels are never learned."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(entries, owner): table entries of each word and its character n-grams, for all words at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    entries, owners = [], []
    with np.errstate(over="ignore"):
        spread = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        spread ^= spread >> np.uint64(31)

        def bucket(h: np.ndarray) -> np.ndarray:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return ((h ^ (h >> np.uint64(32))) % np.uint64(REPEAT)).astype(np.int64)

        for n in GRAMS:
            if len(code) >= n:
                h = np.zeros(len(code) - n + 1, np.uint64)
                for k in range(n):
                    h = h * np.uint64(1099511628211) + spread[k : len(code) - n + 1 + k]
                inside = owner[: len(h)] == owner[n - 1 :]
                entries.append(bucket(h + np.uint64(n))[inside])
                owners.append(owner[: len(h)][inside])
        start = np.cumsum(lengths) - lengths
        place = np.arange(len(code)) - np.repeat(start, lengths)
        whole = np.add.reduceat(spread * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), start)
        entries.append(bucket(whole + np.uint64(77)))
        owners.append(np.arange(len(words)))
    return np.concatenate(entries), np.concatenate(owners)


def repeats(words: list[str]) -> int:
    """Words that are equal to the one before."""
    return sum(map(eq, words, islice(words, 1, None)))


@dataclass
class Model:
    """Weight of each table entry towards class 1, and the bias."""

    weight: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        """(summed weight, number of entries) of each word."""
        entry, owner = features(words)
        return np.stack([np.bincount(owner, self.weight[entry], len(words)), np.bincount(owner, minlength=len(words))], axis=1)

    def scores(self, texts: list[str], known: dict[str, int], values: list[np.ndarray]) -> np.ndarray:
        """Class-1 probability of whole texts. known and values remember words between calls, boundedly."""
        split = [t.split() for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
            values.clear()
        if new := list(set().union(*split).difference(known)):
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            values.append(self.words(new))
            values[:] = [np.concatenate(values)]
        out = np.full(len(texts), self.bias)
        for k, words in enumerate(split):
            if words:
                own = values[0][np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
                again = repeats(words)
                out[k] += (own[0] + again * self.weight[REPEAT]) / (own[1] + again)
        return 1 / (1 + np.exp(-out))


def train(texts: list[str], labels: np.ndarray, steps: int = 450, batch: int = 32, rate: float = 1.0, seed: int = 3) -> Model:
    if not len(texts):
        return Model(np.zeros(TABLE), 0.0)
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = []
    again = np.zeros(len(texts))
    for k, t in enumerate(texts):
        words = t.split()
        own, again[k] = Counter(words), repeats(words)
        docs.append((np.array([vocabulary.setdefault(w, len(vocabulary)) for w in own], np.int64), np.array(list(own.values()), np.float64)))
    entry, owner = features(list(vocabulary)) if vocabulary else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(owner, kind="stable")
    entry, count = entry[order], np.bincount(owner, minlength=len(vocabulary))
    first = np.cumsum(count) - count
    table = rng.uniform(-1, 1, (TABLE, DIM)) / DIM
    out, bias = np.zeros((DIM, 2)), np.zeros(2)
    step = 0
    while step < steps:
        shuffled = rng.permutation(len(docs))
        for at in range(0, len(docs), batch):
            pick = shuffled[at : at + batch]
            word = np.concatenate([docs[d][0] for d in pick])
            times = np.concatenate([docs[d][1] for d in pick])
            doc = np.repeat(np.arange(len(pick)), [len(docs[d][0]) for d in pick])
            n = count[word]
            # Entries of the batch, with each one's share of its document's mean.
            e = entry[np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            total = np.maximum(np.bincount(doc, times * n, len(pick)) + again[pick], 1)
            e = np.r_[e, np.full(len(pick), REPEAT)]
            share, of = np.r_[np.repeat(times / total[doc], n), again[pick] / total], np.r_[np.repeat(doc, n), np.arange(len(pick))]
            mean = np.stack([np.bincount(of, table[e, k] * share, len(pick)) for k in range(DIM)], axis=1)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            now = rate * (1 - step / steps)
            back = p @ out.T
            out -= now * mean.T @ p / len(pick) * 4
            bias -= now * p.mean(0) * 0.2
            for k in range(DIM):
                table[:, k] -= now * np.bincount(e, back[of, k] * share, TABLE)
            step += 1
    return Model(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """A model from at most `sample` labelled rows outside the held-out fold, of at most `chars` characters together. Only
    their texts come to the driver."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sized = docs.select(F.col(id_col).alias("id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n"))
    sized = sized.join(known.select("id"), "id", "left_semi").groupBy("id").agg(F.max("n").alias("n"))
    chosen = known.join(sized, "id").orderBy(F.xxhash64("id"), "id").limit(sample)
    ahead = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy(F.xxhash64("id"), "id").rowsBetween(W.unboundedPreceding, 0))
    chosen = chosen.withColumn("ahead", ahead).where((F.col("ahead") <= chars) | (F.col("ahead") == F.col("n"))).select("id", "label")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("label").alias("label"), F.max("t").alias("t")).toPandas().sort_values("id")
    return train(rows["t"].tolist(), rows["label"].to_numpy(dtype=np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted."""
    shown = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = shown.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = {}, []
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist(), known, values))], ["id", "score"])

    out = map_text(shown, run, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold. One narrow pass."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = {}, []
        for b in batches:
            for k in range(0, b.num_rows, TEXT_ROWS):
                part = b.slice(k, TEXT_ROWS)
                good = model.scores([t or "" for t in part.column(at).to_pylist()], known, values) >= threshold
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
