"""Quality by ridge regression on random Fourier features of document statistics.

Statistics of whole texts (shares of character classes, word and line lengths, repetition)
are standardised and mapped to random Fourier features, which approximate a Gaussian
kernel. Each partition sums its part of the normal equations, the sums are added up in a
tree, and the driver solves one small system. Isotonic regression on the ridge scores
then gives calibrated scores between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers
from .common import cut, picked

COMPONENTS = 320
#: The Gaussian kernel's width, in standard deviations of one statistic.
WIDTH = 4.0
RIDGE = 0.3
#: Ridge scores are pooled in so many steps between LOW and HIGH before calibration.
STEPS, LOW, HIGH = 400, -0.5, 1.5
#: Partial sums that one task of the tree adds up.
FAN_IN = 16

# The classes of bytes whose shares are statistics.
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "feed": b"\n",
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "bar": b"|",
    "hash": b"#",
    "star": b"*",
    "money": b"$%&",
    "markup": b"<>/\\={}[]()_~^+-@",
    "quote": b"\"'`",
    "high": bytes(range(0x80, 0x100)),
}
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _i
_N_CLASSES = len(_CLASSES) + 1
STATISTICS = [
    "log_bytes", "log_words", "log_lines", *_CLASSES, "other", "word_length", "word_spread", "one_byte_words", "long_words", "line_words", "distinct_words", "same_next", "distinct_pairs", "distinct_lines", "top_word", "end_symbol", "upper_words", "capital_words", "bar_words",
]


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct keys, count of the most frequent key) for each document."""
    if n == 1:
        d, k = np.zeros(len(key), np.int8), np.sort(key)
    else:
        order = np.lexsort((key, doc))
        d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(d)))
    top = np.zeros(n)
    np.maximum.at(top, d[at], runs)
    return np.bincount(d[at], minlength=n), top


_SUMS = ["size", *_CLASSES, "other", "words", "length", "square", "feeds", "one_byte", "long", "symbol", "all_upper", "upper_first", "bar"]


def _measured(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What adds up over parts of a text: _SUMS for each text; the hash and text of each word;
    the key and text of each line with words (the sum of its words' hashes)."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    classes = np.bincount(owner * np.int64(_N_CLASSES) + _CLASS[raw], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
    starts, ends, doc = buffers.word_bounds(raw, offsets)
    length = (ends - starts).astype(float)
    count = lambda mask: np.bincount(doc, mask, minlength=n)
    hashes = buffers.word_hashes(buffers.LOWER[raw], starts, ends)
    last, first = raw[ends - 1] if len(ends) else raw[:0], raw[starts] if len(starts) else raw[:0]
    feed = raw == 0x0A
    line_of = np.cumsum(feed)[starts] if len(starts) else starts
    key = doc.astype(np.int64) * (int(line_of[-1]) + 2 if len(line_of) else 1) + line_of
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    sums = np.add.reduceat(hashes * np.uint64(0x9E3779B97F4A7C15), at) if len(at) else np.zeros(0, np.uint64)
    capital = (raw >= 0x41) & (raw <= 0x5A)
    capitals = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(capital, out=capitals[1:])
    capitals = capitals[ends] - capitals[starts]
    columns = [
        size, *classes.T, np.bincount(doc, minlength=n), count(length), count(length**2), np.bincount(owner[feed], minlength=n), count(length == 1), count(length > 15),
        count(np.isin(_CLASS[last], [7, 8, 9, 10, 11, 12])), count((capitals >= 2) & (capitals >= 0.6 * length)), count((first >= 0x41) & (first <= 0x5A)), count((length == 1) & (first == 0x7C)),
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1), hashes, doc, sums, doc[at]


def statistics(texts: pa.Array, part: int = buffers.PART) -> np.ndarray:
    """One row of STATISTICS for each text; all zero for empty and null texts. A long text is
    read in parts."""
    n = len(texts)
    raw, offsets = buffers.raw_of(texts)
    if n == 1 and len(raw) > part:
        total, hashes, sums = np.zeros((1, len(_SUMS))), [], []
        for a, b in buffers.parts(raw, part):  # parts are cut within a line, between words
            one, h, _, s, _ = _measured(raw[a:b], np.array([0, b - a]))
            total += one
            hashes.append(h)
            if len(s) and sums:
                sums[-1][-1:] += s[:1]
                s = s[1:]
            if len(s):
                sums.append(s)
        hashes, sums = np.concatenate(hashes), np.concatenate(sums) if sums else np.zeros(0, np.uint64)
        doc, line_doc = np.zeros(len(hashes), np.int8), np.zeros(len(sums), np.int8)
    else:
        total, hashes, doc, sums, line_doc = _measured(raw, offsets)
    of = dict(zip(_SUMS, total.T))
    words, per_word, lines = of["words"], np.maximum(of["words"], 1), of["feeds"] + (of["size"] > 0)
    mean = of["length"] / per_word
    spread = np.sqrt(np.maximum(of["square"] / per_word - mean**2, 0))
    in_doc = doc[1:] == doc[:-1]
    next_same = np.bincount(doc[1:][in_doc], hashes[1:][in_doc] == hashes[:-1][in_doc], minlength=n)
    pairs, _ = _distinct(doc[1:][in_doc], buffers.mix(hashes[1:] * np.uint64(3) + hashes[:-1])[in_doc], n)
    distinct, top = _distinct(doc, hashes, n)
    distinct_lines, _ = _distinct(line_doc, sums, n)
    full_lines = np.bincount(line_doc, minlength=n)
    share = lambda name: of[name] / per_word
    columns = [
        np.log1p(of["size"]), np.log1p(words), np.log1p(lines), *(of[c] / np.maximum(of["size"], 1) for c in (*_CLASSES, "other")), mean, spread, share("one_byte"), share("long"), words / np.maximum(lines, 1) / 20,
        distinct / per_word, next_same / per_word, pairs / np.maximum(words - 1, 1), distinct_lines / np.maximum(full_lines, 1), top / per_word, share("symbol"), share("all_upper"), share("upper_first"), share("bar"),
    ]
    out = np.stack([np.asarray(c, float) for c in columns], axis=1)
    out[of["size"] == 0] = 0.0
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x (array of STATISTICS); one row for every input row, over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers.release()
        for batch in batches:
            for a, b in buffers.slices(batch.column(1)):
                x = statistics(batch.column(1).slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "x"])

    return picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Fourier:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))])


def _rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.array(batch.column(column).flatten()).reshape(batch.num_rows, -1)


def _summed(parts: DataFrame, fan_in: int = FAN_IN) -> np.ndarray:
    """The sum of one-column binary rows of doubles, added up in a tree of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column(0):
                v = np.frombuffer(row.as_py())
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan_in)
        parts = parts.repartition(n).mapInArrow(add, "v binary")
    return np.frombuffer(parts.first()[0])


def fit_ridge(training: DataFrame, seed: int = 7, components: int = COMPONENTS, width: float = WIDTH, ridge: float = RIDGE) -> tuple[Fourier, np.ndarray]:
    """training: x, y. Runs jobs; nothing that grows with the rows reaches the driver."""
    d = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * d + 1)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch, 0)
                total += np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    m = _summed(training.select("x").mapInArrow(moments, "v binary"))
    mean = m[1 : d + 1] / m[0]
    scale = np.sqrt(np.maximum(m[d + 1 :] / m[0] - mean**2, 0))
    rng = np.random.default_rng(seed)
    fourier = Fourier(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(d, components)) / width, rng.uniform(0, 2 * np.pi, components))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = components + 1
        a, b = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                f = fourier(_rows(batch, 0))
                a += f.T @ f
                b += f.T @ np.array(batch.column(1), float)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.reshape(-1), b]).tobytes()], pa.binary())], names=["v"])

    total = _summed(training.select("x", "y").mapInArrow(normal, "v binary"))
    k = components + 1
    penalty = ridge * np.eye(k)
    penalty[-1, -1] = 1e-6
    return fourier, np.linalg.solve(total[: k * k].reshape(k, k) + penalty, total[k * k :])


def isotonic(scores: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (the pooled scores, rising values) for ascending scores."""
    blocks: list[list[float]] = []  # sum of scores times count, ones, count
    for s, o, c in zip(scores, ones, counts):
        blocks.append([s * c, o, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    # Half a case of either kind keeps the values off 0 and 1.
    return np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])


def score(docs: DataFrame, labels: DataFrame, learn_from=lambda doc_id: F.lit(True)) -> DataFrame:
    """doc_id, score (0 to 1) for every row of docs (doc_id, text).

    Trains on all rows of labels (doc_id, quality) for which learn_from holds and whose
    document is there; a document with several labels takes the larger, null labels are
    left out. Empty and null texts are scored by all-zero statistics. Without labels of
    both kinds every score is the share of good labels, or 0.5 without any. Runs jobs;
    texts are read once.
    """
    table = cut(document_statistics(docs))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y")).where(learn_from(F.col("doc_id")))
    training = cut(table.join(known, "doc_id").select("x", "y"))
    n, good = training.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n or good in (0, n):
        return table.select("doc_id", F.lit(good / n if n else 0.5).alias("score"))
    fourier, weights = fit_ridge(training)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(fourier(_rows(batch, 0)) @ weights if batch.num_rows else np.empty(0))], names=["y", "s"])

    step = F.least(F.lit(STEPS), F.greatest(F.lit(0), F.round((F.col("s") - LOW) / (HIGH - LOW) * STEPS))).cast("int")
    pooled = training.select("x", "y").mapInArrow(raw, "y double, s double").groupBy(step.alias("step")).agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n")).orderBy("step").collect()
    x, y = isotonic(np.array([r["step"] for r in pooled], float), np.array([r["ones"] for r in pooled]), np.array([r["n"] for r in pooled], float))
    at = LOW + x * (HIGH - LOW) / STEPS
    y = np.maximum.accumulate(y)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = fourier(_rows(batch, 1)) @ weights if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.interp(s, at, y))], names=["doc_id", "score"])

    return table.select("doc_id", "x").mapInArrow(final, "doc_id long, score double")
