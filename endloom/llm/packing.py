"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

An individual is a partition of pieces into bins. Crossover injects whole well-filled
bins of one parent into another, drops every bin of the other that now holds a duplicate
(and a few of the worst filled), and puts the displaced pieces back by best fit, longest
first. Fitness: fewer bins, then fuller ones (sum of squared fill).

Pieces are dealt into shards of a bounded size; each shard is evolved by several islands,
each a group of its own, that send their elite to the next island of a ring between
epochs. The bins that the best island of a shard leaves poorly filled are dissolved and
their pieces are packed once more with those of other shards. A shard that meets the
lower bound (tokens over capacity, rounded up) is done at once.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import cut, picked

CAPACITY = 4096
SHARD_PIECES = 4000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 8
POPULATION = 5
ELITE = 2
_UID = "__uid"

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Tokenise every whole text, append end_id, and cut only what is longer than capacity:
    doc_id, piece, start, length, ids_crc32. Null texts are empty: one piece of one id.
    The strings of special tokens in a text give their ids, as the library does by default,
    or with special_as_text are ordinary text. Columns of docs beyond the two that are
    named have no influence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        for batch in batches:
            rows = []
            for i, ids in tokens.encoded(tokenizer_path, batch.column(1), special_as_text=special_as_text):
                ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                key = batch.column(0)[i].as_py()
                rows += [(key, k, s, len(p), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(ids), capacity)) for p in (ids[s : s + capacity],)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _PIECE)], schema=_PIECE)

    base = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, free: list[int], capacity: int) -> None:
    """Put the pieces of order into the bin with the least room that holds them, or a new
    one. bins: the bin of each piece; free: the room of each bin. Both change."""
    room = sorted((f, b) for b, f in enumerate(free) if f > 0)
    for i in order.tolist():
        need = int(lengths[i])
        at = bisect_left(room, (need, -1))
        if at < len(room):
            f, b = room.pop(at)
        else:
            f, b = capacity, len(free)
            free.append(capacity)
        bins[i] = b
        free[b] = f - need
        if f > need:
            insort(room, (f - need, b))


def fitness(bins: np.ndarray, lengths: np.ndarray) -> tuple[int, float]:
    fill = np.bincount(bins, lengths)
    fill = fill[fill > 0]
    return len(fill), -float((fill**2).sum())


def crossover(giver: np.ndarray, taker: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(giver, lengths)
    best = np.flatnonzero(fill >= np.quantile(fill[fill > 0], 0.5))
    given = rng.choice(best, max(1, len(best) // 3), replace=False)
    injected = np.isin(giver, given)
    held = np.bincount(taker, lengths)
    used = np.flatnonzero(held > 0)
    drop = np.union1d(taker[injected], used[np.argsort(held[used])[: 2 + len(used) // 50]])
    displaced = np.isin(taker, drop) & ~injected
    child = np.full(len(taker), -1, np.int64)
    kept = ~injected & ~displaced
    _, child[kept] = np.unique(taker[kept], return_inverse=True)
    first = int(child.max(initial=-1)) + 1
    _, new = np.unique(giver[injected], return_inverse=True)
    child[injected] = first + new
    placed = child >= 0
    free = (capacity - np.bincount(child[placed], lengths[placed])).astype(np.int64).tolist() if placed.any() else []
    order = np.flatnonzero(displaced)
    best_fit(lengths, order[np.argsort(-lengths[order], kind="stable")], child, free, capacity)
    return child


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], capacity: int, generations: int, population: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after so many generations, best first; seeds are part of the first."""
    least = -(-int(lengths.sum()) // capacity)
    pool = list(seeds)
    while len(pool) < population:
        bins = np.full(len(lengths), -1, np.int64)
        noise = lengths * (1 + (0.1 * rng.random(len(lengths)) if pool else 0))
        best_fit(lengths, np.argsort(-noise, kind="stable"), bins, [], capacity)
        pool.append(bins)
        if fitness(bins, lengths)[0] <= least:
            break
    pool.sort(key=lambda b: fitness(b, lengths))
    for _ in range(generations):
        if fitness(pool[0], lengths)[0] <= least or len(pool) < 2:
            break
        children = []
        for _ in range(population):
            a, b = rng.choice(len(pool), 2, replace=False)
            children.append(crossover(pool[a], pool[b], lengths, capacity, rng))
        pool = sorted(pool + children, key=lambda b: fitness(b, lengths))[:population]
    return pool


def migrated(state: DataFrame, islands: int) -> DataFrame:
    """Each island keeps its own rows and gets those of the one before it in the ring, whose
    elites are told from its own by source."""
    ring = F.array_distinct(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")))
    return state.select("shard", F.explode(ring).alias("island"), "uid", "length", "source", "elites")


def _pack_shards(items: DataFrame, level: int, capacity: int, shard_pieces: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """items: uid, length, n (their number). Result: uid, length, sequence_id, offset,
    fill (of the sequence)."""
    shards = F.greatest(F.lit(1), F.ceil(F.col("n") / shard_pieces))
    state = items.select(F.pmod(F.xxhash64("uid", F.lit(level)), shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "uid", "length", F.lit(0).alias("source"), F.expr("CAST(array() AS array<int>)").alias("elites"))

    def epoch():
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            shard, island = (int(k) for k in key)
            own = pdf[pdf["source"] == pdf["source"].min()].sort_values("uid")
            lengths = own["length"].to_numpy(np.int64)
            seeds = []
            for _, part in pdf.sort_values("uid").groupby("source"):
                stack = np.array(part["elites"].tolist(), np.int64).reshape(len(part), -1)
                seeds += [np.ascontiguousarray(c) for c in stack.T]
            pool = evolve(lengths, seeds, capacity, generations, population, np.random.default_rng([level, shard, island, len(seeds)]))
            elites = np.stack(pool[:ELITE], axis=1)
            score = fitness(pool[0], lengths)
            return pd.DataFrame({"shard": shard, "island": island, "uid": own["uid"].to_numpy(), "length": lengths, "source": island, "elites": list(elites.astype(np.int32)), "bins": score[0], "square": score[1]})

        return run

    schema = "shard long, island int, uid long, length long, source int, elites array<int>, bins long, square double"
    for e in range(epochs):
        if e:
            state = migrated(state, islands)
        state = state.groupBy("shard", "island").applyInPandas(epoch(), schema)
    best = Window.partitionBy("shard", "uid").orderBy("bins", "square", "island")
    won = state.withColumn("place", F.row_number().over(best)).where("place = 1")
    sequence = F.lit(level << 56) + F.shiftleft(F.col("shard"), 24) + F.col("elites")[0]
    rows = won.select("uid", "length", sequence.alias("sequence_id"))
    w = Window.partitionBy("sequence_id")
    return rows.withColumns({"offset": F.sum("length").over(w.orderBy("uid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"), "fill": F.sum("length").over(w)})


def pack(piece_rows: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, poor: float = 0.97, levels: int = 3) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to capacity.

    Every row is packed, repeated ones and those with a null doc_id too. Sequences have no
    gaps. An empty frame stays empty. Runs jobs that checkpoint the rows and, at each level,
    the packed shards. Sequences filled below ``poor`` go to the next level, where there are
    fewer shards, until one shard is left or ``levels`` is reached.
    """
    extra = [F.col(f"`{c}`") for c in piece_rows.columns if c not in ("sequence_id", "offset")]
    rows = cut(piece_rows.select(*extra, F.monotonically_increasing_id().alias(_UID)))
    own = rows.select(F.col(_UID).alias("uid"), "length")
    whole = own.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = own.where(F.col("length") < capacity)
    parts = [whole]
    n = left.count()
    for level in range(levels):
        if not n:
            break
        last = level == levels - 1 or n <= shard_pieces
        packed = cut(_pack_shards(left.withColumn("n", F.lit(n)), level, capacity, shard_pieces, islands, epochs, generations, population))
        keep = packed if last else packed.where(F.col("fill") >= poor * capacity)
        parts.append(keep.select("uid", "sequence_id", "offset"))
        if last:
            break
        left = packed.where(F.col("fill") < poor * capacity).select("uid", "length")
        n = left.count()
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    return rows.join(placed.withColumnRenamed("uid", _UID), _UID).drop(_UID)
