"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code.

A file set is a folder of Parquet files whose rows are blocks. A block holds consecutive
documents in ascending doc_id order: their identifiers and lengths, the block's ids by
falling frequency (a rank is a place in this list), the control bytes (two bits for each
token, four tokens a byte: how many bytes its rank takes, less one) and apart from them
the data bytes (the ranks, little endian, only as many bytes as the control says). The
decoder turns control bytes into lengths by one table lookup and gathers whole columns of
data bytes, so no step goes token by token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import picked, shuffle_width

#: Tokens after which a block ends; a longer document makes a longer block.
BLOCK_TOKENS = 1 << 20
#: Pieces that a worker's cache holds, and bytes of text that are joined at a time: this
#: tokenizer keeps case, so it meets more pieces than others.
CACHE_PIECES, GROUP_BYTES = 1_200_000, 8_000_000
#: For each control byte, the lengths of its four tokens.
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
_SHIFTS = np.array([1, 4, 16, 64], np.uint8)


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(table, control, data) of a block's ids."""
    counts = np.bincount(ids)
    seen = np.flatnonzero(counts)
    table = seen[np.argsort(-counts[seen], kind="stable")]
    rank = np.zeros(len(counts), np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    ranks = rank[ids]
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    padded[: len(ids)] = code
    control = (padded.reshape(-1, 4) * _SHIFTS).sum(axis=1, dtype=np.uint8)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= code[:, None]]
    return table.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode_block(table: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids, as little-endian unsigned 32-bit integers."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        at = np.flatnonzero(lengths > k)
        if not len(at):
            break
        ranks[at] |= raw[starts[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(table, "<u4")[ranks]


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("first_hash", pa.int64()), ("table", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])
_BLOCK_DDL = "part int, block int, n_tokens long, doc_ids array<long>, lengths array<long>, first_hash long, table binary, control binary, data binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, block_tokens: int = BLOCK_TOKENS, special_as_text: bool = False) -> None:
    """Encode every whole text, append end_id, and write the token files to path.

    Null texts are empty. Documents are in ascending doc_id order (null first; rows that
    share a doc_id by a hash of their text), so a doc_id on many rows is still spread over
    files. The strings of special tokens in a text give their ids, as the library does by
    default, or with special_as_text are ordinary text. Columns of docs beyond the two that
    are named have no influence. Runs a job; texts are shuffled once and encoded once.
    """
    base = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = parts or shuffle_width(docs.sparkSession)
    ordered = base.repartitionByRange(parts, "doc_id", "row_hash").sortWithinPartitions("doc_id", "row_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        part, block = TaskContext.get().partitionId(), 0
        keys: list = []
        arrays: list[np.ndarray] = []
        n, first = 0, None

        def flush() -> pa.RecordBatch:
            table, control, data = encode_block(np.concatenate(arrays))
            row = {"part": part, "block": block, "n_tokens": n, "doc_ids": keys, "lengths": [len(a) for a in arrays], "first_hash": first, "table": table, "control": control, "data": data}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            for i, ids in tokens.encoded(tokenizer_path, batch.column(2), GROUP_BYTES, special_as_text, CACHE_PIECES):
                if not keys:
                    first = batch.column(1)[i].as_py()
                keys.append(batch.column(0)[i].as_py())
                arrays.append(np.append(ids, ids.dtype.type(end_id)))
                n += len(ids) + 1
                if n >= block_tokens:
                    yield flush()
                    keys, arrays, n, block = [], [], 0, block + 1
        if keys:
            yield flush()

    ordered.mapInArrow(run, _BLOCK_DDL).write.mode("errorifexists").option("compression", "uncompressed").parquet(path)


def _starts(blocks: DataFrame) -> DataFrame:
    """part, block, start: ids in all blocks before. Works on one row for each block, and
    in one task only on one row for each file."""
    heads = blocks.select("part", "block", "n_tokens", F.col("doc_ids")[0].alias("first_id"), "first_hash")
    order = Window.partitionBy("part").orderBy("block")
    inside = heads.withColumn("before", F.sum("n_tokens").over(order) - F.col("n_tokens"))
    files = heads.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.min_by(F.struct("first_id", "first_hash"), "block").alias("first"))
    files = files.withColumn("base", F.sum("n").over(Window.orderBy(F.col("first.first_id").asc_nulls_first(), "first.first_hash", "part")) - F.col("n"))
    return inside.join(files.select("part", "base"), "part").select("part", "block", (F.col("base") + F.col("before")).alias("start"))


_DIGEST = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("inner", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Read token files back: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked for,
    the ids. An empty file set gives an empty frame."""
    blocks = spark.read.schema(_BLOCK_DDL).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, block, n, table, control, data = (batch.column(c)[row].as_py() for c in ("part", "block", "n_tokens", "table", "control", "data"))
                ids = decode_block(table, control, data, n)
                lengths = np.array(batch.column("lengths")[row].as_py(), np.int64)
                ends = np.cumsum(lengths)
                views = [ids[e - k : e] for e, k in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(lengths), pa.int32()),
                        pa.array([block] * len(lengths), pa.int32()),
                        batch.column("doc_ids")[row].values.cast(pa.int64()),
                        pa.array(ends - lengths),
                        pa.array(lengths),
                        pa.array([zlib.crc32(v.astype("<u4", copy=False).tobytes()) for v in views], pa.int64()),
                        pa.array([v.tolist() for v in views] if with_ids else [None] * len(lengths), pa.list_(pa.int64())),
                    ],
                    schema=_DIGEST,
                )

    rows = blocks.mapInArrow(run, "part int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long, ids array<long>")
    out = rows.join(_starts(blocks), ["part", "block"]).select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")
