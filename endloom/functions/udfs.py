"""The kernels as Arrow UDFs, and their names in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from . import kernels as K


@F.pandas_udf(DoubleType())
def hp_edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else K.homopolymer_edit_distance(x, y) for x, y in zip(a, b)], dtype="float64")


def hp_edit_distance_by(penalties: dict[str, dict[int, float]]):
    """hp_edit_distance whose gaps cost what a table says (``operators.netseq.penalty_table``)."""

    @F.pandas_udf(DoubleType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else K.homopolymer_edit_distance(x, y, penalties) for x, y in zip(a, b)], dtype="float64")

    return distance


@F.pandas_udf(StructType([StructField("score", IntegerType()), StructField("cigar", StringType())]))
def affine_cigar(query: pd.Series, target: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if x is None or y is None else K.affine_align(x, y) for x, y in zip(query, target)]
    return pd.DataFrame(rows, columns=["score", "cigar"])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch of strings and where each begins (with the end); nulls are empty."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


@F.arrow_udf(DoubleType())
def max_richness(seq: pa.Array) -> pa.Array:
    """The greatest share of As in ten bases, as ``sequence.max_richness`` gives it: one
    running sum over a whole batch."""
    raw, offsets = _bytes(seq)
    sums = np.concatenate([[0], np.cumsum(raw == 0x41)])
    n = np.diff(offsets)
    share = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1)
    long = np.flatnonzero(n > 10)
    if len(long):
        window = np.append(sums[10:] - sums[:-10], 0)
        edges = np.stack([offsets[long], offsets[long + 1] - 9], axis=1).reshape(-1)
        share[long] = np.maximum.reduceat(window, edges)[::2] / 10
    return pa.array(share, mask=np.asarray(seq.is_null()))


@F.arrow_udf(ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))
def cigar_junctions(start: pa.Array, cigar: pa.Array) -> pa.Array:
    """The skipped stretches of alignments, as ``sequence.junctions`` gives them: the CIGARs of a
    batch are read as one array of bytes."""
    raw, offsets = _bytes(cigar)
    at = np.flatnonzero(raw > 0x39)  # operations stand behind digits
    first = np.searchsorted(at, offsets)
    begin = np.append(0, at[:-1] + 1) if len(at) else at
    begin[first[:-1][np.diff(first) > 0]] = offsets[:-1][np.diff(first) > 0]
    # Digit k before its operation counts 10 ** (k - 1): whole columns of digits at a time.
    size = np.zeros(len(at), np.int64)
    for k in range(1, int((at - begin).max(initial=0)) + 1):
        has = np.flatnonzero(at - begin >= k)
        size[has] += (raw[at[has] - k].astype(np.int64) - 0x30) * 10 ** (k - 1)
    op = raw[at]
    moves = np.where(np.isin(op, np.frombuffer(b"MDN=X", np.uint8)), size, 0)
    ends = np.cumsum(moves)
    row = np.repeat(np.arange(len(cigar)), np.diff(first))
    base = np.concatenate([[0], ends])[first[:-1]]
    origin = np.asarray(start.fill_null(0).cast(pa.int64()))
    stop = origin[row] + ends - base[row]
    skip = np.flatnonzero(op == 0x4E)
    pairs = pa.StructArray.from_arrays([pa.array(stop[skip] - size[skip]), pa.array(stop[skip])], names=["start", "end"])
    bounds = np.searchsorted(row[skip], np.arange(len(cigar) + 1)).astype(np.int32)
    none = np.asarray(start.is_null()) | np.asarray(cigar.is_null())
    return pa.ListArray.from_arrays(pa.array(bounds, mask=np.append(none, False)), pairs)


@F.pandas_udf(ArrayType(StructType([StructField("offset", IntegerType()), StructField("share", DoubleType())])))
def nnls_deconvolve(signal: pd.Series, psf: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or p is None else [{"offset": o, "share": f} for o, f in K.deconvolve(np.asarray(s, float), np.asarray(p, float))] for s, p in zip(signal, psf)])


_PEAK = StructType([StructField("offset", IntegerType()), StructField("height", DoubleType()), StructField("fraction", DoubleType()), StructField("confidence", DoubleType())])
_FIT = StructType([StructField("solution", ArrayType(DoubleType())), StructField("r_squared", DoubleType()), StructField("rmse", DoubleType()), StructField("recovery", DoubleType()), StructField("peaks", ArrayType(_PEAK))])


@F.pandas_udf(_FIT)
def deconvolved_region(signal: pd.Series, psf: pd.Series, ridge: pd.Series, least: pd.Series) -> pd.DataFrame:
    rows = []
    for s, p, r, t in zip(signal, psf, ridge, least):
        if s is None or p is None:
            rows.append((None, None, None, None, None))
            continue
        x, r_squared, rmse, recovery, peaks = K.fitted(np.asarray(s, float), np.asarray(p, float), r, t)
        rows.append((x.tolist(), r_squared, rmse, recovery, [dict(zip(_PEAK.names, k)) for k in peaks]))
    return pd.DataFrame(rows, columns=_FIT.names)


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("strand", StringType())])))
def motif_scan(seq: pd.Series, motif: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or m is None else [{"start": a, "end": b, "strand": c} for a, b, c in K.motif_hits(s, m)] for s, m in zip(seq, motif)])


@F.pandas_udf(StructType([StructField("tail", IntegerType()), StructField("adapter", IntegerType()), StructField("pass", IntegerType())]))
def tail_adapter(seq: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([K.tail_adapter(s or "") for s in seq], columns=["tail", "adapter", "pass"])


@F.pandas_udf(LongType())
def walk_back(cigar: pd.Series, read: pd.Series, genome: pd.Series, start: pd.Series, strand: pd.Series) -> pd.Series:
    """genome: the reference from start on, at least to the end of the alignment."""
    out = []
    for c, r, g, at, d in zip(cigar, read, genome, start, strand):
        ok = not any(x is None or x is pd.NA for x in (c, r, g, d)) and at == at
        out.append(K.walk_back([(o, int(n)) for n, o in K.CIGAR.findall(c)], r, g, int(at), d) if ok else None)
    return pd.Series(out, dtype="Int64")


_MISMATCH = StructType([StructField("position", LongType()), StructField("base", StringType()), StructField("in_homopolymer", BooleanType())])


@F.pandas_udf(ArrayType(_MISMATCH))
def mismatches(cigar: pd.Series, read: pd.Series, genome: pd.Series, start: pd.Series) -> pd.Series:
    """genome: the reference from start on."""
    out = []
    for c, r, g, at in zip(cigar, read, genome, start):
        ok = not any(x is None or x is pd.NA for x in (c, r, g)) and at == at
        out.append([dict(zip(_MISMATCH.names, m)) for m in K.mismatches([(k, int(n)) for n, k in K.CIGAR.findall(c)], r, g, int(at))] if ok else None)
    return pd.Series(out)


@F.pandas_udf(LongType())
def mismatch_in_run(cigar: pd.Series, read: pd.Series, genome: pd.Series, start: pd.Series, strand: pd.Series, outside: pd.Series) -> pd.Series:
    """genome: the reference from start on; outside: from the mapped 3' end on, along the strand."""
    out = []
    for c, r, g, at, d, o in zip(cigar, read, genome, start, strand, outside):
        ok = not any(x is None or x is pd.NA for x in (c, r, g, d, o)) and at == at
        out.append(K.mismatch_in_run([(k, int(n)) for n, k in K.CIGAR.findall(c)], r, g, int(at), d, o) if ok else None)
    return pd.Series(out, dtype="Int64")


@F.pandas_udf(IntegerType())
def polya_boundary(seq: pd.Series, strand: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or d is None else K.polya_boundary(s, d) for s, d in zip(seq, strand)], dtype="Int32")


@F.pandas_udf(StructType([StructField("start", LongType()), StructField("cigar", StringType())]))
def reclip(cigar: pd.Series, start: pd.Series, strand: pd.Series, end: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if c is None or d is None or at != at or e != e else K.reclip([(o, int(n)) for n, o in K.CIGAR.findall(c)], int(at), d, int(e)) for c, at, d, e in zip(cigar, start, strand, end)]
    return pd.DataFrame(rows, columns=["start", "cigar"]).astype({"start": "Int64"})


def register(spark: SparkSession) -> None:
    """Make the UDFs callable from SQL by their names."""
    for f in (hp_edit_distance, affine_cigar, nnls_deconvolve, motif_scan, tail_adapter, walk_back, polya_boundary, reclip, deconvolved_region, max_richness, cigar_junctions, mismatch_in_run, mismatches):
        spark.udf.register(f.func.__name__, f)
