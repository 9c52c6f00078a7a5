"""Alignments stitched from several aligners' versions of one read.

Where all aligners place the same bases on the same reference positions the read is in step;
between such runs each aligner's version is scored by itself, and the best versions are
joined at the runs, whose ends all share. A read has one row for each aligner, so its group
is small; reads are grouped in sorted batches.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import CIGAR
from .grouped import map_groups

#: What a version of a segment gains or loses: for each aligned base, mismatch (X), inserted or
#: deleted base, opened gap, clipped base, junction, known junction, junction over MAX_INTRON.
WEIGHTS = {"base": 0.5, "mismatch": -1.0, "gap_base": -1.0, "gap": -3.0, "clip": -0.5, "junction": 2.0, "known": 5.0, "long": -15.0}
MAX_INTRON = 10_000
#: Least share of a read's bases on which all aligners must agree.
LEAST_SYNC = 0.05
#: Reference gaps up to this between joined segments become deletions, longer ones skips.
MOST_DELETION = 10

Op = tuple[str, int, int, int]  # kind, length, query position, reference position


def placed(ops: list[tuple[str, int]], start: int) -> list[Op]:
    out, q, r = [], 0, start
    for kind, n in ops:
        if kind in "HP":
            continue
        out.append((kind, n, q, r))
        q += n if kind in "M=XIS" else 0
        r += n if kind in "M=XDN" else 0
    return out


def reference_of(ops: list[Op], size: int) -> np.ndarray:
    """The reference position of each base of the read, -1 where it is not aligned."""
    out = np.full(size, -1, np.int64)
    for kind, n, q, r in ops:
        if kind in "M=X":
            out[q : q + n] = np.arange(r, r + n)
    return out


def sliced(ops: list[Op], a: int, b: int, edges: bool) -> list[Op]:
    """The operations of the bases from a to b; with edges, also the deletions and skips that
    stand right before a or right after the last base."""
    out = []
    for kind, n, q, r in ops:
        if kind in "DN":
            if a < q < b or edges and a <= q <= b:
                out.append((kind, n, q, r))
            continue
        low, high = max(q, a), min(q + n, b)
        if low < high:
            out.append((kind, high - low, low, r + (low - q if kind in "M=X" else 0)))
    return out


def segment_score(ops: list[Op], known: set[tuple[int, int]], weights: dict[str, float] = WEIGHTS) -> float:
    total = 0.0
    for kind, n, _, r in ops:
        if kind in "M=":
            total += n * weights["base"]
        elif kind == "X":
            total += n * weights["mismatch"]
        elif kind in "ID":
            total += weights["gap"] + n * weights["gap_base"]
        elif kind == "S":
            total += n * weights["clip"]
        elif kind == "N":
            total += weights["long"] if n > MAX_INTRON else weights["junction"] + (weights["known"] if (r, r + n) in known else 0.0)
    return total


def segments(maps: list[np.ndarray]) -> list[tuple[int, int, bool]]:
    """(from, to, in step) over the bases of a read: the runs on which all maps agree and
    advance together, and what lies before, between (maybe nothing) and behind them."""
    size = len(maps[0])
    same = maps[0] >= 0
    for m in maps[1:]:
        same &= m == maps[0]
    on = np.flatnonzero(same)
    if not len(on):
        return [(0, size, False)]
    cuts = np.flatnonzero((np.diff(on) != 1) | (np.diff(maps[0][on]) != 1))
    starts, ends = on[np.append(0, cuts + 1)].tolist(), (on[np.append(cuts, len(on) - 1)] + 1).tolist()
    out, at = [], 0
    for a, b in zip(starts, ends):
        out += [(at, a, False), (a, b, True)]
        at = b
    return [*out, (at, size, False)]


def joined(parts: list[list[Op]]) -> tuple[int, str] | None:
    """(start, CIGAR) of segments laid end to end; None if the reference would run backwards or
    nothing is aligned."""
    ops: list[list] = []
    start = at = None
    for kind, n, _, r in (op for part in parts for op in part):
        if kind in "M=XDN":
            if at is None:
                if kind in "DN":
                    continue
                start = at = r
            if r < at:
                return None
            if r > at and kind in "DN":
                n += r - at
            elif r > at:
                ops.append(["D" if r - at <= MOST_DELETION else "N", r - at])
            at = r + n if r == at or kind not in "DN" else at + n
        if ops and ops[-1][0] == kind:
            ops[-1][1] += n
        else:
            ops.append([kind, n])
    while ops and ops[-1][0] in "DN":
        ops.pop()
    return None if start is None else (start, "".join(f"{n}{kind}" for kind, n in ops))


def stitched(versions: dict[str, tuple[int, str]], known: set[tuple[int, int]] = frozenset()) -> tuple[int, str, list[str], int]:
    """(start, CIGAR, aligners of the segments that differ in order, number of such segments) of
    the versions (start, CIGAR) of one read by aligner. The whole best version, where they
    agree on too little, are of different lengths, or cannot be joined."""
    ops = {name: placed([(o, int(n)) for n, o in CIGAR.findall(cigar)], start) for name, (start, cigar) in versions.items()}
    size = {name: sum(n for kind, n, _, _ in x if kind in "M=XIS") for name, x in ops.items()}
    whole = {name: segment_score(x, known) for name, x in ops.items()}
    best = min(ops, key=lambda name: (-whole[name], name))
    alone = (*versions[best], [best], 0)
    if len(ops) < 2 or len(set(size.values())) > 1:
        return alone
    maps = {name: reference_of(x, size[name]) for name, x in ops.items()}
    cut = segments(list(maps.values()))
    if sum(b - a for a, b, step in cut if step) < LEAST_SYNC * max(size[best], 1):
        return alone
    parts, winners = [], []
    for a, b, step in cut:
        if step:
            parts.append(sliced(ops[best], a, b, False))
            continue
        options = {name: sliced(x, a, b, True) for name, x in ops.items()}
        if len({tuple(o) for o in map(tuple, options.values())}) == 1:
            parts.append(options[best])
            continue
        score = {name: segment_score(o, known) for name, o in options.items()}
        won = min(options, key=lambda name: (-score[name], -whole[name], name))
        parts.append(options[won])
        winners.append(won)
    out = joined(parts)
    if out is None or sum(int(n) for n, o in CIGAR.findall(out[1]) if o in "M=XIS") != size[best]:
        return alone
    return (*out, winners or [best], len(winners))


def stitch_reads(alignments: DataFrame) -> DataFrame:
    """alignments: read_id, aligner, chrom, strand, start, cigar and known (array of
    start-end strings: the known junctions near it; may be empty). read_id, chrom, strand,
    start, cigar, aligners (of the segments that differ, joined by commas), n_segments,
    is_chimeric. Of a read on several chromosomes or strands, the versions of each are one
    read. Rows with nulls are left out."""
    rows = alignments.select("read_id", "chrom", "strand", "aligner", F.col("start").cast("long").alias("start"), "cigar", F.array_join("known", ",").alias("known")).dropna()

    def run(group: tuple, c: dict) -> list[tuple]:
        known = {tuple(map(int, j.split("-"))) for text in c["known"].tolist() for j in re.findall("[0-9]+-[0-9]+", text)}
        versions = dict(zip(c["aligner"].tolist(), zip(c["start"].tolist(), c["cigar"].tolist())))
        start, cigar, aligners, n = stitched(versions, known)
        return [(*group, start, cigar, ",".join(aligners), n, len(set(aligners)) > 1)]

    kind = dict(alignments.dtypes)["read_id"]
    return map_groups(rows, ["read_id", "chrom", "strand"], ["aligner", "start", "cigar"], run, f"read_id {kind}, chrom string, strand string, start long, cigar string, aligners string, n_segments int, is_chimeric boolean")
