"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes it forms.

A document is the set of its word shingles. All shingles have one global order: first those
that are not listed as frequent, by hash, then the frequent ones by frequency. If two sets overlap enough to be linked, prefixes that are lengthened by l - 1 tokens share at
least l of them. Each document chooses its own l: a longer prefix reads more postings, but
candidates must share more tokens before they are verified; it takes the l of least
estimated cost. A pair is a candidate if its prefixes share at least the smaller l.

Documents with the same set count once, from the first step on. Pairs come from two kinds
of postings. A short posting has fewer than ``frequent_from`` sets, so all its pairs are
made. Long postings, of listed tokens or not, may hold a third of all documents: they are
first put in order of size, only neighbours become pairs, and each document verifies its
best partner, in a few rounds. What still lies in different classes is compared exactly, in
blocks that share enough tokens with long postings. So no link between classes is lost and
no group of copies makes a row for each of its pairs.

Sets are compared by 48-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers
from .common import cut, picked, spread_join
from .components import components

SIZE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Sets from which a shingle counts as frequent, and how many of the most frequent ones are
#: broadcast. Others stay in the order by hash; their postings are long or short all the same.
FREQUENT_FROM = 16
MAX_FREQUENT = 2_000_000
#: Most tokens that a prefix is lengthened by, and what verifying a pair costs in postings.
MAX_MATCH = 8
VERIFY_COST = 60.0
#: Rounds in which every set of a mixed posting verifies one more partner, before all pairs
#: of sets in different components are made.
ROUNDS = 2
#: Tokens that a task gathers before it sorts and sends them, and tokens of a bucket.
FLUSH_TOKENS = 1_500_000
BUCKET_TOKENS = 2_000_000
#: Most sets of a block that meets other blocks whole, and shingles from which it ends.
BLOCK = 256
BLOCK_TOKENS = 500_000
#: Parts that the blocks of one token are dealt into when they meet.
MEETINGS = 16
#: Distinct sets that are asked for by a broadcast list; beyond it the sets are joined.
MAX_WANTED = 4_000_000

_U = np.uint64


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size words."""
    k = max(len(h) - size + 1, 0)
    grams = np.zeros(k, _U)
    for j in range(size):
        grams = grams * _U(0x9E3779B97F4A7C15) + h[j : j + k]
    return grams


def _long_set(raw: np.ndarray, size: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of one long text, read in parts. The last words of a part go on to the next."""
    found, before = [], np.zeros(0, _U)
    for a, b in buffers.parts(raw, part):
        low = buffers.LOWER[raw[a:b]]
        starts, ends, _ = buffers.word_bounds(low, np.array([0, len(low)]))
        h = np.concatenate([before, buffers.word_hashes(low, starts, ends)])
        found.append(np.unique(buffers.mix(_grams(h, size))))
        before = h[max(len(h) - size + 1, 0) :]
    keys = np.unique(np.concatenate(found))
    if not len(keys) and len(before):  # fewer words than a shingle
        value = np.array([len(before)], _U)
        for w in before:
            value = value * _U(0x9E3779B97F4A7C15) + w
        keys = buffers.mix(value + _U(0xABCDEF))
    return keys, np.array([0, len(keys)])


def shingle_sets(texts: pa.Array, size: int = SIZE, part: int = buffers.PART) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, ascending, and where each text's begin."""
    n = len(texts)
    raw, offsets = buffers.raw_of(texts)
    if n == 1 and len(raw) > part:
        return _long_set(raw, size, part)
    raw = buffers.LOWER[raw]
    starts, ends, doc = buffers.word_bounds(raw, offsets)
    h = buffers.word_hashes(raw, starts, ends)
    count = np.bincount(doc, minlength=n)
    grams = _grams(h, size)
    k = len(grams)
    whole = doc[:k] == doc[size - 1 :] if k else np.zeros(0, bool)
    keys, owner = buffers.mix(grams[whole]), doc[:k][whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(doc, short)
        value = count[short].astype(_U)
        for j in range(size - 1):
            more = count[short] > j
            value[more] = value[more] * _U(0x9E3779B97F4A7C15) + h[first[more] + j]
        keys, owner = np.concatenate([keys, buffers.mix(value + _U(0xABCDEF))]), np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(n + 1))


def fingerprints(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 only for the empty set."""
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(buffers.mix(keys * _U(0xD6E8FEB86659FD93) + _U(1)), dtype=_U)])
    n = np.diff(bounds).astype(_U)
    out = buffers.mix((sums[bounds[1:]] - sums[bounds[:-1]]) * _U(0x9E3779B97F4A7C15) + n)
    return np.where(n == 0, 0, out | _U(1)).astype(np.uint64).view(np.int64)


def least_overlap(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least intersection of a set of n with any set that it links to."""
    return -(-percent * n // 100)


def _pack(values: np.ndarray, width: int) -> bytes:
    """Integers below 256 ** width, byte by byte place, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes, n: int, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def _deltas(tokens: np.ndarray) -> np.ndarray:
    return np.diff(tokens, prepend=_U(0))


def _bucket_cuts(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Where the ascending 40-bit tokens of each bucket begin."""
    edges = np.arange(buckets + 1, dtype=np.float64) / buckets * float(1 << 40)
    return np.searchsorted(tokens, edges.astype(_U))


def _text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def document_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, fp, n (size of the set) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers.release()
        for batch in batches:
            for a, b in buffers.slices(batch.column(1)):
                keys, bounds = shingle_sets(batch.column(1).slice(a, b - a), size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fingerprints(keys, bounds)), pa.array(np.diff(bounds))], names=["doc_id", "fp", "n"])

    return _text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long, n long")


def _new_sets(batches: Iterator[pa.RecordBatch], size: int):
    """(fp, keys) of each non-empty set that this task has not seen."""
    buffers.release()
    seen: set[int] = set()
    for batch in batches:
        for a, b in buffers.slices(batch.column(1)):
            keys, bounds = shingle_sets(batch.column(1).slice(a, b - a), size)
            for fp, s, e in zip(fingerprints(keys, bounds).tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if e > s and fp not in seen:
                    seen.add(fp)
                    yield fp, keys[s:e]
    buffers.release()


def frequent_tokens(rows: DataFrame, buckets: int, size: int, at_least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(40-bit tokens, ascending; number of sets) of the tokens in at_least sets or more, at
    most so many. Each task sends distinct tokens with counts, in ranges."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held) >> _U(24), return_counts=True)
            cuts = _bucket_cuts(tokens, buckets)
            out = []
            for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                if e > s:
                    many = np.flatnonzero(counts[s:e] > 1)
                    out.append((k, int(e - s), _pack(_deltas(tokens[s:e]), 5), many.astype("<u4").tobytes(), counts[s:e][many].astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "size", "tokens", "at", "counts"])

        for _, keys in _new_sets(batches, size):
            held.append(keys)
            n += len(keys)
            if n >= FLUSH_TOKENS:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        buffers.release()
        tokens, counts = [], []
        for n, blob, at, more in zip(*(table.column(c).to_pylist() for c in ("size", "tokens", "at", "counts"))):
            tokens.append(np.cumsum(_unpack(blob, n, 5), dtype=_U))
            c = np.ones(n, np.int64)
            c[np.frombuffer(at, "<u4")] = np.frombuffer(more, "<u4")
            counts.append(c)
        t, c = np.concatenate(tokens), np.concatenate(counts)
        order = np.argsort(t, kind="stable")
        t, c = t[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        total = np.add.reduceat(c, first)
        keep = total >= at_least
        return pa.table({"token": pa.array(t[first][keep].astype(np.int64)), "df": pa.array(total[keep])})

    found = rows.mapInArrow(send, "bucket int, size int, tokens binary, at binary, counts binary").groupBy("bucket").applyInArrow(count, "token long, df long")
    found = cut(found)
    n = found.count()
    if n > most:
        found = found.orderBy(F.col("df").desc(), "token").limit(most)
    table = found.toArrow()
    tokens, df = table.column("token").to_numpy().astype(_U), table.column("df").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], df[order]


def choose_prefix(df: np.ndarray, n: int, percent: int, most: int, verify_cost: float) -> tuple[int, int]:
    """(l, prefix length) of least estimated cost; df: frequencies in the global order, 1 for
    rare tokens. Reading costs the postings of the prefix; at most a l-th of them can be
    candidates, each of which is verified."""
    need = int(-(-percent * n // 100))
    read = np.cumsum(df)
    ls = np.arange(1, min(most, need) + 1)
    s = read[n - need + ls - 1]
    best = int(np.argmin(s * (1 + verify_cost / ls)))
    return int(ls[best]), n - need + int(ls[best])


_PREFIX_DDL = "bucket int, size int, tokens binary, at binary, fps binary, ns binary, ls binary, token long, fp long, n long, l int"
_PREFIX = pa.schema([("bucket", pa.int32()), ("size", pa.int32()), *((c, pa.binary()) for c in ("tokens", "at", "fps", "ns", "ls")), ("token", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("l", pa.int32())])


def prefixes(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int, size: int, percent: int, max_match: int) -> DataFrame:
    """Prefix tokens: rare ones packed by range (bucket, ...), frequent ones as rows
    (token, fp, n, l)."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = shared.value
        tokens: list[np.ndarray] = []
        sizes: list[int] = []
        fps: list[int] = []
        ns: list[int] = []
        ls: list[int] = []
        posts: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            t = np.concatenate(tokens)
            owner = np.repeat(np.arange(len(fps)), sizes)
            order = np.argsort(t, kind="stable")
            t, owner = t[order], owner[order]
            cuts = _bucket_cuts(t, buckets)
            columns: dict[str, list] = {f: [] for f in _PREFIX.names}
            fp, n, l = np.array(fps, np.int64), np.array(ns, np.int64), np.array(ls, np.uint8)
            for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                if e > s:
                    docs, at = np.unique(owner[s:e], return_inverse=True)
                    for c, v in (("bucket", k), ("size", int(e - s)), ("tokens", _pack(_deltas(t[s:e]), 5)), ("at", _pack(at, 4)), ("fps", fp[docs].tobytes()), ("ns", n[docs].tobytes()), ("ls", l[docs].tobytes())):
                        columns[c].append(v)
                    for c in ("token", "fp", "n", "l"):
                        columns[c].append(None)
            for token, f, m, k in posts:
                for c in ("bucket", "size", "tokens", "at", "fps", "ns", "ls"):
                    columns[c].append(None)
                for c, v in (("token", token), ("fp", f), ("n", m), ("l", k)):
                    columns[c].append(v)
            return pa.RecordBatch.from_pydict(columns, schema=_PREFIX)

        for fp, keys in _new_sets(batches, size):
            t = keys >> _U(24)
            at = np.minimum(np.searchsorted(known, t), max(len(known) - 1, 0))
            often = known[at] == t if len(known) else np.zeros(len(t), bool)
            f = np.where(often, df[at] if len(known) else 1, 1)
            order = np.argsort(f, kind="stable")  # rare first, each kind by hash
            f = f[order]
            l, length = choose_prefix(f, len(t), percent, max_match, VERIFY_COST)
            rare = t[order[: min(length, int((~often).sum()))]]
            tokens.append(np.unique(rare))
            sizes.append(len(tokens[-1]))
            listed = np.unique(t[order[len(rare) : length]])
            # Shingles of one token count once, so they cannot be asked for twice.
            l = max(1, l - (length - len(tokens[-1]) - len(listed)))
            fps.append(fp), ns.append(len(t)), ls.append(l)
            posts += [(int(x), fp, len(t), l) for x in listed]
            held += sizes[-1] + len(posts) // 8
            if held >= FLUSH_TOKENS // 2 or len(posts) >= 200_000:
                yield flush()
                tokens, sizes, fps, ns, ls, posts, held = [], [], [], [], [], [], 0
        if fps:
            yield flush()

    return rows.mapInArrow(run, _PREFIX_DDL)


def _close(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


_RARE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("l", pa.int64()), ("token", pa.int64()), ("fp", pa.int64()), ("n", pa.int64())])


def rare_pairs(prefix: DataFrame, percent: int, long_from: int = FREQUENT_FROM) -> tuple[DataFrame, DataFrame]:
    """Of the packed tokens: a, b, shared, l for all pairs of sets of near enough size in
    postings of fewer than long_from sets; and the longer postings (token, fp, n, l)."""

    def pairs(table: pa.Table) -> pa.Table:
        buffers.release()
        parts = [[], [], [], []]
        for n, blob, at, fps, ns, ls in zip(*(table.column(c).to_pylist() for c in ("size", "tokens", "at", "fps", "ns", "ls"))):
            where = _unpack(at, n, 4).astype(np.int64)
            for part, v in zip(parts, (np.cumsum(_unpack(blob, n, 5), dtype=_U), np.frombuffer(fps, np.int64)[where], np.frombuffer(ns, np.int64)[where], np.frombuffer(ls, np.uint8)[where])):
                part.append(v)
        t, fp, n, l = (np.concatenate(p) for p in parts)
        order = np.lexsort((fp, t))
        t, fp, n, l = t[order], fp[order], n[order], l[order].astype(np.int64)
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (fp[1:] != fp[:-1])])
        t, fp, n, l = t[new], fp[new], n[new], l[new]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        length = np.diff(np.append(first, len(t)))
        long = np.repeat(length >= long_from, length)
        posts = pa.table({"token": pa.array(t[long].astype(np.int64)), "fp": pa.array(fp[long]), "n": pa.array(n[long]), "l": pa.array(l[long])})
        t, fp, n, l = t[~long], fp[~long], n[~long], l[~long]
        out = []
        step = 1
        while True:  # postings are short: pairs at distance 1, 2, ... in a posting
            same = np.flatnonzero(t[step:] == t[:-step])
            if not len(same):
                break
            same = same[_close(n[same], n[same + step], percent)]
            out.append(np.stack([fp[same], fp[same + step], np.minimum(l[same], l[same + step])]))
            step += 1
        found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        order = np.lexsort(found[::-1])
        found = found[:, order]
        first = np.flatnonzero(np.concatenate([[True], (found[:2, 1:] != found[:2, :-1]).any(axis=0)])) if found.shape[1] else np.zeros(0, np.int64)
        shared = np.diff(np.append(first, found.shape[1]))
        made = pa.table({"a": pa.array(found[0][first]), "b": pa.array(found[1][first]), "shared": pa.array(shared), "l": pa.array(found[2][first])})
        return pa.concat_tables([made, posts], promote_options="default").select(_RARE.names).cast(_RARE)

    packed = prefix.where("bucket IS NOT NULL").select("bucket", "size", "tokens", "at", "fps", "ns", "ls").groupBy("bucket")
    both = cut(packed.applyInArrow(pairs, "a long, b long, shared long, l long, token long, fp long, n long"))
    made = both.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("l").alias("l"))
    return made, both.where("token IS NOT NULL").select("token", "fp", "n", F.col("l").cast("int").alias("l"))


def neighbours(posts: DataFrame, percent: int, salt: int) -> DataFrame:
    """a, b, shared for neighbours in the postings, put in order of size and a hash. Cuts
    between partitions only cost a pair."""
    width = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    component = F.col("component") if "component" in posts.columns else F.col("fp")
    ordered = posts.withColumn("h", F.xxhash64("fp", F.lit(salt))).select("token", "n", "h", "fp", component.alias("component")).repartitionByRange(width, "token", "n", "h").sortWithinPartitions("token", "n", "h", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            t, n, _, fp, c = (col.to_numpy() for col in batch.columns)
            if last is not None:
                t, n, fp, c = (np.concatenate([[x], col]) for x, col in zip(last, (t, n, fp, c)))
            if len(t):
                last = (t[-1], n[-1], fp[-1], c[-1])
            ok = np.flatnonzero((t[1:] == t[:-1]) & (c[1:] != c[:-1]) & _close(n[1:], n[:-1], percent))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[ok], fp[ok + 1])), pa.array(np.maximum(fp[ok], fp[ok + 1]))], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def _mixed(posts: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """posts with the component of each set, without the postings that lie in one component."""
    labelled = cut(posts.join(known.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    tokens = labelled.groupBy("token").agg((F.min("component") < F.max("component")).alias("mixed"), F.count(F.lit(1)).alias("n_left"))
    return spread_join(labelled, tokens.where("mixed").drop("mixed"), "token", total)


def hubs(labelled: DataFrame, links: DataFrame, percent: int, total: int) -> DataFrame:
    """a, b, shared: each set with the hub of its postings, the set with the most links so
    far, unless both are in one component."""
    ends = links.select(F.col("a").alias("fp")).unionByName(links.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count(F.lit(1)).alias("degree"))
    ranked = cut(labelled.join(ends, "fp", "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
    hub = F.max_by(F.struct(F.col("fp").alias("hub"), F.col("n").alias("hub_n"), F.col("component").alias("hub_component")), F.struct("degree", "fp"))
    best = ranked.groupBy("token").agg(hub.alias("h"), F.count(F.lit(1)).alias("n_left")).select("token", "h.*", "n_left")
    pairs = spread_join(ranked, best, "token", total).where("component <> hub_component AND 100 * least(n, hub_n) >= %d * greatest(n, hub_n)" % percent)
    return pairs.groupBy(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def _best_partners(pairs: DataFrame) -> DataFrame:
    """For each set, its pair with the most shared tokens."""
    both = pairs.select("a", "b", "shared").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    best = both.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def wanted_sets(rows: DataFrame, wanted: DataFrame, size: int, most: int = MAX_WANTED) -> DataFrame:
    """fp, keys (48-bit hashes, ascending, six bytes each) of the sets in wanted (fp)."""
    n = wanted.count()
    listed = np.sort(wanted.toArrow().column(0).to_numpy()) if n <= most else None
    shared = rows.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for fp, keys in _new_sets(batches, size):
            if known is not None:
                at = int(np.searchsorted(known, fp))
                if at == len(known) or known[at] != fp:
                    continue
            short = np.unique(keys >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            yield pa.RecordBatch.from_arrays([pa.array([fp], pa.int64()), pa.array([np.ascontiguousarray(short).tobytes()], pa.binary())], names=["fp", "keys"])

    # A set that several tasks met is one row from here on.
    sets = rows.mapInArrow(run, "fp long, keys binary").dropDuplicates(["fp"])
    return sets if listed is not None else sets.join(wanted, "fp", "left_semi")


def _keys(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").reshape(-1)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets link. Both sides go to the pair's place once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers.release()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = _keys(x.as_py()), _keys(y.as_py())
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    left = sets.select(F.col("fp").alias("a"), F.col("keys").alias("x"))
    right = sets.select(F.col("fp").alias("b"), F.col("keys").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _summed_before(ordered: DataFrame, weight: str) -> DataFrame:
    """Adds place, the sum of weight over all rows before, in all partitions, of a frame that
    is range-partitioned and sorted. One number for each partition passes through the
    driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            w = batch.column(names.index(weight)).to_numpy()
            ends = at + np.cumsum(w)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(w), part, np.int64)), pa.array(ends - w)], names=[*names, "part", "local"])
            at = int(ends[-1]) if len(w) else at

    names = ordered.columns
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema) + ", part long, local long"
    placed = cut(ordered.mapInArrow(local, ddl))
    sums = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum(weight).alias("n")).collect())
    base, bases = 0, []
    for part, n in sums:
        bases.append((part, base))
        base += n
    offsets = placed.sparkSession.createDataFrame(bases, "part long, base long")
    return placed.join(F.broadcast(offsets), "part").withColumn("place", F.col("base") + F.col("local")).drop("part", "local", "base")


def block_overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of ascending key arrays."""
    keys_x, keys_y = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(keys_x, keys_y)
    out = np.zeros((len(x), len(y)), np.float32)
    own_x, own_y = (np.repeat(np.arange(len(z)), [len(k) for k in z]) for z in (x, y))
    for at in range(0, len(common), 8192):
        part = common[at : at + 8192]
        ms = []
        for keys, own, z in ((keys_x, own_x, x), (keys_y, own_y, y)):
            place = np.minimum(np.searchsorted(part, keys), len(part) - 1)
            hit = part[place] == keys
            m = np.zeros((len(z), len(part)), np.float32)
            m[own[hit], place[hit]] = 1
            ms.append(m)
        out += ms[0] @ ms[1].T
    return out


def block_links(labelled: DataFrame, sets: DataFrame, near: DataFrame, percent: int, block: int = BLOCK, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The links between sets of different components that share tokens of long postings.

    labelled: the mixed postings (token, fp, n, l, component); near: the pairs (a, b) that
    share tokens of short postings. The sets of mixed postings are put in order of their
    first token and size and dealt into blocks of a bounded number of sets and shingles. Two
    blocks meet if their sizes allow a link and they share as many tokens as the least l of
    either asks for, or, if a pair between them shares tokens of short postings too, one.
    All pairs of two blocks are compared by one matrix product, so a pair is never a row."""
    each = labelled.groupBy("fp").agg(F.min("token").alias("lead"), F.min("n").alias("n"), F.min("l").alias("l"), F.min("component").alias("component"))
    each = each.withColumn("weight", F.greatest("n", F.lit(block_tokens // block)))
    width = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _summed_before(each.repartitionByRange(width, "lead", "n", "fp").sortWithinPartitions("lead", "n", "fp"), "weight")
    dealt = cut(placed.select("fp", "n", "l", "component", F.floor(F.col("place") / block_tokens).alias("block")))
    heads = dealt.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("l").alias("l"))
    tokens = cut(labelled.select("token", "fp").join(dealt.select("fp", "block"), "fp").select("token", "block").distinct().join(heads, "block"))
    side = lambda s: tokens.select("token", *(F.col(c).alias(s + c) for c in ("block", "low", "high", "l")))
    left = side("p").withColumn("part", F.pmod(F.xxhash64("pblock"), F.lit(MEETINGS)).cast("int"))
    right = side("q").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(MEETINGS - 1))))
    close = "pblock <= qblock AND 100 * phigh >= {0} * qlow AND 100 * qhigh >= {0} * plow".format(percent)
    shared = left.join(right, ["token", "part"]).where(close).groupBy(F.col("pblock").alias("p"), F.col("qblock").alias("q")).agg(F.count(F.lit(1)).alias("c"), F.min(F.least("pl", "ql")).alias("l"))
    where = dealt.select("fp", "block")
    linked = near.join(where.select(F.col("fp").alias("a"), F.col("block").alias("x")), "a").join(where.select(F.col("fp").alias("b"), F.col("block").alias("y")), "b").select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), F.lit(True).alias("near")).distinct()
    met = shared.join(linked, ["p", "q"], "left").where("c >= l OR near").select("p", "q")
    bodies = dealt.join(sets, "fp").groupBy("block").agg(F.collect_list(F.struct("fp", "n", "component", "keys")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers.release()
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                x, y = x.as_py(), y.as_py()
                fx, nx, cx = (np.array([r[k] for r in x]) for k in ("fp", "n", "component"))
                fy, ny, cy = (np.array([r[k] for r in y]) for k in ("fp", "n", "component"))
                both = block_overlaps([_keys(r["keys"]) for r in x], [_keys(r["keys"]) for r in y]).astype(np.int64)
                i, j = np.nonzero((100 * both >= percent * (nx[:, None] + ny[None, :] - both)) & (cx[:, None] != cy[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fx[i], fy[j])), pa.array(np.maximum(fx[i], fy[j]))], names=["a", "b"])

    pairs = met.join(bodies.select(F.col("block").alias("p"), F.col("body").alias("x")), "p").join(bodies.select(F.col("block").alias("q"), F.col("body").alias("y")), "q")
    return pairs.select("x", "y").mapInArrow(run, "a long, b long").distinct()


def _classes_of(table: DataFrame, final: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id from the rows (doc_id, fp, n) and the components of fps.
    What many rows or fps share meets them without a shuffle."""
    own = cut(table.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_left")).join(final.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    rows, fps = own.agg(F.coalesce(F.sum("n_left"), F.lit(0)), F.count(F.lit(1))).first()
    least = own.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_left"))
    named = cut(spread_join(own.select("fp", "component", F.col("n_left").alias("rows")), least, "component", fps).select("fp", "component_id", F.col("rows").alias("n_left")))
    full = spread_join(table.where("n > 0"), named, "fp", rows).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(table.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, frequent_from: int = FREQUENT_FROM, max_match: int = MAX_MATCH, max_frequent: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; other columns have no influence.

    Words are runs of characters that are no ASCII white space, with A-Z lower-cased. A
    text of fewer words than a shingle is one shingle; null, empty and blank texts have an
    empty set and are linked with nothing (component_id is their own doc_id). component_id is
    the least doc_id in a component (null doc_ids are passed over; null if there is no
    other). Rows that repeat stay; an empty table gives an empty frame. max_frequent bounds
    the list of frequent tokens and with it the cost, not the result. Runs jobs; texts are
    read four times.
    """
    rows = _text_rows(docs, id_col, text_col)
    table = cut(document_sets(docs, id_col, text_col, size))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = int(total // BUCKET_TOKENS) + 1
    frequent = frequent_tokens(rows, buckets, size, frequent_from, MAX_FREQUENT if max_frequent is None else max_frequent)
    prefix = cut(prefixes(rows, frequent, buckets, size, percent, max_match))
    rare, long = rare_pairs(prefix, percent, frequent_from)
    rare = cut(rare)
    posts = cut(prefix.where("token IS NOT NULL").select("token", "fp", "n", "l").unionByName(long).distinct())
    n_posts = posts.count()
    # Only sets with enough rare matches, or in long postings, can be candidates.
    lengths = posts.groupBy("token").agg(F.count(F.lit(1)).alias("n_left")).where("n_left > 1")
    posts = cut(spread_join(posts, lengths, "token", n_posts))
    enough = rare.where("shared >= l")
    ends = enough.select(F.col("a").alias("fp")).unionByName(enough.select(F.col("b").alias("fp"))).unionByName(posts.select("fp")).distinct()
    sets = cut(wanted_sets(rows, cut(ends), size))
    tried = cut(_best_partners(enough.select("a", "b", "shared").unionByName(neighbours(posts, percent, 0))))
    links = cut(verified(tried, sets, percent))
    known = cut(components(links))
    for step in range(1, ROUNDS + 1):
        labelled = cut(_mixed(posts, known, n_posts))
        if step % 2:
            more = hubs(labelled, links, percent, n_posts)
        else:
            more = neighbours(labelled, percent, step)
        more = cut(_best_partners(more.join(tried, ["a", "b"], "left_anti")))
        found = cut(verified(more, sets, percent))
        tried, links = cut(tried.unionByName(more)), cut(links.unionByName(found))
        known = cut(components(links))
    label = lambda side: known.select(F.col("node").alias(side), F.col("component").alias("c" + side))
    apart = enough.join(label("a"), "a", "left").join(label("b"), "b", "left").where("NOT coalesce(ca, a) <=> coalesce(cb, b)").select("a", "b")
    rest = cut(verified(apart.join(tried, ["a", "b"], "left_anti"), sets, percent).unionByName(block_links(cut(_mixed(posts, known, n_posts)), sets, rare.where("shared < l"), percent)))
    return _classes_of(table, components(links.unionByName(rest)))
