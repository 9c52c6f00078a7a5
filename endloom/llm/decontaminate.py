"""Benchmark decontamination with a generalised suffix automaton of test items.

The normalised words of all items go into one generalised suffix automaton. Every
document is streamed through it; the automaton's state and the matching length give, at
each word, the longest run ending there that occurs in some item. A run of at least
``window`` words means that the window ending at the word occurs; items shorter than a
window are found at states that their whole sequence reaches.

The automaton is broadcast. Its size is bounded: items are cut into shards of at most
``shard_words`` words, each with an automaton of its own, and with more than one shard
the documents are streamed once for each shard and the results merged.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buffers
from .common import picked

WINDOW = 13
SHARD_WORDS = 250_000
#: Bytes of a document that are cut into words at a time.
PART = 1_000_000
_SPANS = "__spans"

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Lower-cases A-Z and turns every byte that is in no word into a blank.
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20) for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def word_parts(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, part by part."""
    folded = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(folded):
        to = folded.find(b" ", at + PART) if at + PART < len(folded) else -1
        to = len(folded) if to < 0 else to
        yield folded[at:to].split()
        at = to


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences, with the items of each window."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.trans: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[object] = []
        sequences = []
        for key, sequence in items:
            if sequence:
                self.items.append(key)
                sequences.append(sequence)
                self._add(sequence)
        self._finish(sequences)

    def _state(self, length: int) -> int:
        self.trans.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.trans) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """A copy of q for the paths through p that are as short as p's."""
        copy = self._state(self.length[p] + 1)
        self.trans[copy] = dict(self.trans[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.trans[p].get(w) == q:
            self.trans[p][w] = copy
            p = self.link[p]
        return copy

    def _add(self, sequence: list[bytes]) -> None:
        last = 0
        for w in sequence:
            q = self.trans[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
                continue
            cur, p = self._state(self.length[last] + 1), last
            while p >= 0 and w not in self.trans[p]:
                self.trans[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.trans[p][w]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
            last = cur

    def _finish(self, sequences: list[list[bytes]]) -> None:
        """For each state: the state of its suffix of one window, that state's items, and
        the short items that end there."""
        n, k = len(self.trans), self.window
        self.link[0] = 0
        self.window_state = [-1] * n
        self.short: list[tuple[tuple[int, int], ...]] = [()] * n
        own: dict[int, list[tuple[int, int]]] = {}
        for i, sequence in enumerate(sequences):
            if len(sequence) < k:
                v = 0
                for w in sequence:
                    v = self.trans[v][w]
                own.setdefault(v, []).append((len(sequence), i))
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= k:
                self.window_state[v] = v if self.length[up] < k else self.window_state[up]
            self.short[v] = self.short[up] + tuple(own.get(v, ()))
        found: dict[int, set[int]] = {}
        for i, sequence in enumerate(sequences):
            v = 0
            for j, w in enumerate(sequence):
                v = self.trans[v][w]
                if j + 1 >= k:
                    found.setdefault(self.window_state[v], set()).add(i)
        self.window_items = {v: tuple(x) for v, x in found.items()}
        self.least = min([k, *(len(s) for s in sequences)], default=k)

    def scan(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans (first word, word after the last) inside windows; items found."""
        return self.scan_parts([sequence])[:2]

    def scan_parts(self, parts: Iterable[list[bytes]]) -> tuple[list[tuple[int, int]], set[int], int]:
        """The same over a sequence in parts, and its length."""
        trans, link, length, least, k = self.trans, self.link, self.length, self.least, self.window
        spans: list[tuple[int, int]] = []
        windows: set[int] = set()  # states, so that a window of many items costs little
        ends: set[int] = set()
        v = size = 0
        i = -1
        for sequence in parts:
            for w in sequence:
                i += 1
                t = trans[v].get(w)
                if t is None:
                    while v and t is None:
                        v = link[v]
                        t = trans[v].get(w)
                    if t is None:
                        size = 0
                        continue
                    size = length[v]
                v = t
                size += 1
                if size >= least:
                    longest = 0
                    if size >= k:
                        longest = k
                        windows.add(self.window_state[v])
                    if self.short[v]:
                        shown = max((n for n, _ in self.short[v] if n <= size), default=0)
                        if shown:
                            longest = max(longest, shown)
                            ends.add((v, min(size, k)))
                    if longest:
                        start = i + 1 - longest
                        while spans and spans[-1][1] >= start:
                            start = min(start, spans.pop()[0])
                        spans.append((start, i + 1))
        items: set[int] = set()
        for state in windows:
            items.update(self.window_items[state])
        for state, shown in ends:
            items.update(item for n, item in self.short[state] if n <= shown)
        return spans, items, i + 1


#: The automaton that this Python worker built last.
_built: dict[tuple[str, int], SuffixAutomaton] = buffers.kept({})


class Shard:
    """Items that are broadcast; a Python worker builds their automaton once and keeps it from
    task to task, until it needs another."""

    def __init__(self, spark: SparkSession, items: list[tuple[str, list[bytes]]]) -> None:
        self.key, self.items = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    def automaton(self, window: int) -> SuffixAutomaton:
        key = self.key, window
        if key not in _built:
            _built.clear()
            _built[key] = SuffixAutomaton(self.items.value, window)
        return _built[key]


def _shards(benchmark: DataFrame, shard_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in shards of at most shard_words words; only one shard is on the driver at a
    time."""
    shard: list[tuple[str, list[bytes]]] = []
    n = 0
    for key, text in benchmark.select(F.col("item_id").cast("string"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        sequence = words(text)
        if shard and n + len(sequence) > shard_words:
            yield shard
            shard, n = [], 0
        shard.append((key, sequence))
        n += len(sequence)
    yield shard


_SCAN = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
_SCAN_DDL = "doc_id long, row_hash long, n_words long, spans array<array<long>>, items array<string>"


def _scan(docs: DataFrame, shard: Shard, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers.release(_built)
        automaton = shard.automaton(window)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in _SCAN.names}
            for key, row_hash, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                spans, items, n_words = automaton.scan_parts(word_parts(text.as_py()))
                out["doc_id"].append(key.as_py())
                out["row_hash"].append(row_hash.as_py())
                out["n_words"].append(n_words)
                out["spans"].append([list(s) for s in spans])
                out["items"].append(sorted(automaton.items[i] for i in items))
            yield pa.RecordBatch.from_pydict(out, schema=_SCAN)

    return docs.mapInArrow(run, _SCAN_DDL)


def merged(spans: Iterable[Iterable[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and out[-1][1] >= a:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, spans (word offsets), items (ids as strings, distinct, sorted).

    One row for every input row; other columns have no influence. Null and empty texts have
    no words and no spans; with an empty benchmark no text has spans. Long texts are read in
    parts. Items without an identifier, text or word are ignored; items that repeat count once for each
    identifier. Reads the benchmark on the driver, one shard at a time.
    """
    spark = docs.sparkSession
    base = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row_hash"), F.col("text").cast("string").alias("text"))
    shards = [Shard(spark, items) for items in _shards(picked(benchmark, item_id=item_col, text=item_text_col), shard_words)]
    if len(shards) == 1:
        return _scan(base, shards[0], window).select("doc_id", "n_words", "spans", F.array_distinct("items").alias("items"))
    hashed = base.withColumn("row_hash", F.xxhash64("text"))
    parts = None
    for shard in shards:
        one = _scan(hashed, shard, window)
        parts = one if parts is None else parts.unionByName(one)
    groups = parts.groupBy("doc_id", "row_hash", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count(F.lit(1)) / len(shards)).cast("int").alias("copies"))
    # Rows that repeat were merged above; each comes back as often as it was there.
    rows = groups.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    spans = F.transform(F.array_sort("spans"), lambda s: F.struct(s[0].alias("a"), s[1].alias("b")))
    union = F.aggregate(
        spans,
        F.expr("CAST(array() AS array<struct<a:bigint,b:bigint>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= s["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(s))),
    )
    return rows.select("doc_id", "n_words", F.transform(union, lambda s: F.array(s["a"], s["b"])).alias("spans"), "items")


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (at least a twentieth of the
    words is hit) to the result of contamination()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return found.withColumn("n_hit", n_hit).withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join("items", ","), 256),
            "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
        }
    )


def _cleaner(text: str, spans: list[list[int]]) -> str:
    """text without the given word spans; the blanks around a span shrink to one."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(_FOLD)
    bounds, i, n = [], 0, len(folded)
    while i < n:
        if folded[i] == 0x20:
            i += 1
            continue
        j = folded.find(b" ", i)
        j = n if j < 0 else j
        bounds.append((i, j))
        i = j
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : bounds[a][0]].rstrip())
        at = bounds[b - 1][1]
    out.append(raw[at:].lstrip() if out else raw[at:])
    return b" ".join(x for x in out if x).decode("utf-8", "surrogatepass")


def remove_spans(docs: DataFrame, benchmark: DataFrame, max_span: int = 2 * WINDOW, max_coverage: float = 0.05, window: int = WINDOW) -> DataFrame:
    """docs with the spans cut out that are longer than max_span words, or all spans where
    they cover more than max_coverage of a document's words; other columns stay. A null
    text stays null; a document without such spans stays byte for byte as it was."""
    spark, columns = docs.sparkSession, docs.columns
    shards = [Shard(spark, items) for items in _shards(picked(benchmark, item_id="item_id", text="text"), SHARD_WORDS)]
    at = columns.index("text")
    schema = docs.schema
    # Each shard adds its spans of the text as it came; what to cut is judged over all.
    kept = pa.list_(pa.list_(pa.int64()))
    docs = docs.withColumn(_SPANS, F.expr("CAST(array() AS array<array<long>>)"))

    for shard in shards:

        def find(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            automaton = shard.automaton(window)
            for batch in batches:
                found = [known.as_py() + [list(s) for s in automaton.scan_parts(word_parts(text.as_py()))[0]] for text, known in zip(batch.column(at), batch.column(len(columns)))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kept)], names=[*columns, _SPANS])

        docs = docs.mapInArrow(find, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(at), batch.column(len(columns))):
                text, spans = text.as_py(), merged(found.as_py())
                covered = sum(b - a for a, b in spans)
                cut = spans if spans and covered > max_coverage * len(words(text)) else [s for s in spans if s[1] - s[0] > max_span]
                texts.append(_cleaner(text, cut) if cut else text)
            arrays = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return docs.mapInArrow(run, schema)


def items_digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
