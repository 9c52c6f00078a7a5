"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two words is the sum over all subsequences of three characters, within a
stretch of at most SPAN, of the product of their weights, where a weight is ``DECAY`` to the
power of the stretch that the subsequence spans: insults with inserted or missing characters
keep most of it. Words are compared with a mark at their start, in lower case, without
characters that are neither letters nor digits, with digits and signs that stand for
letters read as such; runs of single letters are read as one word.

The machine learns from sentences. A sentence's value is that of its most insulting word,
so a clean sentence says that all of its words lie below the margin, and a toxic sentence
that some of its words, its witnesses, lie above. Every sentence of a clean document is
clean. A sentence of a toxic document is toxic if it holds a word that tells, by itself or
by a run of five of its characters, toxic documents from clean ones, at least HALF as
strongly as the best of its document. These words are its witnesses; after a fit, they
are chosen anew: those that the fit finds insulting, or else the best. Of the words of clean sentences the driver holds
only those that break the margin: each round one pass over all of them finds the breakers
of the last fit, until there are no new ones, so the fit is that of all words.

The decision function is linear in the kernel, so the landmarks fold into one table over
character triples and a word's value does not take a kernel evaluation for each landmark.
A logistic model turns a document's sentence values into a score.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers
from .common import cut, picked

DECAY = 0.5
#: Most characters that the three of a subsequence stretch over.
SPAN = 6
LANDMARKS = 300
HALF = 0.5
#: Most labelled documents that are read for training, the first by a hash of their id.
MAX_LABELLED = 20_000
#: Characters of the runs that tell words of one stem.
RUN = 5
#: Words of clean sentences that the first fit starts from (the passes add all that matter),
#: by how much a word breaks the margin before it is added, words that one pass adds, most
#: rounds of fitting, and the rounds in which witnesses may change.
START, SLACK, STEP, ROUNDS, MOVES = 3000, 0.5, 5000, 8, 2
#: Labelled documents that share this part of their runs of SHINGLE words are copies. It is
#: estimated by so many min-hashes; those to compare share BAND of these in a row.
COPY, SHINGLE, HASHES, BAND = 0.8, 5, 60, 5

# Digits and signs read as the letters that they resemble, signs that do not
# count at the edges of a word, and what may stand after the stop of a sentence.
_LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_EDGE = "\"'`.,;:!?()[]{}<>«»„“”‘’*&%#$|…-_=+/\\~^"
_CLOSERS = "\"'»”)]"
_STOPS = ".!?"

_ALPHA, _ALNUM, _AT_EDGE, _CLOSER, _STOP = 1, 2, 4, 8, 16


def _kind(c: str) -> int:
    return _ALPHA * c.isalpha() + _ALNUM * c.isalnum() + _AT_EDGE * (c in _EDGE) + _CLOSER * (c in _CLOSERS) + _STOP * (c in _STOPS)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case and kind of the first 65536 characters, and the looks of the first 128."""
    chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(1 << 16)]
    looks = np.zeros(128, np.uint32)
    for c, to in _LOOKS.items():
        looks[ord(c)] = ord(to)
    return np.array([ord(c.lower()[0]) for c in chars], np.uint32), np.array([_kind(c) for c in chars], np.uint8), looks


_LOWER, _KIND, _LOOK = _tables()


def _code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 bytes, and the number of characters before each byte."""
    lead = (raw & 0xC0) != 0x80
    before = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(lead, out=before[1:])
    at = np.flatnonzero(lead)
    code = raw[at].astype(np.uint32)
    wide = np.flatnonzero(code >= 0x80)
    if len(wide):
        first = code[wide]
        one, two, three = (raw[np.minimum(at[wide] + k, len(raw) - 1)].astype(np.uint32) & 0x3F for k in (1, 2, 3))
        code[wide] = np.where(first < 0xE0, (first & 0x1F) << 6 | one, np.where(first < 0xF0, (first & 0x0F) << 12 | one << 6 | two, (first & 0x07) << 18 | one << 12 | two << 6 | three))
    return code, before


@dataclass
class Words:
    """The words of some texts: the text of each, its form's size, the characters of all
    forms, and whether a sentence ends with it."""

    doc: np.ndarray
    size: np.ndarray
    chars: np.ndarray
    stop: np.ndarray

    def strings(self) -> list[str]:
        """The forms."""
        text = self.chars.astype("<u4").tobytes().decode("utf-32-le", "replace")
        ends = np.cumsum(self.size).tolist()
        return [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, doc = buffers.word_bounds(raw, offsets)
    if not len(starts):
        return Words(doc, np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, bool))
    code, before = _code_points(raw)
    length = before[ends] - before[starts]
    code = code[~((code == 0x20) | (code - np.uint32(9) < 5))]
    word = np.repeat(np.arange(len(starts), dtype=np.int32), length)
    first = np.cumsum(length) - length
    low = np.minimum(code, np.uint32(0xFFFF))
    lower, kind = _LOWER[low], _KIND[low]
    if len(high := np.flatnonzero(code > 0xFFFF)):
        for c in np.unique(code[high]).tolist():
            here = high[code[high] == c]
            lower[here], kind[here] = (ord(chr(c).lower()[0]), _kind(chr(c))) if c < 0x110000 else (c, 0)
    at = np.arange(len(code), dtype=np.int32)
    core = (kind & _AT_EDGE) == 0
    left = np.minimum.reduceat(np.where(core, at, np.int32(2**31 - 1)), first)
    right = np.maximum.reduceat(np.where(core, at, np.int32(-1)), first)
    letters = np.bitwise_or.reduceat(kind, first) & _ALPHA > 0
    look = np.where(lower < 128, _LOOK[np.minimum(lower, 127)], 0)
    looked = (look > 0) & letters[word]
    kept = ((kind & _ALNUM > 0) | looked) & (at >= left[word]) & (at <= right[word])
    chars = np.where(looked, look, lower)[kept].astype(np.uint32)
    size = np.bincount(word[kept], minlength=len(starts))
    last = np.maximum.reduceat(np.where(kind & _CLOSER == 0, at, np.int32(-1)), first)
    stop = (last >= 0) & (kind[last] & _STOP > 0)
    feeds = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(raw == 0x0A, out=feeds[1:])
    stop |= feeds[np.append(starts[1:], len(raw))] > feeds[ends]
    return Words(doc, size, chars, stop)


def word_parts(texts: pa.Array, part: int = buffers.PART) -> Iterator[Words]:
    """The words of texts; of one long text part by part."""
    raw, offsets = buffers.raw_of(texts)
    if len(texts) == 1 and len(raw) > part:
        for a, b in buffers.parts(raw, part):
            yield words_of(raw[a:b], np.array([0, b - a]))
    else:
        yield words_of(raw, offsets)


def bare(piece: str) -> str:
    """The form of a word that the kernel sees."""
    raw = np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8)
    return "".join(words_of(raw, np.array([0, len(raw)])).strings())


def _scale(n: np.ndarray | int) -> np.ndarray:
    """The norm of words of n characters whose subsequences are all different."""
    n, total = np.asarray(n, float), 0.0
    for d in range(3, SPAN + 1):
        total = total + DECAY ** (2 * d) * np.maximum(n + 2 - d, 0) * (d - 2)
    return np.sqrt(np.where(total > 0, total, 1.0))


@dataclass
class WordModel:
    """value(word) = bias + sum of table[a, b, c] * DECAY ** span over its character triples,
    over a norm that depends on the word's length."""

    chars: dict[str, int]
    table: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.other = len(self.chars)
        self.ids = np.full(1 << 16, self.other, np.int32)
        for c, i in self.chars.items():
            if ord(c) < 1 << 16:
                self.ids[ord(c)] = i
        self.flat = self.table.astype(np.float32).reshape(-1)

    def value_of(self, chars: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Values of words from their characters and sizes; all words in one pass, with
        marks between them that no triple of the table holds."""
        if not len(size):
            return np.zeros(0)
        a, gap = self.other + 1, SPAN - 1
        begin = np.cumsum(size + 1 + gap) - (size + 1 + gap)
        total = int(begin[-1] + size[-1] + 1 + gap)
        line = np.full(total + gap, self.other, np.int32)
        line[begin] = self.chars["^"]
        line[np.arange(len(chars)) + np.repeat(begin + 1 - (np.cumsum(size) - size), size)] = np.where(chars < 1 << 16, self.ids[np.minimum(chars, 0xFFFF)], self.other)
        scaled = line * np.int32(a)
        sums = np.zeros(total, np.float32)
        for d in range(3, SPAN + 1):
            weight = np.float32(DECAY**d)
            for m in range(1, d - 1):
                sums += self.flat[(scaled[:total] + line[m : total + m]) * np.int32(a) + line[d - 1 : total + d - 1]] * weight
        return self.bias + np.add.reduceat(sums, begin).astype(float) / _scale(size)

    def values(self, words: list[str]) -> np.ndarray:
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.value_of(chars, np.array([len(w) for w in words], np.int64))


class Features:
    """The weighted triples of words, as arrays: those of word i are from bounds[i] to
    bounds[i + 1] in codes (ascending) and weights."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        size = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet, ids = np.unique(np.append(chars, np.uint32(ord("^"))), return_inverse=True)
        self.base = len(self.alphabet) + 1
        begin = np.cumsum(size + 1) - (size + 1)
        line = np.full(int((size + 1).sum()), ids[-1], np.int64)
        line[np.arange(len(chars)) + np.repeat(begin + 1 - (np.cumsum(size) - size), size)] = ids[:-1]
        owner = np.repeat(np.arange(len(words)), size + 1)
        keys, weights = [], []
        for d in range(3, SPAN + 1):
            at = np.flatnonzero(owner[: len(owner) - d + 1] == owner[d - 1 :]) if len(owner) >= d else np.zeros(0, np.int64)
            for m in range(1, d - 1):
                keys.append(owner[at] * self.base**3 + (line[at] * self.base + line[at + m]) * self.base + line[at + d - 1])
                weights.append(np.full(len(at), DECAY**d))
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        self.bounds = np.searchsorted(key, np.arange(len(words) + 1) * self.base**3)
        self.codes = key % self.base**3
        self.weights = np.bincount(where, np.concatenate(weights), minlength=len(key)) / np.repeat(_scale(size), np.diff(self.bounds))

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.bounds[i], self.bounds[i + 1])
        return self.codes[part], self.weights[part]

    def dense(self, rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, matrix) of some words."""
        codes = np.unique(np.concatenate([self.of(r)[0] for r in rows]))
        out = np.zeros((len(rows), len(codes)))
        for k, r in enumerate(rows):
            c, v = self.of(r)
            out[k, np.searchsorted(codes, c)] = v
        return codes, out

    def against(self, codes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """The kernel of every word with the words of dense()."""
        at = np.minimum(np.searchsorted(codes, self.codes), len(codes) - 1)
        held = codes[at] == self.codes
        out = np.zeros((len(self.words), len(matrix)))
        for i, (s, e) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())):
            h = held[s:e]
            if h.any():
                out[i] = matrix[:, at[s:e][h]] @ self.weights[s:e][h]
        return out


def _unlike(features: Features, rows: list[int], most: int, limit: float = 0.85) -> list[int]:
    """Of words in order, those that are unlike all that were chosen before them."""
    chosen: list[int] = []
    if not rows:
        return chosen
    codes, matrix = features.dense(rows[: 20 * most])
    for k, r in enumerate(rows[: 20 * most]):
        if len(chosen) >= most:
            break
        if not chosen or (matrix[[c for c, _ in chosen]] @ matrix[k]).max() < limit:
            chosen.append((k, r))
    return [r for _, r in chosen]


def fit_words(words: list[str], signs: np.ndarray, weights: np.ndarray, landmarks: int = LANDMARKS, penalty: float = 0.05, positive_weight: float = 4.0) -> WordModel:
    """A linear machine with squared hinge loss on the Nyström features of words, of which
    the most telling come first. A word may be there with both signs."""
    features = Features(words)
    positive = [i for i, s in enumerate(signs) if s > 0]
    chosen = _unlike(features, positive, landmarks * 2 // 3)
    taken = {words[i] for i in chosen}
    chosen += [i for i, s in enumerate(signs) if s < 0 and words[i] not in taken][: landmarks - len(chosen)]
    codes, phi = features.dense(chosen)
    values, vectors = np.linalg.eigh(phi @ phi.T)
    keep = values > 1e-9 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # K_mm to the power of -1/2
    x = np.hstack([features.against(codes, phi) @ root, np.ones((len(words), 1))])
    c = weights * np.where(signs > 0, positive_weight, 1.0)
    beta = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9

    def cost(b: np.ndarray) -> float:
        return float(b @ ridge @ b + (c * np.maximum(0.0, 1 - signs * (x @ b)) ** 2).sum())

    best = cost(beta)
    for _ in range(100):  # Newton steps, halved until the cost falls
        held = signs * (x @ beta) < 1
        xs, cs = x[held], c[held]
        step = np.linalg.solve(ridge + (xs * cs[:, None]).T @ xs, (xs * cs[:, None]).T @ signs[held]) - beta
        size = 1.0
        while size > 1e-4 and (new := cost(beta + size * step)) >= best:
            size /= 2
        if size <= 1e-4:
            break
        beta, gain, best = beta + size * step, best - new, new
        if gain < 1e-7 * best:
            break
    alpha = phi.T @ (root @ beta[:-1])
    used = np.unique(np.concatenate([codes // features.base**2, codes // features.base % features.base, codes % features.base, np.searchsorted(features.alphabet, [ord("^")])]))
    place = np.zeros(features.base, np.int64)
    place[used] = np.arange(len(used))
    n = len(used) + 1
    table = np.zeros((n, n, n))
    table[place[codes // features.base**2], place[codes // features.base % features.base], place[codes % features.base]] = alpha
    return WordModel({chr(features.alphabet[u]): k for k, u in enumerate(used.tolist())}, table, float(beta[-1]))


def _runs_of(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size words from each place on."""
    runs = np.zeros(max(len(ids) - size + 1, 0), np.uint64)
    for k in range(size):
        runs = (runs ^ ids[k : len(runs) + k]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    return runs


_FACTORS = np.random.default_rng(7).integers(2**63, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_hashes(words: list[str], bounds: np.ndarray) -> np.ndarray:
    """HASHES min-hashes of 32 bits of the runs of SHINGLE words of each text, a row each;
    shorter texts are one run, those without words have none."""
    known = {w: zlib.crc32(w.encode("utf-8", "surrogatepass")) + 1 for w in set(words)}
    ids = np.array([known[w] for w in words], np.uint64)
    runs, out = _runs_of(ids, SHINGLE), np.full((len(bounds) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    long = np.flatnonzero(np.diff(bounds) >= SHINGLE)
    if len(long):
        edges = np.stack([bounds[long], bounds[long + 1] - SHINGLE + 1], axis=1).reshape(-1)
        for k, f in enumerate(_FACTORS):
            least = ((runs * f) >> np.uint64(32)).astype(np.uint32)
            out[long, k] = np.minimum.reduceat(np.append(least, np.uint32(0xFFFFFFFF)), edges)[::2]
    for i in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < SHINGLE)).tolist():
        one = _runs_of(ids[bounds[i] : bounds[i + 1]], int(bounds[i + 1] - bounds[i]))
        out[i] = (one[0] * _FACTORS) >> np.uint64(32)
    return out


def _read_texts(texts: pa.Array, part: int = buffers.PART) -> tuple[list[set[str]], list[int], np.ndarray]:
    """(words, hash of the whole sequence of words, min-hashes) of each text; a long text is
    read in parts, whose last words go on to the next."""
    n = len(texts)
    words: list[set[str]] = [set() for _ in range(n)]
    hashes = [hashlib.blake2b(digest_size=8) for _ in range(n)]
    least, before = np.full((n, HASHES), 0xFFFFFFFF, np.uint32), []
    parts = 0
    for found in word_parts(texts, part):
        forms = [w for w in found.strings() if w]
        bounds = np.searchsorted(found.doc[found.size > 0], np.arange(n + 1))
        for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            words[i].update(w for w in forms[s:e] if len(w) >= 2)
            hashes[i].update("".join(w + " " for w in forms[s:e]).encode("utf-8", "surrogatepass"))
        joined = before + forms if n == 1 else forms
        now = min_hashes(joined, np.array([0, len(joined)]) if n == 1 else bounds)
        least = np.minimum(least, now) if not parts or len(joined) >= SHINGLE else least
        before, parts = joined[1 - SHINGLE :] if n == 1 else [], parts + 1
    return words, [int.from_bytes(h.digest(), "little", signed=True) for h in hashes], least


def near_copies(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int]]:
    """rows: toxic, sign, min-hashes. toxic, sign, leader of each row that shares COPY of its
    min-hashes with a row of the same label before it, the leader, which follows none."""
    buckets: dict[tuple[int, int, bytes], list[int]] = {}
    marks = np.zeros((len(rows), HASHES), np.uint32)
    signs: list[int] = []
    moved = []
    for toxic, sign, raw in sorted(rows):
        mark = np.frombuffer(raw, np.uint32)
        keys = [(toxic, k, raw[4 * k : 4 * (k + BAND)]) for k in range(0, HASHES, BAND)]
        near = sorted({i for key in keys for i in buckets.get(key, ())})
        same = (marks[near] == mark).sum(axis=1)
        if near and same.max() >= COPY * HASHES:
            moved.append((toxic, sign, signs[near[int(same.argmax())]]))
            continue
        marks[len(signs)] = mark
        for key in keys:
            buckets.setdefault(key, []).append(len(signs))
        signs.append(sign)
    return moved


def type_counts(labelled: DataFrame) -> DataFrame:
    """labelled: text, toxic. word, toxic_docs, clean_docs; the word '' stands for all
    documents. Copies and near copies of a document (by the runs of SHINGLE words that they
    share) count once: copies of one toxic document would else make all of its words telling.
    Collects the min-hashes of the different texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers.release()
        for batch in batches:
            for a, b in buffers.slices(batch.column(0)):
                words, sign, least = _read_texts(batch.column(0).slice(a, b - a))
                lists = pa.array([[*own, ""] for own in words], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(a, b - a), pa.array(sign, pa.int64()), pa.array([row.tobytes() for row in least], pa.binary())], names=["words", "toxic", "sign", "least"])

    read = cut(labelled.select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "words array<string>, toxic int, sign long, least binary"))
    different = read.groupBy("toxic", "sign").agg(F.first("least").alias("least"), F.count(F.lit(1)).alias("n")).collect()
    moved = near_copies([(r["toxic"], r["sign"], bytes(r["least"])) for r in different])
    leader = {(t, s): l for t, s, l in moved}
    several = {(r["toxic"], r["sign"]) for r in different if r["n"] > 1} | set(leader) | {(t, l) for t, _, l in moved}
    groups = read.sparkSession.createDataFrame([(t, s, leader.get((t, s), s)) for t, s in sorted(several)], "toxic int, sign long, leader long")
    marked = read.select("words", "toxic", "sign").join(F.broadcast(groups), ["toxic", "sign"], "left")
    single = marked.where("leader IS NULL").select(F.explode("words").alias("word"), "toxic")
    once = marked.where("leader IS NOT NULL").select(F.explode("words").alias("word"), "toxic", "leader").distinct().select("word", "toxic")
    return single.unionByName(once).groupBy("word").agg(F.sum("toxic").alias("toxic_docs"), F.sum(1 - F.col("toxic")).alias("clean_docs"))


def _runs(word: str) -> list[str]:
    """The runs of RUN characters of a marked word that is longer than such a run."""
    marked = "^" + word
    return [marked[i : i + RUN] for i in range(len(marked) - RUN + 1)] if len(marked) > RUN else []


def telling(counts: DataFrame) -> dict[str, float]:
    """Words, and runs of characters (marked by a blank before them), that tell toxic documents:
    at least four times as frequent there, in three or more, and that is no chance among so
    many. Runs add up the documents of the words that hold them."""
    toxic, both = F.col("toxic_docs"), F.col("toxic_docs") + F.col("clean_docs")
    runs = F.array_distinct(F.expr(f"transform(sequence(1, length(word) + 2 - {RUN}), i -> concat(' ', substring(concat('^', word), i, {RUN})))"))
    long = counts.where(F.length("word") >= RUN)
    places = F.length("word") + 2 - RUN
    first = counts.agg(F.count_if(toxic > 0), F.sum(toxic), F.sum("clean_docs")).first()
    second = long.agg(F.sum(toxic * places), F.sum(F.col("clean_docs") * places)).first()
    if not first[1] or not first[2]:
        return {}

    def told(part: DataFrame, tested: int, p: int, q: int, clean: bool) -> DataFrame:
        """Rows that tell, or, before clean documents are counted, that may tell."""
        share = p / (p + q)
        all_docs = both if clean else toxic
        z = (toxic - all_docs * share) / F.sqrt(all_docs * share + 1)
        out = part.withColumn("z", z).where((toxic >= 3) & (F.col("z") >= 0.8 * float(np.sqrt(2 * np.log(max(tested, 2))))))
        return out.where(toxic * (q / p) >= 4 * F.col("clean_docs")) if clean else out.select("word", "toxic_docs")

    out = {r["word"]: r["z"] for r in told(counts, *first, True).select("word", "z").collect()}
    if second[0] and second[1]:
        seen = cut(long.where(toxic > 0).select(F.explode(runs).alias("word"), "toxic_docs").groupBy("word").agg(F.sum("toxic_docs").alias("toxic_docs")))
        tested = seen.count()
        may = cut(told(seen, tested, *second, False))
        clean = long.where("clean_docs > 0").select(F.explode(runs).alias("word"), "clean_docs").join(may.select("word"), "word", "left_semi").groupBy("word").agg(F.sum("clean_docs").alias("clean_docs"))
        full = may.join(clean, "word", "left").withColumn("clean_docs", F.coalesce("clean_docs", F.lit(0)))
        out |= {r["word"]: r["z"] for r in told(full, tested, *second, True).select("word", "z").collect()}
    return out


def toxic_sentences(labelled: DataFrame, evidence: dict[str, float]) -> list[tuple[tuple[str, ...], int]]:
    """(the words that tell at least HALF as strongly as the best of their document, the
    strongest first; number) of the sentences of toxic documents that hold any; sentences
    with the same words are one row, repeated texts count once."""
    shared = labelled.sparkSession.sparkContext.broadcast(evidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers.release()
        tells = shared.value
        known: dict[str, float] = {}
        for batch in batches:
            for a, b in buffers.slices(batch.column(0)):
                found: dict[tuple[int, int], dict[str, float]] = {}
                best: dict[int, float] = {}
                number = 0
                for words in word_parts(batch.column(0).slice(a, b - a)):
                    if not len(words.doc):
                        continue
                    sentence = number + np.cumsum(np.concatenate([[False], words.stop[:-1] | (words.doc[1:] != words.doc[:-1])]))
                    for d, s, w in zip(words.doc.tolist(), sentence.tolist(), words.strings()):
                        if w not in known:
                            known[w] = max([tells.get(w, 0.0), *(tells.get(" " + r, 0.0) for r in _runs(w))]) if len(w) >= 2 else 0.0
                        if known[w]:
                            found.setdefault((d, s), {})[w] = known[w]
                            best[d] = max(best.get(d, 0.0), known[w])
                    number = int(sentence[-1]) + bool(words.stop[-1])
                kept = ((d, f, [w for w in f if f[w] >= HALF * best[d]]) for (d, _), f in found.items())
                rows = [sorted(told, key=lambda w: (-f[w], w)) for d, f, told in kept if told]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["words"])
                if len(known) > 500_000:
                    known.clear()

    rows = labelled.where("toxic = 1").select(F.col("text").cast("string").alias("text")).distinct().mapInArrow(run, "words array<string>")
    return [(tuple(r["words"]), r["n"]) for r in rows.groupBy("words").agg(F.count(F.lit(1)).alias("n")).orderBy("words").collect()]


def breakers(clean: DataFrame, model: WordModel, seen: set[str], most: int) -> list[tuple[str, int]]:
    """clean: word, clean_docs. The words not seen that break the margin by more than SLACK,
    at most so many, the worst first; later rounds find the others."""
    shared = clean.sparkSession.sparkContext.broadcast((model, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            value = model.values(words)
            value[[w in seen for w in words]] = -9.0
            yield batch.append_column("value", pa.array(value)).filter(pa.array(value > SLACK - 1.0))

    return [(r[0], r[1]) for r in clean.mapInArrow(run, "word string, clean_docs long, value double").orderBy(F.col("value").desc(), "word").limit(most).collect()]


def train_words(labelled: DataFrame) -> WordModel:
    """labelled: text, toxic (0 or 1). Without a telling word the model's values are all -1."""
    none = WordModel({"^": 0}, np.zeros((2, 2, 2)), -1.0)
    counts = cut(type_counts(labelled))
    n = counts.where("word = ''").first()
    if not n or not n["toxic_docs"] or not n["clean_docs"]:
        return none
    counts = counts.where("word <> ''")
    evidence = telling(counts)
    sentences = toxic_sentences(labelled, evidence) if evidence else []
    if not sentences:
        return none
    clean = counts.where("clean_docs > 0").select("word", F.col("clean_docs").cast("long").alias("clean_docs"))
    negatives = {r[0]: r[1] for r in clean.orderBy(F.col("clean_docs").desc(), "word").limit(START).collect()}
    if not negatives:
        return none
    witness = [words for words, _ in sentences]
    model = none
    for step in range(ROUNDS):
        weight: dict[str, int] = {}
        for words, (_, k) in zip(witness, sentences):
            for w in words:
                weight[w] = weight.get(w, 0) + k
        positive = sorted(weight, key=lambda w: (-weight[w], w))
        negative = sorted(negatives, key=lambda w: (-negatives[w], w))
        signs = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        model = fit_words(positive + negative, signs, np.log1p([float(weight[w]) for w in positive] + [float(negatives[w]) for w in negative]))
        again = witness
        if step < MOVES:
            several = sorted({w for words, _ in sentences for w in words})
            value = dict(zip(several, model.values(several)))
            again = [tuple(w for w in words if value[w] >= min(0.0, max(value[x] for x in words))) for words, _ in sentences]
        new = breakers(clean, model, set(negatives), STEP)
        if not new and again == witness:
            break
        negatives |= dict(new)
        witness = again
    return model


FEATURES = ["first", "second", "third", "insulting", "share", "mass", "empty"]


def _spelled(words: Words, value: np.ndarray, model: WordModel) -> None:
    """Gives a run of three or more single letters the value of the word they spell."""
    single = words.size == 1
    edge = np.diff(np.concatenate([[0], single.view(np.int8), [0]]))
    begin = np.cumsum(words.size) - words.size
    found, spelt = [], []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        while b - a >= 3:
            to = a + int(np.searchsorted(words.doc[a:b], words.doc[a], side="right"))
            if to - a >= 3:
                found.append(a)
                spelt.append(words.chars[begin[a] : begin[a] + to - a])
            a = to
    if found:
        value[found] = model.value_of(np.concatenate(spelt), np.array([len(s) for s in spelt]))


def sentence_values(raw: np.ndarray, offsets: np.ndarray, model: WordModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """(text, value) of each sentence; of each text the sum of its words' values between 0
    and 2 and the number of its words; whether the last sentence is open."""
    n = len(offsets) - 1
    words = words_of(raw, offsets)
    if not len(words.doc):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(n), np.zeros(n, np.int64), True
    value = np.where(words.size >= 2, model.value_of(words.chars, words.size), -9.0)
    _spelled(words, value, model)
    begins = np.ones(len(value), bool)
    begins[1:] = words.stop[:-1] | (words.doc[1:] != words.doc[:-1])
    at = np.flatnonzero(begins)
    return words.doc[at], np.maximum.reduceat(value, at), np.bincount(words.doc, np.clip(value, 0, 2), minlength=n), np.bincount(words.doc, minlength=n), not words.stop[-1]


def features(texts: pa.Array, model: WordModel, part: int = buffers.PART) -> np.ndarray:
    """One row of FEATURES for each text. Long texts are worked on in parts."""
    n = len(texts)
    raw, offsets = buffers.raw_of(texts)
    if n == 1 and len(raw) > part:
        bests, mass, words, is_open = [], np.zeros(1), np.zeros(1, np.int64), False
        for a, b in buffers.parts(raw, part):
            _, best, m, w, now_open = sentence_values(raw[a:b], np.array([0, b - a]), model)
            if not len(best):
                continue
            if is_open and bests:  # the first sentence began in the part before
                bests[-1][-1] = max(bests[-1][-1], best[0])
                best = best[1:]
                if not len(best):  # and goes on
                    mass, words, is_open = mass + m, words + w, now_open
                    continue
            bests.append(best)
            mass, words, is_open = mass + m, words + w, now_open
        best = np.concatenate(bests) if bests else np.zeros(0)
        owner = np.zeros(len(best), np.int64)
    else:
        owner, best, mass, words, _ = sentence_values(raw, offsets, model)
    out = np.zeros((n, len(FEATURES)))
    out[:, :3] = -1.0  # what is below the margin is clean, and so is a sentence that is not there
    order = np.lexsort((-best, owner))
    best, owner = best[order], owner[order]
    first = np.searchsorted(owner, np.arange(n))
    count = np.bincount(owner, minlength=n)
    for k in range(3):
        has = count > k
        out[has, k] = np.clip(best[first[has] + k], -1, 3)
    insulting = np.bincount(owner, best > 0, minlength=n)
    out[:, 3] = np.log1p(insulting)
    out[:, 4] = insulting / np.maximum(count, 1)
    out[:, 5] = mass / np.sqrt(np.maximum(words, 1))
    out[:, 6] = count == 0
    return out


_FEATURES_DDL = "doc_id long, row_key long, features array<double>"


def sentence_features(docs: DataFrame, model: WordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key (a hash of the text), features; one row for every input row, over
    whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers.release()
        for batch in batches:
            for a, b in buffers.slices(batch.column(2)):
                x = features(batch.column(2).slice(a, b - a), shared.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], names=["doc_id", "row_key", "features"])
        buffers.release()

    return picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), F.col("text").cast("string").alias("text")).mapInArrow(run, _FEATURES_DDL)


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1], -30, 30)
        return 1 / (1 + np.exp(-z))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(penalty + (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z, z.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn_from, max_labelled: int) -> DataFrame:
    """doc_id, <label> of at most max_labelled labelled documents (one label a document, the
    larger), the first by a hash of their identifier."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias(label)).where(learn_from(F.col("doc_id")))
    have = docs.select("doc_id").distinct()
    return known.join(have, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def score(docs: DataFrame, labels: DataFrame, learn_from=lambda doc_id: F.lit(True), max_labelled: int = MAX_LABELLED, by_row: bool = False) -> DataFrame:
    """doc_id, score (0 to 1) for every row of docs (doc_id, text; other columns have no
    influence); by_row adds row_key, the xxhash64 of the text.

    Trains on at most max_labelled documents of labels (doc_id, toxic) for which learn_from
    holds; of a labelled doc_id with several texts, the one of least hash. Empty and null
    texts get the score of a text without words; with no labels of one kind every score is
    the share of toxic labels, or 0 without any. Repeated rows get equal scores; an empty
    table gives an empty frame. Runs jobs: the training texts are read once more than the
    others.
    """
    keys = lambda c: [c] if by_row else []
    docs = picked(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = cut(labelled_sample(docs, labels, "toxic", learn_from, max_labelled))
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or toxic in (0, n):
        return docs.select("doc_id", *keys(F.xxhash64("text").alias("row_key")), F.lit(float(toxic) / n if n else 0.0).alias("score"))
    # At most max_labelled rows are broadcast and, with one text each, kept.
    one = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("r"))
    training = cut(one.select("r.text", "r.toxic"))
    model = train_words(training)
    found = cut(sentence_features(docs, model))
    rows = sentence_features(training.select(F.col("toxic").alias("doc_id"), "text"), model).select("features", F.col("doc_id").alias("toxic")).collect()
    final = fit_logistic(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(final.probabilities(x))], names=["doc_id", "row_key", "score"])

    return found.mapInArrow(run, "doc_id long, row_key long, score double").select("doc_id", *keys("row_key"), "score")
