"""Token ids of whole texts by a public tokenizer file, with a bounded cache of pieces.

The tokenizers library spends most of its time on words it has just seen. Where the
file's own rules make the text between two blanks independent of its surroundings, the
texts of a batch are cut there into pieces, Arrow finds the distinct ones, the library
encodes each new one once, and numpy joins the ids from the cache. A text with any other
use of white space or with a special token's string, and any tokenizer whose rules are not
known to allow this, is encoded whole. A very long text is first cut at blanks between two
ASCII letters, where both tokenizers always end a piece.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from . import buffers

#: Most pieces that the cache of one worker holds. Beyond that only the third that came
#: first stays, as frequent pieces come early.
CACHE_PIECES = 700_000
#: New pieces that are encoded in one call.
TOGETHER = 1000
#: Bytes of text that are cut and joined at a time; longer texts are cut into parts.
GROUP_BYTES = 5_000_000


#: Lower-cases A-Z and makes every ASCII blank a space.
_FOLD = buffers.LOWER.copy()
_FOLD[0x09:0x0E] = 0x20


def _style(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normalizer, pre, post = spec.get("normalizer"), spec.get("pre_tokenizer") or {}, spec.get("post_processor")
    if post is None and normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "leading"  # a blank belongs to the word after it
    if post is None and normalizer and [n["type"] for n in normalizer.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        split = (pre.get("pretokenizers") or [{}])[0]
        if split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and "\\s" in split["pattern"].get("Regex", ""):
            return "dropped"  # white space only separates
    return "whole"


#: Letters of plain words: ASCII, and those that UTF-8 writes as 0xC3 and one more byte.
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_ACCENTED = np.zeros(256, bool)
_ACCENTED[0x80:0xC0] = True
_ACCENTED[[0x97, 0xB7]] = False


class Encoder:
    """Ids of texts. The ids of known pieces stand one after the other in ``store``; piece k has
    length[k] of them from begin[k] on, or a length of -1 if it is not independent of what
    stands around it."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES, special_as_text: bool = False) -> None:
        """special_as_text: the strings of special tokens in a text are ordinary text; else
        they give the special tokens' ids, as the library does by default."""
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = () if special_as_text else self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.lower().encode() for t in added]
        self.style = _style(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.most = cache_pieces
        self.cache: dict[bytes, int] = {}
        self.begin, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.store, self.used = np.zeros(4096, self.dtype), 0
        # What stands between new pieces that are encoded together; it gives one id that no
        # piece without that character can give.
        self.between = {"leading": "\n", "dropped": " 0 "}.get(self.style, "")
        self.mark = self._whole([self.between.strip(" ")])[0] if self.between else np.empty(0, self.dtype)
        self.stops = {ord(c): self._whole([c])[0][0] for c in ".,"} if self.between else {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, pieces: list[bytes], ids: np.ndarray, length: np.ndarray) -> None:
        n, k = len(self.cache), len(pieces)
        while n + k > len(self.begin):
            self.begin, self.length = np.concatenate([self.begin, self.begin]), np.concatenate([self.length, self.length])
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, self.store])
        self.store[self.used : self.used + len(ids)] = ids
        self.length[n : n + k] = length
        real = np.maximum(length, 0)
        self.begin[n : n + k] = self.used + np.cumsum(real) - real
        self.used += len(ids)
        self.cache.update(zip(pieces, range(n, n + k)))

    def _together(self, pieces: list[bytes]) -> None:
        """Adds pieces that do not hold the separator's character."""
        for i in range(0, len(pieces), TOGETHER):
            some = pieces[i : i + TOGETHER]
            ids = self._whole([self.between.encode().join(some).decode("utf-8", "replace")])[0]
            marks = ids == self.mark[0]
            edges = np.concatenate([[-1], np.flatnonzero(marks), [len(ids)]])
            self._add(some, ids[~marks], np.diff(edges) - 1)

    def _trim(self, coming: int) -> bool:
        """Makes room if the cache is too full: the third that came first stays."""
        if not self.cache or len(self.cache) + coming <= self.most:
            return False
        keep = self.most // 3
        for p in list(self.cache)[keep:]:
            del self.cache[p]
        keep = len(self.cache)
        self.used = int(self.begin[keep - 1] + max(self.length[keep - 1], 0)) if keep else 0
        return True

    def _learn(self, new: pa.Array) -> None:
        """Adds all of new (distinct pieces that are not in the cache)."""
        pieces = new.to_pylist()
        raw, offsets = buffers.raw_of(new)
        # Plain words: an optional blank, letters, an optional stop.
        plain = _LETTER[raw]
        after = np.zeros(len(raw), bool)
        after[1:] = (raw[:-1] == 0xC3) & _ACCENTED[raw[1:]]
        plain |= after
        plain[:-1] |= after[1:]
        letters = np.concatenate([[0], np.cumsum(plain)])
        letters = letters[offsets[1:]] - letters[offsets[:-1]]
        first, last = raw[offsets[:-1]], raw[offsets[1:] - 1]
        others = (first == 0x20).astype(np.int64) + ((last == 0x2E) | (last == 0x2C))
        simple = (letters > 0) & (letters + others == np.diff(offsets))
        stopped = simple & ((last == 0x2E) | (last == 0x2C))
        mark = self.between.strip()
        together, alone, odd = [pieces[i] for i in np.flatnonzero(simple & ~stopped).tolist()], [], []
        for i in np.flatnonzero(~simple).tolist():
            p = pieces[i]
            text = p.decode("utf-8", "replace")
            bare = text[1:] if text[:1] == " " else text
            if b"<" in p and any(t in p.lower() for t in self.special) or self.style == "leading" and text != "\n" and (not bare or bare[0].isspace() or bare[-1].isspace()):
                odd.append(p)
            elif bare.isalpha() or bare.isprintable() and not (mark and mark in bare) and " " not in bare:
                together.append(p)
            else:
                alone.append(p)
        self._together(together)
        ids = self._whole([p.decode("utf-8", "replace") for p in alone])
        self._add(alone, np.concatenate(ids) if ids else self.store[:0], np.array([len(x) for x in ids], np.int32))
        self._add(odd, self.store[:0], np.full(len(odd), -1, np.int32))
        if stopped.any():
            self._stopped([pieces[i] for i in np.flatnonzero(stopped).tolist()])

    def _stopped(self, pieces: list[bytes]) -> None:
        """Adds plain words with a stop, which after a letter is a token of its own: they share
        the ids of the word without it."""
        stems = [p[:-1] for p in pieces]
        self._together([p for p in dict.fromkeys(stems) if p not in self.cache])
        at = self._places(stems)
        length = self.length[at].astype(np.int64) + 1
        ends = np.cumsum(length)
        take = np.repeat(self.begin[at] - (ends - length), length) + np.arange(int(ends[-1]))
        take[ends - 1] = 0
        ids = self.store[take]
        ids[ends - 1] = np.array([self.stops[p[-1]] for p in pieces], self.dtype)
        self._add(pieces, ids, length.astype(np.int32))

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        get = self.cache.get
        return np.array([get(p, -1) for p in pieces], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, without special tokens, and where each text's ids begin
        (with the end of the last). Null texts are empty."""
        if self.style == "whole" or not len(texts):
            return _joined(self._whole([t or "" for t in texts.to_pylist()]), self.dtype)
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.empty(0, np.uint8)
        if self.style == "dropped":  # these bytes' case and kind of blank make no difference
            raw = _FOLD[raw]
        offsets = offsets - offsets[0]
        # Cut before each blank; a line feed that means a token is a piece of its own.
        starts = np.zeros(len(raw) + 1, bool)
        if self.style == "leading":
            line = raw == 0x0A
            starts[:-1] = line | (raw == 0x20)
            starts[1:] |= line
        else:
            starts[:-1] = raw == 0x20
        starts[offsets] = True
        cuts = np.flatnonzero(starts)
        if len(cuts) < 2:
            return np.empty(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        known = pieces.dictionary.to_pylist()
        at = self._places(known)
        if (at < 0).any():
            if self._trim(int((at < 0).sum())):
                at = self._places(known)
            self._learn(pieces.dictionary.filter(pa.array(at < 0)))
            at[at < 0] = self._places([known[i] for i in np.flatnonzero(at < 0).tolist()])
        which = at[pieces.indices.to_numpy()]
        each = self.length[which]
        odd = each < 0
        each = np.maximum(each, 0).astype(np.int64)
        ends = np.cumsum(each)
        take = np.repeat(self.begin[which] - (ends - each), each)
        take += np.arange(len(take))
        ids = self.store[take]
        place = np.searchsorted(cuts, offsets)
        bounds = np.concatenate([[0], ends])[place]
        if self.style == "leading":
            feed = raw[cuts[:-1]] == 0x0A
            odd[1:] |= feed[1:] & feed[:-1] & ~starts_of(offsets, cuts)[1:]
        if odd.any():
            docs = np.unique(np.searchsorted(offsets, cuts[:-1][odd], side="right") - 1)
            parts = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
            for d, whole in zip(docs.tolist(), self._whole([texts[d].as_py() for d in docs.tolist()])):
                parts[d] = whole
            return _joined(parts, self.dtype)
        return ids, bounds


def starts_of(offsets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Which pieces begin a text."""
    return np.isin(cuts[:-1], offsets)


def _joined(parts: list[np.ndarray], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, dtype)), bounds


_encoders: dict[tuple[str, bool], Encoder] = buffers.kept({})


def release() -> None:
    """Gives back what tasks of other operators keep in this worker; encoders stay."""
    buffers.release(_encoders)


def encoder(path: str, special_as_text: bool = False, cache_pieces: int = CACHE_PIECES) -> Encoder:
    """One encoder for each file and Python worker, kept from task to task."""
    key = path, special_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(path, cache_pieces, special_as_text)
    return _encoders[key]


def _long(enc: Encoder, text: pa.Scalar, size: int) -> np.ndarray:
    """The ids of a text longer than size bytes, encoded part by part."""
    raw, _ = buffers.raw_of(pa.array([text], text.type))
    parts, at = [], 0
    while at < len(raw):
        to = at + size if enc.style != "whole" else len(raw)
        while to < len(raw):  # the first blank between two letters, sought a part at a time
            near = raw[to - 1 : to + size + 1]
            found = np.flatnonzero((near[1:-1] == 0x20) & _LETTER[near[:-2]] & _LETTER[near[2:]])
            if len(found):
                to += int(found[0])
                break
            to += size
        parts.append(enc.encode(pa.array([raw[at:to].tobytes()], pa.binary()).cast(pa.large_binary()).cast(pa.large_string()))[0])
        at = to
    return np.concatenate(parts)


def encoded(path: str, texts: pa.Array, size: int = GROUP_BYTES, special_as_text: bool = False, cache_pieces: int = CACHE_PIECES):
    """(row, ids) for each text, working on about so many bytes of text at a time."""
    enc = encoder(path, special_as_text, cache_pieces)
    sizes = np.cumsum([0, *(pc.fill_null(pc.binary_length(texts), 0).to_pylist())])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + size, side="right")) - 1)
        if sizes[to] - sizes[at] > size:  # one long text
            yield at, _long(enc, texts[at], size)
            at = to
            continue
        ids, bounds = enc.encode(texts.slice(at, to - at))
        for i in range(to - at):
            yield at + i, ids[bounds[i] : bounds[i + 1]]
        at = to
