"""Token ids of whole texts by a public byte-level BPE, with content-defined chunk reuse.

A rolling hash over the last ``WINDOW`` code points of a text proposes cuts, so that
equal passages of different documents are cut alike; a proposed cut moves on to the next change between letters, digits, white space
and the rest, where it is seldom bad. Each chunk is encoded by itself. Chunks met before in the worker
process are taken from its dictionary, of bounded size.

Then every join is tested by encoding again: the last piece of the left chunk and the first piece of the right one (pieces as the
pre-splitting makes them) are split and encoded together. They agree if the joined text has a piece end at the join and gives the ids of both
sides. The verdict on a pair of pieces is kept too. Where they do not agree, the text is mended: from the last settled piece on, pieces are
split off the whole text and encoded again, until one ends where a piece of the chunk that lies there ends; from there on that chunk's own ids
hold. That is exact for any pre-splitting without look-behind and with at most one character of look-ahead: a piece depends on the text from
its start to one character after its end, so all pieces of a chunk but its last stand in the whole text too, once its first does.

Each document stays one row in one task: no shuffle, no skew.

Defined results: null and empty texts give an empty list; special tokens in a text are ordinary text;
repeated rows each give a row; a text of any length is encoded whole; an empty frame gives an
empty one; lone surrogates cannot occur in Spark strings. Of other columns only the id is kept.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

WINDOW = 6  # code points of the rolling hash
MASK = 3  # a cut is proposed where the hash has these bits clear
MULTIPLIER = np.uint32(0x9E3779B1)
DICTIONARY = 400_000  # chunks, and verdicts on joins, kept by a worker; at the limit it starts anew
LONGEST = 400  # longer chunks are not kept
VOCABULARY = "byte_bpe_50k.tiktoken"
DEFAULT_DIR = "/opt/tokenizers"
#: How the byte-level vocabularies split a text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, DIGIT, SPACE = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point as the pre-splitting sees it."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            out[cp] = LETTER
        elif c == "N":
            out[cp] = DIGIT
    for cp in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[cp] = SPACE
    return out


@lru_cache(maxsize=4)
def load_encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(hashlib.sha1(f"{path}\0{pattern}".encode()).hexdigest(), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cuts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Chunk starts in texts that lie behind each other (``starts``: first position of each non-empty text)."""
    n = len(codes)
    kind = _classes()[codes]
    before, here = kind[:-1], kind[1:]
    likely = np.zeros(n, bool)
    likely[1:] = ((before == LETTER) & (here != LETTER)) | ((before == DIGIT) & (here != DIGIT)) | ((before != SPACE) & (here == SPACE))
    h = np.zeros(n, np.uint32)
    x = codes.astype(np.uint32) + np.uint32(1)
    for k in range(WINDOW):
        h *= MULTIPLIER
        h[k:] += x[: max(0, n - k)]
    h ^= h >> np.uint32(15)
    proposed = np.flatnonzero((h & np.uint32(MASK)) == 0) + 1
    places = np.flatnonzero(likely)
    at = np.searchsorted(places, proposed)
    moved = places[at[at < len(places)]]
    cut = np.zeros(n, bool)
    cut[moved] = True
    cut[starts] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes batches of texts, keeping the ids of chunks met before and the verdicts on joins."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.encoding = load_encoding(path, pattern)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[bytes, int, int]] = {}  # ids, numbers of the first and the last piece
        self.pieces: dict[str, int] = {}
        self.good: set[int] = set()  # joins of a last with a first piece that agree, by both numbers
        self.mended = 0  # texts with a join that did not agree

    def ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), np.int32).tobytes()

    def chunk(self, text: str) -> tuple[bytes, int, int]:
        split = self.pattern.findall(text)
        number = self.pieces.setdefault
        got = self.ids(text), number(split[0], len(self.pieces)), number(split[-1], len(self.pieces))
        if len(text) <= LONGEST:
            self.known[text] = got
        return got

    def agree(self, left: str, right: str) -> bool:
        """Whether two pieces stand beside each other in the joined text as they do apart."""
        whole = left + right
        return self.pattern.match(whole).end() == len(left) and self.ids(whole) == self.ids(left) + self.ids(right)

    def _bad(self, entries: list[tuple[bytes, int, int]], first: np.ndarray) -> np.ndarray:
        """Chunks whose join with the one before does not agree; ``first`` are the first ones of a text."""
        n = len(entries)
        head = np.fromiter((e[1] for e in entries), np.int64, n)
        tail = np.fromiter((e[2] for e in entries), np.int64, n)
        joined = np.ones(n, bool)
        joined[first] = False
        at = np.flatnonzero(joined)
        keys = tail[at - 1] << 32 | head[at]
        good, bad = self.good, []
        pieces: list[str] = []
        for k in np.unique(keys).tolist():
            if k not in good:
                pieces = pieces or list(self.pieces)
                if self.agree(pieces[k >> 32], pieces[k & 0xFFFFFFFF]):
                    good.add(k)
                else:
                    bad.append(k)
        return at[np.isin(keys, bad)] if bad else at[:0]

    def mend(self, text: str, starts: list[int]) -> bytes:
        """The ids of a text with chunks at ``starts``, joins repaired."""
        self.mended += 1
        out: list[bytes] = []
        at = 0  # all before is settled, and a piece begins here
        for a, z in zip(starts, [*starts[1:], len(text)]):
            if at >= z:  # a piece of the whole text covered the chunk
                continue
            ends = {a, *(m.end() + a for m in self.pattern.finditer(text[a:z]))}
            while at not in ends and at < z:  # until the whole text and the chunk agree
                m = self.pattern.match(text, at)
                out.append(self.ids(m.group()))
                at = m.end()
            if at >= z:
                continue
            if z == len(text):
                out.append(self.ids(text[at:z]))
                at = z
                continue
            # the chunk's own pieces, but for the last, which may go on
            last = max((e for e in ends if e < z), default=a)
            if at < last:
                for m in self.pattern.finditer(text[at:z]):
                    if at >= last:
                        break
                    out.append(self.ids(m.group()))
                    at += m.end() - m.start()
            m = self.pattern.match(text, at)
            out.append(self.ids(m.group()))
            at = m.end()
        return b"".join(out)

    def batch(self, texts: list[str | None], cut=cuts) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        whole = "".join(t for t in texts if t)
        if not whole:
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t or "") for t in texts])
        bounds = cut(codes, np.r_[0, ends[ends < len(codes)]])
        edges = np.r_[bounds, len(codes)].tolist()
        known, chunk = self.known.get, self.chunk
        if len(self.known) >= DICTIONARY or len(self.good) >= DICTIONARY or len(self.pieces) >= DICTIONARY:
            for d in (self.known, self.pieces, self.good):  # the numbers of pieces begin anew
                d.clear()
        entries = [known(c) or chunk(c) for c in map(whole.__getitem__, map(slice, edges[:-1], edges[1:]))]
        parts = [e[0] for e in entries]
        first = np.searchsorted(bounds, np.r_[0, ends])  # of each text its first chunk, and the end
        bad = self._bad(entries, first[first < len(parts)])
        for i in np.unique(np.searchsorted(ends, bounds[bad], "right")).tolist():
            a, z = int(first[i]), int(first[i + 1])
            parts[a] = self.mend(texts[i], [e - edges[a] for e in edges[a:z]])
            parts[a + 1 : z] = [b""] * (z - a - 1)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        total = np.r_[0, np.cumsum(sizes)]
        offsets = np.r_[0, total[np.searchsorted(edges, ends)]]
        return offsets, np.frombuffer(b"".join(parts), np.int32)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizers: str = DEFAULT_DIR, name: str = VOCABULARY, pattern: str = PATTERN, characters: int = 4_000_000) -> DataFrame:
    """(doc_id, ids) for each row. ``tokenizers`` is the folder of the vocabulary files (``*.tiktoken``) on every executor; about ``characters`` are handled at once."""
    path = f"{tokenizers.rstrip('/')}/{name}"
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            a = 0
            while a < len(texts):
                z, n = a, 0
                while z < len(texts) and (z == a or n < characters):
                    n += len(texts[z] or "")
                    z += 1
                offsets, ids = enc.batch(texts[a:z])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), lists], names=[doc_id, "ids"])
                a = z

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>")
