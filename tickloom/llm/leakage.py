"""Passages of evaluation items inside a corpus.

Units are words (runs of letters and digits) or, for items of ``char_langs``, single
letters and digits; letter case, Unicode composition, punctuation, white space and
line breaks count for nothing. Every window of ``words`` (``chars``) units of an item is
a SimHash of its shingles of two units; so is every window of a document that could pass the verification at
all, which needs enough shingles that some item has. The 64 bits are cut into
``radius + 1`` blocks: two fingerprints within the radius agree in one of them, so
looking up each block finds all of them. Candidates are then verified by the exact
similarity of their weighted shingles (shared over all, with multiplicity); at similarity 1
the units must also be the same in the same order.

The items are a stated query set: up to ``block_items`` are collected, indexed and broadcast (some 7 KB an item of a hundred
words), and the documents are read once; more are taken in blocks, and the documents read once a block. A document
is one row in one task, whatever its length; documents are not shuffled.

Defined results: one row per (document, item), however often it is found and however often a document or item
is repeated; null and empty texts and passages find nothing, nor do passages
shorter than a window; items of null language go by words; items and documents
with a null id are left out; empty tables give an empty result; of extra columns none is read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+")
BITS = 64


def normalize(text: str) -> str:
    t = text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    t = t.casefold()
    return t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)


def units(text: str, chars: bool) -> list[str]:
    found = WORDS.findall(normalize(text))
    return list("".join(found)) if chars else found


def shingle_hash(a: str, b: str) -> int:
    return xxhash.xxh64_intdigest(f"{a}\0{b}")


def _votes(hashes: np.ndarray) -> np.ndarray:
    """(..., 64) of +1 and -1."""
    bits = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(*hashes.shape, 8), axis=-1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def simhash(votes: np.ndarray) -> np.ndarray:
    """Fingerprints of (windows, shingles, 64) votes."""
    return np.packbits(votes.sum(1) > 0, axis=1, bitorder="little").view("<u8").ravel()


class Index:
    """Fingerprints of all windows of a block of items, in one kind of unit."""

    def __init__(self, items: Iterable[tuple[object, str]], size: int, chars: bool, radius: int, similarity: float):
        self.size, self.chars, self.radius, self.similarity = size, chars, radius, similarity
        self.vocabulary: dict[str, int] = {}  # unit -> 1, 2, ...
        rows, owners = [], []
        self.items: list[object] = []
        for item, passage in items:
            ids = np.array([self.vocabulary.setdefault(u, len(self.vocabulary) + 1) for u in units(passage, chars)], np.int32)
            if len(ids) >= size:
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, size).ravel())
                owners += [len(self.items)] * (len(ids) - size + 1)
                self.items.append(item)
        self.rows = np.concatenate(rows).reshape(-1, size) if rows else np.zeros((0, size), np.int32)
        self.owners = np.array(owners, np.int32)
        self.base = len(self.vocabulary) + 1
        pairs = self.rows[:, :-1].astype(np.int64) * self.base + self.rows[:, 1:]
        self.pairs = np.unique(pairs)
        names = [""] + list(self.vocabulary)
        self.hashes = np.array([shingle_hash(names[p // self.base], names[p % self.base]) for p in self.pairs.tolist()], np.uint64)
        self.prints = np.concatenate([simhash(_votes(self.hashes[np.searchsorted(self.pairs, pairs[a : a + 4096])])) for a in range(0, len(pairs), 4096)]) if len(pairs) else np.zeros(0, np.uint64)
        edges = np.linspace(0, BITS, radius + 2).astype(int)
        self.blocks = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            v = self._block(self.prints, lo, hi)
            order = np.argsort(v, kind="stable")
            # 16 bits a block at radius 3: the values of a block take as little room as their width allows
            self.blocks.append((lo, hi, v[order].astype(np.uint16 if hi - lo <= 16 else np.uint64), order.astype(np.int32)))
        #: of a window's shingles, so many must be known for the similarity to be reached
        shingles = size - 1
        self.enough = int(np.ceil(2 * shingles * similarity / (1 + similarity) - 1e-9))
        if chars:
            self.points = np.zeros(0x110000, np.int64)
            for u, i in self.vocabulary.items():
                self.points[ord(u)] = i

    @staticmethod
    def _block(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (prints >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)

    def find(self, texts: list[str]) -> list[tuple[int, object]]:
        """(position of the text, item) of all hits in normalised texts."""
        if not len(self.rows):
            return []
        hits: set[tuple[int, object]] = set()
        ids, unit_of, doc = self._read(texts)
        if len(ids) < self.size:
            return []
        known = (ids[:-1] > 0) & (ids[1:] > 0) & (doc[:-1] == doc[1:])
        at = np.flatnonzero(known)
        pair = ids[at] * self.base + ids[at + 1]
        slot = np.searchsorted(self.pairs, pair).clip(max=len(self.pairs) - 1)
        real = self.pairs[slot] == pair
        place = np.full(len(ids), -1)
        place[at[real]] = slot[real]
        count = np.r_[0, np.cumsum(place[:-1] >= 0)]
        starts = np.arange(len(ids) - self.size + 1)
        starts = starts[(count[starts + self.size - 1] - count[starts] >= self.enough) & (doc[starts] == doc[starts + self.size - 1])]
        for a in range(0, len(starts), 4096):
            s = starts[a : a + 4096]
            grid = place[s[:, None] + np.arange(self.size - 1)]
            hashes = self.hashes[grid]
            for i, j in zip(*np.nonzero(grid < 0)):
                hashes[i, j] = shingle_hash(unit_of(s[i] + j), unit_of(s[i] + j + 1))
            prints = simhash(_votes(hashes))
            for w, c in self._candidates(prints):
                if self._verified(ids[s[w] : s[w] + self.size], c, grid[w]):
                    hits.add((int(doc[s[w]]), self.items[self.owners[c]]))
        return list(hits)

    def _candidates(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item window) within the radius; each once."""
        for n, (lo, hi, values, order) in enumerate(self.blocks):
            v = self._block(prints, lo, hi)
            v = v.astype(values.dtype)
            a, z = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            w = np.repeat(np.arange(len(v)), z - a)
            c = order[np.arange(len(w)) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + np.repeat(a, z - a)]
            x = prints[w] ^ self.prints[c]
            near = np.bitwise_count(x) <= self.radius
            for m, (lo2, hi2, _, _) in enumerate(self.blocks[:n]):
                near &= self._block(x, lo2, hi2) != 0  # else an earlier block has given it
            yield from zip(w[near].tolist(), c[near].tolist())

    def _verified(self, window: np.ndarray, c: int, shingles: np.ndarray) -> bool:
        if self.similarity >= 1:
            return bool((window == self.rows[c]).all())
        theirs = np.searchsorted(self.pairs, self.rows[c, :-1].astype(np.int64) * self.base + self.rows[c, 1:])
        shared = sum((Counter(shingles[shingles >= 0].tolist()) & Counter(theirs.tolist())).values())
        return shared / (2 * (self.size - 1) - shared) >= self.similarity

    def _read(self, texts: list[str]):
        """(ids, unit by position, number of text) of all units; id 0 is no unit of an item."""
        if not self.chars:
            get = self.vocabulary.get
            found = [WORDS.findall(t) for t in texts]
            flat = [w for ws in found for w in ws]
            ids = np.fromiter((get(w, 0) for w in flat), np.int64, len(flat))
            return ids, flat.__getitem__, np.repeat(np.arange(len(texts)), [len(ws) for ws in found])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        ids = self.points[points]
        # the letters and digits that no item has still part the others; only places near a known one matter
        near = ids > 0
        if not near.any():
            return np.zeros(0, np.int64), None, np.zeros(0, np.int64)
        keep = near | _alnum()[points]
        points, ids, doc = points[keep], ids[keep], doc[keep]
        return ids, (lambda i: chr(points[i])), doc


_TABLE: list[np.ndarray] = []


def _alnum() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", lang: str = "lang", words: int = 8, chars: int = 20, char_langs: tuple[str, ...] = ("zh", "ja"), radius: int = 3, similarity: float = 1.0, block_items: int = 20_000, characters: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id) of all documents that hold a window of an item's passage."""
    q = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_id).alias("i"), F.col(passage).alias("p"), F.coalesce(F.col(lang).isin(*char_langs), F.lit(False)).alias("c"))
    n = q.count()
    blocks = 2 * -(-n // block_items) if n > block_items else 1  # twice as many, as hashed blocks are not of one size
    spark = docs.sparkSession
    base = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(doc_id, text)
    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, `{item_id}` {items.schema[item_id].dataType.simpleString()}"
    parts = []
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()
        index = spark.sparkContext.broadcast([
            Index([(r.i, r.p) for r in rows if not r.c], words, False, radius, similarity),
            Index([(r.i, r.p) for r in rows if r.c], chars, True, radius, similarity),
        ])
        parts.append(base.mapInArrow(_scanner(index, doc_id, item_id, characters), schema))
    return reduce(DataFrame.union, parts).distinct()


def _scanner(index, doc_id: str, item_id: str, characters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            out: list[tuple[int, object]] = []
            a = 0
            while a < len(texts):
                z, n = a, 0
                while z < len(texts) and (z == a or n < characters):
                    n += len(texts[z])
                    z += 1
                part = [normalize(t) for t in texts[a:z]]
                out += [(a + d, i) for ix in index.value for d, i in ix.find(part)]
                a = z
            ids = b.column(0)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([d for d, _ in out], pa.int64())), pa.array([i for _, i in out])] if out else [ids.slice(0, 0), pa.array([], pa.int64())], names=[doc_id, item_id])

    return run
