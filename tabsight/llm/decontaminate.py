"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by their number of word shingles into classes up to
8, 16, 32, ... A document is seen once per class, as windows of twice the class
size that advance by the class size, so that an item's passage lies whole in
one window and the sizes of the two sets stay within a factor of four: the
containment threshold then bounds their Jaccard similarity from below, and
``PERMUTATIONS`` single-value bands miss a window with a chance near 1e-6.
Minima are taken once per smallest block and merged upwards. Every candidate
(document, item) is verified by the exact share of the item's distinct shingles
that occur anywhere in the document, compared as words.

Items of one to ``FEW`` shingles are looked up instead: by their whole word
sequence where they are shorter than a shingle, else by each of their shingles,
so that none is missed.

Items are a query set: they are read in blocks of bounded size (``BLOCK_BYTES``),
each against all documents and written before the next one is read. Words are lower-cased (A-Z). A text of one to four
words has its whole word sequence as its only shingle; null, empty and wordless
texts have none and match nothing. Repeated documents and items are reported
one by one. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import LOWER, free_name, shingle_hashes, span_hashes, stored, text_chunks, word_spans

PERMUTATIONS, BLOCK_BYTES, LEAST_CLASS = 64, 16 << 20, 3
MULTIPLIERS = np.random.default_rng(77).integers(0, 2**31, PERMUTATIONS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
#: Items of at most so many distinct shingles are found by looking them up.
FEW = 4
SCHEMA = "doc_id long, key long, item_id long, n_item_shingles long, n_shared long"


def shingles(words: list[bytes], k: int) -> set[bytes]:
    if len(words) < k:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    """The hash of each shingle of at least ``k`` words, as document text gets it."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, text = word_spans(data, np.array([0, len(data)]))
    return shingle_hashes(span_hashes(data, starts, ends), text, k)[0]


class Items:
    """A block of test items, with the band values of each size class."""

    def __init__(self, rows: list[tuple[int, str | None]], k: int):
        self.k, self.ids, self.sets, self.hashes = k, [], [], []
        self.short: dict[bytes, list[int]] = defaultdict(list)
        few: list[int] = []
        classes: dict[int, list[int]] = defaultdict(list)
        for item_id, text in rows:
            words = (text or "").encode().translate(LOWER).split()
            if not words:
                continue
            at = len(self.ids)
            self.ids.append(item_id)
            self.sets.append(shingles(words, k))
            self.hashes.append(np.unique(_hashes(words, k)))
            if len(words) < k:
                self.short[b" ".join(words)].append(at)
            elif len(self.hashes[at]) <= FEW:
                few.append(at)
            else:
                classes[max(LEAST_CLASS, int(np.ceil(np.log2(len(words) - k + 1))))].append(at)
        owned = np.concatenate([np.empty(0, np.uint64), *[self.hashes[i] for i in few]])
        order = np.argsort(owned, kind="stable")
        self.few, self.few_items = owned[order], np.repeat(np.array(few, np.int64), [len(self.hashes[i]) for i in few])[order]
        self.classes = {c: _Bands(np.array(at), [self.hashes[i] for i in at]) for c, at in sorted(classes.items())}


class _Bands:
    def __init__(self, items: np.ndarray, hashes: list[np.ndarray]):
        minima = np.array([[((h >> np.uint64(32)).astype(np.uint32) * m).min() for m in MULTIPLIERS] for h in hashes], np.uint64)
        keys = (np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(32) | minima).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], np.repeat(items, PERMUTATIONS)[order]
        self.bits = int(np.clip(np.ceil(np.log2(len(keys) * 64)), 16, 24))
        self.seen = np.zeros(1 << self.bits, bool)
        for p in range(PERMUTATIONS):
            self.seen[self.slot(minima[:, p].astype(np.uint32), p)] = True

    def slot(self, values: np.ndarray, p: int) -> np.ndarray:
        return (values * np.uint32(0x9E3779B1) + np.uint32(p * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - self.bits)

    def found(self, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that agree in a band."""
        windows, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for p in range(PERMUTATIONS):
            at = np.flatnonzero(self.seen[self.slot(minima[p], p)])
            key = np.uint64(p << 32) | minima[p][at].astype(np.uint64)
            a, b = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
            n = b - a
            windows.append(np.repeat(at, n))
            items.append(self.items[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.concatenate(windows), np.concatenate(items)


def candidates(items: Items, hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Distinct (text, item) pairs with a common band value in some window.
    ``text``: text number of each shingle, rising."""
    a, b = np.searchsorted(items.few, hashes), np.searchsorted(items.few, hashes, "right")
    hit = np.flatnonzero(b > a)
    looked_up = [(text[h], items.few_items[i]) for h in hit.tolist() for i in range(a[h], b[h])]
    looked_up = np.unique(np.array(looked_up, np.int64).reshape(-1, 2), axis=0)
    if not len(hashes) or not items.classes:
        return looked_up
    level = min(items.classes)
    first = np.searchsorted(text, text, "left")
    starts = np.flatnonzero((np.arange(len(text)) - first) % (1 << level) == 0)
    block_text = text[starts]
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    minima = np.stack([np.minimum.reduceat(low * m, starts) for m in MULTIPLIERS])
    out = [looked_up]
    while True:
        if level in items.classes:
            joined = minima.copy()
            near = np.flatnonzero(block_text[1:] == block_text[:-1])
            joined[:, near] = np.minimum(minima[:, near], minima[:, near + 1])
            window, item = items.classes[level].found(joined)
            out.append(np.stack([block_text[window], item], 1))
        if level >= max(items.classes):
            return np.unique(np.concatenate(out), axis=0)
        first = np.searchsorted(block_text, block_text, "left")
        pairs = np.flatnonzero((np.arange(len(block_text)) - first) % 2 == 0)
        minima, block_text, level = np.minimum.reduceat(minima, pairs, axis=1), block_text[pairs], level + 1


def _search(docs: DataFrame, items: Items, per_cent: int) -> DataFrame:
    k = items.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in text_chunks(batch, "text"):
                low = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
                starts, ends, text = word_spans(low, offsets)
                hashes, at = shingle_hashes(span_hashes(low, starts, ends), text, k)
                owner = text[at]
                rows = []
                for t, item in candidates(items, hashes, owner).tolist():
                    a, b = np.searchsorted(owner, [t, t + 1])
                    hit = at[a:b][np.isin(hashes[a:b], items.hashes[item])]
                    shared = {b" ".join(low[starts[h] : ends[h + k - 1]].tobytes().split()) for h in hit.tolist()} & items.sets[item]
                    if 100 * len(shared) >= per_cent * len(items.sets[item]):
                        rows.append((t, item, len(shared)))
                if items.short:
                    n = np.bincount(text, minlength=len(offsets) - 1)
                    for t in np.flatnonzero((n > 0) & (n < k)).tolist():
                        words = b" ".join(low[offsets[t] : offsets[t + 1]].tobytes().split())
                        rows += [(t, item, 1) for item in items.short.get(words, ())]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(pa.array([i + t for t, _, _ in rows])) for c in ("doc_id", "key")), pa.array([items.ids[x] for _, x, _ in rows], pa.int64()), pa.array([len(items.sets[x]) for _, x, _ in rows], pa.int64()), pa.array([s for _, _, s in rows], pa.int64())],
                        ["doc_id", "key", "item_id", "n_item_shingles", "n_shared"],
                    )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(run, SCHEMA)


def _found(docs: DataFrame, benchmark: DataFrame, k: int, per_cent: int, block_bytes: int) -> DataFrame:
    """What :func:`contained` returns, with a hash ``key`` of the document's text.
    One block of items is on the driver and in the tasks at a time: where there are
    several, each block's rows are written before the next block is read."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    parts = []
    for b in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        part = _search(docs, Items([tuple(r) for r in block.collect()], k), per_cent)
        parts.append(part if n == 1 else stored(part, "contained"))
    return reduce(DataFrame.unionByName, parts).withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


def contained(docs: DataFrame, benchmark: DataFrame, k: int = 5, per_cent: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, n_item_shingles, n_shared, containment`` of each test
    item that lies in a document to at least ``per_cent`` of its shingles."""
    return _found(docs, benchmark, k, per_cent, block_bytes).drop("key")


def without_items(docs: DataFrame, benchmark: DataFrame, k: int = 5, per_cent: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no test item. A row goes by its id and text hash
    together: another text under the same (or a null) id stays."""
    name = free_name("_found", docs)
    found = _found(docs, benchmark, k, per_cent, block_bytes).select(F.struct("doc_id", "key").alias(name)).distinct()
    rows = docs.withColumn(name, F.struct(F.col("doc_id"), F.xxhash64("text").alias("key")))
    return rows.join(stored(found, "contaminated"), name, "left_anti").select(*docs.columns)
