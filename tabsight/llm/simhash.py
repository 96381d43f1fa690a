"""SimHash near-duplicates by vantage-point trees.

Fingerprints are majority bits of the XXH64 values of a text's word shingles.
Equal fingerprints are one point. A vantage-point tree, fitted on a sample that
grows with the shards, cuts the points into shards of about ``SHARD`` (more where
that would take over ``SHARDS`` of them); each point lives in one shard and asks
every shard whose region lies within the allowed distance (triangle bounds). Inside a shard a tree of the same kind prunes the search down to small
leaves, which are compared in full, so every pair within the distance is found.
A shard returns only a spanning forest of its links.

Null and wordless texts have fingerprint zero and link like any other. Repeated
rows are one point. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import LOWER, free_name, stored
from tabsight.llm.components import components

#: Points per shard aimed at, most shards, points that the split tree is fitted on for
#: each shard, leaf size. The sample is at most about SHARDS * PER_SHARD points (8 MB).
SHARD, SHARDS, PER_SHARD, LEAF = 20_000, 1 << 16, 16, 48
#: Points routed at once: a large tree is walked once for many.
ROUTED = 1 << 17


def fingerprint(text: str | None, k: int = 3) -> int:
    """64 bits, each set if over half of the shingles' hashes have it."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        ends = (starts + sizes)[k - 1 :].tolist()
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends)], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, fp, a hash ``key`` of the text, and the row's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), k) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("row"), pa.array(fp.view(np.int64))], ["doc_id", "key", "row", "fp"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "doc_id long, key long, row long, fp long")


# ---------------------------------------------------------------- vantage-point trees


def vantage(points: np.ndarray, reach: int, tries: int = 12) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that split ``points`` most usefully: at least
    a quarter on either side and the fewest points within ``reach`` of the
    border. None if no candidate parts them."""
    best = None
    for p in points[np.linspace(0, len(points) - 1, tries).astype(np.int64)]:
        seen = np.bincount(np.bitwise_count(points ^ p), minlength=65)
        inside = np.cumsum(seen)
        for r in range(64):
            if len(points) <= 4 * inside[r] <= 3 * len(points):
                border = int(inside[min(r + reach, 64)] - (inside[r - reach] if r >= reach else 0))
                if best is None or border < best[0]:
                    best = (border, p, r)
    return best and best[1:]


def split_tree(sample: np.ndarray, full: int, reach: int) -> list[tuple[int, int, int, int]]:
    """Nodes ``(vantage, radius, inner, outer)``; a child below 0 is shard ``-child - 1``.
    A part of the sample of more than ``full`` points (at least 8) is split again."""
    nodes: list[tuple[int, int, int, int]] = []
    shards = 0

    def grow(points: np.ndarray) -> int:
        nonlocal shards
        cut = vantage(points, reach) if len(points) > max(full, 8) else None
        if cut is None:
            shards += 1
            return -shards
        near = np.bitwise_count(points ^ cut[0]) <= cut[1]
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        nodes[at] = (int(cut[0]), int(cut[1]), grow(points[near]), grow(points[~near]))
        return at

    grow(sample)
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]], reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(index, shard, home)`` of every shard that a point must ask."""
    index, shard, home = [], [], []
    todo = [(0 if nodes else -1, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, at, own = todo.pop()
        if not len(at):
            continue
        if node < 0:
            index.append(at), shard.append(np.full(len(at), -node - 1)), home.append(own)
            continue
        p, r, inner, outer = nodes[node]
        d = np.bitwise_count(points[at] ^ np.uint64(p)).astype(np.int64)
        a, b = d - reach <= r, d + reach > r
        todo.append((inner, at[a], own[a] & (d[a] <= r)))
        todo.append((outer, at[b], own[b] & (d[b] > r)))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *index]), np.concatenate([none, *shard]), np.concatenate([none.astype(bool), *home])


class Forest:
    """Union-find on arrays: the smallest index of a set is its root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(self.up, after := self.up[self.up]):
                self.up = after


def linked(points: np.ndarray, home: np.ndarray, reach: int, cells: int = 1 << 21) -> np.ndarray:
    """Root (an index) of each point, under links of points within ``reach`` bits
    to points at home here. Leaves are compared in slices of ``cells`` pairs."""
    forest = Forest(len(points))
    todo = [(np.flatnonzero(home), np.arange(len(points)))]
    while todo:
        here, ask = todo.pop()
        if not len(here) or not len(ask):
            continue
        cut = vantage(points[here], reach) if len(here) > LEAF else None
        if cut is None:
            step = max(1, cells // len(here))
            for i in range(0, len(ask), step):
                q = ask[i : i + step]
                x, y = np.nonzero(np.bitwise_count(points[q][:, None] ^ points[here][None, :]) <= reach)
                forest.link(q[x], here[y])
            continue
        p, r = cut
        d_here = np.bitwise_count(points[here] ^ p)
        d_ask = np.bitwise_count(points[ask] ^ p).astype(np.int64)
        todo.append((here[d_here <= r], ask[d_ask - reach <= r]))
        todo.append((here[d_here > r], ask[d_ask + reach > r]))
    return forest.up


# ---------------------------------------------------------------- operator


def _sampled(points: DataFrame, share: float) -> np.ndarray:
    """The points whose hash falls in a ``share`` of the hashes, in order of the hash."""
    place = F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(1 << 40))
    rows = points.select("fp", place.alias("place")).where(F.col("place") < int(share * (1 << 40))).toArrow()
    order = np.lexsort((rows["fp"].to_numpy(), rows["place"].to_numpy()))
    return rows["fp"].to_numpy()[order].view(np.uint64)


def point_links(points: DataFrame, reach: int = 2, shard: int = SHARD, shards: int = SHARDS, per_shard: int = PER_SHARD) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct longs ``fp`` exactly as all
    pairs within ``reach`` bits do. The points are split until each shard has at most
    ``shard``, or an ``1 / shards`` of all, as the split tree's sample tells: about
    ``per_shard`` points for each. Every point is indexed and searched."""
    n = points.count()
    shard = max(shard, -(-n // shards))
    nodes = []
    if n > shard:
        share = min(1.0, max(4096 / n, per_shard / shard))
        nodes = split_tree(_sampled(points, share), int(shard * share), reach)

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            if sum(map(len, held)) >= ROUTED:
                yield np.concatenate(held)
                held = []
        if held:
            yield np.concatenate(held)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp in batched(batches):
            at, to, home = route(fp.view(np.uint64), nodes, reach)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(fp[at]), pa.array(home)], ["shard", "fp", "home"])

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fp", kind="stable")
        fp = rows["fp"].to_numpy()
        root = linked(fp.view(np.uint64), rows["home"].to_numpy(), reach)
        own = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[own], "b": fp[root[own]]})

    routed = points.mapInArrow(spread, "shard long, fp long, home boolean")
    return routed.groupBy("shard").applyInPandas(search, "a long, b long")


def _classes(prints: DataFrame, reach: int, shard: int) -> DataFrame:
    """``fp, first, root`` of each fingerprint: its smallest doc_id, and the
    fingerprint that names its component."""
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    roots = components(point_links(points.select("fp"), reach, shard))
    return points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, k: int = 3, reach: int = 2, shard: int = SHARD) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document: fingerprints of
    ``k``-word shingles link at ``reach`` or fewer bits; a component is named by
    its smallest doc_id. Links between fingerprints with a null id count; the
    smallest id of a component is taken over its non-null ones."""
    prints = stored(fingerprints(docs, k), "fingerprints")
    classes = _classes(prints, reach, shard)
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(classes.join(smallest, "root").select("fp", "component_id"), "classes")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_copies(docs: DataFrame, k: int = 3, reach: int = 2, shard: int = SHARD) -> DataFrame:
    """One row of each component: that of the smallest doc_id (null ids last), among
    rows of one id that of the smallest text hash, among equal rows the first read.
    Rows of different components all stay, whatever their ids.

    The rows that go are found among fingerprints and taken out by row number, id and
    text hash together, so a row can only go as itself; they are few beside the texts.
    ``docs`` must give its rows in the same partitions and order each time, as a
    written table does; of a table that does not, copies may stay."""
    prints = stored(fingerprints(docs, k), "fingerprints")
    classes = _classes(prints, reach, shard).select("fp", "root")
    placed = stored(prints.join(classes, "fp").select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "row").alias("place")), "placed")
    first = placed.groupBy("root").agg(F.min("place").alias("first"))
    gone = placed.join(first, "root").where("place.row != first.row").select("place.*")
    names = {c: free_name(f"_{c}", docs) for c in ("row", "key", "gone")}
    gone = stored(gone.select(F.col("row").alias(names["row"]), F.struct("doc_id", "key").alias(names["gone"])), "copies")
    rows = docs.withColumn(names["row"], F.monotonically_increasing_id())
    rows = rows.withColumn(names["gone"], F.struct(F.col("doc_id"), F.xxhash64("text").alias("key")))
    return rows.join(gone, [names["row"], names["gone"]], "left_anti").select(*docs.columns)
