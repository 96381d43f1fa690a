"""Substring dedup by prefix-partitioned suffix trees over words.

A word is removed if a window of ``WINDOW`` consecutive words of its document
covers it that also starts earlier (smaller doc_id, or earlier in the same
document). Documents are packed into blocks of word numbers. Every suffix (a
place in a text) has a variable-length prefix: it ends with the anchor, the
``GRAM`` words of least hash among those that lie in the suffix's first
``WINDOW`` words. Equal windows have equal prefixes, and neighbouring suffixes
share their anchor, so their words travel once.

1. Each block sends its distinct anchors; Spark counts the blocks of each, and those
   of at least two blocks come back.
2. Each block settles repeats inside it, and sends of the windows with a shared
   anchor the first of each kind, as stretches of words, to the anchor's group.
   A passage with any number of copies thus sends one stretch per block.
3. A group builds the suffix tree of its stretches, cut at depth ``WINDOW``, level by
   level (prefix doubling: depths 1, 2, 4, 8, 16, then ``WINDOW``). Suffixes that share
   a node of depth ``WINDOW`` lie below a deep internal node, a maximal repeat;
   all but its earliest suffix are marked.
4. Prefixes of more than ``HOT`` blocks are lengthened to the whole window: such a
   group is a single leaf, whose earliest suffix Spark's own aggregation finds, with
   partial minima per task. No group of step 3 thus holds more than ``HOT``
   stretches of one anchor, however many blocks have it.
5. Each block removes what its own and the returned marks cover.

Hashes choose groups and candidates only: inside a block, windows of equal hash are
compared word by word (and named by the tree where a hash lies); between blocks words
travel as words. Null, empty and short texts (under ``WINDOW`` words) lose nothing; a
null doc_id comes before all others; rows with the same doc_id count as one document
whose later rows follow in block order. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import block_ids, pack_blocks, shingle_hashes, span_hashes, stored, word_list

WINDOW, GRAM = 20, 8
#: Blocks whose anchors or stretches share a group, about.
BLOCKS_PER_GROUP = 6
#: Stretches of one anchor that a group takes; anchors of more blocks go the other way.
HOT = 64
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Block:
    """A block's windows: place, 64-bit hash, anchor, and which are first in it."""

    def __init__(self, block: int, doc_ids: list, lens: np.ndarray, ids: bytes, words: list[bytes]):
        self.block, self.words = block, words
        # null (None or NaN) comes first
        self.doc_ids = np.array([np.iinfo(np.int64).min if d is None or d != d else int(d) for d in doc_ids], np.int64)
        self.lens = np.asarray(lens, np.int64)
        self.ids = block_ids(ids, self.lens)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        self.hash = span_hashes(data, ends - sizes, ends)[self.ids] if len(self.ids) else np.empty(0, np.uint64)
        self.text = np.repeat(np.arange(len(self.lens)), self.lens)
        self.begin = np.cumsum(self.lens) - self.lens
        self.window, self.at = shingle_hashes(self.hash, self.text, WINDOW)
        gram, place = shingle_hashes(self.hash, self.text, GRAM)
        least = np.full(len(self.hash), np.iinfo(np.uint64).max, np.uint64)
        least[place] = gram
        span, reach = WINDOW - GRAM + 1, 1
        while reach < span:  # least of ``reach`` grams from each place
            step = min(reach, span - reach)
            least[:-step] = np.minimum(least[:-step], least[step:])
            reach += step
        self.anchor = least[self.at]

    def first(self) -> np.ndarray:
        """Whether no equal window starts earlier in this block."""
        kind = self.window
        order = np.lexsort((self.at, self.doc_ids[self.text[self.at]], kind))
        same = np.flatnonzero(kind[order][1:] == kind[order][:-1])
        one, other = self.at[order[same]], self.at[order[same + 1]]
        if any((self.ids[one + k] != self.ids[other + k]).any() for k in range(WINDOW)):
            kind = repeats(self.ids, self.lens)[0]
            order = np.lexsort((self.at, self.doc_ids[self.text[self.at]], kind))
            same = np.flatnonzero(kind[order][1:] == kind[order][:-1])
        out = np.ones(len(order), bool)
        out[order[same + 1]] = False
        return out

    def firsts(self, shared: pd.DataFrame, column: str) -> np.ndarray:
        """The windows to send: first of their kind, with an anchor of ``column``."""
        anchors = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in shared[column])])
        asked = np.isin(self.anchor, anchors)
        return np.flatnonzero(asked & self.first()) if asked.any() else np.empty(0, np.int64)


def _read(batch: pa.RecordBatch) -> Iterator[Block]:
    for r in batch.to_pylist():
        yield Block(r["block"], r["doc_ids"], np.array(r["lens"], np.int64), r["ids"], word_list(r["words"]))


def _of(rows: pd.DataFrame) -> Block | None:
    if not len(rows):
        return None
    r = rows.iloc[0]
    return Block(r["block"], list(r["doc_ids"]), r["lens"], r["ids"], word_list(r["words"]))


def _by_group(values: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of ``values`` by the group they belong to."""
    group = (values % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(part):
            yield int(group[part[0]]), part


def _anchors(blocks: DataFrame, groups: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _read(batch):
                found = np.unique(b.anchor)
                for g, part in _by_group(found, groups):
                    yield pa.RecordBatch.from_pydict({"grp": pa.array([g], pa.int64()), "block": pa.array([b.block], pa.int64()), "anchors": pa.array([found[part].tobytes()], pa.binary())})

    return blocks.mapInArrow(run, "grp long, block long, anchors binary")


def _shared(hot: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The anchors of each block that another block has too, those of many blocks apart."""
        lists = [np.frombuffer(b, np.uint64) for b in rows["anchors"]]
        seen, n = np.unique(np.concatenate(lists), return_counts=True)
        several, many = seen[(n > 1) & (n <= hot)], seen[n > max(1, hot)]
        parts = [(b, x[np.isin(x, several, assume_unique=True)].tobytes(), x[np.isin(x, many, assume_unique=True)].tobytes()) for b, x in zip(rows["block"], lists)]
        return pd.DataFrame([p for p in parts if p[1] or p[2]], columns=["block", "anchors", "hot"])

    return run


def _stretches(groups: int):
    def run(block: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        out = []
        b = _of(block)
        send = b.firsts(shared, "anchors") if b is not None and len(shared) else np.empty(0, np.int64)
        if len(send):
            at, anchor = b.at[send], b.anchor[send]
            new = np.r_[True, (np.diff(at) != 1) | (anchor[1:] != anchor[:-1])]
            begin = np.flatnonzero(new)
            size = np.diff(np.r_[begin, len(at)])
            for g, part in _by_group(anchor[begin], groups):
                start, n = at[begin[part]], size[part]
                length = n + WINDOW - 1
                places = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
                used, code = np.unique(b.ids[places], return_inverse=True)
                words = b" ".join([b.words[w] for w in used.tolist()])
                code = code.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
                out.append((g, b.block, b.doc_ids[b.text[start]].tobytes(), start.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), code.tobytes(), words))
        return pd.DataFrame(out, columns=["grp", "block", "docs", "starts", "sizes", "codes", "words"])

    return run


def _hot_windows(block: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
    """The windows of the block whose anchors are in many blocks, as words."""
    b = _of(block)
    send = b.firsts(shared, "hot") if b is not None and len(shared) else np.empty(0, np.int64)
    at = b.at[send] if len(send) else send
    words = [b" ".join([b.words[w] for w in b.ids[i : i + WINDOW].tolist()]) for i in at.tolist()]
    return pd.DataFrame({"words": words, "doc": b.doc_ids[b.text[at]] if len(send) else at, "block": np.full(len(at), b.block if len(send) else 0), "place": at.astype(np.int32)})


def repeats(codes: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffix-tree node of depth ``window`` of each suffix that is long enough,
    and the suffix's place. ``codes``: stretches one after another, ``lengths``
    long. The node of depth a + b is named by the nodes of depth a here and of
    depth b, a places on; equal names mean equal words."""
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # words from here to the stretch's end

    def joined(a: np.ndarray, b: np.ndarray, step: int, depth: int) -> np.ndarray:
        name = np.full(len(codes), -1, np.int64)
        at = np.flatnonzero(left >= depth)
        name[at] = np.unique(a[at] * np.int64(len(codes) + 1) + b[at + step], return_inverse=True)[1]
        return name

    level = {1: np.unique(codes, return_inverse=True)[1].astype(np.int64)}
    depth = 1
    while 2 * depth <= window:
        level[2 * depth] = joined(level[depth], level[depth], depth, 2 * depth)
        depth *= 2
    name = level[depth]
    for d in sorted(level, reverse=True):  # the rest of the depth from shorter nodes
        if depth + d <= window and depth < window:
            name, depth = joined(name, level[d], depth, depth + d), depth + d
    at = np.flatnonzero(left >= window)
    return name[at], at


def _marks(rows: pd.DataFrame) -> pd.DataFrame:
    """Starts, per block, of the windows that also start earlier in another block."""
    rows = rows.reset_index(drop=True)
    size = np.concatenate([np.frombuffer(x, np.int32) for x in rows["sizes"]]).astype(np.int64)
    start = np.concatenate([np.frombuffer(x, np.int32) for x in rows["starts"]]).astype(np.int64)
    doc = np.concatenate([np.frombuffer(x, np.int64) for x in rows["docs"]])
    source = np.repeat(np.arange(len(rows)), [len(x) // 4 for x in rows["sizes"]])
    length = size + WINDOW - 1
    number: dict[bytes, int] = {}
    codes = []
    for packed, words, sizes in zip(rows["codes"], rows["words"], rows["sizes"]):
        n = int((np.frombuffer(sizes, np.int32).astype(np.int64) + WINDOW - 1).sum())
        own = np.array([number.setdefault(w, len(number)) for w in word_list(words)], np.int64)
        codes.append(own[np.frombuffer(packed, np.uint32 if len(packed) > 2 * n else np.uint16)])
    node, at = repeats(np.concatenate(codes), length)
    stretch = np.repeat(np.arange(len(length)), length)[at]
    place = start[stretch] + at - (np.cumsum(length) - length)[stretch]
    block = rows["block"].to_numpy(np.int64)[source[stretch]]
    order = np.lexsort((place, block, doc[stretch], node))
    later = order[1:][node[order][1:] == node[order][:-1]]
    out = []
    owner = source[stretch][later]
    for s in np.unique(owner):
        out.append((int(rows["block"][s]), place[later[owner == s]].astype(np.int32).tobytes()))
    return pd.DataFrame(out, columns=["block", "starts"])


def _kept(block: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    b = _of(block)
    if b is None:
        return pd.DataFrame({"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []})
    starts = [b.at[~b.first()], *(np.frombuffer(x, np.int32).astype(np.int64) for x in marks["starts"] if x is not None), *(np.asarray(x, np.int64) for x in marks["places"] if x is not None)]
    edge = np.zeros(len(b.ids) + 1, np.int64)
    for s in starts:
        np.add.at(edge, s, 1)
        np.add.at(edge, s + WINDOW, -1)
    keep = np.cumsum(edge[:-1]) == 0
    kept = [b" ".join([b.words[w] for w in b.ids[i : i + n][keep[i : i + n]].tolist()]) for i, n in zip(b.begin.tolist(), b.lens.tolist())]
    removed = b.lens - np.bincount(b.text, keep, len(b.lens)).astype(np.int64)
    ids = pd.array([None if d is None or d != d else int(d) for d in block.iloc[0]["doc_ids"]], "Int64")
    return pd.DataFrame({"doc_id": ids, "n_words": b.lens, "n_removed": removed, "kept": kept})


def _digest(block: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    out = _kept(block, marks)
    out["kept_sha256"] = [hashlib.sha256(x).hexdigest() for x in out.pop("kept")] if "kept" in out else []
    return out


def _text(block: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    out = _kept(block, marks)
    out["text"] = [x.decode() for x in out.pop("kept")] if "kept" in out else []
    return out[["doc_id", "n_words", "n_removed", "text"]]


def dedup(docs: DataFrame, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """``doc_id, n_words, n_removed`` and the digest of the kept words, or with
    ``with_text`` the kept words themselves, joined by one space."""
    blocks = pack_blocks(docs, lower=False, name="sub-blocks")
    groups = max(1, blocks.count() // BLOCKS_PER_GROUP)
    anchors = _anchors(blocks, groups).groupBy("grp").applyInPandas(_shared(hot), "block long, anchors binary, hot binary")
    shared = stored(anchors, "sub-shared")
    asked = blocks.groupBy("block").cogroup(shared.groupBy("block"))
    sent = asked.applyInPandas(_stretches(groups), "grp long, block long, docs binary, starts binary, sizes binary, codes binary, words binary")
    marks = stored(sent.groupBy("grp").applyInPandas(_marks, "block long, starts binary"), "sub-marks")
    many = shared.where(F.octet_length("hot") > 0).select("block", "hot")
    if not many.isEmpty():
        whole = blocks.join(many.select("block").distinct(), "block", "left_semi").groupBy("block").cogroup(many.groupBy("block"))
        whole = stored(whole.applyInPandas(_hot_windows, "words binary, doc long, block long, place int"), "sub-windows")
        earliest = whole.groupBy("words").agg(F.min(F.struct("doc", "block", "place")).alias("first"))
        later = whole.join(earliest, "words").where(F.struct("doc", "block", "place") != F.col("first"))
        marks = marks.unionByName(later.groupBy("block").agg(F.collect_list("place").alias("places")), allowMissingColumns=True)
    else:
        marks = marks.withColumn("places", F.lit(None).cast("array<int>"))
    both = blocks.groupBy("block").cogroup(marks.groupBy("block"))
    if with_text:
        return both.applyInPandas(_text, "doc_id long, n_words long, n_removed long, text string")
    return both.applyInPandas(_digest, RESULT)
