"""Language-model scoring by context-tree weighting over bytes.

A text is coded as its lower-cased words, each followed by a space, and one end
mark. Every byte is decomposed into eight binary decisions; each decision has a
context tree over the ``DEPTH`` bytes before it in the running text, across words
(the place before the text counts as spaces). Krichevsky-Trofimov estimates of all
depths are mixed with the context-tree weights learned from the training texts;
the sum over the text is its code length, also given in bits per coded byte.

Documents are packed once into blocks of word numbers. A cell of ``CELL`` blocks
counts its distinct contexts with the byte that follows. Those with the same last two
bytes meet, up a tree of ``FAN`` cells or nodes at a time, in which equal contexts
become one; the root of each is a subtree of the context tree, whose weights are
computed bottom-up. Only the two top levels (at most 256 contexts of 255 decisions)
meet on the driver. Values return down the same tree, each node asking for its own
contexts alone. No task holds more than a cell, ``FAN`` nodes or one subtree, which
grows with the distinct contexts of the language and not with the texts.

Word counts of the base score meet in hashed buckets and return packed likewise.

Null texts count as empty: only the end mark is scored. Repeated rows are
learned and scored one by one. Words are of any length. An empty table gives no
rows. Without training texts all estimates are those of empty counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import block_ids, crc_mod, pack_blocks, stored, word_list

#: Bytes of context; distinct words of a block that share a bucket, at least.
DEPTH, BLOCKS_PER_BUCKET = 5, 8
#: Blocks of a cell (a power of two, as an exponent); cells or nodes that meet in one group.
CELL, FAN = 4, 64
END = b"\n"


def held_out(doc_id: int | None, folds: int = 5, fold: int = 1) -> bool:
    return zlib.crc32(b"" if doc_id is None or doc_id != doc_id else str(int(doc_id)).encode()) % folds == fold


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts in four bytes each where they fit, else in eight."""
    return counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.int64).tobytes()


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint32 if len(data) == 4 * n else np.int64).astype(np.int64)


def _buckets(words: list[bytes], n: int) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in words], np.int64) % n


# ---------------------------------------------------------------- context trees


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5, by Stirling's series at x + 8."""
    low = np.ones_like(x)
    for i in range(8):
        low *= np.minimum(x, 1e30) + i if i else x
    small = x < 1e6
    y = np.where(small, x + 8, x)
    z = 1 / (y * y)
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return series - np.where(small, np.log(np.where(small, low, 1.0)), 0.0)


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of the counts."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def grams(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Key (``DEPTH`` context bytes, then the byte) of each byte of the ``coded``
    texts, and the number of its text."""
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
    text = np.repeat(np.arange(len(coded)), sizes)
    first = np.cumsum(sizes) - sizes
    key = data.copy()
    for d in range(1, DEPTH + 1):
        key[d:] |= data[:-d] << (8 * d)
        for i in range(d):  # the places before the text are spaces
            at = first[sizes > i] + i
            key[at] = key[at] & ~(255 << (8 * d)) | 32 << (8 * d)
    return key, text


def coded_texts(block: dict) -> list[bytes]:
    """The texts of a block as they are coded."""
    lens = np.array(block["lens"], np.int64)
    word, ends = [w + b" " for w in word_list(block["words"])].__getitem__, np.cumsum(lens)
    ids = block_ids(block["ids"], lens).tolist()
    return [b"".join(map(word, ids[e - n : e])) + END for e, n in zip(ends.tolist(), lens.tolist())]


class Lookup:
    """Places of keys in a list of distinct keys that has them all: a table of
    places by hash, and a search for the few keys whose slot another one took."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys, self.sorted = keys, keys[self.order]
        self.shift = np.uint64(64 - max(8, int(np.ceil(np.log2(len(keys) + 1))) + 2))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def places(self, asked: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(asked)]
        other = np.flatnonzero(self.keys[at] != asked)
        at[other] = self.order[np.searchsorted(self.sorted, asked[other])]
        return at


def key_counts(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and how many of each are to be learned: the flag is sorted
    along as the lowest bit, since sorting values is cheaper than sorting places."""
    both = np.sort(keys << 1 | learn)
    first = np.flatnonzero(np.append(True, both[1:] >> 1 != both[:-1] >> 1)) if len(both) else np.empty(0, np.int64)
    return both[first] >> 1, np.add.reduceat(both & 1, first) if len(both) else first


def near(keys: np.ndarray) -> np.ndarray:
    """The last two context bytes."""
    return keys >> 8 & 0xFFFF


def packed(keys: np.ndarray) -> np.ndarray:
    """A key without its last two context bytes, in the same order among equal ones."""
    return (keys >> 24 << 8 | keys & 255).astype(np.uint32)


def unpacked(part: np.ndarray, last: int) -> np.ndarray:
    part = part.astype(np.int64)
    return part >> 8 << 24 | last << 8 | part & 255


class Subtree:
    """Context trees of all decisions below one context of two bytes."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        self.keys = keys
        symbol = keys & 255
        j = np.arange(8)
        self.node = (1 << j) | (symbol[:, None] >> (8 - j))
        self.bit = (symbol[:, None] >> (7 - j)) & 1
        self.levels = []  # from DEPTH to 2: node ids, n0, n1, log ratio, position of each (key, bit)
        below = None
        for d in range(DEPTH, 1, -1):
            context = (keys >> 8) & ((1 << (8 * d)) - 1)
            ids, at = np.unique((context[:, None] << 8) | self.node, return_inverse=True)
            at = at.reshape(self.node.shape)
            w = np.repeat(weights, 8)
            n1 = np.bincount(at.ravel(), w * self.bit.ravel(), len(ids))
            n0 = np.bincount(at.ravel(), w, len(ids)) - n1
            log_pe = kt_log(n0, n1)
            if below is None:
                ratio, log_pw = np.full(len(ids), np.inf), log_pe
            else:
                child_ids, child_pw = below
                # a child's parent: the context without its farthest byte
                parent = ((child_ids >> 8) & ((1 << (8 * d)) - 1)) << 8 | (child_ids & 255)
                children = np.bincount(np.searchsorted(ids, parent), child_pw, len(ids))
                ratio, log_pw = log_pe - children, np.logaddexp(log_pe, children) - np.log(2)
            self.levels.append((n0, n1, ratio, at))
            below = ids, log_pw
        self.top_ids, self.top_pw, self.top = below[0], below[1], self.levels[-1][:2]

    def bits(self) -> np.ndarray:
        """Probability of each key's bits under the mixture from depth 2 down."""
        p = None
        for n0, n1, ratio, at in self.levels:
            a, b = n0[at], n1[at]
            p = mixed((np.where(self.bit, b, a) + 0.5) / (a + b + 1), ratio[at], p)
        return p


def mixed(own: np.ndarray, ratio: np.ndarray, below: np.ndarray | None) -> np.ndarray:
    """A node's prediction: its own estimate and the one below it, in the ratio
    exp(ratio) to 1."""
    if below is None:
        return own
    share = 1 / (1 + np.exp(-np.clip(ratio, -700, 700)))
    return share * own + (1 - share) * below


class Top:
    """The two upper levels of the trees, from rows ``c, node, n0, n1, log_pw``
    summed over the subtrees of each last context byte c."""

    def __init__(self, rows: pd.DataFrame):
        self.n = np.zeros((2, 257, 256))  # counts; row 256: depth 0
        below = np.zeros((257, 256))
        c, node = rows["c"].to_numpy(np.int64), rows["node"].to_numpy(np.int64)
        self.n[0, c, node], self.n[1, c, node], below[c, node] = rows["n0"], rows["n1"], rows["log_pw"]
        pe = kt_log(self.n[0], self.n[1])
        self.ratio = pe - below
        self.n[:, 256] = self.n[:, :256].sum(1)
        below[256] = (np.logaddexp(pe, below) - np.log(2))[:256].sum(0)
        self.ratio[256] = kt_log(self.n[0, 256], self.n[1, 256]) - below[256]

    def log10(self, tree: Subtree) -> np.ndarray:
        p = tree.bits()
        for c in ((tree.keys >> 8 & 255)[:, None], np.int64(256)):
            a, b = self.n[0, c, tree.node], self.n[1, c, tree.node]
            p = mixed((np.where(tree.bit, b, a) + 0.5) / (a + b + 1), self.ratio[c, tree.node], p)
        return np.log10(p).sum(1)


# ---------------------------------------------------------------- jobs


def _merge_words(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: numbers its distinct words, adds up their training counts and
    turns each block's list into numbers."""
    number: dict[bytes, int] = {}
    total = np.zeros(0, np.int64)
    out = []
    for r in rows.sort_values("block", kind="stable").itertuples(index=False):
        at = np.array([number.setdefault(w, len(number)) for w in word_list(r.words)], np.int32)
        total = np.pad(total, (0, len(number) - len(total)))
        total[at] += unpacked_counts(r.counts, len(at))  # a block's words are distinct
        out.append((r.bucket, r.block, at.tobytes(), None, None))
    out.append((rows["bucket"].iloc[0], None, None, b" ".join(number), total.tobytes()))
    return pd.DataFrame(out, columns=["bucket", "block", "numbers", "words", "counts"]).astype({"block": "Int64"})


def _spread(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lens = np.array(r["lens"], np.int64)
                ids, words = block_ids(r["ids"], lens), word_list(r["words"])
                learn = np.repeat(np.array([not held_out(d) for d in r["doc_ids"]], bool), lens)
                n = np.bincount(ids[learn], minlength=len(words))
                bucket = _buckets(words, buckets)
                order = np.argsort(bucket, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    if len(part):
                        yield pa.RecordBatch.from_pylist(
                            [{"bucket": int(bucket[part[0]]), "block": r["block"], "words": b" ".join([words[i] for i in part.tolist()]), "counts": packed_counts(n[part])}],
                            pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]),
                        )

    return blocks.select("block", "doc_ids", "lens", "ids", "words").mapInArrow(run, "bucket long, block long, words binary, counts binary")


def _contexts(blocks: DataFrame) -> DataFrame:
    """Distinct keys of each cell with their training counts, by last two bytes. A
    cell whose blocks are read by two tasks has two rows of a kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, keys, weights = None, [], []

        def flush() -> pa.RecordBatch:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            weight = np.bincount(at, np.concatenate(weights), len(key)).astype(np.int64)
            last = near(key)
            order = np.argsort(last, kind="stable")
            cuts = np.flatnonzero(np.diff(last[order])) + 1
            parts = [p for p in np.split(order, cuts) if len(p)]
            rows = [pa.array([cell] * len(parts), pa.int64()), pa.array([int(last[p[0]]) for p in parts], pa.int64()), pa.array([packed(key[p]).tobytes() for p in parts], pa.binary()), pa.array([packed_counts(weight[p]) for p in parts], pa.binary())]
            return pa.RecordBatch.from_arrays(rows, ["cell", "near", "keys", "weights"])

        for batch in batches:
            for r in batch.to_pylist():
                if cell is not None and r["block"] >> CELL != cell:
                    yield flush()
                    keys.clear(), weights.clear()
                cell = r["block"] >> CELL
                learn = np.array([not held_out(d) for d in r["doc_ids"]], np.int64)
                key, text = grams(coded_texts(r))
                own, n = key_counts(key, learn[text])
                keys.append(own)
                weights.append(n)
        if keys:
            yield flush()

    return blocks.select("block", "doc_ids", "lens", "ids", "words").mapInArrow(run, "cell long, near long, keys binary, weights binary")


def _joined(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct packed keys of some nodes and their summed counts."""
    keys, at = np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in rows["keys"]]), return_inverse=True)
    n = [unpacked_counts(w, len(k) // 4) for k, w in zip(rows["keys"], rows["weights"])]
    return keys, np.bincount(at, np.concatenate(n), len(keys))


def _node(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    keys, weights = _joined(rows)
    return pd.DataFrame({"near": [key[0]], "node": [key[1]], "keys": [keys.tobytes()], "weights": [packed_counts(weights)]})


def _tree(row) -> Subtree:
    return Subtree(unpacked(np.frombuffer(row.keys, np.uint32), row.near), unpacked_counts(row.weights, len(row.keys) // 4).astype(float))


def _tops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples(index=False):
            tree = _tree(row)
            yield pd.DataFrame({"c": (tree.top_ids >> 8) & 255, "node": tree.top_ids & 255, "n0": tree.top[0], "n1": tree.top[1], "log_pw": tree.top_pw})


def _answers(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """The logs of each node's keys, from those of the node above it."""
    keys, logs = (np.frombuffer(above[c].iloc[0], t) for c, t in (("keys", np.uint32), ("logs", np.float32)))
    return own.assign(logs=[logs[np.searchsorted(keys, np.frombuffer(k, np.uint32))].tobytes() for k in own["keys"]])


def context_logs(blocks: DataFrame, fan: int = FAN) -> DataFrame:
    """``cell, near, keys, logs``: log10 probability of the byte of each distinct key
    of each cell, under the tree learned from all training texts."""
    leaves = stored(_contexts(blocks), "lm-contexts")
    n = leaves.select("cell").distinct().count()
    levels = [leaves.withColumn("node", F.xxhash64("cell"))]
    while True:
        n = max(1, -(-n // fan))
        levels[-1] = levels[-1].withColumn("above", F.pmod("node", F.lit(n)))
        above = levels[-1].groupBy("near", "above").applyInPandas(_node, "near long, node long, keys binary, weights binary")
        levels.append(stored(above, "lm-nodes"))
        if n == 1:
            break
    top_rows = levels[-1].mapInPandas(_tops, "c long, node long, n0 double, n1 double, log_pw double")
    top = Top(top_rows.groupBy("c", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_pw").alias("log_pw")).toPandas())

    def root(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            logs = [top.log10(_tree(row)).astype(np.float32).tobytes() for row in frame.itertuples(index=False)]
            yield frame.drop(columns="weights").assign(logs=logs)

    known = levels[-1].mapInPandas(root, "near long, node long, keys binary, logs binary")
    for own in reversed(levels[:-1]):
        leaf = "cell" in own.columns
        own = own.select(*(["cell"] if leaf else []), "near", "node", "above", "keys")
        schema = ("cell long, " if leaf else "") + "near long, node long, above long, keys binary, logs binary"
        known = own.groupBy("near", "above").cogroup(known.groupBy("near", "node")).applyInPandas(_answers, schema)
    return known.select("cell", "near", "keys", "logs")


def score(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte`` (of the coded text)."""
    blocks = pack_blocks(docs, lower=True, name="lm-blocks")
    buckets = max(1, blocks.count() // BLOCKS_PER_BUCKET)
    merged = stored(
        _spread(blocks, buckets).groupBy("bucket").applyInPandas(_merge_words, "bucket long, block long, numbers binary, words binary, counts binary"), "lm-words"
    )
    # the end mark, once per training document
    ends = blocks.select(F.explode("doc_ids").alias("doc_id")).where(crc_mod(F.col("doc_id"), 5) != 1).count()
    total, distinct = _totals(merged.where("block IS NULL").select("bucket", "words", "counts"))
    total, distinct = total + ends, distinct + (ends > 0)
    scale = total + 0.5 * (distinct + 1)

    def counted(words: pd.DataFrame) -> pd.DataFrame:
        """The training counts of each block's words of a bucket."""
        counts = np.frombuffer(words[words["block"].isna()]["counts"].iloc[0], np.int64)
        lists = words[words["block"].notna()]
        return pd.DataFrame({"block": lists["block"].astype("int64"), "bucket": lists["bucket"], "counts": [packed_counts(counts[np.frombuffer(n, np.int32)]) for n in lists["numbers"]]})

    values = merged.groupBy("bucket").applyInPandas(counted, "block long, bucket long, counts binary")
    cell = F.shiftright("block", CELL).alias("cell")
    logs = context_logs(blocks, fan).select("cell", F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("counts"), "near", "keys", "logs")
    answers = values.select(cell, "block", "bucket", "counts", *(F.lit(None).cast(t).alias(c) for c, t in (("near", "long"), ("keys", "binary"), ("logs", "binary")))).unionByName(logs)

    def scored(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own = answers[answers["block"].isna()]
        key = np.concatenate([np.empty(0, np.int64), *(unpacked(np.frombuffer(k, np.uint32), int(c)) for c, k in zip(own["near"], own["keys"]))])
        log = np.concatenate([np.empty(0, np.float32), *(np.frombuffer(x, np.float32) for x in own["logs"])])
        places = Lookup(key)
        out = []
        for r in block.to_dict("records"):
            bucket = _buckets(word_list(r["words"]), buckets)
            counts = np.zeros(len(bucket), np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            starts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
            for v in answers[answers["block"] == r["block"]].itertuples(index=False):
                v_bucket = int(v.bucket)
                at = by_bucket[starts[v_bucket] : starts[v_bucket + 1]]
                counts[at] = unpacked_counts(v.counts, len(at))
            base = np.log10((counts + 0.5) / scale)
            lens = np.array(r["lens"], np.int64)
            ids, part = block_ids(r["ids"], lens), np.repeat(np.arange(len(lens)), lens)
            sums = [np.bincount(part, x[ids], len(lens)) for x in ((counts > 0).astype(float), base)]
            gram, text = grams(coded_texts(r))
            total_log = np.bincount(text, log[places.places(gram)], len(lens))
            coded = np.bincount(text, minlength=len(lens))
            doc_ids = pd.array([None if d is None or d != d else int(d) for d in r["doc_ids"]], "Int64")  # a null may be a NaN here
            out.append(
                pd.DataFrame({"doc_id": doc_ids, "n": lens + 1, "known": sums[0].astype(np.int64) + (ends > 0), "base": sums[1] + np.log10((ends + 0.5) / scale), "score": total_log, "bits": -total_log * np.log2(10) / coded})
            )
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n": [], "known": [], "base": [], "score": [], "bits": []})

    per = blocks.withColumn("cell", F.shiftright("block", CELL)).groupBy("cell").cogroup(answers.groupBy("cell"))
    per = per.applyInPandas(scored, "doc_id long, n long, known long, base double, score double, bits double")
    return per.select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", F.col("bits").alias("bits_per_byte"),
    )


def _totals(words: DataFrame) -> tuple[int, int]:
    """Training words and distinct training words of all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.frombuffer(b, np.int64) for b in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([int((c > 0).sum()) for c in counts], pa.int64())], ["n", "v"])

    n, v = words.select("counts").mapInArrow(run, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return n or 0, v or 0
