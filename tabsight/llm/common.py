"""Helpers shared by the operators: intermediate tables in the shared folder,
vectorised word hashing, and documents packed into blocks of word numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words, ``[\x20\x09-\x0D]``.
SPACE = bytes([9, 10, 11, 12, 13, 32])
#: Java form of the same class, for split() and regexp_replace().
SPACE_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE)] = False
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTE = np.random.default_rng(20240).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset a local
    session (tests) gets a temporary folder; a cluster session is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: computed once,
    short lineage, survives lost executors. ``df`` may hold no void column."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table made by :func:`stored` that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id, n: int):
    """``crc32`` of the id written as text, modulo ``n``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def free_name(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[str, np.ndarray] = {}


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POW or len(_POW["up"]) < n:
        size = max(n, 1 << 21)
        _POW["up"], _POW["down"] = _powers(_BASE, size), _powers(_BASE_INV, size)
    return _POW["up"], _POW["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``data[s:e]`` for each span: differences of a running
    polynomial sum, so the cost is per byte and not per span."""
    up, down = _pow_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word in ``data``, whose text i is
    ``data[offsets[i]:offsets[i + 1]]``."""
    inside = _IS_WORD[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[:1], after[-1:] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    begin, full = offsets[:-1], offsets[1:] > offsets[:-1]
    before[begin[full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingle_hashes(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words within one text, and where it starts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _BASE + words[j : j + n]
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    return mix(total[at]), at


def text_chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most ``most`` text bytes (a longer text makes a
    slice of its own): first row, past-the-end row, bytes, offsets. Null is ''."""
    col = batch.column(column).cast(pa.large_string()).fill_null("")
    if not len(col):
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


# ---------------------------------------------------------------- blocks

BLOCKS = "block long, doc_ids array<long>, lens array<int>, ids binary, words binary"
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("ids", pa.binary()), ("words", pa.binary())])
#: A block ends with the document that takes it over either number.
BLOCK_WORDS, BLOCK_DISTINCT = 1_000_000, 50_000


def pack_blocks(docs: DataFrame, lower: bool, name: str) -> DataFrame:
    """Documents as rows of packed word numbers with the words they stand for,
    written once. A block holds consecutive whole documents of one task, about
    ``BLOCK_WORDS`` words or ``BLOCK_DISTINCT`` distinct words; word numbers have
    two bytes, or four where one document has too many distinct words. Words are
    joined by spaces: an array of them would take three times the room in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 33, 0
        number: dict[bytes, int] = {}
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            packed = np.concatenate(ids).astype(np.uint16 if len(number) <= 1 << 16 else np.uint32).tobytes()
            row = {"block": base + seq, "doc_ids": list(doc_ids), "lens": list(map(len, ids)), "ids": packed, "words": b" ".join(number)}
            seq += 1
            number.clear(), ids.clear(), doc_ids.clear()
            return pa.RecordBatch.from_pylist([row], BLOCK_SCHEMA)

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = (text.as_py() or "").encode()
                words = (raw.translate(LOWER) if lower else raw).split()
                ids.append(np.array([number.setdefault(w, len(number)) for w in words], np.uint32))
                doc_ids.append(doc_id)
                size += len(words)
                if size >= BLOCK_WORDS or len(number) >= BLOCK_DISTINCT or len(ids) >= 100_000:
                    yield flush()
                    size = 0
        if doc_ids:
            yield flush()

    return stored(docs.select("doc_id", "text").mapInArrow(run, BLOCKS), name)


def word_list(words: bytes) -> list[bytes]:
    return words.split(b" ") if words else []


def block_ids(ids: bytes, lens: np.ndarray) -> np.ndarray:
    """Word numbers of a block."""
    return np.frombuffer(ids, np.uint32 if len(ids) > 2 * int(np.sum(lens)) else np.uint16)
