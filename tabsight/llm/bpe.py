"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The distinct pre-tokens of a batch are encoded together. Their symbols lie in
one flat array; each round looks up every adjacent pair by binary search among
the sorted pair keys, takes the lowest rank of each pre-token and merges all
its places. Pre-tokens without a further merge leave the array.

Null texts count as empty. An empty text has no ids and decodes to ''. The
special token's own string in a text becomes its id, as the tokenizers library
does by default. Repeated rows and clashing column names do not matter: only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

# The tokenizer's splitting pattern with its white-space class
# spelled out.
_S = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"

# The same pattern for texts with only these letters, where the plain re module
# needs half the time; a text with any other character takes the full pattern.
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_OTHER = re.compile(f"[^\0-\x7f{_LETTER}]")
_COMMON = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\t-\r {_LETTER}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL_SCHEMA = SCHEMA + ", ids array<int>"
#: Pre-tokens whose encodings a worker remembers; the memory is emptied when full.
REMEMBERED = 200_000


class Vocabulary:
    """Byte-level BPE read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        byte_of = {c: b for b, c in chars.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = {i: bytes(byte_of[c] for c in t) for t, i in ids.items() if i not in self.special.values()}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.first = np.array([ids[chars[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        into = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.into = keys[order], order, into[order]
        self.pattern = regex.compile(PATTERN)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the sorted keys, by binary search; -1: no merge."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in one array, and how many each has. Ranks are
        looked up again only beside the places of the last round's merges."""
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, words), np.int64, len(words)))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        none = len(self.rank)
        rank_of = np.append(self.rank, none)  # so that place -1 has the last rank
        place = np.full(len(sym), -1, np.int64)
        same = np.flatnonzero(word[1:] == word[:-1])
        place[same] = self._ranks(sym[same], sym[same + 1])
        done_sym, done_word = [sym[:0]], [word[:0]]
        while len(sym):
            rank = rank_of[place]
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.r_[begin, len(sym)]))
            still = best < none
            done_sym.append(sym[~still])
            done_word.append(word[~still])
            hit = np.flatnonzero((rank == best) & still)
            if len(hit):  # of overlapping places (a pair of equal symbols) every second one, from the left
                run = np.cumsum(np.r_[True, np.diff(hit) > 1]) - 1
                first = np.flatnonzero(np.r_[True, np.diff(run) > 0])
                hit = hit[(np.arange(len(hit)) - first[run]) % 2 == 0]
                sym[hit] = self.into[place[hit]]
                still[hit + 1] = False
            new = (np.cumsum(still) - 1)[hit]
            sym, word, place = sym[still], word[still], place[still]
            if len(new):
                look = np.unique(np.r_[new, np.maximum(new - 1, 0)])
                place[look] = -1
                look = look[look < len(sym) - 1]
                look = look[word[look] == word[look + 1]]
                place[look] = self._ranks(sym[look], sym[look + 1])
        all_sym, all_word = np.concatenate(done_sym), np.concatenate(done_word)
        return all_sym[np.argsort(all_word, kind="stable")], np.bincount(all_word, minlength=len(words))


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Coder:
    """Encodes texts a batch at a time and remembers the pre-tokens it has met:
    number of each, and their ids in one array."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.decimal = [str(i) for i in range(max(vocab.bytes) + 1)]
        self.token = [vocab.bytes.get(i, b"") for i in range(len(self.decimal))]
        self.forget()

    def forget(self) -> None:
        special = self.v.special
        self.number = {s: i for i, s in enumerate(special)}
        self.ids = np.array(list(special.values()), np.int64)
        self.sizes = np.ones(len(special), np.int64)

    def pieces(self, text: str) -> list[str]:
        v, pattern = self.v, self.v.pattern if _OTHER.search(text) else _COMMON
        if not any(s in text for s in v.special):
            return pattern.findall(text)
        out: list[str] = []
        for part in v.split.split(text):
            out += [part] if part in v.special else pattern.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        lists = [self.pieces(t) for t in texts]
        if len(self.number) > REMEMBERED:
            self.forget()
        number = self.number
        new = list(set().union(*lists).difference(number))
        got_ids, got_sizes = [self.ids], [self.sizes]
        for a in range(0, len(new), 10_000):
            some = new[a : a + 10_000]
            ids, sizes = self.v.encode_words([w.encode() for w in some])
            number.update(zip(some, range(len(number), len(number) + len(some))))
            got_ids.append(ids)
            got_sizes.append(sizes)
        self.ids, self.sizes = np.concatenate(got_ids), np.concatenate(got_sizes)
        begin = np.cumsum(self.sizes) - self.sizes
        out = []
        for pieces in lists:
            which = np.array([number[p] for p in pieces], np.int64)
            n = self.sizes[which]
            out.append(self.ids[np.repeat(begin[which] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return out


_CODERS: dict[str, Coder] = {}


def encode(docs: DataFrame, path: str, with_ids: bool = False, most: int = 1 << 20) -> DataFrame:
    """One row per document: token count, digests of the ids and of the text
    decoded from them, and with ``with_ids`` the ids. ``most``: characters of
    text that are worked on together. ``path``: the tokenizers JSON file, at
    the same place on every machine; its size is fixed (50,000 merges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _CODERS:
            _CODERS[path] = Coder(vocabulary(path))
        coder = _CODERS[path]
        for batch in batches:
            doc_ids, column = batch.column("doc_id"), batch.column("text")
            lengths = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
            a = 0
            while a < len(lengths):
                size, b = 0, a
                while b < len(lengths) and (b == a or size < most):
                    size += lengths[b]
                    b += 1
                n, sha, back, full = [], [], [], []
                # Only the texts worked on are Python strings; ids stay in arrays.
                for ids in coder.encode([t or "" for t in column.slice(a, b - a).to_pylist()]):
                    listed = ids.tolist()
                    n.append(len(listed))
                    sha.append(hashlib.sha256(",".join([coder.decimal[i] for i in listed]).encode()).hexdigest())
                    back.append(hashlib.sha256(text_of(coder.token, listed).encode()).hexdigest())
                    if with_ids:
                        full.append(ids.astype(np.int32))
                out = [doc_ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    begin = np.cumsum([0, *n]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(begin, np.concatenate(full)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)
                a = b

    return docs.select("doc_id", "text").mapInArrow(run, FULL_SCHEMA if with_ids else SCHEMA)


def text_of(token: list[bytes], ids: list[int]) -> str:
    """Text of token ids, special tokens kept, broken UTF-8 replaced."""
    return b"".join([token[i] for i in ids]).decode("utf-8", "replace")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Text of each row's ``ids`` (array<int>; null: empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _CODERS:
            _CODERS[path] = Coder(vocabulary(path))
        token = _CODERS[path].token
        for batch in batches:
            texts = pa.array([text_of(token, ids or []) for ids in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
