"""Substring dedup is exact: words are compared as words, hot passages included."""

import hashlib
import random

import numpy as np
import pytest

from tabsight.llm import substring_dedup
from tabsight.llm.common import span_hashes

RND = random.Random(21)
SCHEMA = "doc_id long, text string"


def _brute(rows):
    seen, out = set(), []
    for doc_id, text in sorted(rows):
        w = (text or "").split()
        keep = [True] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                keep[i : i + 20] = [False] * 20
            seen.add(k)
        left = " ".join(x for x, y in zip(w, keep) if y)
        out.append((doc_id, len(w), len(w) - sum(keep), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


def _prose(n):
    return " ".join(RND.choice("abcdefgh") + str(RND.randrange(300)) for _ in range(n))


@pytest.mark.parametrize("hot", [1, 3, 64])
def test_passages_in_every_block(spark, hot):
    """Eight blocks; passages in all, some or two of them, and repeats inside one."""
    everywhere, some, two = _prose(70), _prose(45), _prose(33)
    texts = []
    for i in range(80):
        parts = [_prose(RND.randint(0, 60)), everywhere]
        parts += [some] * (i % 5 == 0) + [two] * (i in (3, 44)) + [everywhere] * (i % 7 == 0)
        RND.shuffle(parts)
        texts.append((i, "\n".join(parts)))
    texts += [(100, ""), (101, None), (102, "w " * 200), (103, "w " * 19), (104, texts[4][1])]
    got = substring_dedup.dedup(spark.createDataFrame(texts, SCHEMA).repartition(8), hot=hot)
    assert sorted(map(tuple, got.collect())) == _brute(texts)


def test_different_words_of_like_hashes(spark):
    """Words whose hashes agree in their upper half are not equal."""
    words = [f"{a}{i}" for a in "xyz" for i in range(140_000)]
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes)
    half = span_hashes(np.frombuffer("".join(words).encode(), np.uint8), ends - sizes, ends) >> np.uint64(32)
    order = np.argsort(half, kind="stable")
    twin = int(np.flatnonzero(np.diff(half[order]) == 0)[0])
    one, other = words[order[twin]], words[order[twin + 1]]
    before, after = _prose(15), _prose(14)
    rows = [(1, f"{before} {one} {after}"), (2, f"{before} {other} {after}")]
    for parts in (1, 2):
        got = substring_dedup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(parts, "doc_id") if parts == 1 else spark.createDataFrame(rows, SCHEMA).repartitionByRange(2, "doc_id"))
        assert sorted(map(tuple, got.collect())) == _brute(rows)
        assert [r["n_removed"] for r in got.collect()] == [0, 0]


def test_windows_of_equal_hash(monkeypatch):
    """Even where all words have one hash, a block tells its windows apart."""
    monkeypatch.setattr(substring_dedup, "span_hashes", lambda data, starts, ends: np.ones(len(starts), np.uint64))
    words = [f"w{i}".encode() for i in range(50)]
    texts = [np.arange(30), np.arange(10, 40), np.arange(25), np.full(22, 7)]
    block = substring_dedup.Block(0, [0, 1, 2, 3], np.array([len(t) for t in texts]), np.concatenate(texts).astype(np.uint16).tobytes(), words)
    seen, expected = set(), []
    for t in texts:
        for i in range(len(t) - 19):
            expected.append(tuple(t[i : i + 20]) not in seen)
            seen.add(tuple(t[i : i + 20]))
    assert block.first().tolist() == expected
