"""The manifest, the exact search and the hard negatives against plain Python, on
tables with nulls, ties, repeated rows, odd vectors and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.llm import bond, merkle, threshold_search, vectors

RND = random.Random(5)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos string, node string, _n string, steps string"
VECTORS = "vec_id long, embedding array<float>, label int, row string, x string, id string, window string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(nodes):
    """Root and, for each leaf, the (left, right) siblings from below upward."""
    steps, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, over = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for j in range(len(run)):
                for i in own[a + j]:
                    steps[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(_h(*run))
            over.append(sum(own[a : a + 3], []))
        nodes, own = above, over
    return nodes[0], steps


def _manifest(rows):
    per = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        even = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 2 == 0
        now = text.replace("\n", "") if even and text is not None else text
        leaf, changed = (_h(*map(_field, (doc_id, source, lang, n_chars, t))) for t in (text, now))
        per[source].append((doc_id is not None, doc_id or 0, leaf, changed, doc_id))
    names = sorted(per, key=lambda s: (s is not None, (s or "").encode()))
    trees = [_tree([leaf for _, _, leaf, _, _ in sorted(per[s], key=lambda r: r[:3])]) for s in names]
    root, over = _tree([t for t, _ in trees]) if trees else (None, None)
    out = []
    for i, s in enumerate(names):
        for k, (_, _, leaf, node, doc_id) in enumerate(sorted(per[s], key=lambda r: r[:3])):
            path = trees[i][1][k] + over[i]
            for left, right in path:
                node = _h(left, node, right)
            out.append((doc_id, leaf, trees[i][0], root, _h(*[a + b for a, b in path]), node, node == root))
    return sorted(out, key=str)


def _documents():
    rows = [(i, RND.choice(["a\nb", "plain", "", None, "é\n" * 3, "x" * 20000]), RND.choice(["en", None]), RND.choice(["s", "s", "s", "t", None, "", "é"]), i % 5 or None) for i in range(900)]
    rows += [(None, "null id", "en", "s", 1), (None, "other", "en", "s", 2), rows[3], rows[3], (77, "same id\n", None, "t", None)]
    rows += [(1000 + 20 * n + i, f"source of {n}\n", "en", f"few{n}", 3) for n in (1, 2, 3, 4, 9, 10) for i in range(n)]
    return [r + ("c",) * 5 for r in rows]


def test_manifest(spark):
    rows = _documents()
    got = merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(5))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == _manifest(rows)


def test_manifest_of_one_row(spark):
    rows = [(0, "t\n", "en", "s", 1) + ("c",) * 5]
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()), key=str) == _manifest(rows)


def test_manifest_of_bands(spark, monkeypatch):
    """Subtrees of three leaves: the tree is made of many bands."""
    monkeypatch.setattr(merkle, "BAND", 1)
    monkeypatch.setattr(merkle, "SUBTREE", 3)
    rows = _documents()[:100]
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()), key=str) == _manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


# ---------------------------------------------------------------- vectors


def _vectors():
    def vec(d=12):
        return [RND.choice([0.0, RND.gauss(0, 0.3)]) for _ in range(d)]

    rows = [(i, vec(), RND.randrange(4)) for i in range(400)]
    near = vec()
    rows += [(400 + i, [v + RND.gauss(0, 0.01) for v in near], i % 3) for i in range(60)]
    rows += [(460 + i, near, 1) for i in range(12)]  # ties
    rows += [rows[50], rows[100], rows[100], (None, near, 2), (None, vec(), 1), (700, vec(3), 0), (701, [], 0), (800, [0.0] * 12, 1)]
    rows += [(900, None, 1), (901, [None] + vec(11), 1), (902, [float("nan")] + vec(11), 1), (903, [float("inf")] + vec(11), 1), (950, vec(), None), (1000, [-v for v in near], 2)]
    return [r + ("c",) * 4 for r in rows]


def _whole(rows):
    out = []
    for vec_id, v, label, *_ in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            out.append((vec_id, [math.floor(256 * float(np.float32(c))) for c in v], label))
    return out


def _ranked(rows, i):
    """(score, id) of the other rows, best first."""
    found = [(-sum(a * b for a, b in zip(rows[i][1], r[1])), r[0] is None, r[0] or 0, r) for j, r in enumerate(rows) if j != i]
    return [(-s, r) for s, _, _, r in sorted(found, key=lambda f: f[:3])]


@pytest.mark.parametrize("values", [1 << 20, 40])
def test_top_k(spark, monkeypatch, values):
    """Also with queries in many blocks."""
    monkeypatch.setattr(vectors, "BLOCK_VALUES", values)
    monkeypatch.setattr(threshold_search, "FIRST", 2)
    rows = _vectors()
    got = threshold_search.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 50 == 0, 5)
    exp = []
    whole = _whole(rows)
    for i, (q, _, _) in enumerate(whole):
        if q is not None and q % 50 == 0:
            exp += [(q, n + 1, r[0], s) for n, (s, r) in enumerate(_ranked(whole, i)[:5])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(exp, key=str)


def test_walk_stops_early():
    """One strong dimension and short vectors: most rows are never scored."""
    rng = np.random.default_rng(3)
    m = rng.integers(-20, 20, (4000, 4))
    m[:, 0] = np.arange(4000)
    best = vectors.Best(1, 5)
    scored = threshold_search.walk(np.array([[50, 1, 0, -1]]), np.array([-1]), m, np.arange(4000), np.arange(4000), np.zeros(4000, bool), best, 0)
    assert best.score[0].tolist() == np.sort(m @ np.array([50, 1, 0, -1]))[::-1][:5].tolist()
    assert scored < 1000


@pytest.mark.parametrize("values", [1 << 20, 40])
def test_hard_negatives(spark, monkeypatch, values):
    monkeypatch.setattr(vectors, "BLOCK_VALUES", values)
    monkeypatch.setattr(bond, "STEP", 5)
    rows = _vectors()
    got = bond.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 20 == 0, 5, 10, 30, 90)
    exp = []
    whole = [r for r in _whole(rows) if r[2] is not None]
    for i, (q, _, label) in enumerate(whole):
        if q is not None and q % 20 == 0:
            ranked = _ranked(whole, i)
            for p, r in [(s, r) for s, r in ranked if r[2] == label][:5]:
                near = [(s, o) for s, o in ranked if o[2] != label and 30 * p <= 100 * s <= 90 * p][:10]
                exp += [(q, r[0], n + 1, o[0], p, s) for n, (s, o) in enumerate(near)]
    assert len(exp) > 200
    assert sorted(map(tuple, got.collect()), key=str) == sorted(exp, key=str)


def test_scan_prunes():
    """After a few dimensions the bitmap holds few rows; the result is the plain one."""
    rng = np.random.default_rng(4)
    m = rng.normal(0, 50, (3000, 32)).astype(int)
    m[:, 24:] //= 20
    anchor = rng.normal(0, 50, 32).astype(int)
    anchor[24:] //= 20
    score = m @ anchor
    low, high = np.array([int(np.quantile(score, 0.5))]), np.array([int(np.quantile(score, 0.9))])
    columns = np.ascontiguousarray(m.T)
    _, at, got = bond.scan(anchor, columns, columns.min(1), columns.max(1), np.ones(3000, bool), low, high, 10, np.zeros(1, int), np.zeros(1, bool))
    assert (score[at] == got).all()
    assert sorted(got)[::-1][:10] == sorted(score[(score >= low) & (score <= high)])[::-1][:10]
    assert len(at) < 100


def test_large_components(spark):
    """Products beyond the exact range of floats stay exact."""
    rows = [(i, [float(2**20 + RND.randrange(1000)) for _ in range(12)], i % 2) + ("c",) * 4 for i in range(60)]
    got = threshold_search.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0, 5)
    whole = _whole(rows)
    exp = [(q, n + 1, r[0], s) for q in (0, 50) for n, (s, r) in enumerate(_ranked(whole, q)[:5])]
    assert sorted(map(tuple, got.collect())) == sorted(exp)


@pytest.mark.parametrize("rows", [[], [(50, None, 1) + ("c",) * 4], [(50, [], 1) + ("c",) * 4, (51, [], 2) + ("c",) * 4]])
def test_few_vectors(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    both = len(_whole(rows)) == 2
    assert [tuple(r) for r in threshold_search.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()] == ([(50, 1, 51, 0)] if both else [])
    assert bond.hard_negatives(df, F.col("vec_id") % 50 == 0, 5, 10, 30, 90).collect() == []
