"""Each operator against a brute-force version on small tables that hold nulls,
empty and long texts, ties, repeated rows and clashing extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tabsight.llm import bpe, decontaminate, licenses, lm_score, pii, quality_classifier, quality_rules, simhash, substring_dedup, url_filter
from tabsight.llm.common import crc_mod
from tabsight.llm.queries import URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, w string, score string, key string, base string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RND = random.Random(12)
VOCAB = ["".join(RND.choice("abcdeé") for _ in range(RND.randint(1, 7))) for _ in range(400)]
PASSAGE = " ".join(RND.choice(VOCAB) for _ in range(60))
LICENSE = "Released under the MIT License."


def _prose(n):
    return " ".join(RND.choice(VOCAB).capitalize() if RND.random() < 0.1 else RND.choice(VOCAB) for _ in range(n))


def _texts():
    out = [None, "", " \n\t ", "one", "two words", "a b c", "x" * 5000, PASSAGE, PASSAGE]
    out += [_prose(30) + "\n" + PASSAGE + "\n" + _prose(30) for _ in range(4)]
    out += [_prose(RND.randint(60, 200)) for _ in range(60)]
    copy = _prose(300)
    out += [copy, copy, copy + " tail", "lead " + copy]
    out += [_prose(20) + f' mail.{i}@site{i}.example.com ip 10.0.{i}.256 10.0.0.{i} +1 (555) 010-00{i}0 4111 1111 1111 1111 token = "{hashlib.sha1(bytes([i])).hexdigest()}" ' + _prose(60) for i in range(8)]
    out += [_prose(60) + f' token = "{hashlib.sha1(bytes([i])).hexdigest().upper()}"' for i in range(2)]
    out += [_prose(80) + "\n" + LICENSE + "\n" + _prose(20), _prose(4000), "### $$$ " * 80, ("same line again and again here\n" * 30)]
    return out


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, None if i % 7 == 0 else "en", "src" + str(i % 2), None if t is None else len(t)) + ("x",) * 6 for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[20], rows[20]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def _words(text):
    return WORD.findall(text or "")


def test_decontaminate(spark, docs, nothing):
    items = [(1, PASSAGE), (2, " ".join(TEXTS[30].split()[5:30])), (3, "two words"), (4, ""), (5, None), (6, _prose(40)), (1, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sh = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))(_words((t or "").translate(LOWER)))
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        for item, t in items:
            s = sh(t)
            if s and 5 * len(s & sh(r["text"])) >= 4 * len(s):
                want[r["doc_id"], item] += 1
    for size in (decontaminate.BLOCK_BYTES, 100):
        got = decontaminate.contained(docs, bench, block_bytes=size)
        assert collections.Counter((r["doc_id"], r["item_id"]) for r in got.collect()) == want
    assert decontaminate.contained(nothing, bench).count() == decontaminate.contained(docs, bench.limit(0)).count() == 0
    bad = {d for d, _ in want}
    assert {r["doc_id"] for r in decontaminate.without_items(docs, bench).collect()} == {r["doc_id"] for r in docs.collect()} - bad


def test_licenses(docs):
    got = licenses.report(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"] for r in got if r["licenses"]} == {i for i, t in enumerate(TEXTS) if t and LICENSE in t}
    assert {r["licenses"] for r in got} == {None, "mit"}


def _base(text):
    w = _words(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(tri)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    covered = {i + j for i, t in enumerate(tri) if n[t] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, nothing):
    got = quality_rules.judge(docs, min_cell=20).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        b = _base(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert set(range(13, 73)) <= kept and TEXTS.index("### $$$ " * 80) not in kept
    passed = quality_rules.passing(docs, min_cell=20)
    assert passed.columns == docs.columns and {r["doc_id"] for r in passed.collect()} == kept
    assert quality_rules.judge(nothing).count() == 0


def test_quality_rules_duplicate_lines(spark):
    """Ordinary words, most lines repeated: rejected although no base rule is."""
    rnd = random.Random(31)
    word = lambda: rnd.choice(VOCAB)
    line = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, "\n".join(line(12) for _ in range(rnd.randint(5, 20))), "en", "s") for i in range(300)]
    for i, distinct in enumerate((1, 3, 5)):  # of 20 short lines, beside a long one
        short = [word() for _ in range(distinct)]
        lines = short + [rnd.choice(short) for _ in range(20 - distinct)]
        rows.append((1000 + i, "\n".join([line(150), *rnd.sample(lines, 20)]), "en", "s"))
    got = _by_id(quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    for i in range(1000, 1003):
        assert not got[i]["base_failed"] and got[i]["n_dup_lines"] >= 0.7 * 21 and not got[i]["kept"]
    assert all(got[i]["kept"] for i in range(300))


def test_least_determinant_of_several_starts(spark):
    """The estimate is settled, and no start's own end has a smaller determinant."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (300, quality_rules.DIM)) @ rng.normal(0, 1, (quality_rules.DIM, quality_rules.DIM))
    x[:70] = x[:70] * 0.2 + 3
    names = [v for v, _, _ in quality_rules.VECTOR]
    df = spark.createDataFrame([("c", *map(float, r)) for r in x], "cell string, " + ", ".join(f"{n} double" for n in names)).cache()
    matrix = lambda r: np.array([[r[f"p_{min(i, j)}_{max(i, j)}"] for j in range(quality_rules.DIM)] for i in range(quality_rules.DIM)])
    best = quality_rules._estimate(df, 0.75)
    again = quality_rules._concentrate(df, best, 0.75).first()
    assert np.allclose(matrix(best.first()), matrix(again), rtol=1e-5) and again["det"] == pytest.approx(-np.linalg.slogdet(matrix(again))[1])
    factor, least, ridge = quality_rules.consistency(0.75, quality_rules.DIM), np.array(quality_rules.LEAST), np.array([r for _, _, r in quality_rules.VECTOR])
    ends = []
    for r in quality_rules._starts(df).collect():
        m, inv = np.array([r[f"m_{i}"] for i in range(quality_rules.DIM)]), matrix(r)
        for _ in range(100):
            d2 = np.einsum("ij,jk,ik->i", x - m, inv, x - m)
            near = x[d2 <= np.sort(d2)[224]]
            cov = np.cov(near.T, bias=True) * factor + np.diag(ridge**2)
            np.fill_diagonal(cov, np.maximum(np.diag(cov), least**2))
            m, inv = near.mean(0), np.linalg.inv(cov)
        ends.append(np.linalg.slogdet(cov)[1])
    assert len(ends) == 3 and again["det"] == pytest.approx(min(ends), abs=1e-5)


def test_robust_estimate_against_numpy(spark):
    """Concentration steps equal the same steps in numpy; planted outliers stay out."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, quality_rules.DIM)) @ rng.normal(0, 1, (quality_rules.DIM, quality_rules.DIM))
    x[:60] += 40
    names = [v for v, _, _ in quality_rules.VECTOR]
    df = spark.createDataFrame([("c", *map(float, r)) for r in x], "cell string, " + ", ".join(f"{n} double" for n in names)).cache()
    est = quality_rules._start(df)
    for _ in range(3):
        est = quality_rules._concentrate(df, est, 0.75)
    got = est.first()
    floor = np.array([f for _, _, f in quality_rules.VECTOR])
    m = np.array([sorted(c)[199] for c in x.T])
    inv = np.diag(1 / np.maximum(1.4826 * np.array([sorted(abs(c - mm))[199] for c, mm in zip(x.T, m)]), floor) ** 2)
    for _ in range(3):
        d2 = np.einsum("ij,jk,ik->i", x - m, inv, x - m)
        near = x[d2 <= np.sort(d2)[299]]
        m = near.mean(0)
        inv = np.linalg.inv(np.cov(near.T, bias=True) * quality_rules.consistency(0.75, quality_rules.DIM) + np.diag(floor**2))
    assert np.allclose([got[f"m_{i}"] for i in range(len(m))], m, atol=1e-6)
    assert np.allclose([got[f"p_{i}_{j}"] for i in range(len(m)) for j in range(i, len(m))], [inv[i, j] for i in range(len(m)) for j in range(i, len(m))], rtol=1e-5, atol=1e-8)
    assert (np.einsum("ij,jk,ik->i", x - m, inv, x - m)[:60] > 100).all()


_PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _spans(text):
    out = []
    for i, (kind, p) in enumerate(_PII):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and sum(int(c) if j % 2 == 0 else sum(map(int, str(2 * int(c)))) for j, c in enumerate(reversed(d))) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), i, m.end()))
    return sorted(out)


@pytest.mark.parametrize("text", ["", "@", "@a.b@c.d", "a@b.c@d.e f@g", "1.2.3.4.5.6.7.8 999.1.1.1", "a@b..c x.@y.z", "+12345678 +123456789- +1 (2) 3", "0000 0000 0000 0 12-34 5", "é1@x.yé.z", "4111-1111 1111--1111", "1.2.3.0004"])
def test_base_spans(text):
    assert pii.base_spans(text) == _spans(text)


def test_pii(docs, nothing):
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = pii.report(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        want = _spans(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{_PII[k][0]}:{s}:{e}" for s, k, e in want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for _, k, _ in want) for x in range(4)]
    # upper-case keys are no seeds; their context finds them
    for d, t in text.items():
        for m in re.finditer('token = "([0-9A-Fa-f]{40})"', t):
            assert f"secret:{m.start(1)}:{m.end(1)}" in {r["doc_id"]: r["spans"] for r in got}[d].split(",")
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.count() == docs.count()
    for r in red.collect():
        assert "@site" not in (r["text"] or "") and not re.search('token = "[0-9a-fA-F]', r["text"] or "")
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    row = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] or "")
    assert sorted(red.collect(), key=row) == sorted(pii.redact(docs, trusted_bytes=-1).collect(), key=row)
    assert pii.report(nothing).count() == pii.redact(nothing).count() == 0


def test_pii_patterns_bootstrap(spark):
    """Discovered values reach patterns without a seed; a pattern's own candidates do not raise it."""
    rows = [(0, "a a", v) for v in range(8)] + [(-1, "a a", 100), (-1, "a a", 101)]  # 80 % seeds
    rows += [(0, "b b", v) for v in range(10, 18)] + [(-1, "b b", 102), (-1, "b b", 103)]
    rows += [(-1, "hop one", v) for v in (100, 101, 102, 103)]  # no seed
    rows += [(0, "low seeds", v) for v in (20, 21)] + [(0, "low seeds", 22), (0, "low seeds", 23)] + [(-1, "low seeds", v) for v in range(200, 206)]  # 40 %
    rows += [(0, "low twin", v) for v in range(20, 24)] + [(-1, "low twin", v) for v in range(200, 206)]
    rows += [(-1, "hop two", v) for v in (100, 102, 103)] + [(-1, "rest", v) for v in (900, 901, 902)]
    got = {r["pattern"]: r["confidence"] for r in pii.trusted_patterns(spark.createDataFrame(rows, "kind int, pattern string, value long")).collect()}
    assert set(got) == {"a a", "b b", "hop one", "hop two"}
    assert all(0.75 <= c <= 1 for c in got.values())


def test_pii_two_words_before():
    for gap in (" ", " " * 500, " " + "- . , " * 300):
        text = f"My Token{gap}X123456"
        assert pii._before(text, len(text) - 7) == ("my token" if "-" not in gap else "- -")
    long = "w" * 300
    assert pii._before(f"one {long} X123456", 305) == f"one ~{xxhash.xxh64_hexdigest(long.encode(), 42)}"


def test_bpe(spark, docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    odd = ["aaaaaaaa aaa", "<|endoftext|>hi <|endoftext|><|endoftext|>", " \x85x\x1c y\u3000 z\n\n a", "it's I'LL we'll ''\u200b", "日本語😀😀 ١٢٣ ² ½", "\x00\x01", "!" * 300 + " " * 99, "ª º µ × ÷ ß"]
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    got = bpe.encode(every, path, with_ids=True)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(got, path).collect()}
    text = {r["doc_id"]: r["text"] or "" for r in every.collect()}
    rows = got.collect()
    assert len(rows) == every.count()
    for r in rows:
        ids = lib.encode(text[r["doc_id"]], add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and back[r["doc_id"]] == decoded
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode(nothing, path).count() == 0


def test_substring_dedup(docs, nothing):
    one = docs.dropDuplicates(["doc_id"]).repartition(4)
    got = _by_id(substring_dedup.dedup(one))
    texts = _by_id(substring_dedup.dedup(one, with_text=True))
    seen, assert_removed = set(), 0
    for r in sorted(one.collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"]):
        w = _words(r["text"])
        keep = [True] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                keep[i : i + 20] = [False] * 20
            seen.add(k)
        left = " ".join(x for x, y in zip(w, keep) if y)
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_removed"], g["kept_sha256"]) == (len(w), len(w) - sum(keep), hashlib.sha256(left.encode()).hexdigest())
        assert texts[r["doc_id"]]["text"] == left
        assert_removed += g["n_removed"]
    assert assert_removed > 500
    assert substring_dedup.dedup(docs).count() == docs.count() and substring_dedup.dedup(nothing).count() == 0


def _ctw(train):
    """Context-tree weighting of coded texts with dictionaries, node by node."""
    depth = lm_score.DEPTH

    def steps(coded):
        seen = b" " * depth
        for c in coded:
            for j in range(8):
                yield seen, (1 << j) | (c >> (8 - j)), (c >> (7 - j)) & 1
            seen = (seen + bytes([c]))[-depth:]

    counts = collections.Counter(s for coded in train for s in steps(coded))
    nodes = collections.defaultdict(lambda: [0, 0])
    for (s, n, b), c in counts.items():
        for k in range(depth + 1):
            nodes[s[depth - k :], n][b] += c
    kids = collections.defaultdict(list)
    for s, n in nodes:
        if s:
            kids[s[1:], n].append((s, n))
    log_pw, ratio = {}, {}
    for key in sorted(nodes, key=lambda x: -len(x[0])):
        a, b = nodes[key]
        pe = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        below = sum(log_pw[k] for k in kids[key])
        ratio[key] = pe - below
        log_pw[key] = pe if len(key[0]) == depth else np.logaddexp(pe, below) - math.log(2)
    memo = {}

    def step_log(step):
        s, n, b = step
        p = None
        for k in range(depth, -1, -1):
            key = (s[depth - k :], n)
            c = nodes[key] if key in nodes else [0, 0]
            own = (c[b] + 0.5) / (sum(c) + 1)
            share = 1 / (1 + math.exp(-max(-700, min(700, ratio.get(key, 0.0)))))
            p = own if p is None else share * own + (1 - share) * p
        return math.log10(p)

    def log10(coded):
        return sum(memo[x] if x in memo else memo.setdefault(x, step_log(x)) for x in steps(coded))

    return log10


@pytest.mark.parametrize("fan", [64, 2])
def test_lm_score(docs, nothing, fan):
    rows = docs.select("doc_id", "text").collect()
    words = [_words((r["text"] or "").translate(LOWER)) for r in rows]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    coded = ["".join(w + " " for w in ws).encode() + b"\n" for ws in words]
    train = collections.Counter(w for r, ws in zip(rows, words) if not held(r["doc_id"]) for w in [*ws, ""])
    n, v = sum(train.values()), len(train)
    model = _ctw([c for r, c in zip(rows, coded) if not held(r["doc_id"])])
    want = []
    for r, ws, c in zip(rows, words, coded):
        base = sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*ws, ""])
        score = model(c)
        want.append(((r["doc_id"] is None, r["doc_id"] or 0, len(ws)), held(r["doc_id"]), len(ws) + 1, sum(train[x] > 0 for x in [*ws, ""]), base, score, -score * math.log2(10) / len(c)))
    got = lm_score.score(docs, fan).collect()
    got = [((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"] - 1), r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"], r["bits_per_byte"]) for r in got]
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want)):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], rel=1e-6)
    assert lm_score.score(nothing).count() == 0


def test_lm_score_knows_the_order_of_words(spark):
    """A text and its words in another order have the same base score only."""
    text = " ".join(f"{a} {b}" for a in ("the", "one", "some") for b in ("cat sat down", "dog ran off")) + " . "
    texts = [text * 20, text, " ".join(sorted(text.split()))]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1][:1] + [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    got = _by_id(lm_score.score(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")))
    straight, mixed = got[ids[1]], got[ids[2]]
    assert straight["base_score"] == pytest.approx(mixed["base_score"])
    assert straight["score"] > mixed["score"] + 5 and straight["bits_per_byte"] < mixed["bits_per_byte"]


def test_url_filter(spark):
    urls = [None, "no scheme", "http://x.COM", "https://a.example.com/en/1", "http://www.example.com/en/1?q#f", "http://example.com/fr/", "http://h.net/es/1", "http://h.net/es/2", "http://h.net/de/1", "http://b.net/de/", "http://c.org#x", "http://d.org", "ftp://net/fr/x://y"]
    html = [None] * 9 + ['<a href="http://H.net/x">'] + ["<p>"] * 3
    pages = spark.createDataFrame(list(zip(range(len(urls)), urls, html, ["x"] * len(urls))), "page_id long, url string, html string, trust string")
    got = {r["page_id"]: r for r in url_filter.judge(pages.unionByName(pages.limit(0)), URL_RULES).collect()}
    assert [got[i]["host"] for i in range(len(urls))] == ["", "", "x.com", "a.example.com", "www.example.com", "example.com", "h.net", "h.net", "h.net", "b.net", "c.org", "d.org", "net"]
    assert got[4]["path"] == "/en/1" and got[2]["path"] == "" and got[10]["path"] == ""
    assert [got[i]["rule"] for i in (3, 4, 5, 6, 8, 12)] == ["example.com/en/", "www.example.com/en/", "com/", "net/es/", None, "net/fr/"]
    assert got[2]["rule"] is None  # "com/" needs a path that starts with "/"
    assert got[3]["verdict"] == "block" and got[4]["verdict"] == "allow"
    assert got[8]["verdict"] == "block"  # most of its host's pages are blocked
    assert got[9]["verdict"] == "allow" or got[9]["distrust"] > 0  # links to a blocked host
    assert got[9]["distrust"] > 0 and got[10]["distrust"] == 0 and got[10]["verdict"] == "allow"
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0


def test_pagerank_against_numpy(spark):
    rnd, hosts = random.Random(5), [f"h{i}" for i in range(12)]
    links = {(rnd.choice(hosts[:9]), rnd.choice(hosts)) for _ in range(30)}
    links = {(a, b) for a, b in links if a != b}
    out = collections.Counter(a for a, _ in links)
    nodes = spark.createDataFrame([(h, 0.5 if h in ("h1", "h4") else 0.0) for h in hosts], "host string, seed double")
    edges = spark.createDataFrame([(a, b, 1 / out[a]) for a, b in links], "src string, dst string, weight double")
    got = {r["host"]: r["rank"] for r in url_filter.spread(nodes, edges).collect()}
    seed = np.array([0.5 if h in ("h1", "h4") else 0.0 for h in hosts])
    m = np.zeros((12, 12))
    for a, b in links:
        m[hosts.index(b), hosts.index(a)] = 1 / out[a]
    rank = seed
    for _ in range(url_filter.ROUNDS):
        lost = sum(rank[i] for i, h in enumerate(hosts) if not out[h])
        rank = (1 - url_filter.DAMPING) * seed + url_filter.DAMPING * (m @ rank + lost * seed)
    assert np.allclose([got[h] for h in hosts], rank)


def test_pagerank_settles_on_a_chain(spark):
    """A chain longer than one block of rounds, against the solved linear system."""
    n = 16
    nodes = spark.createDataFrame([(f"h{i:02}", 1.0 if i == 0 else 0.0) for i in range(n)], "host string, seed double")
    edges = spark.createDataFrame([(f"h{i:02}", f"h{i + 1:02}", 1.0) for i in range(n - 1)], "src string, dst string, weight double")
    got = {r["host"]: r["rank"] for r in url_filter.settled(nodes, edges).collect()}
    m = np.diag(np.ones(n - 1), -1)
    m[0, n - 1] = 1.0  # the last host gives its rank back to the seed
    seed = np.eye(n)[0]
    want = np.linalg.solve(np.eye(n) - url_filter.DAMPING * m, (1 - url_filter.DAMPING) * seed)
    assert want[13] > 0.01 and np.allclose([got[f"h{i:02}"] for i in range(n)], want)


def test_quality_classifier(spark, docs, nothing):
    rnd = random.Random(9)
    good = [(i, " ".join(rnd.choice(VOCAB) for _ in range(80))) for i in range(200)]
    bad = [(1000 + i, " ".join(rnd.choice(VOCAB).upper() + "!!" for _ in range(80))) for i in range(60)]
    labelled = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    fold = crc_mod(F.col("doc_id"), 4) == 2
    got = quality_classifier.score(labelled.unionByName(docs.select("doc_id", "text").where("doc_id IS NULL OR doc_id < 9")), labels, fold).collect()
    out = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] >= 9]
    assert np.mean([r["predicted"] == (r["doc_id"] < 1000) for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.score(nothing, labels, fold).count() == 0
    assert {r["score"] for r in quality_classifier.score(docs, labels.limit(0), fold).collect()} == {0.5}
    # the voting equals a plain loop
    model = quality_classifier.Model([t for _, t in good[:40] + bad[:10]], [1] * 40 + [0] * 10)
    x = np.concatenate([quality_classifier.matrix(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for _, t in good[40:44] + bad[10:12]])
    sims = np.round((model.latent(x * model.weight) @ model.vectors.T).astype(float), 5)
    for s, value in zip(sims, model.score(x)):
        near = sorted(range(50), key=lambda i: (-s[i], i))[: quality_classifier.NEIGHBOURS]
        w = [max(s[i], 0) ** quality_classifier.POWER for i in near]
        assert value == pytest.approx(sum(a * model.labels[i] for a, i in zip(w, near)) / sum(w))


def _fingerprint(text):
    w = _words((text or "").translate(LOWER))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, nothing):
    rows = docs.select("doc_id", "text").collect()
    fp = [_fingerprint(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 2 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    first = {g: min((r["doc_id"] for r, x in zip(rows, group) if x == g and r["doc_id"] is not None), default=None) for g in group}
    want = collections.Counter((r["doc_id"], f"{f:016x}", first[g]) for r, f, g in zip(rows, fp, group))
    for shard in (simhash.SHARD, 6):
        got = simhash.near_duplicates(docs, shard=shard).collect()
        assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    kept = simhash.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({d for d in first.values() if d is not None})
    assert simhash.near_duplicates(nothing).count() == 0


def test_vantage_trees_find_every_link():
    rng = np.random.default_rng(1)
    c = rng.integers(0, 2**63, 40).astype(np.uint64)
    chains = [c]
    for _ in range(25):  # chains of near copies
        chains.append(chains[-1] ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)))
    points = np.unique(np.concatenate([*chains, rng.integers(0, 2**63, 1500).astype(np.uint64)]))
    plain = simhash.Forest(len(points))
    plain.link(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2))
    assert (simhash.linked(points, np.ones(len(points), bool), 2, cells=5000) == plain.up).all()
    nodes = simhash.split_tree(points[::3], 4, 2)
    at, shard, home = simhash.route(points, nodes, 2)
    assert (np.bincount(at[home], minlength=len(points)) == 1).all()
    forest = simhash.Forest(len(points))
    for s in np.unique(shard):
        own = at[shard == s]
        root = simhash.linked(points[own], home[shard == s], 2)
        forest.link(own, own[root])
    assert (forest.up == plain.up).all()


def test_shards_grow_with_the_points(spark):
    """No shard outgrows its size because there are many: the sample grows with them."""
    points = np.unique(np.random.default_rng(8).integers(0, 2**63, 60_000).astype(np.uint64))
    df = spark.createDataFrame([(int(p),) for p in points], "fp long")
    shard = 100
    sample = simhash._sampled(df, simhash.PER_SHARD / shard)
    assert 0.9 < len(sample) / (simhash.PER_SHARD / shard * len(points)) < 1.1 and np.isin(sample, points).all()
    at, to, home = simhash.route(points, simhash.split_tree(sample, simhash.PER_SHARD, 2), 2)
    sizes = np.bincount(to[home])
    assert (np.bincount(at[home], minlength=len(points)) == 1).all()
    assert len(sizes) >= len(points) / shard and sizes.max() < 4 * shard


def test_point_links_in_few_or_many_shards(spark):
    rng = np.random.default_rng(9)
    c = rng.integers(0, 2**63, 1500).astype(np.uint64)
    points = np.unique(np.concatenate([c, c[:400] ^ np.uint64(5), c[:200] ^ np.uint64(1 << 40)]))
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    plain = simhash.Forest(len(points))
    plain.link(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2))
    for shard, shards in ((20_000, 1 << 16), (10, 1 << 16), (10, 4)):
        edges = simhash.point_links(df, 2, shard, shards).toPandas()
        forest = simhash.Forest(len(points))
        place = lambda x: np.searchsorted(points, x.to_numpy(np.int64).view(np.uint64))
        forest.link(place(edges["a"]), place(edges["b"]))
        assert (forest.up == plain.up).all()


def _vector(text):
    words, lines = _words(text), [x for x in text.split("\n") if _words(x)]
    n, chars, symbols, dup, rep = _base(text)
    upper, marks = sum("A" <= c <= "Z" for c in text), sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text)
    assert n == len(words)
    return [np.log(chars / n), np.log(1 + symbols / n), np.sqrt(dup / max(len(lines), 1)), np.sqrt(rep / n), np.log(1 + upper / n), np.log(1 + marks / n)]


def _robust(x):
    """Squared distances from the minimum-covariance-determinant estimate of rows ``x``."""
    dim, least = x.shape[1], np.array(quality_rules.LEAST)
    ridge, factor = np.array([r for _, _, r in quality_rules.VECTOR]), quality_rules.consistency(0.75, x.shape[1])
    at = lambda v, p: np.sort(v)[int(np.ceil(p * len(v))) - 1]
    m = np.array([at(c, 0.5) for c in x.T])
    sd = np.maximum(1.4826 * np.array([at(abs(c - mm), 0.5) for c, mm in zip(x.T, m)]), least)
    z = (x - m) / sd
    starts = [np.diag(1 / sd**2)]
    for y in (np.tanh(z), z / np.maximum(np.sqrt((z**2).sum(1)), 1e-9)[:, None]):
        q = y.T @ y / len(y)
        size = np.sqrt(np.diag(q) + 1e-6)
        corr = q / np.outer(size, size)
        np.fill_diagonal(corr, 1)
        starts.append(np.linalg.inv(corr * np.outer(sd, sd)))
    distance = lambda m, inv: np.einsum("ij,jk,ik->i", x - m, inv, x - m)
    best = None
    for inv in starts:
        mm, was = m, np.inf
        while True:
            d2 = distance(mm, inv)
            near = x[d2 <= at(d2, 0.75)]
            mm, cov = near.mean(0), np.cov(near.T, bias=True) * factor
            cov[np.arange(dim), np.arange(dim)] = np.maximum(np.diag(cov) + ridge**2, least**2)
            inv, det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
            if best is None or det < best[0]:
                best = (det, mm, inv)
            if not det < was - quality_rules.TOLERANCE:
                break
            was = det
    return distance(*best[1:])


def test_quality_verdicts_against_numpy(spark, monkeypatch):
    """``d2`` and ``kept`` of every row equal a numpy estimate per cell, large, pooled by
    language and pooled over all, whether estimates are sent to the rows or shuffled."""
    rnd = random.Random(77)
    rows = []
    for i in range(900):
        lang, source = rnd.choice([("en", "a")] * 5 + [("en", "b"), ("de", "c"), ("de", None), (None, "a"), ("fr", "x")])
        lines = [" ".join(rnd.choice(VOCAB) + rnd.choice(["", "", "", "!", "X"]) for _ in range(rnd.randint(3, 15))) for _ in range(rnd.randint(8, 20))]
        text = "\n".join(lines + rnd.choices(lines, k=rnd.choice([0, 0, 1, 2, 9])))
        rows.append((i, rnd.choice([text] * 30 + [None, "", "### " * 90, text.upper()]), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    least = 120
    good, cells = {}, collections.Counter((lang or "", source or "") for _, t, lang, source in rows if not _failed(t))
    pooled = collections.Counter()
    for (lang, _), n in cells.items():
        pooled[lang] += n if n < least else 0
    for i, t, lang, source in rows:
        if not _failed(t):
            pair = (lang or "", source or "")
            good.setdefault(pair if cells[pair] >= least else pair[0] if pooled[pair[0]] >= least else None, []).append((i, _vector(t)))
    assert {type(k) for k in good} == {tuple, str, type(None)}
    cut, want = quality_rules.chi2_quantile(1 - quality_rules.BEYOND, quality_rules.DIM), {}
    for members in good.values():
        want.update(zip((i for i, _ in members), _robust(np.array([v for _, v in members]))))
    for pairs in (quality_rules.PAIRS, 0):
        monkeypatch.setattr(quality_rules, "PAIRS", pairs)
        got = _by_id(quality_rules.judge(docs, min_cell=least))
        assert len(got) == len(rows)
        for i, t, _, _ in rows:
            assert (got[i]["d2"] is None) == _failed(t)
            assert got[i]["kept"] == (not _failed(t) and bool(want[i] <= cut))
            assert _failed(t) or got[i]["d2"] == pytest.approx(want[i], rel=1e-6, abs=1e-9)
    assert {r["kept"] for r in got.values() if not r["base_failed"]} == {True, False}


def _failed(text):
    n, *_, rep = _base(text)
    return n < 50 or 100 * rep > 50 * n
