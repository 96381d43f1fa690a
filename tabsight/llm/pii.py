"""Personal data: fixed patterns as seeds, then bootstrapped contextual patterns.

Four base kinds are found by fixed expressions. These spans, and long
lower-case hexadecimal keys as seeds of a fifth kind (``secret``), are the seed
instances. Words with a digit that no base span touches are candidates. The two
words before a mention are its lexical pattern. Spark scores the graph of
patterns and instances in rounds, until no pattern gains: a pattern's confidence
in a kind is the mean score of its distinct instances, where a seed has 1 and a
candidate the best confidence among the *other* trusted patterns it stands
behind. A pattern with enough confidence and enough distinct instances that are
seeds or so discovered is trusted; candidates behind it become spans of that kind.

Null texts count as empty; every input row gives one result row; repeated rows
give the same spans; words without neighbours have the pattern of a text's
start. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import free_name, stored

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = KINDS[:4]
#: Least confidence and least number of distinct known instances of a pattern;
#: gain in the sum of confidences that ends the rounds.
CONFIDENCE, SUPPORT, TOLERANCE = 0.75, 3, 1e-6
#: Trusted patterns up to this size go to the tasks whole; more are joined.
TRUSTED_BYTES = 16 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![0-9a-zA-Z])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{40}(?![0-9a-zA-Z])")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'`()[]{}<>,;:.!?#$%&*|"
_ASCII_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base kinds, sorted."""
    out = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            s = m.start()
            while s > last and text[s - 1] in _LOCAL:
                s -= 1
            if s < m.start():
                out.append((s, 0, m.end()))
                last = m.end()
    if _ASCII_DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def _before(text: str, at: int) -> str:
    """The two words before a place, lower-cased and without marks at their ends;
    a word over 64 characters is named by its hash."""
    reach = 80
    while True:
        low = max(0, at - reach)
        found = _WORD.findall(text, low, at)
        if low:
            found = found[1:]  # may be cut
        words = [w for w in (w.strip(_EDGE).lower() for w in found[-2:]) if w]
        if len(words) < 2:
            words = [w for w in (w.strip(_EDGE).lower() for w in found) if w][-2:]
        if len(words) == 2 or not low:
            break
        reach *= 8
    words = [w if len(w) <= 64 else f"~{xxhash.xxh64_hexdigest(w.encode(), 42)}" for w in words]
    return " ".join(["^"] * (2 - len(words)) + words)


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, int]]:
    """``(start, end, kind or -1, pattern, value hash)`` of seeds and candidates."""
    if not _ASCII_DIGIT.search(text) and not spans:
        return []
    found = [(s, e, k) for s, k, e in spans]
    taken = sorted((s, e) for s, e, _ in found)
    for m in _SECRET.finditer(text):
        found.append((m.start(), m.end(), 4))
        taken.append((m.start(), m.end()))
    taken.sort()
    i, reach = 0, -1
    for m in _DIGIT_WORD.finditer(text):
        word = m[0]
        s = m.start() + len(word) - len(word.lstrip(_EDGE))
        e = m.end() - len(word) + len(word.rstrip(_EDGE))
        while i < len(taken) and taken[i][0] < m.end():
            reach = max(reach, taken[i][1])
            i += 1
        if e - s >= 6 and reach <= m.start():
            found.append((s, e, -1))
    return [(s, e, k, _before(text, s), _signed(xxhash.xxh64_intdigest(text[s:e].lower().encode(), 42))) for s, e, k in sorted(found)]


_DIGIT_WORD = re.compile(r"[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_MENTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("pattern", pa.string()), ("value", pa.int64())])
SCAN = "doc_id long, key long, counts array<long>, base string, mentions array<struct<start:int,end:int,kind:int,pattern:string,value:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and mentions of every text; ``key`` is the text's XXH64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, counts, base, seen = [], [], [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                spans = base_spans(text)
                key.append(_signed(xxhash.xxh64_intdigest(text.encode(), 42)))
                counts.append([sum(k == x for _, k, _ in spans) for x in range(4)])
                base.append(joined(spans))
                seen.append([dict(zip(("start", "end", "kind", "pattern", "value"), m)) for m in mentions(text, spans)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(key, pa.int64()), pa.array(counts, pa.list_(pa.int64())), pa.array(base, pa.string()), pa.array(seen, pa.list_(_MENTION))],
                ["doc_id", "key", "counts", "base", "mentions"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCAN)


def trusted_patterns(seen: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """``pattern, kind, confidence`` of the patterns that hold when the rounds of
    scoring have settled. ``seen``: kind, pattern, value of each mention. Only
    trusted patterns lend their confidence, and none to itself, so confidences
    only rise from seeds and a pattern's own candidates never raise it."""
    edges = stored(seen.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(f"n >= {support}")
    # No pattern has the name '', which stands for the seeds.
    seeds = stored(edges.where("kind >= 0").select("value", "kind").distinct().select("value", "kind", F.lit(1.0).alias("confidence"), F.lit("").alias("pattern")), "pii-seeds")
    open_ = stored(edges.join(size, "pattern").select("pattern", "value", "n"), "pii-open")
    offered, mark = seeds, None
    while True:
        best = offered.groupBy("value", "kind").agg(F.max(F.struct("confidence", "pattern")).alias("best"))
        others = offered.join(best, ["value", "kind"]).where("pattern != best.pattern").groupBy("value", "kind").agg(F.max("confidence").alias("second"))
        scores = best.join(others, ["value", "kind"], "left")
        score = F.when(F.col("best.pattern") != F.col("pattern"), F.col("best.confidence")).otherwise(F.coalesce("second", F.lit(0.0)))
        scored = open_.join(scores, "value").withColumn("score", score)
        good = scored.groupBy("pattern", "n", "kind").agg(F.sum("score").alias("mass"), F.sum(F.when(F.col("score") >= confidence, 1).otherwise(0)).alias("known"))
        held = good.select("pattern", "kind", "known", (F.col("mass") / F.col("n")).alias("confidence")).where(f"known >= {support} AND confidence >= {confidence}").drop("known")
        trusted = stored(held, "pii-scores")
        n, total = trusted.agg(F.count("*"), F.coalesce(F.sum("confidence"), F.lit(0.0))).first()
        if n == 0 or mark is not None and n == mark[0] and total - mark[1] < TOLERANCE:
            break
        mark = (n, total)
        offered = seeds.unionByName(open_.join(trusted, "pattern").select("value", "kind", "confidence", "pattern"))
    best = trusted.groupBy("pattern").agg(F.max(F.struct("confidence", -F.col("kind"))).alias("b"))
    return best.select("pattern", (-F.col("b.col2")).alias("kind"), F.col("b.confidence").alias("confidence"))


def _scanned(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scan of ``docs``, its mentions one by one, and the trusted patterns."""
    scanned = stored(scan(docs), "pii-scan")
    seen = scanned.select("doc_id", "key", F.explode("mentions").alias("m")).select("doc_id", "key", "m.*")
    return scanned, seen, stored(trusted_patterns(seen.select("kind", "pattern", "value")), "pii-trusted")


def find(docs: DataFrame) -> DataFrame:
    """Per input row: ``doc_id, key``, the base counts and ``base`` spans, and
    ``added``, the spans that seeds' and trusted patterns' contexts add."""
    return _found(*_scanned(docs))


def _found(scanned: DataFrame, seen: DataFrame, trusted: DataFrame) -> DataFrame:
    secret = seen.where("kind = 4").select("doc_id", "key", "start", "end", "kind")
    found = seen.where("kind = -1").drop("kind").join(trusted.select("pattern", "kind"), "pattern").select("doc_id", "key", "start", "end", "kind")
    added = secret.unionByName(found).groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("added"))
    rows = scanned.drop("mentions").withColumnRenamed("doc_id", "d").withColumnRenamed("key", "k")
    match = (F.col("d").eqNullSafe(added["doc_id"])) & (F.col("k") == added["key"])
    return rows.join(added, match, "left").select(F.col("d").alias("doc_id"), F.col("k").alias("key"), "counts", "base", "added")


def all_spans() -> str:
    """SQL for base and added spans in one string, by start, then kind."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    base = f"transform(filter(split(base, ','), x -> x != ''), x -> struct(CAST(split(x, ':')[1] AS INT) AS start, CAST(array_position(array({kinds}), split(x, ':')[0]) - 1 AS INT) AS kind, CAST(split(x, ':')[2] AS INT) AS end))"
    each = f"concat(element_at(array({kinds}), x.kind + 1), ':', x.start, ':', x.end)"
    return f"array_join(transform(array_sort(concat({base}, coalesce(added, array()))), x -> {each}), ',')"


def report(docs: DataFrame) -> DataFrame:
    return find(docs).select(
        "doc_id", *(F.col("counts")[i].alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2("base", 256).alias("base_sha256"), F.expr(all_spans()).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )


def cover(text: str, spans: str) -> str:
    """``text`` with each span replaced by its kind in angle brackets; spans that
    overlap are replaced together under the first one's kind."""
    out, at = [], 0
    for x in spans.split(",") if spans else ():
        kind, s, e = x.split(":")
        if int(s) >= at:
            out += [text[at : int(s)], f"<{kind.upper()}>"]
        at = max(at, int(e))
    return "".join(out) + text[at:]


def spans_of(text: str, trusted: dict[str, int]) -> str:
    """All spans of a text, given the kind of each trusted pattern."""
    base = base_spans(text)
    named = ((s, k if k >= 0 else trusted.get(pattern, -1), e) for s, e, k, pattern, _ in mentions(text, base) if k in (-1, 4))
    return joined(sorted(base + list({x for x in named if x[1] >= 0})))


def redact(docs: DataFrame, trusted_bytes: int = TRUSTED_BYTES) -> DataFrame:
    """The documents with all spans covered; other columns as they are, and
    ``n_chars``, where there is one, counted anew. Where the trusted patterns
    have at most ``trusted_bytes``, each task looks for them in its own texts and
    no text is shuffled; otherwise the spans are joined to the documents."""
    scanned, seen, trusted = _scanned(docs)
    size = trusted.agg(F.sum(F.octet_length("pattern") + 64)).first()[0] or 0
    small, known = size <= trusted_bytes, {}
    name = free_name("_spans", docs)
    if small:
        known = {r["pattern"]: r["kind"] for r in trusted.select("pattern", "kind").collect()}
        both = docs
    else:
        at = free_name("_at", docs)
        spans = _found(scanned, seen, trusted).select(F.struct("doc_id", "key").alias(at), F.expr(all_spans()).alias(name)).where(F.col(name) != "").distinct()
        rows = docs.withColumn(at, F.struct(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")))
        both = rows.join(stored(spans, "pii-spans"), at, "left").select(*docs.columns, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [spans_of(t, known) if t else "" for t in texts] if small else batch.column(name).to_pylist()
            texts = [t if not s else cover(t, s) for t, s in zip(texts, spans)]
            fields = {f.name: batch.column(f.name) for f in batch.schema if f.name != name}
            fields["text"] = pa.array(texts, pa.string())
            if "n_chars" in fields:
                fields["n_chars"] = pa.array([None if t is None else len(t) for t in texts], fields["n_chars"].type)
            yield pa.RecordBatch.from_pydict(fields)

    return both.mapInArrow(run, docs.schema)
