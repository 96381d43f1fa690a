"""Merkle manifest of a dataset: one hash tree per source, one tree over sources.

Slot pivot: the children of a parent are spread into ``FANOUT`` columns by
conditional aggregates over the parent's run (``max(when(slot = i, node))``).
Concatenating the columns and hashing gives the parent; leaving out the own slot
column gives a node's siblings on either side.

``BAND`` levels are pivoted per shuffle: rows are dealt out once by (tree, number
of their subtree of FANOUT**BAND leaves) and sorted by the digits of their
position, which is the order every level's runs need. A group is never larger
than such a subtree, whatever the size of a source. Proofs are made where the leaf
rows are, so no shuffle carries them except the few from subtree roots upward.

Defined results: a null field is hashed as ``-``; null ids come first in their
source, null sources first of all; repeated rows are leaves of their own, and
leaves of one id are ordered by their hash; a null id counts as '' for tampering;
an empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.common import crc_mod, stored

#: Children per parent, the fields of a leaf in order.
FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels pivoted per shuffle: subtrees of 729 nodes.
BAND = 6
SUBTREE = FANOUT**BAND


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field of a leaf: its length in UTF-8 bytes, a colon and itself; null is '-'."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return sha(*[field(text if name == "text" else F.col(name)) for name in FIELDS])


def positions(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with its place ``at`` (from 0) in the order of ``keys``: range
    partitions are written in order, numbered inside, and shifted by the row
    counts of those before. The only window without a key is over one row per
    partition. Equal rows are dealt out by their number in the input."""
    rows = stored(
        df.withColumn("_n", F.monotonically_increasing_id())
        .repartitionByRange(*keys, "_n")
        .sortWithinPartitions(*keys, "_n")
        .withColumn("_n", F.monotonically_increasing_id()),
        name,
    ).withColumn("_part", F.shiftright("_n", 33))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")
    placed = rows.join(parts.withColumn("_before", before), "_part")
    return placed.withColumn("at", F.col("_before") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_n", "_rows", "_before")


def band(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, pos, n, node, ...) with ``up``, the node ``BAND`` levels up or
    the tree's root if that comes first, the number ``chunk`` of that node, and
    ``steps``, the siblings passed on the way as (left, right) texts from below
    upward. ``n`` is the node count of the tree."""
    df = nodes.withColumn("chunk", F.expr(f"pos div {SUBTREE}")).withColumn("up", F.col("node"))
    df = df.withColumns({f"d{i}": F.expr(f"cast(pos div {FANOUT**i} % {FANOUT} AS int)") for i in range(BAND)})
    order = ["tree", "chunk", *[f"d{i}" for i in reversed(range(BAND))]]
    df = df.repartition("tree", "chunk").sortWithinPartitions(*order)
    slots = [f"c{j}" for j in range(FANOUT)]
    for i in range(BAND):
        run = Window.partitionBy(*order[: 1 + BAND - i])
        slot, more = F.col(f"d{i}"), F.col("n") > FANOUT**i
        df = df.withColumns({c: F.coalesce(F.max(F.when(slot == j, F.col("up"))).over(run), F.lit("")) for j, c in enumerate(slots)})
        left = F.concat(*[F.when(slot > j, F.col(c)).otherwise("") for j, c in enumerate(slots)])
        right = F.concat(*[F.when(slot < j, F.col(c)).otherwise("") for j, c in enumerate(slots)])
        step = F.when(more, F.struct(left.alias("left"), right.alias("right")))
        df = df.withColumns({f"s{i}": step, "up": F.when(more, sha(*slots)).otherwise(F.col("up"))})
    steps = F.filter(F.array(*[f"s{i}" for i in range(BAND)]), lambda s: s.isNotNull())
    return df.withColumn("steps", steps).select(*nodes.columns, "chunk", "up", "steps")


def climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """``nodes`` and, band by band, the nodes above them; the last table has one row
    per tree, its root. ``most`` is the node count of the largest tree."""
    levels = [nodes]
    while most > 1 or len(levels) == 1:
        above = band(levels[-1]).groupBy("tree", F.col("chunk").alias("pos"))
        above = above.agg(F.first("up").alias("node"), F.max(F.ceil(F.col("n") / SUBTREE)).alias("n"))
        levels.append(stored(above, "merkle-nodes"))
        most = -(-most // SUBTREE)
    return levels


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest table of ``levels`` with ``steps`` from its nodes all the way up:
    what ``tops`` (tree, pos, steps, ...) has for the last table is handed down."""
    for nodes in reversed(levels[:-1]):
        tops = tops.withColumnsRenamed({"pos": "chunk", "steps": "_higher"})
        kept = [c for c in tops.columns if c not in ("tree", "chunk", "_higher")]
        here = band(nodes).join(tops, ["tree", "chunk"])
        columns = nodes.columns if nodes is levels[0] else ["tree", "pos"]
        tops = here.select(*columns, F.concat("steps", "_higher").alias("steps"), *kept)
    return tops


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, and the root
    folded from the leaf after tampering (line feeds deleted from the text of every
    row whose id has an even crc32), with ``verified`` telling whether it is the root."""
    tampered = F.when(crc_mod(F.col("doc_id"), 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf(F.col("text")).alias("node"), leaf(tampered).alias("now"))
    placed = positions(stored(leaves, "merkle-leaves"), ["source", "doc_id", "node"], "merkle-order")
    sources = placed.groupBy("source").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    sources = stored(positions(sources, ["source"], "merkle-sources").withColumnRenamed("at", "tree"), "merkle-trees")
    most, trees = sources.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    own = sources.withColumnRenamed("source", "_source")
    placed = placed.join(own, F.col("source").eqNullSafe(F.col("_source"))).withColumn("pos", F.col("at") - F.col("first"))
    inside = climb(placed.select("tree", "pos", "n", "node", "now", "doc_id"), most)

    tops = inside[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), "node")
    over = climb(tops, trees)
    none = F.array().cast("array<struct<left:string,right:string>>")
    over = descend(over, over[-1].select("tree", "pos", none.alias("steps"), F.col("node").alias("root")))
    over = stored(over.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "steps", F.col("node").alias("subroot"), "root"), "merkle-subroots")

    out = descend(inside, over)
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
    folded = F.aggregate("steps", F.col("now"), lambda node, s: sha(s["left"], node, s["right"]))
    out = out.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
