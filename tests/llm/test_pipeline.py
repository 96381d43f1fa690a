"""The pipeline's stages take effect, keep the columns, and handle empty tables."""

import corpus_pipeline
from tabsight.llm import decontaminate, pii, quality_rules, simhash
from tabsight.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    kept = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        got = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert len(got) == after.count()
        if name == "quality_rules":
            assert got == kept < ids
        elif name == "simhash":
            assert got == {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
        elif name == "decontamination":
            assert got == ids - {r["doc_id"] for r in decontaminate.contained(docs, table(spark, SF, "benchmark")).collect()}
        else:
            assert got == ids
        if name != "bpe":
            assert after.columns == columns
            docs, ids = after, got
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == ids


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _found string, _spans string, _row string, _key string, _gone string, _at string, row string, key string"


def _rows(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) + ("c",) * 8 for i, t in pairs], CLASH).coalesce(1)


def test_copies_go_by_row(spark):
    """Different texts under null and repeated ids all stay; of equal rows one does."""
    prose = [f"some words of text {i} that {i * 7} nobody {i * i} else has written {i + 3} so far" for i in range(9)]
    pairs = [(None, prose[0]), (None, prose[1]), (None, prose[2]), (None, prose[3]), (7, prose[4]), (7, prose[5]), (8, prose[6])]
    copies = [(8, prose[6]), (8, prose[6]), (None, prose[0]), (9, prose[4]), (None, prose[5])]
    docs = _rows(spark, pairs + copies)
    kept = simhash.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted(pairs, key=str)


def test_contamination_goes_by_row(spark):
    """Only the rows that hold an item go, in one block of items or in many."""
    item = "one two three four five six seven"
    clean = [(None, "clean text of no id"), (None, "other clean text"), (7, "clean again"), (3, "")]
    docs = _rows(spark, [*clean, (None, f"before {item} after"), (7, item)])
    items = spark.createDataFrame([(1, item), (2, "not to be found in there at all"), (3, None)], "item_id long, text string")
    for block_bytes in (1 << 20, 80):
        kept = decontaminate.without_items(docs, items, block_bytes=block_bytes)
        assert kept.columns == docs.columns
        assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_short_items_are_all_found(spark):
    """Items of five to eight words deep in long texts."""
    import random

    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(5000)]
    items = [[rnd.choice(vocab) for _ in range(rnd.randint(5, 8))] for _ in range(400)]
    texts = [(i, " ".join([*(rnd.choice(vocab) for _ in range(rnd.randint(0, 400))), *item, *(rnd.choice(vocab) for _ in range(60))])) for i, item in enumerate(items)]
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(_rows(spark, texts), bench).collect()}
    assert got >= {(i, i) for i in range(len(items))}


def test_spans_are_covered_beside_clashing_columns(spark):
    docs = _rows(spark, [(None, "mail to a.b@example.com now"), (1, "nothing here"), (1, "10.0.0.1 it is")])
    for trusted_bytes in (1 << 20, -1):
        got = pii.redact(docs, trusted_bytes=trusted_bytes)
        assert got.columns == docs.columns
        assert sorted((r["text"], r["_spans"]) for r in got.collect()) == [("<IP> it is", "c"), ("mail to <EMAIL> now", "c"), ("nothing here", "c")]
