"""Replayed edits equal a plain replay, for any slice width and fan."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsight.functions import deltas as dl
from tabsight.operators.replay import replay_edits

EDIT = st.tuples(st.integers(0, 12), st.integers(0, 6), st.text("abé😀", max_size=4))


def plain(text, edits):
    for o, m, t in edits:
        o = min(o, len(text))
        text = text[:o] + t + text[o + m :]
    return text


@settings(max_examples=300, deadline=None)
@given(st.lists(EDIT, min_size=1, max_size=12), st.integers(0, 12), st.text("xyz", max_size=10))
def test_lengths_and_deltas_compose(edits, cut, text):
    lengths = [dl.edit_lengths(o, m, len(t)) for o, m, t in edits]
    whole = dl.together(lengths, dl.compose_lengths)
    for n in range(30):
        assert dl.length_after(whole, n) == len(plain("." * n, edits))
    assert whole[0][0] == 0 and whole[2][-1] == 1
    parts, at = [], len(text)
    for o, m, t in edits:
        o = min(o, at)
        parts.append(dl.edit_delta(o, min(m, at - o), t))
        at += len(t) - min(m, at - o)
    assert dl.apply_delta(text, dl.together(parts, dl.compose)) == plain(text, edits)
    a, b = parts[: cut % len(parts) + 1], parts[cut % len(parts) + 1 :]
    if b:  # any grouping
        left = dl.compose(dl.together(a, dl.compose), dl.together(b[::-1][::-1], dl.compose))
        assert dl.apply_delta(text, left) == plain(text, edits)


def test_a_long_history_stays_small():
    """Typing and deleting at one place: the composed values do not grow with it."""
    edits = [(5, 0, "a") if i % 2 == 0 else (5, 1, "") for i in range(2000)]
    assert sum(map(len, dl.together([dl.edit_delta(*e) for e in edits], dl.compose))) <= 3
    assert len(dl.together([dl.edit_lengths(o, m, len(t)) for o, m, t in edits], dl.compose_lengths)[0]) <= 3


@pytest.mark.parametrize(("slice_edits", "fan", "slice_ms"), [(1, 2, 10), (7, 3, 1000), (1024, 16, 10**9)])
def test_replay(spark, slice_edits, fan, slice_ms):
    rnd = random.Random(slice_edits)
    bases = {"a": "some text to start with\n" * 3, "b": "", "c": "😀é\n", "unused": "x"}
    rows, per, t = [], {}, 0
    for seq in range(240):
        t += rnd.choice([0, 3, 40])
        file = rnd.choice(["a", "a", "a", "b", "c", "new", None])
        for j in range(rnd.randint(1, 3)):
            edit = (rnd.choice([0, 1, 5, 30, 500]), rnd.choice([0, 0, 1, 4, 60]), rnd.choice(["", "z", "longer text", "é\n", None]))
            rows.append((file, t, seq, j, *edit))
            per.setdefault(file, []).append((edit[0], edit[1], edit[2] or ""))
    rows.append(("b", t + 1, 1000, 0, None, -3, "!"))
    per["b"].append((0, 0, "!"))
    rnd.shuffle(rows)
    edits = spark.createDataFrame(rows, "file string, ts long, seq long, change_idx long, offset int, length int, text string")
    base = spark.createDataFrame(list(bases.items()), "file string, text string")
    got = replay_edits(edits, base, slice_edits, fan, slice_ms)
    want = sorted((f, len(e), plain(bases.get(f, ""), e)) for f, e in per.items() if f is not None)
    assert sorted(map(tuple, got.collect())) == want


def test_replay_of_nothing(spark):
    edits = spark.createDataFrame([], "file string, ts long, seq long, change_idx long, offset int, length int, text string")
    assert replay_edits(edits, spark.createDataFrame([("a", "x")], "file string, text string")).collect() == []


def test_no_data_frame_per_file(spark, monkeypatch):
    """A call of Python per group makes many small files slow, whatever their edits."""
    from pyspark.sql import GroupedData

    def refuse(*args, **kwargs):
        raise AssertionError("a data frame per group")

    monkeypatch.setattr(GroupedData, "applyInPandas", refuse)
    rows = [(f"f{i % 300}", i, i, 0, i % 4, 1, str(i % 10)) for i in range(900)]
    edits = spark.createDataFrame(rows, "file string, ts long, seq long, change_idx long, offset int, length int, text string")
    base = spark.createDataFrame([(f"f{i}", "text") for i in range(200)], "file string, text string")
    for slice_edits, fan in ((1024, 16), (2, 2)):
        got = {r["file"]: (r["n_edits"], r["text"]) for r in replay_edits(edits, base, slice_edits, fan).collect()}
        assert len(got) == 300
        for i in range(300):
            text = plain("text" if i < 200 else "", [(r[4], r[5], r[6]) for r in rows if r[0] == f"f{i}"])
            assert got[f"f{i}"] == (3, text)
