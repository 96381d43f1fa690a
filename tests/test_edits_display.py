"""Edit application, position conversion (with CRLF) and display strings."""

import pytest
from pyspark.sql import functions as F

from tabsight.functions import display as dsp
from tabsight.functions.commands import make_action, pos, rng
from tabsight.operators import edits as ed

TEXT = "ab\r\ncd\nef"  # lines: "ab" (CRLF), "cd" (LF), "ef"


def _one(spark, cols):
    return spark.createDataFrame([(TEXT,)], "text string").select("text", *cols)


def test_offset_position_round_trip(spark):
    d = _one(spark, [F.lit(o).alias(f"o{o}") for o in range(len(TEXT) + 2)])
    p = ed.offsets_to_positions(d, "text", {f"p{o}": f"o{o}" for o in range(len(TEXT) + 2)}).first()
    got = [(p[f"p{o}"]["line"], p[f"p{o}"]["ch"]) for o in range(len(TEXT) + 2)]
    # offset 2 and 3 sit on the CRLF: end of line 0; past the end clamps.
    assert got == [(0, 0), (0, 1), (0, 2), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 2)]
    o = ed.positions_to_offsets(
        d.withColumn("l", F.lit(1)).withColumn("c", F.lit(1)).withColumn("l9", F.lit(9)).withColumn("c9", F.lit(99))
        .withColumn("z", F.lit(0)),
        "text",
        {"a": ("l", "c"), "b": ("l9", "z"), "c2": ("l", "c9")},
    ).first()
    assert (o["a"], o["b"], o["c2"]) == (5, len(TEXT), 6)


@pytest.mark.parametrize(
    "action,expected",
    [
        (lambda: make_action("editInsert", position=pos(F.lit(1), F.lit(1)), text=F.lit("X")), "ab\r\ncXd\nef"),
        (lambda: make_action("editDelete", range_=rng(pos(F.lit(0), F.lit(0)), pos(F.lit(1), F.lit(0)))), "cd\nef"),
        (lambda: make_action("editReplace", range_=rng(pos(F.lit(1), F.lit(0)), pos(F.lit(2), F.lit(0))), text=F.lit("Z\n")), "ab\r\nZ\nef"),
        (lambda: make_action("editInsert", position=pos(F.lit(3), F.lit(0)), text=F.lit("\nT\n")), TEXT + "\nT\n"),
        (lambda: make_action("terminalSendText", text=F.lit("ls")), TEXT),
    ],
)
def test_apply(spark, action, expected):
    d = spark.createDataFrame([(TEXT,)], "text string").withColumn("action", action())
    assert ed.apply_action(d).first()["new_text"] == expected


def test_viewport(spark):
    text = "\n".join(f"l{i}" for i in range(40))
    d = spark.createDataFrame([(1, text, 5)], "doc_id int, text string, cursor_line int")
    rows = ed.viewport_lines(d, radius=3).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == ["l2", "l3", "l4", "l5", "l6", "l7", "l8"]


def test_display(spark):
    d = spark.createDataFrame([("a\r\nb\tc" + "x" * 100, "C:\\dir\\f.py", "/a/b/", "a  b\n", " a b")],
                              "t string, p string, q string, o string, n string")
    r = d.select(
        dsp.truncate_text(F.col("t"), 10).alias("t10"),
        dsp.path_basename(F.col("p")).alias("b1"),
        dsp.path_basename(F.col("q")).alias("b2"),
        dsp.significant_diff(F.col("o"), F.col("n")).alias("sig"),
    ).first()
    assert r["t10"] == "a↵b\tcxxxx…"
    assert r["b1"] == "f.py" and r["b2"] == "/a/b/"
    assert r["sig"] is False


def test_action_strings(spark):
    a = make_action("editDelete", range_=rng(pos(F.lit(2), F.lit(0)), pos(F.lit(4), F.lit(0))))
    r = spark.range(1).select(
        dsp.action_summary(a).alias("s"), dsp.action_detail(a).alias("d"), dsp.action_description(a).alias("x")
    ).first()
    assert r["s"] == "Delete lines 3–5" and r["d"] == "Lines 3 to 5"
    assert r["x"]["title"] == "Delete Text" and r["x"]["body"] == "Lines 3–5"


def test_start_after_end_is_normalised(spark):
    # sed '5,2d' parses to a range whose start is after its end; applying it
    # deletes the same text as the ordered range.
    from tabsight.functions.commands import with_action

    text = "\n".join(f"l{i}" for i in range(8))
    d = spark.createDataFrame([("sed -i '5,2d' /a.py", "/a.py", 8, 2, text)],
                              "raw string, active_path string, line_count int, last_line_len int, text string")
    a = with_action(d)
    r = a.select("action.range.start.line", "action.range.end.line").first()
    assert tuple(r) == (4, 2)
    out = ed.apply_action(a).first()["new_text"]
    assert out == "\n".join(["l0", "l1", "l4", "l5", "l6", "l7"])


def test_utf16_units(spark):
    """Every unit offset of a text with characters of two units, against Python's own UTF-16."""
    text = "a\U0001F600b\r\n\U0001F680\U0001F680c\n\u00e9"
    units = len(text.encode("utf-16-be")) // 2
    lines = ["a\U0001F600b", "\U0001F680\U0001F680c", "\u00e9"]
    starts = [0, 6, 12]  # units before each line
    width = lambda s: len(s.encode("utf-16-be")) // 2
    want = []
    for o in range(units + 2):
        line = max(i for i, s in enumerate(starts) if s <= min(o, units))
        inside = min(o, units) - starts[line]
        want.append((line, max(width(lines[line][:k]) for k in range(len(lines[line]) + 1) if width(lines[line][:k]) <= inside)))
    names = range(units + 2)
    d = spark.createDataFrame([(text,)], "text string").select("text", *[F.lit(o).alias(f"o{o}") for o in names])
    p = ed.offsets_to_positions(d, "text", {f"p{o}": f"o{o}" for o in names}, utf16_units=True)
    r = p.first()
    assert [(r[f"p{o}"]["line"], r[f"p{o}"]["ch"]) for o in names] == want
    b = p.select("text", *[F.col(f"p{o}.line").alias(f"l{o}") for o in names], *[F.col(f"p{o}.ch").alias(f"c{o}") for o in names])
    r = ed.positions_to_offsets(b, "text", {f"b{o}": (f"l{o}", f"c{o}") for o in names}, utf16_units=True).first()
    assert [r[f"b{o}"] for o in names] == [starts[line] + ch for line, ch in want]
    empty = spark.createDataFrame([("",), (None,)], "text string").withColumn("o", F.lit(3))
    assert [x["p"] and tuple(x["p"]) for x in ed.offsets_to_positions(empty, "text", {"p": "o"}, utf16_units=True).collect()][0] == (0, 0)


@pytest.mark.parametrize("utf16_units,expected", [(True, "a\U0001F600Xb\n\U0001F680d"), (False, "a\U0001F600bX\n\U0001F680d")])
def test_apply_counts_units(spark, utf16_units, expected):
    """The same logged position is another place when its characters count units."""
    d = spark.createDataFrame([("a\U0001F600b\n\U0001F680d",)], "text string")
    d = d.withColumn("action", make_action("editInsert", position=pos(F.lit(0), F.lit(3)), text=F.lit("X")))
    assert ed.apply_action(d, utf16_units=utf16_units).first()["new_text"] == expected
    r = rng(pos(F.lit(0), F.lit(1)), pos(F.lit(1), F.lit(2)))
    d = d.withColumn("action", make_action("editDelete", range_=r))
    assert ed.apply_action(d, utf16_units=True).first()["new_text"] == "ad"


def test_positions_in_a_range_equal_those_in_the_text(spark):
    """Every offset of every range, line ends of two characters cut by it included."""
    from tabsight.operators import diffs as D

    text = "ab\r\nc\rd\n\r\n\nef\r"
    rows = [(text, a, text[a:b], o) for a in range(len(text) + 1) for b in range(a, len(text) + 1) for o in range(b - a + 1)]
    d = spark.createDataFrame(rows, "text string, range_start int, old_text string, o int")
    d = ed.offsets_to_positions(d.withColumn("whole", F.col("range_start") + F.col("o")), "text", {"want": "whole"})
    got = D.to_positions(D.with_range(d), {"got": F.col("o")})
    assert got.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0 and "text" in got.columns
    # Against the text split into lines.
    lines = ["ab\r\n", "c\r", "d\n", "\r\n", "\n", "ef\r", ""]
    for r in got.where("range_start = 0").select("o", "got").distinct().collect():
        line = max(i for i in range(len(lines)) if len("".join(lines[:i])) <= r["o"])
        ch = min(r["o"] - len("".join(lines[:line])), len(lines[line].rstrip("\r\n")))
        assert tuple(r["got"]) == (line, ch)


def test_offsets_of_lines_with_and_without_carriage_returns(spark):
    rows = [(t, line, ch) for t in ("ab\ncd\n\nef", "ab\r\ncd\r\ref", "", "\n", None) for line in (None, -1, 0, 1, 2, 3, 9) for ch in (None, -1, 0, 1, 2, 99)]
    d = spark.createDataFrame(rows, "text string, line int, ch int")
    from tabsight.functions.positions import line_pieces, offset_at

    t = F.col("text")
    got = ed.positions_to_offsets(d, "text", {"got": ("line", "ch")}).withColumn("want", offset_at(t, line_pieces(t), F.col("line"), F.col("ch")))
    assert got.where(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


def test_collapsed_white_space(spark):
    from tabsight.functions.jscompat import js_collapse_ws

    cases = {"a b": "a b", "a  b": "a b", "  a\t b\n\n c ": "a b c", "a   b\tc": "a b c", "\t": "", "a\nb": "a b"}
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", js_collapse_ws("t").alias("c"))
    assert {r["t"]: r["c"] for r in d.collect()} == cases


def test_only_texts_that_may_hold_a_form_are_parsed(spark):
    """What the cheap look leaves out is never an edit of the form; a think block in the
    midst of a command is cut out first."""
    from tabsight.functions import commands as cm

    scripts = {"delete": "1,2d", "replace": "1,2c\\\nx", "insert": "3i\\\nx", "append": "$a\\\nx"}
    raws = [f"sed -i '{s}' /a.py" for s in scripts.values()]
    raws += [f"Plan.\n{cm.BT}bash\n{r}\n{cm.BT}" for r in raws[:4]]
    raws += [r[:k] + "<Think>no\n</THINK>" + r[k:] for r in raws[:4] for k in range(len(r) + 1)]
    raws += ["cat -n /a.py", "sed -i '1,2c x' /a.py", "", None]
    df = spark.createDataFrame([(i, r, "/a.py") for i, r in enumerate(raws)], "i int, raw string, active_path string")
    looks = [cm.may_hold_form(F.col("raw"), (form,)).alias(f"may_{form}") for form in scripts]
    parsed = cm.with_sed_form(cm.with_command(df)).select("raw", "sed_form", *looks).collect()
    for form in scripts:
        held = [r[f"may_{form}"] for r in parsed if r["sed_form"] == form]
        assert len(held) > 2 and all(held)
    left = {r["raw"] for r in parsed if r["may_replace"]}
    assert not left & {raws[0], raws[2], raws[3], *raws[-4:]}


def test_edits_cut_at_bytes_equal_edits_of_characters(spark):
    """Every position of texts with characters of one to four bytes, and the difference told from the changed stretch."""
    import re

    from tabsight.functions.positions import bytes_at, feeds, line_pieces, offset_at

    texts = ["ab\n\u00e9\U0001F600\n\n \t\u20ac", "\u00e9\r\n\U0001F600 b\rc", "", "\n", " \u3000\n y"]
    inserted = ["", " ", "\n\u3000", "\U0001F600", " a"]

    def offset(text, line, ch):
        pieces = re.split(r"(?<=\n)|(?<=\r)(?!\n)", text)
        if line >= len(pieces):
            return len(text)
        return sum(map(len, pieces[:line])) + min(ch, len(pieces[line].rstrip("\r\n")))

    places = [(line, ch) for line in range(5) for ch in (0, 1, 3)]
    rows = [(t, "editInsert", *p, *p, i, t[: offset(t, *p)] + i + t[offset(t, *p):]) for t in texts for p in places for i in inserted]
    for t in texts:
        for p in places:
            for q in places:
                a, b = sorted((offset(t, *p), offset(t, *q)))
                rows += [(t, "editDelete", *p, *q, None, t[:a] + t[b:])]
                rows += [(t, "editReplace", *p, *q, i, t[:a] + i + t[b:]) for i in inserted[1::2]]
    rows += [(None, "editInsert", 0, 0, 0, 0, "x", None), ("a", "terminalSendText", 0, 0, 0, 0, "ls", "a"), ("a", "editInsert", 0, 0, 0, 0, None, None)]
    d = spark.createDataFrame(rows, "text string, kind string, l1 int, c1 int, l2 int, c2 int, ins string, want string")
    d = d.withColumn("n", F.monotonically_increasing_id())
    one, two = pos(F.col("l1"), F.col("c1")), pos(F.col("l2"), F.col("c2"))
    made = [make_action(k, position=one, range_=rng(one, two), text=F.col("ins")) for k in ("editInsert", "editDelete", "editReplace", "terminalSendText")]
    d = d.withColumn("action", F.coalesce(*[F.when(F.col("kind") == m, x) for m, x in zip(("editInsert", "editDelete", "editReplace", "terminalSendText"), made)]))
    t, n = F.col("text"), F.col("new_text")
    out = ed.apply_action(d, changed="changed")
    out = out.withColumn("sig", dsp.significant_diff(t, n, F.col("changed"))).withColumn("whole", dsp.significant_diff(t, n))
    assert out.count() == len(rows) and {True, False, None} == {r[0] for r in out.select("sig").distinct().collect()}
    assert out.where(~n.eqNullSafe(F.col("want")) | ~F.col("sig").eqNullSafe(F.col("whole"))).collect() == []
    points = offset_at(t, line_pieces(t), F.col("l1"), F.col("c1"))
    place = bytes_at(t, feeds(t), F.col("l1"), F.col("c1"))
    assert d.where(place != F.octet_length(F.left(t, points.cast("int")))).collect() == []


def test_line_statistics(spark):
    import re

    from tabsight.functions.jscompat import last_line_len, line_count

    texts = ["", "a", "a\n", "a\nbc", "\n\n", "a\r\nb\rcd", "\u00e9\n\U0001F600\U0001F600", "a\r"]
    d = spark.createDataFrame([(x,) for x in [*texts, None]], "t string").select("t", line_count("t"), last_line_len("t"))
    want = {x: (len(re.split(r"\r\n|\n|\r", x)), len(re.split(r"\r\n|\n|\r", x)[-1])) for x in texts}
    assert {r[0]: tuple(r)[1:] for r in d.collect() if r[0] is not None} == want
