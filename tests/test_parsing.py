"""Golden rows for command parsing (FIXTURES.md 2.2) and JavaScript text pins."""

import json

import pytest
from pyspark.sql import functions as F

from tabsight.functions import commands as cm
from tabsight.functions.jscompat import js_trim

BT = "`" * 3
NL = "\n"

# (raw, expected (kind, line, ch, end_line, end_ch, text, file_path) or None)
CASES = [
    ("sed -i '3,4d' /a.py", ("editDelete", 2, 0, 4, 0, None, None)),
    ("sed -i '9,10d' /a.py", ("editDelete", 8, 0, 9, 4, None, None)),
    ("sed -i '2,2c\\" + NL + "x' /a.py", ("editReplace", 1, 0, 2, 0, "x" + NL, None)),
    ("sed -E -i '5i\\" + NL + "y\\n' /a.py && cat -n /a.py", ("editInsert", 4, 0, None, None, "y" + NL, None)),
    ("sed -i '$a\\" + NL + "z' /a.py", ("editInsert", 10, 0, None, None, NL + "z" + NL, None)),
    ("sed -i '3,4d' /b.py", ("terminalSendText", None, None, None, None, "sed -i '3,4d' /b.py", None)),
    ("sed -i '2,2c\\" + NL + "a && b' /a.py", ("terminalSendText", None, None, None, None, "sed -i '2,2c\\" + NL + "a && b' /a.py", None)),
    ("sed -i '0,0d' /a.py", ("editDelete", 0, 0, 1, 0, None, None)),
    ("cat -n /a.py", ("showTextDocument", None, None, None, None, None, None)),
    ("cat -n /b.py", ("openFile", None, None, None, None, None, "/b.py")),
    ("cat -n /a.py | sed -n '1,9p'", ("setSelections", 4, 0, None, None, None, None)),
    ("cat -n /a.py | sed -n '90,99p'", ("setSelections", 9, 0, None, None, None, None)),
    ("cat -n /b.py | sed -n '90,99p'", ("openFile", 93, 0, None, None, None, "/b.py")),
    (BT + "BASH" + NL + "ls" + NL + BT, ("terminalSendText", None, None, None, None, "ls", None)),
    (BT + "python" + NL + "ls" + NL + BT, ("terminalSendText", None, None, None, None, "python" + NL + "ls", None)),
    (BT + "bash" + NL + NL + BT, ("terminalSendText", None, None, None, None, BT + "bash" + NL + NL + BT, None)),
    ("<think>a</think>", None),
    ("<think>a</think> ls", ("terminalSendText", None, None, None, None, "ls", None)),
    ("   ", None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, raw, "/a.py", 10, 4) for i, (raw, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, raw string, active_path string, line_count int, last_line_len int")
    out = cm.with_action(df).select("i", *cm.action_columns(F.col("action"))).orderBy("i").collect()
    return {r["i"]: r for r in out}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_command_golden(parsed, i):
    expected = CASES[i][1]
    r = parsed[i]
    if expected is None:
        assert r["kind"] is None
        return
    got = (r["kind"], r["line"], r["ch"], r["end_line"], r["end_ch"], r["text"], r["file_path"])
    assert got == expected


def test_no_document_goes_to_terminal(spark):
    df = spark.createDataFrame([("sed -i '3,4d' /a.py",)], "raw string").select(
        "raw", F.lit(None).cast("string").alias("active_path"), F.lit(None).cast("int").alias("line_count"),
        F.lit(None).cast("int").alias("last_line_len"),
    )
    r = cm.with_action(df).select("action.kind").first()
    assert r[0] == "terminalSendText"


def test_js_trim_unicode_whitespace(spark):
    df = spark.createDataFrame([("　﻿\t a b \n ",)], "s string")
    assert df.select(js_trim(F.col("s"))).first()[0] == "a b"


def test_sanitize_order(spark):
    df = spark.createDataFrame([("-A ls \\\\n x\\t",)], "s string")
    assert df.select(cm.sanitize_command(F.col("s"))).first()[0] == "ls " + NL + " x"


def test_huge_line_number_is_no_edit(spark):
    df = spark.createDataFrame([("sed -i '99999999999,2d' /a.py", "/a.py", 10, 4)],
                               "raw string, active_path string, line_count int, last_line_len int")
    assert cm.with_action(df).select("action.kind").first()[0] == "terminalSendText"


def test_edits_on_documents_equal_the_parse(spark):
    """Each golden that is an edit comes out with its document, the others do not."""
    from tabsight.operators.actions import edits_on_documents

    text = NL.join(["abcd"] * 10)
    rows = [(i, raw, "/a.py", "clash") for i, (raw, _) in enumerate(CASES)] + [(99, CASES[0][0], None, ""), (100, None, "/a.py", "")]
    c = spark.createDataFrame(rows, "i int, raw string, active_path string, text string")
    docs = spark.createDataFrame([("/a.py", text), ("/b.py", ""), (None, "x")], "path string, text string")
    forms = {"delete": "editDelete", "replace": "editReplace", "insert": "editInsert", "append": "editInsert"}
    got = edits_on_documents(c, docs, tuple(forms)).select("i", "text", *cm.action_columns(F.col("action"))).collect()
    want = {i: w for i, (_, w) in enumerate(CASES) if w and w[0] in forms.values()}
    assert {r["i"]: tuple(r)[2:] for r in got} == want and all(r["text"] == text for r in got)
    only = edits_on_documents(c, docs, ("delete",)).select("action.kind").collect()
    assert {r[0] for r in only} == {"editDelete"}


def test_edits_on_documents_equal_the_parse_of_every_form(spark):
    """Actions from parts parsed before the join are those of the whole parse with the document's statistics."""
    from tabsight.operators.actions import attach_documents, edits_on_documents, parse_completions

    scripts = ["2,3d", "3,99d", "1,99999999999d", "99999999999,1d", "1,2c\\" + NL + "x\\ny", "1,99999999999c\\" + NL + "x",
               "2i\\" + NL + "a\\tb", "99999999999i\\" + NL + "a", "$a\\" + NL + "end" + NL, "7d"]
    raws = [f"sed -i '{s}' {p}" for s in scripts for p in ("/a.py", "/b.py", "/e.py", "/x.py")]
    raws += ["cat -n /a.py; " + r for r in raws[:40:4]] + ["<think>no</think>" + r for r in raws[:40:4]] + ["cat -n /a.py", "", None]
    rows = [(i, r, p) for i, (r, p) in enumerate((r, p) for r in raws for p in ("/a.py", "/b.py", "/e.py", "/x.py", None))]
    c = spark.createDataFrame(rows, "i int, raw string, active_path string")
    docs = spark.createDataFrame([("/a.py", "a\nb\nc\nd"), ("/b.py", "a\r\nb\r"), ("/e.py", ""), (None, "x")], "path string, text string")
    parsed = parse_completions(attach_documents(c, docs)).where("route = 'edit' and active_path != '/x.py'")
    out = ["i", "line_count", "last_line_len", "route", "sed_form", *cm.action_columns(F.col("action"))]
    for forms in (("delete",), ("replace",), ("insert", "append"), ("delete", "replace", "insert", "append")):
        want = parsed.where(F.col("sed_form").isin(*forms)).select(*out).collect()
        got = edits_on_documents(c, docs, forms).select(*out).collect()
        assert len(want) > 3 and sorted(got, key=lambda r: r["i"]) == sorted(want, key=lambda r: r["i"])


def test_apply_insert_parses_an_output_once(spark):
    """Nor is a whole document collapsed; an output's command is written once."""
    from tabsight.plans.queries import QUERIES
    from tabsight.sources import fixtures as fx

    plan = _optimized(QUERIES["apply_insert"](spark, "/root/testdata/sf0.001"))
    assert plan.count(cm.SED_DELETE) == 1 and plan.count("regexp_replace(coalesce(changed") == 2
    assert plan.count("regexp_replace(new_text") == 0 and plan.count("regexp_replace(text") == 0
    assert _optimized(fx.completions(spark, "/root/testdata/sf0.001")).count("pytest -k ") == 1


def test_groups_of_one_match(spark):
    """Payloads and targets that hold the separator, other controls or a second command."""
    rows = [
        ("sed -i '1,2c\\" + NL + "a" + NL + NL + "b\u0001$1' /a.py", ("editReplace", 0, 0, 2, 0, "a" + NL + NL + "b\u0001$1" + NL, None)),
        ("sed -i '7d' /a.py", ("terminalSendText", None, None, None, None, "sed -i '7d' /a.py", None)),
        ("sed -i '1,99999999999d' /a.py", ("terminalSendText", None, None, None, None, "sed -i '1,99999999999d' /a.py", None)),
        ("x=1 sed -i '$a\\" + NL + "q' /a.py", ("editInsert", 10, 0, None, None, NL + "q" + NL, None)),
        ("echo sed; sed -i '3i\\" + NL + "' /a.py", ("editInsert", 2, 0, None, None, NL, None)),
        ("cat -n /b.py | sed -n '1,99999999999p'", ("terminalSendText", None, None, None, None, "cat -n /b.py | sed -n '1,99999999999p'", None)),
    ]
    df = spark.createDataFrame([(i, r, "/a.py", 10, 4) for i, (r, _) in enumerate(rows)], "i int, raw string, active_path string, line_count int, last_line_len int")
    out = cm.with_action(df).select("i", *cm.action_columns(F.col("action"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in out] == [w for _, w in rows]


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_gate_parses_a_body_once(spark):
    from tabsight.operators import responses as rsp

    def body(*logprobs):
        return json.dumps({"choices": [{"message": {"content": "t"}, "logprobs": {"content": [{"logprob": x} for x in logprobs]}}]})

    bodies = [("low", body(-3.0, -1.0)), ("equal", body(-1.0)), ("none", body()), ("bad", "no json"), (None, None), ("ok", body(-0.5, 0.0))]
    rows = spark.createDataFrame(bodies, "id string, body string")
    gated = rsp.confidence_gate(rsp.with_scores(rows))
    assert _optimized(gated.select("id", "avg_logprob")).count("parseJson") == 1
    assert gated.columns == rsp.with_scores(rows).columns
    got = {r["id"]: r["avg_logprob"] for r in gated.collect()}
    assert set(got) == {"equal", "none", "ok"} and got["ok"] == -0.25


def test_responses_aggregate_the_lines_once(spark):
    from tabsight.sources import fixtures as fx

    plan = _optimized(fx.responses(spark, "/root/testdata/sf0.001"))
    assert plan.count("Aggregate [") == 1 and plan.count("Join ") == 1
