"""Outcome, truncation, coalescing and response goldens (FIXTURES.md 2.3-2.6)."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tabsight.operators import messages as M
from tabsight.operators import responses as R
from tabsight.operators import sessions as S
from tabsight.operators.triggers import coalesce_triggers, simulate


def _decisions(spark, seq):
    rows = [(1, 1000 * (i + 1), i, k) for i, k in enumerate(seq)]
    return spark.createDataFrame(rows, "user_id long, ts long, seq long, kind string")


@pytest.mark.parametrize(
    "seq,expected",
    [
        (["shown", "accept"], [(0, "accepted")]),
        (["shown", "shown", "reject"], [(0, "ignored"), (1, "rejected")]),
        (["shown", "accept", "reject"], [(0, "accepted")]),
        (["accept", "shown"], []),
        (["shown", "reject", "accept", "shown", "accept"], [(0, "rejected"), (3, "accepted")]),
    ],
)
def test_outcomes(spark, seq, expected):
    out = S.resolve_outcomes(_decisions(spark, seq)).orderBy("shown_seq").collect()
    assert [(r["shown_seq"], r["outcome"]) for r in out] == expected


def test_ignored_time_is_next_shown(spark):
    out = S.resolve_outcomes(_decisions(spark, ["shown", "shown", "reject"])).orderBy("shown_seq").collect()
    assert out[0]["outcome_ts"] == 2000


def test_pending_only_when_asked(spark):
    out = S.resolve_outcomes(_decisions(spark, ["accept", "shown"]), include_pending=True).collect()
    assert len(out) == 1 and out[0]["outcome"] is None


def test_scan_across_slices_matches(spark):
    # Tiny slices force every carry path of the two-level scan.
    seq = ["shown", "accept", "shown", "shown", "reject", "shown"]
    a = S.resolve_outcomes(_decisions(spark, seq), slice_ms=1).orderBy("shown_seq").collect()
    b = S.resolve_outcomes(_decisions(spark, seq), slice_ms=10**9).orderBy("shown_seq").collect()
    assert a == b and len(a) == 3


@pytest.mark.parametrize(
    "system,turns,budget,kept",
    [
        (10, [10, 10], 30, 2),
        (10, [10, 10, 10], 30, 1),
        (10, [1, 50], 30, 1),
        (10, [50], 30, 0),
    ],
)
def test_truncation(spark, system, turns, budget, kept):
    sys_prompt = "s" * (system * 4)
    rows = [(1, i, "user", "x" * (t * 4)) for i, t in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")
    out = M.truncate_context(df, max_tokens=budget, system_prompt=sys_prompt, turn_slice=1).collect()
    assert sum(1 for r in out if r["role"] == "system") == 1
    assert sum(1 for r in out if r["role"] != "system") == kept


@pytest.mark.parametrize(
    "times,fires,cancelled",
    [
        ([0], [150], []),
        ([0, 50, 100, 400], [200, 250, 550], [1]),
        ([0, 10, 20, 30, 40], [180, 190], [1, 2, 3]),
        ([0, 200, 210, 220], [150, 450, 450], [2]),
        ([0, 1000, 1100], [150, 1150, 1250], []),
    ],
)
def test_coalescing(times, fires, cancelled):
    res = simulate(times, 150, 300, 2)
    assert [f for f, _ in res if f is not None] == fires
    assert [i + 1 for i, (_, c) in enumerate(res) if c] == cancelled


def test_coalescing_job_splits_bursts(spark):
    times = [0, 50, 100, 400, 5000, 5010, 5020, 5030, 5040]
    df = spark.createDataFrame([(1, t, i) for i, t in enumerate(times)], "user_id long, t long, seq long")
    out = coalesce_triggers(df, slice_ms=1000).orderBy("seq").collect()
    assert [r["fire_at"] for r in out] == [None, 200, 250, 550, None, None, None, 5180, 5190]


def _body(content=None, text=None, lps=None, choices=True, raw=None):
    if raw is not None:
        return raw
    if not choices:
        return json.dumps({"id": 1})
    ch = {}
    if content is not None:
        ch["message"] = {"content": content}
    if text is not None:
        ch["text"] = text
    if lps is not None:
        ch["logprobs"] = {"content": [{"logprob": x} for x in lps]}
    return json.dumps({"choices": [ch]})


def test_responses(spark):
    cases = [
        (_body("ls", lps=[-0.5, -1.5]), "ok", -1.0),
        (_body("ls", lps=[-1.0, -1.5]), "low_confidence", -1.25),
        (_body(text="ls", lps=[-0.1]), "ok", -0.1),
        (_body(5, lps=[-0.1]), "empty_content", -0.1),
        (_body("   ", lps=[-0.1]), "empty_content", -0.1),
        (_body("ls", lps=[]), "ok", None),
        (_body("ls"), "bad_response", None),
        (_body(choices=False), "bad_response", None),
        (_body(raw="not json"), "bad_response", None),
    ]
    df = spark.createDataFrame([(i, b) for i, (b, _, _) in enumerate(cases)], "i int, body string").select(
        "i", "body", F.lit(None).cast("string").alias("active_path"), F.lit(None).cast("int").alias("line_count"),
        F.lit(None).cast("int").alias("last_line_len"),
    )
    out = {r["i"]: r for r in R.parse_responses(df).collect()}
    for i, (_, status, avg) in enumerate(cases):
        assert out[i]["parse_status"] == status, (i, out[i])
        if avg is not None:
            assert out[i]["avg_logprob"] == pytest.approx(avg)
    assert out[5]["avg_logprob"] != out[5]["avg_logprob"]  # NaN for an empty list
    assert out[2]["text"] == "ls"


def test_dismiss_rejects(spark):
    ev = spark.createDataFrame(
        [(1, 1, 1, "shown"), (1, 2, 2, "dismiss"), (1, 3, 3, "accept")], "user_id long, ts long, seq long, kind string"
    )
    out = [(r.shown_seq, r.outcome, r.outcome_ts) for r in S.resolve_outcomes(ev).collect()]
    assert out == [(1, "rejected", 2)]


def test_cursor_belongs_to_its_file(spark):
    point = "struct<line:int,ch:int>"
    schema = (
        "user_id long, ts long, seq long, "
        f"action struct<kind:string,filePath:string,selections:array<struct<start:{point},`end`:{point}>>,text:string>"
    )
    at = [((7, 0), (7, 0))]
    rows = [
        (1, 1, 1, ("openFile", "a", at, None)),
        (1, 2, 2, ("openFile", "b", None, None)),
        (1, 3, 3, ("setSelections", None, at, None)),
    ]
    st = S.session_state_asof(spark.createDataFrame(rows, schema)).orderBy("seq").collect()
    assert [(r.active_file, r.cursor_line) for r in st] == [("a", 7), ("b", None), ("b", 7)]


def test_pairs_take_the_nearest_accepted_sample(spark):
    from tabsight.operators.preferences import dpo_pairs

    rows = [(t, t, o, [(c, c)]) for t, o, c in [
        (1, "rejected", "x"), (2, "accepted", "x"), (3, "accepted", "x"), (4, "rejected", "x"), (5, "rejected", "y"),
        (6, "ignored", "y")]]
    s = spark.createDataFrame(
        rows, "timestamp long, sample_id long, outcome string, context array<struct<role:string,content:string>>"
    )
    for width in (1, 1000):
        got = sorted(map(tuple, dpo_pairs(s, slice_ms=width).collect()))
        assert got == [(2, 1), (3, 4)]


def test_null_logprob_counts_as_zero(spark):
    import math

    from tabsight.functions.responses import mean_logprob, parse_body, token_logprobs

    def body(tokens):
        return '{"choices":[{"text":"t","logprobs":{"content":[%s]}}]}' % tokens

    df = spark.createDataFrame([(body('{"logprob":-4.0},{"logprob":null}'),), (body('{"logprob":-4.0},{}'),)], "b string")
    got = [r.m for r in df.select(mean_logprob(token_logprobs(parse_body(F.col("b")))).alias("m")).collect()]
    assert got[0] == -2.0 and math.isnan(got[1])


def test_transcript_pages_join_to_the_transcript(spark):
    """Any page and slice width: pages joined in order are the transcript; no page is
    longer than asked; empty and null chunks are counted, null commands are one."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        text = rng.choice([None, "", "x", "yz\n", "long " * rng.randint(1, 30), "\U0001F600" * 7])
        rows.append((rng.choice([1, 1, 1, 2, None]), 1000 + i // 3 * 10, i, text))
    rows += [(3, 5, 900, ""), (3, 6, 901, None), (4, 7, 902, "abcd"), (4, 8, 903, ""), (5, 9, 904, "w" * 100)]
    df = spark.createDataFrame(rows, "execution_id long, ts long, seq long, text string")
    whole = {r["execution_id"]: (r["n_chunks"], r["transcript"]) for r in S.terminal_transcript(df).collect()}
    for page, width in ((4, 1), (4, 50), (33, 3_600_000), (100_000, 7)):
        got = {}
        for r in S.transcript_pages(df, page, width).orderBy("execution_id", "page").collect():
            got.setdefault(r["execution_id"], []).append(r)
        joined = {k: (sum(r["n_chunks"] for r in v), "".join(r["text"] for r in v)) for k, v in got.items()}
        assert joined == whole
        for v in got.values():
            assert [r["page"] for r in v] == list(range(len(v)))
            assert all(len(r["text"]) == page for r in v[:-1]) and len(v[-1]["text"]) <= page
    assert S.transcript_pages(df.limit(0)).count() == 0
