"""Licence notices on one line, wrapped, commented and reworded; the paragraphs that
passing lines make, against plain Python."""

import random
import re

import pytest

from tabsight.llm import licenses

RND = random.Random(8)
VOCAB = ["".join(RND.choice("abcdeéghilmnorst") for _ in range(RND.randint(2, 8))) for _ in range(300)]
SCHEMA = "doc_id long, text string, key string, place string, family string"


def _prose(n):
    return "\n".join(" ".join(RND.choice(VOCAB) for _ in range(RND.randint(4, 14))) for _ in range(n))


def _wrap(text, width, mark=""):
    w = text.split()
    return "\n".join(mark + " ".join(w[i : i + width]) for i in range(0, len(w), width))


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
    "lgpl": "This library is free software; you may redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use these files except in compliance with the License. You may obtain a copy of the License at",
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
LINES = {"mit": "MIT License", "lgpl": "GNU Lesser General Public License", "agpl": "GNU Affero General Public License v3", "cc-by-sa": "Licensed under CC BY-SA 4.0.", "cc-by": "Licensed under CC BY 4.0.", "cc0": "CC0 1.0 Universal", "mpl": "SPDX-License-Identifier: MPL-2.0"}


@pytest.fixture(scope="module")
def texts():
    out = [(None, 100), ("", 101), (" \n\n", 102), ("word", 103)]
    rows = [(i, t, None) for t, i in out]
    for n, (family, notice) in enumerate(NOTICES.items()):
        for m, (width, mark) in enumerate(((11, ""), (8, " * "), (100, "# "))):
            rows.append((200 + 10 * n + m, _prose(5) + "\n" + _wrap(notice, width, mark) + "\n" + _prose(6), family))
    rows += [(300 + n, _prose(4) + "\n" + line + "\n" + _prose(4), family) for n, (family, line) in enumerate(LINES.items())]
    rows += [(400 + n, _prose(12), None) for n in range(40)]
    rows += [(500, "mit " + _prose(1) + " license\n" + _prose(3), None), (501, _prose(300), None)]
    # one id (or none) with different texts, and a repeated row
    rows += [(600, LINES["mit"], "mit"), (600, _prose(5), None), (None, LINES["mpl"], "mpl"), (None, _prose(4), None)]
    return [*rows, rows[5], rows[5]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t) + ("c",) * 3 for i, t, _ in texts], SCHEMA).repartition(3).cache()


def test_notices_of_each_family(docs, texts):
    got = licenses.report(docs)
    assert got.columns == ["doc_id", "licenses", "n_license", "n_unknown"]
    rows = got.collect()
    assert sorted(((r["doc_id"], r["licenses"]) for r in rows), key=str) == sorted(((i, f) for i, _, f in texts), key=str)
    assert all((r["n_license"] > 0) == (r["licenses"] is not None) for r in rows)


def _terms(text):
    w = [x.lower() for x in re.findall(r"[^\W_]+", text)]
    return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}


def test_paragraphs_against_plain_python(spark):
    """Lines put together by place and family, and confirmed by templates."""
    rnd = random.Random(4)
    rows = []
    for doc in range(30):
        lines = [rnd.choice([*NOTICES.values(), *LINES.values(), "nothing of this kind", "one more line"]) for _ in range(12)]
        for place in rnd.sample(range(12), rnd.randint(1, 7)):
            rows.append((doc if doc else None, doc, place, lines[place], lines[place - 1] if place else None, lines[place + 1] if place < 11 else None, rnd.choice(["mit", "gpl", "bsd"]), rnd.random()))
    passing = spark.createDataFrame(rows, "doc_id long, key long, place int, line string, before string, after string, family string, chance double")
    want = []
    for doc, key, family in {(r[0], r[1], r[6]) for r in rows}:
        own = sorted(r for r in rows if (r[1], r[6]) == (key, family))
        run = []
        for r in [*sorted(own, key=lambda r: r[2]), None]:
            if run and (r is None or r[2] - run[-1][2] > 2):
                parts = {x for r_ in run for x in ((r_[2] - 1, r_[4]), (r_[2], r_[3]), (r_[2] + 1, r_[5])) if x[1] is not None}
                paragraph = "\n".join(line for _, line in sorted(parts))
                shares = {f: max(len(_terms(paragraph) & _terms(t)) / len(_terms(t)) for t in ts) for f, ts in licenses.TEMPLATES.items()}
                holds = shares[family] >= licenses.CONFIRMED and shares[family] == max(shares.values())
                want.append((doc, key, run[0][2], paragraph, family if holds else "unknown", max(x[7] for x in run)))
                run = []
            run.append(r)
    got = licenses.paragraphs(passing).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r["family"] for r in got} == {"mit", "gpl", "bsd", "unknown"}


def test_threshold(spark):
    """At most the share of all lines passes; resembled lines do not count."""
    rows = [(0.5005 + i / 2100, 0.0) for i in range(1000)] + [(0.999, 0.9)] * 50
    candidates = spark.createDataFrame(rows, "chance double, resemblance double")
    edge = licenses.threshold(100_000, candidates, 1e-3)
    over = sum(c > edge and r < 0.3 for c, r in rows)
    assert 95 <= over <= 100
    assert licenses.threshold(10_000_000, candidates, 1e-3) == 0.5


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert licenses.report(empty).count() == 0
    assert [tuple(r) for r in licenses.report(spark.createDataFrame([(1, None, "c", "c", "c")], SCHEMA)).collect()] == [(1, None, 0, 0)]
