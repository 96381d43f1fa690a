"""License scans: a trained paragraph classifier, confirmed by templates.

The lines of a text that have words are its paragraphs' parts, since notices stand on one
line, or wrapped over several, with comment marks or without. A line's lower-cased words and
word pairs, hashed into a sparse vector, go to a multinomial logistic regression with
one class per licence family and a class for everything else. The families are learned
from their templates, whole and cut as wrapping would cut them; the other class from
the lines of a sample of documents that no template resembles (``SAMPLE`` documents,
about). A threshold on the family's probability is calibrated over all documents, so
that at most ``FALSE_SHARE`` of the lines that no template resembles pass.

Passing lines of one family, at most one line apart, are a paragraph, together with the
lines around and between them. It holds if it has at least ``CONFIRMED`` of the words and
word pairs of one of the family's templates, and no other family's template has a
larger share; else it is unknown.

Null and empty texts have no paragraphs; every input row gives one result row; rows
of one doc_id and one text share their result, other texts under the same id (or a
null one) have their own. Of classes with equal chances the first by name counts. Lines
of any length are scored whole. An empty table gives no rows. Only DataFrame and ML
functions that run in the JVM are used.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsight.llm.common import stored

#: Hashed terms; documents whose lines are fitted on, about; calibration share of
#: false alarms; least share of a template's words and pairs.
TERMS, SAMPLE, FALSE_SHARE, CONFIRMED = 1 << 14, 400, 1e-3, 0.7
#: Words of a wrapped line, as the families are learned.
WRAPS = (5, 9, 14)
OTHER = "unknown"

# Customary licence notices by family.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "GNU Affero General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "ISC License", "SPDX-License-Identifier: ISC"],
    "lgpl": [
        "GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "The Unlicense", "SPDX-License-Identifier: Unlicense"],
}
FAMILIES = [OTHER, *sorted(TEMPLATES)]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def terms(w: Column) -> Column:
    """Words and pairs of neighbours."""
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(w, pairs)


def _features(lines: DataFrame) -> DataFrame:
    """Adds ``w`` (words), ``terms`` and the vector ``features`` to rows with a ``line``."""
    d = lines.withColumn("w", words(F.col("line"))).withColumn("terms", terms(F.col("w")))
    return HashingTF(numFeatures=TERMS, inputCol="terms", outputCol="features", binary=True).transform(d)


def _resemblance(own: Column, templates: list[str]) -> Column:
    """Largest share of a template's distinct words and pairs among the terms ``own``."""
    shares = []
    for t in templates:
        wanted = F.array_distinct(terms(words(F.lit(t))))
        shares.append(F.size(F.array_intersect(own, wanted)) / F.size(wanted))
    return F.greatest(*shares, F.lit(0.0))


def _every() -> list[str]:
    return [t for ts in TEMPLATES.values() for t in ts]


def _lines(docs: DataFrame, *columns: Column) -> DataFrame:
    """The lines that have words, numbered, each with its neighbours."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    rows = docs.select(*columns, lines.alias("lines")).select("*", F.posexplode("lines").alias("place", "line"))
    around = [F.get("lines", F.col("place") - 1).alias("before"), F.get("lines", F.col("place") + 1).alias("after")]
    return rows.select("*", *around).drop("lines")


def wrapped(template: str) -> set[str]:
    """A template whole, and as the lines that wrapping at any place would make of it."""
    w = template.split()
    return {template} | {" ".join(w[i : i + n]) for n in WRAPS if n < len(w) for i in range(0, len(w) - n + 1, 2)}


def _examples(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(float(label)).alias("label"), F.lit(line).alias("line")) for label, family in enumerate(FAMILIES) for t in TEMPLATES.get(family, ()) for line in sorted(wrapped(t))]
    return spark.range(1).select(F.inline(F.array(*rows)))


def train(docs: DataFrame, sample: int = SAMPLE) -> LogisticRegressionModel:
    """The classifier. ``sample``: about the number of documents that stand for
    ordinary text, taken by a hash of the whole row, so no text is sorted or moved."""
    spark = docs.sparkSession
    share = min(1.0, sample / max(1, docs.count()))
    dice = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(1 << 30))
    some = docs.select("doc_id", "text").where(dice < int(share * (1 << 30)))
    ordinary = _lines(some).select("line").distinct()
    ordinary = ordinary.where(_resemblance(terms(words(F.col("line"))), _every()) < 0.3)
    ordinary = stored(ordinary, "license-sample").select(F.lit(0.0).alias("label"), "line")
    filler = spark.range(1).select(F.lit(0.0).alias("label"), F.lit("").alias("line"))
    data = _examples(spark).unionByName(ordinary).unionByName(filler)
    n = ordinary.count() + 1
    data = data.withColumn("weight", F.when(F.col("label") == 0, F.lit(1.0)).otherwise(F.lit(max(1.0, n / 400))))
    return LogisticRegression(family="multinomial", maxIter=60, regParam=1e-4, weightCol="weight").fit(_features(data).select("label", "features", "weight").coalesce(1))


def _scored(features: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """Adds the likeliest family and ``chance``, its probability."""
    out = model.setProbabilityCol("p").setRawPredictionCol("").setPredictionCol("").transform(features)
    out = out.withColumn("p", F.slice(vector_to_array("p"), 2, len(FAMILIES) - 1)).withColumn("chance", F.array_max("p"))
    names = F.array(*[F.lit(f) for f in FAMILIES[1:]])
    return out.withColumn("family", F.element_at(names, F.array_position("p", F.col("chance")).cast("int"))).drop("p")


def threshold(lines: int, candidates: DataFrame, false_share: float = FALSE_SHARE) -> float:
    """The chance that at most ``false_share`` of all ``lines`` exceed, counting the
    ``candidates`` (chance over one half) that no template resembles."""
    alarms = candidates.where("resemblance < 0.3").groupBy(F.floor(F.col("chance") * 1000).alias("mill")).count().orderBy(F.desc("mill")).collect()  # 500 rows at most
    room = int(false_share * lines)
    for r in alarms:
        room -= r["count"]
        if room < 0:
            return (r["mill"] + 1) / 1000
    return 0.5


def scan(docs: DataFrame) -> DataFrame:
    """Every paragraph found: ``doc_id, key`` (a hash of the text)``, place`` (its first
    line's number)``, paragraph, family`` (``unknown`` where no template confirms it),
    ``chance`` (of its best line)."""
    model = train(docs)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    at = [F.col("doc_id"), F.col("key")]
    scored = _scored(_features(_lines(keyed, *at)), model).where(F.col("chance") > 0.5)
    scored = scored.withColumn("resemblance", _resemblance(F.col("terms"), _every()))
    candidates = stored(scored.select("doc_id", "key", "place", "line", "before", "after", "family", "chance", "resemblance").distinct(), "license-lines")
    whole = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    lines = docs.agg(F.sum(F.size(whole))).first()[0] or 0
    return paragraphs(candidates.where(F.col("chance") > threshold(lines, candidates)))


def paragraphs(passing: DataFrame) -> DataFrame:
    """Passing lines put together and confirmed (see :func:`scan`)."""
    own = Window.partitionBy("doc_id", "key", "family").orderBy("place")
    far = F.col("place") - F.lag("place").over(own) > 2
    runs = passing.withColumn("run", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(own))
    three = F.array(F.struct((F.col("place") - 1).alias("place"), F.col("before").alias("line")), F.struct("place", "line"), F.struct((F.col("place") + 1).alias("place"), F.col("after").alias("line")))
    found = runs.groupBy("doc_id", "key", "family", "run").agg(F.min("place").alias("place"), F.max("chance").alias("chance"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(three)))).alias("parts"))
    found = found.withColumn("paragraph", F.array_join(F.transform("parts", lambda p: p["line"]), "\n"))
    found = found.withColumn("terms", terms(words(F.col("paragraph"))))
    found = found.withColumn("alike", F.create_map(*[x for f in FAMILIES[1:] for x in (F.lit(f), _resemblance(F.col("terms"), TEMPLATES[f]))]))
    own = F.element_at("alike", F.col("family"))
    confirmed = (own >= CONFIRMED) & (own >= F.array_max(F.map_values("alike")))
    return found.select("doc_id", "key", "place", "paragraph", F.when(confirmed, F.col("family")).otherwise(F.lit(OTHER)).alias("family"), "chance")


def report(docs: DataFrame) -> DataFrame:
    """Per document its confirmed ``licenses`` (comma-joined, null: none), the
    number of their paragraphs and of unconfirmed ones."""
    named = F.when(F.col("family") != OTHER, F.col("family"))
    per = scan(docs).groupBy(F.struct("doc_id", "key").alias("at")).agg(F.array_join(F.array_sort(F.collect_set(named)), ",").alias("licenses"), F.count(named).alias("n_license"), (F.count("*") - F.count(named)).alias("n_unknown"))
    per = stored(per, "license-documents")
    rows = docs.select("doc_id", F.struct(F.col("doc_id"), F.xxhash64("text").alias("key")).alias("at"))
    out = rows.join(per, "at", "left")
    return out.select("doc_id", F.when(F.col("n_license") > 0, F.col("licenses")).alias("licenses"), F.coalesce("n_license", F.lit(0)).cast("long").alias("n_license"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"))
