"""Quality rules: robust multivariate outliers per language and source.

Every document gets counts over its whole text. A few hard rules reject it
outright; all others are judged by the Mahalanobis distance of a transformed
statistic vector from the minimum-covariance-determinant estimate of its
(language, source) cell: three robust starts, from each concentration steps that
fit mean and covariance to the ``SUPPORT`` share of documents nearest to the last
estimate until the determinant falls no more, then the estimate of the least
determinant. Everything is DataFrame expressions; the cells' estimates are a
small table, the documents' vectors are written once.

Null and empty texts have no words and fail the base rule. Null languages and
sources count as empty ones. Cells with fewer than ``MIN_CELL`` documents
are pooled by language, and languages with fewer over everything. A ridge keeps
dependent statistics from making singular matrices; a variance below ``LEAST``
squared counts as that, so a constant statistic makes no outliers of tiny
deviations. Repeated rows are judged one by one. An empty table gives no rows. Clashing extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import SPACE_RE, WORD_RE, stored

#: Share of a cell that the estimate rests on; smallest cell; share of a clean
#: normal cell beyond the cut; fall of the log-determinant that ends the steps.
SUPPORT, MIN_CELL, BEYOND, TOLERANCE = 0.75, 200, 1e-5, 1e-6

#: Statistic vector: name, expression, ridge (a standard deviation).
VECTOR: list[tuple[str, str, float]] = [
    ("v_length", "ln(word_chars / n_words)", 1e-3),
    ("v_symbols", "ln(1 + n_symbols / n_words)", 1e-3),
    ("v_lines", "sqrt(n_dup_lines / greatest(n_lines, 1))", 1e-3),
    ("v_repeats", "sqrt(n_repeat_words / n_words)", 1e-3),
    ("v_upper", "ln(1 + n_upper / n_words)", 1e-3),
    ("v_marks", "ln(1 + n_marks / n_words)", 1e-3),
]
DIM = len(VECTOR)
#: Least standard deviation of each statistic, in place of smaller ones. Of the
#: two shares: where all others have none, half of the lines or words is beyond the cut.
LEAST = [0.05, 0.03, 0.12, 0.12, 0.03, 0.03]


#: Most (language, source) pairs whose estimates are sent to the documents' rows
#: (under 1 KB each, three starts); beyond that they are joined by shuffles.
PAIRS = 10_000


def _as_is(few: DataFrame) -> DataFrame:
    return few


def chi2_quantile(p: float, dof: int) -> float:
    """Quantile of the chi-squared law for an even number of degrees of freedom."""
    cdf = lambda x: 1 - exp(-x / 2) * sum((x / 2) ** k / factorial(k) for k in range(dof // 2))
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return low


def consistency(support: float, dof: int) -> float:
    """Factor by which a covariance of the nearest ``support`` share falls short
    under a normal law."""
    x = chi2_quantile(support, dof)
    return support / (1 - exp(-x / 2) * sum((x / 2) ** k / factorial(k) for k in range(dof // 2 + 1)))


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Counts over each whole text: the contract's four, lines, capitals, marks.
    ``carry`` keeps the input row in a column ``row``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*docs.columns) if carry else F.lit(0)
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("t"), row.alias("row"))
    d = d.withColumn("w", F.filter(F.split("t", SPACE_RE + "+"), lambda x: x != ""))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD_RE)))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    d = d.withColumn("windows", F.expr("CASE WHEN n_words >= 3 THEN transform(sequence(0, CAST(n_words AS INT) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END"))
    left_over = lambda keep: F.length(F.regexp_replace("t", keep, "")).cast("long")
    # Only texts with a repeated window sort them: equal neighbours, whose places
    # and the two words after each are then counted once.
    d = d.withColumn("sorted", F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN array_sort(transform(windows, (h, i) -> struct(h, i))) END"))
    again = "filter(sorted, (x, j) -> get(sorted, j - 1).h <=> x.h OR get(sorted, j + 1).h <=> x.h)"
    return d.select(
        "doc_id", "lang", "source", "n_words", "row",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        left_over(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN sorted IS NULL THEN 0L ELSE CAST(size(array_distinct(flatten(transform({again}, x -> array(x.i, x.i + 1, x.i + 2))))) AS BIGINT) END").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        left_over("[^A-Z]+").alias("n_upper"),
        left_over(r"[^!-/:-@\[-`{-~]+").alias("n_marks"),
    ).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def _cells(vectors: DataFrame, min_cell: int) -> DataFrame:
    """Cell of each (lang, source): itself, its language's small ones, or all small ones."""
    n = vectors.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = n.where(F.col("n") < min_cell).groupBy("lang").agg(F.sum("n").alias("pooled"))
    key = F.when(F.col("n") >= min_cell, F.to_json(F.array("lang", "source"))).when(F.col("pooled") >= min_cell, F.to_json(F.array("lang"))).otherwise(F.lit("[]"))
    return n.join(small, "lang", "left").select("lang", "source", key.alias("cell"))


def _distance(center: list[Column], inverse: dict[tuple[int, int], Column]) -> Column:
    d = [F.col(v) - c for (v, _, _), c in zip(VECTOR, center)]
    terms = [(F.lit(1.0) if i == j else F.lit(2.0)) * inverse[i, j] * d[i] * d[j] for i in range(DIM) for j in range(i, DIM)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _inverse(cov: DataFrame) -> DataFrame:
    """Center, ``p_i_j`` (i <= j), the inverse of the symmetric matrix ``c_i_j``,
    by one sweep per row on an array of rows, and ``det``, its log-determinant."""
    matrix = ", ".join(f"array({', '.join(f'c_{min(i, j)}_{max(i, j)}' for j in range(DIM))})" for i in range(DIM))
    swept = F.expr(f"""aggregate(sequence(0, {DIM - 1}), struct(array({matrix}) AS m, CAST(0 AS DOUBLE) AS det), (s, k) -> struct(transform(s.m, (row, i) -> transform(row, (x, j) ->
        CASE WHEN i = k AND j = k THEN -1 / s.m[k][k] WHEN i = k OR j = k THEN x / s.m[k][k] ELSE x - s.m[i][k] * s.m[k][j] / s.m[k][k] END)) AS m, s.det + ln(s.m[k][k]) AS det))""")
    keep = [c for c in cov.columns if not c.startswith("c_")]
    return cov.select(*keep, swept.alias("s")).select(*keep, *((-F.col("s.m")[i][j]).alias(f"p_{i}_{j}") for i in range(DIM) for j in range(i, DIM)), F.col("s.det").alias("det"))


def _start(vectors: DataFrame, send: Callable = _as_is) -> DataFrame:
    """Medians and median absolute deviations, as a diagonal estimate."""
    med = stored(vectors.groupBy("cell").agg(*(F.percentile_approx(v, 0.5, 10_000).alias(f"m_{i}") for i, (v, _, _) in enumerate(VECTOR))), "quality-medians")
    away = vectors.join(send(med), "cell").groupBy("cell").agg(*(F.percentile_approx(F.abs(F.col(v) - F.col(f"m_{i}")), 0.5, 10_000).alias(f"d_{i}") for i, (v, _, _) in enumerate(VECTOR)))
    spread = [F.pow(F.greatest(1.4826 * F.col(f"d_{i}"), F.lit(LEAST[i])), 2) for i in range(DIM)]
    zero = [F.lit(0.0).alias(f"p_{i}_{j}") for i in range(DIM) for j in range(i + 1, DIM)]
    return med.join(away, "cell").select("cell", *(f"m_{i}" for i in range(DIM)), *((F.lit(1.0) / s).alias(f"p_{i}_{i}") for i, s in enumerate(spread)), *zero)


def _starts(vectors: DataFrame, send: Callable = _as_is) -> DataFrame:
    """Three starts per cell around the medians, all with the spreads of
    :func:`_start`: no correlations, and those of two robust transforms of the
    scaled deviations, their hyperbolic tangents and their directions."""
    first = stored(_start(vectors, send), "quality-start")
    z = [((F.col(v) - F.col(f"m_{i}")) * F.sqrt(f"p_{i}_{i}")).alias(f"z_{i}") for i, (v, _, _) in enumerate(VECTOR)]
    scaled = vectors.join(send(first), "cell").select("cell", *z)
    norm = F.expr("sqrt(" + " + ".join(f"z_{i} * z_{i}" for i in range(DIM)) + ")")
    pairs = [(i, j) for i in range(DIM) for j in range(i, DIM)]
    parts = [first.withColumn("start", F.lit(0))]
    for n, y in enumerate([[F.tanh(f"z_{i}") for i in range(DIM)], [F.col(f"z_{i}") / F.greatest(norm, F.lit(1e-9)) for i in range(DIM)]], 1):
        means = scaled.groupBy("cell").agg(*(F.avg(y[i] * y[j]).alias(f"q_{i}_{j}") for i, j in pairs))
        both = first.join(means, "cell")
        size = lambda i: F.sqrt(F.col(f"q_{i}_{i}") + 1e-6)
        cov = [((F.lit(1.0) if i == j else F.col(f"q_{i}_{j}") / (size(i) * size(j))) / F.sqrt(F.col(f"p_{i}_{i}") * F.col(f"p_{j}_{j}"))).alias(f"c_{i}_{j}") for i, j in pairs]
        parts.append(_inverse(both.select("cell", *(f"m_{i}" for i in range(DIM)), *cov)).drop("det").withColumn("start", F.lit(n)))
    return reduce(DataFrame.unionByName, parts)


def _judged(vectors: DataFrame, estimate: DataFrame, send: Callable = _as_is) -> DataFrame:
    inverse = {(i, j): F.col(f"p_{i}_{j}") for i in range(DIM) for j in range(i, DIM)}
    d2 = _distance([F.col(f"m_{i}") for i in range(DIM)], inverse)
    return vectors.join(send(estimate), "cell").withColumn("d2", d2).select(*_keys(estimate), *(v for v, _, _ in VECTOR), "d2")


def _keys(estimate: DataFrame) -> list[str]:
    return [c for c in ("cell", "start") if c in estimate.columns]


def _concentrate(vectors: DataFrame, estimate: DataFrame, support: float, send: Callable = _as_is) -> DataFrame:
    """Mean and covariance of each cell's nearest ``support`` share, for each start."""
    keys = _keys(estimate)
    judged = _judged(vectors, estimate, send)
    edge = stored(judged.groupBy(*keys).agg(F.percentile_approx("d2", support, 10_000).alias("edge")), "quality-edge")
    near = judged.join(send(edge), keys).where("d2 <= edge")
    x = [F.col(v) for v, _, _ in VECTOR]
    sums = near.groupBy(*keys).agg(*(F.avg(x[i]).alias(f"m_{i}") for i in range(DIM)), *(F.covar_pop(x[i], x[j]).alias(f"q_{i}_{j}") for i in range(DIM) for j in range(i, DIM)))
    factor = consistency(support, DIM)
    cov = {(i, j): F.col(f"q_{i}_{j}") * factor for i in range(DIM) for j in range(i, DIM)}
    for i in range(DIM):
        cov[i, i] = F.greatest(cov[i, i] + VECTOR[i][2] ** 2, F.lit(LEAST[i] ** 2))
    return _inverse(sums.select(*keys, *(f"m_{i}" for i in range(DIM)), *(c.alias(f"c_{i}_{j}") for (i, j), c in cov.items())))


def _estimate(vectors: DataFrame, support: float, send: Callable = _as_is) -> DataFrame:
    """Per cell the estimate of the least determinant that concentration reaches
    from any start. A start is left when its determinant falls no more."""
    open_ = stored(_starts(vectors, send).withColumn("was", F.lit(float("inf"))), "quality-estimate")
    reached = []
    while not open_.isEmpty():
        after = _concentrate(vectors, open_.drop("was"), support, send)
        was = open_.select("cell", "start", "was")
        reached.append(stored(after.join(was, ["cell", "start"]), "quality-estimate"))
        open_ = reached[-1].where(f"det < was - {TOLERANCE}").withColumn("was", F.col("det")).drop("det")
    if not reached:
        return open_.drop("start", "was")
    fields = [f"m_{i}" for i in range(DIM)] + [f"p_{i}_{j}" for i in range(DIM) for j in range(i, DIM)]
    return reduce(DataFrame.unionByName, reached).groupBy("cell").agg(F.min(F.struct("det", "start", *fields)).alias("b")).select("cell", *(f"b.{f}" for f in fields))


def judge(docs: DataFrame, support: float = SUPPORT, min_cell: int = MIN_CELL, beyond: float = BEYOND) -> DataFrame:
    """Statistics of every document with ``base_failed``, squared distance ``d2``
    (null where the base rules failed) and ``kept``."""
    stats = stored(statistics(docs).drop("row"), "quality-statistics")
    return _verdicts(stats, support, min_cell, beyond).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def passing(docs: DataFrame, support: float = SUPPORT, min_cell: int = MIN_CELL, beyond: float = BEYOND) -> DataFrame:
    """The input rows that :func:`judge` keeps. The rows are written once beside
    their statistics, so no text is shuffled."""
    stats = stored(statistics(docs, carry=True), "quality-statistics")
    return _verdicts(stats, support, min_cell, beyond).where("kept").select("row.*")


def _verdicts(stats: DataFrame, support: float, min_cell: int, beyond: float) -> DataFrame:
    good = stats.where("NOT base_failed").select("lang", "source", *(F.expr(e).alias(v) for v, e, _ in VECTOR))
    cells = stored(_cells(good, min_cell), "quality-cells")
    send = F.broadcast if cells.count() <= PAIRS else _as_is
    vectors = stored(good.join(send(cells), ["lang", "source"]).drop("lang", "source"), "quality-vectors")
    estimate = _estimate(vectors, support, send)
    every = stats.select("*", *(F.expr(f"CASE WHEN NOT base_failed THEN {e} END").alias(v) for v, e, _ in VECTOR))
    inverse = {(i, j): F.col(f"p_{i}_{j}") for i in range(DIM) for j in range(i, DIM)}
    d2 = F.when(~F.col("base_failed"), _distance([F.col(f"m_{i}") for i in range(DIM)], inverse))
    cut = chi2_quantile(1 - beyond, DIM)
    # At most one row per pair.
    fitted = stored(cells.join(estimate, "cell"), "quality-fitted")
    judged = every.join(send(fitted), ["lang", "source"], "left").withColumn("d2", d2)
    return judged.withColumn("kept", F.coalesce(~F.col("base_failed") & (F.col("d2") <= cut), F.lit(False)))
