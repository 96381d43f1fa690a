"""Model response JSON -> text and mean token log-probability.

The body is parsed once into a Variant; type tests use ``schema_of_variant``
so that a number in ``content`` is not mistaken for text (``from_json`` and
``get_json_object`` would turn 5 into "5").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTENT = "$.choices[0].message.content"
TEXT = "$.choices[0].text"
LOGPROBS = "$.choices[0].logprobs.content"


def parse_body(body: Column) -> Column:
    """Variant of the body; null when it is not JSON."""
    return F.try_parse_json(body)


def _string_at(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def response_text(v: Column) -> Column:
    """``choices[0].message.content`` if it is a string, else
    ``choices[0].text`` if it is a string, else null. Never fails."""
    return F.coalesce(_string_at(v, CONTENT), _string_at(v, TEXT))


def token_logprobs(v: Column) -> Column:
    """Per-token log-probabilities in order; null when the list is missing
    (the caller treats that as a bad response). A JSON null counts as 0; a
    missing logprob or one that is not a number contributes NaN."""
    toks = F.try_variant_get(v, LOGPROBS, "array<variant>")

    def value(t: Column) -> Column:
        is_null = F.schema_of_variant(F.try_variant_get(t, "$.logprob", "variant")) == "VOID"
        return F.coalesce(
            F.try_variant_get(t, "$.logprob", "double"), F.when(is_null, F.lit(0.0)), F.lit(float("nan"))
        )

    return F.transform(toks, value)


def mean_logprob(lps: Column) -> Column:
    """Left-to-right sum divided by the count; an empty list gives NaN."""
    total = F.aggregate(lps, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.when(F.size(lps) > 0, total / F.size(lps)).otherwise(F.lit(float("nan")))


def below_floor(avg: Column, floor: float) -> Column:
    """The confidence gate's drop condition; NaN is never below the floor."""
    return (~F.isnan(avg)) & (avg < F.lit(floor))
