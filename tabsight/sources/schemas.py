"""Declared schemas. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

POS = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("ch", T.IntegerType())])
RANGE = T.StructType([T.StructField("start", POS), T.StructField("end", POS)])

ACTION = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("position", POS),
        T.StructField("range", RANGE),
        T.StructField("text", T.StringType()),
        T.StructField("filePath", T.StringType()),
        T.StructField("selections", T.ArrayType(RANGE)),
    ]
)

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

PREFERENCE = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("context", T.ArrayType(MESSAGE)),
        T.StructField(
            "completion",
            T.StructType(
                [
                    T.StructField("rawModelOutput", T.StringType()),
                    T.StructField("parsedAction", ACTION),
                    T.StructField("avgLogprob", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("outcome", T.StringType()),
        T.StructField("outcomeTimestamp", T.LongType()),
        T.StructField("modelName", T.StringType()),
    ]
)

# On disk a position is a two-element JSON array [line, character].
_POS_DISK = T.ArrayType(T.LongType())
_RANGE_DISK = T.StructType([T.StructField("start", _POS_DISK), T.StructField("end", _POS_DISK)])
ACTION_DISK = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("position", _POS_DISK),
        T.StructField("range", _RANGE_DISK),
        T.StructField("text", T.StringType()),
        T.StructField("filePath", T.StringType()),
        T.StructField("selections", T.ArrayType(_RANGE_DISK)),
    ]
)
PREFERENCE_DISK = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("context", T.ArrayType(MESSAGE)),
        T.StructField(
            "completion",
            T.StructType(
                [
                    T.StructField("rawModelOutput", T.StringType()),
                    T.StructField("parsedAction", ACTION_DISK),
                    T.StructField("avgLogprob", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("outcome", T.StringType()),
        T.StructField("outcomeTimestamp", T.LongType()),
        T.StructField("modelName", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

# Long interaction-event table (one schema for all kinds).
EVENT = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("ts", T.LongType()),  # epoch milliseconds
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("execution_id", T.LongType()),
        T.StructField("change_idx", T.LongType()),  # place in a batch of content changes
    ]
)

EVENT_KINDS = (
    "selection",
    "tab",
    "content",
    "terminal_focus",
    "terminal_command",
    "terminal_output",
    "clear",
    "toggle",
)

DIFF_SEGMENT = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])
