"""Behaviour parameters of the suggestion loop: defaults of the operators' arguments."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values. These must equal the behaviour being reproduced.
#   model name default .............. "qwen/qwen3-8b"
#   minimum mean log-probability .... -1.0
#   context budget (tokens) ......... 120000
#   viewport radius (lines) ......... 10
#   debounce ........................ 150 ms
#   throttle ........................ 300 ms
#   pending triggers kept ........... 2
#   sampling ........................ temperature 0.7, top_p 0.8, top_k 20,
#                                     min_p 0, logprobs true,
#                                     chat_template_kwargs.enable_thinking false
#   outcomes ........................ "accepted", "rejected", "ignored"
# ---------------------------------------------------------------------------
DEFAULT_MODEL_NAME = "qwen/qwen3-8b"
DEFAULT_MIN_AVG_LOGPROB = -1.0
DEFAULT_MAX_CONTEXT_TOKENS = 120000
DEFAULT_VIEWPORT_RADIUS = 10
DEBOUNCE_MS = 150
THROTTLE_MS = 300
MAX_PENDING_TRIGGERS = 2
TEMPERATURE = 0.7
TOP_P = 0.8
TOP_K = 20
MIN_P = 0
OUTCOMES = ("accepted", "rejected", "ignored")

# Our own choices (the token estimator and system prompt are not knowable;
# the log file name is ours too).
PREFERENCE_LOG_FILE_NAME = ".preferences.jsonl"
DEFAULT_SYSTEM_PROMPT = (
    "You are a coding assistant inside an editor. Reply with exactly one bash "
    "command in a fenced block: a sed edit, a cat -n view, or a terminal command."
)
CHARS_PER_TOKEN = 4

# Width of the ordered-scan slices used by the skew-safe running aggregates
# (see operators/scan.py). A slice is the unit of work of one window task.
EVENT_SLICE_MS = 3_600_000  # one hour of one user's events
TURN_SLICE = 4096  # turns of one conversation

# How far behind the newest event a stream still takes rows; also the width of the
# slices of event time that a stream holds and releases (streaming/ordered.py).
STREAM_DELAY_MS = 86_400_000  # one day

# Characters of one page of a terminal transcript: what a task holds of a command.
TRANSCRIPT_PAGE_CHARS = 65_536
