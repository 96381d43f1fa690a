"""Text edits as values that compose.

A *delta* says what happens to a text from its start: runs of kept and dropped
characters and inserted texts; whatever follows is kept. Composition is
associative, so a long history can be cut anywhere and put together in any grouping.
As arrays: ``runs`` (positive: keep, negative: drop, zero: the next text), ``texts``.

An edit's place is clamped to the text, so what it does depends on the text's length.
Lengths compose too: the length after an edit is a function of the length before,
made of pieces of slope one or zero, and so is that of any history. As arrays:
``starts`` of the pieces, their ``values`` there, and their ``slopes``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence
from typing import TypeVar

Delta = tuple[list[int], list[str]]
Lengths = tuple[list[int], list[int], list[int]]
X = TypeVar("X")


def together(items: Sequence[X], join: Callable[[X, X], X]) -> X:
    """All ``items`` composed, neighbours first: the parts stay of like size."""
    items = list(items)
    while len(items) > 1:
        items = [join(*items[i : i + 2]) if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
    return items[0]


class _Runs:
    """A delta under construction: neighbouring runs of one kind are one run, and
    what is inserted where something is dropped comes before the drop."""

    def __init__(self):
        self.runs: list[int] = []
        self.texts: list[str] = []

    def keep(self, n: int) -> None:
        if n and self.runs and self.runs[-1] > 0:
            self.runs[-1] += n
        elif n:
            self.runs.append(n)

    def drop(self, n: int) -> None:
        if n and self.runs and self.runs[-1] < 0:
            self.runs[-1] -= n
        elif n:
            self.runs.append(-n)

    def insert(self, text: str) -> None:
        if not text:
            return
        at = len(self.runs) - (1 if self.runs and self.runs[-1] < 0 else 0)
        if at and self.runs[at - 1] == 0:
            self.texts[-1] += text
        else:
            self.runs.insert(at, 0)
            self.texts.append(text)

    def delta(self) -> Delta:
        return self.runs, self.texts


def edit_delta(offset: int, length: int, text: str) -> Delta:
    out = _Runs()
    out.keep(offset)
    out.drop(length)
    out.insert(text)
    return out.delta()


def _pieces(delta: Delta) -> list[tuple[int, str | None]]:
    texts = iter(delta[1])
    return [(n, None) if n else (0, next(texts)) for n in delta[0]]


def compose(first: Delta, second: Delta) -> Delta:
    """The delta that does ``first``, then ``second``."""
    out, source = _Runs(), _pieces(first)[::-1]
    for n, text in _pieces(second):
        if text is not None:
            out.insert(text)
            continue
        kept, left = n > 0, abs(n)
        while left:
            m, own = source.pop() if source else (left, None)
            if own is not None:
                if kept:
                    out.insert(own[:left])
                if len(own) > left:
                    source.append((0, own[left:]))
                left -= min(left, len(own))
            elif m < 0:
                out.drop(-m)
            else:
                part = min(m, left)
                (out.keep if kept else out.drop)(part)
                if m > part:
                    source.append((m - part, None))
                left -= part
    for m, own in source[::-1]:
        if own is not None:
            out.insert(own)
        elif m < 0:
            out.drop(-m)
        else:
            out.keep(m)
    return out.delta()


def apply_delta(text: str, delta: Delta) -> str:
    out, at = [], 0
    for n, own in _pieces(delta):
        if own is not None:
            out.append(own)
        elif n > 0:
            out.append(text[at : at + n])
        at += abs(n)
    return "".join(out) + text[at:]


def edit_lengths(offset: int, length: int, added: int) -> Lengths:
    """The length after an edit: up to ``offset`` only the addition counts, within the
    replaced range the length before does not matter."""
    if not length:
        return [0], [added], [1]
    head = [(0, added, 1)] if offset else []
    pieces = [*head, (offset, offset + added, 0), (offset + length, offset + added, 1)]
    return tuple(list(x) for x in zip(*pieces))  # type: ignore[return-value]


def length_after(lengths: Lengths, before: int) -> int:
    starts, values, slopes = lengths
    i = bisect_right(starts, before) - 1
    return values[i] + slopes[i] * (before - starts[i])


def compose_lengths(first: Lengths, second: Lengths) -> Lengths:
    """The length after both, as a function of the length before the first."""
    starts, values, slopes = first
    out: list[tuple[int, int, int]] = []
    for i, (start, value, slope) in enumerate(zip(starts, values, slopes)):
        end = starts[i + 1] if i + 1 < len(starts) else None
        # Places inside this piece where its value reaches a start of ``second``.
        cuts = [start]
        if slope:
            j = bisect_right(second[0], value)
            while j < len(second[0]) and (end is None or start + second[0][j] - value < end):
                cuts.append(start + second[0][j] - value)
                j += 1
        for cut in cuts:
            middle = value + slope * (cut - start)
            k = bisect_right(second[0], middle) - 1
            piece = (cut, length_after(second, middle), slope * second[2][k])
            if out and piece[2] == out[-1][2] and piece[1] == out[-1][1] + out[-1][2] * (cut - out[-1][0]):
                continue
            out.append(piece)
    return tuple(list(x) for x in zip(*out))  # type: ignore[return-value]
