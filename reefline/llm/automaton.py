"""Automata over bytes whose runs are composed instead of followed.

A stretch of bytes is a function: for each state it may be entered in, the state it is left in and how
many events happen on the way. Functions of neighbouring stretches compose, in any grouping, so stretches
are worked on apart and the state each one is really entered in is settled afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np

#: Functions of words, looked up by their bytes' classes, in a table at most.
WORDS = 1 << 16

Level = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Automaton:
    """kinds: the class of each byte, with one class more that stands for no byte; step and emits: by state
    and class, the next state and the events (0 or 1) on the way; accepts: by state."""

    kinds: np.ndarray
    step: np.ndarray
    emits: np.ndarray
    accepts: np.ndarray

    def __post_init__(self) -> None:
        states, classes = self.step.shape
        size = max(n for n in (1, 2, 4) if n == 1 or classes**n <= WORDS)
        after = np.tile(np.arange(states), (classes**size, 1))
        count = np.zeros_like(after)
        words = np.array(list(product(range(classes), repeat=size)))
        for k in range(size):
            at = words[:, k, None]
            count, after = count + self.emits[after, at], self.step[after, at]
        object.__setattr__(self, "_words", (after.astype(np.int32), count.astype(np.int32)))
        object.__setattr__(self, "_places", classes ** np.arange(size - 1, -1, -1))

    @property
    def states(self) -> int:
        return len(self.step)

    def levels(self, data: np.ndarray) -> list[Level]:
        """(next, count) by stretch and state: of words, of pairs of words and so on up to all of ``data``."""
        size = len(self._places)
        classes = np.full(-(-max(len(data), 1) // size) * size, self.step.shape[1] - 1)
        classes[: len(data)] = self.kinds[data]
        words = classes.reshape(-1, size) @ self._places
        out = [(self._words[0][words], self._words[1][words])]
        while len(out[-1][0]) > 1:
            out.append(self._paired(*out[-1]))
        return out

    def _paired(self, after: np.ndarray, count: np.ndarray) -> Level:
        if len(after) % 2:
            after = np.concatenate([after, np.arange(self.states, dtype=after.dtype)[None]])
            count = np.concatenate([count, np.zeros_like(count[:1])])
        first = after[0::2]
        at = first + (np.arange(len(first)) * self.states)[:, None]
        return after[1::2].ravel()[at], count[0::2] + count[1::2].ravel()[at]

    def place(self, data: np.ndarray, levels: list[Level], state: int, rank: int) -> int:
        """The byte at which event number ``rank`` (from 0) happens, entering in ``state``."""
        at = 0
        for after, count in reversed(levels[:-1]):
            at *= 2
            if rank >= count[at, state]:
                rank, state, at = rank - int(count[at, state]), int(after[at, state]), at + 1
        for k in range(at * len(self._places), len(data)):
            kind = self.kinds[data[k]]
            if self.emits[state, kind]:
                if rank == 0:
                    return k
                rank -= 1
            state = int(self.step[state, kind])
        raise ValueError("there are fewer events")


def line_automaton(marks: Sequence[str]) -> Automaton:
    """Its events are the first bytes of lines; it accepts what holds one of ``marks``.

    A state is whether a line begins here, and the longest end of what was read that may begin a mark.
    """
    wanted = [m.encode() for m in marks]
    if not all(wanted):
        raise ValueError("a mark needs a character")
    letters = sorted(set(b"\n".join(wanted)) | {10})
    kinds = np.zeros(256, dtype=np.int64)
    for k, b in enumerate(letters):
        kinds[b] = k + 1
    stubs = {m[:n] for m in wanted for n in range(len(m))}

    def read(seen: bytes | None, byte: int | None) -> bytes | None:
        """The longest such end after one byte more, where ``None`` is a byte of no mark; None once a mark was read."""
        if seen is None:
            return None
        if byte is None:
            return b""
        whole = seen + bytes([byte])
        if any(whole.endswith(m) for m in wanted):
            return None
        return next(whole[k:] for k in range(len(whole) + 1) if whole[k:] in stubs)

    states: list[tuple[bool, bytes | None]] = [(True, b"")]
    rows = []
    for begins, seen in states:  # grows while it is read
        row = []
        for byte in [None, *letters]:
            to = (byte == 10, read(seen, byte))
            if to not in states:
                states.append(to)
            row.append(states.index(to))
        rows.append([*row, len(rows)])
    step = np.array(rows)
    emits = np.zeros_like(step)
    emits[[s for s, (begins, _) in enumerate(states) if begins], :-1] = 1
    return Automaton(kinds, step, emits, np.array([seen is None for _, seen in states]))
