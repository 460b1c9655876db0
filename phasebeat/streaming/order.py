"""The rows of one key in order, however many frames a trigger brings."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from itertools import chain
from operator import attrgetter

import pandas as pd

# Schemas of the state that holds sorted runs while they are merged; it is empty between triggers.
RUN_KEY, RUN_VALUE = "run long, block long", "rows binary"
# Rows of a run that are in memory at once, runs that are merged at once, rows that are given back at once.
BLOCK_ROWS, FAN_IN, OUT_ROWS = 256, 32, 4096


class Runs:
    """A merge sort whose runs are kept in a map state, block by block.

    Every frame is sorted and put away as a run.  Runs are then merged with one block of each in memory, in several passes if
    there are many, so what a call holds is one frame or ``FAN_IN`` blocks, whatever the length of the key's sequence.  A key with a
    single frame needs no state at all.
    """

    def __init__(self, state, column: str, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN):
        self.state, self.column, self.block_rows, self.fan_in = state, column, block_rows, fan_in
        self.blocks: dict[int, int] = {}
        self.made = 0

    def _put(self, rows: Iterator[tuple]) -> None:
        run, block, n = self.made, [], 0
        for row in chain(rows, [None]):
            if row is not None:
                block.append(tuple(row))
            if block and (row is None or len(block) == self.block_rows):
                self.state.updateValue((run, n), (pickle.dumps(block),))
                block, n = [], n + 1
        self.blocks[run] = n
        self.made += 1

    def _take(self, run: int, row: Callable) -> Iterator[tuple]:
        for n in range(self.blocks.pop(run)):
            (block,) = self.state.getValue((run, n))
            self.state.removeKey((run, n))
            yield from map(row._make, pickle.loads(block))

    def of(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """The rows of all frames as named tuples, by ``column``; rows with equal values keep the order of their frames."""
        first = next(frames, None)
        if first is None:
            return
        by = attrgetter(self.column)

        def in_frame(frame: pd.DataFrame) -> Iterator[tuple]:
            return frame.sort_values(self.column, kind="stable").itertuples(index=False, name="Row")

        second = next(frames, None)
        if second is None:
            yield from in_frame(first)
            return
        kind = type(next(first.itertuples(index=False, name="Row")))
        for frame in chain([first, second], frames):
            self._put(in_frame(frame))
        del first, second
        while len(self.blocks) > self.fan_in:
            # The oldest runs go together and the result comes first, which keeps equal values in order.
            runs = sorted(self.blocks)
            for at in range(0, len(runs), self.fan_in):
                self._put(heapq.merge(*[self._take(r, kind) for r in runs[at : at + self.fan_in]], key=by))
        yield from heapq.merge(*[self._take(r, kind) for r in sorted(self.blocks)], key=by)


def in_parts(rows: Iterator[tuple], columns: list[str], size: int = OUT_ROWS) -> Iterator[pd.DataFrame]:
    """Frames of some thousand rows each."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)
