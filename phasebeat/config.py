"""Parameters of the analysis."""

from __future__ import annotations

from dataclasses import dataclass

# Resource names in the order in which sample lines carry them.
RESOURCES = ("cpu", "mem")

# Rows of one ordered sequence that a single task may sort.  Sequences are indexed by a
# unique integer, so a range of this length bounds every group, however skewed the keys.
SEGMENT_ROWS = 1 << 16
# Versions of one phase that are folded in sequence before the next segment starts.
CHAIN_ROWS = 1 << 14


@dataclass(frozen=True)
class Settings:
    """Defaults are fixed values that results depend on; every one can be overridden."""

    threshold: float = 0.6
    batch_size: int = 3
    alpha: float = 0.1
    replay: int = 5
    seed: int = 0
    stride: int = 2
    cpu_floor: float = 10.0
    mape_limit: float = 50.0
    confidence_limit: int = 5
    window: str = "5 minutes"
    variant: str = "v2"
    algo: str = "lasso"
    segment_rows: int = SEGMENT_ROWS
    chain_rows: int = CHAIN_ROWS

    def __post_init__(self) -> None:
        if self.variant not in ("v1", "v2"):
            raise ValueError(f"unknown variant {self.variant!r}")
        if self.algo not in ("simple", "lasso", "agg"):
            raise ValueError(f"unknown algorithm {self.algo!r}")
        if self.stride < 1 or self.batch_size < 1 or min(self.segment_rows, self.chain_rows) < 2:
            raise ValueError("stride, batch_size, segment_rows and chain_rows must be positive")

    @property
    def cycle(self) -> int:
        """Visits of a phase from one training to the next.

        The first variant trains on the visit after the batch is full and drops the
        profile of that visit.
        """
        return self.batch_size + 1 if self.variant == "v1" else self.batch_size

    @property
    def measurement_suffix(self) -> str:
        return "_old_code" if self.variant == "v1" else ""
