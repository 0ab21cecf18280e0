"""The evidence model: votes, cells, and the tables that make up a store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

SAME, DIFFERENT, UNKNOWN = "same", "different", "unknown"
PAIR = ["h_left", "h_right"]
KEY = [*PAIR, "epoch", "source"]
CELL = "h_left string, h_right string, epoch bigint, source string, vote string, reason string"


@dataclass(frozen=True)
class Evidence:
    """cells(h_left, h_right, epoch, source, vote, reason), handles(handle), floors(h_left, h_right,
    epoch); `sources` is the registry and `threshold` the positive votes that SAME takes."""

    cells: DataFrame
    handles: DataFrame
    sources: tuple[str, ...]
    threshold: int
    floors: DataFrame | None = None

    def __post_init__(self) -> None:
        if not self.sources or len(set(self.sources)) != len(self.sources):
            raise ValueError("sources must be non-empty and unique")
        if isinstance(self.threshold, bool) or not 1 <= self.threshold <= len(self.sources):
            raise ValueError("the threshold lies between 1 and the number of sources")
