"""A driver for iterations over written state tables."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .storage import drop_written, written


@dataclass
class State:
    table: DataFrame
    error: float
    iteration: int


class Iteration(ABC):
    """Runs :meth:`step` until ``max_iterations`` are done or the error is at most ``tolerance``."""

    def __init__(self, max_iterations: int | None, tolerance: float):
        self.max_iterations, self.tolerance = max_iterations, tolerance

    @abstractmethod
    def initial(self) -> DataFrame: ...

    @abstractmethod
    def step(self, table: DataFrame) -> DataFrame:
        """The next table; a plan that reads the last one, which is a written table."""

    @abstractmethod
    def error(self, table: DataFrame) -> float:
        """Of a written table that :meth:`step` made."""

    def finish(self, state: State) -> State:
        return state

    def run(self, init: DataFrame | None = None) -> State:
        state = State(written(init if init is not None else self.initial(), "state"), 100.0 + self.tolerance, 0)
        while (self.max_iterations is None or state.iteration < self.max_iterations) and state.error > self.tolerance:
            table = written(self.step(state.table), "state")
            done = State(table, self.error(table), state.iteration + 1)
            drop_written(state.table)
            state = done
        return self.finish(state)
