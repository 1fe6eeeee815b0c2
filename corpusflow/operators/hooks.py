"""User hooks: chained text transforms and observers."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators.arrow_text import text_pieces

log = logging.getLogger(__name__)

TEXT_STAGES = ("after_parse", "before_call", "after_call")
OBSERVER_STAGES = ("before_parse", "batch_before", "batch_after")


def row_hook(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """A Python text function as a column hook; a null, and a row it fails on, pass unchanged."""

    def guarded(value):
        try:
            return value if value is None else fn(value)
        except Exception:
            return value

    def batches(texts):
        for batch in texts:
            for piece in text_pieces(batch):
                yield pa.array([guarded(value) for value in piece.to_pylist()], pa.string())

    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(batches, T.StringType()).asNondeterministic()  # not copied into later expressions
    return lambda c: udf(c)


@dataclass
class Hooks:
    """Hooks per stage, run in registration order; a hook that cannot be built is logged and skipped."""

    text: dict[str, list[tuple[str, Callable[[Column], Column]]]] = field(default_factory=dict)
    observers: dict[str, list[tuple[str, Callable[[DataFrame], None]]]] = field(default_factory=dict)

    def on_text(self, stage: str, name: str, hook: Callable[[Column], Column]) -> None:
        if stage not in TEXT_STAGES:
            raise ValueError(f"unknown text stage {stage}")
        self.text.setdefault(stage, []).append((name, hook))

    def on_event(self, stage: str, name: str, observer: Callable[[DataFrame], None]) -> None:
        if stage not in OBSERVER_STAGES:
            raise ValueError(f"unknown observer stage {stage}")
        self.observers.setdefault(stage, []).append((name, observer))

    def around_calls(self) -> bool:
        """There are hooks before or after model calls."""
        return any(self.text.get(stage) for stage in ("before_call", "after_call"))

    def apply(self, stage: str, value: Column) -> Column:
        for name, hook in self.text.get(stage, []):
            try:
                value = hook(value)
            except Exception as error:
                log.error("hook %s at %s skipped: %s", name, stage, error)
        return value

    def notify(self, stage: str, df: DataFrame) -> None:
        for name, observer in self.observers.get(stage, []):
            try:
                observer(df)
            except Exception as error:
                log.error("observer %s at %s skipped: %s", name, stage, error)


def counted(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """Attach counters that are filled when ``df`` is first written or read; no extra pass."""
    observation = Observation(name)
    return df.observe(observation, *[c.alias(n) for n, c in counters.items()]), observation
