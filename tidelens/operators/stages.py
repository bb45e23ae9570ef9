"""Run many indicators over numbered bars in as few passes as possible.

An indicator is a generator that asks for passes over the series and finally returns
its output columns. ``compute`` advances all chosen indicators together and merges
their requests: all rolling frames wanted in a round share one blocked pass (one
exchange, one sort), all recurrences share one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .replay import replay
from .series import WIDE_FRAME, affine_scan, blocks, prefix, unblock


MAX_DOUBLINGS = 3


@dataclass
class Roll:
    """Rolling frames: ``steps`` are dicts name -> column, each may use the earlier ones."""

    steps: list[dict[str, Column]]
    history: int
    ahead: int = 0


@dataclass
class Scan:
    """Affine recurrences: name -> (factor, increment)."""

    specs: dict


@dataclass
class Cum:
    """Whole-series running aggregates: name -> (kind, column)."""

    specs: dict


@dataclass
class Replay:
    """A state machine over the series; see ``replay``."""

    step: Callable
    inputs: list[str]
    outputs: dict


class Temp:
    """Names for the intermediate columns of one indicator."""

    def __init__(self, label: str):
        self.label = "".join(ch if ch.isalnum() else "_" for ch in label)

    def __call__(self, name: str) -> str:
        return f"_{self.label}_{name}"

    def __getitem__(self, name: str) -> Column:
        return F.col(self(name))


Indicator = Callable[..., Generator]


@dataclass
class _Run:
    gen: Generator
    request: object = None
    outputs: dict = field(default_factory=dict)


def _advance(run: _Run) -> bool:
    try:
        run.request = next(run.gen)
        return True
    except StopIteration as stop:
        run.outputs, run.request = stop.value, None
        return False


def _pass(df: DataFrame, kind: type, requests: list, rows) -> DataFrame:
    if kind is Roll:
        history = max(r.history for r in requests)
        df = blocks(df, history, max(r.ahead for r in requests), rows, history >= WIDE_FRAME)
        for i in range(max(len(r.steps) for r in requests)):
            merged = {}
            for r in requests:
                if i < len(r.steps):
                    merged.update(r.steps[i])
            df = df.withColumns(merged)
        return unblock(df)
    if kind is Replay:
        for r in requests:
            df = df.join(replay(df, r.step, r.inputs, r.outputs), ["symbol", "_rn"])
        return df
    merged = {}
    for r in requests:
        merged.update(r.specs)
    return affine_scan(df, merged) if kind is Scan else prefix(df, merged)


def compute(bars: DataFrame, chosen: dict[str, Generator], keep=("symbol", "ts"), rows: int | None = None) -> DataFrame:
    """``bars`` are numbered (``_rn``); ``chosen`` maps label -> started-able generator.

    Output columns are named ``label`` or ``label_part``.
    """
    runs = {label: _Run(gen) for label, gen in chosen.items()}
    active = [r for r in runs.values() if _advance(r)]
    df, reads = bars, 1  # numbering reads the bars twice
    while active:
        for kind in (Replay, Roll, Scan, Cum):
            due = [r for r in active if isinstance(r.request, kind)]
            if due:
                # recurrences read their input twice: the plan doubles with each, so cut it now and then
                twice = 0 if kind is Roll else len(due) if kind is Replay else 1
                if twice and reads + twice > MAX_DOUBLINGS:
                    df, reads = cut_lineage(df), 0
                reads += twice
                df = _pass(df, kind, [r.request for r in due], rows)
                active = [r for r in active if r not in due or _advance(r)]
    out = []
    for label, run in runs.items():
        for part, column in run.outputs.items():
            out.append(column.alias(f"{label}_{part}" if part else label))
    return df.select(*keep, *out)
