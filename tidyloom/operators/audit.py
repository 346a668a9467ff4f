"""Parameters and counts of the actions that report what they do.

An action checks its parameters with ``settings``. What it counts is taken at
once (``audit=True``), not at all (``False``), or by the run itself: a ``Tally``
puts the counters into the frame (``DataFrame.observe``), so one job over the
finished table fills in the records of every step.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from tidyloom.functions.scalar import is_numeric
from tidyloom.operators.aggregates import one_row
from tidyloom.session import cut_lineage

_ABSENT = object()


def settings(action: str, params: dict | None, **rules) -> dict:
    """The parameters of an action by their rules.

    A rule is ``(default, kind)``: a tuple of the values allowed, or a function that
    turns the value given into the one used. Without a default it has to be given.
    """
    given, out = params or {}, {}
    for name, rule in rules.items():
        default, kind = rule if len(rule) == 2 else (_ABSENT, rule[0])
        value = given.get(name, default)
        if isinstance(kind, tuple):
            if value is _ABSENT or value not in kind:
                shown = "nothing" if value is _ABSENT else repr(value)
                raise ValueError(f"{action}: {name} may be {', '.join(map(str, kind))}; got {shown}")
            out[name] = value
        else:
            if value is _ABSENT:
                raise ValueError(f"{action}: {name} has to be given")
            try:
                out[name] = kind(value)
            except (TypeError, ValueError) as error:
                raise ValueError(f"{action}: {name} can't be {value!r} ({error})") from error
    return out


def list_of(kind: type, least: int = 0) -> Callable:
    """A rule: a list of ``kind`` with at least ``least`` entries."""

    def check(value) -> list:
        if value is None and not least:
            return []
        if not isinstance(value, list) or len(value) < least or not all(isinstance(v, kind) for v in value):
            raise ValueError(f"a list of {kind.__name__}" + (f", at least {least} long" if least else ""))
        return value

    return check


def columns_of(action: str, df: DataFrame, params: dict | None, numeric: bool = False, present: bool = True) -> list[str]:
    """The columns an action names: some, in the table, and numeric where it needs that."""
    names = settings(action, params, columns=(list_of(str, 1),))["columns"]
    absent = [c for c in names if c not in df.columns]
    if present and absent:
        raise ValueError(f"{action}: the table has no {', '.join(absent)}")
    other = [c for c in names if c not in absent and not is_numeric(df.schema[c].dataType)]
    if numeric and other:
        raise ValueError(f"{action} works on numbers, not on {', '.join(other)}")
    return names


class Uncounted(Exception):
    """Spark left out a counter: it drops what lies below a step that turned out to have no rows."""


class Tally:
    """Counts of several steps, taken by one job at the end of a run.

    Spark counts a task again if it loses its result and repeats it after a shuffle,
    so with lost executors the counts (never the rows) may be too high.
    """

    def __init__(self) -> None:
        self.waiting: list[tuple[str, list[str], Callable[[dict], None]]] = []

    def watch(self, df: DataFrame, counts: dict[str, Column], tell: Callable[[dict], None]) -> DataFrame:
        name = f"tally-{uuid.uuid4().hex}"
        self.waiting.append((name, list(counts), tell))
        return df.observe(name, *[e.alias(f"m{i}") for i, e in enumerate(counts.values())])

    def settle(self, df: DataFrame) -> DataFrame:
        """Store the finished table, which takes all counts, and hand them out."""
        if not self.waiting:
            return df
        done = cut_lineage(df)
        # Read from the plan that has just run. An Observation object would do it too, but
        # leaves a listener in the session that later jobs of it can't serialise.
        found = df._jdf.queryExecution().observedMetrics()
        for name, counts, tell in self.waiting:
            if not found.contains(name):
                raise Uncounted("a counter was optimised away")
            row = found.apply(name)
            tell({n: row.get(i) for i, n in enumerate(counts)})
        self.waiting.clear()
        return done


def counted(
    df: DataFrame, counts: dict[str, Column], audit: bool | Tally, tell: Callable[[dict], None]
) -> DataFrame:
    """``df``; its counts reach ``tell`` now, at the end of the run, or never."""
    if not audit or not counts:
        return df
    if isinstance(audit, Tally):
        return audit.watch(df, counts, tell)
    tell(one_row(df, counts))
    return df
