"""Shared aggregate helpers: one-row statistics, exact quantiles, value counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.scalar import col

# Expressions per aggregate job: beyond this the generated plan gets unwieldy.
CHUNK = 400
# Values that may be gathered, over all columns, for the last step of a quantile search.
GATHER_LIMIT = 50_000
_SKETCH_ACCURACY = 20_000


def one_row(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """Evaluate aggregate expressions over ``df``; a bounded, one-row result."""
    out: dict = {}
    names = list(exprs)
    for start in range(0, len(names), CHUNK):
        part = names[start : start + CHUNK]
        row = df.agg(*[exprs[n].alias(f"s{i}") for i, n in enumerate(part)]).first()
        out.update({n: row[i] for i, n in enumerate(part)})
    return out


def _sketch_points(p: float) -> list[float]:
    near = [p + d for d in (-2e-3, -5e-4, -2e-4, 0.0, 2e-4, 5e-4, 2e-3)]
    return sorted({min(1.0, max(0.0, q)) for q in (0.0, *near, 1.0)})


def exact_quantiles(
    df: DataFrame, wanted: dict[str, list[float]], gather_limit: int = GATHER_LIMIT
) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of many columns, for tables of any size.

    Each order statistic is found by narrowing: a mergeable sketch proposes
    pivots, exact counts below each pivot say between which two the wanted rank
    lies, and the search goes on inside that interval until its values are few
    enough to be gathered. Every pass is a plain aggregate with a small state,
    and a value that repeats often ends the search at once. The first sketch
    comes with the counts.
    """
    cols = list(wanted)
    if not cols:
        return {}
    first = {}
    spots = {c: sorted({q for p in wanted[c] for q in _sketch_points(p)}) for c in cols}
    for c in cols:
        x = col(c).cast("double")
        first |= {f"n:{c}": F.count(x), f"s:{c}": F.percentile_approx(x, spots[c], _SKETCH_ACCURACY)}
    stats = one_row(df, first)
    counts = {c: stats[f"n:{c}"] for c in cols if stats[f"n:{c}"]}
    places = {c: [p * (counts[c] - 1) for p in wanted[c]] for c in counts}
    ranks = {c: {math.floor(h) for h in hs} | {math.ceil(h) for h in hs} for c, hs in places.items()}
    found = order_statistics(df, ranks, counts, gather_limit, {c: stats[f"s:{c}"] for c in counts})
    out: dict[str, list[float | None]] = {c: [None] * len(wanted[c]) for c in cols}
    for c, hs in places.items():
        ends = [(found[c, math.floor(h)], found[c, math.ceil(h)], h % 1) for h in hs]
        out[c] = [lo + (hi - lo) * part for lo, hi, part in ends]
    return out


@dataclass(frozen=True)
class _Interval:
    """Open interval of one column, with the counts at or below its low end and inside."""

    column: str
    low: float | None
    high: float | None
    below: int
    size: int

    def inside(self) -> Column:
        x = col(self.column).cast("double")
        cond = x.isNotNull()
        if self.low is not None:
            cond = cond & (x > self.low)
        if self.high is not None:
            cond = cond & (x < self.high)
        return F.when(cond, x)


def order_statistics(
    df: DataFrame,
    ranks: dict[str, set[int]],
    counts: dict[str, int],
    gather_limit: int = GATHER_LIMIT,
    sketches: dict[str, list[float]] | None = None,
) -> dict[tuple[str, int], float]:
    """The k-th smallest non-NULL value (0-based) for several ``(column, k)``.

    Ranks that lie in the same interval share its sketch, pivots and counts.
    ``sketches`` may give the first pivots of the columns. At most
    ``gather_limit`` values are gathered at once, the smallest intervals first.
    """
    open_ = {_Interval(c, None, None, 0, counts[c]): set(ks) for c, ks in ranks.items()}
    known = {iv: (sketches or {}).get(iv.column) for iv in open_}
    found: dict[tuple[str, int], float] = {}
    while open_:
        small, room = [], gather_limit
        for iv in sorted(open_, key=lambda v: v.size):
            room -= iv.size
            if room < 0:
                break
            small.append(iv)
        if small:
            got = one_row(
                df,
                {str(i): F.sort_array(F.collect_list(iv.inside())) for i, iv in enumerate(small)},
            )
            for i, iv in enumerate(small):
                found |= {(iv.column, k): got[str(i)][k - iv.below] for k in open_.pop(iv)}
            continue

        spots = {
            iv: sorted({q for k in ks for q in _sketch_points((k - iv.below) / max(iv.size - 1, 1))})
            for iv, ks in open_.items()
            if not known.get(iv)
        }
        fresh = one_row(
            df,
            {
                str(i): F.percentile_approx(iv.inside(), qs, _SKETCH_ACCURACY)
                for i, (iv, qs) in enumerate(spots.items())
            },
        )
        known |= {iv: fresh[str(i)] for i, iv in enumerate(spots)}
        pivots = {iv: sorted(set(known[iv])) for iv in open_}
        exprs = {}
        for i, (iv, values) in enumerate(pivots.items()):
            x = col(iv.column).cast("double")
            for j, v in enumerate(values):
                exprs |= {f"{i}<{j}": F.count_if(x < v), f"{i}={j}": F.count_if(x <= v)}
        tally = one_row(df, exprs)
        nearer: dict[_Interval, set[int]] = {}
        for i, (iv, values) in enumerate(pivots.items()):
            for k in open_[iv]:
                hit = next(
                    (v for j, v in enumerate(values) if tally[f"{i}<{j}"] <= k < tally[f"{i}={j}"]), None
                )
                if hit is not None:
                    found[iv.column, k] = hit
                    continue
                low, below, high, top = iv.low, iv.below, iv.high, iv.below + iv.size
                for j, v in enumerate(values):
                    if tally[f"{i}={j}"] <= k:
                        low, below = v, tally[f"{i}={j}"]
                    else:
                        high, top = v, tally[f"{i}<{j}"]
                        break
                nearer.setdefault(_Interval(iv.column, low, high, below, top - below), set()).add(k)
        open_ = nearer
        known = {}
    return found


def long_form(df: DataFrame, cols: list[str], value_type: str = "string") -> DataFrame:
    """One row per cell: ``column``, ``value`` (cast to one type)."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), col(c).cast(value_type).alias("value"))
            for c in cols
        ]
    )
    return df.select(F.explode(cells).alias("cell")).select("cell.column", "cell.value")


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact counts per (column, value), NULL kept as a value.

    The partial aggregation runs before the shuffle, so a value that fills a
    third of the table costs one row per task.
    """
    return long_form(df, cols).groupBy("column", "value").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- values by digest
#: Bytes of a value that travel with its digest.
HEAD = 16
#: Values that are fetched at once, per column.
FETCH_LIMIT = 200


def _digest(value: Column) -> tuple[Column, Column]:
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def digest_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column, h1, h2, n, head, size``: a row per distinct value other than NULL.

    Values are told apart by 128 bits; the first bytes and the length come along, so
    whatever is shuffled has a fixed size, however long the texts are.
    """
    h1, h2 = _digest(F.col("value"))
    head = F.substring(F.encode("value", "UTF-8"), 1, HEAD)
    cells = long_form(df, cols).where(F.col("value").isNotNull())
    cells = cells.select("column", h1.alias("h1"), h2.alias("h2"), head.alias("head"), F.octet_length("value").alias("size"))
    return cells.groupBy("column", "h1", "h2").agg(
        F.count("*").alias("n"), F.min("head").alias("head"), F.min("size").alias("size")
    )


def value_figures(digests: DataFrame) -> DataFrame:
    """``column, n_unique, top_count, n_values``: distinct values, rows of the most frequent one, rows."""
    return digests.groupBy("column").agg(
        F.count("*").alias("n_unique"), F.max("n").alias("top_count"), F.sum("n").alias("n_values")
    )


def _fetched(df: DataFrame, wanted: list) -> dict[tuple[str, int, int], str]:
    """The values of some digests; long ones by one more scan, a minimum each."""
    short = {(r["column"], r["h1"], r["h2"]): bytes(r["head"]).decode("utf-8", "replace") for r in wanted if r["size"] <= HEAD}
    exprs = {}
    for r in wanted:
        if r["size"] > HEAD:
            value = col(r["column"]).cast("string")
            h1, h2 = _digest(value)
            key = r["column"], r["h1"], r["h2"]
            exprs[key] = F.min(F.when((h1 == F.lit(r["h1"])) & (h2 == F.lit(r["h2"])), value))
    return short | (one_row(df, exprs) if exprs else {})


def smallest_values(df: DataFrame, digests: DataFrame, cols: list[str], k: int) -> dict[str, list[str]]:
    """The ``k`` smallest distinct values of each column, found by their first bytes.

    Columns with very many values that begin alike are asked for the values themselves.
    """
    from tidyloom.operators.ranking import smallest

    order = [F.asc("head"), F.asc("size"), F.asc("h1"), F.asc("h2")]
    some = smallest(digests, ["column"], order, max(k, FETCH_LIMIT) + 1).collect()
    found, crowded = _smallest_of(df, some, cols, k, max(k, FETCH_LIMIT))
    if crowded:
        rows = smallest(value_counts(df, crowded).where(F.col("value").isNotNull()), ["column"], [F.asc("value")], k).collect()
        found |= {c: sorted(r["value"] for r in rows if r["column"] == c) for c in crowded}
    return found


def _smallest_of(df: DataFrame, rows: list, cols: list[str], k: int, limit: int) -> tuple[dict, list[str]]:
    wanted, crowded = [], []
    for c in cols:
        own = sorted((r for r in rows if r["column"] == c), key=lambda r: bytes(r["head"]))
        last = bytes(own[min(k, len(own)) - 1]["head"]) if own and k else b""
        # Values that begin like the last one wanted compete with it.
        near = [r for r in own if bytes(r["head"]) <= last] if k else []
        if len(near) > limit:
            crowded.append(c)
        else:
            wanted += near
    values = _fetched(df, wanted)
    found: dict[str, list[str]] = {c: [] for c in cols if c not in crowded}
    for (c, _, _), v in values.items():
        found[c].append(v)
    return {c: sorted(v)[:k] for c, v in found.items()}, crowded


def top_values(df: DataFrame, digests: DataFrame, cols: list[str]) -> dict[str, tuple[str, int]]:
    """The most frequent value of each column and its rows, ties to the smallest; NULL counts for nothing."""
    from tidyloom.operators.ranking import smallest

    rows = smallest(digests, ["column"], [F.desc("n"), F.asc("head"), F.asc("size"), F.asc("h1"), F.asc("h2")], FETCH_LIMIT + 1).collect()
    most = {c: max((r["n"] for r in rows if r["column"] == c), default=0) for c in cols}
    tied = [r for r in rows if r["n"] == most[r["column"]]]
    # Where all values are different, the smallest of all is wanted.
    unlike = [c for c in cols if most[c] == 1 and sum(r["column"] == c for r in tied) > FETCH_LIMIT]
    out = {}
    if unlike:
        least = one_row(df, {c: F.min(col(c).cast("string")) for c in unlike})
        out = {c: (least[c], 1) for c in unlike}
    found, crowded = _smallest_of(df, tied, [c for c in cols if most[c] and c not in out], 1, FETCH_LIMIT)
    out |= {c: (v[0], most[c]) for c, v in found.items()}
    if crowded:
        best = value_counts(df, crowded).where(F.col("value").isNotNull()).groupBy("column").agg(
            F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b")
        )
        out |= {r["column"]: (r["b"]["value"], -r["b"]["n"]) for r in best.collect()}
    return out


def missing_counts(df: DataFrame, cols: list[str] | None = None) -> tuple[int, dict[str, int]]:
    cols = list(df.columns if cols is None else cols)
    exprs = {"*": F.count(F.lit(1))} | {c: F.count(col(c)) for c in cols}
    got = one_row(df, exprs)
    total = got.pop("*") if "*" not in cols else got["*"]
    return total, {c: total - got[c] for c in cols}
