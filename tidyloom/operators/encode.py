"""Categories: one-hot, ordinal, per-column encoding and rare-value grouping."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.functions.scalar import col
from tidyloom.operators.aggregates import value_counts
from tidyloom.operators.audit import Tally, columns_of, settings
from tidyloom.operators.columns import append_columns, resolve_names, text_like
from tidyloom.operators.ranking import global_row_number, smallest

# Categories kept as literals in an expression; larger sets are joined.
LITERAL_LIMIT = 64
# Categories brought to the driver. Within Spark's per-group limit (1000), so
# finding out that a column has more costs no full sort.
DRIVER_LIMIT = 999
# Tasks that share a frequent value of a joined vocabulary, and the share of all
# rows (one in so many) from which a value is frequent.
SALTS = 8
HOT_SHARE = 256


def as_category(c: Column, missing_token: str | None = None) -> Column:
    text = c.cast("string")
    return text if missing_token is None else F.coalesce(text, F.lit(missing_token))


def can_hash(kind: T.DataType) -> bool:
    """Whether Spark hashes this type (no maps, nor anything that holds one)."""
    if isinstance(kind, T.StructType):
        return all(can_hash(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return can_hash(kind.elementType)
    return not isinstance(kind, (T.MapType, T.UserDefinedType))


def unique_names(names: list[str], taken=()) -> list[str]:
    """Spark resolves names without case: a second spelling gets a number."""
    seen = {t.lower() for t in taken}
    out = []
    for n in names:
        name, i = n, 2
        while name.lower() in seen:
            name, i = f"{n}~{i}", i + 1
        seen.add(name.lower())
        out.append(name)
    return out


def _counts(df: DataFrame, cols: list[str], missing_token: str | None) -> DataFrame:
    counts = value_counts(df, cols)
    if missing_token is None:
        return counts.where(F.col("value").isNotNull())
    token = F.coalesce("value", F.lit(missing_token))
    return (
        counts.groupBy("column", token.alias("value")).agg(F.sum("n").alias("n"))
    )


def fit_categories(
    df: DataFrame,
    cols: list[str],
    order: str = "alphabetical",
    limit: int = DRIVER_LIMIT,
    missing_token: str | None = None,
) -> dict[str, list[str]]:
    """Up to ``limit + 1`` categories per column in the given order (one job)."""
    if not cols:
        return {}
    sort = [F.asc("value")] if order == "alphabetical" else [F.desc("n"), F.asc("value")]
    top = smallest(_counts(df, cols, missing_token), ["column"], sort, limit + 1)
    out: dict[str, list] = {c: [] for c in cols}
    for r in top.collect():
        out[r["column"]].append((r["n"], r["value"]))
    key = (lambda t: t[1]) if order == "alphabetical" else (lambda t: (-t[0], t[1]))
    return {c: [v for _, v in sorted(vals, key=key)] for c, vals in out.items()}


def code_frame(
    df: DataFrame, column: str, order: str = "alphabetical", missing_token: str | None = None
) -> DataFrame:
    """``value, code, hot`` for a column with too many categories for the driver."""
    counts = _counts(df, [column], missing_token).select("value", "n")
    sort = [F.asc("value")] if order == "alphabetical" else [F.desc("n"), F.asc("value")]
    coded = global_row_number(counts, sort, "code")
    total = coded.agg(F.sum("n")).first()[0] or 0
    return coded.select("value", "code", _hot(total))


def _hot(total: int) -> Column:
    """Whether a value fills a good part of ``total`` rows; at most ``HOT_SHARE`` values do."""
    return (F.col("n") * HOT_SHARE > F.lit(total)).alias("hot")


def literal_codes(c: Column, categories: list[str]) -> Column:
    out = None
    for i, v in enumerate(categories):
        hit = c == F.lit(v)
        code = F.lit(i).cast("bigint")
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return F.lit(None).cast("bigint") if out is None else out


def dealt_codes(frame: DataFrame, out: str) -> DataFrame:
    """``__value``, its code and ``__salt``: a row for each task that gets rows of the value."""
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return frame.select(
        F.col("value").alias("__value"), F.col("code").alias(out), F.explode(salts).alias("__salt")
    )


def join_codes(df: DataFrame, value: Column, codes, out: str) -> DataFrame:
    """Left join of a category table.

    A list (at most ``DRIVER_LIMIT`` entries) is broadcast. A table that never
    came to the driver is joined without a hint: Spark broadcasts it only if
    its measured size allows. Else both sides are shuffled, and each value that
    is ``hot`` is dealt to ``SALTS`` tasks, so that no task gets all rows of a
    frequent value; the others are sent once.
    """
    if isinstance(codes, list):
        rows = [(v, i) for i, v in enumerate(codes)]
        frame = F.broadcast(df.sparkSession.createDataFrame(rows, "__value string, code bigint"))
        return df.join(frame.withColumnRenamed("code", out), value == F.col("__value"), "left").drop("__value")
    right = dealt_codes(codes, out)
    hot = F.broadcast(codes.where("hot").select(F.col("value").alias("__hot")))
    hashed = [col(f.name) for f in df.schema if can_hash(f.dataType)]
    salt = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*hashed), F.lit(SALTS))).otherwise(F.lit(0))
    dealt = df.join(hot, value == F.col("__hot"), "left").withColumn("__own", salt)
    return dealt.join(right, (value == F.col("__value")) & (F.col("__own") == F.col("__salt")), "left").drop(
        "__value", "__salt", "__hot", "__own"
    )


def with_codes(df: DataFrame, source: str, codes, out: str, missing_token=None) -> DataFrame:
    value = as_category(col(source), missing_token)
    if isinstance(codes, list) and len(codes) <= LITERAL_LIMIT:
        return df.withColumn(out, literal_codes(value, codes))
    return join_codes(df, value, codes, out)


# ---------------------------------------------------------------- eager encoding
def encode_categorical(df: DataFrame, params: dict, audit: bool | Tally = True):
    """One-hot (``<c>__<category>``, NULL stays NULL) or ordinal (``<c>__ord``)."""
    names = columns_of("encode_categorical", df, params)
    o = settings(
        "encode_categorical", params, method=(("one_hot", "ordinal"),), handle_unknown=("ignore", ("ignore", "error")),
        ordinal_order=("alphabetical", ("alphabetical", "frequency")), max_categories=(30, _positive),
        other_label=("OTHER", str), drop_first=(False, bool),
    )
    flags, most = o["method"] == "one_hot", o["max_categories"]
    found = fit_categories(
        df, names, "frequency" if flags else o["ordinal_order"], most if flags else DRIVER_LIMIT
    )
    categories: dict[str, list] = {}
    mappings: dict[str, dict] = {}
    notes, new, done = [], {}, []
    for c in names:
        if not found[c]:
            notes.append(f"{c} has no values to encode")
            continue
        if flags:
            made, categories[c], cut = _flag_columns(df, c, found[c], o, [*df.columns, *new])
            if cut:
                notes.append(f"{c}: {most} categories kept, the others are {o['other_label']}")
        else:
            df, made, codes = _code_column(df, c, found[c], o)
            if codes is not None:
                mappings[c] = codes
        new |= made
        done.append(c)
    record = {
        "method": o["method"], "unknown_handling": o["handle_unknown"],
        **{k: o[k] for k in ("drop_first", "max_categories", "other_label")},
        "encoded_columns": done, "dropped_original_columns": done, "created_columns": list(new),
        "mappings": mappings, "one_hot_categories": categories,
    }
    return (append_columns(df, new, [*done, *new]) if new else df), record, notes


def _positive(value) -> int:
    if int(value) < 1:
        raise ValueError("at least 1")
    return int(value)


def _flag_columns(df: DataFrame, c: str, by_frequency: list[str], o: dict, taken: list[str]):
    """A column for each category of ``c``, the categories, and whether some were put together."""
    value, kept = as_category(col(c)), by_frequency[: o["max_categories"]]
    cut = len(by_frequency) > len(kept)
    if cut:
        value = F.when(value.isNull() | value.isin(kept), value).otherwise(o["other_label"])
        kept = [*{*kept, o["other_label"]}]
    kept = sorted(kept)
    shown = kept[int(o["drop_first"]) :]
    columns = zip(unique_names([f"{c}__{v}" for v in shown], taken), shown)
    return {n: (value == F.lit(v)).cast("bigint") for n, v in columns}, kept, cut


def _code_column(df: DataFrame, c: str, cats: list[str], o: dict):
    """The table with codes of ``c`` joined where needed, the column, and its mapping if that is short."""
    short = len(cats) <= DRIVER_LIMIT
    name = f"{c}__ord"
    df = with_codes(df, c, cats if short else code_frame(df, c, o["ordinal_order"]), name)
    code = col(name)
    if o["handle_unknown"] == "error":
        stop = F.raise_error(F.lit(f"a category of {c} was not there when it was fitted"))
        code = F.when(col(c).isNotNull() & code.isNull(), stop).otherwise(code)
    return df, {name: code}, {v: i for i, v in enumerate(cats)} if short else None


# ---------------------------------------------------------------- fitted encoding
def fit_encoding(
    df: DataFrame, methods: dict[str, str], missing_token: str = "None", sep: str = "__"
) -> dict:
    """State for encoding each column as ``ordinal`` (unknown -> -1) or ``one_hot`` (unknown -> 0s).

    One-hot codes of a vocabulary that is too large for the driver become one
    column of sparse vectors instead of a column per category.
    """
    cats = fit_categories(df, list(methods), missing_token=missing_token)
    state = {"columns": [], "missing_token": missing_token, "frames": {}}
    taken = list(df.columns)
    for c, method in methods.items():
        entry = {"column": c, "method": method}
        if len(cats[c]) > DRIVER_LIMIT:
            state["frames"][c] = code_frame(df, c, missing_token=missing_token)
            entry["categories"] = None
        else:
            entry["categories"] = cats[c]
        if method == "one_hot" and entry["categories"] is None:
            entry["width"] = state["frames"][c].count()
            names = unique_names([f"{c}{sep}codes"], taken)
        elif method == "one_hot":
            names = unique_names([f"{c}{sep}{v}" for v in cats[c]], taken)
        else:
            names = unique_names([f"{c}__ord"], taken)
        entry["names"] = names
        taken += names
        state["columns"].append(entry)
    return state


def apply_encoding(df: DataFrame, state: dict) -> DataFrame:
    token = state["missing_token"]
    new: dict[str, Column] = {}
    gone: list[str] = []
    for e in state["columns"]:
        c = e["column"]
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
        gone.append(c)
        if e["method"] == "one_hot" and e["categories"] is None:
            name, code = e["names"][0], f"__code_{c}"
            df = with_codes(df, c, state["frames"][c], code, token)
            df = sparse_codes(df, code, name, e["width"])
            new[name] = col(name)
            gone += [code, name]
        elif e["method"] == "one_hot":
            value = as_category(col(c), token)
            for n, v in zip(e["names"], e["categories"]):
                new[n] = (value == F.lit(v)).cast("double")
        else:
            codes = e["categories"] if e["categories"] is not None else state["frames"][c]
            name = e["names"][0]
            df = with_codes(df, c, codes, name, token)
            new[name] = F.coalesce(col(name), F.lit(-1)).cast("double")
            gone.append(name)
    return append_columns(df, new, gone)


def sparse_codes(df: DataFrame, code: str, out: str, width: int) -> DataFrame:
    """A sparse vector of ``width`` with a one at ``code``; all zeros where there is none."""
    top = df.sparkSession.range(width - 1, width).select(F.col("id").cast("double").alias(code))
    encoder = OneHotEncoder(inputCols=[code], outputCols=[out], dropLast=True, handleInvalid="keep").fit(top)
    return encoder.transform(df.withColumn(code, F.coalesce(col(code), F.lit(width)).cast("double")))


def encoding_methods(
    df: DataFrame,
    encodings: dict[str, str],
    default: str,
    columns: list[str] | None = None,
    target: str | None = None,
) -> dict[str, str]:
    """Which columns to encode, and how. Numeric ones only if they are listed."""
    real = {resolve_names(df.columns, [k]).get(k, k): m for k, m in encodings.items()}
    pool = [c for c in (columns or df.columns) if c in df.columns and c != target]
    texts = set(text_like(df))
    picked = [c for c in pool if c in texts or c in real]
    methods = {c: real.get(c, default) for c in picked}
    # Ordinal columns are appended before one-hot ones.
    ordinal = {c: m for c, m in methods.items() if m == "ordinal"}
    return ordinal | {c: m for c, m in methods.items() if m == "one_hot"}


# ---------------------------------------------------------------- rare categories
def fit_rare(
    df: DataFrame,
    cols: list[str],
    min_pct: float = 0.01,
    min_abs: int = 5,
    max_categories: int | None = None,
    label: str = "Other",
) -> dict:
    """Values to keep: frequent enough, and within the top N if asked. NULL is left alone."""
    state = {"label": label, "keep": {c: [] for c in cols}, "frames": {}}
    if not cols:
        return state
    total = df.count()
    least = max(int(min_abs), round(float(min_pct) * total))
    sort = [F.desc("n"), F.asc("value")]
    frequent = _counts(df, cols, None).where(F.col("n") >= least)
    cap = DRIVER_LIMIT if max_categories is None else min(int(max_categories), DRIVER_LIMIT)
    extra = 1 if max_categories is None or int(max_categories) > DRIVER_LIMIT else 0
    for r in smallest(frequent, ["column"], sort, cap + extra).collect():
        state["keep"][r["column"]].append(r["value"])
    for c, kept in state["keep"].items():
        kept.sort()
        if len(kept) > DRIVER_LIMIT:
            one = frequent.where(F.col("column") == c).select("value", "n")
            if max_categories is not None:
                one = one.orderBy(*sort).limit(int(max_categories))
            state["frames"][c] = one.select("value", F.lit(0).cast("bigint").alias("code"), _hot(total))
            state["keep"][c] = None
    return state


def apply_rare(df: DataFrame, state: dict) -> DataFrame:
    new, helpers = {}, []
    for c, kept in state["keep"].items():
        if c not in df.columns:
            continue
        value = col(c).cast("string")
        if kept is not None and len(kept) <= LITERAL_LIMIT:
            fine = value.isNull() | (value.isin(kept) if kept else F.lit(False))
        else:
            flag = f"__keep_{c}"
            df = join_codes(df, value, kept if kept is not None else state["frames"][c], flag)
            helpers.append(flag)
            fine = value.isNull() | col(flag).isNotNull()
        new[c] = F.when(fine, value).otherwise(F.lit(state["label"]))
    return df.withColumns(new).drop(*helpers) if new else df
