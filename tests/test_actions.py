"""Single operators on tiny frames."""

import pytest
from pyspark.sql import functions as F

from tidyloom.operators import columns, dedup, encode, missing, numeric, texts
from tidyloom.operators.columns import fix_column_names


@pytest.fixture
def people(spark):
    rows = [("  Ana", 25.0, "Lisboa"), ("Bruno", 40.0, "Porto"), ("Bruno", 40.0, "Porto"), (None, None, "Faro")]
    return spark.createDataFrame(rows, "`First Name` string, Age double, `City-Name` string")


def values(df, c):
    return [r[c] for r in df.collect()]


def test_names(people):
    out, diff, notes = fix_column_names(people)
    assert out.columns == ["first_name", "age", "city_name"]
    assert diff["columns_renamed"]["First Name"] == "first_name"
    assert people.columns == ["First Name", "Age", "City-Name"]


def test_name_collision_is_an_error(spark):
    with pytest.raises(ValueError):
        fix_column_names(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


@pytest.mark.parametrize("impute", [{"numeric": "median"}, {"numeric": "mean"}, {}])
def test_impute_one_column(spark, impute):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (5.0,)], "x double")
    out, diff, _ = missing.handle_missing(df, {"columns": ["x"], "strategy": "impute", "impute": impute})
    assert sorted(values(out, "x")) == pytest.approx([1.0, 3.0, 3.0, 5.0])
    assert "x" in diff["imputation_values"]


def test_impute_unknown_strategy_is_an_error(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        missing.handle_missing(df, {"columns": ["x"], "strategy": "magic"})


def test_all_missing_columns_get_constants(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    out, _, _ = missing.handle_missing(df, {"columns": ["x", "s"]})
    assert out.collect()[0] == (0.0, "MISSING")


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    assert missing.fit_mode(df, ["s"]) == {"s": "a"}


def test_text(spark):
    df = spark.createDataFrame([("  Hello ",), ("WORLD",)], "c string")
    out, diff, _ = texts.normalize_text(df, {"columns": ["c"], "ops": ["strip", "lower", "collapse_whitespace"]})
    assert values(out, "c") == ["hello", "world"]
    assert diff["values_changed_count"] == {"c": 2}


def test_text_unicode_whitespace_and_accents(spark):
    df = spark.createDataFrame([(" café  ﬁn\u001c",), (None,)], "c string")
    ops = ["strip", "remove_accents", "collapse_whitespace"]
    out, _, _ = texts.normalize_text(df, {"columns": ["c"], "ops": ops})
    assert values(out, "c") == ["cafe fin", None]


def test_text_rules_tokens_and_policy(spark):
    df = spark.createDataFrame([("ab-12", 1), ("NULL", 2)], "c string, n int")
    params = {
        "columns": ["c", "n"],
        "ops": [],
        "replace": [{"pattern": r"(?P<w>[a-z]+)-(\d+)", "repl": r"\2:\g<w>$"}],
        "null_like_to_nan": ["null"],
        "non_string_policy": "skip",
    }
    out, diff, notes = texts.normalize_text(df, params)
    assert values(out, "c") == ["12:ab$", None]
    assert values(out, "n") == [1, 2]
    assert diff["null_like_converted_to_nan"] == {"c": 1}
    assert diff["replacements_applied"] == {"c": 1}
    assert len(notes) == 1 and notes[0].startswith("n ")


def test_dedup_full_row(people):
    out, diff, _ = dedup.deduplicate(people, {"subset": None, "keep": "first"})
    assert out.count() == 3 and diff["rows_removed"] == 1


def test_dedup_keeps(spark):
    rows = [(1, "A"), (2, "a"), (3, "b"), (4, None), (5, None)]
    df = spark.createDataFrame(rows, "id int, k string")
    base = {"subset": ["k"], "case_insensitive": True, "order_by": ["id"]}
    assert sorted(values(dedup.deduplicate(df, base | {"keep": "first"})[0], "id")) == [1, 3, 4]
    assert sorted(values(dedup.deduplicate(df, base | {"keep": "last"})[0], "id")) == [2, 3, 5]
    out, diff, _ = dedup.deduplicate(df, base | {"keep": "none"})
    assert values(out, "id") == [3]
    assert diff["rows_removed"] == 4 and len(diff["duplicate_key_examples"]) == 2


def test_dedup_subset_needs_an_order(people):
    with pytest.raises(ValueError):
        dedup.deduplicate(people, {"subset": ["Age"]})


def test_drop_column(people):
    out, diff, notes = columns.drop_column(people, {"columns": ["Age"], "reason": "test"})
    assert "Age" not in out.columns and diff["cols_after"] == 2 and notes == []
    with pytest.raises(ValueError):
        columns.drop_column(people, {"columns": ["nope"]})
    with pytest.raises(ValueError):
        columns.drop_column(people, {"columns": ["Age"], "target_column": "Age"})
    out, _, notes = columns.drop_column(
        people, {"columns": ["Age"], "target_column": "Age", "allow_drop_target": True}
    )
    assert len(notes) == 1


def test_one_hot(spark):
    df = spark.createDataFrame([("red",), ("green",), ("blue",), ("red",), (None,)], "colour string")
    out, diff, _ = encode.encode_categorical(df, {"columns": ["colour"], "method": "one_hot"})
    assert out.columns == ["colour__blue", "colour__green", "colour__red"]
    assert out.agg(F.sum("colour__red")).first()[0] == 2
    assert out.where("colour__red IS NULL").count() == 1


def test_one_hot_drop_first_limit_and_case(spark):
    df = spark.createDataFrame([("b",), ("b",), ("B",), ("a",), ("c",)], "k string")
    out, diff, notes = encode.encode_categorical(
        df, {"columns": ["k"], "method": "one_hot", "max_categories": 2, "drop_first": True}
    )
    assert diff["one_hot_categories"]["k"] == ["B", "OTHER", "b"]
    assert out.columns == ["k__OTHER", "k__b"] and notes
    out, diff, _ = encode.encode_categorical(df, {"columns": ["k"], "method": "one_hot"})
    assert len({c.lower() for c in out.columns}) == len(out.columns) == 4


def test_fitted_encoding_unknown(spark):
    train = spark.createDataFrame([("a", "x"), ("b", None)], "k string, m string")
    test = spark.createDataFrame([("zz", "q"), (None, None)], "k string, m string")
    state = encode.fit_encoding(train, {"k": "ordinal", "m": "one_hot"})
    out = encode.apply_encoding(test, state)
    assert values(out, "k__ord") == [-1.0, -1.0]
    assert [tuple(r)[1:] for r in out.collect()] == [(0.0, 0.0), (1.0, 0.0)]


def test_outliers(spark):
    df = spark.createDataFrame([(10,), (11,), (12,), (13,), (1000,)], "v long")
    params = {"columns": ["v"], "method": "iqr", "iqr_k": 1.5, "mode": "drop_rows", "combine": "any"}
    out, diff, _ = numeric.remove_outliers(df, params)
    assert sorted(values(out, "v")) == [10, 11, 12, 13] and diff["rows_removed"] == 1
    out, diff, _ = numeric.remove_outliers(df, params | {"mode": "clip"})
    assert max(values(out, "v")) == 16.0 and diff["values_clipped_count"] == {"v": 1}


def test_outliers_keep_missing_and_flat_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (2.0, 5.0), (3.0, 9.0)], "v double, f double")
    out, diff, notes = numeric.remove_outliers(df, {"columns": ["v", "f"], "method": "iqr", "mode": "clip"})
    assert out.where("v IS NULL").count() == 1
    with pytest.raises(ValueError):
        numeric.remove_outliers(df.withColumn("s", F.lit("x")), {"columns": ["s"], "method": "iqr"})


def test_casts(spark):
    df = spark.createDataFrame([("1", "12.0", "yes"), ("x", "12.5", "TRUE")], "a string, b string, c string")
    out, diff, _ = columns.cast_type(df, {"columns": ["a", "b"], "dtype": "int", "errors": "coerce"})
    assert [tuple(r)[:2] for r in out.collect()] == [(1, 12), (None, None)]
    assert diff["invalid_values_coerced"] == {"a": 1, "b": 1}
    with pytest.raises(RuntimeError):
        columns.cast_type(df, {"columns": ["a"], "dtype": "float"})
    out, diff, _ = columns.cast_type(df, {"columns": ["a"], "dtype": "float", "errors": "ignore"})
    assert out.schema["a"].dataType.simpleString() == "string" and diff["columns_casted"] == []
    out, _, _ = columns.cast_type(spark.range(3), {"columns": ["id"], "dtype": "string"})
    assert out.schema["id"].dataType.simpleString() == "string"


def test_cast_large_integers_stay_exact(spark):
    df = spark.createDataFrame([("9007199254740993",)], "a string")
    out, _, _ = columns.cast_type(df, {"columns": ["a"], "dtype": "int", "errors": "coerce"})
    assert values(out, "a") == [9007199254740993]


def test_datetime_pattern(spark):
    df = spark.createDataFrame([("03/Feb/2024 10:30",), ("bad",)], "t string")
    out, _, _ = columns.cast_type(
        df,
        {"columns": ["t"], "dtype": "datetime", "errors": "coerce", "datetime_format": "%d/%b/%Y %H:%M"},
    )
    assert [str(v) for v in values(out, "t")] == ["2024-02-03 10:30:00", "None"]


def test_parameters_are_checked(spark):
    df = spark.createDataFrame([("a", 1.0)], "s string, n double")
    for call, params in [
        (columns.drop_column, {}), (columns.drop_column, {"columns": ["n"], "on_missing": "hide"}), (columns.cast_type, {"columns": ["n"]}),
        (columns.cast_type, {"columns": ["gone"], "dtype": "int"}), (columns.cast_type, {"columns": ["n"], "dtype": "int", "errors": "no"}),
        (texts.normalize_text, {"columns": ["s"], "ops": ["shout"]}), (texts.normalize_text, {"columns": ["s"], "ops": "strip"}),
        (texts.normalize_text, {"columns": ["s"], "replace": [{"repl": "x"}]}), (texts.normalize_text, {"columns": ["s"], "null_like_to_nan": "NA"}),
        (texts.normalize_text, {"columns": ["s"], "non_string_policy": "?"}), (texts.normalize_text, {"columns": []}),
        (dedup.deduplicate, {"keep": "any"}), (dedup.deduplicate, {"subset": []}), (dedup.deduplicate, {"subset": ["gone"]}),
        (encode.encode_categorical, {"columns": ["s"]}), (encode.encode_categorical, {"columns": ["s"], "method": "one_hot", "max_categories": 0}),
        (encode.encode_categorical, {"columns": ["s"], "method": "ordinal", "ordinal_order": "size"}),
        (numeric.remove_outliers, {"columns": ["n"]}), (numeric.remove_outliers, {"columns": ["n"], "method": "iqr", "iqr_k": "wide"}),
        (numeric.remove_outliers, {"columns": ["n"], "method": "iqr", "combine": "most"}),
    ]:
        with pytest.raises(ValueError):
            call(df, params)


def test_rare_categories(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 5 + [("c",)] + [(None,)], "k string")
    out = encode.apply_rare(df, encode.fit_rare(df, ["k"]))
    counts = {r["k"]: r["count"] for r in out.groupBy("k").count().collect()}
    assert counts == {"a": 6, "b": 5, "Other": 1, None: 1}


def test_indicators_limits(spark):
    df = spark.createDataFrame([(None, None, 1), (1, 2, 3)], "a int, b int, c int")
    assert missing.fit_indicators(df, max_indicators=1) == ["a"]
    assert missing.fit_indicators(df, columns=["C", "b"], exclude={"b"}) == ["c"]


def test_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "v double")
    state = numeric.fit_bins(df, ["v"], 3, "custom", splits={"v": [2.0, 5.0]})
    out = numeric.apply_bins(df, state)
    assert sorted(values(out, "v__bin")) == [0.0] * 2 + [1.0] * 4 + [2.0] * 5
    flat = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert numeric.apply_bins(flat, numeric.fit_bins(flat, ["v"])).columns == ["v"]


def test_choose_columns_and_all_token(people):
    assert columns.known_columns(people, ["Age", "ghost"]) == (["Age"], ["ghost"])
    assert columns.known_columns(people, ["all"]) == ([], [])
    assert columns.choose_columns("handle_missing", people) == ["First Name", "Age"]
