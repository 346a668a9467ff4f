"""Plans: fitting, policy, audit, documents, evaluation, streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyloom.plans import PlanCleaner, fallback_plan, fixed_plan, policy, raw_plan, register_action, run_fixed, run_plan
from tidyloom.operators.sampling import assign_folds
from tidyloom.plans.evaluate import class_codes, cross_validate, fold_predictions
from tidyloom.plans.fold_statistics import fold_scores
from tidyloom.plans import runner
from tidyloom.plans.model import PlanModel
from tidyloom.plans.normalise import plan_actions, plan_notes
from tidyloom.plans.search import search_preparation
from tidyloom.session import ensure_checkpoint_dir
from tidyloom.sources.documents import close_brackets, read_context_files, read_plan_files, recover_json
from tidyloom.sources import cached_table, detect_separator, load_raw, read_csv
from tidyloom.sources.tables import table_digest
from tidyloom.streaming import clean_stream, dedup_stream, last_profile, profile_stream, write_stream

PLAN = {
    "actions": [
        {"action": "fix_column_names"},
        {"action": "add_missing_indicators", "params": {}},
        {"action": "semantic_missing_to_category", "params": {"column_fills": {"KIND": "none"}}},
        {"action": "handle_missing", "params": {"strategy": "impute"}},
        {"action": "group_rare_categories", "params": {}},
        {"action": "transform_numeric_skewed", "params": {"method": "yeo-johnson", "skewness_threshold": 0.5}},
        {"action": "clip_outliers", "params": {"iqr_k": 3.0}},
        {"action": "encode_categorical_per_column", "params": {"column_encodings": {"kind": "ordinal"}}},
        {"action": "scale_features", "params": {"exclude_columns": ["id"]}},
        {"action": "select_features", "params": {}},
        {"action": "not_an_action"},
    ]
}


@pytest.fixture(scope="module")
def raw(spark):
    return spark.range(300).select(
        "id",
        F.when(F.col("id") % 7 != 0, F.exp((F.col("id") % 50) / 12.0)).alias("Amount"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 11).cast("double")).alias("Score"),
        F.when(F.col("id") % 6 != 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("Kind"),
        F.concat(F.lit("c"), F.col("id") % 2).alias("City Name"),
        (F.col("id") % 2).alias("y"),
    )


def test_fit_uses_training_rows_only(spark, raw):
    train, test = raw.where("id < 200"), raw.where("id >= 200")
    carry = ["id", "y"]
    model = PlanCleaner(PLAN, carry=carry).fit(train)
    assert model.skipped == ["not_an_action"]
    out = model.transform(test)
    assert out.columns[:2] == carry and out.count() == 100
    altered = test.withColumn("Amount", F.lit(1e9)).withColumn("Kind", F.lit("new"))
    again = PlanCleaner(PLAN, carry=carry).fit(train)
    assert [s["state"] for s in again.steps if not s["state"].get("frames")] == [
        s["state"] for s in model.steps if not s["state"].get("frames")
    ]
    assert model.transform(altered).columns == out.columns


def test_model_round_trip(spark, raw, tmp_path):
    model = PlanCleaner(PLAN, carry=["id"]).fit(raw)
    model.save(spark, str(tmp_path / "m"))
    back = PlanModel.load(spark, str(tmp_path / "m"))
    assert back.columns == model.columns
    assert model.transform(raw).exceptAll(back.transform(raw)).count() == 0


def test_transform_aligns_to_the_fitted_schema(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "v double, k string")
    model = PlanCleaner({"actions": [{"action": "encode_categorical"}]}).fit(train)
    out = model.transform(spark.createDataFrame([(5.0, 1)], "v double, extra int"))
    assert out.columns == model.columns == ["v", "k__a", "k__b"]


def test_registered_action(spark):
    @register_action("double_it")
    class DoubleIt:
        @staticmethod
        def fit(df, params, columns, target):
            return {"columns": columns}

        @staticmethod
        def apply(df, state):
            return df.withColumns({c: F.col(c) * 2 for c in state["columns"]})

    plan = {"actions": [{"action": "double_it", "target_columns": ["v"]}]}
    df = spark.createDataFrame([(2,)], "v int")
    assert PlanCleaner(plan).fit(df).transform(df).first()["v"] == 4
    assert run_plan(df, plan)[0].first()["v"] == 4


def test_run_plan_logs_failures_and_discards_unknown_columns(spark):
    df = spark.createDataFrame([(" a ", 1), ("b", None)], "`Text Col` string, n int")
    plan = {
        "actions": [
            {"action": "fix_column_names"},
            {"action": "normalize_text", "target_columns": ["text_col", "ghost"]},
            {"action": "remove_outliers", "params": {"columns": ["text_col"]}},
            {"action": "handle_missing", "params": {"strategy": "drop_rows"}},
            {"action": "nonsense"},
        ]
    }
    out, log = run_plan(df, plan, "t")
    assert [s["status"] for s in log.steps] == ["applied", "applied", "failed", "applied", "failed"]
    assert "ghost" in log.steps[1]["warnings"][0]
    assert out.collect() == [("a", 1)]
    frame = log.to_frame(spark)
    assert frame.count() == 5 and len(frame.columns) == 13


def test_presets(spark):
    assert raw_plan()["actions"] == [] and len(fixed_plan()["actions"]) == 4
    tree = fallback_plan({"downstream_model": "GBM", "column_semantics": {"a": "x"}}, per_column=True)
    assert tree["actions"][-1]["params"]["column_encodings"] == {"a": "ordinal"}
    df = spark.createDataFrame([("  x  y", 1.0), ("  x  y", 1.0), (None, None)], "`A B` string, v double")
    out, log = run_fixed(df)
    assert sorted(out.collect()) == [("x y", 1.0)] and len(log.steps) == 4


# ---------------------------------------------------------------- policy
BASE = [
    ("handle_missing", ["num_a"], {"strategy": "impute"}),
    ("encode_categorical_per_column", [], {"default_method": "ordinal"}),
    ("clip_outliers", [], {"method": "iqr", "iqr_k": "1.5"}),
]
MODELS = ["RandomForest", "GradientBoosting", "LogisticRegression", "Ridge", "KNN", "KNN_regression", "NeuralNetwork"]


@pytest.fixture(scope="module")
def enforced(spark):
    def run(extra=(), redundant=()):
        rows = [
            (m, i, a, "", cols, params)
            for m in MODELS
            for i, (a, cols, params) in enumerate([*BASE, *extra], start=1)
        ]
        plans = spark.createDataFrame(
            rows,
            "plan_id string, step int, action string, rationale string, target_columns array<string>, params map<string,string>",
        )
        contexts = spark.createDataFrame(
            [(m, m, list(redundant), []) for m in MODELS],
            "plan_id string, downstream_model string, redundant_features array<string>, leakage_cols array<string>",
        )
        kept = policy.kept_actions(policy.enforce(plans, contexts)).orderBy("plan_id", "step").collect()
        out = {m: [] for m in MODELS}
        for r in kept:
            out[r["plan_id"]].append(r)
        return out

    return run


def _params(rows, action):
    return next(r["params"] for r in rows if r["action"] == action)


def test_policy_per_family(enforced):
    plans = enforced()
    names = {m: [r["action"] for r in rows] for m, rows in plans.items()}
    for m in ("RandomForest", "GradientBoosting"):
        assert "clip_outliers" not in names[m] and "scale_features" not in names[m]
        assert _params(plans[m], "handle_missing")["strategy"] == "median"
    for m in ("LogisticRegression", "Ridge"):
        assert float(_params(plans[m], "clip_outliers")["iqr_k"]) >= 3.0
        assert names[m].count("scale_features") == 1
        assert _params(plans[m], "handle_missing") == {"strategy": "impute", "cat_missing_strategy": "fill_mode"}
    assert _params(plans["KNN"], "handle_missing")["strategy"] == "median"
    assert _params(plans["KNN_regression"], "handle_missing")["strategy"] == "impute"
    for m in ("KNN", "NeuralNetwork"):
        assert "scale_features" not in names[m]
    assert _params(plans["NeuralNetwork"], "handle_missing") == {"strategy": "impute"}


def test_policy_drops_and_scaler(enforced):
    drop = ("drop_column", ["num_b"], {})
    blocked = enforced([drop, ("scale_features", [], {})])
    assert all("drop_column" not in [r["action"] for r in rows] for rows in blocked.values())
    assert [r["action"] for r in blocked["Ridge"]].count("scale_features") == 1
    allowed = enforced([drop], redundant=["num_b"])
    assert all("drop_column" in [r["action"] for r in rows] for rows in allowed.values())


def test_policy_strikes_numeric_encodings(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    encodings = one(
        [("p", 2, "cat_low", "one_hot"), ("p", 2, "num_b", "ordinal")],
        "plan_id string, step int, column string, method string",
    )
    contexts = one(
        [("p", "RandomForest", [], [])],
        "plan_id string, downstream_model string, redundant_features array<string>, leakage_cols array<string>",
    )
    semantics = one([("p", "cat_low", "nominal")], "plan_id string, column string, semantics string")
    profile = one(
        [("p", "cat_low", True, 2), ("p", "num_b", False, None)],
        "plan_id string, column string, is_text boolean, n_unique long",
    )
    steps = one([("p", 2)], "plan_id string, step int")
    out = policy.encoding_rule(encodings, contexts, semantics, profile, steps).collect()
    assert [(r["column"], r["method"], r["changed"]) for r in out] == [("cat_low", "ordinal", True)]


@pytest.fixture(scope="module")
def settled(spark):
    """The fixture plan through every rule, with its column encodings and a feature selection."""
    rows = [
        (m, i, a, "", cols, params)
        for m in MODELS
        for i, (a, cols, params) in enumerate(
            [*BASE, ("select_features", [], {"drop_columns": "num_b,cat_low", "variance_threshold": "0.2"})], start=1
        )
    ]
    plans = spark.createDataFrame(
        rows,
        "plan_id string, step long, action string, rationale string, target_columns array<string>, params map<string,string>",
    )
    contexts = spark.createDataFrame(
        [(m, m, ["num_b"], []) for m in MODELS],
        "plan_id string, downstream_model string, redundant_features array<string>, leakage_cols array<string>",
    )
    columns = [("num_a", False, None, False), ("num_b", False, None, False), ("cat_low", True, 2, False),
               ("wide", True, 150, False), ("wider", True, 180, False), ("target", False, None, True)]
    profile = spark.createDataFrame(
        [(m, c, t, not t, n, y) for m in MODELS for c, t, n, y in columns],
        "plan_id string, column string, is_text boolean, is_numeric boolean, n_unique long, is_target boolean",
    )
    semantics = spark.createDataFrame(
        [(m, c, "nominal") for m in MODELS for c in ("cat_low", "wide", "wider")],
        "plan_id string, column string, semantics string",
    )
    own = spark.createDataFrame(
        [(m, 2, c, "ordinal") for m in MODELS for c in ("cat_low", "num_b")],
        "plan_id string, step long, column string, method string",
    )
    return policy.enforce(plans, contexts, profile, own, semantics)


def test_enforced_encodings_strike_numbers_and_keep_the_budget(settled):
    plans = policy.to_plans(settled, MODELS)
    log = {r["plan_id"]: r["changes"] for r in policy.change_log(settled).collect()}

    def method(m):
        step = next(a for a in plans[m]["actions"] if a["action"] == "encode_categorical_per_column")
        return step["params"]["column_encodings"]

    assert all("num_b" not in method(m) and "encoding:strike num_b" in log[m] for m in MODELS)
    assert method("RandomForest") == {"cat_low": "ordinal", "wide": "ordinal", "wider": "ordinal"}
    # 2 numbers, 2 + 150 + 180 one-hot columns: over 200 until the widest is ordinal.
    assert method("LogisticRegression") == {"cat_low": "one_hot", "wide": "one_hot", "wider": "ordinal"}
    assert "budget:wider->ordinal" in log["LogisticRegression"] and "encoding:cat_low->one_hot" in log["Ridge"]


def test_enforced_plans_run(spark, settled):
    plans = policy.to_plans(settled, MODELS)
    for m in MODELS:
        step = next(a for a in plans[m]["actions"] if a["action"] == "select_features")
        assert step["params"] == {"drop_columns": ["num_b"], "variance_threshold": 0.0, "correlation_threshold": 1.0}
    df = spark.createDataFrame(
        [(1.0, 10, "x", "u"), (2.0, 20, "y", "v"), (None, 30, "x", "w")], "num_a double, num_b long, cat_low string, wide string"
    ).withColumn("wider", F.col("wide"))
    for m in ("Ridge", "RandomForest", "KNN"):
        out = PlanCleaner(plans[m]).fit(df).transform(df)
        assert "num_b" not in out.columns and out.where("num_a is null").count() == 0
        _, log = run_plan(df, plans[m], audit=False)
        assert {r["status"] for r in log.steps} == {"applied"}


def test_typed_params():
    got = policy.typed_params({"iqr_k": "3.0", "n": "5", "flag": "true", "columns": "a,b", "ops": '["strip"]', "m": "one_hot", "x": None})
    assert got == {"iqr_k": 3.0, "n": 5, "flag": True, "columns": ["a", "b"], "ops": ["strip"], "m": "one_hot"}


# ---------------------------------------------------------------- documents
@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": [1, {"b": 2', '{"a": [1, {"b": 2}]}'),
        ('{"a": "cut', '{"a": "cut"}'),
        ('{"a": "br{ace", "b":', '{"a": "br{ace", "b"}'),
        ('{"a": "q\\"x", "b": [1,', '{"a": "q\\"x", "b": [1]}'),
        ('{"a": 1}', '{"a": 1}'),
    ],
)
def test_close_brackets(text, want):
    assert close_brackets(text) == want


def test_recover_json(spark):
    texts = [
        ' {"a": 1} ',
        'so:\n```json\n{"a": 1}\n```\nend',
        '```\n{"a": 1}\n```',
        'x {"a": 1} y',
        '{"a": 1, /* note */ }',
        "{'a': 1}",
        '{"a": 1, "b": [2, {"c": 3',
        "nothing",
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["j"] for r in recover_json(df, "t", "j").orderBy("i").collect()]
    assert [json.loads(x)["a"] if x else None for x in got] == [1] * 7 + [None, None]
    assert json.loads(got[6]) == {"a": 1, "b": [2, {"c": 3}]}


def test_plan_files(spark, tmp_path):
    body = json.dumps({"actions": [{"code": "drop_column", "message": "m", "target_columns": ["a"]}, "x"],
                       "diagnostics": "one note", "prognostics": [{"name": "n"}]})
    (tmp_path / "p1.json").write_bytes(body.encode() + b"\x00\x00")
    (tmp_path / "p2.json").write_text(body + "tail")
    (tmp_path / "p3.json").write_text("{broken")
    plans = read_plan_files(spark, str(tmp_path)).withColumnRenamed("file", "plan_id")
    assert plans.where("plan_json IS NULL").collect()[0]["plan_id"] == "p3.json"
    rows = plan_actions(plans).orderBy("plan_id").collect()
    assert [(r["plan_id"], r["step"], r["action"], r["rationale"]) for r in rows] == [
        ("p1.json", 1, "drop_column", "m"),
        ("p2.json", 1, "drop_column", "m"),
    ]
    assert {r["code"] for r in plan_notes(plans, "prognostics").collect()} == {"n"}
    assert {r["message"] for r in plan_notes(plans).collect()} == {"one note"}


def test_context_files(spark, tmp_path):
    inner = {"downstream_model": "KNN", "redundant_features": ["a"], "column_semantics": {"c": "ordinal"}}
    (tmp_path / "one.json").write_text(json.dumps({"user": inner}))
    (tmp_path / "two.json").write_text(json.dumps(inner))
    rows = read_context_files(spark, str(tmp_path)).collect()
    assert [r["downstream_model"] for r in rows] == ["KNN", "KNN"]
    assert rows[0]["column_semantics"] == {"c": "ordinal"}


# ---------------------------------------------------------------- tables
def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id;name;score;ok\n1;ana;1.5;true\n2;N/A;;false\n3;null;NA;true\n")
    assert detect_separator(spark, str(path)) == ";"
    df = read_csv(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "double", "boolean"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, "ana", 1.5, True),
        (2, None, None, False),
        (3, None, None, True),
    ]
    assert read_csv(spark, str(path), na_values=["ana"]).where("name = 'N/A'").count() == 1


def test_load_raw(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("y"), F.lit(1).alias("leak"))
    out = load_raw(df, "y", "classification", "id", ["leak", "none"], 10, {"1": "yes"})
    assert out.columns == ["id", "y"]
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {"yes": 5, "0": 5}
    with pytest.raises(ValueError):
        load_raw(df, "absent", "regression", "id")


SIX = {
    "actions": [
        {"action": "fix_column_names"},
        {"action": "normalize_text", "params": {"columns": ["kind"], "ops": ["strip", "lower"]}},
        {"action": "cast_type", "params": {"columns": ["n"], "dtype": "int", "errors": "coerce"}},
        {"action": "handle_missing", "params": {"columns": ["n"], "strategy": "drop_rows"}},
        {"action": "deduplicate"},
        {"action": "drop_column", "params": {"columns": ["spare"]}},
    ]
}


def test_audit_reads_the_source_once(spark):
    """Six steps with counts: one pass over the rows, and the same records as step by step."""
    rows = [(i % 40, f" Kind{i % 3} " if i % 2 else "kind", str(i % 40) if i % 4 else "no", 1) for i in range(200)]
    df = spark.createDataFrame(rows, "ID long, Kind string, N string, Spare int").repartition(5)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    out, log = run_plan(df.mapInArrow(count, df.schema), SIX)
    assert read.value == 200
    assert out.count() == 70 and read.value == 200  # the table is stored
    found = {s["action_name"]: s for s in log.steps}
    assert all(s["status"] == "applied" for s in log.steps)
    assert found["normalize_text"]["diff_summary"]["values_changed_count"] == {"kind": 100}
    assert found["cast_type"]["diff_summary"]["invalid_values_coerced"] == {"n": 50}
    assert len(found["cast_type"]["warnings"]) == 1 and found["drop_column"]["warnings"] == []
    assert found["handle_missing"]["diff_summary"]["dropped_rows"] == 50
    counts = [found["deduplicate"]["diff_summary"][f"rows_{k}"] for k in ("before", "after", "removed")]
    assert counts == [150, out.count(), 150 - out.count()]
    _, slow = runner._run(df, SIX, "", None, False, True)
    for a, b in zip(log.steps, slow.steps):
        assert {k: v for k, v in a.items() if k != "timestamp"} == {k: v for k, v in b.items() if k != "timestamp"}


def test_audit_of_failing_steps(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "n long, s string")
    steps = [
        {"action": "cast_type", "params": {"columns": ["s"], "dtype": "when"}},
        {"action": "deduplicate", "params": {"subset": ["n"]}},
        {"action": "deduplicate", "params": {"subset": ["n"], "keep": "none"}},
    ]
    out, log = run_plan(df, {"actions": steps})
    assert [s["status"] for s in log.steps] == ["failed", "failed", "applied"]
    assert log.steps[2]["diff_summary"]["duplicate_key_examples"] == [{"n": 2, "n_rows": 2}]
    assert [r["n"] for r in out.collect()] == [1]


def test_audit_of_tables_that_get_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "y")], "id long, n long, s string")
    steps = [
        {"action": "handle_missing", "params": {"columns": ["n"], "strategy": "drop_rows"}},
        {"action": "deduplicate"},
        {"action": "normalize_text", "params": {"columns": ["s"], "ops": ["strip"]}},
    ]
    for rows, dropped in ((df, 2), (df.limit(0), 0), (df.where("id < 0").repartition(3), 0)):
        out, log = run_plan(rows, {"actions": steps})
        assert out.count() == 0 and [s["status"] for s in log.steps] == ["applied"] * 3
        assert log.steps[0]["diff_summary"]["dropped_rows"] == dropped
        assert log.steps[1]["diff_summary"]["rows_removed"] == 0
        assert log.steps[2]["diff_summary"]["values_changed_count"] == {"s": 0}


def test_cache_knows_its_input(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []
    one = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")

    def get(df, refresh=False):
        def compute():
            calls.append(1)
            return df.groupBy().count()

        return cached_table(spark, path, compute, refresh, df).first()[0]

    assert get(one) == get(one.repartition(3)) == 2 and len(calls) == 1
    more = one.union(one.limit(1))
    assert get(more) == 3 and get(one) == 2 and len(calls) == 2
    assert get(one, refresh=True) == 2 and len(calls) == 3
    swapped = spark.createDataFrame([(1, None), (2, "a")], "k long, v string")
    assert len({table_digest(x) for x in (one, more, swapped, one.withColumnRenamed("v", "w"), one.limit(0))}) == 5


# ---------------------------------------------------------------- models
@pytest.mark.parametrize("model", ["logreg", "rf", "gbm", "knn"])
def test_cross_validation_learns(spark, model):
    df = spark.range(120).select(
        "id",
        F.when(F.col("id") % 9 != 0, (F.col("id") % 10).cast("double")).alias("v"),
        F.concat(F.lit("k"), F.col("id") % 3).alias("k"),
        F.when(F.col("id") % 10 > 4, "hi").otherwise("lo").alias("y"),
    )
    row = cross_validate(df, "id", "y", "classification", fixed_plan(), model, folds=2,
                         options={"trees": 5, "depth": 3, "rounds": 3}).first()
    assert row["f1_macro"] > 0.7 and 0 <= row["f1_macro_std"] < 0.3
    if "roc_auc" in row:
        assert row["roc_auc"] > 0.7


def test_boosting_over_three_classes(spark):
    """Probabilities of every class, and the ROC AUC by counting pairs."""
    rng = np.random.default_rng(2)
    v = rng.random(150)
    kind = np.where(v + rng.normal(0, 0.15, 150) < 0.3, "a", np.where(v + rng.normal(0, 0.15, 150) < 0.6, "b", "c"))
    df = spark.createDataFrame([(i, float(x), float(rng.random()), str(k)) for i, (x, k) in enumerate(zip(v, kind))], "id long, v double, w double, y string")
    options = {"rounds": 3}
    placed = assign_folds(df, "id", "y", 2).persist()
    classes = class_codes(placed, "y")
    scores = []
    for fold in (0, 1):
        rows = fold_predictions(placed, fold, "id", "y", "classification", None, "gbm", None, options, classes).collect()
        for r in rows:
            assert sorted(r["share"]) == [0, 1, 2] and sum(r["share"].values()) == pytest.approx(1)
            assert r["share"][int(r["prediction"])] == max(r["share"].values())
        total = 0.0
        for c in range(3):
            good, bad = ([r["share"][c] for r in rows if (r["label"] == c) == own] for own in (True, False))
            total += len(good) / len(rows) * np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
        scores.append(total)
    row = cross_validate(df, "id", "y", "classification", None, "gbm", None, options, folds=2).first()
    assert row["roc_auc"] == pytest.approx(np.mean(scores), abs=1e-9) and row["roc_auc"] > 0.75
    placed.unpersist()


@pytest.mark.parametrize("model", ["gbm", "rf"])
def test_trees_get_their_rows_in_few_pieces(spark, monkeypatch, model):
    """A table in many partitions is not fitted in as many tasks, and its rows are all there."""
    from tidyloom.plans import evaluate

    met, build = [], evaluate.build_estimator

    class Counted:
        def __init__(self, *args):
            self.real = build(*args)

        def fit(self, train):
            met.append((train.rdd.getNumPartitions(), train.count()))
            return self.real.fit(train)

    monkeypatch.setattr(evaluate, "build_estimator", Counted)
    df = spark.range(90).select("id", (F.col("id") % 7).alias("v"), (F.col("id") % 7 * 2.0).alias("y"))
    placed = assign_folds(df, "id", None, 2).repartition(40).persist()
    options = {"rounds": 2, "trees": 2, "depth": 2}
    out = fold_predictions(placed, 0, "id", "y", "regression", None, model, None, options)
    assert out.count() == 45 and met == [(40, 45)]  # few rows stay as they are
    monkeypatch.setattr(evaluate, "TREE_ROWS", 10)
    fold_predictions(placed, 0, "id", "y", "regression", None, model, None, options)
    assert met[1] == (5, 45)
    placed.unpersist()


def test_preparation_search(spark):
    df = spark.range(80).select("id", (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 7 * 2.0).alias("y"))
    space = {"missing_num": ["median"], "scaling": ["none", "minmax"], "feat_sel": ["none", "variance"]}
    out = search_preparation(df, "id", "y", "regression", "ridge", space=space, folds=2)
    assert out.count() == 4 and out.agg(F.min("value")).first()[0] > 0.9


def _mixed_table(spark, n=160):
    """Numbers with gaps and outliers, categories with gaps and rare values, a target with gaps."""
    rng = np.random.default_rng(11)
    a, b = rng.normal(50, 10, n), rng.exponential(3.0, n)
    b[::17] *= 40
    kind = rng.choice(["x", "y", "zz", "Ä"], n, p=[0.5, 0.3, 0.15, 0.05])
    y = 1e4 + 3 * a - 2 * np.minimum(b, 9) + np.where(kind == "x", 25, 0) + rng.normal(0, 4, n)
    gap = rng.random((n, 4)) < [0.15, 0.1, 0.2, 0.03]
    flat = np.where(np.arange(n) % 40, 1.0, 1.001)
    rows = [
        (i, None if gap[i, 0] else float(a[i]), None if gap[i, 1] else float(b[i]), float(flat[i]), 7.5,
         None if gap[i, 2] else str(kind[i]), "one" if i == 3 else "all", None if gap[i, 3] else float(y[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, a double, `b.c` double, flat double, same double, kind string, rare string, y double")


def test_fold_statistics_equal_fits_for_each_fold(spark):
    """Scores from matrices against cleaning, fitting and predicting the rows of every fold."""
    df = _mixed_table(spark)
    configs = [
        {"missing_num": m, "missing_cat": c, "outlier": o, "scaling": s, "feat_sel": f}
        for m, c, o, s, f in [
            ("median", "most_frequent", "none", "none", "none"), ("mean", "constant", "iqr_1.5", "standard", "variance"),
            ("knn", "most_frequent", "iqr_3.0", "minmax", "variance"), ("knn", "constant", "none", "standard", "none"),
            ("median", "constant", "iqr_1.5", "none", "variance"),
        ]
    ]
    got = fold_scores(df, "id", "y", configs, folds=3)
    for config, (value, sd) in zip(configs, got):
        row = cross_validate(df, "id", "y", "regression", None, "ridge", config, folds=3).first()
        assert value == pytest.approx(row["r2"], abs=1e-8), config
        assert sd == pytest.approx(row["r2_std"], abs=1e-8), config


def test_plans_share_folds_and_ridge_takes_one_pass(spark, monkeypatch):
    """Neither the folds nor Spark ML's passes are repeated for every plan."""
    from tidyloom.plans import evaluate
    from tidyloom.plans.search import search_plans

    dealt, df = [], _mixed_table(spark)
    plain = {r["name"]: r for r in search_plans(df, {"fixed": fixed_plan(), "raw": raw_plan()}, "id", "y", "regression", "ridge", folds=2).collect()}
    assert plain["raw"]["delta"] == pytest.approx(0.0, abs=1e-12) and plain["fixed"]["value"] > 0.5

    def counted(*args, **kwargs):
        dealt.append(args)
        return assign_folds(*args, **kwargs)

    def unwanted(*args, **kwargs):
        raise AssertionError("ridge regression was fitted by several passes")

    monkeypatch.setattr(evaluate, "assign_folds", counted)
    monkeypatch.setattr(evaluate, "build_estimator", unwanted)
    again = search_plans(df, {"fixed": fixed_plan(), "raw": raw_plan()}, "id", "y", "regression", "ridge", folds=2).collect()
    assert len(dealt) == 1
    for r in again:
        assert r["value"] == pytest.approx(plain[r["name"]]["value"], abs=1e-12)


def test_one_pass_ridge_equals_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler

    from tidyloom.plans.evaluate import build_estimator
    from tidyloom.plans.ridge import fit_ridge, predict_ridge

    rng = np.random.default_rng(5)
    names = ["f0", "f1", "f2", "f3"]
    schema = "id long, f0 double, f1 double, f2 double, f3 double, label double"
    noise = rng.normal(size=(300, 3))
    for offset in (5.0, 1e6):
        # A constant, and a copy that only the penalty tells apart.
        rows = [(i, float(offset + a), float(b), float(b), 3.25, float(10 * offset + 2 * a - 3 * b + e)) for i, (a, b, e) in enumerate(noise)]
        df = spark.createDataFrame(rows, schema).repartition(7)
        fitted = fit_ridge(df, names, "label")
        assert fitted[0][3] == 0.0 and fitted[0][1] == pytest.approx(fitted[0][2])
        got = {r["id"]: r["prediction"] for r in predict_ridge(df, fitted, names, ["id", "label"]).collect()}
        assert len(got) == 300
        x, y = np.array([r[1:4] for r in rows]), np.array([r[5] for r in rows])
        z = x - x.mean(0)
        guess = y.mean() + z @ np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
        assert np.allclose([got[i] for i in range(300)], guess, rtol=0, atol=1e-7)
        if offset == 5.0:
            wide = VectorAssembler(inputCols=names, outputCol="features").transform(df)
            n, spread = df.agg(F.count("*"), F.stddev_pop("label")).first()
            model = build_estimator("ridge", "regression", n, 0, None, spread).fit(wide)
            assert all(got[r["id"]] == pytest.approx(r["prediction"], abs=1e-7) for r in model.transform(wide).collect())
    with pytest.raises(ValueError):
        fit_ridge(df.limit(0), names, "label")
    bad = df.withColumn("f1", F.when(F.col("id") == 7, F.lit(float("nan"))).otherwise(F.col("f1")))
    with pytest.raises(Exception, match="not finite"):
        fit_ridge(bad, names, "label")


def test_whole_grid(spark):
    df = _mixed_table(spark)
    out = {r["name"]: r for r in search_preparation(df, "id", "y", "regression", "ridge", (0.5, 0.01), folds=4).collect()}
    assert len(out) == 108 and all(r["value"] > 0.5 and r["verdict"] == "WIN" for r in out.values())
    assert len({round(r["value"], 9) for r in out.values()}) > 30


def test_wide_categories_are_fitted_one_by_one(spark):
    df = spark.range(1200).select("id", F.col("id").cast("string").alias("k"), (F.col("id") % 5 * 1.0).alias("y"))
    assert fold_scores(df, "id", "y", [{}]) is None
    assert fold_scores(df.limit(0), "id", "y", [{}]) is None


def test_ridge_has_a_unit_penalty(spark):
    df = _mixed_table(spark).select("id", F.coalesce("a", F.lit(0.0)).alias("a"), "y").where("y IS NOT NULL")
    rows = assign_folds(df, "id", None, 2).toPandas()
    want = []
    for fold in (0, 1):
        train, test = rows[rows.fold != fold], rows[rows.fold == fold]
        x, y = train.a - train.a.mean(), train.y - train.y.mean()
        w = (x @ y) / (x @ x + 1.0)
        guess = train.y.mean() + w * (test.a - train.a.mean())
        want.append(1 - ((test.y - guess) ** 2).sum() / ((test.y - test.y.mean()) ** 2).sum())
    row = cross_validate(df, "id", "y", "regression", None, "ridge", {"scaling": "none"}, folds=2).first()
    assert row["r2"] == pytest.approx(np.mean(want), abs=1e-9)


# ---------------------------------------------------------------- streams
def test_stream(spark, raw, tmp_path):
    plan = {"actions": [a for a in PLAN["actions"] if a["action"] != "select_features"]}
    model = PlanCleaner(plan, carry=["id"]).fit(raw)
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    write_stream(clean_stream(stream, model), out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(out).exceptAll(model.transform(raw)).count() == 0
    with pytest.raises(ValueError):
        clean_stream(raw, model)


def test_stream_profile_equals_the_table(spark, tmp_path):
    """Many batches, a restart from the checkpoint, and a repeated batch: each row counts once."""
    from tidyloom.streaming import profile as sp

    rng = np.random.default_rng(6)
    rows = [(int(i), None if i % 7 == 0 else float(rng.normal(1e6, 2.0)), None if i % 5 else f"t{i % 13}", None) for i in range(900)]
    schema = "id long, `v.x` double, t string, void int"
    parts = [rows[:10], rows[10:400], [], rows[400:], [(1, None, None, None)] * 3]
    source, state, check = (str(tmp_path / n) for n in ("in", "state", "check"))

    def add(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        profile_stream(stream, state, check).awaitTermination()

    for part in parts[:2]:
        add(part)
    go()
    for part in parts[2:]:
        add(part)
    go()
    batches = sp.stored_batches(spark, state)
    assert len(batches) == sp.KEPT_STATES and batches[-1] >= 3
    want = spark.createDataFrame([r for p in parts for r in p], schema)
    whole = {r["column"]: r for r in sp.profile_of(sp.batch_state(want)).collect()}
    got = {r["column"]: r for r in last_profile(spark, state).collect()}
    assert set(got) == set(want.columns)
    for c, r in got.items():
        for name in ("n_rows", "n_missing", "missing_share", "min_value", "max_value", "min", "max"):
            assert r[name] == whole[c][name], (c, name)
        assert r["distinct_estimate"] == pytest.approx(whole[c]["distinct_estimate"], rel=0.03)
        for name in ("mean", "sd"):
            assert r[name] == (whole[c][name] if whole[c][name] is None else pytest.approx(whole[c][name], rel=1e-9))
    assert got["v.x"]["sd"] == pytest.approx(2.0, rel=0.1) and got["void"]["n_missing"] == 903
    # A batch that is repeated starts from the state before it and gives the same again.
    before = spark.read.schema(sp.STATE).parquet(sp._path(state, batches[-2]))
    assert before.agg(F.max("n_rows")).first()[0] < 903
    with pytest.raises(ValueError):
        profile_stream(want, state, check)
    assert last_profile(spark, str(tmp_path / "none")).collect() == []


def test_stream_duplicates(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 5).alias("k"), F.timestamp_seconds("id").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    write_stream(dedup_stream(stream, "ts", "1 hour", ["k"]), out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_checkpoint_dir_is_kept(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
