"""A profile of a stream, kept up batch by batch.

Each micro-batch is reduced to a few numbers for each column: values, missing
ones, bounds, mean and squared deviations, and a sketch of its distinct values.
They are merged with what earlier batches left, by the formulas that merge the
partial aggregates of one table, and stored under the batch's number. A batch
that Spark repeats after a failure finds the state before it and writes its own
again, so rows count once; a stream goes on from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidyloom.functions.scalar import col, is_numeric

STATE = (
    "column string, n_rows bigint, n_values bigint, min_value string, max_value string, "
    "min double, max double, mean double, square double, sketch binary"
)
#: States kept on disk: the one before the last batch is what a repeated batch needs.
KEPT_STATES = 2


def batch_state(df: DataFrame) -> DataFrame:
    """A row for each column of a batch, from one aggregate."""
    fields = []
    for i, f in enumerate(df.schema):
        c = col(f.name)
        text = c.cast("string")
        x = c.cast("double") if is_numeric(f.dataType) else F.lit(None).cast("double")
        fields.append(F.struct(
            F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count(c).alias("n_values"),
            F.min(text).alias("min_value"), F.max(text).alias("max_value"), F.min(x).alias("min"), F.max(x).alias("max"),
            F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("square"), F.hll_sketch_agg(text).alias("sketch"),
        ).alias(f"s{i}"))
    row = df.agg(*fields)
    return row.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(fields))])).alias("s")).select("s.*")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The state of both sets of rows."""
    n = F.sum("n_values")

    def spread(mean: Column) -> Column:
        return F.sum(F.col("n_values") * mean * mean)

    mean = F.try_divide(F.sum(F.col("n_values") * F.col("mean")), F.sum(F.when(F.col("mean").isNotNull(), F.col("n_values"))))
    both = a.unionByName(b)
    # Deviations from the larger part's mean, so that squares of large means cancel nothing.
    base = both.groupBy("column").agg(F.max_by("mean", "n_values").alias("base"))
    moved = both.join(base, "column").withColumn("off", F.col("mean") - F.col("base"))
    off = F.try_divide(F.sum(F.col("n_values") * F.col("off")), F.sum(F.when(F.col("off").isNotNull(), F.col("n_values"))))
    return moved.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"), n.alias("n_values"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.min("min").alias("min"), F.max("max").alias("max"), mean.alias("mean"),
        (F.sum("square") + spread(F.col("off")) - n * off * off).alias("square"), F.hll_union_agg("sketch").alias("sketch"),
    )


def profile_of(state: DataFrame) -> DataFrame:
    """``column, n_rows, n_missing, missing_share, distinct_estimate, min_value, max_value, min, max, mean, sd``."""
    return state.select(
        "column", "n_rows", (F.col("n_rows") - F.col("n_values")).alias("n_missing"),
        F.coalesce(F.try_divide(F.col("n_rows") - F.col("n_values"), F.col("n_rows")), F.lit(0.0)).alias("missing_share"),
        F.hll_sketch_estimate("sketch").alias("distinct_estimate"), "min_value", "max_value", "min", "max", "mean",
        F.when(
            F.col("square").isNotNull(), F.sqrt(F.try_divide(F.greatest(F.col("square"), F.lit(0.0)), F.col("n_values")))
        ).alias("sd"),
    )


def _path(folder: str, batch: int) -> str:
    return f"{folder}/batch={batch:012d}"


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def stored_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose state is complete, ascending."""
    files, target = _folder(spark, folder)
    if not files.exists(target):
        return []
    found = []
    for status in files.listStatus(target):
        name = status.getPath().getName()
        done = _folder(spark, f"{folder}/{name}/_SUCCESS")
        if name.startswith("batch=") and done[0].exists(done[1]):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def profile_stream(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the profile of all rows seen so far in ``folder``."""
    if not stream.isStreaming:
        raise ValueError("profile_stream expects a streaming DataFrame")

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = [n for n in stored_batches(spark, folder) if n < number]
        state = batch_state(batch)
        if earlier:
            state = merged(spark.read.schema(STATE).parquet(_path(folder, earlier[-1])), state)
        state.write.mode("overwrite").parquet(_path(folder, number))
        for old in earlier[: 1 - KEPT_STATES]:
            files, target = _folder(spark, _path(folder, old))
            files.delete(target, True)

    writer = stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def last_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile after the last complete batch; no rows before the first."""
    found = stored_batches(spark, folder)
    state = spark.read.schema(STATE).parquet(_path(folder, found[-1])) if found else spark.createDataFrame([], STATE)
    return profile_of(state)
