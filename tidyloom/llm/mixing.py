"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources get target token counts by their weights; a target stops at
``max_repeats`` times what the source holds and the excess is shared again. The
mix is allotted in blocks of equal token count: first to sources, then inside a
source to its shards, each time by the highest quotients votes/(2k + 1). Inside
a shard the documents stand in a seeded order on a line that is gone round at
most ``max_repeats`` times; the quota takes the first blocks of that line, so a
document's share follows from its offset and no block row is ever made.

Everything is DataFrame functions. Documents are spread over seeded buckets of
bounded size, so a source with a third of all rows is split like any other; only
one row per (source, bucket) and one row per source meet in windows.

NULL text counts as empty, a NULL source is a source of its own and comes last,
rows with equal keys are separate documents, an empty table gives no rows.
Columns of the input pass through; those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.llm.common import col, seeded, seeded_sql
from tidyloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_TOKENS = 32
SHARD_TOKENS = 4_000_000
BUCKET_TOKENS = 500_000
MAX_REPEATS = 3
MADE = ["size", "source_size", "target", "taken", "takes"]


def word_count(text: Column) -> Column:
    """Number of maximal runs of other than ASCII blanks, tabs and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def apportion(df: DataFrame, group: list[str], party: list[str], votes: str, seats: str, out: str):
    """Seats per party by the highest quotients votes/(2k + 1), ties by ``party``.

    ``df`` has a row per (group, party); ``seats`` is the group's total, a column
    with one value per group. All but the last few seats follow from a divisor
    that is surely too large; only about four quotients per party are ranked.
    """
    whole = Window.partitionBy(*group)
    v, k = col(votes).cast("double"), col(seats)
    based = df.withColumns({
        "__v": F.sum(v).over(whole), "__c": F.count("*").over(whole)
    }).withColumn(
        "__base",
        F.when(
            (F.col("__v") > 0) & (k * 2 > F.col("__c")),
            F.greatest(F.lit(0), F.floor(v * (k - F.col("__c") / 2) / F.col("__v") + 0.5) - 1),
        ).otherwise(F.lit(0)).cast("bigint"),
    )
    based = based.withColumn("__left", k - F.sum("__base").over(whole))
    extra = F.floor(v * F.col("__c") / F.col("__v")) + 3
    steps = F.when(v > 0, F.sequence(F.lit(0).cast("bigint"), extra.cast("bigint")))
    tried = based.where((v > 0) & (F.col("__left") > 0)).select("*", F.explode(steps).alias("__k"))
    quotients = tried.select(
        *group, *party, "__left", (v / (2 * (F.col("__base") + F.col("__k")) + 1)).alias("__q")
    )
    best = Window.partitionBy(*group).orderBy(F.desc("__q"), *party)
    won = (
        quotients.withColumn("__rank", F.row_number().over(best))
        .where(F.col("__rank") <= F.col("__left"))
        .groupBy(*group, *party)
        .agg(F.count("*").alias("__won"))
    )
    kept = [*df.columns, "__base"]
    return based.select(*kept).join(won, [*group, *party], "left").select(
        *df.columns, (F.col("__base") + F.coalesce("__won", F.lit(0))).alias(out)
    )


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``weight`` and ``target`` to one row per source (``source``, ``source_size``).

    Sources by code point, NULL last, weigh 1, 2, 3, 1, ... and share the sum of
    all sizes. The level at which the rest is shared is found among the sources
    ordered by how soon they are full.
    """
    everyone = Window.partitionBy()
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("__ratio", "__key")
    named = sizes.withColumn("__n", F.row_number().over(in_order)).select(
        *sizes.columns,
        ((F.col("__n") - 1) % 3 + 1).cast("bigint").alias("weight"),
        F.col("__n").alias("__key"),
        (F.col("source_size") * max_repeats).alias("__cap"),
        F.sum("source_size").over(everyone).alias("__all"),
    )
    rated = named.withColumn("__ratio", F.col("__cap") / F.col("weight"))
    before = F.coalesce(F.sum("__cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("__all") - before) / after
    found = rated.withColumns({"__level": level, "__at": F.row_number().over(full)})
    fits = F.when(F.col("__level") <= F.col("__ratio"), F.struct("__at", "__level"))
    return found.withColumn("__level", F.min(fits).over(everyone)["__level"]).select(
        *sizes.columns,
        "weight",
        F.least(F.col("__cap").cast("double"), F.col("weight") * F.col("__level")).alias("target"),
    )


def shard_quotas(
    sized: DataFrame, block: int, shard: int, bucket_tokens: int, max_repeats: int
) -> tuple[DataFrame, int]:
    """Per (source, bucket): the shard's quota and where the bucket begins in it.

    ``sized`` has ``source``, ``size`` and ``__h`` (seeded order). Also returns the
    number of buckets.
    """
    total = sized.agg(F.sum("size")).first()[0] or 0
    buckets = max(64, -(-total // bucket_tokens))
    cells = (
        sized.withColumn("__bucket", bucket_of(buckets))
        .groupBy("source", "__bucket")
        .agg(F.sum("size").alias("__words"))
        .withColumn("__source", source_key())
    )
    sizes = cells.groupBy("source", "__source").agg(F.sum("__words").alias("source_size"))
    targets = source_targets(sizes, max_repeats).withColumns({
        "__all": F.lit(""), "__blocks": F.lit(total // block).cast("bigint")
    })
    sources = apportion(targets, ["__all"], ["__source"], "target", "__blocks", "__quota")
    # Neighbouring buckets form a shard; a small source is one shard.
    placed = cells.select("__source", "__bucket", "__words").join(
        sources.select("__source", "source_size", "target", "__quota"), "__source"
    )
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("bigint")
    placed = placed.withColumn("__shard", F.floor(F.col("__bucket") * shards / F.lit(buckets)))
    whole = Window.partitionBy("__source", "__shard")
    earlier = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({
        "__line": F.sum("__words").over(whole),
        "__from": F.coalesce(F.sum("__words").over(earlier), F.lit(0)),
    })
    by_shard = placed.groupBy("__source", "__shard", "__quota", "__line").agg(F.lit(0).alias("__u"))
    won = apportion(by_shard, ["__source"], ["__shard"], "__line", "__quota", "__seats")
    won = won.select("__source", "__shard", "__seats")
    return placed.join(won, ["__source", "__shard"]).select(
        "__source", "__bucket", "source_size", "target", "__line", "__from", "__seats"
    ), buckets


def bucket_of(buckets: int) -> Column:
    return F.floor(F.col("__h") * F.lit(buckets) / F.lit(2147483647)).cast("bigint")


def source_key() -> Column:
    """A text that is never NULL and differs for NULL and empty sources."""
    return F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))


def mix_sources(
    df: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    bucket_tokens: int = BUCKET_TOKENS,
    max_repeats: int = MAX_REPEATS,
    seed: int = 7,
    narrow: bool = False,
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``taken`` and ``takes``.

    ``takes`` lists the tokens taken in each round (``max_repeats`` of them) and
    ``taken`` is their sum. With ``narrow`` only the key and these columns are
    returned, and sizes are measured once and checkpointed.
    """
    rest = [c for c in df.columns if c not in MADE]
    sized = df.select(
        *([col(id_col)] if narrow else [col(c) for c in rest]),
        col(source_col).alias("__src"),
        size.cast("bigint").alias("size"),
        seeded(col(id_col), seed).alias("__h"),
    )
    if narrow:
        sized = cut_lineage(sized)
        rest = [id_col]
    key = sized.select(F.col("__src").alias("source"), "size", "__h")
    quotas, buckets = shard_quotas(key, block_tokens, shard_tokens, bucket_tokens, max_repeats)
    src = F.when(F.col("__src").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "__src"))
    local = Window.partitionBy("__source", "__bucket").orderBy("__h", col(id_col), "size")
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    lined = sized.withColumns({"__source": src, "__bucket": bucket_of(buckets)}).withColumn(
        "__at", F.coalesce(F.sum("size").over(earlier), F.lit(0))
    )
    start = F.col("__from") + F.col("__at")
    reach = F.col("__seats") * F.lit(block_tokens)
    takes = [
        F.greatest(F.lit(0), F.least(F.col("size"), reach - F.col("__line") * e - start))
        for e in range(max_repeats)
    ]
    return (
        lined.join(quotas, ["__source", "__bucket"])
        .withColumn("takes", F.array(*takes))
        .select(
            *[col(c) for c in rest],
            "size",
            "source_size",
            "target",
            F.aggregate("takes", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("taken"),
            "takes",
        )
    )


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: a row per round in which a document is taken.

    The document at which a shard's quota ends is cut after its last taken word.
    """
    text = F.coalesce("text", F.lit(""))
    held = {c: f"__own_{c}" for c in docs.columns if c in MADE}
    mixed = mix_sources(docs.withColumnsRenamed(held), word_count(F.col("text")), seed=seed)
    each = mixed.select("*", F.explode("takes").alias("__take")).where(F.col("__take") > 0)
    words = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    cut = F.array_join(F.slice(words, F.lit(1), F.col("__take").cast("int")), " ")
    part = F.col("__take") < F.col("size")
    return each.withColumn("text", F.when(part, cut).otherwise(F.col("text"))).select(
        *[
            F.when(part, F.length("text")).otherwise(F.col("n_chars")).cast(kind).alias("n_chars")
            if c == "n_chars"
            else col(held.get(c, c)).alias(c)
            for c, kind in docs.dtypes
        ]
    )


def oracle(block: int = BLOCK_TOKENS, shard: int = SHARD_TOKENS, bucket: int = BUCKET_TOKENS, seed: int = 7):
    """The query over ``documents`` as DuckDB SQL."""
    h = seeded_sql("doc_id", seed)

    def seats(parties: str, group: str, party: str, votes: str, name: str) -> str:
        return f"""
  {name}_a AS (SELECT *, sum(CAST({votes} AS DOUBLE)) OVER w AS v_all, count(*) OVER w AS n_all
    FROM {parties} WINDOW w AS (PARTITION BY {group})),
  {name}_b AS (SELECT *, CAST(CASE WHEN v_all > 0 AND quota * 2 > n_all THEN greatest(0,
      floor({votes} * (quota - n_all / 2) / v_all + 0.5) - 1) ELSE 0 END AS BIGINT) AS base
    FROM {name}_a),
  {name}_c AS (SELECT *, quota - sum(base) OVER (PARTITION BY {group}) AS todo FROM {name}_b),
  {name}_q AS (SELECT {group}, {party}, todo, {votes} / (2 * (base + k) + 1) AS q
    FROM (SELECT *, unnest(range(0, CAST(floor({votes} * n_all / v_all) + 4 AS BIGINT))) AS k
      FROM {name}_c WHERE {votes} > 0 AND todo > 0)),
  {name}_w AS (SELECT {group}, {party}, count(*) AS won FROM (SELECT *, row_number() OVER (
      PARTITION BY {group} ORDER BY q DESC, {party}) AS r FROM {name}_q) WHERE r <= todo
    GROUP BY ALL),
  {name} AS (SELECT c.*, base + coalesce(won, 0) AS seats FROM {name}_c c
    LEFT JOIN {name}_w w ON c.{group} = w.{group} AND c.{party} = w.{party})"""

    return f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text,
    '[^\\x20\\x09-\\x0D]+')), 0) AS size, {h} AS h FROM documents),
  t AS (SELECT CAST(sum(size) AS BIGINT) AS total,
    greatest(64, CAST(ceil(sum(size) / {bucket}) AS BIGINT)) AS buckets FROM sized),
  placed AS (SELECT s.*, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS skey,
    CAST(floor(h * buckets / 2147483647) AS BIGINT) AS bucket, total, buckets FROM sized s, t),
  cells AS (SELECT skey, bucket, buckets, CAST(sum(size) AS BIGINT) AS words FROM placed
    GROUP BY ALL),
  sizes AS (SELECT skey, any_value(total) AS total, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY (skey = ''), skey) - 1) % 3 + 1 AS weight FROM placed GROUP BY skey),
  rated AS (SELECT *, source_size * 3 AS cap, source_size * 3 / weight AS ratio FROM sizes),
  levels AS (SELECT *, (total - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND
      1 PRECEDING), 0)) / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      AS lv, row_number() OVER f AS nth FROM rated
    WINDOW f AS (ORDER BY ratio, (skey = ''), skey)),
  one AS (SELECT arg_min(lv, nth) AS lv FROM levels WHERE lv <= ratio),
  targets AS (SELECT skey, '' AS everyone, source_size, total // {block} AS quota,
    least(CAST(cap AS DOUBLE), weight * one.lv) AS target FROM rated, one),
  {seats("targets", "everyone", "skey", "target", "src")},
  marked AS (SELECT c.*, s.source_size, s.target, s.seats AS quota, CAST(floor(bucket *
      greatest(1, ceil(s.source_size / {shard})) / buckets) AS BIGINT) AS shard
    FROM cells c JOIN src s USING (skey)),
  lines AS (SELECT *, sum(words) OVER (PARTITION BY skey, shard) AS line, coalesce(sum(words) OVER (
      PARTITION BY skey, shard ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS start FROM marked),
  shards AS (SELECT DISTINCT skey, shard, quota, line FROM lines),
  {seats("shards", "skey", "shard", "line", "sh")},
  docs AS (SELECT p.doc_id, p.size, l.source_size, l.target, l.line, sh.seats, l.start + coalesce(sum(p.size)
      OVER (PARTITION BY p.skey, p.bucket ORDER BY h, p.doc_id, p.size ROWS BETWEEN
      UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
    FROM placed p JOIN lines l ON p.skey = l.skey AND p.bucket = l.bucket
    JOIN sh ON sh.skey = l.skey AND sh.shard = l.shard)
SELECT doc_id, size, source_size, target, CAST(
  greatest(0, least(size, seats * {block} - pos)) + greatest(0, least(size, seats * {block} - line - pos))
  + greatest(0, least(size, seats * {block} - 2 * line - pos)) AS BIGINT) AS taken FROM docs"""
