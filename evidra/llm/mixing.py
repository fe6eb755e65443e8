"""Mixing sources to target weights, native.

Every source gets a share of all words by its weight, at most ``max_epochs`` times its own words; what is left over
is shared by weight among the rest until no source is above. Documents get hash-random keys. Inside a source the key
range is cut into as many equal ranges as the square root of its rows, so that a range holds about as many documents
as a source has ranges and a source with a third of all rows is spread over many tasks. Documents are sorted inside
their range, running sums are taken there, and the ranges' own sums are accumulated into offsets: a distributed
prefix sum. A source is cut where its prefix sum reaches the target; a target above the source's size repeats whole
epochs first.

Defined cases: a null text has no words and is taken 0 times; a null source is a source of its own, ordered last;
repeated rows are documents of their own; a document without words takes 0; extra columns pass through
``mix_documents``; an empty table gives an empty table. Reruns agree: keys depend on doc_id and the seed only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.llm.common import WORD_RE, table, written

WEIGHTS, MAX_EPOCHS, SEED = (1, 2, 3), 3, "mix"
_HEX15 = float(16**15)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: size, rows, ranges and target words.

    Capped sources are those with the smallest ratio of cap to weight, so the level at which the water settles comes
    from running sums over the sources in that order; sums stay whole numbers until one division."""
    by_name = Window.orderBy(F.col("_ev_source").isNull(), "_ev_source")
    totals = (
        sized.groupBy("_ev_source")
        .agg(F.sum("_ev_size").alias("_ev_source_size"), F.count(F.lit(1)).alias("_ev_rows"))
        .withColumn("nth", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights)).cast("int") + 1).cast("long"))
        .withColumn("cap", max_epochs * F.col("_ev_source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    every = Window.partitionBy(F.lit(0))
    below = every.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        totals.withColumn("all_size", F.sum("_ev_source_size").over(every))
        .withColumn("spent", F.coalesce(F.sum("cap").over(below), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0)))
        .withColumn("open", F.col("weight") * (F.col("all_size") - F.col("spent")) <= F.col("cap") * F.col("left_weight"))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct("ratio", "nth", "spent", "left_weight"))).over(every))
    )
    capped = F.col("level").isNull() | (F.struct("ratio", "nth") < F.struct("level.ratio", "level.nth"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(
        (F.col("weight") * (F.col("all_size") - F.col("level.spent"))) / F.col("level.left_weight")
    )
    return levels.select(
        F.col("_ev_source").alias("_ev_name"), "_ev_source_size", target.alias("_ev_target"), F.ceil(F.sqrt("_ev_rows")).cast("long").alias("_ev_ranges")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Per document row: its id and print, size, its source's size and target, and the words the mix takes."""
    sized = written(
        docs.select(
            F.col("doc_id").alias("_ev_doc"),
            F.col("source").alias("_ev_source"),
            word_count(F.col("text")).alias("_ev_size"),
            F.xxhash64("text").alias("_ev_row"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("_ev_key"),
        ),
        "mix-sizes",
    )
    targets = written(source_targets(sized, weights, max_epochs), "mix-targets")
    place = F.conv(F.substring("_ev_key", 1, 15), 16, 10).cast("long")
    ranged = (
        sized.join(targets, F.col("_ev_source").eqNullSafe(F.col("_ev_name")))
        .withColumn("_ev_range", F.floor(place / F.lit(_HEX15) * F.col("_ev_ranges")))
        .repartition("_ev_name", "_ev_range")
    )
    inside = Window.partitionBy("_ev_name", "_ev_range")
    sums = ranged.groupBy("_ev_name", "_ev_range").agg(F.sum("_ev_size").alias("range_size"))
    before = Window.partitionBy("_ev_name").orderBy("_ev_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("_ev_name").alias("o_name"), F.col("_ev_range").alias("o_range"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("_ev_offset")
    )
    ordered = inside.orderBy("_ev_key", "_ev_doc", "_ev_size", "_ev_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_ev_before", F.coalesce(F.sum("_ev_size").over(ordered), F.lit(0))).join(
        offsets, F.col("_ev_name").eqNullSafe(F.col("o_name")) & (F.col("_ev_range") == F.col("o_range"))
    )
    budget = F.floor("_ev_target")
    epochs = F.when(F.col("_ev_source_size") > 0, F.floor(budget / F.col("_ev_source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("_ev_source_size") - F.col("_ev_offset") - F.col("_ev_before")
    taken = epochs * F.col("_ev_size") + F.greatest(F.lit(0), F.least(F.col("_ev_size"), rest))
    return placed.select("_ev_doc", "_ev_row", "_ev_source", "_ev_size", "_ev_source_size", "_ev_target", taken.cast("long").alias("_ev_taken"))


def mix_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed corpus, same columns: each document as often as the mix takes it, the one at a source's cut whole."""
    copies = mix(docs, **parameters).groupBy("_ev_doc", "_ev_row", "_ev_source").agg(F.max("_ev_size").alias("s"), F.avg("_ev_taken").alias("t"))
    copies = copies.where("t > 0").select(
        "_ev_doc", "_ev_row", F.col("_ev_source").alias("_ev_name"), F.sequence(F.lit(1), F.ceil(F.col("t") / F.col("s")).cast("int")).alias("_ev_copies")
    )
    same = docs["doc_id"].eqNullSafe(copies["_ev_doc"]) & (F.xxhash64(docs["text"]) == copies["_ev_row"]) & docs["source"].eqNullSafe(copies["_ev_name"])
    return docs.join(copies, same).select(*[docs[c] for c in docs.columns], F.explode("_ev_copies").alias("_ev_copy")).drop("_ev_copy")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: what it takes of each."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        F.col("_ev_doc").alias("doc_id"),
        F.col("_ev_size").alias("size"),
        F.col("_ev_source_size").alias("source_size"),
        F.col("_ev_target").alias("target"),
        F.col("_ev_taken").alias("taken"),
    )


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight,
         row_number() OVER (ORDER BY source IS NULL, source) AS nth
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio,
         sum(source_size) OVER ()::BIGINT AS all_size FROM totals
), levels AS (
  SELECT *, coalesce(sum(cap) OVER before, 0)::BIGINT AS spent,
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS left_weight
  FROM ranked WINDOW before AS (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first_open AS (
  SELECT ratio AS o_ratio, nth AS o_nth, spent AS o_spent, left_weight AS o_weight FROM levels
  WHERE weight * (all_size - spent) <= cap * left_weight ORDER BY ratio, nth LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN o_nth IS NULL OR (ratio, nth) < (o_ratio, o_nth) THEN cap::DOUBLE
              ELSE (weight * (all_size - o_spent)) / o_weight END AS target
  FROM levels LEFT JOIN first_open ON true
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size
                 + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM placed
"""
