"""Line dedup, native: lines repeated in many documents stay only in the document with the largest id.

A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased. Two independent 64-bit
hashes stand for the key. The hashes are range-partitioned together with the document id, so one line that a third
of all documents share is spread over many tasks, and sorted by document and position inside each partition; a
streaming pass keeps the first occurrence in each document, and partial counts of these meet per key. What comes
back is a bitmap of kept lines per document (64 lines a word, words without a dropped line implied), not text.

Defined cases: a null or empty text is one empty line; rows whose doc_id is null take no part and keep every line;
rows that repeat a doc_id count as one document, each with its own bitmap; extra columns pass through; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.llm.common import WHITE, ascii_lower, table, written

MIN_CHARS, MIN_DOCS = 40, 5


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One narrow row for each line long enough to count: document, row print, position and two key hashes."""
    lines = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").alias("_ev_doc"),
        F.xxhash64("text").alias("_ev_row"),
        F.posexplode(F.split("text", "\n", -1)).alias("_ev_pos", "line"),
    )
    key = F.btrim("line", F.lit(WHITE))
    return (
        lines.where(F.char_length("line") >= min_chars)
        .withColumn("key", key)
        .where(F.char_length("key") >= min_chars)
        .withColumn("key", ascii_lower(F.col("key")))
        .select("_ev_doc", "_ev_row", "_ev_pos", F.xxhash64("key").alias("_ev_h1"), F.xxhash64(F.lit(1), "key").alias("_ev_h2"))
    )


def repeated_keys(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Keys found in at least ``min_docs`` documents, with the document that keeps its lines."""
    ranged = hashes.repartitionByRange("_ev_h1", "_ev_h2", "_ev_doc")
    streamed = Window.partitionBy("_ev_h1", "_ev_h2", "_ev_doc").orderBy("_ev_row", "_ev_pos")
    firsts = ranged.withColumn("_ev_nth", F.row_number().over(streamed)).where("_ev_nth = 1")
    return (
        firsts.groupBy("_ev_h1", "_ev_h2")
        .agg(F.count(F.lit(1)).alias("_ev_docs"), F.max("_ev_doc").alias("_ev_keeper"))
        .where(F.col("_ev_docs") >= min_docs)
        .select("_ev_h1", "_ev_h2", "_ev_keeper")
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document that loses lines: its keep bitmap (bit i of word w is line 64w + i; words past the end are all
    ones) and the number of dropped lines. Key columns are the document id and the print of its text."""
    hashes = written(line_hashes(docs, min_chars), "line-hashes")
    # Read back from a table so that both sides of the join are plain exchanges, which adaptive execution can split.
    repeated = written(repeated_keys(hashes, min_docs), "line-keys")
    dropped = hashes.join(repeated, ["_ev_h1", "_ev_h2"]).where("_ev_doc <> _ev_keeper")
    words = (
        dropped.select("_ev_doc", "_ev_row", "_ev_pos")
        .distinct()
        .repartition("_ev_doc", "_ev_row")
        .groupBy("_ev_doc", "_ev_row", F.expr("cast(_ev_pos div 64 as int)").alias("word"))
        .agg(F.expr("~bit_or(shiftleft(1L, _ev_pos % 64))").alias("bits"), F.count(F.lit(1)).alias("n"))
    )
    return (
        words.groupBy("_ev_doc", "_ev_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"), F.max("word").alias("top"), F.sum("n").alias("_ev_dropped"))
        .select("_ev_doc", "_ev_row", "_ev_dropped", F.expr("transform(sequence(0, top), w -> coalesce(m[w], -1L))").alias("_ev_keep"))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with their dropped lines gone, plus ``_ev_lines`` (before) and ``_ev_dropped``."""
    columns = docs.columns
    text = F.coalesce(docs["text"], F.lit(""))
    kept = F.expr("array_join(filter(split(text, '\n', -1), (x, i) -> coalesce(shiftright(get(_ev_keep, i div 64), i % 64) & 1L, 1L) = 1L), '\n')")
    joined = docs.join(bitmaps, (docs["doc_id"] == bitmaps["_ev_doc"]) & (F.xxhash64(docs["text"]) == bitmaps["_ev_row"]), "left")
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        *[docs[c] for c in columns if c != "text"],
        F.when(F.col("_ev_keep").isNull(), docs["text"]).otherwise(kept).alias("text"),
        lines.cast("long").alias("_ev_lines"),
        F.coalesce("_ev_dropped", F.lit(0)).cast("long").alias("_ev_dropped"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents, same columns, without the repeated lines."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs)).select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over all documents: counts and the digest of each kept text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = apply_bitmaps(docs, keep_bitmaps(docs))
    return done.select(
        "doc_id",
        F.col("_ev_lines").alias("n_lines"),
        F.col("_ev_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, (r.key IS NOT NULL AND k.doc_id <> r.keeper) AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
