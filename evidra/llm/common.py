"""What the operators share: the shared scratch folder, table reading and small column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.sources.scratch import drop_path, drop_scratch, scratch_dir, scratch_path, written

__all__ = ["ascii_lower", "crc_mod", "drop_path", "drop_scratch", "labelled_sample", "map_rows", "scratch_dir", "scratch_path", "table", "written"]

#: ASCII white space as every operator here understands it: U+0020 and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; ``lower`` does the same on pure ASCII and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def map_rows(df: DataFrame, schema: str, factory: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Apply Python to rows in Arrow batches without keeping a partition: ``factory()`` runs once a task and returns
    a function from a row's values to its output rows; its attribute ``finish``, if any, is called at the end of the
    task. ``schema`` is ``name type`` pairs of flat types."""
    fields = [f.split() for f in schema.split(",")]
    arrow = pa.schema([(name, _ARROW[kind]) for name, kind in fields])

    def run(batches):
        function = factory()
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*([v.as_py() for v in column] if pa.types.is_primitive(column.type) else _values(column) for column in batch.columns), strict=True):
                for result in function(*row):
                    out.append(result)
                    size += sum(len(v) for v in result if isinstance(v, (bytes, str)))
                    if len(out) >= 4096 or size > 1 << 22:
                        yield _batch(out, arrow)
                        out, size = [], 0
        if out:
            yield _batch(out, arrow)
        getattr(function, "finish", int)()  # workers outlive tasks: what a function keeps should not

    return df.mapInArrow(run, schema)


def _values(column):
    return (v.as_py() for v in column)  # one at a time: texts may be long


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> list[tuple[str, int]]:
    """Texts and labels of at most ``max_rows`` labelled documents, those with the smallest hash of their id, so that
    reruns agree. The bound makes broadcasting and collecting safe; null texts and labels take no part."""
    picked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", label).distinct()
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(max_rows)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.select("text", label, F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id", F.xxhash64("text")).limit(max_rows)
    return [(r[0], int(r[1])) for r in rows.collect()]
