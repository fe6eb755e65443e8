"""Files in, graphs out: raw documents, property graphs and vectors on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Raw files as documents: an id from their content, name, extension, size in MB and digest."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    digest = F.sha2("content", 256)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(
        F.substring(digest, 1, 32).alias("doc_id"),
        name.alias("filename"),
        F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"),
        F.round(F.col("length") / 1048576, 2).alias("filesize_mb"),
        digest.alias("checksum"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("ingested_at"),
        "content",
    )


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet, a partition per document; documents that are written again are replaced."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str, doc_id=None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all documents, or of one: the filter prunes partitions."""
    both = [spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges")]
    return tuple(df if doc_id is None else df.where(F.col("doc_id") == doc_id) for df in both)


def node_link_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON object a document in node-link form. A document's graph is gathered in one row: for exports of single
    documents, as their reader takes them whole."""
    n = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in nodes.columns if c != "doc_id"]))).alias("nodes"))
    e = edges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in edges.columns if c != "doc_id"]))).alias("links"))
    return n.join(e, "doc_id", "left").select("doc_id", F.to_json(F.struct(F.lit(True).alias("directed"), "nodes", "links")).alias("graph"))


def check_vectors(vectors: DataFrame, dimension: int, column: str = "v") -> DataFrame:
    """The vectors; reading one of another dimension fails."""
    right = F.size(column) == dimension
    return vectors.withColumn(column, F.when(right, F.col(column)).otherwise(F.raise_error(F.lit(f"a vector doesn't have {dimension} components"))))


def documents_in(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a stored graph, from the names of its partitions."""
    return spark.read.parquet(f"{path}/nodes").select("doc_id").distinct()


def delete_document(spark: SparkSession, path: str, doc_id) -> None:
    """Remove a document's partitions."""
    jvm = spark.sparkContext._jvm
    for name in ("nodes", "edges"):
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/doc_id={doc_id}")
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def save_vectors(vectors: DataFrame, path: str, dimension: int, column: str = "v") -> None:
    """Vectors as Parquet, a partition per document; documents that are written again are replaced. The dimension is kept
    with every vector, so that a reader can tell what it was written with."""
    kept = check_vectors(vectors, dimension, column).withColumn("dimension", F.lit(dimension))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def load_vectors(spark: SparkSession, path: str, dimension: int | None = None, doc_id=None) -> DataFrame:
    """Vectors of all documents, or of one. With a dimension, ``reindex`` marks those that were written with another."""
    kept = spark.read.parquet(path)
    kept = kept if doc_id is None else kept.where(F.col("doc_id") == doc_id)
    return kept if dimension is None else kept.withColumn("reindex", F.col("dimension") != dimension)


def save_metadata(metadata: DataFrame, path: str) -> None:
    """Metadata of documents as JSON, a partition per document; documents that are written again are replaced."""
    metadata.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").json(path)


def load_metadata(spark: SparkSession, path: str, schema: str, doc_id=None) -> DataFrame:
    """Metadata of all documents, or of one, under a stated schema (which saves the pass that would infer it)."""
    kept = spark.read.schema(schema).json(path)
    return kept if doc_id is None else kept.where(F.col("doc_id") == doc_id)


def save_pictures(images: DataFrame, path: str) -> None:
    """Pictures (doc_id, image_id, format, content, ...) as Parquet with their bytes, a partition per document. A file each
    would be as many small files as pictures; ``load_pictures`` gives the name that such a file would have."""
    images.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def load_pictures(spark: SparkSession, path: str, doc_id=None) -> DataFrame:
    """Pictures of all documents, or of one, with their file names."""
    kept = spark.read.parquet(path).withColumn("filename", F.concat_ws(".", "image_id", "format"))
    return kept if doc_id is None else kept.where(F.col("doc_id") == doc_id)
