"""A store of documents whose parts (graph, vectors, metadata, pictures) become visible together.

A save writes all parts of its documents to a fresh folder, a generation, which is never changed again, and then one
manifest: the numbered list of generations that make up the store. The manifest appears by a rename that fails where
its number is taken, so a save that fails before leaves the store as it was, and of two writers at once one has to try
again. A document is read from the newest generation that lists it, whether it holds rows of it or, after a
deletion, none. Readers hold a snapshot: whatever is written later doesn't change what they read. ``compact`` writes the
visible rows to one generation; ``clear`` begins an empty list. Folders of generations that no manifest needs any more
stay until ``vacuum``.

Only manifests pass through the driver: a name for each generation, of which ``compact`` leaves one."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.sources.scratch import drop_path


class StoreConflict(RuntimeError):
    """Another writer has committed since the snapshot was read."""


class Snapshot:
    """The store as one manifest has it."""

    def __init__(self, spark: SparkSession, path: str, number: int, generations: list[dict]):
        self.spark, self.path, self.number, self.generations = spark, path, number, generations

    def _at(self, generation: dict, part: str) -> str:
        return f"{self.path}/data/{generation['name']}/{part}"

    def newest(self) -> DataFrame:
        """Documents with the place of the generation that they are read from."""
        listed = [self.spark.read.parquet(self._at(g, "_documents")).withColumn("generation", F.lit(i)) for i, g in enumerate(self.generations)]
        return reduce(DataFrame.unionByName, listed).groupBy("doc_id").agg(F.max("generation").alias("generation"))

    def documents(self) -> DataFrame:
        """Ids of the visible documents."""
        if not self.generations:
            return self.spark.createDataFrame([], "doc_id string").limit(0)
        holding = [i for i, g in enumerate(self.generations) if g["parts"]]
        return self.newest().where(F.col("generation").isin(holding)).select("doc_id")

    def read(self, part: str, doc_id=None) -> DataFrame:
        """A part's rows, of all documents or of one. A part that no save has written is an error."""
        holding = [(i, g) for i, g in enumerate(self.generations) if part in g["parts"]]
        if not holding:
            raise KeyError(part)
        rows = [self.spark.read.parquet(self._at(g, part)).withColumn("generation", F.lit(i)) for i, g in holding]
        rows, newest = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows), self.newest()
        if doc_id is not None:
            rows, newest = rows.where(F.col("doc_id") == doc_id), newest.where(F.col("doc_id") == doc_id)
        return rows.join(newest, ["doc_id", "generation"], "left_semi").drop("generation")


class DocumentStore:
    """Saves and snapshots under a path in the cluster's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        where = self._path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The newest state of the store, or that of a number; an empty one before the first save."""
        numbers = self._numbers()
        if number is None:
            number = numbers[-1] if numbers else -1
        if number < 0:
            return Snapshot(self.spark, self.path, -1, [])
        text = self.spark.read.text(f"{self.path}/manifests/{number:012d}.json", wholetext=True).first()[0]
        return Snapshot(self.spark, self.path, number, json.loads(text))

    def _commit(self, base: Snapshot, generations: list[dict]) -> Snapshot:
        jvm = self.spark.sparkContext._jvm
        draft, final = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.path}/manifests/{base.number + 1:012d}.json")
        self._fs.mkdirs(final.getParent())
        stream = self._fs.create(draft)
        try:
            stream.write(bytearray(json.dumps(generations).encode()))
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        keep = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, keep)  # fails where the name is taken
        except Exception as error:
            drop_path(self.spark, str(draft.toString()))
            if "FileAlreadyExists" in str(error):
                raise StoreConflict(f"manifest {base.number + 1} has been written") from error
            raise
        return Snapshot(self.spark, self.path, base.number + 1, generations)

    def _generation(self, parts: dict[str, DataFrame], documents: DataFrame) -> dict:
        name = uuid.uuid4().hex
        for part, rows in parts.items():
            rows.write.parquet(f"{self.path}/data/{name}/{part}")
        documents.select("doc_id").distinct().write.parquet(f"{self.path}/data/{name}/_documents")
        return {"name": name, "parts": sorted(parts)}

    def save(self, parts: dict[str, DataFrame], base: Snapshot | None = None) -> Snapshot:
        """Write parts (each with doc_id). All documents in any of them are replaced as a whole: what they had in other parts
        before is no longer seen. With ``base``, fails if another writer has committed since."""
        base = base or self.snapshot()
        documents = reduce(DataFrame.union, [rows.select("doc_id") for rows in parts.values()])
        return self._commit(base, [*base.generations, self._generation(parts, documents)])

    def delete(self, documents: DataFrame, base: Snapshot | None = None) -> Snapshot:
        """Remove documents (doc_id)."""
        base = base or self.snapshot()
        return self._commit(base, [*base.generations, self._generation({}, documents)])

    def clear(self) -> Snapshot:
        """Remove all documents."""
        return self._commit(self.snapshot(), [])

    def compact(self) -> Snapshot:
        """The same rows in one generation."""
        base = self.snapshot()
        names = sorted({p for g in base.generations for p in g["parts"]})
        if not names:
            return self._commit(base, [])
        return self._commit(base, [self._generation({p: base.read(p) for p in names}, base.documents())])

    def vacuum(self) -> int:
        """Delete the folders of generations that the newest manifest doesn't name, and older manifests; readers of older
        snapshots must have finished. Returns the number of folders."""
        now, where = self.snapshot(), self._path(f"{self.path}/data")
        used = {g["name"] for g in now.generations}
        stale = [s.getPath() for s in self._fs.listStatus(where) if s.getPath().getName() not in used] if self._fs.exists(where) else []
        for old in stale:
            self._fs.delete(old, True)
        for number in self._numbers():
            if number < now.number:
                self._fs.delete(self._path(f"{self.path}/manifests/{number:012d}.json"), False)
        return len(stale)
