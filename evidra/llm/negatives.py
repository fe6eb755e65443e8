"""Hard negatives by a vector-approximation file.

Vectors are made integers; equal vectors of one label are one entry (see ``topk``). Every dimension is cut into ``CELLS``
cells: inner edges are quantiles of a sample of at most ``SAMPLE`` entries, the outer ones the least and largest component
of all entries, so a cell's number, one byte, bounds a component from both sides. Entries of a label are packed into blocks
that hold the cells and, in columns of their own, the exact vectors.

Both questions are of one form: the best rows of a query whose score lies in a window. Positives: own label, window
without ends. Negatives: other labels, a window for each different score of a positive. A question takes two scans:

* Cells only. A query's smallest and largest product with each cell is looked up and summed over dimensions, for all
  queries of a chunk at once: edges of the cells, looked up by number, times the positive and the negative components. An
  entry whose bounds both lie in the window is surely in it; the n-th largest lower bound of such entries, over all blocks,
  is the least that a row must reach.
* Exact. Only tiles of blocks go out where the first scan saw an upper bound that reaches it, and in them only those
  entries are scored whose bounds still meet what is left of the window.

Chunks and blocks meet in tiles, results are folded one by one in the order of chunks, so no task holds a group that
grows with the table. To the driver go the sample and a label for each block.

Defined cases: rows without an id or a label, and vectors that are null or hold null or non-finite components, take no
part; shorter vectors count as padded with 0; rows that share an anchor's id are not its positives; ties go to the
smaller id; repeated rows count each, as anchors, positives and negatives; products beyond 64 bits fail; extra columns
are ignored; an empty table gives an empty table; a positive with a score below 0 has no negatives, as its window is
empty.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import table, written
from evidra.llm.topk import _leading, _matrix, _products, entries, integers

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95  # LOW and HIGH: per cent of the positive's score
CELLS, SAMPLE, MIN_BLOCK, MAX_BLOCK, CHUNK, TILE = 64, 4096, 128, 8192, 128, 8
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FAR = 2**62


class Grid:
    """The cells of each dimension: ``low`` and ``high`` hold the least and the largest component of a cell."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, cells: int, kind: str):
        d = sample.shape[1]
        inner = np.sort(sample, axis=0)[(np.arange(1, cells) * len(sample)) // cells].T  # d x (cells - 1)
        self.inner = np.clip(inner, least[:, None], most[:, None] + 1)
        self.low = np.concatenate([least[:, None], self.inner], 1)
        self.high = np.concatenate([self.inner - 1, most[:, None]], 1)
        self.d, self.kind, self.exact = d, kind, float(max(-least.min(initial=0), most.max(initial=0))) ** 2 * d < 2.0**53
        self.labels = np.zeros(0, np.int64)  # of the blocks, by number
        self.blocks = np.zeros(0, np.int64)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Cells of vectors, a byte for each component."""
        return np.stack([np.searchsorted(self.inner[i], x[:, i], side="right") for i in range(self.d)], 1).astype(np.uint8)

    def bounds(self, q: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products of queries and the vectors in these cells."""
        dims = np.arange(self.d)
        low, high = self.low[dims, codes].astype(np.float64).T, self.high[dims, codes].astype(np.float64).T
        q = q.astype(np.float64)
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        lower, upper = plus @ low + minus @ high, plus @ high + minus @ low
        if not self.exact:  # room for rounding
            room = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high))) + 1
            lower, upper = lower - room, upper + room
        return lower, upper


def _packed(rows: DataFrame, size: int, names: list[str], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """Rows (label, key, columns), sorted and packed into lists of at most ``size`` of one label."""

    def pack(batches):
        held: list[tuple] = []

        def out():
            columns = [[held[0][0]], *([[h[i] for h in held]] for i in range(1, len(names)))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][0] != row[0] or len(held) >= size):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    ordered = rows.repartitionByRange("label", "key").sortWithinPartitions("label", "key").select(*names)
    return ordered.mapInArrow(pack, schema)


def _file(found: DataFrame, sent, block: int) -> DataFrame:
    """The approximation file: blocks of cells (codes, first ids) and of exact vectors (v) with their ids and rows."""

    def place(batches):
        grid = sent.value
        for batch in batches:
            x = _matrix(batch.column(2).to_pylist(), grid.d)
            ids = [np.array([(i["vec_id"], i["rows"]) for i in e], np.int64) for e in batch.column(3).to_pylist()]
            codes = grid.codes(x) if len(x) else []
            columns = [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([int(i[0, 0]) for i in ids], pa.int64())]
            columns += [pa.array([r.astype(grid.kind).tobytes() for r in x], pa.binary()), pa.array([i.tobytes() for i in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "key", "codes", "first", "v", "ids"])

    placed = found.select("label", "key", "v", "ids").mapInArrow(place, "label long, key string, codes binary, first long, v binary, ids binary")
    many = pa.list_(pa.binary())
    kinds = [pa.int64(), many, pa.list_(pa.int64()), many, many]
    blocks = _packed(placed, block, ["label", "codes", "first", "v", "ids"], "label long, codes array<binary>, first array<long>, v array<binary>, ids array<binary>", kinds)
    return written(blocks.withColumn("block", F.monotonically_increasing_id()), "approximations")


def _asks(row: dict) -> np.ndarray:
    """A chunk's questions: number of the query, lower and upper end of the window."""
    return np.frombuffer(row["asks"], np.int64).reshape(-1, 3)


def _surest(lower: np.ndarray, first: np.ndarray, n: int) -> list[tuple[float, int]]:
    """The largest lower bounds of entries with n different first ids."""
    order = np.argsort(-lower, kind="stable") if len(lower) <= 8 * n else np.argpartition(-lower, 8 * n)[: 8 * n]
    found = _distinct(zip(lower[order].tolist(), first[order].tolist(), strict=True), n)
    return found if len(found) == n or len(lower) <= 8 * n else _distinct(zip(lower.tolist(), first.tolist(), strict=True), n)


def _distinct(pairs: Iterable[tuple[float, int]], n: int) -> list[tuple[float, int]]:
    best: dict[int, float] = {}
    for value, i in pairs:
        best[i] = max(value, best.get(i, value))
    return sorted(((v, i) for i, v in best.items()), reverse=True)[:n]


def _folded(told: DataFrame, names: list[str], schema: str, join: Callable) -> DataFrame:
    """Rows of a chunk folded one after another: ``join(held, row)`` takes the first row with None; the last ``held`` is a
    row of the result."""

    def run(batches):
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if held is not None and held["chunk"] != row["chunk"]:
                    yield pa.RecordBatch.from_pylist([held], arrow)
                    held = None
                held = join(held, row)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], arrow)

    arrow = pa.schema([("chunk", pa.int64()), *((n, pa.list_(pa.binary())) for n in names)])
    return told.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, schema)


def best_in_windows(chunks: DataFrame, blocks: DataFrame, sent, same: bool, n: int) -> DataFrame:
    """For each chunk (chunk, label, keys, qs, asks) what is best in its windows: chunk, ``found``, a list for each ask
    of (score, id, rows) by falling score and rising id, down to the one that brings the n-th different id. Blocks are
    those of the chunk's label, or of all others."""

    def plan(batches):
        grid = sent.value
        for batch in batches:
            for chunk, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tiles = np.unique(grid.blocks[(grid.labels == label) == same] // TILE)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tiles), chunk), pa.int64()), pa.array(tiles, pa.int64())], names=["chunk", "btile"])

    def read(mine: pa.Table, theirs: pa.Table):
        """Chunks with their blocks and the bounds of both."""
        grid = sent.value
        held = [(b["label"], np.frombuffer(b"".join(b["codes"]), np.uint8).reshape(-1, grid.d), np.array(b["first"], np.int64), b) for b in theirs.to_pylist()]
        for row in mine.to_pylist():
            q = np.frombuffer(row["qs"], grid.kind).reshape(-1, grid.d)
            yield row, q, _asks(row), ((grid.bounds(q, codes), first, b) for label, codes, first, b in held if (label == row["label"]) == same)

    def rough(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        for row, _, asks, met in read(mine, theirs):
            sure: list[list] = [[] for _ in asks]
            tops = np.full(len(asks), -np.inf)
            for (lower, upper), first, _ in met:
                for a, (i, least, most) in enumerate(asks.tolist()):
                    low, up = lower[i], upper[i]
                    meets = up[(low <= most) & (up >= least)]
                    tops[a] = max(tops[a], meets.max(initial=-np.inf))
                    inside = np.flatnonzero((low >= least) & (up <= most))
                    if len(inside):
                        sure[a] = _distinct(sure[a] + _surest(low[inside], first[inside], n), n)
            best = [np.array(s, np.float64).reshape(-1, 2)[:, 0].tobytes() for s in sure]
            ids = [np.array([i for _, i in s], np.int64).tobytes() for s in sure]
            out.append({"chunk": row["chunk"], "btile": key[1].as_py(), "tops": [t.tobytes() for t in tops], "best": best, "ids": ids})
        return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("btile", pa.int64()), ("tops", pa.list_(pa.binary())), ("best", pa.list_(pa.binary())), ("ids", pa.list_(pa.binary()))]))

    def surer(held: dict | None, row: dict) -> dict:
        if held is None:
            return {k: row[k] for k in ("chunk", "best", "ids")}
        for a in range(len(row["best"])):
            pairs = [p for h in (held, row) for p in zip(np.frombuffer(h["best"][a]).tolist(), np.frombuffer(h["ids"][a], np.int64).tolist(), strict=True)]
            kept = _distinct(pairs, n)
            held["best"][a] = np.array([v for v, _ in kept], np.float64).tobytes()
            held["ids"][a] = np.array([i for _, i in kept], np.int64).tobytes()
        return held

    def raised(batches):
        """Questions whose windows begin at what surely is reached, and the tiles where something may reach it."""
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                asks = _asks(row).copy()
                for a, best in enumerate(row["best"]):
                    if len(best) == 8 * n:
                        asks[a, 1] = max(asks[a, 1], math.floor(np.frombuffer(best)[-1]))
                tops = np.array([np.frombuffer(t)[0] for t in row["tops"]])
                if len(asks) and (tops >= asks[:, 1]).any():
                    rows.append({"chunk": row["chunk"], "btile": row["btile"], "asks": asks.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("btile", pa.int64()), ("asks", pa.binary())]))

    def score(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        grid, out = sent.value, []
        for row, q, asks, met in read(mine, theirs):
            best: list[list] = [[] for _ in asks]
            of = np.split(np.arange(len(asks)), np.flatnonzero(np.diff(asks[:, 0])) + 1) if len(asks) else []
            for (lower, upper), _, b in met:
                x = np.frombuffer(b"".join(b["v"]), grid.kind).reshape(-1, grid.d)
                for group in of:
                    i = int(asks[group[0], 0])
                    may = np.zeros(len(x), bool)
                    for a in group:
                        may |= (upper[i] >= asks[a, 1]) & (lower[i] <= asks[a, 2])
                    may = np.flatnonzero(may)
                    scores = _products(q[i : i + 1], x[may])[0]
                    for a in group.tolist():
                        good = np.flatnonzero((scores >= asks[a, 1]) & (scores <= asks[a, 2]))
                        if len(good) > n:  # further entries can't bring one of the first n ids, ties aside
                            good = good[scores[good] >= np.partition(scores[good], len(good) - n)[len(good) - n]]
                        if len(good):
                            pairs = [(int(scores[j]), *p) for j in good.tolist() for p in np.frombuffer(b["ids"][may[j]], np.int64).reshape(-1, 2).tolist()]
                            best[a] = _leading(best[a] + pairs, n - 1)
            out.append({"chunk": row["chunk"], "found": [np.array(f, np.int64).tobytes() for f in best]})
        return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("found", pa.list_(pa.binary()))]))

    def better(held: dict | None, row: dict) -> dict:
        if held is None:
            return row
        for a, f in enumerate(row["found"]):
            if f:
                both = [tuple(t) for h in (held["found"][a], f) for t in np.frombuffer(h, np.int64).reshape(-1, 3).tolist()]
                held["found"][a] = np.array(_leading(both, n - 1), np.int64).tobytes()
        return held

    def met_by(pairs: DataFrame, columns: list[str], kernel: Callable, schema: str, asks: DataFrame | None = None) -> DataFrame:
        tiles = written(pairs.withColumn("ctile", F.expr(f"chunk div {TILE}")), "tiles")
        own = chunks.select("chunk", "label", "qs") if "asks" in pairs.columns else chunks.select("chunk", "label", "qs", "asks")
        mine = tiles.join(own, "chunk")
        names = tiles.select(F.col("ctile").alias("of_chunks"), F.col("btile").alias("of_blocks")).distinct()
        theirs = names.join(blocks.select(*columns).withColumn("of_blocks", F.expr(f"block div {TILE}")), "of_blocks")
        return mine.groupBy("ctile", "btile").cogroup(theirs.groupBy("of_chunks", "of_blocks")).applyInArrow(kernel, schema)

    pairs = chunks.select("chunk", "label").mapInArrow(plan, "chunk long, btile long")
    told = written(met_by(pairs, ["block", "label", "codes", "first"], rough, "chunk long, btile long, tops array<binary>, best array<binary>, ids array<binary>"), "bounds")
    reached = _folded(told.drop("tops", "btile"), ["best", "ids"], "chunk long, best array<binary>, ids array<binary>", surer)
    open_ = told.select("chunk", "btile", "tops").join(reached.select("chunk", "best"), "chunk").join(chunks.select("chunk", "asks"), "chunk")
    left = open_.mapInArrow(raised, "chunk long, btile long, asks binary")
    scored = met_by(left, ["block", "label", "codes", "first", "v", "ids"], score, "chunk long, found array<binary>")
    return written(_folded(scored, ["found"], "chunk long, found array<binary>", better), "best")


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def mine(vectors: DataFrame, is_anchor: Callable[[Column], Column], positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, cells: int = CELLS, block: int | None = None, chunk: int = CHUNK, vector: str = "embedding") -> DataFrame:
    """Hard negatives of the anchors' positives. ``is_anchor`` tests the column of ids; labels are integers in ``label``."""
    spark = vectors.sparkSession
    if not 2 <= cells <= 256:
        raise ValueError("cells are numbered by one byte")
    labelled = integers(vectors.where("label IS NOT NULL"), vector, ("label",))
    ints = written(labelled.withColumn("key", F.concat(F.sha2("v", 256), F.lit(":"), F.col("label"))), "integers")
    d, top = ints.agg(F.max("d"), F.max("top")).first()
    if d is None:
        return spark.createDataFrame([], _RESULT)
    kept = max(positives, negatives)
    found = written(entries(ints, kept).withColumn("label", F.substring_index("key", ":", -1).cast("long")), "entries")
    n, d = found.count(), max(1, int(d))
    block = block or min(MAX_BLOCK, max(MIN_BLOCK, math.ceil(math.sqrt(n))))

    def ends(batches):
        least, most = np.full(d, _FAR), np.full(d, -_FAR)
        for batch in batches:
            x = _matrix(batch.column(0).to_pylist(), d)
            if len(x):
                least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(least, pa.int64()), pa.array(most, pa.int64())], names=["i", "least", "most"])

    span = found.select("v").mapInArrow(ends, "i int, least long, most long").groupBy("i").agg(F.min("least").alias("least"), F.max("most").alias("most")).orderBy("i").collect()
    sample = _matrix([bytes(r["v"]) for r in found.orderBy("key").select("v").limit(SAMPLE).collect()], d)
    grid = Grid(sample, np.array([r["least"] for r in span], np.int64), np.array([r["most"] for r in span], np.int64), cells, "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8")
    blocks = _file(found, spark.sparkContext.broadcast(grid), block)
    places = blocks.select("block", "label").collect()  # a row for each block
    grid.blocks, grid.labels = (np.array([r[i] for r in places], np.int64) for i in (0, 1))
    sent = spark.sparkContext.broadcast(grid)

    anchors = ints.where(is_anchor(F.col("vec_id"))).select(F.col("vec_id").alias("anchor_id"), "key")
    asked = found.join(anchors.select("key").distinct(), "key", "left_semi").select("label", "key", "v")
    many = pa.list_(pa.binary())
    packed = _packed(asked, chunk, ["label", "key", "v"], "label long, keys array<string>, vs array<binary>", [pa.int64(), pa.list_(pa.string()), many])

    def whole(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                q = _matrix(row["vs"], d)
                asks = np.array([(i, -_FAR, _FAR) for i in range(len(q))], np.int64)
                rows.append({"label": row["label"], "keys": row["keys"], "qs": q.astype(grid.kind).tobytes(), "asks": asks.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("label", pa.int64()), ("keys", pa.list_(pa.string())), ("qs", pa.binary()), ("asks", pa.binary())]))

    chunks = written(packed.mapInArrow(whole, "label long, keys array<string>, qs binary, asks binary").withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    near = best_in_windows(chunks, blocks, sent, True, positives + 1).withColumnRenamed("found", "near")

    def windows(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                asks = []
                for i, f in enumerate(row["near"]):
                    scores = sorted({s for s, _, _ in np.frombuffer(f, np.int64).reshape(-1, 3).tolist()}, reverse=True)
                    asks += [(i, least, most) for least, most in (window(s, low, high) for s in scores) if least <= most]
                rows.append(row | {"asks": np.array(asks, np.int64).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("label", pa.int64()), ("keys", pa.list_(pa.string())), ("qs", pa.binary()), ("near", many), ("asks", pa.binary())]))

    second = written(chunks.drop("asks").join(near, "chunk").select("chunk", "label", "keys", "qs", "near").mapInArrow(windows, "chunk long, label long, keys array<string>, qs binary, near array<binary>, asks binary"), "windows")
    hard = best_in_windows(second, blocks, sent, False, negatives)

    def told(batches):
        for batch in batches:
            for row in batch.to_pylist():
                asks, rows = _asks(row), []
                for i, (key, f) in enumerate(zip(row["keys"], row["near"], strict=True)):
                    mine_ = np.flatnonzero(asks[:, 0] == i).tolist()
                    rows.append({"key": key, "near": f, "asks": asks[mine_].tobytes(), "hard": [row["found"][a] for a in mine_] if row["found"] else []})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("near", pa.binary()), ("asks", pa.binary()), ("hard", many)]))

    def emitted(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                triples = [tuple(t) for t in np.frombuffer(row["near"], np.int64).reshape(-1, 3).tolist()]
                others = [(s, i) for s, i, times in triples if i != row["anchor_id"] for _ in range(times)][:positives]
                known = {tuple(a[1:]): h for a, h in zip(_asks(row).tolist(), row["hard"], strict=False)}
                for s, i in others:
                    bad = [(t, j) for t, j, times in np.frombuffer(known.get(window(s, low, high), b""), np.int64).reshape(-1, 3).tolist() for _ in range(times)]
                    rows += [(row["anchor_id"], i, r + 1, j, s, t) for r, (t, j) in enumerate(bad[:negatives])]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int32() if c == 2 else pa.int64() for c in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _RESULT.split(", ")])

    known = second.select("chunk", "keys", "near", "asks").join(hard, "chunk", "left").select("keys", "near", "asks", "found")
    answers = known.mapInArrow(told, "key string, near binary, asks binary, hard array<binary>")
    return anchors.join(answers, "key").select("anchor_id", "near", "asks", "hard").mapInArrow(emitted, _RESULT)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 50; a seventh of the labels is moved on by one."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), lambda ids: ids % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS alike, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q CROSS JOIN v c WHERE q.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
