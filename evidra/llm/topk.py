"""Exact top-k by inner product with a pivot-distance index.

Vectors are made integers, and given one more coordinate that brings them all to the largest norm M; then the larger
an inner product with a query, the smaller the distance to it, |q|^2 + M^2 - 2 q.x. Equal vectors are one entry that
holds its k + 1 smallest ids with their numbers of rows, which is all that any query can need; equal queries are asked
once. Each entry is keyed by its nearest pivot and its distance to it; in that order entries are packed into blocks,
each one a stretch of an annulus around a pivot. For a query, the triangle inequality gives each block a smallest
possible distance, its gap. Queries, in chunks of neighbours, expand over the annuli in rounds of rising gap (``STEPS``
blocks, then whatever is left); after each round the k-th best score gives a smaller radius, and a query stops once no
unseen block has a gap within it. Scores are matrix products of whole numbers, so results are exact.

A round ships names first: which tiles (``TILE`` chunks x ``TILE`` blocks) hold something to compare. Chunks and blocks
are then sent once for each tile that they take part in. To the driver and the workers go the pivots, as many as the
square root of the entries (at most ``MAX_PIVOTS``), and three numbers for each block.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without an id take no part;
shorter vectors count as padded with 0; rows that share a query's id are no candidates; ties go to the smaller id;
rows that repeat an id are candidates and queries each; components or scores beyond 64 bits fail; extra columns are
ignored; an empty table gives an empty table. Pivots are entries with the smallest digests; the index holds every row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.llm.common import table, written

K, SCALE, MAX_PIVOTS, MIN_BLOCK, MAX_BLOCK, CHUNK, TILE = 5, 256.0, 1 << 15, 128, 8192, 128, 8
STEPS = (4, 32)  # blocks that a query has seen after the first rounds, those of the smallest gaps
_RESULT = "query_id long, rank int, vec_id long, score long"


def integers(vectors: DataFrame, vector: str = "embedding", also: tuple[str, ...] = ()) -> DataFrame:
    """Rows that take part: vec_id, dimension, floor(256 x) as 64-bit integers without zeros at the end, squared norm,
    largest component, and columns of 64-bit integers that come along."""
    usable = F.col("vec_id").isNotNull() & F.expr(f"{vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")

    def run(batches):
        for batch in batches:
            floats = [np.trim_zeros(np.floor(SCALE * np.asarray(x.as_py(), np.float64)), "b") for x in batch.column(1)]
            top = [float(np.abs(f).max(initial=0)) for f in floats]
            if max(top, default=0) >= 2.0**63:
                raise OverflowError("a component times 256 is beyond 64 bits, and so are scores")
            columns = [
                batch.column(0).cast(pa.int64()),
                pa.array([len(f) for f in floats], pa.int32()),
                pa.array([f.astype(np.int64).tobytes() for f in floats], pa.binary()),
                pa.array([float(f @ f) for f in floats], pa.float64()),
                pa.array(top, pa.float64()),
                *batch.columns[2:],
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "d", "v", "norm2", "top", *also])

    schema = "vec_id long, d int, v binary, norm2 double, top double" + "".join(f", {c} long" for c in also)
    return vectors.where(usable).select("vec_id", vector, *(F.col(c).cast("long") for c in also)).mapInArrow(run, schema)


def _matrix(values, d: int) -> np.ndarray:
    """Rows of packed integers, padded with 0."""
    rows = [np.frombuffer(v, np.int64) for v in values]
    out = np.zeros((len(rows), d), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; those beyond 64 bits fail."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return (a.astype(object) @ b.T.astype(object)).astype(np.int64)


def _lifted(x: np.ndarray, pivots: np.ndarray, m2: float) -> np.ndarray:
    """Distances of index vectors to pivots, both brought to norm M."""
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    rest = np.sqrt(np.maximum(0, m2 - (x * x).sum(1)))[:, None] * np.sqrt(np.maximum(0, m2 - (p * p).sum(1)))[None]
    return np.sqrt(np.maximum(0, 2 * m2 - 2 * (x @ p.T + rest)))


def _reach(q: np.ndarray, pivots: np.ndarray, m2: float) -> np.ndarray:
    """Distances of queries, which get no further coordinate, to pivots."""
    q, p = q.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + m2 - 2 * (q @ p.T)))


def _radius(q: np.ndarray, bound: np.ndarray, m2: float) -> np.ndarray:
    """How far a vector at least as good as ``bound`` can be, with a margin for rounding."""
    q = q.astype(np.float64)
    return np.sqrt(np.maximum(0, (q * q).sum(1) + m2 - 2 * bound)) * (1 + 1e-9) + 1e-6 * max(1.0, np.sqrt(m2))


def _gaps(q: np.ndarray, space: Space) -> np.ndarray:
    """Smallest possible distances of queries to the blocks."""
    reach = _reach(q, space.pivots, space.m2)[:, space.pivot]
    return np.maximum(0, np.maximum(reach - space.hi, space.lo - reach))


def _leading(items: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """The best (score, id, rows) up to the one that brings the k + 1st id: without any one id, k rows are left."""
    items.sort(key=lambda t: (-t[0], t[1]))
    ids: set[int] = set()
    for n, (_, i, _) in enumerate(items):
        ids.add(i)
        if len(ids) > k:
            return items[: n + 1]
    return items


class Space:
    """What all tasks know: pivots, the largest squared norm, and the place of each block."""

    def __init__(self, pivots: np.ndarray, m2: float, kind: str):
        self.pivots, self.m2, self.kind, self.d = pivots, m2, kind, pivots.shape[1]
        self.block = self.pivot = np.zeros(0, np.int64)
        self.lo = self.hi = np.zeros(0)


def entries(ints: DataFrame, k: int) -> DataFrame:
    """Distinct vectors by digest, with their smallest k + 1 ids and how many rows (k count) have each. Rows are counted
    by vector and id first, and cut to k + 1 ids before they meet, so that no group of copies meets in one task."""
    by_id = ints.groupBy("key", "vec_id").agg(F.first("v").alias("v"), F.least(F.count(F.lit(1)), F.lit(k)).alias("rows"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    first = by_id.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    return first.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct("vec_id", "rows"))).alias("ids"))


def build_index(found: DataFrame, space: Space, block: int) -> tuple[DataFrame, DataFrame]:
    """Entries by place (pivot, distance, key, v, ids as pairs), and the blocks packed from them."""
    kind = np.dtype(space.kind)

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist(), space.d)
            far = _lifted(x, space.pivots, space.m2)
            near = far.argmin(1) if len(x) else np.zeros(0, np.int64)
            ids = [np.array([(i["vec_id"], i["rows"]) for i in e], np.int64).tobytes() for e in batch.column(2).to_pylist()]
            columns = [pa.array(near, pa.int32()), pa.array(far[np.arange(len(x)), near], pa.float64()), batch.column(0), pa.array([r.astype(kind).tobytes() for r in x], pa.binary()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["pivot", "distance", "key", "v", "ids"])

    def pack(batches):
        held: list[tuple] = []

        def out():
            row = (held[0][0], held[0][1], held[-1][1], b"".join(h[2] for h in held), [h[3] for h in held])
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["pivot", "lo", "hi", "vectors", "ids"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][0] != row[0] or len(held) >= block):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    placed = written(found.select("key", "v", "ids").mapInArrow(place, "pivot int, distance double, key string, v binary, ids binary"), "placed")
    ordered = placed.select("pivot", "distance", "v", "ids", "key").repartitionByRange("pivot", "distance", "key").sortWithinPartitions("pivot", "distance", "key").drop("key")
    blocks = ordered.mapInArrow(pack, "pivot int, lo double, hi double, vectors binary, ids array<binary>")
    return placed, written(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")


_CHUNK = "keys array<string>, qs binary, bounds binary, seen binary, found array<binary>, compared long, open boolean"
_CHUNK_ARROW = pa.schema([("keys", pa.list_(pa.string())), ("qs", pa.binary()), ("bounds", pa.binary()), ("seen", pa.binary()), ("found", pa.list_(pa.binary())), ("compared", pa.int64()), ("open", pa.bool_())])


def _chunk_row(keys, q, bounds, seen, found, compared, is_open) -> dict:
    return dict(zip(_CHUNK_ARROW.names, (keys, q.tobytes(), bounds.tobytes(), seen.tobytes(), found, compared, is_open), strict=True))


def _read(row: dict, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q = np.frombuffer(row["qs"], space.kind).reshape(len(row["keys"]), space.d)
    return q, np.frombuffer(row["bounds"], np.float64), np.frombuffer(row["seen"], np.float64)


def _horizon(gaps: np.ndarray, step: int | None) -> np.ndarray:
    """The gap up to which each query looks in a round."""
    if step is None or step >= gaps.shape[1]:
        return np.full(len(gaps), np.inf)
    return np.partition(gaps, step - 1, axis=1)[:, step - 1]


def chunks_of(asked: DataFrame, size: int = CHUNK) -> DataFrame:
    """Queries (pivot, distance, key, v) packed into chunks of neighbours that know nothing yet."""

    def pack(batches):
        held: list[tuple[str, bytes]] = []

        def out():
            n = len(held)
            row = ([h[0] for h in held], b"".join(h[1] for h in held), np.full(n, -np.inf).tobytes(), np.full(n, -1.0).tobytes(), [b""] * n, 0, True)
            return pa.RecordBatch.from_pylist([dict(zip(_CHUNK_ARROW.names, row, strict=True))], _CHUNK_ARROW)

        for batch in batches:
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((key, v))
                if len(held) >= size:
                    yield out()
                    held = []
        if held:
            yield out()

    ordered = asked.repartitionByRange("pivot", "distance", "key").sortWithinPartitions("pivot", "distance", "key").select("key", "v")
    return written(ordered.mapInArrow(pack, _CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def expand(chunks: DataFrame, blocks: DataFrame, sent, k: int, step: int | None) -> DataFrame:
    """One round: chunks after their queries have looked at all blocks with gaps up to the round's horizon."""

    def plan(batches):
        space = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                q, bounds, seen = _read(row, space)
                need = np.zeros(len(space.block), bool)
                for part in np.array_split(np.arange(len(q)), max(1, len(q) // 16)):
                    gaps = _gaps(q[part], space)
                    limit = np.minimum(_horizon(gaps, step), _radius(q[part], bounds[part], space.m2))
                    need |= ((gaps > seen[part, None]) & (gaps <= limit[:, None])).any(0)
                tiles = np.unique(space.block[need] // TILE)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tiles), row["chunk"]), pa.int64()), pa.array(tiles, pa.int64())], names=["chunk", "btile"])

    def score(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        space = sent.value
        held = []
        for b in theirs.to_pylist():
            ids = [np.frombuffer(i, np.int64).reshape(-1, 2) for i in b["ids"]]
            held.append((b["pivot"], b["lo"], b["hi"], np.frombuffer(b["vectors"], space.kind).reshape(len(ids), space.d), ids))
        out = []
        for row in mine.to_pylist():
            q, bounds, seen = _read(row, space)
            limit = np.empty(len(q))
            for part in np.array_split(np.arange(len(q)), max(1, len(q) // 16)):
                limit[part] = np.minimum(_horizon(_gaps(q[part], space), step), _radius(q[part], bounds[part], space.m2))
            best: list[list] = [[] for _ in q]
            compared = 0
            for pivot, lo, hi, x, ids in held:
                reach = _reach(q, space.pivots[pivot : pivot + 1], space.m2)[:, 0]
                gap = np.maximum(0, np.maximum(reach - hi, lo - reach))
                todo = np.flatnonzero((gap > seen) & (gap <= limit))
                if not len(todo):
                    continue
                compared += len(todo) * len(x)
                for i, scores in zip(todo.tolist(), _products(q[todo], x), strict=True):
                    good = np.flatnonzero(scores >= bounds[i])
                    if len(good) > k + 1:  # further entries can't bring one of the first k + 1 ids, ties aside
                        cut = np.partition(scores[good], len(good) - k - 1)[len(good) - k - 1]
                        good = good[scores[good] >= cut]
                    best[i] = _leading(best[i] + [(int(scores[j]), *pair) for j in good.tolist() for pair in ids[j].tolist()], k)
            out.append({"chunk": row["chunk"], "best": [np.array(b, np.int64).tobytes() for b in best], "compared": compared})
        return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("best", pa.list_(pa.binary())), ("compared", pa.int64())]))

    def merge(key: tuple, mine: pa.Table, news: pa.Table) -> pa.Table:
        space = sent.value
        (row,) = mine.to_pylist()
        q, bounds, seen = _read(row, space)
        best = [list(map(tuple, np.frombuffer(f, np.int64).reshape(-1, 3).tolist())) for f in row["found"]]
        for found in news["best"] if len(news) else ():
            for i, b in enumerate(found.as_py()):
                if b:
                    best[i] = _leading(best[i] + list(map(tuple, np.frombuffer(b, np.int64).reshape(-1, 3).tolist())), k)
        limit, left = np.empty(len(q)), np.empty(len(q), bool)
        bounds = np.array([float(b[-1][0]) if len({i for _, i, _ in b}) > k else -np.inf for b in best])
        radius = _radius(q, bounds, space.m2)
        for part in np.array_split(np.arange(len(q)), max(1, len(q) // 16)):
            gaps = _gaps(q[part], space)
            limit[part] = _horizon(gaps, step)
            left[part] = ((gaps > limit[part, None]) & (gaps <= radius[part, None])).any(1)
        done = _chunk_row(row["keys"], q, bounds, np.where(left, limit, np.inf), [np.array(b, np.int64).tobytes() for b in best], row["compared"] + sum(news["compared"].to_pylist()), bool(left.any()))
        return pa.Table.from_pylist([done | {"chunk": row["chunk"]}], _CHUNK_ARROW.append(pa.field("chunk", pa.int64())))

    asking = chunks.where("open")
    pairs = asking.mapInArrow(plan, "chunk long, btile long").withColumn("ctile", F.expr(f"chunk div {TILE}"))
    tiles = written(pairs, "tiles")
    mine = tiles.join(asking.select("chunk", "keys", "qs", "bounds", "seen"), "chunk")
    names = tiles.select(F.col("ctile").alias("of_chunks"), F.col("btile").alias("of_blocks")).distinct()
    theirs = names.join(blocks.withColumn("of_blocks", F.expr(f"block div {TILE}")), "of_blocks")
    told = mine.groupBy("ctile", "btile").cogroup(theirs.groupBy("of_chunks", "of_blocks")).applyInArrow(score, "chunk long, best array<binary>, compared long")
    merged = asking.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(merge, f"{_CHUNK}, chunk long")
    return written(merged.unionByName(chunks.where("NOT open")), "chunks")


def explored(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = K, n_pivots: int | None = None, block: int | None = None, chunk: int = CHUNK, vector: str = "embedding") -> tuple[DataFrame, DataFrame, int] | None:
    """Chunks after all rounds, the queries (query_id, key), and the number of entries; None without a vector."""
    spark = vectors.sparkSession
    ints = written(integers(vectors, vector).withColumn("key", F.sha2("v", 256)), "integers")
    m2, d, top = ints.agg(F.max("norm2"), F.max("d"), F.max("top")).first()
    if m2 is None:
        return None
    found = written(entries(ints, k), "entries")
    n = found.count()
    n_pivots = n_pivots or min(MAX_PIVOTS, math.ceil(math.sqrt(n)))
    block = block or min(MAX_BLOCK, max(MIN_BLOCK, math.ceil(math.sqrt(n))))
    sample = found.orderBy("key").select("v").limit(n_pivots).collect()  # as many rows as pivots
    space = Space(_matrix([bytes(r["v"]) for r in sample], max(1, int(d))), float(m2), "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8")
    placed, blocks = build_index(found, space, block)
    places = blocks.select("block", "pivot", "lo", "hi").collect()  # about n / block + pivots rows of 28 bytes
    space.block, space.pivot = (np.array([r[i] for r in places], np.int64) for i in (0, 1))
    space.lo, space.hi = (np.array([r[i] for r in places], np.float64) for i in (2, 3))
    queries = ints.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "key")
    chunks = chunks_of(placed.join(queries.select("key").distinct(), "key", "left_semi").select("pivot", "distance", "key", "v"), chunk)
    sent = spark.sparkContext.broadcast(space)
    for step in (*STEPS, None):
        if chunks.where("open").isEmpty():
            break
        chunks = expand(chunks, blocks, sent, k, step)
    return chunks, queries, n


def search(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = K, **parameters) -> DataFrame:
    """The k best rows for each query: query_id, rank, vec_id, score. ``is_query`` tests the column of ids."""
    known = explored(vectors, is_query, k, **parameters)
    if known is None:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    chunks, queries, _ = known

    def unpacked(batches):
        for batch in batches:
            for keys, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.binary())], names=["key", "found"])

    def ranked(batches):
        for batch in batches:
            rows = []
            for query, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                others = [(i, s) for s, i, times in np.frombuffer(found, np.int64).reshape(-1, 3).tolist() if i != query for _ in range(times)]
                rows += [(query, n + 1, i, s) for n, (i, s) in enumerate(others[:k])]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])

    answers = chunks.select("keys", "found").mapInArrow(unpacked, "key string, found binary")
    return queries.join(answers, "key").select("query_id", "found").mapInArrow(ranked, _RESULT)


def pruned_share(vectors: DataFrame, is_query: Callable[[Column], Column], **parameters) -> float:
    """The share of (distinct query, distinct vector) pairs that the bounds spare."""
    chunks, _, n = explored(vectors, is_query, **parameters)
    compared, asked = chunks.agg(F.sum("compared"), F.sum(F.size("keys"))).first()
    return 1 - compared / (n * asked)


def _every_fiftieth(ids: Column) -> Column:
    return ids % 50 == 0


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every embedding whose id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings"), _every_fiftieth)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
