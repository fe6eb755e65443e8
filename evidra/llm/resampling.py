"""Resampling documents by importance towards a target distribution.

Features of a text are its runs of ``words`` consecutive words, hashed into ``BUCKETS`` buckets by crc32. Buckets are
counted over all documents and over the target's texts; the logarithm of the two shares' ratio is a bucket's gain, one
array of ``BUCKETS`` whole numbers that every task gets. A document's weight is the sum of its features' gains, looked up
in that array; Gumbel noise that depends on doc_id alone makes the highest scores a draw without replacement.

The draw is a merge of sorted runs. Each partition sorts its eligible keys (score down, doc_id up, then a row number, so
keys are unique) into a run, cut into blocks of ``BLOCK`` keys. Up to ``RANGES`` ranges of keys, whose ends come from a
sample of the blocks' heads, are counted; running sums tell each range the rank it starts with, and ranges that start
beyond the draw are neither sent nor merged: the draw count is exact, and the merge stops at it. A task gets its range's blocks in the order of their
heads and merges runs with a tournament tree; a block enters when the merge comes to its head and leaves when it is used
up, so it holds at most one open block of a run. Ranges are cut by whole keys, so ties of scores don't make one large.

Words of a text are cut once: their buckets are stored as two bytes each and read again for the weights.

Defined cases: a null text has no words, no features and weight 0; a null doc_id is hashed as the empty text and comes
first among equal scores; repeated rows are documents of their own; empty tables give no gains but those of add-one
smoothing, and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import LOWER, UPPER, map_rows, table, written

BUCKETS, WORDS, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
BLOCK, RANGES, OVER = 4096, 1024, 16  # OVER: heads that are looked at for each range
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FOLD = str.maketrans(UPPER, LOWER)
_KEY = np.dtype([("score", "<i8"), ("doc", "<i8"), ("row", "<i8")])
_NO_DOC = -(2**63)


class Buckets(dict):
    """Buckets of features, kept up to a bound."""

    def __init__(self, n: int, kept: int = 500_000):
        super().__init__()
        self.n, self.kept = n, kept

    def __missing__(self, feature: str) -> int:
        if len(self) >= self.kept:
            self.clear()
        found = self[feature] = zlib.crc32(feature.encode()) % self.n
        return found


def features(text: str | None, words: int = WORDS) -> tuple[int, list[str]]:
    """Number of words of a text, and its features."""
    found = _WORD.findall((text or "").translate(_FOLD) if text and not text.isascii() else (text or "").lower())
    return len(found), found if words == 1 else [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)]


def bucketed(docs: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """Per row: doc_id, number of words, number of features, and their buckets as two-byte numbers."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets are stored in two bytes")

    def factory():
        known = Buckets(buckets)

        def row(doc_id, text):
            n, found = features(text, words)
            yield doc_id, n, len(found), np.array([known[f] for f in found], "<u2").tobytes()

        row.finish = known.clear
        return row

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_words long, n_features long, buckets binary", factory)


def bucket_counts(marked: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket; tasks add up their own, the driver gets one row a bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in batch.column(0):
                total += np.bincount(np.frombuffer(part.as_py(), "<u2"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in marked.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of each bucket's smoothed share in the target over that in the source."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """Whole thousandths of a Gumbel variate that depends on the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(marked: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight and score."""
    sent = marked.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def factory():
        array = sent.value

        def row(doc_id, n_words, n_features, buckets):
            weight = int(array[np.frombuffer(buckets, "<u2")].sum())
            yield doc_id, n_words, n_features, weight, weight + noise(doc_id, seed)

        return row

    return map_rows(marked.select("doc_id", "n_words", "n_features", "buckets"), "doc_id long, n_words long, n_features long, weight long, score long", factory)


class Tournament:
    """A tree of matches between runs' current keys: each inner place holds the run that lost there, the root the winner.

    Runs come and go; their number is doubled when all places are taken. A key is a tuple, the smallest wins."""

    _LAST = (math.inf,)

    def __init__(self, places: int = 8):
        self.places = places
        self.keys: list[tuple] = [self._LAST] * places
        self.free = list(range(places))
        self.losers = [0] * places
        self._build()

    def _build(self) -> None:
        winners = [0] * self.places + list(range(self.places))
        for node in range(self.places - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.keys[a] <= self.keys[b] else (b, a)
        self.winner = winners[1]

    def enter(self, key: tuple) -> int:
        """A place for a run whose current key this is."""
        if not self.free:
            self.free = list(range(self.places, 2 * self.places))
            self.keys += [self._LAST] * self.places
            self.losers += [0] * self.places
            self.places *= 2
            self._build()
        place = self.free.pop()
        self.keys[place] = key
        self._build()  # once a block
        return place

    def replay(self) -> None:
        """Play the winner's matches again after its key has changed."""
        best, node, keys, losers = self.winner, (self.winner + self.places) >> 1, self.keys, self.losers
        while node:
            if keys[losers[node]] < keys[best]:
                best, losers[node] = losers[node], best
            node >>= 1
        self.winner = best

    def put(self, key: tuple | None) -> None:
        """The winner's next key; None if its run has ended."""
        if key is None:
            self.free.append(self.winner)
        self.keys[self.winner] = self._LAST if key is None else key
        self.replay()


def merged_runs(blocks: Iterable[tuple[tuple, Iterator[tuple]]]) -> Iterator[tuple]:
    """Keys of sorted blocks in order. Blocks come as (head, keys) by rising heads; each is opened when it is needed."""
    tree, open_, blocks = Tournament(), {}, iter(blocks)
    coming = next(blocks, None)
    while coming is not None or open_:
        while coming is not None and (not open_ or coming[0] <= tree.keys[tree.winner]):
            keys = iter(coming[1])
            place = tree.enter(next(keys))
            open_[place] = keys
            coming = next(blocks, None)
        yield tree.keys[tree.winner]
        place = tree.winner
        following = next(open_[place], None)
        if following is None:
            del open_[place]
        tree.put(following)


def runs(keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sorted runs of the partitions (score, doc, row), in blocks: head score, doc and row, number of keys, and the keys."""

    def pack(batches):
        held = np.zeros(0, _KEY)

        def out(part):
            head = part[0]
            columns = [[int(head["score"])], [int(head["doc"])], [int(head["row"])], [len(part)], [part.tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["score", "doc", "row", "n", "keys"])

        for batch in batches:
            more = np.zeros(batch.num_rows, _KEY)
            for name, column in zip(_KEY.names, batch.columns, strict=True):
                more[name] = column.to_numpy(zero_copy_only=False)
            held = np.concatenate([held, more])
            while len(held) >= block:
                yield out(held[:block])
                held = held[block:]
        if len(held):
            yield out(held)

    ordered = keys.select("score", "doc", "row").sortWithinPartitions(F.desc("score"), "doc", "row")
    return ordered.mapInArrow(pack, "score long, doc long, row long, n long, keys binary")


def draw(keys: DataFrame, n_draws: int, block: int = BLOCK, ranges: int = RANGES) -> DataFrame:
    """The first ``n_draws`` keys (score, doc, row; highest score first, then lowest doc and row) with ranks from 1."""
    spark = keys.sparkSession
    made = written(runs(keys, block), "runs")
    sample = made.select((-F.col("score")).alias("s"), "doc", "row").orderBy(F.xxhash64("row"), "row").limit(OVER * ranges).collect()
    ends = np.sort(np.array([tuple(r) for r in sample], _KEY), order=list(_KEY.names))[::OVER]
    sent = spark.sparkContext.broadcast(ends)  # at most ``ranges`` keys

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            for (data,) in zip(*batch.columns, strict=True):
                whole = np.frombuffer(data.as_py(), _KEY)
                mine = whole.copy()
                mine["score"] = -mine["score"]
                of = np.searchsorted(sent.value, mine, side="right") - 1
                for first in np.flatnonzero(np.diff(of, prepend=-2)).tolist():
                    last = int(np.searchsorted(of, of[first], side="right"))
                    out.append((int(of[first]), int(mine[first]["score"]), int(mine[first]["doc"]), int(mine[first]["row"]), last - first, mine[first:last].tobytes()))
            kinds = [pa.int32(), *[pa.int64()] * 4, pa.binary()]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["range", "s", "doc", "row", "n", "keys"])

    pieces = written(made.select("keys").mapInArrow(cut, "range int, s long, doc long, row long, n long, keys binary"), "pieces")
    starts, ahead = {}, 0
    for r in sorted(pieces.groupBy("range").agg(F.sum("n").alias("n")).collect()):  # at most ``ranges`` rows
        if ahead >= n_draws:
            break
        starts[r["range"]] = ahead
        ahead += r["n"]

    def merge(batches):
        def arriving():
            for batch in batches:
                for row in zip(*(c for c in batch.columns), strict=True):
                    yield tuple(c.as_py() for c in row)

        out: list[tuple] = []
        rows = arriving()
        row = next(rows, None)
        while row is not None:
            of = row[0]

            def blocks(of=of):
                nonlocal row
                while row is not None and row[0] == of:
                    yield row[1:4], iter(np.frombuffer(row[4], _KEY).tolist())
                    row = next(rows, None)

            rank = starts[of]
            for key in merged_runs(blocks()):
                if rank >= n_draws:
                    break
                rank += 1
                out.append((key[2], rank))
                if len(out) >= BLOCK:
                    yield _ranks(out)
                    out = []
            while row is not None and row[0] == of:
                row = next(rows, None)
        if out:
            yield _ranks(out)

    wanted = pieces.where(F.col("range").isin(*starts)) if starts else pieces.where(F.lit(False))
    sorted_ = wanted.select("range", "s", "doc", "row", "keys").repartition("range").sortWithinPartitions("range", "s", "doc", "row")
    return sorted_.mapInArrow(merge, "row long, rank long")


def _ranks(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["row", "rank"])


def resample(docs: DataFrame, target: DataFrame, words: int = WORDS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED, block: int = BLOCK, ranges: int = RANGES) -> DataFrame:
    """Per document row: doc_id, n_features, weight, score, and its rank in the draw (null if it isn't drawn). ``target``
    holds texts of the target distribution."""
    marked = written(bucketed(docs, words, buckets), "features")
    wanted = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), words, buckets)
    gain = gains(bucket_counts(marked, buckets), bucket_counts(wanted, buckets))
    rated = written(scored(marked, gain, seed).withColumn("_ev_row", F.monotonically_increasing_id()), "scored")
    eligible = rated.where(F.col("n_words") >= min_words).select("score", F.coalesce("doc_id", F.lit(_NO_DOC)).alias("doc"), F.col("_ev_row").alias("row"))
    ranked = written(draw(eligible, percent * eligible.count() // 100, block, ranges).select(F.col("row").alias("_ev_drawn"), "rank"), "drawn")
    return rated.join(ranked, rated["_ev_row"] == ranked["_ev_drawn"], "left").select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The drawn documents, same columns. Rows are matched by doc_id, so ids must be unique."""
    ids = resample(docs, target, **parameters).where("rank IS NOT NULL").select(F.col("doc_id").alias("_ev_doc"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col("_ev_doc")), "left_semi")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by their likeness to the benchmark's texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT n::BIGINT AS n, n::BIGINT AS c, 0 AS k FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY n) AS steps FROM bits WHERE k = 8
), d AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), w AS (
  SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM d
), b AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), v AS (
  SELECT w, xor(4294967295, list_reduce(
           [4294967295] || list_transform(range(1, len(hex(w)) + 1, 2), lambda i: ('0x' || substr(hex(w), i::INTEGER, 2))::BIGINT),
           lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT w FROM w UNION SELECT w FROM b) AS every_word(w), crc
), s AS (
  SELECT bucket, count(*) AS n FROM w JOIN v USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM b JOIN v USING (w) GROUP BY bucket
), g AS (
  SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM w) + 10000))
                                  / ((s.n + 1) * ((SELECT count(*) FROM b) + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t ON s.bucket = t.bucket
), p AS (
  SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM w JOIN v USING (w) JOIN g USING (bucket) GROUP BY r
), z AS (
  SELECT d.r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN p ON d.r = p.r
), o AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS every_row FROM z WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * every_row // 100 THEN rank END AS rank
FROM z LEFT JOIN o ON z.r = o.r
"""
