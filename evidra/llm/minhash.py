"""Near-duplicate classes by DartMinHash signatures, banding and exact verification.

Signatures. A text is a weighted set: its distinct word shingles, each with the number of times it occurs. Each element
(a hashed shingle) owns the plane of weight x rank. Darts fall on it as a Poisson process whose places are drawn by
hashing, so all documents see the same darts for an element; an element of weight w catches those below weight w. Every
dart names one of K coordinates. Working through cells of rising rank, each coordinate keeps its earliest dart; the
expected work is total weight + K log K hashes, not K times as much. Two documents agree in a coordinate with the
probability of their weighted Jaccard similarity, sum of smaller counts / sum of larger counts.

Weights are whole numbers, so the region of an element is stacked from unit layers, and a weighted set is the plain set
of its layers: (shingle, 1) to (shingle, count). Jaccard similarity of layers is the weighted one, exactly.

Classes. Documents of equal words are one node. Nodes that agree in a whole band share a bucket. In each bucket all
members are compared with one leader, and what the exact similarity confirms is united; buckets that still hold several
classes get other leaders in the next round. Whatever is still apart after the rounds is compared in blocks of bounded
size, dealt anew ``MIXES`` times, and at last in all pairs of blocks, across classes, by size and signature first and by
layers then. So no link between bucket mates is lost,
and a group of near copies costs a few comparisons a member. Exact copies are counted once, before anything is shuffled
by bucket. Nodes are told apart by two 64-bit prints of their words (128 bits); their names are 56 bits of the first
and a number among those that agree in these.

Defined cases: words are cut at ASCII white space and lower-cased; a text of fewer than five words is one shingle;
a null text or one without words is a class of its own; a class is named by its smallest doc_id, null if no member has
one (``_ev_class`` tells such classes apart); rows that repeat a doc_id are rows of their own; extra columns are ignored
by ``near_duplicate_classes`` and kept by ``drop_near_duplicates``, which keeps every row without words; an empty table
gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.llm.common import WORD_RE, map_rows, table, written

K, ROWS, WORDS, SIMILARITY = 120, 5, 5, 0.8
ROUNDS, MIXES, SLACK = 2, 2, 0.17  # SLACK: 4.6 standard deviations of a signature's estimate at 0.8
BLOCK, BLOCK_BYTES = 256, 16 << 20  # nodes, and bytes of their layers, that a block holds on average
PIECE = 1 << 18  # layers looked at together
_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _levels() -> list[tuple[float, float, int, int, np.ndarray]]:
    """Cells of rank: (start, width, number of such cells, number of the first, cumulated Poisson probabilities)."""
    found, start, nth = [], 0.0, 1
    for end in (2**-6, 2**-3, 2**-1, 1.0, *(2.0**i for i in range(1, 40))):
        width = min(1.0, end - start)
        cells = round((end - start) / width)
        p = np.cumsum([math.exp(-width) * width**n / math.factorial(n) for n in range(16)])
        found.append((start, width, cells, nth, p))
        start, nth = end, nth + cells
    return found


LEVELS = _levels()


def dart_signatures(elements: np.ndarray, owners: np.ndarray, n: int, k: int = K, caught: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (n x k, 32-bit names of the earliest darts) of n sets at once, and the darts' ranks.

    elements: 64-bit hashes; owners: number of the set that holds each; caught: the weight, up to 1, that each holds (1
    if None). Sets whose coordinates are all filled leave, so later cells are looked at for small sets only."""
    signature, ranks, empty = np.zeros(n * k, np.uint32), np.full(n * k, np.inf), np.ones(n * k, bool)
    for start, width, cells, nth, p in LEVELS:
        if not len(elements):
            break
        per = max(1, (1 << 18) // len(elements))
        for first in range(0, cells, per):
            here = np.arange(first, min(cells, first + per))
            place = mixed(elements[:, None] + (_U(nth) + here.astype(_U)) * _PRIME).ravel()
            darts = np.searchsorted(p, (place >> _U(11)).astype(np.float64) * 2.0**-53, side="right")
            hit = np.flatnonzero(darts)
            n_darts = darts[hit]
            source = np.repeat(hit, n_darts)
            order = (np.arange(len(source)) - np.repeat(np.cumsum(n_darts) - n_darts, n_darts)).astype(_U)
            dart = mixed(place[source] ^ mixed(order + _PRIME))
            element, cell = source // len(here), source % len(here)
            rank = start + (cell + first) * width + (dart >> _U(32)).astype(np.float64) * (width * 2.0**-32)
            more = mixed(dart)
            slot = owners[element] * k + ((more >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)
            keep = empty[slot]
            if caught is not None:
                keep &= (mixed(more) >> _U(11)).astype(np.float64) * 2.0**-53 < caught[element]
            keep = np.flatnonzero(keep)
            keep = keep[np.argsort(-rank[keep], kind="stable")]  # the earliest is written last
            signature[slot[keep]] = (more[keep] & _U(0xFFFFFFFF)).astype(np.uint32)
            ranks[slot[keep]] = rank[keep]
            empty[slot[keep]] = False
            if first + per < cells and not empty.any():
                break
        stay = empty.reshape(n, k).any(1)[owners]
        elements, owners = elements[stay], owners[stay]
        caught = caught[stay] if caught is not None else None
    return signature.reshape(n, k), ranks.reshape(n, k)


def layered(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The unit layers of a weighted set: the elements themselves, and further ones for counts above 1."""
    if counts.max(initial=0) <= 1:
        return elements
    layer = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    spread = np.repeat(elements, counts)
    return np.where(layer == 0, spread, mixed(spread + layer.astype(_U) * _PRIME))


def dart_signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """DartMinHash signature of one set.

    elements: distinct 64-bit hashes; weights: positive, all 1 if None. Of an element's layers the last one catches only
    darts below the rest of a weight that isn't whole."""
    if weights is None:
        weights = np.ones(len(elements))
    layers = np.ceil(weights).astype(np.int64)
    layer = np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
    caught = np.minimum(1.0, np.repeat(weights, layers) - layer)
    return dart_signatures(layered(elements, layers), np.zeros(len(layer), np.int64), 1, k, caught)[0][0]


def _together(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Signatures of several sets of layers; large sets are taken in pieces, of which each coordinate keeps the earliest
    dart."""
    out = np.zeros((len(sets), k), np.uint32)
    small = [i for i, s in enumerate(sets) if len(s) <= PIECE]
    if small:
        out[small] = dart_signatures(np.concatenate([sets[i] for i in small]), np.repeat(np.arange(len(small)), [len(sets[i]) for i in small]), len(small), k)[0]
    for i in (i for i, s in enumerate(sets) if len(s) > PIECE):
        best = np.full(k, np.inf)
        for at in range(0, len(sets[i]), PIECE):
            piece = sets[i][at : at + PIECE]
            signature, ranks = dart_signatures(piece, np.zeros(len(piece), np.int64), 1, k)
            better = ranks[0] < best
            out[i, better], best[better] = signature[0, better], ranks[0, better]
    return out


class Shingler:
    """Hashed word shingles of texts; hashes of words are kept in a bounded store."""

    def __init__(self, words: int = WORDS, kept: int = 200_000):
        self.words, self.kept, self.known = words, kept, {}

    def __call__(self, text: str | None) -> tuple[int, int, np.ndarray] | None:
        """Two prints of the words, and the sorted layers of the weighted shingle set; None without words."""
        words = (text or "").lower().encode().split()
        if not words:
            return None
        known = self.known
        try:
            hashes = np.array([known[w] for w in words], _U)
        except KeyError:
            if len(known) > self.kept:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = np.array([known[w] for w in words], _U)
        joined = b" ".join(words)
        n = max(1, len(words) - self.words + 1)
        shingle = np.zeros(n, _U)
        for i in range(min(self.words, len(words))):
            shingle = shingle * _PRIME + hashes[i : i + n]
        layers = layered(*np.unique(mixed(shingle), return_counts=True))
        layers.sort()
        return xxhash.xxh3_64_intdigest(joined) - 2**63, xxhash.xxh64_intdigest(joined) - 2**63, layers


def band_hashes(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash for each band of a signature, or of several."""
    n = signature.shape[-1] // rows
    bands = signature[..., : n * rows].reshape(*signature.shape[:-1], n, rows).astype(_U)
    h = np.broadcast_to(mixed(np.arange(1, n + 1, dtype=_U) * _PRIME), bands.shape[:-1])
    for i in range(rows):
        h = mixed(h ^ bands[..., i]) + _PRIME
    return h.astype(np.int64)


def _in_groups(df: DataFrame, schema: str, factory, elements: int = 60_000) -> DataFrame:
    """Like ``map_rows`` for functions of many rows: ``factory()`` gives (prepare, finish); rows are prepared one by
    one to (row, set of hashes or None) and finished in groups of about so many hashes."""
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    arrow = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[t]) for n, t in zip(names, kinds, strict=True)])

    def run(batches):
        prepare, finish = factory()
        held, size = [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                found = prepare(*(v.as_py() for v in row))
                if found is None:
                    continue
                held.append(found)
                size += 20 + (0 if found[1] is None else len(found[1]))
                if size >= elements:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in finish(held)], arrow)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in finish(held)], arrow)

    return df.mapInArrow(run, schema)


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, comp) after uniting the components of ``links`` (a, b: component names).

    Smallest names spread over links with pointer jumping, each round a written table; the number of rounds is
    logarithmic in a component's diameter."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    names = written(both.select("a").distinct().select(F.col("a").alias("name"), F.col("a").alias("root")), "roots")
    while True:
        seen = both.join(names.select(F.col("name").alias("b"), F.col("root").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        low = names.join(seen, names["name"] == seen["a"]).select("name", "root", F.least("root", "near").alias("low"))
        up = low.select(F.col("name").alias("low"), F.col("low").alias("higher"))
        step = written(low.join(up, "low").select("name", F.least("low", "higher").alias("root"), (F.least("low", "higher") < F.col("root")).alias("moved")), "roots")
        names = step.select("name", "root")
        if step.where("moved").isEmpty():
            break
    return written(
        labels.join(names, labels["comp"] == names["name"], "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels"
    )


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, and the components ca, cb) whose sets of layers are as similar as asked."""
    need = f"cast(least(n, m) as double) >= {similarity} * greatest(n, m)"
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("layers").alias("sa"), F.col("n")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("layers").alias("sb"), F.col("n").alias("m")), "b").where(need)

    def function(ca, cb, sa, sb):
        if _similar(np.frombuffer(sa, _U), np.frombuffer(sb, _U), similarity):
            yield ca, cb

    return map_rows(with_b.select("ca", "cb", "sa", "sb"), "a long, b long", lambda: function)


def _block_links(state: DataFrame, apart: DataFrame, sets: DataFrame, similarity: float, rows: int, block: int, seed: int, across: bool) -> DataFrame:
    """Links (a, b: components) between bucket mates of different components, found in blocks of bounded size, or
    ``across`` blocks in all their pairs. Across blocks, a pair that shares several buckets is looked at in the one of its
    first common band, and a bucket of g nodes sends each of them to g / ``block`` tasks, or to one for every
    ``BLOCK_BYTES`` of its members' layers. Of the links of a task no more are told than connect what they connect."""
    in_bytes = state.join(sets.select("node", F.col("n").cast("long").alias("n")), "node").groupBy("band").agg((8 * F.sum("n")).alias("bytes"))
    sizes = apart.join(in_bytes, "band").select("band", F.ceil(F.greatest(F.col("g") / block, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = state.join(written(sizes, "block-sizes"), "band").withColumn("mine", F.pmod(F.xxhash64(F.lit(seed), "node"), "blocks").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if across else F.col("mine"))
    keyed = spread.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "comp")
    members = keyed.join(sets, "node")

    def function(key: tuple, group: pa.Table) -> pa.Table:
        comps, sizes, band = group["comp"].to_numpy(), group["n"].to_numpy(), key[0].as_py()
        signatures = np.stack([np.frombuffer(s.as_py(), np.uint32) for s in group["signature"]])
        bands = band_hashes(signatures, rows)
        layers = group["layers"]
        order = np.argsort(sizes, kind="stable")  # mates of x lie in a stretch of sizes
        comps, sizes, signatures, bands = comps[order], sizes[order], signatures[order], bands[order]
        ends = np.searchsorted(sizes, sizes / similarity + 1e-9, side="right")
        found: list[tuple[int, int]] = []
        _, names = np.unique(comps, return_inverse=True)  # what is united, by the smallest place of its components
        for x in range(len(comps) - 1):
            mates = np.flatnonzero(names[x + 1 : ends[x]] != names[x]) + x + 1
            for y in mates[(signatures[mates] == signatures[x]).mean(1) >= similarity - SLACK] if len(mates) else ():
                if names[x] == names[y] or across and bands[x][(bands[x] == bands[y]).argmax()] != band:
                    continue
                a, b = (np.frombuffer(layers[int(order[z])].as_py(), _U) for z in (x, y))
                if _similar(a, b, similarity):
                    found.append((min(int(comps[x]), int(comps[y])), max(int(comps[x]), int(comps[y]))))
                    names[names == names[y]] = names[x]
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate("ab")})

    return members.groupBy("band", "i", "j").applyInArrow(function, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets are as similar as asked."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _named(prints: DataFrame) -> DataFrame:
    """Nodes (p1, p2, ...) with exact 64-bit names: 56 bits of the first print, and in the other eight a number among
    the nodes that agree in these. Few nodes ever do, so only they are numbered and joined."""
    prefix = F.col("p1").bitwiseAND(F.lit(-256))
    alike = written(prints.groupBy(prefix.alias("prefix")).count().where("count > 1").select("prefix"), "alike")
    if alike.isEmpty():
        return prints.withColumn("node", prefix)
    among = prints.select("p1", "p2", prefix.alias("prefix")).join(alike, "prefix")
    nth = F.row_number().over(Window.partitionBy("prefix").orderBy("p1", "p2")) - 1
    sound = F.when(nth < 256, nth).otherwise(F.raise_error(F.lit("more than 256 nodes agree in 56 bits")))
    ranks = written(among.select("p1", "p2", sound.cast("long").alias("nth")), "numbers")
    return prints.join(ranks, ["p1", "p2"], "left").withColumn("node", prefix.bitwiseOR(F.coalesce("nth", F.lit(0)))).drop("nth")


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, k: int = K, rows: int = ROWS, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """Per document row: doc_id, class_id (smallest doc_id of its class), ``_ev_row``, the print of its text, and
    ``_ev_class``, its class's inner name (null without words)."""

    def mark():
        shingler = Shingler(words)

        def prepare(doc_id, text, print_):
            found = shingler(text)
            return ((doc_id, print_, None, None), None) if found is None else ((doc_id, print_, *found[:2]), found[2])

        def finish(held):
            sets = [s for _, s in held if s is not None]
            bands = iter(band_hashes(_together(sets, k), rows).tolist() if sets else ())
            return [(*row, None if s is None else next(bands)) for row, s in held]

        return prepare, finish

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_ev_row"))
    marked = written(_in_groups(texts, "doc_id long, _ev_row long, p1 long, p2 long, bands array<long>", mark), "marked")
    prints = written(marked.where("p1 IS NOT NULL").groupBy("p1", "p2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "prints")
    nodes = _named(prints)
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = written(banded.groupBy("band").count().where("count > 1").select("band"), "shared-bands")
    grouped = written(banded.join(shared, "band"), "buckets")
    needed = grouped.select("node").distinct().join(nodes.select("node", "rep", "p1", "p2"), "node")

    def sets_of():
        shingler = Shingler(words)

        def prepare(node, p1, p2, text):
            found = shingler(text)
            return (node, found[2]) if found is not None and found[:2] == (p1, p2) else None

        def finish(held):
            return [(node, len(x), x.tobytes(), y.tobytes()) for (node, x), y in zip(held, _together([s for _, s in held], k), strict=True)]

        return prepare, finish

    chosen = docs.select("doc_id", "text").join(needed, F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "p1", "p2", "text")
    sets = written(_in_groups(chosen, "node long, n int, layers binary, signature binary", sets_of).dropDuplicates(["node"]), "layer-sets")
    labels = written(needed.select("node", F.col("node").alias("comp")), "labels")

    def unite(links: DataFrame, labels: DataFrame) -> DataFrame:
        links = written(links.distinct(), "verified")
        return labels if links.isEmpty() else contracted(labels, links)

    def state_of(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Buckets that hold several components: their members, and their sizes."""
        state = grouped.join(labels, "node")
        sizes = state.groupBy("band").agg(F.count(F.lit(1)).alias("g"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        apart = written(sizes.where("lo <> hi").select("band", "g"), "apart")
        return written(grouped.join(apart.select("band"), "band").join(labels, "node"), "members"), apart

    for nth in range(rounds):
        state, apart = state_of(labels)
        if apart.isEmpty():
            break
        turn = F.xxhash64(F.lit(nth), "node")
        first = written(state.groupBy("band").agg(F.min(turn).alias("turn")), "turns")
        lead = written(state.join(first, "band").where(turn == F.col("turn")).select("band", F.col("node").alias("a"), F.col("comp").alias("ca")), "leaders")
        # Of the leaders of its buckets a node is compared with that of the lowest turn, which most of its mates share.
        meets = state.join(lead, "band").where("comp <> ca").select(F.xxhash64(F.lit(nth), "a").alias("turn"), "a", "ca", F.col("node").alias("b"), F.col("comp").alias("cb"))
        lowest = meets.groupBy("b", "cb").agg(F.min(F.struct("turn", "a", "ca")).alias("m"))
        labels = unite(_verified(lowest.select("m.a", "b", "m.ca", "cb"), sets, similarity), labels)
    # Blocks by themselves, dealt anew, connect most of what is left at a linear cost; then all pairs of blocks.
    for nth in range(MIXES + 1):
        state, apart = state_of(labels)
        if apart.isEmpty():
            break
        labels = unite(_block_links(state, apart, sets, similarity, rows, block, nth, nth == MIXES), labels)

    named = nodes.select("p1", "p2", "node", "rep").join(labels, "node", "left").select("p1", "p2", "rep", F.coalesce("comp", "node").alias("comp"))
    named = written(named, "components")
    smallest = written(named.groupBy("comp").agg(F.min("rep").alias("class_id")), "classes")
    classes = written(named.join(smallest, "comp").select(F.col("p1").alias("of1"), F.col("p2").alias("of2"), "class_id", F.col("comp").alias("_ev_class")), "node-classes")
    return marked.join(classes, (marked["p1"] == classes["of1"]) & (marked["p2"] == classes["of2"]), "left").select(
        "doc_id", F.when(F.col("p1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "_ev_row", "_ev_class"
    )


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """The documents, same columns, with one of each class: that with the smallest doc_id. Classes that share it, as a
    doc_id with different texts makes them, keep one each; rows without words all stay. Whole texts meet the list of
    what stays in one shuffle, or none where it is small enough to be sent; rows that repeat a doc_id and a text are
    found in the same partitioning."""
    kind = lambda doc, row: F.xxhash64(doc, row)
    classes = near_duplicate_classes(docs, **parameters).where("_ev_class IS NOT NULL AND doc_id <=> class_id")
    once = classes.groupBy("_ev_class").agg(F.min("class_id").alias("_ev_doc"), F.min("_ev_row").alias("_ev_print"))
    kept = written(once.select("_ev_doc", "_ev_print", kind("_ev_doc", "_ev_print").alias("_ev_kind")).distinct(), "kept")
    with_words = F.coalesce(F.rlike("text", F.lit(WORD_RE)), F.lit(False))
    rows = docs.withColumn("_ev_words", with_words).withColumn("_ev_row", F.xxhash64("text"))
    rows = rows.withColumn("_ev_nth", F.when(F.col("_ev_words"), 0).otherwise(F.monotonically_increasing_id()))
    rows = rows.withColumn("_ev_key", F.when(F.col("_ev_words"), kind("doc_id", "_ev_row")).otherwise(F.xxhash64("_ev_nth")))
    same = (rows["_ev_key"] == kept["_ev_kind"]) & rows["_ev_words"] & rows["doc_id"].eqNullSafe(kept["_ev_doc"]) & (rows["_ev_row"] == kept["_ev_print"])
    stay = rows.join(kept, same, "left").where(~F.col("_ev_words") | F.col("_ev_kind").isNotNull())
    return stay.dropDuplicates(["_ev_key", "doc_id", "_ev_row", "_ev_nth"]).select(*docs.columns)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
