"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line with a word gives a handful of binary features (length, shape of its words, symbols, repetition, where it
stands, whether sampled texts share it). The field is fitted on at most ``MAX_LABELLED`` labelled documents (those with
the smallest hash of their id) and ``MAX_LINES`` of their lines, whole documents only. ``labels.quality`` speaks of
documents, so lines' labels are latent: see ``fit_field``. Viterbi decoding then labels the lines of every whole
document, and a document is kept if lines marked content hold at least ``MIN_SHARE`` of its characters and the base
rule doesn't fail it (under 50 words, or more than half of its words inside 3-word windows that recur).

Defined cases: a null or empty text has no words, fails the base rule and is not kept; without labelled rows of both
kinds every line is content and the base rule alone decides; repeated rows are judged each for itself; extra columns
pass through ``quality_filter``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import LOWER, UPPER, WHITE, labelled_sample, map_rows, table

MAX_LABELLED, MAX_LINES, MIN_SHARE, MIN_WORDS = 2000, 100_000, 0.5, 50
SHARED = 3  # labelled texts that hold a shared line
SYMBOLS = "#*$%&|<>"
CHUNK = 16  # lines in a training sequence
_LENGTHS, _SHARES = (1, 2, 4, 8, 16, 32, 64), (0.0, 0.05, 0.2, 0.5, 0.8)
#: Feature groups, in order, with their sizes.
_GROUPS = {"words": 8, "caps": 6, "symbols": 6, "marks": 6, "alpha": 6, "repeats": 6, "distinct": 6, "mean": 8, "end": 2, "seen": 2, "edge": 3, "shared": 2}
_OFFSETS = dict(zip(_GROUPS, np.cumsum([0, *_GROUPS.values()][:-1]).tolist(), strict=True))
N_FEATURES = sum(_GROUPS.values())
_LOWERED = str.maketrans(UPPER, LOWER)


def _bucket(x: float, bounds: tuple) -> int:
    for i, b in enumerate(bounds):
        if x <= b:
            return i
    return len(bounds)


def repeat_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    if n < 20_000:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) == n:
            return 0
        counts = Counter(windows)
        hit = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    else:  # long texts: numbers instead of tuples
        number: dict = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n + 2)
        _, pair = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)
        _, inverse, counts = np.unique(pair * len(number) + ids[2:], return_inverse=True, return_counts=True)
        hit = counts[inverse] > 1
    covered = np.zeros(n + 2, bool)
    for shift in range(3):
        covered[shift : n + shift] |= hit
    return int(covered.sum())


def base_features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # of bytes: splits at ASCII white space only
    lines = text.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dup += bool(line.strip(WHITE))
            else:
                seen.add(line)
    return len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words)


def line_key(line: str) -> int:
    """A hash of a line, the same for lines that differ in white space at their ends or in the case of A-Z."""
    return xxhash.xxh3_64_intdigest(line.strip(WHITE).translate(_LOWERED))


def line_features(line: str, seen: set[str], nth: int, last: bool, shared: bool) -> list[int]:
    """Numbers of the features that a line has, one of each group."""
    words = line.split()
    n = len(words)
    chars = len(line)
    o = _OFFSETS
    found = [
        o["words"] + _bucket(n, _LENGTHS),
        o["caps"] + _bucket(sum(map(str.isupper, words)) / n, _SHARES),
        o["symbols"] + _bucket(sum(map(line.count, SYMBOLS)) / n, _SHARES),
        o["marks"] + _bucket((line.count("!") + line.count("?")) / n, _SHARES),
        o["alpha"] + _bucket(sum(map(str.isalpha, words)) / n, _SHARES),
        o["repeats"] + _bucket(sum(map(str.__eq__, words, words[1:])) / n, _SHARES),
        o["distinct"] + _bucket(len(set(words)) / n, _SHARES),
        o["mean"] + _bucket(chars / n, (2, 4, 5, 6, 7, 9, 12)),
        o["end"] + (words[-1][-1] in ".!?…:;\"'»”"),
        o["seen"] + (line in seen),
        o["edge"] + (0 if nth == 0 else 1 if last else 2),
        o["shared"] + shared,
    ]
    seen.add(line)
    return found


def featured_lines(text: str | None, shared: frozenset[int] = frozenset()) -> tuple[list[list[int]], list[int], list[int]]:
    """Features, lengths and keys of the lines with a word."""
    lines = [x for x in (text or "").split("\n") if x.split()]
    seen: set[str] = set()
    keys = [line_key(x) for x in lines]
    return [line_features(x, seen, i, i == len(lines) - 1, k in shared) for i, (x, k) in enumerate(zip(lines, keys, strict=True))], [len(x) for x in lines], keys


def shared_lines(texts: list[str]) -> frozenset[int]:
    """Hashes of the keys of lines that ``SHARED`` or more of the texts hold: passages that sites repeat. Texts that share
    more than half of a text's lines are copies of it, and each counts as its part of the group only, so that lines of
    copied documents aren't taken for shared ones."""
    held = [list({line_key(x) for x in text.split("\n") if x.split()}) for text in texts]
    found: dict[int, list[int]] = {}
    for n, keys in enumerate(held):
        for key in keys:
            found.setdefault(key, []).append(n)
    holders = {key: np.array(at) for key, at in found.items() if len(at) >= SHARED}
    part = np.ones(len(texts))
    for n, keys in enumerate(held):
        common = [holders[k] for k in keys if k in holders]
        if common:
            part[n] = 1 / max(1, (2 * np.bincount(np.concatenate(common)) > len(keys)).sum())
    return frozenset(k for k, at in holders.items() if part[at].sum() >= SHARED)


def _sequences(samples: list[tuple[str, int]], shared: frozenset[int], max_lines: int) -> list[tuple[list, list, int, list]]:
    """Features, lengths, label and sharedness of the samples' lines, whole texts up to ``max_lines`` lines together."""
    found, n_lines = [], 0
    for text, y in samples:
        features, sizes, keys = featured_lines(text, shared)
        if features and n_lines + len(features) <= max_lines:
            n_lines += len(features)
            found.append((features, sizes, y, [k in shared for k in keys]))
    return found


class Field(NamedTuple):
    """What is fitted: emission weights (features x 2), weights of moves (2 x 2; 1 is content), lines that texts share."""

    emit: list[list[float]]
    move: list[list[float]]
    shared: frozenset[int]


def fit_field(samples: list[tuple[str, int]], rounds: int = 3, max_lines: int = MAX_LINES) -> Field:
    """Fit the field to lines whose labels are latent.

    At first the lines of documents of quality 1 are content but for those that texts share, and those of the other
    documents boilerplate. The field is fitted to these labels, and then in turn relabels lines by Viterbi decoding:
    a document of quality 1 takes the new labels where content keeps ``MIN_SHARE`` of it, one of quality 0 where it
    doesn't; shared lines stay boilerplate. So clean lines in rejected documents, and menus in good ones, get labels of
    their own."""
    shared = shared_lines([t for t, _ in samples])
    lines = _sequences(samples, shared, max_lines)
    if len({y for _, _, y, _ in lines}) < 2:
        return Field(np.zeros((N_FEATURES, 2)).tolist(), np.zeros((2, 2)).tolist(), shared)
    first = [[int(y and not s) for s in common] for _, _, y, common in lines]
    targets = first
    for nth in range(rounds):
        emit, move = fit_crf([f for f, *_ in lines], targets, [y for _, _, y, _ in lines])
        if nth + 1 == rounds:
            break
        targets = []
        for (features, sizes, y, common), start in zip(lines, first, strict=True):
            marked = [int(m and not s) for m, s in zip(viterbi(features, emit, move), common, strict=True)]
            targets.append(marked if (content_share(marked, sizes) >= MIN_SHARE) == bool(y) else start)
    return Field(emit, move, shared)


def fit_crf(lines: list[list[list[int]]], targets: list[list[int]], kinds: list[int], steps: int = 120) -> tuple[list, list]:
    """Emission and transition weights by Adam on the log likelihood of the lines' labels; documents of both kinds count
    alike. Long documents are fitted in chunks of ``CHUNK`` lines."""
    emit, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    chunks = [(f[i : i + CHUNK], y[i : i + CHUNK], kind) for f, y, kind in zip(lines, targets, kinds, strict=True) for i in range(0, len(f), CHUNK)]
    n = len(chunks)
    found = np.zeros((n, CHUNK, len(_GROUPS)), np.int64)
    real = np.zeros((n, CHUNK), bool)
    gold = np.zeros((n, CHUNK, 2))
    for c, (features, labels, _) in enumerate(chunks):
        found[c, : len(features)] = features
        real[c, : len(features)] = True
        gold[c, range(len(labels)), labels] = 1
    kind = np.array([k for *_, k in chunks])
    weight = np.where(kind == 1, 0.5 / max(1, (kind == 1).sum()), 0.5 / max(1, (kind == 0).sum())) * n
    mask = real.astype(np.float64)
    follow = mask[:, 1:] * weight[:, None]
    gold_moves = np.einsum("cti,ctj,ct->ij", gold[:, :-1], gold[:, 1:], follow)
    flat = found.reshape(-1, len(_GROUPS))
    m = [np.zeros_like(emit), np.zeros_like(move)]
    v = [np.zeros_like(emit), np.zeros_like(move)]
    for step in range(1, steps + 1):
        scores = emit[flat].sum(1).reshape(n, CHUNK, 2) * mask[..., None]
        ahead, back = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, CHUNK):
            moved = np.logaddexp(ahead[:, t - 1, 0, None] + move[0], ahead[:, t - 1, 1, None] + move[1]) + scores[:, t]
            ahead[:, t] = np.where(real[:, t, None], moved, ahead[:, t - 1])
        for t in range(CHUNK - 2, -1, -1):
            coming = scores[:, t + 1] + back[:, t + 1]
            moved = np.logaddexp(move[:, 0] + coming[:, 0, None], move[:, 1] + coming[:, 1, None])
            back[:, t] = np.where(real[:, t + 1, None], moved, back[:, t + 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        state = np.exp(ahead + back - total[:, None, None]) * mask[..., None]
        edge = np.exp(ahead[:, :-1, :, None] + move + (scores + back)[:, 1:, None, :] - total[:, None, None, None]) * follow[..., None, None]
        off = ((gold - state) * weight[:, None, None]).reshape(-1, 2)
        pull = np.stack([np.bincount(flat.ravel(), np.repeat(off[:, y], len(_GROUPS)), N_FEATURES) for y in (0, 1)], 1)
        grads = [pull / n - 1e-3 * emit, (gold_moves - edge.sum((0, 1))) / n - 1e-2 * move]
        for w, g, a, b in zip((emit, move), grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w += 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return emit.tolist(), move.tolist()


def viterbi(features: list[list[int]], emit: list[list[float]], move: list[list[float]]) -> list[int]:
    """The best label of each line; content wins ties."""
    if not features:
        return []
    back = []
    bad = good = 0.0
    for i, found in enumerate(features):
        e0, e1 = sum([emit[f][0] for f in found]), sum([emit[f][1] for f in found])
        if i:
            to_bad, to_good = (bad + move[0][0], good + move[1][0]), (bad + move[0][1], good + move[1][1])
            back.append((int(to_bad[1] >= to_bad[0]), int(to_good[1] >= to_good[0])))
            bad, good = max(to_bad) + e0, max(to_good) + e1
        else:
            bad, good = e0, e1
    label = int(good >= bad)
    labels = [label]
    for step in reversed(back):
        label = step[label]
        labels.append(label)
    return labels[::-1]


def content_share(marked: list[int], sizes: list[int]) -> float:
    """The share of characters in lines marked content."""
    return sum(s for s, y in zip(sizes, marked, strict=True) if y) / (sum(sizes) or 1)


def _verdict(text: str | None, field: Field, min_share: float) -> tuple:
    n_words, word_chars, n_symbols, n_dup, n_repeat = base_features(text)
    failed = n_words < MIN_WORDS or 100 * n_repeat > 50 * n_words
    features, sizes, _ = featured_lines(text, field.shared)
    marked = viterbi(features, field.emit, field.move)
    share = content_share(marked, sizes)
    return n_words, word_chars, n_symbols, n_dup, n_repeat, failed, not failed and share >= min_share, sum(marked), share


def fitted(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Field:
    """The field of the labelled documents."""
    return fit_field(labelled_sample(docs, labels, "quality", max_labelled))


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, min_share: float = MIN_SHARE) -> DataFrame:
    """Per document: base features, base verdict, verdict, number of content lines and content share."""
    field = fitted(docs, labels, max_labelled)
    return map_rows(
        docs.select("doc_id", "text"),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " base_failed boolean, kept boolean, n_content_lines long, content_share double",
        lambda: lambda doc_id, text: ((doc_id, *_verdict(text, field, min_share)),),
    )


def quality_filter(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents, same columns, that the rules keep; no shuffle."""
    field = fitted(docs, labels, max_labelled)

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        return pa.array([_verdict(t.as_py(), field, min_share)[6] for t in texts], pa.bool_())

    return docs.where(kept(F.col("text")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
