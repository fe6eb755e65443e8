"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities, counts and the densest stretch of words from two learned lexicons (words and word beginnings
that are far more frequent in toxic training texts), their nearness to second-person words, shares of capitals,
exclamation and question marks, symbols, letters doubled or replaced to obfuscate words, and lexicon words that
appear only once such obfuscation is undone. Each training row's features come from lexicons
learned on other folds. Trees are fitted on three folds by Newton steps on the logistic loss; the fourth fits the
calibration (pool adjacent violators).

Labels are read only from rows whose crc32(doc_id) mod 5 is not 0, and of those at most ``MAX_LABELLED``, those with
the smallest hash of their id. labels, lang, source and doc_id are never inputs of a score.

Defined cases: a null or empty text is scored like any text, from features that are all 0; without labelled rows of
both kinds every score is the share of label 1 (0 without rows); repeated rows are scored each; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import crc_mod, labelled_sample, map_rows, table

MAX_LABELLED, LEXICON, STARTS = 5000, 400, (4, 5)
FOLDS = 4
HELD_OUT = 5
WINDOW = 20  # words of a stretch
YOU = frozenset("you your yours yourself youre u ur du dich dir dein deine deiner euch ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros".split())
#: Characters that stand for letters in obfuscated words.
PLAIN = str.maketrans("013457@$!€£", "oieastasiel")
_WORDS = re.compile(r"\w[\w'@$!€£*.\-]*")
_EDGE = ".!*-'"
_DOUBLED = re.compile(r"(.)\1{2,}")
_INNER = re.compile(r"[*.\-_']+")
FEATURES = 16


def words_of(text: str) -> list[str]:
    """Words in lower case; marks inside a word stay, those at its end go."""
    return [w.rstrip(_EDGE) or w for w in _WORDS.findall(text.lower())]


def undone(word: str) -> str:
    """A word without the usual obfuscation."""
    return _DOUBLED.sub(r"\1", _INNER.sub("", word.translate(PLAIN)))


def learn_lexicons(samples: list[tuple[str, int]], size: int = LEXICON) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings by how much likelier they make label 1, from document frequencies."""
    toxic = sum(y for _, y in samples)
    clean = len(samples) - toxic
    found = []
    for view in (lambda w: (w,), lambda w: [w[:k] for k in STARTS if len(w) > k]):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in samples:
            seen[y].update({v for w in set(words_of(text)) for v in view(w)})
        odds = {
            w: float(np.log((n + 0.5) / (toxic + 1)) - np.log((seen[0][w] + 0.5) / (clean + 1)))
            for w, n in seen[1].items()
            if n >= 4
        }
        best = sorted((w for w in odds if odds[w] > 2.5), key=lambda w: (-odds[w] * np.log1p(seen[1][w]), w))[:size]
        found.append({w: odds[w] for w in best})
    return found[0], found[1]


def _start(word: str, lexicon: dict[str, float]) -> float | None:
    """The value of a word's longest known beginning."""
    return next((lexicon[word[:k]] for k in reversed(STARTS) if len(word) > k and word[:k] in lexicon), None)


def features(text: str | None, words_lexicon: dict[str, float], starts_lexicon: dict[str, float]) -> list[float]:
    """The dense features of a text."""
    text = text or ""
    words = words_of(text)
    n, chars = len(words) or 1, len(text) or 1
    hits, weight, starts, start_weight, hidden, near = [], 0.0, 0, 0.0, 0, 0
    odd = 0
    for i, w in enumerate(words):
        value = words_lexicon.get(w)
        start = _start(w, starts_lexicon)
        if value is not None:
            weight += value
            hits.append(i)
        elif start is not None:
            hits.append(i)
        if start is not None:
            starts += 1
            start_weight += start
        if value is None and start is None and not w.isalpha():
            odd += 1
            plain = undone(w)
            if plain != w and (plain in words_lexicon or _start(plain, starts_lexicon) is not None):
                hidden += 1
                hits.append(i)
    densest = j = 0
    for i, at in enumerate(hits):
        while at - hits[j] >= WINDOW:
            j += 1
        densest = max(densest, i - j + 1)
    if hits:
        near = sum(1 for at in hits if not YOU.isdisjoint(words[max(0, at - 4) : at + 5]))
    upper = sum(map(str.isupper, text.split()))
    return [
        len(hits), len(hits) / n, weight, weight / n, starts, start_weight / n, densest, near, near / (len(hits) or 1),
        hidden, odd / n, upper / n, text.count("!") / n, text.count("?") / n, sum(map(text.count, "#*$%&@")) / chars, float(np.log1p(n)),
    ]


class Trees:
    """Gradient-boosted trees on binned features, logistic loss."""

    def __init__(self, trees: list, base: float):
        self.trees, self.base = trees, base

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        edges = [np.unique(np.concatenate([e, [0.0]])) for e in edges]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        base = float(np.log(p / (1 - p)))
        raw, trees = np.full(len(y), base), []
        for _ in range(rounds):
            prob = 1 / (1 + np.exp(-raw))
            grad, hess = y - prob, np.maximum(prob * (1 - prob), 1e-9)
            tree: list = []

            def grow(rows: np.ndarray, level: int, tree=tree, grad=grad, hess=hess) -> int:
                g, h = grad[rows].sum(), hess[rows].sum()
                best = (1e-6, -1, -1)
                if level < depth and len(rows) > 1:
                    for f, e in enumerate(edges):
                        gs = np.bincount(binned[rows, f], grad[rows], len(e) + 1).cumsum()[:-1]
                        hs = np.bincount(binned[rows, f], hess[rows], len(e) + 1).cumsum()[:-1]
                        gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g * g / (h + ridge)
                        gain[(hs * 4 < 0.05 * least) | ((h - hs) * 4 < 0.05 * least)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (float(gain.max()), f, int(gain.argmax()))
                at = len(tree)
                tree.append(None)
                if best[1] < 0:
                    value = rate * float(g / (h + ridge))
                    raw[rows] += value
                    tree[at] = (-1, value, 0, 0)
                else:
                    _, f, b = best
                    left = binned[rows, f] <= b
                    tree[at] = (f, float(edges[f][b]), grow(rows[left], level + 1), grow(rows[~left], level + 1))
                return at

            grow(np.arange(len(y)), 0)
            trees.append(tree)
        return Trees(trees, base)

    def raw(self, row: list[float]) -> float:
        """Log-odds of a row of features."""
        total = self.base
        for tree in self.trees:
            f, value, left, right = tree[0]
            while f >= 0:
                f, value, left, right = tree[left if row[f] <= value else right]
            total += value
        return total


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: knots and their values; a prior of one row of each kind at the ends keeps scores off
    0 and 1 and the map growing with the raw score where only one kind is found."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, sum of raw
    for r, t in zip(raw[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, s = blocks.pop()
            a, b, c = blocks[-1]
            blocks[-1] = [(a * b + m * w) / (b + w), b + w, c + s]
    return [s / w for _, w, s in blocks], [(m * w + 0.5 * (0.02 + 0.96 * (m >= 0.5))) / (w + 0.5) for m, w, _ in blocks]


class Scorer:
    """Everything that is fitted: lexicons, trees and calibration."""

    def __init__(self, samples: list[tuple[str, int]]):
        self.share = sum(y for _, y in samples) / len(samples) if samples else 0.0
        self.ready = 0 < self.share < 1
        if not self.ready:
            return
        # A row's features come from lexicons of the other folds, so that trees see lexicons as they act on new texts.
        rows: list[tuple[list[float], float, bool]] = []
        for fold in range(FOLDS):
            lexicons = learn_lexicons([s for i, s in enumerate(samples) if i % FOLDS != fold])
            rows += [(features(t, *lexicons), float(y), fold == 0) for t, y in samples[fold::FOLDS]]
        self.lexicons = learn_lexicons(samples)
        x, cal = (np.array([f for f, _, first in rows if first == part] or np.zeros((0, FEATURES))) for part in (False, True))
        y, y_cal = (np.array([v for _, v, first in rows if first == part]) for part in (False, True))
        if len(set(y)) < 2 or len(set(y_cal)) < 2:
            self.ready = False
            return
        self.trees = Trees.fit(x, y)
        knots, values = isotonic(np.array([self.trees.raw(r) for r in cal.tolist()]), y_cal)
        self.knots, self.values = np.array(knots), np.maximum.accumulate(values)

    def __call__(self, text: str | None) -> float:
        if not self.ready:
            return float(self.share)
        raw = self.trees.raw(features(text, *self.lexicons))
        return float(np.clip(np.interp(raw, self.knots, self.values), 0.0, 1.0))


def fit_scorer(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Scorer:
    """A scorer from the labelled rows outside the held-out part."""
    return Scorer(labelled_sample(docs, labels.where(crc_mod(F.col("doc_id"), HELD_OUT) != 0), "toxic", max_labelled))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per document: doc_id, score and the verdict at 0.5."""
    scorer = fit_scorer(docs, labels, max_labelled)

    def row(doc_id, text):
        score = scorer(text)
        yield doc_id, score, int(score >= 0.5)

    return map_rows(docs.select("doc_id", "text"), "doc_id long, score double, predicted int", lambda: row)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), HELD_OUT) == 0).alias("held_out"), "score", "predicted")
