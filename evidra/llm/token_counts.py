"""Exact token counts of all prefixes of a text, by dynamic programming over byte-level merges.

The encoding of a stretch that ends with byte i ends with some token; what stands before it is the encoding of the
shorter stretch. So one pass over the bytes is enough: of the vocabulary's words that end at i (an Aho-Corasick automaton
names them), just one may follow the last token of the prefix before it, which shows where the two would have met while they were
merged (results are kept by pair). Its count is the shorter prefix's plus one.

Texts are cut as the tokenizer cuts them. A prefix may be cut otherwise than the text (a run of white space gives its last
character to the word behind it only once there is one; ``'re`` is one piece, ``'r`` two; a special string is one token
only when complete), so a text is taken in units outside of which a prefix is cut like the text: a piece with the longer
white space before it, or a special string with the unit before it. Units recur: their counts are kept in a bounded
store.

Counts of all prefixes, one for each code point, are stored as differences in a compressed column. What a text costs up to
some place, where it has to end to fit into a limit, or how many texts fill a budget, is then answered from the column
without the tokenizer (``answers``, ``tokens_until``, ``packed``).

Defined cases: a null or empty text has no tokens and no bytes; special strings inside texts are their token, as the
library has it by default; rows that repeat a doc_id are counted each; extra columns are ignored; an empty table gives an
empty table. A stretch without a cut (a million letters) takes time linear in its length, and a few bytes for each.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict

import ahocorasick
import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.llm.common import map_rows, table, written

MODEL, LIMIT = "byte_bpe_50k.json", 1024
_NEVER = 1 << 60
KEPT = 64  # code points of a unit that may be kept
_SHORT = r"'(?:[sdmt]|ll|ve|re)"  # what the cut of byte-level models takes as one piece after a word


def default_model() -> str:
    """Path of the public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest follow
    from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def character_classes(model: str) -> dict[str, str]:
    """Bodies of character sets for letters (L), numbers (N) and white space (S), as the tokenizer's own cut has them.

    Versions of Unicode differ between libraries, so the cut is asked about each character that any installed table takes
    for one of the three; all others are none."""
    from tokenizers import Tokenizer

    pieces = Tokenizer.from_str(model).pre_tokenizer.pre_tokenize_str
    perhaps = regex.compile(r"[\p{L}\p{N}\s]")
    found: dict[str, list[int]] = {"L": [], "N": [], "S": []}
    for code in range(0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or not (perhaps.match(c) or unicodedata.category(c)[0] in "LN" or c.isspace()):
            continue
        if len(pieces("a" + c)) == 1:
            found["L"].append(code)
        elif len(pieces("!" + c)) > 1:
            found["N" if len(pieces("1" + c)) == 1 else "S"].append(code)
    return {k: _ranges(v) for k, v in found.items()}


def _ranges(codes: list[int]) -> str:
    out, at = [], 0
    while at < len(codes):
        end = at
        while end + 1 < len(codes) and codes[end + 1] == codes[end] + 1:
            end += 1
        out.append(f"\\U{codes[at]:08x}" + (f"-\\U{codes[end]:08x}" if end > at else ""))
        at = end + 1
    return "".join(out)


def zigzag(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, small ones as one each: sign in the lowest bit, seven bits a byte, lowest first."""
    folded = (values.astype(np.int64) << 1 ^ values.astype(np.int64) >> 63).astype(np.uint64)
    if not len(folded) or folded.max() < 128:
        return folded.astype(np.uint8).tobytes()
    out = bytearray()
    for v in folded.tolist():
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def unzigzag(data: bytes) -> np.ndarray:
    """What ``zigzag`` took."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    if raw.max() < 128:
        folded = raw.astype(np.int64)
    else:
        ends = np.flatnonzero(raw < 128)
        starts = np.concatenate([[0], ends[:-1] + 1])
        place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
        folded = np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts)
    return folded >> 1 ^ -(folded & 1)


class PrefixCounter:
    """Token counts of prefixes under one byte-level merge model."""

    def __init__(self, model: str, classes: dict[str, str], kept: int = 200_000):
        spec = json.loads(model)
        body, cut = spec["model"], spec["pre_tokenizer"]
        if body["type"] != "BPE" or body.get("dropout") or body.get("ignore_merges") or spec["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("only byte-level merge models without a normalizer are counted")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take white space with them aren't counted")
        letters = byte_alphabet()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in body["merges"]]
        self.rank = {tuple(bytes(letters[c] for c in part).decode("latin-1") for part in m): i for i, m in reversed(list(enumerate(pairs)))}
        self.made = {a + b: (i, a, b) for (a, b), i in self.rank.items()}
        if len(self.made) < len(self.rank) or any(self.made.get(part, (-1,))[0] >= i for i, a, b in self.made.values() for part in (a, b)):
            raise ValueError("a merge comes before one that it needs, or a word is made in two ways")
        self.automaton = ahocorasick.Automaton()
        for word in {chr(b) for b in range(256)} | {a + b for a, b in self.rank}:
            self.automaton.add_word(word, len(word))
        self.automaton.make_automaton()
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=lambda s: (-len(s), s))
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        s, one = f"[{classes['S']}]", [f"[{classes['L']}]", f"[{classes['N']}]", f"[^{classes['S']}{classes['L']}{classes['N']}]"]
        runs = "|".join(f"{x}+" for x in one)
        plain = "|".join([_SHORT, *(f" ?{x}+" for x in one)])
        dark = f"[{classes['S'].replace(chr(92) + 'U00000020', '')}]"  # white space that never joins a word
        self.pieces = re.compile(f"{plain}|{s}+(?!{s[0]}^{s[1:]})|{s}+").findall
        self.units = re.compile(f"{s}+(?={s}{s[0]}^{s[1:]})(?:{dark}{_SHORT}|{s}(?:{runs}))|{plain}|{s}+").findall
        self.spaced = re.compile(f"({s}+)({s}(?:{_SHORT}|{runs}))", re.S).fullmatch
        self.kept, self.young, self.old = kept, {}, {}
        self.pairs: dict[str, dict[str, bool]] = defaultdict(dict)
        self.n_pairs = 0

    def merged(self, stretch: str) -> list[str]:
        """Encoding of a short stretch by its definition: best merge first, leftmost among equals."""
        parts, rank = list(stretch), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether two tokens stay two when what they spell is merged; an empty left one asks whether the right one is a
        token by itself.

        Merges happen in the order of their ranks, so time is walked back: of the two tokens the one that was made later
        is taken apart at the seam, and a pair that would have met there before it was gone doesn't fit."""
        known = self.pairs[left].get(right)
        if known is None:
            if self.n_pairs >= 4 * self.kept:
                self.pairs.clear()
                self.n_pairs = 0
            self.n_pairs += 1
            if left:
                known = self.fits("", right) and self._apart(left, right)
            else:
                known = len(self.merged(right)) == 1
            self.pairs[left][right] = known
        return known

    def _apart(self, left: str, right: str) -> bool:
        rank, made, left_ends, right_ends = self.rank, self.made, _NEVER, _NEVER
        while True:
            meet = rank.get((left, right))
            if meet is not None and meet < left_ends and meet <= right_ends:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                left_ends, left = a[0], a[2]
            else:
                right_ends, right = b[0], b[1]

    def counts(self, piece: str) -> list[int] | np.ndarray:
        """Tokens of a piece's prefixes, one number for each code point."""
        data = piece.encode()
        stretch, n = data.decode("latin-1"), len(data)
        if n <= 4 * KEPT:
            lengths, counts = [0] * (n + 1), [0] * (n + 1)
        else:
            lengths, counts = array("H", bytes(2 * (n + 1))), array("i", bytes(4 * (n + 1)))
        pairs, settled = self.pairs, -1
        for end, length in self.automaton.iter(stretch):
            if end == settled:
                continue
            start = end + 1 - length
            left, token = stretch[start - lengths[start] : start], stretch[start : end + 1]
            fit = pairs[left].get(token)
            if self.fits(left, token) if fit is None else fit:
                lengths[end + 1], counts[end + 1] = length, counts[start] + 1
                settled = end
        if n <= 4 * KEPT:
            return counts[1:] if n == len(piece) else [counts[i] for i in range(1, n + 1) if i == n or data[i] & 0xC0 != 0x80]
        every = np.frombuffer(counts, np.int32)[1:]
        return every if n == len(piece) else every[np.append(np.flatnonzero(np.frombuffer(data, np.uint8)[1:] & 0xC0 != 0x80), n - 1)]

    def total(self, text: str) -> int:
        """Tokens of a text without special strings, cut as if it ended here."""
        return sum(int(self.counts(p)[-1]) for p in self.pieces(text))

    def _unit_counts(self, unit: str) -> list[int] | np.ndarray:
        """Counts of a unit's prefixes."""
        if len(unit) == 1 or " " < unit[0] != "'" and unit[0] <= "~":
            return self.counts(unit)
        if unit[0] == "'":
            return [self.total(unit[:i]) for i in range(1, len(unit) + 1)] if re.fullmatch(_SHORT, unit) else self.counts(unit)
        parts = self.spaced(unit)
        if parts is None:
            return self.counts(unit)
        run, rest = parts[1], parts[2]
        base = self.counts(run)[-1]
        if rest[0] == " ":
            inner = self.counts(rest)[1:]
        else:
            base += self.counts(rest[0])[-1]
            inner = self._unit_counts(rest[1:])
        return [*map(int, self.counts(run + rest[0])), *(int(base + i) for i in inner)]

    def _differences(self, unit: str) -> bytes:
        found = self.old.get(unit)
        if found is None:
            counts = self._unit_counts(unit)
            if len(unit) > KEPT:
                return zigzag(np.diff(counts, prepend=0))
            steps = [b - a for a, b in zip([0, *counts], counts, strict=False)]
            found = bytes([2 * d if d >= 0 else -2 * d - 1 for d in steps]) if -64 <= min(steps) and max(steps) < 64 else zigzag(np.array(steps))
        if len(self.young) >= self.kept:
            self.old, self.young = self.young, {}
        self.young[unit] = found
        return found

    def _plain(self, text: str) -> tuple[list[bytes], str]:
        """Differences of a text without special strings, and its last unit."""
        known, miss, out = self.young.get, self._differences, []
        units = self.units(text)
        for u in units:
            found = known(u)
            if found is None:
                found = miss(u)
                known = self.young.get
            out.append(found)
        return out, units[-1] if units else ""

    def differences(self, text: str | None) -> bytes:
        """For each code point of a whole text what it adds to the count of the prefix that it ends."""
        if not text:
            return b""
        if self.special is None:
            return b"".join(self._plain(text)[0])
        out, at = [], 0
        for found in self.special.finditer(text):
            before, last = self._plain(text[at : found.start()])
            out += before
            of_last = self.total(last)
            inside = [self.total(last + found[0][:i]) - of_last for i in range(1, len(found[0]))]
            out.append(zigzag(np.diff(np.array([0, *inside, 1]))))
            at = found.end()
        return b"".join(out + self._plain(text[at:] if at else text)[0])

    def forget(self) -> None:
        """Drop what is kept of earlier texts."""
        self.young, self.old, self.n_pairs = {}, {}, 0
        self.pairs.clear()


_counters: dict[str, PrefixCounter] = {}
_classes: dict[str, dict[str, str]] = {}


def counter(model: str, classes: dict[str, str]) -> PrefixCounter:
    """The counter of a model, built once in each Python worker."""
    if model not in _counters:
        _counters.clear()
        _counters[model] = PrefixCounter(model, classes)
    return _counters[model]


def load(path: str | None = None) -> tuple[str, dict[str, str]]:
    """A tokenizer file and its character classes; read on the driver, a megabyte travels with the tasks."""
    with open(path or default_model(), encoding="utf-8") as f:
        model = f.read()
    if model not in _classes:
        _classes[model] = character_classes(model)
    return model, _classes[model]


def prefix_table(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, and ``prefixes``, the compressed differences of the counts of all prefixes."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(load(model_path))  # bounded: the tokenizer file

    def factory():
        c = counter(*sent.value)

        def row(doc_id, text):
            found = c.differences(text)
            yield doc_id, len((text or "").encode()), int(unzigzag(found).sum()), zlib.compress(found, 1)

        return row  # what a worker has kept, a bounded store, serves its next tasks

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_tokens long, prefixes binary", factory)


def counts_of(prefixes: bytes | None) -> np.ndarray:
    """Tokens of the prefixes of 0, 1, 2 ... code points."""
    return np.append(0, np.cumsum(unzigzag(zlib.decompress(prefixes)))) if prefixes else np.zeros(1, np.int64)


def answers(counted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per document of a prefix table: whether it has more than ``limit`` tokens, and ``kept_chars``, the code points of
    its longest prefix that has not."""

    def row(doc_id, n_bytes, n_tokens, prefixes):
        if n_tokens <= limit and prefixes is None:
            yield doc_id, n_bytes, n_tokens, False, 0
        else:
            yield doc_id, n_bytes, n_tokens, n_tokens > limit, int(np.flatnonzero(counts_of(prefixes) <= limit)[-1])

    return map_rows(counted.select("doc_id", "n_bytes", "n_tokens", "prefixes"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_chars long", lambda: row)


def tokens_until(counted: DataFrame, chars: Column) -> DataFrame:
    """Per document of a prefix table: ``tokens``, those of its first ``chars`` code points (all, if it has fewer; null
    for a null number)."""

    def row(doc_id, n, prefixes):
        found = counts_of(prefixes)
        yield doc_id, None if n is None else int(found[min(max(n, 0), len(found) - 1)])

    return map_rows(counted.select("doc_id", chars.cast("long").alias("n"), "prefixes"), "doc_id long, tokens long", lambda: row)


def truncated(docs: DataFrame, counted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The documents with texts cut to their longest prefix of at most ``limit`` tokens. Rows are matched by doc_id, so
    ids must be unique; documents without an id stay as they are."""
    cuts = answers(counted, limit).where("over_limit").select(F.col("doc_id").alias("_ev_doc"), F.col("kept_chars").cast("int").alias("_ev_chars"))
    cut = F.when(F.col("_ev_chars").isNull(), docs["text"]).otherwise(F.substring(docs["text"], F.lit(1), F.col("_ev_chars")))
    return docs.join(cuts, docs["doc_id"] == F.col("_ev_doc"), "left").select(*[cut.alias("text") if c == "text" else docs[c] for c in docs.columns])


def packed(counted: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """Documents of a prefix table that fill a budget of tokens in an order by hash: doc_id, n_tokens, ``taken`` tokens of
    it and ``kept_chars``. Sums of hash ranges come first, so no task sums over all rows."""
    turn = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(0)))
    ranged = written(counted.select("doc_id", "n_tokens", "prefixes", turn.alias("turn"), F.shiftright(turn, 52).alias("part"), F.crc32("prefixes").alias("of")), "packed")
    sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("s"))  # at most 4096 rows
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("turn", "doc_id", "of").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(before), "part").where(F.col("offset") < budget)
    left = placed.withColumn("left", F.lit(budget) - F.col("offset") - F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where("left > 0")

    def row(doc_id, n_tokens, prefixes, left):
        found = counts_of(prefixes)
        chars = int(np.flatnonzero(found <= left)[-1])
        yield doc_id, n_tokens, int(found[chars]), chars

    return map_rows(left.select("doc_id", "n_tokens", "prefixes", "left"), "doc_id long, n_tokens long, taken long, kept_chars long", lambda: row)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, and where it would be cut to fit into the limit; both are read from the stored counts."""
    return answers(written(prefix_table(table(spark, sf_dir, "documents")), "prefixes"))
