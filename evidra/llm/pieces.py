"""SentencePiece (merge type) encoding by backtracking, and decoding.

A token sequence is the merge encoding of a text exactly if each token encodes to itself and each adjacent pair
encodes to just that pair. So the encoder walks the text, takes the longest piece that an Aho-Corasick automaton
found at the position, checks it against its left neighbour by merging the two again (results are kept), and steps
back where nothing fits. The tokens on the stack are always the encoding of the text before the position, so a
position that failed once can be marked in a bit field and never be tried again. Time is linear in practice, also for
texts without a space.

Words recur, so encodings of space-delimited stretches are kept in a bounded two-generation store; no piece of the
model joins such stretches, which is checked when a model is loaded. A long stretch without a space takes a few bytes a
character: lengths of matches, lengths of tokens and ids are flat arrays.

Defined cases: a null or empty text has no tokens and decodes to the empty text; characters outside the model become
their UTF-8 bytes; extra columns pass through ``encode``; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from evidra.llm.common import map_rows, table

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
PIECE = 4096  # stretches, or ids of a long one, that are printed and decoded together
KEPT = 64  # characters of a stretch that may be kept
_DECODER = codecs.getincrementaldecoder("utf-8")
#: A stretch's ids as decimals joined by commas (None for a long one), and the ids.
Entry = tuple[str | None, Sequence[int]]


def default_model() -> str:
    """Path of the public tokenizer model."""
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _cutter(pieces: Iterable[str]) -> Callable[[str], list[str]]:
    """A function that cuts normalised text where no piece of the model reaches over: always before a run of spaces,
    and, where the pieces allow it, between Latin letters and other characters and at line ends."""
    latin = "A-Za-z\u00c0-\u024f"
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        raise ValueError("a piece reaches over a space: this model can't be cut into words")
    if any("\n" in p or re.search(f"[{latin}][^{latin}]|[^{latin}{SPACE}][{latin}]", p) for p in pieces):
        return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
    return re.compile(f"\n+|{SPACE}*[{latin}]+|{SPACE}*[^{latin}{SPACE}\n]+|{SPACE}+").findall


class PieceCodec:
    """Encoder and decoder of one merge-type model."""

    def __init__(self, model: bytes, kept: int = 130_000):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.score, self.ids, self.raw = {}, {}, []
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unk = sp.unk_id()
        self.automaton = ahocorasick.Automaton()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.raw.append(b"")
            elif sp.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.raw.append(piece.replace(SPACE, " ").encode())
                if not sp.is_unused(i):
                    self.score[piece], self.ids[piece] = sp.get_score(i), i
        self.whole = frozenset(piece for piece in self.score if len(piece) > 1 and self.alone(piece))
        for piece in self.whole:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.cut = _cutter(self.score)
        self.kept, self.young, self.old = kept, {}, {}
        self.pairs: dict[str, dict[str, bool]] = defaultdict(dict)
        self.n_pairs = 0

    def merged(self, text: str) -> list[str]:
        """Merge encoding of a short text by its definition: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens stay two when merged again."""
        known = self.pairs[left].get(right)
        if known is None:
            if self.n_pairs >= 4 * self.kept:
                self.pairs.clear()
                self.n_pairs = 0
            self.n_pairs += 1
            known = self.pairs[left][right] = self.merged(left + right) == [left, right]
        return known

    def alone(self, piece: str) -> bool:
        """Whether a piece encodes to itself; others can't occur in an encoding."""
        return len(self.merged(piece)) == 1

    def lengths(self, text: str) -> array:
        """Lengths of the tokens of a stretch of normalised text, by backtracking."""
        n = len(text)
        left = array("H", [1]) * n  # longest match not tried yet
        for end, length in self.automaton.iter(text):  # by end, so the last match of a start is its longest
            left[end - length + 1] = length
        pairs, whole, failed, stack, at, last = self.pairs, self.whole, bytearray((n >> 3) + 1), array("H"), 0, ""
        while at < n:
            length = left[at]
            while length:
                end = at + length
                if not failed[end >> 3] >> (end & 7) & 1:
                    token = text[at:end]
                    if last:
                        fits = pairs[last].get(token)
                        if fits is None:
                            fits = self.fits(last, token)
                    else:
                        fits = True
                    if fits:
                        left[at] = length - 1
                        stack.append(length)
                        at, last = end, token
                        break
                length -= 1
                while length > 1 and text[at : at + length] not in whole:
                    length -= 1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= stack.pop()
                last = text[at - stack[-1] : at] if stack else ""
                length = left[at]
                while length > 1 and text[at : at + length] not in whole:
                    length -= 1
                left[at] = length
        return stack

    def tokens(self, text: str) -> list[str]:
        """Tokens of a stretch of normalised text."""
        found, at = [], 0
        for length in self.lengths(text):
            found.append(text[at : at + length])
            at += length
        return found

    def stretch_ids(self, stretch: str) -> array:
        """Ids of a stretch of normalised text; characters outside the model become their bytes."""
        found, ids, byte_ids, at = array("i"), self.ids, self.byte_ids, 0
        for length in self.lengths(stretch):
            token = stretch[at : at + length]
            at += length
            i = ids.get(token)
            if i is not None:
                found.append(i)
            else:
                found.extend([byte_ids[b] for b in token.encode()])
        return found

    def _stretch(self, stretch: str) -> Entry:
        entry = self.old.get(stretch)
        if entry is None:
            if len(stretch) > KEPT:
                return None, self.stretch_ids(stretch)
            ids = tuple(self.stretch_ids(stretch))
            entry = (_printed(ids), ids)
        if len(self.young) >= self.kept:
            self.old, self.young = self.young, {}
        self.young[stretch] = entry
        return entry

    def _entries(self, text: str | None) -> tuple[list[Entry], bool]:
        """Entries of a text's stretches, and whether all of them are short ones."""
        if not text:
            return [], True
        known, miss = self.young.get, self._stretch
        found, short = [], True
        for s in self.cut(SPACE + text.replace(" ", SPACE)):
            entry = known(s)
            if entry is None:
                entry = miss(s)
                known = self.young.get
                short = short and entry[0] is not None
            found.append(entry)
        return found, short

    def forget(self) -> None:
        """Drop what is kept of earlier texts."""
        self.young, self.old, self.n_pairs = {}, {}, 0
        self.pairs.clear()

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        return list(chain.from_iterable([e[1] for e in self._entries(text)[0]]))

    def encode_printed(self, text: str | None) -> tuple[list[int], str]:
        """Ids of a whole text, also as decimals joined by commas."""
        entries, _ = self._entries(text)
        return list(chain.from_iterable([e[1] for e in entries])), ",".join([_printed(e[1]) if e[0] is None else e[0] for e in entries])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of a text's ids, and the digests of the printed ids and of the decoded text. All are made piece by
        piece, so that a long text takes a few bytes an id."""
        ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0
        decoder, raw, first = _DECODER("replace"), self.raw, True
        entries, short = self._entries(text)
        for at in range(0, len(entries), PIECE):
            part = entries[at : at + PIECE]
            for printed, ids in [_joined(part)] if short else _pieces(part):
                ids_sha.update(("," + printed if n else printed).encode())
                n += len(ids)
                decoded = decoder.decode(b"".join(map(raw.__getitem__, ids)))
                text_sha.update((decoded.removeprefix(" ") if first else decoded).encode())
                first = first and not decoded
        text_sha.update(decoder.decode(b"", True).encode())
        return n, ids_sha.hexdigest(), text_sha.hexdigest()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes joined, the space added in front removed."""
        raw = self.raw
        joined = b"".join([raw[i] for i in ids])
        return joined.decode("utf-8", "replace").removeprefix(" ")


def _printed(ids: Sequence[int]) -> str:
    return ",".join(map(str, ids))


def _joined(entries: list[Entry]) -> tuple[str, list[int]]:
    """Printed ids and ids of entries of short stretches."""
    return ",".join([e[0] for e in entries]), list(chain.from_iterable([e[1] for e in entries]))


def _pieces(entries: list[Entry]) -> Iterator[tuple[str, Sequence[int]]]:
    """The same one by one, with those of long stretches cut."""
    for printed, ids in entries:
        for at in range(0, len(ids), PIECE):
            part = ids[at : at + PIECE]
            yield _printed(part) if printed is None or len(part) < len(ids) else printed, part


_codecs: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """The codec of a model, built once in each Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver; half a megabyte travels with the task
        return f.read()


def encode_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per document: number of ids, digest of the ids and of the text decoded from them."""
    model = _model_bytes(model_path or default_model())

    def factory():
        c = codec(model)

        def row(doc_id, text):
            yield doc_id, *c.digests(text)

        row.finish = c.forget
        return row

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", factory)


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per document: its ids as little-endian 32-bit integers, ready to be packed into training shards."""
    import numpy as np

    model = _model_bytes(model_path or default_model())

    def factory():
        c = codec(model)
        return lambda doc_id, text: ((doc_id, np.asarray(c.encode(text), "<i4").tobytes()),)

    return map_rows(docs.select("doc_id", "text"), "doc_id long, ids binary", factory)


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """The texts of what ``encode`` returned."""
    import numpy as np

    model = _model_bytes(model_path or default_model())

    def factory():
        c = codec(model)
        return lambda doc_id, ids: ((doc_id, c.decode(np.frombuffer(ids or b"", "<i4").tolist())),)

    return map_rows(encoded.select("doc_id", "ids"), "doc_id long, text string", factory)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return encode_digests(table(spark, sf_dir, "documents"))
