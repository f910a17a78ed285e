"""SentencePiece encoding and decoding of merge-type (BPE) models with byte fallback.

Merging always takes the best-scored pair, the leftmost of equals. What it makes of a text is the one row of tokens in which
every two neighbours, merged again by themselves, come out as these two: until a merge crosses a border the pieces
on either side merge as they would alone, and a first merge across it would have crossed it in the pair alone
too. So a text is encoded from left to right: an Aho-Corasick automaton gives the longest token at each position; it is taken
if it is compatible with the token before it, else the longest token that is a prefix of it is tried, and so on. If none fits, the
position has failed, which a bitfield keeps (a prefix of a text has one encoding, so the failure holds for good), and the token
before it is shortened instead.

Defined cases: null text is the empty text, which has the begin and end ids alone; ``doc_id`` may be null or repeated, rows are
independent; only the id and text columns are read, so other columns can't clash; an empty table gives an empty
table; characters that no piece holds become the ids of their UTF-8 bytes; a text of n characters takes time in proportion to n times the length of the longest
piece. Models with normalisation rules, user-defined or unused pieces, or without byte fallback are refused.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import Recent

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Fixed values of the published model format: kinds of a piece, the merge-type model.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE_TYPE = 1, 2, 3, 6, 2
#: Chunks and pairs of tokens that a worker remembers (twice that at most); longer chunks aren't kept.
CACHE_ENTRIES, CACHE_CHUNK, CACHE_PAIRS = 450_000, 40, 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of one protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces of a model file, with what encoding and decoding look up."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        trainer = dict(_fields(next((v for k, v in parts if k == 2), b"")))
        rules = {5: 1, 4: 1, 3: 1} | dict(_fields(next((v for k, v in parts if k == 3), b"")))
        pieces = [{2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(v)) for k, v in parts if k == 1]
        kinds = [p[3] for p in pieces]
        if trainer.get(3) != BPE_TYPE or not trainer.get(35) or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: not a merge-type model with byte fallback and plain pieces")
        if rules.get(2) or rules[4] or not rules[3] or not rules[5]:
            raise ValueError(f"{path}: its normalisation isn't the identity with a blank in front")
        self.text = [p[1].decode() for p in pieces]
        self.kinds = kinds
        self.begin, self.end = self.text.index("<s>"), self.text.index("</s>")
        self.bytes = [self.text.index(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {piece: b for b, piece in enumerate(self.bytes)}
        self.is_byte = np.array([kind == BYTE for kind in kinds])
        normal = [i for i, kind in enumerate(kinds) if kind == NORMAL]
        #: Order of merging: better scores first.
        self.order = {self.text[i]: -struct.unpack("<f", pieces[i][2])[0] for i in normal}
        # Tokens: the normal pieces, and characters that occur in pieces but aren't any.
        self.tokens = [self.text[i] for i in normal]
        self.tokens += sorted({c for t in self.tokens for c in t} - self.order.keys())
        self.ids = [[i] for i in normal] + [self.fallback(t) for t in self.tokens[len(normal) :]]
        self.plain_tokens, self.first_ids = len(normal), normal
        self.sizes = list(map(len, self.tokens))
        number = {t: k for k, t in enumerate(self.tokens)}
        #: The longest token that is a proper prefix of a token; -1: none.
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in self.tokens]
        # Read backwards, all tokens that end at a position are those that start there.
        self.starts = ahocorasick.Automaton()
        for t, k in number.items():
            self.starts.add_word(t[::-1], k)
        self.starts.make_automaton()
        # No merge crosses from another character to a blank if no piece does; then a text falls into chunks there.
        crosses = any(SPACE in t.lstrip(SPACE) for t in self.tokens)
        self.cut = (lambda text: [text]) if crosses else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.plain = [t.replace(SPACE, " ") if kind == NORMAL else "" if kind == CONTROL else " ⁇ " for t, kind in zip(self.text, kinds, strict=True)]

    def fallback(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode()]

    def remerge(self, text: str) -> list[str]:
        """Merges a short text from its characters."""
        parts, none = list(text), float("inf")
        order = self.order.get
        scores = [order(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (score := min(scores)) < none:
            # The leftmost of the best pairs; its neighbours' pairs change.
            at = scores.index(score)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = order(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = order(parts[at] + parts[at + 1], none)
        return parts


class Coder:
    """Encodes whole texts; chunks and the compatibility of pairs are remembered up to a bound."""

    def __init__(self, path: str):
        self.model = model = Model(path)
        self.many = len(model.tokens) + 1
        self.chunks = Recent(lambda chunk: array("i", self.encode_chunk(chunk)).tobytes(), CACHE_ENTRIES, CACHE_CHUNK)
        self.pairs: dict[int, bool] = {}

    def compatible(self, key: int) -> bool:
        """Whether merging a pair's text again gives its two tokens; ``key`` is (1 + token before, 0 at a start) * many + token."""
        before, token = divmod(key, self.many)
        tokens = self.model.tokens
        wanted = [tokens[before - 1], tokens[token]] if before else [tokens[token]]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        known = self.pairs[key] = self.model.remerge("".join(wanted)) == wanted
        return known

    def encode_chunk(self, chunk: str) -> list[int]:
        model, last = self.model, len(chunk) - 1
        # Backwards a position's longest token comes first; so it is what the reversed list leaves in the dictionary.
        ends = dict([*model.starts.iter(chunk[::-1])][::-1])
        if len(ends) == len(chunk):
            return self._ids(self._backtrack(ends, last, 0, len(chunk)))
        out: list[int] = []
        at = 0
        while at <= last:
            if last - at not in ends:
                # No piece holds this character, so nothing merges across it.
                out += model.fallback(chunk[at])
                at += 1
                continue
            end = at
            while end <= last and last - end in ends:
                end += 1
            out += self._ids(self._backtrack(ends, last, at, end))
            at = end
        return out

    def _ids(self, tokens: list[int]) -> list[int]:
        ids, first, plain = self.model.ids, self.model.first_ids, self.model.plain_tokens
        if max(tokens) < plain:
            return [first[t] for t in tokens]
        return [i for t in tokens for i in ids[t]]

    def _backtrack(self, ends: dict[int, int], last: int, start: int, end: int) -> list[int]:
        """Tokens of the positions from ``start`` to ``end``; ``ends`` has the longest token of position p at ``last - p``."""
        sizes, shorter, pairs, many = self.model.sizes, self.model.shorter, self.pairs, self.many
        failed = bytearray((end - start >> 3) + 1)
        taken: list[int] = []
        at, token, before = start, ends[last - start], 0
        while True:
            to = at + sizes[token]
            bit = to - start
            if to <= end and not failed[bit >> 3] >> (bit & 7) & 1:
                key = before + token
                fits = pairs.get(key)
                if fits if fits is not None else self.compatible(key):
                    taken.append(token)
                    if to == end:
                        return taken
                    before = (token + 1) * many
                    at, token = to, ends[last - to]
                    continue
            token = shorter[token]
            if token < 0:
                bit = at - start
                failed[bit >> 3] |= 1 << (bit & 7)
                token = taken.pop()
                at -= sizes[token]
                before = (taken[-1] + 1) * many if taken else 0

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, without begin and end."""
        if not text:
            return np.empty(0, np.int32)
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, self.model.cut(SPACE + text.replace(" ", SPACE)))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: a first blank goes, runs of byte pieces are read as UTF-8, each byte that isn't as the replacement character."""
        model = self.model
        codes = ids.tolist()
        is_byte = np.flatnonzero(model.is_byte[ids]).tolist()
        if not is_byte:
            text = "".join(map(model.plain.__getitem__, codes))
        else:
            parts, at, k = [], 0, 0
            while k < len(is_byte):
                first = last = is_byte[k]
                while k + 1 < len(is_byte) and is_byte[k + 1] == last + 1:
                    k, last = k + 1, last + 1
                k += 1
                parts += map(model.plain.__getitem__, codes[at:first])
                parts.append(utf8(bytes(model.byte_of[i] for i in codes[first : last + 1])))
                at = last + 1
            text = "".join([*parts, *map(model.plain.__getitem__, codes[at:])])
        first = next((i for i in codes if model.kinds[i] != CONTROL), None)
        return text[1:] if first is not None and model.text[first].startswith(SPACE) else text


def utf8(data: bytes) -> str:
    """Text of bytes, with one replacement character for each byte that isn't part of a character."""
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        return data[: e.start].decode() + "�" + utf8(data[e.start + 1 :])


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    common.begin("pieces", _CODERS.clear)
    return _CODERS.get(path) or _CODERS.setdefault(path, Coder(path))


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """``doc_id, ids array<int>`` of each row's whole text, with begin and end ids if wanted."""
    path = path or public_tokenizers.path(MODEL)
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        first, last = [c.model.begin] * begin, [c.model.end] * end
        for batch in batches:
            ids = [[*first, *c.encode(t or "").tolist(), *last] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {_id_type(rows)}, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``, to ``doc_id, ids``; null ids decode to the empty text."""
    path = path or public_tokenizers.path(MODEL)
    common.small_batches(coded.sparkSession)
    rows = coded.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            out = [c.decode(np.array(i or [], np.int32)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {_id_type(rows)}, ids array<int>, decoded string")


def packed(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens long, ids binary, decoded string`` in one worker: ids with begin and end, as little-endian unsigned 32-bit integers."""
    path = path or public_tokenizers.path(MODEL)
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        first, last = np.int32([c.model.begin]), np.int32([c.model.end])
        for batch in batches:
            counts, ids, texts = [], [], []
            for t in batch.column(1).to_pylist():
                coded = np.concatenate([first, c.encode(t or ""), last])
                counts.append(len(coded))
                ids.append(coded.astype("<u4").tobytes())
                texts.append(c.decode(coded))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
        common.rest()

    return rows.mapInArrow(run, f"doc_id {_id_type(rows)}, n_tokens long, ids binary, decoded string")


def op11_pieces(spark, sf_dir: str) -> DataFrame:
    """Count and digests of each document's ids and of the text they decode to."""
    rows = packed(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
