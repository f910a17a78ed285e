"""Hidden Markov language model of the corpus.

Tokens are lower-case words (A-Z) between ASCII blanks, and one end a text. Counts of all
training words are gathered by shuffle. The ``KNOWN`` most frequent, the end and one symbol for words unseen in
training are a bounded dictionary that goes to the workers; of these the ``OWN`` most frequent have emissions of their own in every pass.

All other training words are tied while the states form: a word shares the emission of its class (length and
last letters, ``CLASSES`` of them). A word's share of its class is the same in all states, so it takes no part in
the expected counts, and no pass but the last needs a table of words. The last maximisation unties them: its expected counts are
kept word by word, those of the dictionary by the driver, those of rarer words in a table that grows with the input,
stays distributed and is summed by shuffle. So in the model that scores, every training word has an emission of
its own; texts meet those of their rarer words, and their counts, in one shuffle join on the word. By choice of the
dictionary no rarer training word is frequent.

A state speaks an unseen word as often as it spoke, in training, words that occur once there (leaving one token out, each of those is
unseen): its expected counts of such words, as a share of all it spoke, go to the unseen symbol, and its other emissions
shrink by that share. Nothing is held back from training, and the emissions of a state still sum to 1.

``STATES`` latent states are trained by Baum-Welch on every training text: each partition
runs the scaled forward and backward recursions and adds up expected counts, in fixed point so that
sums don't depend on their order. Texts are cut into runs of ``RUN`` tokens whose transfer matrices are computed side by side and
then chained, which is the same recursion in another order of multiplication.

Defined cases: null or empty text is one end token; a null id counts as training; repeated
rows count each; without training texts every count is 0; words and texts of any length are whole; words of equal
count are ranked by name; only the id and text columns are read.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KNOWN, OWN, CLASSES = 200_000, 60_000, 4096
STATES, PASSES, RUN = 4, 4, 128
END, UNSEEN = 0, 1  # symbols: these, then the dictionary's words; rarer ones of a text are -1, -2, ...
#: A symbol that two bytes can't hold.
WIDE = 0xFFFF
FIXED = 1 << 20
#: Tokens, and share of a state's tokens, that the corpus shares count for in its emissions.
LEAN = (200, 0.05)
#: Bytes of words that a partition counts before it sends what it has.
FLUSH = 64 << 20
#: Partitions of texts that one task of a training pass takes, if enough tasks are left: each task sends its sums.
JOINED = 3


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of a column of texts one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, size = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    # Blanks at the ends leave empty strings.
    some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not some.all():
        size = np.bincount(np.repeat(np.arange(len(size)), size)[some], minlength=len(size))
        words = words.filter(pa.array(some))
    return words, size


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over all rows of the one text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            found = pa.concat_arrays(kept).value_counts() if kept else []
            for at in range(0, len(found), 20_000):
                part = found.slice(at, 20_000)
                yield pa.RecordBatch.from_arrays(part.flatten(), ["word", "n"])

        for batch in batches:
            words, _ = tokens(batch.column(0))
            kept.append(words)
            size += words.nbytes
            if size >= FLUSH:
                yield from send()
                kept, size = [], 0
        yield from send()

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def threshold(counts: DataFrame) -> int:
    """The least count such that at most KNOWN words have it or more.

    Words are counted by the logarithm of their count, in 64 steps an octave: a bounded
    number of rows, while the top of a sort would send KNOWN rows from every partition.
    """
    steps = counts.groupBy(F.floor(64 * F.log2("c")).alias("step")).agg(F.min("c").alias("least"), F.count("*").alias("n")).collect()
    least, total = 1 << 62, 0
    for r in sorted(steps, key=lambda r: -r.step):
        total += r.n
        if total > KNOWN:
            break
        least = r.least
    return least


def class_of(word: bytes) -> int:
    """The class that a rare word is tied to: its length and last three letters."""
    return (zlib.crc32(word[-3:]) * 16 + min(len(word), 15)) % CLASSES


class Vocabulary:
    """The bounded dictionary: symbol and count of frequent words, and what they are tied to; corpus totals."""

    def __init__(self, frequent: list[tuple[str, int]], tokens: int, distinct: int, ends: int):
        self.tokens, self.distinct, self.ends = tokens, distinct, ends
        self.all = tokens + distinct + 1
        words = [(w.encode(), c) for w, c in frequent]
        self.symbols, self.own = 2 + len(words), 2 + min(OWN, len(words))
        #: Sums to 1 with the shares (c + 1) / all of the other training words.
        self.counts = np.array([ends + 1, 1, *(c + 1 for _, c in words)], np.int64)
        self.share = self.counts / self.all
        #: Row of each symbol in a tied model: its own, or that of its class behind those.
        self.tie = np.array([*range(self.own), *(self.own + class_of(w) for w, _ in words[self.own - 2 :])], np.int64)
        self.marks = np.array([END, UNSEEN, *(zlib.crc32(w) for w, _ in words[: self.own - 2]), *range(1 << 32, (1 << 32) + CLASSES)], np.uint64)
        #: Words of the symbols from 2 on.
        self.words = pa.array([w for w, _ in frequent], pa.string())


def encode(rows: DataFrame, vocabulary) -> DataFrame:
    """Symbols of each text with the sum over its frequent words, and its other words, each once with its number and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        logs = np.log10(v.share)
        for batch in batches:
            n = batch.num_rows
            words, size = tokens(batch.column(2))
            coded = words.dictionary_encode()
            distinct, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            # Each distinct word of the batch is looked up once; rare ones are symbol 0 here.
            symbol = pc.fill_null(pc.index_in(distinct, value_set=v.words), -2).to_numpy(zero_copy_only=False).astype(np.int64) + 2
            chance = np.where(symbol > 0, logs[symbol], 0.0)
            tie = np.zeros(len(symbol), np.uint16)
            for i, w in zip(np.flatnonzero(symbol == 0).tolist(), distinct.filter(pa.array(symbol == 0)).cast(pa.binary()).to_numpy(zero_copy_only=False), strict=True):
                tie[i] = class_of(w)
            owner, ids = np.repeat(np.arange(n), size), symbol[code]
            rare = ids == 0
            # Rare words of each text, each once: numbered in the order of their codes.
            pairs, inverse, times = np.unique(owner[rare] * max(len(symbol), 1) + code[rare], return_inverse=True, return_counts=True)
            text, word = np.divmod(pairs, max(len(symbol), 1))
            first = np.searchsorted(text, np.arange(n + 1))
            ids[rare] = -1 - (inverse - first[owner[rare]])
            ids = np.insert(ids, np.cumsum(size), END) if n else ids
            ends = np.cumsum(size + 1)
            big = (ids < 0) | (ids >= WIDE)
            short, wide = np.where(big, WIDE, ids).astype(np.uint16), np.where(big, ids, 0).astype(np.int32)
            pieces = [slice(a, b) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []
            names = distinct.take(pa.array(word))
            ties = tie[word]
            lists = lambda x: pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), x)
            columns = [
                pa.array(size + 1, pa.int64()),
                pa.array(size - np.bincount(owner[rare], minlength=n) + (v.ends > 0), pa.int64()),
                pa.array(np.bincount(owner, chance[code], n) + logs[END], pa.float64()),
                pa.array([short[p].tobytes() for p in pieces], pa.binary()),
                pa.array([wide[p][big[p]].tobytes() for p in pieces], pa.binary()),
                pa.array([ties[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary()),
                lists(names),
                lists(pa.array(times.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "n_tokens", "n_known", "base", "symbols", "wide", "ties", "rare", "times"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, symbols binary, wide binary, ties binary, rare array<string>, times array<int>")


def _tilt(marks: np.ndarray) -> np.ndarray:
    """What the first model multiplies shares by, in 2**-20: about one half to three halves, by a hash of word and state."""
    at = np.asarray(marks, np.uint64)[:, None] * np.uint64(STATES) + np.arange(1, STATES + 1, dtype=np.uint64)
    return (common.mix(at) >> np.uint64(44)).astype(np.int64) + (1 << 19)


class Model:
    """Start, transition and emission probabilities; ``norm``, ``lean`` and ``seen`` make those of words that have no row."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray, norm: np.ndarray | None = None, lean: np.ndarray | None = None, seen: np.ndarray | float = 1.0):
        self.start, self.moves, self.emits, self.norm, self.lean, self.seen = start, moves, emits, norm, lean, seen

    @classmethod
    def first(cls, share: np.ndarray, marks: np.ndarray | None = None) -> Model:
        """States that stay, with emissions around the corpus shares; a hash of word and state breaks the tie."""
        emits = share[:, None] * (_tilt(np.arange(len(share)) if marks is None else marks) / 2.0**20)
        moves = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(moves, 0.9)
        return cls(np.full(STATES, 1 / STATES), moves, emits / emits.sum(axis=0))

    @classmethod
    def from_counts(cls, start, moves, emits, share, total) -> Model:
        """Maximisation; each state's emissions lean on the corpus shares, which sum to 1. ``total`` is over all words."""
        lean = LEAN[0] + LEAN[1] * total
        norm = total + lean
        moves = moves + 1
        return cls((start + 1) / (start + 1).sum(), moves / moves.sum(axis=1, keepdims=True), (emits + share[:, None] * lean) / norm, norm, lean)

    def rare(self, share: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Emissions of words without a row, from their shares and expected counts."""
        return self.seen * (counts / FIXED + share[:, None] * self.lean) / self.norm

    def with_rows(self, emits: np.ndarray) -> Model:
        return Model(self.start, self.moves, emits, self.norm, self.lean, self.seen)

    def with_unseen(self, once: np.ndarray) -> Model:
        """The model that gives the unseen symbol the mass of words that occur once: ``once`` are their expected counts by state."""
        mass = once / self.norm
        emits = self.emits * (1 - mass)
        emits[UNSEEN] += mass
        return Model(self.start, self.moves, emits, self.norm, self.lean, 1 - mass)


class Batch:
    """Texts cut into runs of RUN symbols, runs sorted by length so that those still going are a prefix."""

    def __init__(self, texts: list[np.ndarray]):
        self.texts = len(texts)
        of, number, start, length, at = [], [], [], [], 0
        for d, t in enumerate(texts):
            n = -(-len(t) // RUN)
            of += [d] * n
            number += range(n)
            start += range(at, at + len(t), RUN)
            length += [RUN] * (n - 1) + [len(t) - RUN * (n - 1)]
            at += len(t)
        self.symbols = np.concatenate(texts).astype(np.int64)
        length = np.array(length)
        order = np.argsort(-length, kind="stable")
        self.of, self.number, self.start, self.length = (np.array(x)[order] for x in (of, number, start, length))
        self.going = [int(np.searchsorted(-self.length, -t, side="left")) for t in range(RUN)]
        self.steps = int(self.length[0])
        #: Positions (among runs) of each text's n-th run, for n = 0, 1, ...
        by = np.lexsort((self.of, self.number))
        self.rounds = np.split(by, np.flatnonzero(np.diff(self.number[by])) + 1)

    def at(self, t: int) -> np.ndarray:
        return self.symbols[self.start[: self.going[t]] + t]

    def transfers(self, m: Model) -> tuple[np.ndarray, np.ndarray]:
        """Each run's scaled product of step matrices, and the log of its scale."""
        runs = len(self.start)
        x = np.broadcast_to(np.eye(STATES), (runs, STATES, STATES)).copy()
        scale = np.zeros(runs)
        first = self.number == 0
        for t in range(self.steps):
            n = self.going[t]
            y = (x[:n].reshape(-1, STATES) @ m.moves).reshape(n, STATES, STATES)
            if t == 0:
                y[first[:n]] = m.start
            y *= m.emits[self.at(t)][:, None, :]
            if t % 4 == 3 or t == self.steps - 1:
                s = y.sum(axis=(1, 2))
                y /= s[:, None, None]
                scale[:n] += np.log(s)
            x[:n] = y
        return x, scale

    def forward(self, x: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State shares before each run, and the log likelihood of each text."""
        alpha, total = np.zeros((self.texts, STATES)), np.zeros(self.texts)
        alpha[:, 0] = 1
        before = np.empty((len(self.start), STATES))
        for runs in self.rounds:
            d = self.of[runs]
            before[runs] = alpha[d]
            y = np.einsum("ni,nij->nj", alpha[d], x[runs])
            s = y.sum(axis=1)
            alpha[d] = y / s[:, None]
            total[d] += np.log(s) + scale[runs]
        return before, total

    def expected(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions."""
        x, scale = self.transfers(m)
        before, _ = self.forward(x, scale)
        runs = len(self.start)
        beta, after = np.ones((self.texts, STATES)), np.empty((runs, STATES))
        for part in reversed(self.rounds):
            d = self.of[part]
            after[part] = beta[d]
            y = np.einsum("nij,nj->ni", x[part], beta[d])
            beta[d] = y / y.sum(axis=1, keepdims=True)
        first = self.number == 0
        a, alphas = before, []
        for t in range(self.steps):
            n = self.going[t]
            y = a[:n] @ m.moves
            if t == 0:
                y[first[:n]] = m.start
            y *= m.emits[self.at(t)]
            y /= y.sum(axis=1, keepdims=True)
            alphas.append(y)
            a = y
        start, moves = np.zeros(STATES), np.zeros((STATES, STATES))
        met, shares = [], []
        b = after
        for t in range(self.steps - 1, -1, -1):
            n, symbols = self.going[t], self.at(t)
            g = alphas[t] * b[:n]
            g /= g.sum(axis=1, keepdims=True)
            met.append(symbols)
            shares.append(g)
            w = m.emits[symbols] * b[:n]
            u = (before if t == 0 else alphas[t - 1])[:n]
            z = ((u @ m.moves) * w).sum(axis=1, keepdims=True)
            inner = ~first[:n] if t == 0 else slice(None)
            moves += (u / z)[inner].T @ w[inner]
            if t == 0:
                start += g[first[:n]].sum(axis=0)
            y = w @ m.moves.T
            b = b.copy() if t else b
            b[:n] = y / y.sum(axis=1, keepdims=True)
        at, g = np.concatenate(met), np.concatenate(shares)
        emits = np.stack([np.bincount(at, g[:, k], len(m.emits)) for k in range(STATES)], axis=1)
        return start, moves * m.moves, emits


class Coded:
    """Texts of a batch in symbols of the dictionary, with the batch's rare words numbered behind those."""

    def __init__(self, batch: pa.RecordBatch, symbols: int):
        self.size = pc.list_value_length(batch.column("rare" if "rare" in batch.schema.names else "times")).to_numpy(zero_copy_only=False)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.texts = []
        for at, short, wide in zip(self.first.tolist(), batch.column("symbols").to_pylist(), batch.column("wide").to_pylist(), strict=False):
            t = np.frombuffer(short, np.uint16)
            if wide:
                t, wide = t.astype(np.int64), np.frombuffer(wide, np.int32).astype(np.int64)
                t[t == WIDE] = np.where(wide >= 0, wide, symbols + at - 1 - wide)
            self.texts.append(t)


def ties_of(batch: pa.RecordBatch, v: Vocabulary) -> np.ndarray:
    """Rows of the tied model: of the dictionary's symbols, then of the batch's rare words."""
    return np.concatenate([v.tie, v.own + np.frombuffer(b"".join(batch.column("ties").to_pylist()), np.uint16).astype(np.int64)])


_STATES = [f"s{k}" for k in range(STATES)]


def _sums(at: np.ndarray, fixed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(fixed[:, k]) for k in range(STATES))], ["id", *_STATES])


def baum_welch(coded: DataFrame, model: Model, v: Vocabulary, share: np.ndarray) -> Model:
    """One pass over every training text with a tied model: the next one."""
    shared = coded.sparkSession.sparkContext.broadcast((model, v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, v = shared.value
        here = len(m.emits)
        total = np.zeros((here + STATES + 1, STATES))  # emissions, then moves, then starts
        for batch in batches:
            if batch.num_rows:
                rows = ties_of(batch, v)
                start, moves, emits = Batch([rows[t] for t in Coded(batch, v.symbols).texts]).expected(m)
                total[:here] += emits
                total[here:-1] += moves
                total[-1] += start
        fixed = np.rint(total * FIXED).astype(np.int64)
        some = np.flatnonzero(fixed.any(axis=1))
        for i in range(0, len(some), 10_000):
            yield _sums(some[i : i + 10_000], fixed[some[i : i + 10_000]])

    sent = coded.select("symbols", "wide", "ties", "times").mapInArrow(run, "id long, " + ", ".join(f"{x} long" for x in _STATES))
    total = _gathered(sent.groupBy("id").agg(*(F.sum(x).alias(x) for x in _STATES)), len(model.emits) + STATES + 1)
    emits = total[: len(model.emits)]
    return Model.from_counts(total[-1], total[len(emits) : -1], emits, share, emits.sum(axis=0))


def _gathered(sums: DataFrame, rows: int) -> np.ndarray:
    """Sums by row, for a bounded number of rows."""
    found, total = sums.toArrow(), np.zeros((rows, STATES))
    total[found.column("id").to_numpy()] = np.stack([found.column(x).to_numpy() for x in _STATES], axis=1)
    return total / FIXED


def untied(coded: DataFrame, model: Model, v: Vocabulary) -> tuple[Model, DataFrame]:
    """The last pass: the model with a row for each symbol of the dictionary, and ``word, c, s0, ...`` of all rarer training words."""
    shared = coded.sparkSession.sparkContext.broadcast((model, v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, v = shared.value
        here = v.symbols
        total, rest = np.zeros((here + STATES + 1, STATES)), np.zeros((1, STATES), np.int64)

        def rows(words: pa.Array, n: np.ndarray, fixed: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([words, pa.array(n), *(pa.array(fixed[:, k]) for k in range(STATES))], ["word", "c", *_STATES])

        for batch in batches:
            if batch.num_rows:
                start, moves, emits = Batch(Coded(batch, here).texts).expected(m.with_rows(m.emits[ties_of(batch, v)]))
                total[:here] += emits[:here]
                total[here:-1] += moves
                total[-1] += start
                fixed = np.rint(emits[here:] * FIXED).astype(np.int64)
                rest += fixed.sum(axis=0)
                n = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield rows(batch.column("rare").flatten(), n, fixed)
        fixed = np.concatenate([np.rint(total * FIXED).astype(np.int64), rest])
        some = np.flatnonzero(fixed.any(axis=1))
        for i in range(0, len(some), 10_000):
            part = some[i : i + 10_000]
            # No word begins with a blank.
            yield rows(pa.array([f" {x}" for x in part.tolist()]), np.zeros(len(part), np.int64), fixed[part])

    sent = coded.select("symbols", "wide", "ties", "rare", "times").mapInArrow(run, "word string, c long, " + ", ".join(f"{x} long" for x in _STATES))
    sums = placed(sent.groupBy("word").agg(F.sum("c").alias("c"), *(F.sum(x).alias(x) for x in _STATES)))
    bounded = F.col("word").startswith(" ")
    total = _gathered(sums.where(bounded).select(F.col("word").substr(F.lit(2), F.length("word")).cast("long").alias("id"), *_STATES), v.symbols + STATES + 2)
    emits, table = total[: v.symbols], sums.where(~bounded)
    once = table.where("c = 1").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in _STATES)).first()
    model = Model.from_counts(total[-2], total[v.symbols : -2], emits, v.share, emits.sum(axis=0) + total[-1])
    return model.with_unseen(emits[v.counts == 2].sum(axis=0) + np.array(once) / FIXED), table


def likelihood(coded: DataFrame, table: DataFrame, model: Model, v: Vocabulary) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base, states`` of every text; ``states`` is its log10 likelihood."""
    shared = coded.sparkSession.sparkContext.broadcast((model, v.symbols, v.all))
    each = coded.where(F.size("rare") > 0).select("row", F.posexplode("rare").alias("at", "word"))
    met = each.join(table.hint("merge"), "word").groupBy("row").agg(F.collect_list(F.struct("at", "c", *_STATES)).alias("met"))
    whole = coded.drop("rare", "ties").join(met.hint("merge"), "row", "left").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, symbols, all_ = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = Coded(batch, symbols)
            n, words = batch.num_rows, int(coded.first[-1])
            c, counts, met = np.zeros(words, np.int64), np.zeros((words, STATES), np.int64), batch.column("met")
            found = met.flatten()
            if len(found):
                of = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(met), 0).to_numpy(zero_copy_only=False))
                at = coded.first[of] + found.field(0).to_numpy()
                c[at] = found.field(1).to_numpy()
                counts[at] = np.stack([found.field(2 + k).to_numpy() for k in range(STATES)], axis=1)
            rare = m.rare((c + 1) / all_, counts)
            rare[c == 0] = m.emits[UNSEEN]
            b = Batch(coded.texts)
            _, total = b.forward(*b.transfers(m.with_rows(np.concatenate([m.emits, rare]))))
            times, owner = batch.column("times").flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), coded.size)
            known = batch.column("n_known").to_numpy() + np.bincount(owner, times * (c > 0), n).astype(np.int64)
            base = batch.column("base").to_numpy() + np.bincount(owner, times * np.log10((c + 1) / all_), n)
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "held_out", "n_tokens"]).columns, pa.array(known), pa.array(base), pa.array(total / np.log(10))], ["doc_id", "held_out", "n_tokens", "n_known", "base", "states"])

    return whole.mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, states double")


def tied_share(rare: DataFrame, v: Vocabulary) -> np.ndarray:
    """Share of the corpus of each row of a tied model; they sum to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for b in batches:
            if b.num_rows:
                at = np.fromiter((class_of(w.encode()) for w in b.column(0).to_pylist()), np.int64, b.num_rows)
                np.add.at(total, at, b.column(1).to_numpy() + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total)], ["at", "n"])

    out = np.bincount(v.tie, v.counts, v.own + CLASSES)
    for at, n in rare.select("word", "c").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[v.own + at] += n
    return out / v.all


def placed(df: DataFrame) -> DataFrame:
    """A checkpoint that stays dealt by its key, so that a join on it needs no exchange: adaptive plans forget how they were dealt."""
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return common.checkpoint(df)
    finally:
        spark.conf.set(key, before)


def release(spark) -> None:
    """Lets Spark's cleaner drop the shuffles and checkpoints that nothing refers to any more; it follows the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its base score and its exact log10 likelihood under the trained model."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = common.checkpoint(word_counts(training.select("text")))
    words, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    ends = training.count()
    least = threshold(counts)
    frequent = sorted(((r[0], r[1]) for r in counts.where(F.col("c") >= least).select("word", "c").collect()), key=lambda x: (-x[1], x[0]))
    v = Vocabulary(frequent, (words or 0) + ends, distinct + (ends > 0), ends)
    share = tied_share(counts.where(F.col("c") < least), v)
    coded = placed(encode(rows, spark.sparkContext.broadcast(v)).withColumn("row", F.monotonically_increasing_id()).repartition("row"))
    del counts
    parts, least_parts = coded.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism
    model, taught = Model.first(share, v.marks), coded.where(~F.col("held_out")).coalesce(max(parts // JOINED, min(parts, least_parts), 1))
    for _ in range(PASSES - 1):
        release(spark)
        model = baum_welch(taught, model, v, share)
    model, table = untied(taught, model, v)
    release(spark)
    return likelihood(coded, table, model, v).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("states").alias("score"))


def op6_lm(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
