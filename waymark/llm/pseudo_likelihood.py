"""Pseudo-likelihood of notes under a masked bidirectional window network.

Every word of a note is hidden in turn and predicted from the two words before it and the two after it. The network embeds the context words (one
table per place), adds them up, squashes the sum and predicts the hidden word's class, then the word inside its class; there are ``side`` classes
of ``side`` words. Class and word are each predicted by two choices, so that a word costs four choices among about
the fourth root of the vocabulary; for the word, its class weighs the squashed sum, entry by entry. The vocabulary is the corpus's most frequent words, counted over all
notes, and grows with them: ``side`` is at least the fourth root of the number of words. A rarer word's probability is that of the last class times
that of its spelling, a chain of byte pairs counted over all rare words, so that all words together have probability 1 at most (the chain also
spells frequent words). As surroundings, rare words are told apart by a hash of ``side`` values.

The words of all notes train the network: notes, as lists of word numbers, are dealt to trainers by a hash, every trainer fits the network in NumPy
on the windows of its own notes, and after each pass the trainers' weights are averaged. The summed log-probabilities of a note's words given
their surroundings are its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .words import _WORD, Words, mix, slices

SIDE = 32
SIZE = SIDE * SIDE
REACH = (-2, -1, 1, 2)
GAP = 2
RUN = 64
DIM = 32
PASS_ROWS = 4096
RANGE = 1 << 18
UNIT, CROWD = 64, 2
LONG = 16


class Network:
    """Weights: context tables; the outputs of both choices of a class and of both choices of its member, their bias by what was chosen before, and
    the gate that each class lays on the sum for its members."""

    def __init__(self, seed: int = 5, side: int = SIDE):
        rng = np.random.default_rng(seed)
        self.side = side
        bits = side.bit_length() - 1
        self.wide, self.narrow = 1 << (bits + 1) // 2, 1 << bits // 2
        self.context = rng.normal(0, 0.1, (side * side + 1, len(REACH), DIM)).astype(np.float32)
        self.lean = np.zeros(DIM, np.float32)
        self.out = [rng.normal(0, 0.1, (DIM, self.wide + self.narrow)).astype(np.float32) for _ in range(2)]
        self.first = [np.zeros((n, self.wide), np.float32) for n in (1, side)]
        self.second = [np.zeros((n * self.wide, self.narrow), np.float32) for n in (1, side)]
        self.gate = np.ones((side, DIM), np.float32)
        # which of the outputs belong to one choice
        self.belongs = np.zeros((self.wide + self.narrow, 2), np.float32)
        self.belongs[: self.wide, 0] = self.belongs[self.wide :, 1] = 1

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.lean, *self.out, *self.first, *self.second, self.gate]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    @classmethod
    def of(cls, flat: np.ndarray, side: int = SIDE) -> "Network":
        net, at = cls(side=side), 0
        for a in net.arrays():
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
        return net

    def hidden(self, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The squashed sums of the windows around these places of a text of numbers."""
        rows = self.context.reshape(-1, DIM)
        h = rows.take(text.take(place + REACH[0]).astype(np.intp) * len(REACH), 0)
        h += self.lean
        for i in range(1, len(REACH)):
            h += rows.take(text.take(place + REACH[i]).astype(np.intp) * len(REACH) + i, 0)
        return np.tanh(h, out=h)

    def bias(self, i: int, one: np.ndarray) -> np.ndarray:
        """The bias of all outputs of the class (``i`` = 0) or the member, by its first choice, which tells what was chosen before."""
        out = np.empty((len(one), self.wide + self.narrow), np.float32)
        out[:, : self.wide] = self.first[i].take(one // self.wide, 0)
        out[:, self.wide :] = self.second[i].take(one, 0)
        return out

    def odds(self, i: int, h: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the class or the member: e to the power of all outputs, and their sum over each of the two choices."""
        z = h @ self.out[i]
        z += bias
        np.clip(z, -80, 80, out=z)  # every sum is finite and above 0
        np.exp(z, out=z)
        return z, z @ self.belongs

    def chosen(self, z: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the chosen outputs lie in ``z`` laid end to end."""
        at = np.arange(0, z.size, z.shape[1])
        return at + one, at + (self.wide + two)

    def log_probs(self, context: np.ndarray, word: np.ndarray, spelled: np.ndarray | float | None = None) -> np.ndarray:
        """log P(word | context) of every row; with ``spelled``, its value stands for the member of the last class."""
        text = np.concatenate([context[:, :GAP], word[:, None], context[:, GAP:]], 1)
        return self.log_probs_of(self.hidden(text.reshape(-1), np.arange(len(text)) * text.shape[1] + GAP), word, spelled)

    def log_probs_of(self, h: np.ndarray, word: np.ndarray, spelled: np.ndarray | float | None = None) -> np.ndarray:
        word = word.astype(np.intp)
        total = np.zeros(len(word))
        cls = word // self.side
        for i, part in enumerate((cls, word)):
            one = part // self.narrow
            bias = self.bias(i, np.arange(len(self.second[i])))
            z, both = self.odds(i, h * self.gate.take(cls, 0) if i else h, bias.take(one, 0))
            at_one, at_two = self.chosen(z, one % self.wide, part - one * self.narrow)
            flat = z.reshape(-1)
            lp = np.log(flat.take(at_one) / both[:, 0]) + np.log(flat.take(at_two) / both[:, 1])
            total += lp if spelled is None or not i else np.where(cls == self.side - 1, spelled, lp)
        return total

    def fit(self, text: np.ndarray, rate: float = 0.25, batch: int = 256) -> None:
        """One pass of stochastic gradient descent over the windows of runs of numbers; each run holds ``GAP`` numbers more on both sides.

        A table's row moves by the rate over ``UNIT`` for each of a step's windows, but not by more than ``CROWD`` times their mean; what all windows
        share moves by their mean, at most twice as far in steps of more than 256 windows.
        """
        edge, wide = self.side * self.side, text.shape[1]
        size = wide - 2 * GAP
        rate, per = rate * 4, max(1, batch // size)
        for lo in range(0, len(text), per):
            t = text[lo : lo + per]
            w = np.ascontiguousarray(t[:, GAP : GAP + size]).reshape(-1)
            order, w = _in_order(w)
            n = int(np.searchsorted(w, edge))  # edge marks are the last
            if not n:
                continue
            order, w = order[:n], w[:n].astype(np.intp)
            shared = np.float32(rate / n * min(2.0, max(1.0, n / 256) ** 0.5))
            place = order + (order // size * (2 * GAP) + GAP)
            h = self.hidden(t.reshape(-1), place)
            g = np.zeros_like(h)
            # rows are in order of their words, so every choice, and what was chosen before it, comes in runs
            first = _runs(w)
            two = _runs(first[0] // self.narrow, first[1])
            cls = _runs(two[0] // self.wide, two[1])
            one = _runs(cls[0] // self.narrow, cls[1])
            of_cls = np.diff(cls[1], append=n)
            for i, ((row, cut), part) in enumerate(((one, np.repeat(cls[0] % self.narrow, of_cls)), (two, w % self.narrow))):
                gate = np.repeat(self.gate[cls[0]], of_cls, 0) if i else None
                own = gate * h if i else h
                many = np.diff(cut, append=n)
                q, both = self.odds(i, own, np.repeat(self.bias(i, row), many, 0))
                q *= (1 / both) @ self.belongs.T
                for at in self.chosen(q, np.repeat(row % self.wide, many), part):
                    q.reshape(-1)[at] -= 1
                back = q @ self.out[i].T
                self.out[i] -= shared * _product(own, q)
                sums = _sums(q, cut)
                self.second[i][row] -= _steps(many, n, rate) * sums[:, self.wide :]
                if not i:
                    self.first[i][0] -= shared * sums[:, : self.wide].sum(0)
                    g += back
                    continue
                step = _steps(of_cls, n, rate)
                self.first[i][cls[0]] -= step * np.add.reduceat(sums[:, : self.wide], np.searchsorted(cut, cls[1]), axis=0)
                gate *= back
                g += gate
                back *= h
                self.gate[cls[0]] -= step * _sums(back, cls[1])
            h *= h
            g *= 1 - h
            self.lean -= shared * (np.ones(n, np.float32) @ g)
            # each number of a run takes its part in the windows around it: those GAP away at most, none beyond the run
            usual = np.float32(rate / min(n, UNIT))
            all_g = np.zeros((t.size + 2 * GAP + 1, DIM), np.float32)
            all_g[place + GAP] = g * usual
            order, word = _in_order(t.reshape(-1))
            row, cut = _runs(word)
            ahead = np.array([GAP - d for d in REACH])
            for some, many, at, member in _by_length(cut, order):
                rows = all_g.take(at[..., None] + ahead, 0).reshape(*at.shape, -1)
                sums = rows.sum(1) if member is None else member @ rows
                step = _steps(many, n, rate) / usual
                if step.min() < 1:
                    sums *= step
                self.context[row[some]] -= sums.reshape(-1, len(REACH), DIM)


def _in_order(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(number, kind="stable")
    return order, number[order]


def _runs(number: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The runs of equal numbers: their number, and where they begin; with ``cut``, each number stands for a run that begins there."""
    new = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return number[new].astype(np.intp), new if cut is None else cut[new]


def _steps(many: np.ndarray, n: int, rate: float) -> np.ndarray:
    """The step of runs of so many rows, for each of a batch's ``n`` windows."""
    return (rate / np.maximum(min(n, UNIT), many / CROWD)).astype(np.float32)[:, None]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b`` of two long narrow tables, by blocks of rows that stay in the cache."""
    whole = len(a) // 256 * 256
    parts = np.matmul(a[:whole].reshape(-1, 256, a.shape[1]).swapaxes(1, 2), b[:whole].reshape(-1, 256, b.shape[1]))
    return parts.sum(0) + a[whole:].T @ b[whole:]


def _pairs(a: np.ndarray) -> np.ndarray:
    """Neighbouring floats as one complex number: sums take half as many additions."""
    return a.view(np.complex64)


def _sums(a: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.add.reduceat(_pairs(a), cut, axis=0).view(np.float32)


def _by_length(cut: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Runs of entries of ``order``, by their lengths: which runs, how long they are, and their entries. Runs of up to ``LONG`` are rows of one width,
    filled up with the number behind all entries; longer ones come end to end, a few at a time, with the zeros and ones whose product adds them up."""
    many = np.diff(cut, append=len(order))
    padded = np.concatenate([order, np.full(LONG, len(order))])
    wide = 1
    while wide <= LONG:
        some = np.flatnonzero((many > wide // 2) & (many <= wide))
        if len(some):
            size, inner = many[some], np.arange(wide)
            at = padded.take(cut[some][:, None] + inner)
            at[inner >= size[:, None]] = len(order)
            yield some, size, at, None
        wide *= 2
    long = np.flatnonzero(many > LONG)
    for lo in range(0, len(long), LONG):
        some = long[lo : lo + LONG]
        size = many[some]
        of = np.repeat(np.arange(len(some)), size)
        member = (of == np.arange(len(some))[:, None]).astype(np.float32)
        yield some, size, order[np.repeat(cut[some] - (np.cumsum(size) - size), size) + np.arange(len(of))], member


def side_for(n_words: int) -> int:
    """Classes, and words in a class, for a corpus of so many words: the power of two at or above their fourth root, at least ``SIDE``."""
    side = SIDE
    while side**4 < n_words:
        side *= 2
    return side


class Vocabulary:
    """Word hashes by rank; a rare word's number is in the last class, by its hash."""

    def __init__(self, hashes: np.ndarray, side: int = SIDE):
        self.side, self.known = side, side * side - side
        keep = hashes[: self.known].astype(np.uint64)
        order = np.argsort(keep)
        self.hash, self.number = np.append(keep[order], np.uint64(0)), np.append(order.astype(np.int32), np.int32(0))
        # words whose hashes begin alike lie side by side: where they start, by their first 20 bits
        self.start = np.searchsorted(self.hash[:-1] >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        out = (self.known + (h % np.uint64(self.side)).astype(np.int64)).astype(np.int32)
        slot = (h >> np.uint64(44)).astype(np.int64)
        at = self.start.take(slot)
        stop = self.start.take(slot + 1)
        left = np.flatnonzero(at < stop)
        at, stop = at[left], stop[left]
        while len(left):
            hit = self.hash.take(at) == h[left]
            out[left[hit]] = self.number[at[hit]]
            at += 1
            more = ~hit & (at < stop)
            left, at, stop = left[more], at[more], stop[more]
        return out


def chained(w: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the chosen words, a 0 behind each, and where each word begins (one more entry)."""
    size = w.end[chosen] - w.start[chosen] + 1
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.append(w.buf, np.uint8(0)).take(np.repeat(w.start[chosen] - first[:-1], size) + np.arange(first[-1]))
    out[first[1:] - 1] = 0
    return out, first


def _pairs_of(chain: np.ndarray) -> np.ndarray:
    """Every byte of a chain with the one before it; 0 before the first."""
    pair = chain.astype(np.uint16)
    pair[1:] += chain[:-1].astype(np.uint16) << 8
    return pair


def pair_counts(w: Words, chosen: np.ndarray) -> np.ndarray:
    """How often a byte follows another in the chosen words, 256 x 256; byte 0 is the border of a word."""
    return np.bincount(_pairs_of(chained(w, chosen)[0]), minlength=1 << 16)


class Spelling:
    """P(word) as a chain of byte pairs; over all words the probabilities add up to 1."""

    def __init__(self, counts: np.ndarray):
        may = np.append(True, _WORD[1:])
        p = np.where(may, counts.reshape(256, 256) + 0.01, 0.0)
        p[0, 0] = 0  # no word is empty
        with np.errstate(divide="ignore"):
            self.log = np.log(p / p.sum(1, keepdims=True))

    def sums(self, chain: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The log-probability of each part of a chain of whole words, a 0 behind each."""
        run = np.concatenate([[0.0], np.cumsum(self.log.reshape(-1).take(_pairs_of(chain)))])
        return run[first[1:]] - run[first[:-1]]

    def log_probs(self, w: Words) -> np.ndarray:
        return self.sums(*chained(w, np.arange(len(w.start))))


def kind_of(side: int) -> type:
    """The narrowest type that holds word numbers and the edge mark."""
    return np.uint16 if side <= 255 else np.int32


def laid_out(number: np.ndarray, first: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of several notes with ``GAP`` edge marks around each note and ``RUN`` more behind all, and where each word lies."""
    count = np.diff(first)
    place = np.arange(len(number)) + GAP * np.repeat(np.arange(1, len(count) + 1), count)
    text = np.full(len(number) + GAP * (len(count) + 1) + RUN, side * side, kind_of(side))
    text[place] = number
    return text, place


def runs(text: np.ndarray, size: int) -> np.ndarray:
    """The runs of a laid out text that hold every word once in their middle, as views."""
    return np.lib.stride_tricks.sliding_window_view(text, size + 2 * GAP)[::size]


def word_counts(notes: DataFrame) -> DataFrame:
    """(word hash, count) over all notes; counts are summed in each task before the shuffle."""

    def out(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in slices(batches, 0):
            new, many = np.unique(Words(b.column(0)).hash, return_counts=True)
            h, n = np.concatenate([h, new]), np.concatenate([n, many])
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else order
            h, n = h[cut], np.add.reduceat(n, cut) if len(h) else n
            if len(h) > 1 << 20:
                yield out(h, n)
                h, n = h[:0], n[:0]
        yield out(h, n)

    return notes.select("notes").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def numbered(notes: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The notes as lists of word numbers (``record_id``, ``numbers``), and beside them the byte pairs of all rare words (``pair``, ``n``), which
    each task counts: at most 65,536 rows of a task, without numbers."""
    kind = np.dtype(kind_of(vocab.side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in slices(batches):
            w = Words(b.column(1))
            number = vocab.numbers(w.hash)
            total += pair_counts(w, np.flatnonzero(number >= vocab.known))
            lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer((w.first * kind.itemsize).astype(np.int64)), pa.py_buffer(number.astype(kind))])
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), lists.cast(pa.binary()), none, none], names=["record_id", "numbers", "pair", "n"])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(total[at])], names=["record_id", "numbers", "pair", "n"])

    return notes.mapInArrow(run, "record_id long, numbers binary, pair long, n long")


def numbers_of(lists: pa.Array, side: int) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of several notes, and where each note's begin (one more entry)."""
    kind = np.dtype(kind_of(side))
    first = np.concatenate([[0], np.cumsum(pc.binary_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))]) // kind.itemsize
    lists = lists.cast(pa.large_binary())
    start = int(np.frombuffer(lists.buffers()[1], np.int64)[lists.offset])
    data = lists.buffers()[2]
    return np.frombuffer(data, kind, int(first[-1]), start) if first[-1] else np.zeros(0, kind), first


def steps_of(seen: int) -> int:
    """Windows in a step: 256 at first, more and more of them (up to 4,096) as a trainer has seen more."""
    return 1 << min(12, max(8, (seen // 64).bit_length() - 1))


def note_likelihoods(notes: DataFrame, record_id: str = "record_id", text: str = "notes", share: float = 1.0, passes: int = 2, shard_windows: int = 200_000, seed: int = 5) -> DataFrame:
    """Score every whole note by the pseudo-log-likelihood of its words.

    Returns ``record_id``, ``n_words``, ``log_likelihood`` (sum over words of log P(word | words around it); 0 for a note without words) and
    ``per_word`` (its mean, null without words). All windows of the corpus (with ``share`` below 1, a part drawn by note
    id, word and place) train the network, note by note dealt to trainers of about ``shard_windows`` windows each, or four for each weight if that is more; each of ``passes`` passes ends with an average of all trainers' weights,
    weighted by their windows.

    Null and empty notes have no words. Repeated rows are scored each for itself; a null id stays null. Without any word in the corpus all
    scores are 0. Other columns are not read. Rare words are scored by their spelling.
    """
    src = notes.select(F.col(record_id).cast("long").alias("record_id"), F.col(text).cast("string").alias("notes"))
    counts = materialise(word_counts(src))
    n = counts.agg(F.sum("n")).first()[0] or 0
    side = side_for(n)
    top = [r[0] for r in counts.orderBy(F.col("n").desc(), "word").limit(side * side - side).collect()]  # the square root of the number of words
    vocab = Vocabulary(np.array(top, np.int64).view(np.uint64), side)
    lists = materialise(numbered(src.filter("notes is not null"), vocab))
    pairs = np.zeros(1 << 16)
    for r in lists.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 65,536 rows
        pairs[r[0]] = r[1]
    spelling = Spelling(pairs)
    net = Network(seed, side)
    size = len(net.flat())
    shards = max(1, -(-int(n * share) // max(shard_windows, 4 * size)))
    limit = int(share * 2**32)
    for turn in range(passes if n else 0):
        now = net.flat()

        def fit(batches: Iterator[pa.RecordBatch], now: np.ndarray = now, turn: int = turn) -> Iterator[pa.RecordBatch]:
            own, seen = Network.of(now, side), 0
            for b in slices(batches):
                number, first = numbers_of(b.column(1), side)
                if share < 1:
                    count = np.diff(first)
                    note = b.column(0).fill_null(-1).to_numpy().astype(np.int64).view(np.uint64)
                    draw = mix(number.astype(np.uint64) + mix(np.repeat(note, count) + mix((np.arange(len(number)) - np.repeat(first[:-1], count)).astype(np.uint64) + np.uint64(seed))))
                text, place = laid_out(number, first, side)
                around = runs(text, RUN) if share == 1 else np.lib.stride_tricks.sliding_window_view(text, 1 + 2 * GAP)[place[(draw >> np.uint64(32)) < limit] - GAP]
                at = np.random.default_rng(seed + turn).permutation(len(around))
                lo = 0
                while lo < len(at):
                    step = steps_of(seen)
                    part = around[at[lo : lo + max(1, 16 * step // (around.shape[1] - 2 * GAP))]]
                    own.fit(part, 0.25 / (1 + turn), step)
                    lo += len(part)
                    seen += int((part[:, GAP:-GAP] != side * side).sum())
            flat = own.flat()
            for i in range(-(-size // RANGE) if seen else 0):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([seen], pa.int64()), pa.array([flat[i * RANGE : (i + 1) * RANGE].tobytes()], pa.binary())], names=["part", "n", "weights"])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            seen: dict[int, int] = {}
            for b in batches:
                for i, k, weights in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    x = np.frombuffer(weights, np.float32).astype(float) * k
                    total[i] = total[i] + x if i in total else x
                    seen[i] = seen.get(i, 0) + k
            for i, x in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([(x / seen[i]).astype(np.float32).tobytes()], pa.binary())], names=["part", "weights"])

        order = F.xxhash64("record_id", "numbers", F.lit(turn))
        dealt = lists.filter("numbers is not null").select("record_id", "numbers", order.alias("order"))
        dealt = dealt.repartitionById(shards, F.pmod("order", F.lit(shards)).cast("int")).sortWithinPartitions("order", "record_id", "numbers")
        fitted = dealt.mapInArrow(fit, "part int, n long, weights binary")
        parts = -(-size // RANGE)
        sums = fitted.repartitionById(parts, "part").mapInArrow(add_up, "part int, weights binary")
        mean = net.flat()  # with a share of no window, nothing moves
        for i, x in sums.toLocalIterator():  # one network in all
            mean[i * RANGE : (i + 1) * RANGE] = np.frombuffer(bytes(x), np.float32)
        net = Network.of(mean, side)
    weights = net.flat()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.of(weights, side)
        for b in slices(batches):
            w = Words(b.column(1))
            number = vocab.numbers(w.hash)
            text, place = laid_out(number, w.first, side)
            lp = np.empty(len(number))
            for lo in range(0, len(number), PASS_ROWS):
                part = slice(lo, lo + PASS_ROWS)
                lp[part] = own.log_probs_of(own.hidden(text, place[part]), number[part], 0.0)
            rare = np.flatnonzero(number >= vocab.known)
            lp[rare] += spelling.sums(*chained(w, rare))
            run = np.concatenate([[0.0], np.cumsum(lp)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.count.astype(np.int64)), pa.array(run[w.first[1:]] - run[w.first[:-1]])], names=["record_id", "n_words", "log_likelihood"])

    if not n:
        return src.mapInArrow(_unscored, "record_id long, n_words long, log_likelihood double").withColumn("per_word", F.lit(None).cast("double"))
    out = src.mapInArrow(score, "record_id long, n_words long, log_likelihood double")
    return out.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def _unscored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(Words(b.column(1)).count.astype(np.int64)), pa.array(np.zeros(b.num_rows))], names=["record_id", "n_words", "log_likelihood"])
