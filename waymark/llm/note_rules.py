"""Quality rules on reviewers' notes, as a short-circuit cascade.

Every note gets its base counts. The rules beyond them form a cascade: a rule sees only the notes that passed all rules before it, so the order
decides what the cascade costs, and only that: a note is kept if no rule fails it, in any order. The order is chosen on a sample. Each rule is
timed on it and the set of rules that fails each sampled note is counted; then the rule that rejects the most of what is still there for its
time goes next, again and again, so rules that reject the same notes do not both count for them.

Words are maximal runs of bytes other than ASCII white space (space and 0x09 to 0x0D). All counts are exact: words, lines and word windows are
numbered by their bytes, not by hashes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import raw_bytes, slices

WINDOW = 8
SAMPLE_ROWS = 4000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SMALL = np.zeros(256, bool)
_SMALL[ord("a") : ord("z") + 1] = True


def numbered(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each byte range of ``buf`` (ascending, not overlapping), equal for equal bytes."""
    size = end - start
    edge = np.zeros(len(buf) + 1, np.int8)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    data = buf[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return parts.dictionary_encode().indices.to_numpy()


@dataclass
class Notes:
    """A slice of notes: raw bytes, where each note starts, and the base counts."""

    texts: pa.Array
    counts: dict[str, np.ndarray]
    _made: dict = field(default_factory=dict)

    def take(self, rows: np.ndarray) -> Notes:
        return self if len(rows) == len(self.texts) else Notes(self.texts.take(pa.array(rows)), {k: v[rows] for k, v in self.counts.items()})

    def _lazy(self, name: str, make: Callable):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def raw(self) -> tuple[np.ndarray, np.ndarray]:
        return self._lazy("raw", lambda: raw_bytes(self.texts))

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word and where each note's words start."""

        def make():
            buf, off = self.raw
            inside = ~_SPACE[buf]
            begins, ends = inside.copy(), inside.copy()
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            row, last = off[:-1][off[:-1] < len(buf)], off[1:][off[1:] > 0] - 1
            begins[row], ends[last] = inside[row], inside[last]
            start = np.flatnonzero(begins)
            return start, np.flatnonzero(ends) + 1, np.searchsorted(start, off)

        return self._lazy("words", make)

    @property
    def word_numbers(self) -> np.ndarray:
        return self._lazy("numbers", lambda: numbered(self.raw[0], *self.words[:2]))

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and note of every line that holds a word."""

        def make():
            buf, off = self.raw
            cut = np.flatnonzero(buf == 10)
            start, end = np.sort(np.concatenate([off[:-1], cut + 1])), np.sort(np.concatenate([cut, off[1:]]))
            first = self.words[0]
            live = np.searchsorted(first, end) > np.searchsorted(first, start)
            start, end = start[live], end[live]
            return start, end, np.searchsorted(off, start, side="right") - 1

        return self._lazy("lines", make)

    def per_note(self, marked: np.ndarray) -> np.ndarray:
        """How many marked bytes each note has."""
        return _sums(marked, self.raw[1])

    def per_note_words(self, marked: np.ndarray) -> np.ndarray:
        return _sums(marked, self.words[2])

    def per_note_lines(self, marked: np.ndarray) -> np.ndarray:
        return np.bincount(self.lines[2][marked], minlength=len(self.texts))


def _sums(marked: np.ndarray, edges: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
    return np.diff(run[edges])


def repeated_words(number: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each note that lie in a window of ``window`` words (a power of two) found twice or more in the note.

    Windows are numbered by doubling: a run of 2k words is the pair of the numbers of its two halves.
    """
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    left = first[1:][row] - np.arange(len(number))
    rank, k = number.astype(np.int64), 1
    while k < window:
        at = np.flatnonzero(left >= 2 * k)
        if not len(at):
            return np.zeros(len(n), np.int64)
        _, pair = np.unique(rank[at] * (rank.max() + 1) + rank[at + k], return_inverse=True)
        rank = np.zeros(len(number), np.int64)
        rank[at], k = pair, 2 * k
    at = np.flatnonzero(left >= window)
    _, where, many = np.unique(rank[at] * len(n) + row[at], return_inverse=True, return_counts=True)
    hit = at[many[where] > 1]
    edge = np.zeros(len(number) + 1, np.int32)
    edge[hit] += 1
    edge[hit + window] -= 1
    return _sums(np.cumsum(edge[:-1]) > 0, first)


def counted(texts: pa.Array) -> Notes:
    """Base counts of every note."""
    notes = Notes(texts, {})
    buf, off = notes.raw
    start, end, first = notes.words
    point = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)])
    chars = np.concatenate([[0], np.cumsum(point[end] - point[start])])
    l_start, l_end, l_row = notes.lines
    n_lines = np.bincount(l_row, minlength=len(texts))
    distinct = np.zeros(len(texts), np.int64)
    if len(l_start):
        own = np.unique(numbered(buf, l_start, l_end).astype(np.int64) * len(texts) + l_row)
        distinct = np.bincount(own % len(texts), minlength=len(texts))
    notes.counts = {
        "n_words": np.diff(first), "word_chars": np.diff(chars[first]), "n_symbols": notes.per_note(_SYMBOL[buf]), "n_dup_lines": n_lines - distinct,
        "n_repeat_words": repeated_words(notes.word_numbers, first), "n_lines": n_lines,
    }
    return notes


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_fails(c: dict[str, np.ndarray]) -> np.ndarray:
    """Under 20 words, or more than 30 % of the words in repeated windows."""
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


@dataclass(frozen=True)
class Rule:
    """A rule's name and the function that tells which notes of a slice fail it. Notes reach rules only if they have a word."""

    name: str
    fails: Callable[[Notes], np.ndarray]


def _word_length(t: Notes) -> np.ndarray:
    """Mean word length outside 3 to 12 code points."""
    return (t.counts["word_chars"] < 3 * t.counts["n_words"]) | (t.counts["word_chars"] > 12 * t.counts["n_words"])


def _symbols(t: Notes) -> np.ndarray:
    """More than one symbol for ten words."""
    return 10 * t.counts["n_symbols"] > t.counts["n_words"]


def _repeated_lines(t: Notes) -> np.ndarray:
    """More than half of the lines equal an earlier one."""
    return 2 * t.counts["n_dup_lines"] > t.counts["n_lines"]


def _capitals(t: Notes) -> np.ndarray:
    """More than half of the ASCII letters are capitals."""
    buf = t.raw[0]
    capital = t.per_note(_CAPITAL[buf])
    return capital > t.per_note(_SMALL[buf])


def _exclaiming(t: Notes) -> np.ndarray:
    """More than one exclamation mark for five words."""
    return 5 * t.per_note(t.raw[0] == ord("!")) > t.counts["n_words"]


def _letterless(t: Notes) -> np.ndarray:
    """Fewer than 80 % of the words hold a letter (ASCII letters and all characters beyond ASCII count)."""
    buf = t.raw[0]
    start, end, _ = t.words
    run = np.concatenate([[0], np.cumsum(_CAPITAL[buf] | _SMALL[buf] | (buf >= 0x80), dtype=np.int64)])
    return 100 * t.per_note_words(run[end] > run[start]) < 80 * t.counts["n_words"]


def _unfinished(t: Notes) -> np.ndarray:
    """More than 30 % of the lines end in three dots."""
    buf = t.raw[0]
    start, end, _ = t.lines
    dots = np.concatenate([[0], np.cumsum(buf == ord("."), dtype=np.int64)])
    ends = (end - start >= 3) & (dots[end] - dots[np.maximum(end - 3, 0)] == 3)
    return 100 * t.per_note_lines(ends) > 30 * t.counts["n_lines"]


def _listing(t: Notes) -> np.ndarray:
    """More than 90 % of the lines start with - or *."""
    buf = t.raw[0]
    head = buf[t.lines[0]]
    return 100 * t.per_note_lines((head == ord("-")) | (head == ord("*"))) > 90 * t.counts["n_lines"]


def _one_word(t: Notes) -> np.ndarray:
    """One word makes up more than 30 % of all words."""
    first, n = t.words[2], len(t.texts)
    row = np.repeat(np.arange(n), np.diff(first))
    key, many = np.unique(t.word_numbers.astype(np.int64) * n + row, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, key % n, many)
    return 100 * most > 30 * t.counts["n_words"]


def _stuttering(t: Notes) -> np.ndarray:
    """More than 30 % of the words equal the word before them."""
    number, first = t.word_numbers, t.words[2]
    same = np.append(False, number[1:] == number[:-1])[: len(number)]
    same[first[:-1][first[:-1] < len(number)]] = False
    return 100 * t.per_note_words(same) > 30 * t.counts["n_words"]


RULES = (
    Rule("word_length", _word_length), Rule("symbols", _symbols), Rule("repeated_lines", _repeated_lines), Rule("capitals", _capitals),
    Rule("exclaiming", _exclaiming), Rule("letterless", _letterless), Rule("unfinished", _unfinished), Rule("listing", _listing), Rule("one_word", _one_word), Rule("stuttering", _stuttering),
)


def cheapest_order(masks: dict[int, int], cost: Sequence[float]) -> list[int]:
    """Rules by rejection per cost. ``masks`` counts sampled notes by the set of rules that fail them (bit i: rule i).

    Greedy: each next rule is the one with the most notes rejected, of those no earlier rule rejects, per unit of cost; rules that reject nothing
    more come last, the cheapest first, and ties go to the smaller number.
    """
    left, order = dict(masks), []
    rest = set(range(len(cost)))
    while rest:
        def gain(r: int) -> tuple[float, float, int]:
            return (-sum(n for m, n in left.items() if m >> r & 1) / max(cost[r], 1e-12), cost[r], r)

        best = min(rest, key=gain)
        order.append(best)
        rest.remove(best)
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return order


def cascade(notes: Notes, rules: Sequence[Rule]) -> np.ndarray:
    """The number of the first rule that fails each note: -1 for base failures, ``len(rules)`` for notes that none fails."""
    first = np.where(base_fails(notes.counts), -1, len(rules))
    for i, rule in enumerate(rules):
        alive = np.flatnonzero(first == len(rules))
        if not len(alive):
            break
        notes_left = notes.take(alive)
        first[alive[rule.fails(notes_left)]] = i
    return first


def choose_order(notes: DataFrame, text: str, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> list[Rule]:
    """The cascade's order, from about ``sample_rows`` rows. Tasks return times and counts of failing sets only, no text."""
    total = notes.count()
    if not total or len(rules) < 2:
        return list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent = np.zeros(len(rules))
        many: dict[int, int] = {}
        for b in slices(batches, 0):
            all_notes = counted(b.column(0))
            live = all_notes.take(np.flatnonzero(~base_fails(all_notes.counts)))
            if not len(live.texts):
                continue
            mask = np.zeros(len(live.texts), np.int64)
            for i, rule in enumerate(rules):
                alone = Notes(live.texts, live.counts)
                t0 = time.perf_counter()
                mask |= rule.fails(alone).astype(np.int64) << i
                spent[i] += time.perf_counter() - t0
            for m, n in zip(*np.unique(mask, return_counts=True), strict=True):
                many[int(m)] = many.get(int(m), 0) + int(n)
        if many:
            yield pa.RecordBatch.from_pydict({
                "rule": pa.array([*range(len(rules)), *[None] * len(many)], pa.int32()), "mask": pa.array([*[None] * len(rules), *many], pa.int64()),
                "n": pa.array([0] * len(rules) + list(many.values()), pa.int64()), "spent": pa.array([*spent.tolist(), *[0.0] * len(many)], pa.float64())})

    drawn = notes.select(F.col(text).cast("string").alias("t")).sample(min(1.0, sample_rows / total), seed)
    seen = drawn.mapInArrow(run, "rule int, mask long, n long, spent double").groupBy("rule", "mask").agg(F.sum("n").alias("n"), F.sum("spent").alias("spent")).collect()
    cost = [0.0] * len(rules)
    for r in seen:
        if r["rule"] is not None:
            cost[r["rule"]] = r["spent"]
    return [rules[i] for i in cheapest_order({r["mask"]: r["n"] for r in seen if r["rule"] is None}, cost)]


def judge_notes(
    notes: DataFrame, record_id: str = "record_id", text: str = "notes", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Base counts and verdict of every note: record_id, the counts of ``BASE`` (long), base_failed, kept, failed_rule.

    kept is false if the base counts fail or a rule does. failed_rule names the first rule of the cascade that failed the note ("base" for the
    base counts, null if kept); which of several failing rules comes first depends on the order chosen on the sample, kept does not.
    ``sample_rows`` bounds the rows that are drawn to choose that order (at most 63 rules); all else covers all rows and whole texts.

    A null or empty note has counts of zero and fails the base. Repeated rows are judged each for itself; null ids are passed on; an empty table
    gives an empty result; other columns are not read. A task holds one slice of 4 MB of text or one longer note, at up to 60 bytes a byte.
    """
    if len(rules) > 63:
        raise ValueError("at most 63 rules")
    kind = dict(notes.dtypes)[record_id]
    ordered = choose_order(notes, text, rules, sample_rows)
    names = [r.name for r in ordered]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = pa.array([*names, None, "base"], pa.string())
        for b in slices(batches):
            t = counted(b.column(1))
            first = cascade(t, ordered)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(t.counts[c].astype(np.int64)) for c in BASE], pa.array(first == -1), pa.array(first == len(ordered)),
                 label.take(pa.array(np.where(first < 0, len(ordered) + 1, first)))],
                names=["record_id", *BASE, "base_failed", "kept", "failed_rule"])

    fields = f"record_id {kind}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean, failed_rule string"
    return notes.select(F.col(record_id).alias("record_id"), F.col(text).cast("string").alias("notes")).mapInArrow(run, fields)
