"""Abusive spans in reviewers' notes, by a linear-chain conditional random field.

The field has two states per word (plain, abusive). A word's evidence is a sum of hashed weights: the word itself, its beginnings of three to
seven bytes and its last four bytes. Forward-backward marginals give spans and a note's score.

Training needs labelled words, but only whole notes are labelled, so words are labelled first: features whose presence tells abusive notes from
the others (a likelihood-ratio test over the training notes) mark words of abusive notes; all words of the other notes are plain.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import Words, mix, slices

PREFIXES = (3, 4, 5, 6, 7)
SUFFIX = 4
BITS = 18
LANE = 128


@dataclass
class SpanModel:
    """Weights of the field and of the note score."""

    weight: np.ndarray
    bias: float
    turn: np.ndarray
    score: np.ndarray


def features(words: Words) -> Iterator[np.ndarray]:
    """The hashed features of every word, one kind at a time; 0 stands for "absent"."""
    size = words.end - words.start
    yield words.hash
    for k, h, longer in words.prefixes(max(PREFIXES)):
        if k in PREFIXES:
            yield np.where(longer, mix(h + np.uint64(k)), 0)
    yield np.where(size > SUFFIX, mix(words.suffix(SUFFIX) + np.uint64(99)), 0)


def _slot(f: np.ndarray) -> np.ndarray:
    return np.where(f == 0, 0, (f >> np.uint64(64 - BITS)) | np.uint64(1)).astype(np.int32)


def marginals(evidence: np.ndarray, first: np.ndarray, turn: np.ndarray, counts: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """P(abusive) of every word, and the expected numbers of changes into "abusive" from either state.

    Two states leave one ratio per word, r = P(abusive) / P(plain), and r' = g (m0 + m1 r) / (1 + r) going forward, where g is the word's
    evidence. The chain of each note is cut into lanes of ``LANE`` words that are walked side by side: one pass composes each lane's map,
    a short pass over lanes joins those of one note, and a forward and a backward pass fill in the words. Cost follows the number of words,
    whatever the longest note is.
    """
    n = np.diff(first)
    lanes = -(-n // LANE)
    lane_row = np.repeat(np.arange(len(n)), lanes)
    lane_no = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = first[:-1][lane_row] + lane_no * LANE
    size = np.minimum(first[1:][lane_row] - begin, LANE)
    many = len(begin)
    p = np.zeros(len(evidence))
    change = np.zeros(2)
    if not many:
        return p, change
    at = begin + np.arange(LANE)[:, None]
    live = np.arange(LANE)[:, None] < size
    g = np.exp(np.clip(evidence, -30, 30))[np.where(live, at, 0)]
    m0, m1 = np.exp(turn)
    a, b, c, d = np.ones(many), np.zeros(many), np.zeros(many), np.ones(many)
    for t in range(LANE):
        nc, nd = a + c, b + d
        na, nb = g[t] * (m1 * a + m0 * c), g[t] * (m1 * b + m0 * d)
        on, scale = live[t], 1 / (nc + nd)
        a, b, c, d = np.where(on, na * scale, a), np.where(on, nb * scale, b), np.where(on, nc * scale, c), np.where(on, nd * scale, d)
    enter, leave = np.zeros(many), np.ones(many)
    by_no = np.argsort(lane_no, kind="stable")
    cut = np.searchsorted(lane_no[by_no], np.arange(int(lane_no.max()) + 2))
    for k in range(1, len(cut) - 1):
        q = by_no[cut[k] : cut[k + 1]] - 1
        enter[q + 1] = (a[q] * enter[q] + b[q]) / (c[q] * enter[q] + d[q])
    for k in range(len(cut) - 2, 0, -1):
        q = by_no[cut[k] : cut[k + 1]]
        leave[q - 1] = (c[q] + a[q] * leave[q]) / (d[q] + b[q] * leave[q])
    r = np.empty((LANE, many))
    cur = enter
    for t in range(LANE):
        cur = g[t] * (m0 + m1 * cur) / (1 + cur)
        r[t] = cur
    back, out = leave, np.empty((LANE, many))
    for t in range(LANE - 1, -1, -1):
        both = r[t] * back
        out[t] = both / (1 + both)
        seen = g[t] * back
        if counts:
            before = enter if t == 0 else r[t - 1]
            w0, w1 = m0 * seen, before * m1 * seen
            total = 1 + before + w0 + w1
            change += [(w0 / total)[live[t]].sum(), (w1 / total)[live[t]].sum()]
        back = np.where(live[t], (1 + m1 * seen) / (1 + m0 * seen), back)
    p[at[live]] = out[live]
    return p, change


def _evidence(words: Words, weight: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(words.start), bias)
    for f in features(words):
        out += weight[_slot(f)]
    return out


def _word_labels(words: Words, row: np.ndarray, y: np.ndarray, gain: float, odds: float) -> np.ndarray:
    """1 for words of abusive notes that carry a telling feature."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    marked = np.zeros(len(row), bool)
    for f in features(words):
        have = f != 0
        value, doc = f[have], row[have]
        _, once = np.unique(mix(value + mix(doc.astype(np.uint64))), return_index=True)
        value, doc = value[once], doc[once]
        value, where = np.unique(value, return_inverse=True)
        pos = np.bincount(where, weights=y[doc], minlength=len(value))
        neg = np.bincount(where, minlength=len(value)) - pos
        e1 = (pos + neg) * n1 / max(1, n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * (np.where(pos > 0, pos * np.log(pos / e1), 0) + np.where(neg > 0, neg * np.log(neg / (pos + neg - e1)), 0))
        ratio = ((pos + 0.5) / (n1 + 1)) / ((neg + 0.5) / (n0 + 1))
        telling = value[(g >= gain) & (ratio >= odds)]
        marked |= np.isin(f, telling)
    return (marked & (y[row] == 1)).astype(float)


def _note_inputs(p: np.ndarray, first: np.ndarray, floor: float = 0.2) -> np.ndarray:
    """Constant, log of the expected number of abusive words, log odds of the likeliest word, log share. Words below ``floor`` count as plain."""
    n = np.diff(first)
    total = np.concatenate([[0], np.cumsum(np.where(p >= floor, p, 0))])
    expected = total[first[1:]] - total[first[:-1]]
    top = np.zeros(len(n))
    some = n > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, first[:-1][some])
    top = np.clip(top, 1e-2, 1 - 1e-3)
    expected = np.maximum(expected, 0)
    return np.stack([np.ones(len(n)), np.log(expected + 0.25), np.log(top / (1 - top)), np.log((expected + 0.05) / (n + 20))], axis=1)


def train(notes: list[str | None], y: np.ndarray, base_rate: float, epochs: int = 15, rate: float = 0.5, l2: float = 1e-6, gain: float = 25.0, odds: float = 12.0) -> SpanModel:
    """Fit the field by Adagrad on its log-likelihood and the note score by Newton steps; ``base_rate`` corrects the share of abusive notes in
    the sample."""
    words = Words(pa.array(notes, pa.string()))
    row, first = words.row_of_word(), words.first
    y = np.asarray(y, float)
    label = _word_labels(words, row, y, gain, odds)
    slots = [_slot(f) for f in features(words)]
    w, bias, turn = np.zeros(1 << BITS), -4.0, np.zeros(2)
    gw, gb, gt = np.full(1 << BITS, 1e-2), 1e-2, np.full(2, 1e-2)
    prev = np.concatenate([[0.0], label[:-1]]) if len(label) else label
    prev[first[:-1][np.diff(first) > 0]] = 0.0
    truth = np.array([((1 - prev) * label).sum(), (prev * label).sum()])
    scale = max(1.0, label.sum())
    for _ in range(epochs if len(label) else 0):
        ev = np.full(len(label), bias)
        for s in slots:
            ev += w[s]
        p, change = marginals(ev, first, turn)
        d = (label - p) / scale
        g = -l2 * w
        for s in slots:
            g += np.bincount(s, weights=d, minlength=1 << BITS)
        g[0] = 0
        gw += g * g
        w += rate * g / np.sqrt(gw)
        b = d.sum()
        gb += b * b
        bias += rate * b / np.sqrt(gb)
        t = (truth - change) / scale
        gt += t * t
        turn += rate * t / np.sqrt(gt)
    w[0] = 0
    p, _ = marginals(_evidence(words, w, bias), first, turn, False)
    x = _note_inputs(p, first)
    theta = _logistic(x, y)
    drawn = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    rate_ = np.clip(base_rate, 1e-3, 1 - 1e-3)
    theta[0] += np.log(rate_ / (1 - rate_)) - np.log(drawn / (1 - drawn))
    return SpanModel(w.astype(np.float32), float(bias), turn, theta)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Coefficients of a ridge logistic regression (none on the constant), by Newton steps that are halved until they help."""
    pull = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))

    def loss(t: np.ndarray) -> float:
        z = x @ t
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * t @ pull @ t)

    theta = np.zeros(x.shape[1])
    now = loss(theta)
    for _ in range(50 if len(y) else 0):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + pull, x.T @ (y - q) - pull @ theta)
        size = 1.0
        while size > 1e-6 and loss(theta + size * step) > now:
            size /= 2
        new = loss(theta + size * step)
        if now - new < 1e-9 * (1 + abs(now)):
            break
        theta, now = theta + size * step, new
    return theta


def apply(model: SpanModel, texts: pa.Array, least: float = 0.5) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores and spans (code-point offsets, end exclusive) of notes."""
    words = Words(texts)
    ev = _evidence(words, model.weight, model.bias)
    p, _ = marginals(ev, words.first, model.turn, False)
    score = 1 / (1 + np.exp(-np.clip(_note_inputs(p, words.first) @ model.score, -30, 30)))
    hit = np.flatnonzero(p >= least)
    spans: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
    if len(hit):
        row = np.searchsorted(words.first, hit, side="right") - 1
        chars = words.char_offsets()
        base = chars[words.off[row]]
        # neighbouring abusive words of one note are one span
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (row[1:] != row[:-1])
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(hit)) - 1
        best = np.maximum.reduceat(p[hit], head)
        for k in range(group[-1] + 1):
            i, j = head[k], tail[k]
            spans[row[i]].append({"start": int(chars[words.start[hit[i]]] - base[i]), "end": int(chars[words.end[hit[j]]] - base[j]), "p": float(best[k])})
    return score, spans


def training_notes(notes: DataFrame, labels: DataFrame, record_id: str, text: str, label: str, sample: int) -> tuple[list[str | None], np.ndarray, float]:
    """At most ``sample`` labelled notes, half of each kind where there are enough, in a fixed pseudo-random order of their ids; and the share of abusive notes among all labelled rows."""
    known = labels.select(F.col(record_id).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    rate = known.agg(F.avg("_y")).first()[0]
    ids = None
    for v in (0, 1):
        part = known.filter(F.col("_y") == v).orderBy(F.xxhash64("_id"), "_id").limit(sample // 2)
        ids = part if ids is None else ids.unionAll(part)
    picked = {r[0]: r[1] for r in ids.collect()}  # at most ``sample`` rows
    drawn = notes.select(F.col(record_id).alias("_id"), F.col(text).alias("_t")).filter(F.col("_id").isin(list(picked)) if picked else F.lit(False))
    rows = sorted(drawn.dropDuplicates(["_id"]).collect())
    return [r[1] for r in rows], np.array([picked[r[0]] for r in rows], float), 0.1 if rate is None else float(rate)


def fitted(spark: SparkSession, texts: list[str | None], y: np.ndarray, rate: float) -> SpanModel:
    """``train`` in one task, so that the driver holds the drawn notes and the model but none of the training's arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = train(texts, y, rate)
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(m)], pa.binary())})

    return pickle.loads(spark.range(1).coalesce(1).mapInArrow(run, "model binary").first()[0])


OUT = "record_id long, score double, n_spans int, spans array<struct<start: int, end: int, p: double>>"


def score_notes(notes: DataFrame, labels: DataFrame, record_id: str = "record_id", text: str = "notes", label: str = "abusive", sample: int = 2000, least: float = 0.5) -> DataFrame:
    """Score the whole text of every reviewer's note for abuse and list the offending spans.

    notes: one row per record with its note; labels: (record_id, label 0/1), the rows to learn from. At most ``sample`` labelled notes are
    gathered to fit the field (half of each label); everything is scored. Returns ``record_id``, ``score`` (0 to 1), ``predicted`` (score at
    least 0.5), ``n_spans`` and ``spans``: code-point offsets into the note, end exclusive, with the highest word probability.

    A null or empty note, or one without a word, gets the score of a note without abusive words and no spans. Repeated rows are scored each
    for itself; a null id stays null. Labels that are null or not 0/1 are ignored; without any label all scores are near the prior of 0.1.
    Other columns are not read.
    """
    model = fitted(notes.sparkSession, *training_notes(notes, labels, record_id, text, label, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            score, spans = apply(model, b.column(1), least)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, kind)], names=["record_id", "score", "n_spans", "spans"])

    src = notes.select(F.col(record_id).cast("long").alias("record_id"), F.col(text).cast("string").alias("notes"))
    return src.mapInArrow(run, OUT).select("record_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_spans", "spans")
