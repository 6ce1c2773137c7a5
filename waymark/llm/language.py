"""Language of a note, from averaged hashed subword embeddings and a linear softmax.

A note is the mean of the embeddings of its subwords: all runs of two, three and four bytes that touch a word, with word ends as blanks, hashed
into a fixed table. Embeddings and softmax are trained together by stochastic gradient descent in NumPy on windows of the training notes. A
temperature fitted on notes set aside makes the scores probabilities, and a rejection level fitted on them marks predictions that can't be
relied on.

The model is linear after the mean, so a subword's share of every language's logit is one table row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _WORD, lowered, slices

BITS = 16
DIM = 16
GRAMS = (2, 3, 4)
_MUL = np.uint32(0x9E3779B1)


@dataclass
class LanguageModel:
    """The languages, each subword's share of their logits, the offsets, the temperature and the rejection level."""

    languages: list[str]
    table: np.ndarray
    offset: np.ndarray
    temperature: float
    level: float


def subwords(buf: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Table rows of the runs that begin at or just before each word byte, per run length, and the word bytes' places.

    Bytes outside words read as blanks, and so does what lies beyond a note's end.
    """
    n = len(buf)
    clean = np.where(_WORD[buf], buf, 0x20).astype(np.uint32)
    inside = _WORD[buf]
    at = np.flatnonzero(inside)
    # one blank between notes: shift every note by its number
    row = np.searchsorted(off, at, side="right") - 1
    padded = np.full(n + len(off) + max(GRAMS) + 2, 0x20, np.uint32)
    padded[np.arange(n) + 1 + np.repeat(np.arange(len(off) - 1), np.diff(off))] = clean
    where = at + row  # one before the byte itself
    out = []
    code = padded[where]
    for k in range(1, max(GRAMS)):
        code = (code << np.uint32(8)) + padded[where + k] if k < 4 else code
        if k + 1 in GRAMS:
            out.append(((code * _MUL + np.uint32((k + 1) * 0x85EBCA6B & 0xFFFFFFFF)) * _MUL >> np.uint32(32 - BITS)).astype(np.int64) + (GRAMS.index(k + 1) << BITS))
    return out, at


def _windows(notes: list[str], labels: np.ndarray, width: int, rng: np.random.Generator) -> tuple[list[np.ndarray], np.ndarray]:
    """Training examples: notes cut into windows of about ``width`` bytes, each the table rows of its subwords."""
    buf, off = lowered(pa.array(notes, pa.string()))
    grams, at = subwords(buf, off)
    first = np.searchsorted(at, off)
    rows = np.stack(grams, axis=1) if len(at) else np.zeros((0, len(GRAMS)), np.int64)
    out, y = [], []
    for i in range(len(notes)):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        parts = max(1, (b - a) // width)
        for x in np.array_split(rows[a:b], parts):
            out.append(x.ravel())
            y.append(labels[i])
    order = rng.permutation(len(out))
    return [out[i] for i in order], np.array(y, np.int64)[order]


def train(notes: list[str], labels: list[str], width: int = 200, most_windows: int = 12000, steps: int = 600, rate: float = 20.0, batch: int = 64, seed: int = 3, precision: float = 0.99) -> LanguageModel:
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], np.int64)
    rng = np.random.default_rng(seed)
    aside = rng.random(len(notes)) < 0.2
    if len(notes) < 10:
        aside[:] = False
    n_lang = len(languages)
    emb = rng.normal(0, 0.1, (len(GRAMS) << BITS, DIM)).astype(np.float32)
    out = np.zeros((n_lang, DIM), np.float32)
    offset = np.zeros(n_lang, np.float32)
    xs, ys = _windows([t for t, a in zip(notes, aside, strict=True) if not a], y[~aside], width, rng)
    xs, ys = xs[:most_windows], ys[:most_windows]
    at = 0
    for done in range(steps if len(xs) else 0):
        part = [xs[i % len(xs)] for i in range(at, at + batch)]
        t = ys[np.arange(at, at + batch) % len(xs)]
        at += batch
        size = np.array([len(p) for p in part])
        f = np.concatenate(part)
        mean = np.add.reduceat(emb[f], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0) / size[:, None]
        z = mean @ out.T + offset
        z = np.exp(z - z.max(1, keepdims=True))
        p = z / z.sum(1, keepdims=True)
        p[np.arange(len(t)), t] -= 1
        g = p.astype(np.float32) / len(t)
        step = rate * (1 - done / steps)
        back = (g @ out / size[:, None]) * np.float32(step)
        out -= np.float32(step * 0.1) * (g.T @ mean)
        offset -= np.float32(step * 0.01) * g.sum(0)
        np.subtract.at(emb, f, np.repeat(back, size, axis=0))
    table = (emb @ out.T).astype(np.float32)
    model = LanguageModel(languages, table, offset, 1.0, 0.0)
    if aside.any():
        held = [t for t, a in zip(notes, aside, strict=True) if a]
        z, n = logits(model, pa.array(held, pa.string()))
        z, t = z[n > 0], y[aside][n > 0]
        if len(t):
            def loss(c: float) -> float:
                v = z / c
                v = v - v.max(1, keepdims=True)
                return float(np.mean(np.log(np.exp(v).sum(1)) - v[np.arange(len(t)), t]))

            grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
            model.temperature = float(grid[int(np.argmin([loss(c) for c in grid]))])
            p = _softmax(z / model.temperature)
            top, right = p.max(1), p.argmax(1) == t
            by = np.argsort(-top, kind="stable")
            good = np.cumsum(right[by]) / np.arange(1, len(by) + 1)
            reach = np.flatnonzero(good >= precision)
            model.level = float(top[by][reach[-1]]) if len(reach) else 1.0
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def logits(model: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Logits of every note and how many subwords it has."""
    buf, off = lowered(texts)
    grams, at = subwords(buf, off)
    first = np.searchsorted(at, off)
    n = np.diff(first)
    total = np.zeros((len(n), len(model.languages)))
    some = np.flatnonzero(n)
    if len(some):
        share = model.table[grams[0]]
        for g in grams[1:]:
            share += model.table[g]
        total[some] = np.add.reduceat(share.astype(np.float64), first[:-1][some], axis=0)
    return total / np.maximum(n * len(GRAMS), 1)[:, None] + model.offset, n


OUT = "record_id long, language string, score double, accepted boolean"


def note_languages(notes: DataFrame, labels: DataFrame, record_id: str = "record_id", text: str = "notes", label: str = "language", sample: int = 2400, unknown: str = "und") -> DataFrame:
    """Predict the language of every whole note.

    labels: (record_id, notes, language), the notes to learn from; about ``sample`` of them, evenly over languages and chosen by a hash of
    their ids, are gathered to fit the model. The notes of this library carry no language, so column names are free and any labelled text
    will do. Returns ``record_id``, ``language`` (one that was learned, or ``unknown`` for a note that is null or has no letter), ``score`` (its
    calibrated probability; 0 for ``unknown``) and ``accepted``: the score reaches the level at which 99 % of the notes set aside were right.

    Without any label every note is ``unknown``. Repeated rows are predicted each for itself, a null id stays null, ties go to the language
    that comes first in the alphabet. Other columns are not read.
    """
    known = labels.select(F.col(record_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_t"), F.col(label).alias("_y")).filter("_y is not null and _t is not null and _id is not null")
    many = {r[0]: r[1] for r in known.groupBy("_y").agg(F.count(F.lit(1))).orderBy(F.desc("count(1)"), "_y").limit(1000).collect()}  # one row per language
    if not many:
        return notes.select(F.col(record_id).cast("long").alias("record_id"), F.lit(unknown).alias("language"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    quota = max(1, sample // len(many))
    draw = F.pmod(F.xxhash64("_id", F.lit(9)), F.lit(1 << 30))
    level = F.element_at(F.create_map(*[F.lit(x) for k, v in many.items() for x in (k, int(min(1.0, quota / v) * (1 << 30)))]), F.col("_y"))
    rows = sorted(tuple(r) for r in known.filter(draw < level).collect())  # about ``sample`` rows
    if not rows:
        rows = sorted(tuple(r) for r in known.orderBy(draw, "_id").limit(quota).collect())
    model = train([r[1] for r in rows], [r[2] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.languages)
        for b in slices(batches):
            z, _ = logits(model, b.column(1))
            p = _softmax(z / model.temperature)
            best = p.argmax(1)
            score = p[np.arange(len(p)), best]
            known = b.column(2)
            lang = pc.if_else(known, names.take(pa.array(best)), unknown)
            ok = known.to_numpy(zero_copy_only=False).astype(bool)
            score = np.where(ok, score, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), lang, pa.array(score), pa.array(ok & (score >= model.level))], names=["record_id", "language", "score", "accepted"])

    note = F.col(text).cast("string")
    src = notes.select(F.col(record_id).cast("long").alias("record_id"), note.alias("notes"), F.coalesce(note.rlike("\\p{L}"), F.lit(False)).alias("letter"))
    return src.mapInArrow(run, OUT)
