"""Notes of the held-out gold set that leaked into other notes.

Every window of a note that is as long as a gold note gets a SimHash of its words. Fingerprints are looked up in a multi-index: 64 bits are cut
into ``radius + 1`` blocks, and two fingerprints within ``radius`` agree on at least one block, so no fingerprint within the radius is missed.
Candidates are then compared exactly: weighted Jaccard similarity of word shingles, a shingle's weight being how often it occurs.

No radius follows from the similarity, so the radius is wide. A window at similarity 0.8 has at least eight ninths of its words in common with
the gold note, each bit of the two fingerprints differs with probability arccos(8/9) / pi = 0.15 at most, and more than 24 of 64 bits with one of
about 2 in a million. ``exact`` adds the windows in which enough places hold a shingle of one gold note, whatever their distance; it is what
the tests measure the multi-index against.

Windows that hold too few word pairs of the gold set to reach the similarity with any gold note are not fingerprinted. That bound is exact: every
shared shingle begins with a pair of neighbouring words that some gold note has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, mix, slices

PART_BYTES = 32 << 20
MANY = 1 << 16
RADIUS = 24


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(mix(h + np.uint64(7)).view(np.uint8).reshape(-1, 8), axis=1)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a + mix(b + np.uint64(3)))


def _pack(votes: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.packbits(2 * votes > length[:, None], axis=1).view(np.uint64).ravel()


def _window_shingles(words: np.ndarray, k: int) -> np.ndarray:
    """One row of shingle hashes per row of words."""
    k = min(k, words.shape[1])
    m = words.shape[1] - k + 1
    total = np.zeros((len(words), m), np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[:, j : j + m]
    return total


class GoldIndex:
    """The gold notes of one part: words, sizes, fingerprints and the block tables."""

    def __init__(self, ids: list, texts: list[str | None], shingle: int, similarity: float, radius: int, exact: bool = False):
        self.exact = exact
        w = Words(pa.array(texts, pa.string()))
        self.shingle, self.similarity, self.radius = shingle, similarity, radius
        some = np.flatnonzero(w.count)
        self.ids = np.array(ids, np.int64)[some]
        self.words = [w.hash[w.first[i] : w.first[i + 1]] for i in some]
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.print = np.array([_pack(_bits(x).sum(0, dtype=np.int64)[None], np.array([len(x)]))[0] for x in self.words], np.uint64)
        pairs = [_pairs(x[:-1], x[1:]) for x in self.words if len(x) > 1] + [_pairs(x, np.zeros(1, np.uint64)) for x in self.words if len(x) == 1]
        self.vocabulary = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.alone = bool((self.size == 1).any())
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.shingles = []
        for x in self.words:
            s, n = np.unique(_window_shingles(x[None], shingle)[0], return_counts=True)
            self.shingles.append((s, n))
        self.by_shingle = {}
        for k in np.unique(np.minimum(self.size, shingle)).tolist():
            own = np.flatnonzero(np.minimum(self.size, shingle) == k)
            hashes, items = np.concatenate([self.shingles[i][0] for i in own]), np.repeat(own, [len(self.shingles[i][0]) for i in own])
            order = np.argsort(hashes, kind="stable")
            self.by_shingle[k] = hashes[order], items[order]
        edge = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = list(zip(edge[:-1], np.diff(edge), strict=True))
        self.tables = []
        for b in range(len(self.blocks)):
            key = self.block_key(self.print, self.size, b)
            order = np.argsort(key, kind="stable")
            self.tables.append((key[order], order))

    def block_key(self, prints: np.ndarray, size: np.ndarray, b: int) -> np.ndarray:
        low, width = self.blocks[b]
        return (size.astype(np.int64) << 32) | ((prints >> np.uint64(low)) & np.uint64((1 << int(width)) - 1)).astype(np.int64)

    def n_shingles(self, n):
        return np.maximum(n - self.shingle + 1, 1)

    def known(self, h: np.ndarray) -> np.ndarray:
        out = self.maybe[(h >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        v = h[at]
        place = np.minimum(np.searchsorted(self.vocabulary, v), len(self.vocabulary) - 1)
        out[at] = self.vocabulary[place] == v
        return out

    def windows(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and gold size of every window in which enough shingles begin like a gold note's."""
        n = len(w.hash)
        begins = self.known(_pairs(w.hash, np.append(w.hash[1:], np.uint64(0))))
        if self.alone:
            begins |= self.known(_pairs(w.hash, np.zeros(n, np.uint64)))
        seen = np.concatenate([[0], np.cumsum(begins, dtype=np.int32)])
        row = w.row_of_word()
        left = (w.first[row + 1] - np.arange(n)).astype(np.int32)
        share = self.similarity / (1 + self.similarity)
        start, length, size = [], [], []
        for s in np.unique(self.size):
            m = int(self.n_shingles(s))
            need = int(np.ceil(share * 2 * m - 1e-6))
            if n >= s:
                at = np.flatnonzero(seen[m : n + 1 - s + m] - seen[: n + 1 - s] >= need)
                at = at[left[at] >= s]
                start.append(at)
                length.append(np.full(len(at), s))
                size.append(np.full(len(at), s))
            # a note shorter than the gold note is one window
            short = np.flatnonzero((w.count < s) & (w.count > 0))
            mw = self.n_shingles(w.count[short])
            hold = seen[w.first[short] + mw] - seen[w.first[short]]
            ok = short[(hold >= share * (m + mw) - 1e-6) & (mw >= self.similarity * m - 1e-6)]
            start.append(w.first[ok])
            length.append(w.count[ok])
            size.append(np.full(len(ok), s))
        return tuple(np.concatenate(x).astype(np.int64) for x in (start, length, size))

    def sharing(self, w: Words, start: np.ndarray, length: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and gold note of every pair in which enough places of the window hold a shingle of that gold note.

        A place counts however often its shingle occurs, so the count is never below the weighted overlap and no similar pair is missed.
        """
        share = self.similarity / (1 + self.similarity)
        who, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (hashes, items) in self.by_shingle.items():
            of_k = np.flatnonzero(np.minimum(length, self.shingle) == k)
            if not len(of_k):
                continue
            of_k = of_k[np.argsort(start[of_k], kind="stable")]
            n = len(w.hash) - k + 1
            ends = start[of_k] + length[of_k] - k + 1
            used = np.flatnonzero(np.cumsum(np.bincount(start[of_k], minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0)
            h = _window_shingles(w.hash[used[:, None] + np.arange(k)], k)[:, 0]
            lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            many = hi - lo
            entry = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            place, owner = np.repeat(used, many), items[entry]
            order = np.argsort(owner, kind="stable")  # places stay in order inside each gold note
            place, owner = place[order], owner[order]
            for i, p in zip(owner[np.flatnonzero(np.diff(owner, prepend=-1))], np.split(place, np.flatnonzero(np.diff(owner)) + 1), strict=False):
                own = of_k[size[of_k] == self.size[i]]
                held = np.searchsorted(p, start[own] + length[own] - k + 1) - np.searchsorted(p, start[own])
                own = own[held >= share * (length[own] - k + 1 + self.n_shingles(self.size[i])) - 1e-6]
                who.append(own)
                item.append(np.full(len(own), i))
        return np.concatenate(who), np.concatenate(item)

    def search(self, w: Words) -> dict[str, np.ndarray]:
        """The best window of each (note, gold note) pair that is similar enough."""
        start, length, size = self.windows(w) if len(self.ids) and len(w.hash) else (np.zeros(0, np.int64),) * 3
        found = []
        order = np.argsort(start, kind="stable")
        for lo in range(0, len(order), MANY):
            part = order[lo : lo + MANY]
            found.append(self._search(w, start[part], length[part], size[part]))
        cols = [np.concatenate(x) if found else np.zeros(0) for x in zip(*found, strict=True)] if found else [np.zeros(0)] * 6
        row, item, first, n, far, sim = cols
        best = np.lexsort((first, -sim, item, row))
        new = np.ones(len(best), bool)
        new[1:] = (row[best][1:] != row[best][:-1]) | (item[best][1:] != item[best][:-1])
        best = best[new]
        return {"row": row[best].astype(np.int64), "item": item[best].astype(np.int64), "first": first[best].astype(np.int32), "n": n[best].astype(np.int32), "far": far[best].astype(np.int32), "sim": sim[best].astype(float)}

    def _search(self, w: Words, start: np.ndarray, length: np.ndarray, size: np.ndarray):
        # votes of the words between the first and the last window, summed up once; regions without windows are left out
        n = len(w.hash) + 1
        touched = np.bincount(start, minlength=n) - np.bincount(start + length, minlength=n)
        used = np.flatnonzero(np.cumsum(touched)[:-1] > 0)
        place = np.zeros(len(w.hash) + 1, np.int64)
        place[used + 1] = 1
        place = np.cumsum(place)
        votes = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(w.hash[used]), axis=0, dtype=np.int32)])
        prints = _pack(votes[place[start + length]] - votes[place[start]], length)
        who, item = [], []
        for b, (keys, order) in enumerate(self.tables):
            key = self.block_key(prints, size, b)
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            many = hi - lo
            hit = np.repeat(np.arange(len(key)), many)
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            c = order[at]
            near = np.bitwise_count(prints[hit] ^ self.print[c]) <= self.radius
            who.append(hit[near])
            item.append(c[near])
        if self.exact:
            far_who, far_item = self.sharing(w, start, length, size)
            who.append(far_who)
            item.append(far_item)
        pair = np.unique(np.concatenate(who) * len(self.ids) + np.concatenate(item))
        who, item = pair // len(self.ids), pair % len(self.ids)
        sim = np.zeros(len(who))
        by = np.lexsort((length[who], item))
        cut = np.flatnonzero(np.diff(item[by]) | np.diff(length[who][by])) + 1
        for group in np.split(by, cut) if len(by) else []:
            i, n = item[group[0]], length[who[group[0]]]
            s, often = self.shingles[i]
            x = _window_shingles(w.hash[start[who[group]][:, None] + np.arange(n)], self.shingle)
            at = np.minimum(np.searchsorted(s, x), len(s) - 1)
            same = s[at] == x
            count = np.bincount((np.arange(len(group))[:, None] * len(s) + at)[same], minlength=len(group) * len(s)).reshape(len(group), len(s))
            both = np.minimum(count, often).sum(1)
            sim[group] = both / (x.shape[1] + often.sum() - both)
        ok = np.flatnonzero(sim + 1e-9 >= self.similarity)
        row = np.searchsorted(w.first, start[who[ok]], side="right") - 1
        return row, item[ok], start[who[ok]] - w.first[row], length[who[ok]], np.bitwise_count(prints[who[ok]] ^ self.print[item[ok]]), sim[ok]


OUT = "record_id long, gold_id long, first_word int, n_words int, distance int, similarity double"


def leaked_notes(notes: DataFrame, gold: DataFrame, record_id: str = "record_id", text: str = "notes", gold_id: str = "gold_id", gold_text: str = "notes", shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS, exact: bool = False) -> DataFrame:
    """Find gold notes inside other notes.

    Returns one row per (note, gold note) with a similar window: ``record_id``, ``gold_id``, the best window (``first_word`` from 0, ``n_words``),
    its fingerprint ``distance`` and its ``similarity``, at least the given one; ties go to the earlier window. Windows within ``radius`` of the
    gold note's fingerprint are compared, all of them; with ``exact`` also those beyond it that can reach the similarity.

    All windows of whole notes are covered. Gold notes are sent to the tasks, in as many passes over the notes as it takes to keep each part
    under 32 MB. Null and empty notes and gold notes without a word match nothing; a gold note shorter than a shingle has one shingle, all its
    words, and a note shorter than the gold note is one window. Repeated note rows return their matches each time; a gold id used twice
    stands for both its texts. Rows with a null gold id are left out. Other columns are not read.
    """
    src = notes.select(F.col(record_id).cast("long").alias("record_id"), F.col(text).cast("string").alias("notes"))
    items = gold.select(F.col(gold_id).cast("long").alias("gold_id"), F.col(gold_text).cast("string").alias("notes")).filter("gold_id is not null and notes is not null").distinct()
    n_bytes = items.agg(F.sum(F.octet_length("notes"))).first()[0] or 0
    parts = max(1, -(-n_bytes // PART_BYTES))
    out = None
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("gold_id", "notes"), F.lit(parts)) == part).orderBy("gold_id", "notes").collect()  # about PART_BYTES
        index = GoldIndex([r[0] for r in rows], [r[1] for r in rows], shingle, similarity, radius, exact)

        def run(batches: Iterator[pa.RecordBatch], index: GoldIndex = index) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                f = index.search(Words(b.column(1)))
                if len(f["row"]):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(f["row"])), *(pa.array(x) for x in (index.ids[f["item"]], f["first"], f["n"], f["far"], f["sim"]))], names=["record_id", "gold_id", "first_word", "n_words", "distance", "similarity"])

        found = src.mapInArrow(run, OUT)
        out = found if out is None else out.unionAll(found)
    return out


def without_leaks(notes: DataFrame, gold: DataFrame, record_id: str = "record_id", text: str = "notes", **options) -> DataFrame:
    """The rows of ``notes`` in which no gold note was found; rows with a null id are kept. Options as in ``leaked_notes``."""
    hit = leaked_notes(notes, gold, record_id, text, **options).select(F.col("record_id").alias("_leaked")).distinct()
    return notes.join(hit, notes[record_id] == F.col("_leaked"), "left_anti")
