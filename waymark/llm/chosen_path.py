"""Similarity join of notes on word shingles, by recursive splits on sampled shared tokens (chosen paths).

Each note's set of shingles is embedded as ``WIDTH`` sampled tokens: the first tokens of the set in as many fixed random orders, so two sets
share a sampled token with a probability equal to their Jaccard similarity. A run splits all notes by one sampled token, splits what is still
large by the next one, and so on; a bucket of at most ``bucket`` notes is compared as a whole. A large bucket that a split hardly divides holds
notes that are alike; it is compared in blocks. Runs with other tokens are added until the expected recall for pairs exactly at the threshold
reaches the target.

What comes out are candidate groups. Inside a group every pair is then compared exactly, in blocks, without writing pairs out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import components
from .words import Words, distinct_per_row, shingles, slices

WIDTH = 64
RUNS = 5
MORE_RUNS = 4
DEPTH = 6
BLOCK = 1024
BLOCK_BYTES = 4 << 20
_ORDERS = np.random.default_rng(20240229).integers(1, 1 << 62, WIDTH).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def sampled_tokens(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of ``WIDTH`` sampled tokens per set; rows of empty sets stay zero."""
    out = np.zeros((len(starts) - 1, WIDTH), np.int32)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        at = starts[:-1][some]
        for i, order in enumerate(_ORDERS):
            low = np.minimum.reduceat(values * order, at)
            out[some, i] = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _sketches(notes: DataFrame, k: int) -> DataFrame:
    """(record_id, key, tokens): ``key`` is the digest of the text; notes without words are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            v, s = shingles(Words(b.column(2)), k)
            t = sampled_tokens(v, s)
            some = np.flatnonzero(np.diff(s))
            tokens = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * WIDTH, pa.int32()), pa.array(t[some].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), b.column(1).take(pa.array(some)), tokens], names=["record_id", "key", "tokens"])

    return notes.select("record_id", "key", "notes").mapInArrow(run, "record_id long, key binary, tokens array<int>")


def _paths(sk: DataFrame, first: int, last: int) -> DataFrame:
    """(node, p1, p2, ...) for every run from ``first`` to before ``last``: the hashes of the run and its first sampled tokens. Every run takes the tokens in an order of its own."""
    runs = sk.select("node", "tokens", F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("run"))
    path, cols = F.xxhash64("run"), {}
    for level in range(DEPTH):
        pick = F.element_at("tokens", F.pmod(F.xxhash64("run", F.lit(level)), F.lit(WIDTH)).cast("int") + 1)
        path = F.xxhash64(path, pick)
        cols[f"p{level + 1}"] = path
    return runs.select("node", *[c.alias(k) for k, c in cols.items()])


def _root(link: np.ndarray) -> np.ndarray:
    """The smallest row each row is connected to."""
    n = len(link)
    root = np.arange(n)
    if not link.any():
        return root
    while True:
        new = np.minimum(root, np.where(link, root[None, :].astype(np.int32), n).min(1))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _groups(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.Table]:
    """Whole groups (equal first column, rows sorted by it), several in one table."""
    held: list[pa.RecordBatch] = []
    for b in slices(batches, text):
        g = b.column(0).to_numpy()
        other = np.flatnonzero(g != g[-1])
        last = int(other[-1]) + 1 if len(other) else 0
        if last or (held and held[-1].column(0)[-1].as_py() != g[0]):
            ready = held + ([b.slice(0, last)] if last else [])
            if ready:
                yield pa.Table.from_batches(ready)
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _cuts(g: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
    return ((i, j) for i, j in zip(cut[:-1], cut[1:], strict=True) if j - i > 1)


def _alike(rows: DataFrame, least: int) -> DataFrame:
    """Edges (a, b) from each note to the first note of its bucket it is connected to by sharing ``least`` tokens. ``rows``: (grp, tokens as bytes, node), sorted by grp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 1):
            g, node = t.column(0).to_numpy(), t.column(2).to_numpy()
            x = np.frombuffer(b"".join(t.column(1).to_pylist()), np.int32).reshape(-1, WIDTH)
            a, b = [], []
            for i, j in _cuts(g):
                shared = np.zeros((j - i, j - i), np.uint8)
                for c in range(WIDTH):
                    shared += x[i:j, c, None] == x[None, i:j, c]
                root = _root(shared >= least)
                hit = np.flatnonzero(root != np.arange(j - i))
                a.append(node[i:j][hit])
                b.append(node[i:j][root[hit]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _in_blocks(rows: DataFrame, key: str, blocks: str, *keep: str) -> DataFrame:
    """Send every row of a group to all block pairs its own block is part of; ``grp`` names the pair."""
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col(blocks)).cast("int")
    spread = rows.select(key, blocks, "node", *keep, own.alias("blk"), F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)).alias("_j"))
    return spread.select(F.xxhash64(key, F.least("blk", "_j"), F.greatest("blk", "_j")).alias("grp"), (F.col("blk") != F.col("_j")).cast("int").alias("cross"), "blk", "node", *keep)


def candidate_groups(sk: DataFrame, similarity: float, recall: float, bucket: int) -> DataFrame:
    """(node, component): groups that hold, with the stated recall, every pair of similar notes. ``sk``: (node, tokens)."""
    spread = np.sqrt(similarity * (1 - similarity) / WIDTH)
    least = int(np.floor(WIDTH * (similarity - 3.5 * spread)))
    packed = F.unhex(F.array_join(F.transform("tokens", lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), ""))
    by_depth: dict[int, int] = {}
    edges, done, wanted = None, 0, RUNS
    while True:
        paths = materialise(_paths(sk, done, wanted))
        parts: list[DataFrame] = []
        active = paths
        for level in range(1, DEPTH + 1):
            here = f"p{level}"
            sizes = materialise(active.groupBy(here).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
            small = active.select(here, "node").join(sizes.filter(F.col("n") <= bucket).select(here), here, "left_semi")
            parts.append(small.select(F.col(here).alias("path"), "node", F.lit(1).alias("nb"), F.lit(level).alias("level")))
            large = sizes.filter(F.col("n") > bucket)
            if large.isEmpty():
                break
            active = active.join(large, here)
            if level < DEPTH:
                below = f"p{level + 1}"
                child = active.groupBy(here, "n", below).agg(F.count(F.lit(1)).alias("m")).groupBy(here, "n").agg(F.max("m").alias("m"))
                dense = materialise(child.filter("m >= 0.6 * n").select(here))
                alike, active = active.join(dense, here, "left_semi"), active.join(dense, here, "left_anti")
            else:
                alike = active
            parts.append(alike.select(F.col(here).alias("path"), "node", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("nb"), F.lit(level).alias("level")))
            active = materialise(active.drop("n"))
        held = parts[0]
        for x in parts[1:]:
            held = held.unionAll(x)
        held = materialise(held)
        for r in held.groupBy("level").count().collect():  # at most DEPTH rows
            by_depth[r[0]] = by_depth.get(r[0], 0) + r[1]
        with_tokens = _in_blocks(held.join(sk.select("node", packed.alias("tokens")), "node"), "path", "nb", "tokens")
        new = materialise(_alike(with_tokens.select("grp", "tokens", "node").repartition("grp").sortWithinPartitions("grp"), least))
        edges = new if edges is None else edges.unionAll(new)
        done = wanted
        total = sum(by_depth.values())
        expected = sum(n * (1 - (1 - similarity**d) ** done) for d, n in by_depth.items()) / total if total else 1.0
        if expected >= recall:
            return materialise(components(edges))
        wanted += MORE_RUNS


def _exact(side: np.ndarray, values: np.ndarray, starts: np.ndarray, similarity: float, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links per row of a group and the smallest row each is connected to. ``cross``: only rows of different sides are compared."""
    n = len(side)
    v, s = distinct_per_row(values, starts)
    size = np.diff(s)
    row = np.repeat(np.arange(n), size)
    _, col, often = np.unique(v, return_inverse=True, return_counts=True)
    keep = often[col] > 1
    both = np.zeros((n, n), np.float32)
    if keep.any():
        _, col = np.unique(col[keep], return_inverse=True)
        row = row[keep]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        wide = max(256, (1 << 20) // n)
        for lo in range(0, int(col[-1]) + 1, wide):
            i, j = np.searchsorted(col, lo), np.searchsorted(col, lo + wide)
            m = np.zeros((n, wide), np.float32)
            m[row[i:j], col[i:j] - lo] = 1
            both += m @ m.T
    union = (size[:, None] + size[None, :]).astype(np.float32) - both
    link = (both + np.float32(1e-3) >= similarity * union) & (union > 0)
    np.fill_diagonal(link, False)
    if cross:
        link &= side[:, None] != side[None, :]
    return link.sum(1), _root(link)


def _verify(rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """(node, n_links, other, many): exact links of every note in its block pair. ``rows``: (grp, notes, cross, side, node, many) sorted by grp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 1):
            t = t.combine_chunks()
            v, s = shingles(Words(t.column("notes").combine_chunks()), k)
            g, cross, side, node, many = (t.column(c).to_numpy() for c in ("grp", "cross", "side", "node", "many"))
            ids, links, other, parts = [], [], [], []
            for i, j in _cuts(g):
                # a note's own block is sent once to each pair, so a pair of different blocks is marked by any of its rows
                n, root = _exact(side[i:j], v[s[i] : s[j]], s[i : j + 1] - s[i], similarity, bool(cross[i]))
                hit = np.flatnonzero(n)
                ids.append(node[i:j][hit])
                links.append(n[hit])
                first = np.full(j - i, np.iinfo(np.int64).max)
                np.minimum.at(first, root, node[i:j])
                other.append(first[root[hit]])
                parts.append(many[i:j][hit])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links).astype(np.int64)), pa.array(np.concatenate(other)), pa.array(np.concatenate(parts))], names=["node", "n_links", "other", "many"])

    return rows.mapInArrow(run, "node long, n_links long, other long, many int")


def linked_notes(notes: DataFrame, record_id: str = "record_id", text: str = "notes", shingle: int = 5, similarity: float = 0.8, recall: float = 0.99, bucket: int = 32) -> DataFrame:
    """Group records whose notes are near copies: Jaccard similarity of their word-shingle sets at least ``similarity``.

    Returns one row per input row: ``record_id``, ``class_id`` (smallest record id of the class; classes are the connected groups of links),
    ``text_id`` (smallest record id with exactly this text), ``n_copies`` (rows with exactly this text) and ``n_links`` (other texts that are
    similar enough). Equal texts form one class without being compared. Links are exact; ``recall`` is the expected share of pairs exactly at
    the threshold that are found, and closer pairs are found more surely.

    Notes without a word (null, empty, punctuation) have no shingle: equal ones share a ``text_id`` and class only if the text is not null, and
    have no links. A note of fewer than ``shingle`` words has one shingle, all its words. Rows with a null id are returned with null class and
    no links. Rows that repeat an id with the same text count as copies; with another text they share one class and add up their links.
    """
    src = notes.select(F.col(record_id).cast("long").alias("record_id"), F.unhex(F.md5(F.col(text).cast("string"))).alias("key"), F.col(text).cast("string").alias("notes"))
    whole = src.filter("record_id is not null and notes is not null")
    sketched = materialise(_sketches(whole, shingle))
    keys = materialise(src.select("record_id", "key"))
    texts = materialise(keys.filter("record_id is not null and key is not null").groupBy("key").agg(F.min("record_id").alias("text_id"), F.count(F.lit(1)).alias("n_copies")))
    sk = materialise(sketched.join(texts.select("key", F.col("text_id").alias("record_id")), ["record_id", "key"], "left_semi").dropDuplicates(["record_id", "key"]).select(F.col("record_id").alias("node"), "tokens"))
    groups = candidate_groups(sk, similarity, recall, bucket)
    members = groups.withColumnRenamed("node", "record_id").join(texts.select(F.col("text_id").alias("record_id"), "key"), "record_id")
    held = materialise(whole.join(members, ["record_id", "key"]).dropDuplicates(["record_id", "key"]).select(F.col("record_id").alias("node"), "component", "notes"))
    sizes = held.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum(F.octet_length("notes")) / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int").alias("nb"))
    sized = held.join(sizes, "component").withColumn("many", (F.col("nb") > 1).cast("int"))
    spread = _in_blocks(sized, "component", "nb", "notes", "many").select("grp", "notes", "cross", F.col("blk").alias("side"), "node", "many")
    spread = spread.repartition("grp").sortWithinPartitions("grp")
    links = materialise(_verify(spread, shingle, similarity))
    # a group of one block has its classes already; those of several blocks meet in their edges
    whole_groups = links.filter("many = 0").select("node", F.col("other").alias("component"))
    classes = whole_groups.unionAll(components(links.filter("many = 1").select(F.col("node").alias("a"), F.col("other").alias("b"))))
    counts = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    per_text = materialise(counts.join(classes, "node", "left"))
    out = keys.join(texts, "key", "left").join(per_text.withColumnRenamed("node", "text_id"), "text_id", "left")
    known = F.col("record_id").isNotNull()
    return out.select(
        "record_id",
        F.when(known, F.coalesce("component", "text_id", "record_id")).alias("class_id"),
        F.when(known, F.coalesce("text_id", "record_id")).alias("text_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"),
    )
