"""Sampled segmentations of notes into the pieces of a SentencePiece vocabulary, without replacement, and their decoding.

A note is read as its UTF-8 bytes behind one space; a piece's mark for a space is that space. No piece holds a space after another character,
so the lattice of all segmentations falls into independent units, one per run of spaces and what follows it. Summing the lattice of a unit
forwards gives, for each place, the odds of the piece that ends there; a segmentation is a sequence of such choices, unit by unit, each unit
from its end.

Distinct segmentations come from an A-star search with perturbed scores (the Gumbel-max process from the top down): a set of segmentations has
as its score the largest of their Gumbel-perturbed log-probabilities, which depends on the set's total probability alone. The search takes the
best set, draws its best member, and splits the rest by the first choice in which they differ, each part with a Gumbel score cut off at its
parent's. The first ``k`` members found are the top ``k`` of all perturbed segmentations: a sample without replacement.

Random numbers depend on the seed, the note's id, the place in the note and the draw, never on how notes are dealt out to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _powers, mix, raw_bytes, slices

SLICE = 1 << 19
DECODED = 1 << 17
_STEP = np.uint64(0x100000001B3)
_PLACE, _CHOICE = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xABC98388FB8FAC03)


class Vocabulary:
    """Pieces by prefix hash, their weights and bytes. A piece's log-weight is ``-alpha * log(rank)``, by its rank among the pieces' scores."""

    def __init__(self, model_path: str, alpha: float = 1.0):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = m.get_piece_size()
        spelled, ids = [], []
        self.byte_id = np.full(256, -1, np.int32)
        self.bytes_of: list[bytes] = [b""] * n
        for i in range(n):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.bytes_of[i] = p.replace("▁", " ").encode()
                if " " in self.bytes_of[i].decode().lstrip(" "):
                    raise ValueError(f"piece {p!r} spans units")
                spelled.append(self.bytes_of[i])
                ids.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        weight = -alpha * np.log(2.0 - np.array([m.get_score(i) for i in ids], float))
        self.byte_weight = -alpha * float(np.log(2.0 + n))
        known: dict[int, tuple[int, float]] = {}
        prefixes: set[int] = set()
        for b, i, w in zip(spelled, ids, weight, strict=True):
            h = 0x51ED27
            for x in b:
                h = (h * int(_STEP) + x + 1) & 0xFFFFFFFFFFFFFFFF
                prefixes.add(h)
            known[h] = (i, w)
        self.key = np.array(sorted(prefixes), np.uint64)
        self.id = np.array([known.get(int(k), (-1, 0.0))[0] for k in self.key], np.int32)
        self.weight = np.array([known.get(int(k), (-1, 0.0))[1] for k in self.key])
        # as many bytes of a unit as leave every product of weights in the range of doubles
        self.plain = int(600 / (max(np.abs(weight).max(initial=0.0), abs(self.byte_weight)) + 1))
        self.table = np.full((1 << 18) + 4096, -1, np.int32)
        for i, slot in enumerate(self._slot(self.key)):
            while self.table[slot] >= 0:
                slot += 1
            self.table[slot] = i
        self.longest = max(map(len, spelled), default=1)
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        # every piece, and every piece as the first of a note
        self.spelling = pa.array([*self.bytes_of, *(b[b.startswith(b" ") :] for b in self.bytes_of)], pa.large_binary())

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each prefix hash, -1 if no piece begins so."""
        slot = self._slot(h)
        out = self.table[slot]
        open_ = np.flatnonzero((out >= 0) & (self.key[out] != h))
        while len(open_):
            slot[open_] += 1
            at = self.table[slot[open_]]
            out[open_] = at
            open_ = open_[(at >= 0) & (self.key[at] != h[open_])]
        return out

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def _uniform(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


class Lattice:
    """The lattices of the distinct units of a slice: edges grouped by the node they end in, with running odds inside each node.

    Units come longest first, so that node ``level[d] + u`` lies behind the first ``d`` bytes of unit ``u``: nodes below ``units`` are heads, and the
    nodes of one depth lie side by side.
    """

    def __init__(self, vocab: Vocabulary, buf: np.ndarray, start: np.ndarray):
        """``buf``: bytes of distinct units, one after another, longest first; ``start``: where they begin (one more entry)."""
        n = len(buf)
        size = np.diff(start)
        self.units = len(size)
        unit = np.repeat(np.arange(self.units), size)
        stop = start[1:][unit]
        longest = int(size[0]) if self.units else 0
        # how many units have so many bytes at least
        level = self.level = np.concatenate([[0], np.cumsum(np.searchsorted(-size, -np.arange(longest + 1), side="right"))])
        depth = np.arange(n) - start[:-1][unit]
        before, behind = level[depth] + unit, level[depth + 1] + unit
        first = np.flatnonzero((buf & 0xC0) != 0x80)
        char_end = np.append(first[1:], n)
        at, h = first, np.full(len(first), 0x51ED27, np.uint64)
        src, dst, ids, wts = [], [], [], []
        single = np.zeros(n, bool)
        ends = np.zeros(n + 1, bool)
        ends[first] = True
        ends[n] = True
        nth = np.zeros(n + 1, np.int64)
        nth[first] = char_end
        byte = buf.astype(np.uint64) + np.uint64(1)
        for k in range(vocab.longest):
            if k:
                ok = np.flatnonzero(at + k < stop.take(at))
                at, h = at.take(ok), h.take(ok)
            if not len(at):
                break
            h = h * _STEP + byte.take(at + k)
            place = vocab.find(h)
            ok = np.flatnonzero(place >= 0)
            at, h, place = at.take(ok), h.take(ok), place.take(ok)
            entry = vocab.id.take(place)
            whole = np.flatnonzero((entry >= 0) & ends.take(at + (k + 1)))
            s, place = at.take(whole), place.take(whole)
            src.append(before.take(s))
            dst.append(behind.take(s + k))
            ids.append(entry.take(whole))
            wts.append(vocab.weight.take(place))
            if k < 4:  # bytes of one character
                single[s[nth.take(s) == s + (k + 1)]] = True
        lone = first[~single[first]]
        src.append(before[lone])
        dst.append(behind[nth[lone] - 1])
        ids.append(np.full(len(lone), -1, np.int32))
        wts.append((nth[lone] - lone) * vocab.byte_weight)
        # the longest pieces first: a choice is found by walking a node's edges, and they are the likely ones. In one list no node comes twice
        many = np.bincount(np.concatenate(dst), minlength=int(level[-1]))
        self.first = np.concatenate([[0], np.cumsum(many)])
        free, total_edges = self.first[:-1].copy(), int(self.first[-1])
        self.src, self.dst = np.empty(total_edges, np.int64), np.repeat(np.arange(len(many)), many)
        self.id, weight = np.empty(total_edges, np.int32), np.empty(total_edges)
        for s, d, i, w in zip(src[::-1], dst[::-1], ids[::-1], wts[::-1], strict=True):
            e = free.take(d)
            free[d] = e + 1
            self.src[e], self.id[e], weight[e] = s, i, w
        self.p = self._odds(vocab, weight, many, level)
        node = np.flatnonzero(many)
        self.upto = np.cumsum(self.p)
        head, last = self.first[node], self.first[node + 1] - 1
        self.upto -= np.repeat(self.upto[head] - self.p[head], many[node])
        np.minimum(self.upto, 1.0, out=self.upto)
        self.upto[last] = 1.0

    def _odds(self, vocab: Vocabulary, weight: np.ndarray, many: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The odds of every edge among those that end in its node: sums over all ways to a node, by depth; as logarithms where they may leave
        the range of doubles."""
        total = np.ones(len(many))
        node = np.flatnonzero(many)
        cut, step = self.first[node], np.searchsorted(node, level)
        plain = min(vocab.plain, len(level) - 2)
        edges = int(self.first[level[plain + 1]]) if plain >= 0 else 0
        w = np.exp(weight[:edges])
        for d in range(1, plain + 1):
            i, j, a, b = self.first[level[d]], self.first[level[d + 1]], step[d], step[d + 1]
            if i < j:
                total[node[a:b]] = np.add.reduceat(w[i:j] * total.take(self.src[i:j]), cut[a:b] - i)
        p = np.empty(len(weight))
        p[:edges] = w * total.take(self.src[:edges]) / total.take(self.dst[:edges])
        if edges < len(p):
            total = np.log(total)
        for d in range(plain + 1, len(level) - 1):
            i, j, a, b = self.first[level[d]], self.first[level[d + 1]], step[d], step[d + 1]
            if i == j:
                continue
            v = weight[i:j] + total.take(self.src[i:j])
            top = np.maximum.reduceat(v, cut[a:b] - i)
            e = np.exp(v - np.repeat(top, many[node[a:b]]))
            z = np.add.reduceat(e, cut[a:b] - i)
            total[node[a:b]] = top + np.log(z)
            p[i:j] = e / np.repeat(z, many[node[a:b]])
        return p

    def tails(self, size: np.ndarray) -> np.ndarray:
        """The last node of each unit of ``size`` bytes."""
        return self.level[size] + np.arange(self.units)

    def depth(self, node: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.level, node, side="right") - 1

    def without(self, edge: np.ndarray, barred: list[np.ndarray]) -> np.ndarray:
        """Odds of the edges of each edge's node, one row per entry, zero for the barred ones and beyond the node."""
        first = self.first[self.dst[edge]]
        width = self.first[self.dst[edge] + 1] - first
        wide = int(width.max()) if len(edge) else 1
        at = first[:, None] + np.arange(wide)
        p = np.where(np.arange(wide) < width[:, None], self.p[np.minimum(at, len(self.p) - 1)], 0.0)
        for b in barred:
            p[at == b[:, None]] = 0.0
        return p

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge into each node at ``u`` of its running odds."""
        e = self.first.take(node)
        more = np.flatnonzero(self.upto.take(e) <= u)
        left, u = e.take(more), u.take(more)
        while len(more):
            left += 1
            e[more] = left
            on = np.flatnonzero(self.upto.take(left) <= u)
            more, left, u = more.take(on), left.take(on), u.take(on)
        return e


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of several ranges, one after another, and the range of each."""
    many = last - first
    of = np.repeat(np.arange(len(many)), many)
    return np.arange(len(of)) + (first - (np.cumsum(many) - many))[of], of


# no Gumbel number drawn from ``_uniform`` is larger
_TOP = 54 * np.log(2.0) + 1e-6


class _Draw:
    """One drawn segmentation of every note of a slice: its choices in order, and the scores of the sets that differ first at each.

    A set's mass is at most the probability of the choices before it, which only falls, and Gumbel numbers are bounded. So scores are worked
    out from a note's branching place on, as far as one may still be the best.
    """

    def __init__(self, first_unit, parts, lat: Lattice, place, score, parent_key, from_occ, from_step, barred):
        """``parts``: (unit occurrences, steps, edges) that hold every choice once, in any order."""
        occ, step, edge = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.at = np.concatenate([[0], np.cumsum(np.bincount(occ, minlength=len(place)))])
        self.edge = np.empty(len(edge), np.int64)
        self.edge[self.at.take(occ) + step] = edge
        self.first = self.at[first_unit]
        self.run = np.concatenate([[0.0], np.cumsum(np.log(np.maximum(lat.p.take(self.edge), 1e-300)))])
        self.base = self.run[self.first[:-1]]
        self.log_prob = self.run[self.first[1:]] - self.base
        self.lat, self.place, self.score, self.parent_key, self.barred = lat, place, score, parent_key, barred
        self.own = np.where((from_occ >= 0) & (np.diff(self.first) > 0), self.at[from_occ] + from_step, -1)
        self.done = np.where(self.own >= 0, self.own, self.first[:-1])
        self.free, self.known = np.zeros(0), np.zeros(0, bool)
        self.choice, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs = np.flatnonzero(self.done < self.first[1:])
        self._extend(docs, self.run[self.done[docs]] - _TOP - 4)

    def unit_of(self, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit occurrence and the step of choices."""
        occ = np.searchsorted(self.at, choice, side="right") - 1
        return occ, choice - self.at[occ]

    def _extend(self, docs: np.ndarray, floor: np.ndarray) -> None:
        """Lay out more choices, as long as those before them are as likely as ``floor``, with scores as if nothing but these took from a set's mass."""
        upto = np.clip(np.searchsorted(-self.run, -floor, side="right"), self.done[docs] + 1, self.first[1:][docs])
        choice, of = _ranges(self.done[docs], upto)
        doc = docs[of]
        occ, step = self.unit_of(choice)
        u = _uniform(self.parent_key[doc] ^ mix(self.place[occ].astype(np.uint64) * _PLACE + step.astype(np.uint64) * _CHOICE + np.uint64(77)))
        # before it is cut off at the parent's score, which changes no order inside a note
        free = self.run[choice] - self.base[doc] - np.log(-np.log(u))
        order = np.argsort(np.concatenate([self.doc, doc]), kind="stable")
        more = ((self.doc, doc), (self.choice, choice), (self.free, free), (self.known, np.zeros(len(doc), bool)))
        self.doc, self.choice, self.free, self.known = (np.concatenate(x)[order] for x in more)
        self.cut = np.flatnonzero(np.diff(self.doc, prepend=-1))
        self.done[docs] = upto

    def _settle(self, at: np.ndarray) -> None:
        """Take from the scores at these places what the choice itself leaves."""
        edge, doc = self.edge[self.choice[at]], self.doc[at]
        rest = self.lat.without(edge, [edge]).sum(1)
        own = np.flatnonzero(self.choice[at] == self.own[doc])
        rest[own] = self.lat.without(edge[own], [edge[own]] + [x[doc[own]] for x in self.barred]).sum(1)
        with np.errstate(divide="ignore"):
            self.free[at] += np.log(rest)
        self.known[at] = True

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """The best score of each note, and where it lies in ``free``."""
        n = len(self.done)
        while True:
            value, sure, at = np.full(n, -np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
            some = self.doc[self.cut]
            if len(some):
                value[some] = np.maximum.reduceat(self.free, self.cut)
                sure[some] = np.maximum.reduceat(np.where(self.known, self.free, -np.inf), self.cut)
                hit = np.flatnonzero(self.free == value[self.doc])
                at[self.doc[hit[::-1]]] = hit[::-1]
            # the first of a note's open scores alone, then all that are above what is sure
            open_ = np.flatnonzero(~self.known & (self.free >= np.where(np.isfinite(sure), sure, value)[self.doc]))
            if len(open_):
                self._settle(open_)
                continue
            floor = value + self.base - _TOP
            more = np.flatnonzero((self.done < self.first[1:]) & (self.run[self.done] >= floor))
            if not len(more):
                return -np.logaddexp(-self.score, -value), at
            self._extend(more, floor[more])


def _alike(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of every distinct hash, and for every place which of them it is."""
    same = np.arange(len(h))
    left, bits = same, np.uint64(max(8, int(len(h)).bit_length() + 1))
    table = np.empty(1 << int(bits), np.int64)
    key = h
    while len(left):
        slot = (key >> (np.uint64(64) - bits)).astype(np.int64)
        table[slot] = left
        found = table.take(slot)
        equal = h.take(found) == h.take(left)
        same[left[equal]] = found[equal]
        left = left[~equal]
        key = mix(key[~equal])
    one = np.flatnonzero(same == np.arange(len(h)))
    rank = np.empty(len(h), np.int64)
    rank[one] = np.arange(len(one))
    return one, rank.take(same)


def segment(vocab: Vocabulary, ids: np.ndarray, texts: pa.Array, k: int, seed: int) -> list[dict[str, np.ndarray]]:
    """Up to ``k`` draws of each note, best first. Each draw: ``row``, ``log_prob``, ``perturbed``, and piece ids with their ``offsets``; ``kappa`` is the best
    perturbed score left after the last draw (-inf if none)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    led = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    buf, off = raw_bytes(led)
    n_docs = len(off) - 1
    space = buf == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[off[:-1][off[:-1] < len(buf)]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(buf))
    first_unit = np.searchsorted(start, off)
    doc_of = np.repeat(np.arange(n_docs), np.diff(first_unit))
    # distinct units, the longest first
    power, inverse = _powers(len(buf) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)])])
    one, which = _alike(mix((run[end] - run[start]) * inverse[start]) if len(start) else np.zeros(0, np.uint64))
    size = (end - start)[one]
    short = -(size - size.max(initial=0))
    order = np.argsort(short.astype(np.uint16) if short.max(initial=0) < 1 << 16 else short, kind="stable")
    rank = np.empty(len(one), np.int64)
    rank[order] = np.arange(len(one))
    one, size, which = one[order], size[order], rank[which]
    at = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(start[one] - at[:-1], size) + np.arange(at[-1])
    held = buf[take]
    lat = Lattice(vocab, held, at)
    tail = lat.tails(size)[which]  # the node behind each occurrence's unit
    place = np.arange(len(start)) - first_unit[doc_of]  # ordinal of the unit in its note
    doc_key = mix(ids.astype(np.int64).view(np.uint64) ^ mix(np.array([seed & (2**63 - 1)], np.uint64)))
    occ_key = doc_key[doc_of]
    places = np.arange(int(place.max(initial=-1)) + 1).astype(np.uint64) * _PLACE

    def walk(occ: np.ndarray, node: np.ndarray, step: np.ndarray | int, draw: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Free choices from ``node`` (a head: nothing) to the head of each unit; ``step`` is that of the first choice, for all or for each."""
        parts = []
        while True:
            on = np.flatnonzero(node >= lat.units)
            occ, node = occ.take(on), node.take(on)
            if not len(occ):
                return parts
            if isinstance(step, int):
                turn = np.uint64((step * int(_CHOICE) + draw) & 0xFFFFFFFFFFFFFFFF)
                at = place.take(occ)
                drawn = mix(places + turn).take(at) if len(places) < len(at) else mix(places.take(at) + turn)
                parts.append((occ, np.full(len(occ), step), lat.pick(node, _uniform(occ_key.take(occ) ^ drawn))))
            else:
                step = step.take(on)
                drawn = mix(places.take(place.take(occ)) + step.astype(np.uint64) * _CHOICE + np.uint64(draw))
                parts.append((occ, step, lat.pick(node, _uniform(occ_key.take(occ) ^ drawn))))
            node, step = lat.src.take(parts[-1][2]), step + 1

    score = -np.log(-np.log(_uniform(doc_key + np.uint64(1))))
    none = np.full(n_docs, -1, np.int64)
    nothing = [(np.zeros(0, np.int64),) * 3]
    draws = [_Draw(first_unit, walk(np.arange(len(start)), tail, 0, 0) or nothing, lat, place, score, doc_key + np.uint64(2), none, none, [])]
    live = [np.ones(n_docs, bool)]
    barred: list[list[np.ndarray]] = [[]]  # by draw: edges barred at its branching place, -1 where none
    branch = [(none, none)]
    while True:
        values, places_of = zip(*(d.best() for d in draws), strict=True)
        values = np.stack([np.where(a, v, -np.inf) for v, a in zip(values, live, strict=True)])
        src_draw = values.argmax(0)
        value = values[src_draw, np.arange(n_docs)]
        if len(draws) == k:
            kappa = value
            break
        go = np.isfinite(value)
        m = len(draws)
        parts = []
        f_occ, f_step = np.full(n_docs, -1, np.int64), np.full(n_docs, -1, np.int64)
        bars = [np.full(n_docs, -1, np.int64) for _ in range(m + 1)]
        for j, d in enumerate(draws):
            docs = np.flatnonzero(go & (src_draw == j))
            if not len(docs):
                continue
            c = d.choice[places_of[j][docs]]
            d.free[places_of[j][docs]] = -np.inf
            (o, s), e0 = d.unit_of(c), d.edge[c]
            # barred here: the source's own choice, and its bars if this is where it branched off itself
            same = (branch[j][0][docs] == o) & (branch[j][1][docs] == s)
            out = [e0] + [np.where(same, x[docs], -1) for x in barred[j]]
            run = lat.without(e0, out).cumsum(1)
            u = _uniform(doc_key[docs] + mix(np.full(len(docs), 1000 + m, np.uint64))) * run[:, -1]
            e1 = lat.first[lat.dst[e0]] + (run <= u[:, None]).sum(1)
            f_occ[docs], f_step[docs] = o, s
            for b, x in zip(bars, out, strict=False):
                b[docs] = x
            # kept choices, the branching choice, free choices for the rest
            keep, _ = _ranges(d.first[docs], c)
            rest, _ = _ranges(o + 1, first_unit[docs + 1])
            parts += [(*d.unit_of(keep), d.edge[keep]), (o, s, e1), *walk(o, lat.src[e1], s + 1, m), *walk(rest, tail[rest], 0, m)]
        if not parts:
            kappa = value
            break
        draws.append(_Draw(first_unit, parts, lat, place, np.where(go, value, -np.inf), doc_key + mix(np.full(n_docs, 2000 + m, np.uint64)), f_occ, f_step, bars))
        live.append(go)
        barred.append(bars)
        branch.append((f_occ, f_step))
    out = []
    for d, a in zip(draws, live, strict=True):
        # choices run from a unit's end to its head; pieces run the other way
        e = d.edge[np.repeat(d.at[:-1] + d.at[1:] - 1, np.diff(d.at)) - np.arange(len(d.edge))]
        piece, offsets = lat.id.take(e), d.first
        fall = np.flatnonzero(piece < 0)
        if len(fall):
            # a character without a piece is spelled by its bytes
            unit = lat.src[e[fall]] - lat.level[lat.depth(lat.src[e[fall]])]
            many = np.ones(len(e), np.int64)
            many[fall] = lat.depth(lat.dst[e[fall]]) - lat.depth(lat.src[e[fall]])
            begin = np.concatenate([[0], np.cumsum(many)])
            piece = np.repeat(piece, many)
            spot, of = _ranges(begin[fall], begin[fall + 1])
            piece[spot] = vocab.byte_id[held[(at[unit] + lat.depth(lat.src[e[fall]]))[of] + spot - begin[fall][of]]]
            offsets = begin[offsets]
        out.append({"row": np.flatnonzero(a), "live": a, "log_prob": d.log_prob, "perturbed": d.score, "pieces": piece, "offsets": offsets, "kappa": kappa})
    return out


OUT = "record_id long, draw int, n_pieces int, log_prob double, perturbed double, log_inclusion double, pieces array<int>"


def spelled(vocab: Vocabulary, flat: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The texts of piece lists laid end to end; ids outside the vocabulary spell nothing, bytes that form no UTF-8 become U+FFFD."""
    flat = np.where((flat >= 0) & (flat < len(vocab.bytes_of)), flat, 0)
    # the first piece that spells anything loses the space before the note
    some = np.flatnonzero(vocab.size.take(flat))
    head = np.append(some, len(flat))[np.searchsorted(some, cut[:-1])]
    head = head[head < cut[1:]]
    flat[head] += len(vocab.bytes_of)
    raw = vocab.spelling.take(pa.array(flat))
    at = np.frombuffer(raw.buffers()[1], np.int64)[cut] if len(raw) else np.zeros(len(cut), np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(at), raw.buffers()[2] if at[-1] else pa.py_buffer(b"")])
    try:
        return whole.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())


def _gathered(draws: list[tuple[np.ndarray, pa.RecordBatch]], name: str) -> pa.RecordBatch:
    """The first draw of every note of a slice, with a list of the note's other draws, best first."""
    first = draws[0][1]
    rows = np.concatenate([r for r, _ in draws[1:]] or [np.zeros(0, np.int64)])
    names = first.schema.names[1:]
    later = pa.Table.from_batches([t for _, t in draws[1:]] or [first.slice(0, 0)]).combine_chunks()
    columns = [pa.concat_arrays(later.column(c).chunks) if later.column(c).num_chunks else first.column(c).slice(0, 0) for c in names]
    order = np.argsort(rows, kind="stable")
    ends = np.searchsorted(rows[order], np.arange(len(first) + 1))
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(columns, names=names).take(pa.array(order)))
    return pa.RecordBatch.from_arrays([*first.columns, lists], names=[*first.schema.names, name])


def sample_segmentations(
    notes: DataFrame, model_path: str, record_id: str = "record_id", text: str = "notes", k: int = 3, alpha: float = 1.0, seed: int = 17, decoded: str | None = None,
    gathered: str | None = None,
) -> DataFrame:
    """Draw ``k`` distinct segmentations of every whole note, without replacement.

    ``model_path``: a SentencePiece model with byte pieces, read on the driver. Returns one row per note and draw: ``record_id``, ``draw`` (from
    1, in falling order of the perturbed score), ``n_pieces``, ``log_prob`` of the segmentation, its ``perturbed`` score, ``log_inclusion`` (log of
    the probability that the segmentation beats the best one not drawn; 0 if all were drawn) and ``pieces`` (ids). ``decoded`` names one more
    column: the text that the pieces spell, decoded from their ids in the task that drew them. With ``gathered`` a note is one row, its first draw,
    and that column lists its other draws in order.

    A note with fewer than ``k`` segmentations returns all it has: null and empty notes have one, without pieces. Equal ids draw with equal
    random numbers, so repeated rows repeat their results; a null id draws like 0. Characters that no piece spells become byte pieces. Memory
    in a task follows its longest note. Other columns are not read.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    vocab = Vocabulary(model_path, alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, SLICE):
            ids = pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False)
            others: list[tuple[np.ndarray, pa.RecordBatch]] = []
            for i, d in enumerate(segment(vocab, ids, b.column(1), k, seed)):
                rows = d["row"]
                if not len(rows):
                    continue
                x = d["log_prob"][rows] - d["kappa"][rows]
                with np.errstate(over="ignore"):
                    log_inc = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700)))))
                n = np.diff(d["offsets"])
                assert not n[~d["live"]].any()
                cut = np.concatenate([[0], np.cumsum(n[rows])])
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(d["pieces"].astype(np.int32)))
                columns = [b.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), i + 1, np.int32)), pa.array(n[rows].astype(np.int32)), pa.array(d["log_prob"][rows]), pa.array(d["perturbed"][rows]), pa.array(log_inc), lists]
                names = ["record_id", "draw", "n_pieces", "log_prob", "perturbed", "log_inclusion", "pieces"]
                if decoded:
                    columns, names = [*columns, spelled(vocab, d["pieces"], cut)], [*names, decoded]
                drawn = pa.RecordBatch.from_arrays(columns, names=names)
                if gathered:
                    others.append((rows, drawn))
                else:
                    yield drawn
            if others:
                yield _gathered(others, gathered)

    src = notes.select(F.col(record_id).cast("long").alias("record_id"), F.col(text).cast("string").alias("notes"))
    shape = OUT + (f", `{decoded}` string" if decoded else "")
    return src.mapInArrow(run, shape + (f", `{gathered}` array<struct<{shape.split(', ', 1)[1]}>>" if gathered else ""))


def decode_pieces(segmented: DataFrame, model_path: str, pieces: str = "pieces", out: str = "notes") -> DataFrame:
    """Add the text that piece ids spell; null stays null. Ids outside the vocabulary spell nothing, bytes that form no UTF-8 become U+FFFD."""
    vocab = Vocabulary(model_path)
    kinds = ", ".join(f"`{c}` {t}" for c, t in segmented.drop(out).dtypes)
    name = segmented.drop(out).columns

    def spell(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(name.index(pieces))
        flat = np.asarray(pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False), np.int64)
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        texts = spelled(vocab, flat, np.concatenate([[0], np.cumsum(n)]))
        return pa.RecordBatch.from_arrays([*b.columns, pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts)], names=[*name, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.cumsum(pc.fill_null(pc.list_value_length(b.column(name.index(pieces))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + DECODED, side="right")))
                yield spell(b.slice(lo, hi - lo))
                lo = hi

    return segmented.drop(out).mapInArrow(run, f"{kinds}, `{out}` string")
