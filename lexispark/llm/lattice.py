"""The lattices of many short stretches at once, with arrays: a level is a boundary, its nodes are the distinct beginnings of that
length of all stretches, and every step below is taken for all nodes of a level together.

Only for models of the BPE type, where one edge into each node qualifies, and for stretches of known characters that fit into
one window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Table:
    """64-bit keys, 0 or above, with small values; open addressing, so that many keys are looked up in a few steps."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -1 for those that are not there."""
        at = self.slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & len(self.keys) - 1
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not there yet."""
        self.size += len(keys)
        while 2 * self.size > len(self.keys):
            held = self.keys >= 0
            keys, values = np.concatenate((self.keys[held], keys)), np.concatenate((self.values[held], values))
            self.bits += 1
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = keys[left[free]]  # of two that want a slot one gets it
            got = self.keys[at[left]] == keys[left]
            self.values[at[left[got]]] = values[left[got]]
            left = left[~got]
            at[left] = at[left] + 1 & len(self.keys) - 1


class Lattices:
    """pieces: by id, None for ids that stand for no piece. apart: whether two pieces, by id, stay apart as neighbours; most: the number of
    pairs beyond which what is known of them is forgotten."""

    def __init__(self, pieces: list[str | None], apart: Callable[[int, int], bool], most: int):
        self.apart, self.most, self.n, self.pairs = apart, most, len(pieces), Table()
        self.length = np.array([len(p or "") for p in pieces], np.int64)
        single = sorted(p for p in pieces if p and len(p) == 1)
        self.codes = {c: k for k, c in enumerate(single)}
        self.width = len(single)
        self.code = np.full(0x110000, -1, np.int32)
        self.code[[ord(c) for c in single]] = np.arange(self.width)
        # The trie of all pieces: state * width + code -> state, and the piece that ends in a state.
        known, ends = {"": 0}, {}
        for i, p in enumerate(pieces):
            if p and all(c in self.codes for c in p):
                for k in range(1, len(p) + 1):
                    known.setdefault(p[:k], len(known))
                ends[known[p]] = i
        self.ends = np.full(len(known), -1, np.int32)
        self.ends[list(ends)] = list(ends.values())
        self.trie = Table()
        steps = [(known[p[:-1]] * self.width + self.codes[p[-1]], s) for p, s in known.items() if p]
        self.trie.put(*(np.array(x, kind) for x, kind in zip(zip(*steps, strict=True), (np.int64, np.int32), strict=True)))

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.n + right
        known = self.pairs.get(keys)
        if (known < 0).any():
            new = np.unique(keys[known < 0])
            if self.pairs.size + len(new) > self.most:
                self.pairs, new = Table(), np.unique(keys)
            self.pairs.put(new, np.array([self.apart(*divmod(k, self.n)) for k in new.tolist()], np.int32))
            known = self.pairs.get(keys)
        return known > 0

    def encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted distinct stretches: whether each is of known characters (others have no ids), the ids of all of them
        end to end, and how many each has."""
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        flat = self.code[np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins = np.cumsum(sizes) - sizes
        known = np.ones(len(sizes), bool)
        known[np.repeat(np.arange(len(sizes)), sizes)[flat < 0]] = False
        rows = np.flatnonzero(known & (sizes > 0))
        sizes, begins, counts = sizes[rows], begins[rows], np.zeros(len(known), np.int64)
        if not len(rows):
            return known, np.empty(0, np.int32), counts
        width = int(sizes.max())
        text = np.full((len(rows), width), -1, np.int32)
        inside = np.arange(width) < sizes[:, None]
        text[inside] = flat[(begins[:, None] + np.arange(width))[inside]]
        same = np.zeros(len(rows), np.int64)  # characters shared with the stretch before
        same[1:] = np.cumprod((text[1:] == text[:-1]) & inside[1:], 1).sum(1)
        # Of the level before: the node of each stretch, the last pieces at the boundaries of each node, and the open edges, by node.
        node = np.zeros(len(rows), np.int64)
        last = np.full((1, 1), -1, np.int32)
        offsets, start, state = np.zeros(2, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        found, which = [], np.arange(len(rows))
        for at in range(1, width + 1):
            long = sizes[which] >= at
            which, node = which[long], node[long]
            new = same[which] < at
            parent, code = node[new], text[which[new], at - 1]
            node = np.cumsum(new) - 1
            # The open edges of the parents, and one more from the last boundary, go on with the node's character.
            n, n_open = len(parent), offsets[parent + 1] - offsets[parent]
            of = np.repeat(np.arange(n), n_open)
            taken = np.repeat(offsets[parent] - np.cumsum(n_open) + n_open, n_open) + np.arange(len(of))
            all_of, all_start, all_state = (np.empty(len(of) + n, np.int64) for _ in range(3))
            place, begun = np.arange(len(of)) + of, np.cumsum(n_open + 1) - 1
            all_of[place], all_start[place], all_state[place] = of, start[taken], state[taken]
            all_of[begun], all_start[begun], all_state[begun] = np.arange(n), at - 1, 0
            state = self.trie.get(all_state * self.width + code[all_of])
            alive = state >= 0
            of, start, state = all_of[alive], all_start[alive], state[alive].astype(np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n))))
            # Edges that end here: one into each node qualifies.
            piece = self.ends[state]
            ended = np.flatnonzero(piece >= 0)
            piece, into = piece[ended], of[ended]
            before = last[parent[into], start[ended]]
            good = before < 0
            inner = np.flatnonzero(~good)
            good[inner] = self.stay_apart(before[inner], piece[inner])
            reached = np.full(n, -1, np.int32)
            reached[into[good]] = piece[good]
            if (reached < 0).any() or good.sum() != n:
                raise ValueError("not one edge into each node")
            last = np.concatenate((last[parent], reached[:, None]), 1)
            if len(done := np.flatnonzero(sizes[which] == at)):
                found.append((which[done], *self.traced(last[node[done]], at)))
        order = np.argsort(np.concatenate([w for w, *_ in found]), kind="stable")
        lengths = np.concatenate([k for _, _, k in found])
        ids = np.concatenate([x for _, x, _ in found])
        counts[rows] = lengths[order]
        # The ids in the order of the stretches.
        starts = (np.cumsum(lengths) - lengths)[order]
        shift = starts - (np.cumsum(lengths[order]) - lengths[order])
        return known, ids[np.repeat(shift, lengths[order]) + np.arange(len(ids))], counts

    def traced(self, last: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the paths back from boundary `at`, end to end, and how many each has."""
        row, place = np.arange(len(last)), np.full(len(last), at)
        back = np.full((len(last), at), -1, np.int32)
        for k in range(at - 1, -1, -1):
            piece = last[row, place]
            back[:, k] = piece  # -1 at the begin
            place = place - np.where(piece >= 0, self.length[piece], 0)
            if not place.any():
                break
        inside = back >= 0
        return back[inside], inside.sum(1)
