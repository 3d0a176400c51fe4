"""Sampled SentencePiece segmentations without replacement, and decoding.

All segmentations of a text form a lattice: nodes between characters, an edge for each piece of the vocabulary, byte pieces
for characters that it lacks. Edge weights are (rank + SHIFT) ** -alpha, after the place of a piece in the vocabulary; a
backward pass turns them into a distribution over paths. Gumbel top-k picks k distinct paths: a search ordered by perturbed
log-probability (A-star: the perturbed maximum of a set of paths is an exact bound) pops the best set, follows it down to
its maximal path by sampling, and pushes the sets of paths that leave that path, one for each step, with Gumbel maxima
truncated at the popped value. After k paths the next bound is the threshold of the inclusion scores.

The lattice falls apart at blanks and line ends, so its parts are kept for as long as they recur, and a batch of texts is
followed in lockstep by numpy. Random numbers come from a hash of seed, row key, path and place: a row gets the same
paths in any batch or partition.

Defined results: a null or empty text has one path, without pieces, of probability 1; a text with fewer than k
segmentations gives all it has; equal keys and texts give equal paths; a null key is a key of its own. Extra columns are
not looked at. Texts of any length are taken whole, and decoding gives back every text exactly, U+2581 included.
"""

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.rolling import HASH_STEP, Powers
from loomery.llm.shared import lean, quoted, trim

ALPHA = 0.5
SHIFT = 10.0
PATHS = 2
SEED = 17
BATCH_CHARS = 150_000
KEPT_STATES = 500_000
SLOT_BITS = 19
SPACE = "▁"
NO_SET = -np.inf


def uniforms(a: np.ndarray, b) -> np.ndarray:
    """Numbers in (0, 1) from two columns of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (a ^ (np.uint64(0x9E3779B97F4A7C15) * (b + np.uint64(1)))).astype(np.uint64)
        for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            h ^= h >> np.uint64(30)
            h *= np.uint64(m)
        h ^= h >> np.uint64(31)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def key_seed(key, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(repr(key).encode("utf-8", "surrogatepass"), seed)


class Vocabulary:
    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.weight: dict[str, tuple[int, float]] = {}
        for i in range(len(model)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace(SPACE, " ")
                self.bytes_of.append(text.encode())
                self.weight[text] = (i, -alpha * float(np.log(i + SHIFT)))
        self.byte_weight = -alpha * float(np.log(len(model) + SHIFT))
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.lengths = np.array([len(x) for x in self.bytes_of], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode_bytes(self, ids) -> bytes:
        """The bytes of ids, gathered from one table; the blank that encoding puts in front is taken off."""
        ids = np.asarray(ids, np.int64)
        many = self.lengths[ids]
        ends = np.cumsum(many)
        places = np.repeat(self.starts[ids] - ends + many, many)
        places += np.arange(len(places))
        return self.flat[places].tobytes().removeprefix(b" ")

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "surrogatepass")


class Grown:
    """An array that rows are added to, with room to spare."""

    def __init__(self, dtype, first=()):
        self.data, self.n = np.array(first, dtype), len(first)

    def keep(self, mask: np.ndarray) -> None:
        """Only the rows of the mask, in the same room."""
        few = self.data[: self.n][mask]
        self.n = len(few)
        self.data[: self.n] = few

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            room = np.empty(self.n + len(values) + (self.n >> 1), self.data.dtype)
            room[: self.n] = self.data[: self.n]
            self.data = room
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


def part_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the parts begin: no piece crosses a line end, U+2581 or the front of a run of blanks."""
    alone = (codes == 10) | (codes == 0x2581)
    blank = codes == 32
    cut = alone | blank
    cut[1:] &= alone[1:] | ~blank[:-1]
    cut[1:] |= alone[:-1]
    cut[text_starts] = True
    return np.flatnonzero(cut)


class Lattice:
    """The parts met so far as one graph: a state for each place in a part and one behind, edges by state, shortest first.

    Parts recur, so a worker keeps their graph from batch to batch, by the hashes of the parts, and builds that of new ones
    only; beyond KEPT_STATES it lets go of those met once. All places walk the trie of the vocabulary together, a character a step; its
    nodes are sorted hashes of prefixes.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        nodes: dict[int, int] = {}
        self.longest = 0
        for text, (number, _) in vocabulary.weight.items():
            h = 0
            for c in text:
                h = (h * HASH_STEP + ord(c) + 1) % (1 << 64)
                nodes.setdefault(h, -1)
            nodes[h] = number
            self.longest = max(self.longest, len(text))
        # a table of slots: the nodes of a slot stand in a row, their ends mark it
        keys = np.fromiter(nodes, np.uint64, len(nodes))
        slot = self._slots(keys)
        order = np.argsort(slot, kind="stable")
        self.node_keys = np.r_[keys[order], np.uint64(0)]
        self.node_piece = np.r_[np.fromiter(nodes.values(), np.int64, len(nodes))[order], -1]
        self.slot_ends = np.searchsorted(slot[order], np.arange(-1, 1 << SLOT_BITS), side="right")
        self.weights = np.zeros(len(vocabulary.bytes_of))
        for number, weight in vocabulary.weight.values():
            self.weights[number] = weight
        self.powers = Powers()
        self.forget()

    @staticmethod
    def _slots(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _nodes(self, h: np.ndarray) -> np.ndarray:
        """The places of nodes by hash, or the last, which is none."""
        slot = self._slots(h)
        at, end = self.slot_ends[slot], self.slot_ends[slot + 1]
        none = len(self.node_keys) - 1
        found = np.where((at < end) & (self.node_keys[at] == h), at, none)
        more = np.flatnonzero((found == none) & (at + 1 < end))
        while len(more):
            at[more] += 1
            hit = self.node_keys[at[more]] == h[more]
            found[more[hit]] = at[more[hit]]
            more = more[~hit & (at[more] + 1 < end[more])]
        return found

    def forget(self) -> None:
        self.keys, self.number_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes of parts, and their numbers
        self._first, self._uses = Grown(np.int64), Grown(np.int32)  # of each part
        self._start, self._ended = Grown(np.int32, [0]), Grown(bool)  # the first edge of each state
        self._log, self._leave, self._below, self._size = Grown(float), Grown(float), Grown(float), Grown(np.int32)  # of each edge
        self._id_start, self._id_flat = Grown(np.int32, [0]), Grown(np.int32)
        self._bind()

    def numbers(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of the parts of a batch; new ones are added to the graph. Numbers hold until the next call."""
        if self._ended.n > KEPT_STATES:
            self._thin()
        h = self.powers.hashes(codes, starts, starts + sizes)
        own, at, which = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, own)
        new = np.ones(len(own), bool)
        if len(self.keys):
            new = self.keys[np.minimum(place, len(self.keys) - 1)] != own
        if new.any():
            known = len(self.keys)
            begin, many = starts[at[new]], sizes[at[new]]
            ends = np.cumsum(many)
            self._add(codes[np.repeat(begin - ends + many, many) + np.arange(ends[-1])], many)
            self.keys = np.insert(self.keys, place[new], own[new])
            self.number_of = np.insert(self.number_of, place[new], np.arange(known, known + len(begin)))
            place = np.searchsorted(self.keys, own)
        self._bind()
        number = self.number_of[place]
        self._uses.data[number] += np.bincount(which, minlength=len(own)).astype(np.int32)
        return number[which]

    def _thin(self) -> None:
        """Lets go of the parts that were met once since the last time, or of all if the others are many."""
        kept = self._uses.data[: self._uses.n] > 1
        states, first = self._ended.n, self._first.data[: self._first.n]
        of_state = np.repeat(kept, np.diff(np.r_[first, states]))
        if 2 * of_state.sum() > KEPT_STATES:
            self.forget()
            return
        edges, ids = (np.diff(x.data[: x.n]) for x in (self._start, self._id_start))
        of_edge = np.repeat(of_state, edges)
        of_id = np.repeat(of_edge, ids)
        sizes = np.diff(np.r_[first, states])[kept]
        self._ended.keep(of_state)
        for edge_wise in (self._log, self._leave, self._below, self._size):
            edge_wise.keep(of_edge)
        self._id_flat.keep(of_id)
        for grown, values in ((self._start, np.cumsum(edges[of_state])), (self._id_start, np.cumsum(ids[of_edge])), (self._first, np.cumsum(sizes) - sizes), (self._uses, np.zeros(len(sizes)))):
            grown.n = 1 if grown is self._start or grown is self._id_start else 0
            grown.add(values)
        mine = kept[self.number_of]
        self.keys, self.number_of = self.keys[mine], (np.cumsum(kept) - 1)[self.number_of[mine]]
        self._bind()

    def _bind(self) -> None:
        self.first, self.start, self.ended = self._first.data, self._start.data, self._ended.data
        self.log, self.leave, self.below, self.size = self._log.data, self._leave.data, self._below.data, self._size.data
        self.id_start, self.id_flat = self._id_start.data, self._id_flat.data

    def _add(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        parts, n, ends = len(sizes), len(codes), np.cumsum(sizes)
        end_of, part_of = np.repeat(ends, sizes), np.repeat(np.arange(parts), sizes)
        state_of = np.arange(n) + part_of
        found: list[tuple] = []
        alive, h = np.arange(n), np.zeros(n, np.uint64)
        single = np.zeros(n, bool)
        for size in range(1, self.longest + 1):
            inside = np.flatnonzero(alive + size <= end_of[alive])
            alive = alive[inside]
            if not len(alive):
                break
            with np.errstate(over="ignore"):
                h = h[inside] * np.uint64(HASH_STEP) + codes[alive + size - 1] + np.uint64(1)
            node = self._nodes(h)
            hit = np.flatnonzero(node < len(self.node_keys) - 1)
            alive, h, number = alive[hit], h[hit], self.node_piece[node[hit]]
            real = np.flatnonzero(number >= 0)
            found.append((alive[real], size, number[real]))
            if size == 1:
                single[alive[real]] = True
        # characters that are no piece: one edge of their bytes
        lacking = np.flatnonzero(~single)
        others, which = np.unique(codes[lacking], return_inverse=True)
        spelled = [tuple(self.vocabulary.byte_ids[b] for b in chr(int(c)).encode("utf-8", "surrogatepass")) for c in others]
        found.append((lacking, 1, len(self.weights) + which))
        weights = np.r_[self.weights, np.array([self.vocabulary.byte_weight * len(x) for x in spelled])]
        each = np.zeros(n, np.int64)
        for where, _, _ in found:
            each[where] += 1
        free = np.cumsum(each) - each  # the next free edge of each place
        place = np.repeat(np.arange(n), each)
        size, number = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        for where, long, pieces in found:
            spot = free[where]
            size[spot], number[spot] = long, pieces
            free[where] += 1
        weight, source = weights[number], state_of[place]

        # backwards: the mass of all ways from a state to the end of its part, by distance to the end
        rest = np.zeros(n + parts)
        distance = (end_of - np.arange(n))[place]
        small = distance.astype(np.uint16) if len(distance) and distance.max() < 1 << 16 else distance
        by = np.argsort(small, kind="stable")
        cuts = np.flatnonzero(np.diff(distance[by])) + 1
        for group in np.split(by, cuts) if len(by) else []:
            values = weight[group] + rest[source[group] + size[group]]
            heads = np.r_[0, np.flatnonzero(np.diff(source[group])) + 1]
            rest[source[group[heads]]] = np.logaddexp.reduceat(values, heads)
        log = np.minimum(0.0, weight + rest[source + size] - rest[source])
        counts = np.bincount(source, minlength=n + parts)
        start = np.r_[0, np.cumsum(counts)]
        upto = np.r_[0.0, np.cumsum(np.exp(log))]
        below = upto[:-1] - upto[start[source]]
        below[start[:-1][counts > 0]] = -1.0
        many = np.r_[np.ones(len(self.weights), np.int64), np.array([len(x) for x in spelled], np.int64)][number]
        id_start = np.r_[0, np.cumsum(many)]
        flat = np.zeros(int(id_start[-1]), np.int32)
        plain = number < len(self.weights)
        flat[id_start[:-1][plain]] = number[plain]
        for edge in np.flatnonzero(~plain):
            flat[id_start[edge] : id_start[edge + 1]] = spelled[number[edge] - len(self.weights)]

        self._first.add(self._ended.n + ends - sizes + np.arange(parts))
        self._uses.add(np.zeros(parts, np.int32))
        self._start.add(self._start.data[self._start.n - 1] + start[1:])
        self._ended.add(counts == 0)
        self._log.add(log)
        with np.errstate(divide="ignore"):
            # the share of all other edges; a state's only edge has none
            self._leave.add(np.where(counts[source] > 1, np.log(-np.expm1(np.minimum(log, -1e-16))), NO_SET))
        self._below.add(below)
        self._size.add(size)
        self._id_start.add(self._id_start.data[self._id_start.n - 1] + id_start[1:])
        self._id_flat.add(flat)


class Paths:
    """Steps of one path for each text of a batch, in order: text, place, state, edge."""

    def __init__(self, text, place, state, edge):
        order = np.argsort(text * (1 << 40) + place, kind="stable")
        self.text, self.place, self.state, self.edge = text[order], place[order], state[order], edge[order]


def follow(lattice: Lattice, text, place, state, seeds: np.ndarray):
    """Samples edges from the given states to the ends of their parts."""
    steps = []
    while len(state):
        u = uniforms(seeds[text], place.astype(np.uint64))
        edge = lattice.start[state + 1] - 1
        over = np.flatnonzero(lattice.below[edge] > u)
        while len(over):  # the longest pieces come last and mostly are taken
            edge[over] -= 1
            over = over[lattice.below[edge[over]] > u[over]]
        steps.append((text, place, state, edge))
        size = lattice.size[edge]
        state, place = state + size, place + size
        more = np.flatnonzero(~lattice.ended[state])
        text, place, state = text[more], place[more], state[more]
    return steps


def joined(steps) -> list[np.ndarray]:
    if not steps:
        return [np.zeros(0, np.int64)] * 4
    return [np.concatenate([s[i] for s in steps]) for i in range(4)]


class Sampler:
    def __init__(self, path: str, k: int = PATHS, alpha: float = ALPHA, seed: int = SEED):
        self.vocabulary = Vocabulary(path, alpha)
        self.lattice = Lattice(self.vocabulary)
        self.k, self.seed = k, seed

    def batch(self, keys: list, texts: list[str | None]):
        """For each text its paths, best first: (ids, log-probability, log of the inclusion score)."""
        lattice, k = self.lattice, self.k
        n = len(texts)
        whole = [" " + text if text else "" for text in texts]
        codes = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, whole), np.int64, n)
        begins = np.cumsum(lengths) - lengths
        starts = part_starts(codes, begins[lengths > 0])
        sizes = np.diff(np.r_[starts, len(codes)])
        number = lattice.numbers(codes, starts, sizes)
        state = lattice.first[number]
        text = np.repeat(np.arange(n), lengths)[starts]
        place = starts - begins[text]
        base = np.array([key_seed(key, self.seed) for key in keys], np.uint64)
        of_path = lambda r, what: (base ^ np.uint64((r * 4 + what + 1) * 0x632BE59BD9B4E019 % (1 << 64)))

        top = -np.log(-np.log(uniforms(of_path(0, 2), np.zeros(n, np.uint64))))
        paths: list = []
        heaps: list[list] = [[] for _ in range(n)]  # (-bound, path, step or -1, (prefix, state, place, edges left out))
        emitted: list[list] = [[] for _ in range(n)]
        first = Paths(*joined(follow(lattice, text, place, state, of_path(0, 0))))
        self._push(paths, heaps, emitted, first, np.zeros(n, np.int64) - 1, top, of_path(0, 1), np.ones(n, bool))
        occurrence = np.searchsorted(text, np.arange(n + 1))
        for r in range(1, k):
            alive = np.zeros(n, bool)
            bound, from_place = np.full(n, NO_SET), np.full(n, np.iinfo(np.int64).max)
            old = np.full(n, -1)
            begun = []
            for i in range(n):
                if not heaps[i]:
                    continue
                g, path, step, (prefix, at, where, out) = heapq.heappop(heaps[i])
                self._next_of(paths, heaps, i, path, step)
                edges = [e for e in range(lattice.start[at], lattice.start[at + 1]) if e not in out]
                odds = np.exp(lattice.log[edges] - lattice.log[edges].max())
                u = uniforms(of_path(r, 3)[i : i + 1], np.array([where], np.uint64))[0]
                edge = edges[min(len(edges) - 1, int(np.searchsorted(np.cumsum(odds) / odds.sum(), u, side="right")))]
                alive[i], bound[i], from_place[i], old[i] = True, -g, where, path
                begun.append((i, where, at, edge))
                self._push_rest(heaps, i, path, prefix, at, where, (*out, edge), -g, of_path(r, 3)[i : i + 1])
            if not begun:
                break
            new = [np.array(x, np.int64) for x in zip(*begun)]
            steps = [tuple(new)]
            for path in {int(x) for x in old if x >= 0}:
                p = paths[path][0]
                keep = (old[p.text] == path) & (p.place < from_place[p.text])
                steps.append((p.text[keep], p.place[keep], p.state[keep], p.edge[keep]))
            end_state, end_place = new[2] + lattice.size[new[3]], new[1] + lattice.size[new[3]]
            inside = ~lattice.ended[end_state]
            later = np.concatenate([np.arange(np.searchsorted(place[occurrence[i] : occurrence[i + 1]], p) + occurrence[i], occurrence[i + 1]) for i, p in zip(new[0], np.where(inside, new[1] + 1, end_place))] or [np.zeros(0, np.int64)])
            go = (np.r_[new[0][inside], text[later]], np.r_[end_place[inside], place[later]], np.r_[end_state[inside], state[later]])
            steps += follow(lattice, *go, of_path(r, 0))
            self._push(paths, heaps, emitted, Paths(*joined(steps)), from_place, bound, of_path(r, 1), alive)
        out = []
        for i in range(n):
            limit = -heaps[i][0][0] if heaps[i] else NO_SET
            own = []
            for ids, logp in emitted[i]:
                x = logp - limit if np.isfinite(limit) else np.inf
                score = x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 50.0)))))
                own.append((ids, logp, score))
            out.append(own)
        return out

    def _push(self, paths, heaps, emitted, path: Paths, beyond, bound, seeds, alive):
        """Emits the paths of the texts alive, and pushes the best set that leaves each beyond a place."""
        lattice = self.lattice
        ends = np.searchsorted(path.text, np.arange(len(alive) + 1))
        total = np.r_[0.0, np.cumsum(lattice.log[path.edge])] if len(path.edge) else np.zeros(1)
        prefix = total[:-1] - total[ends[:-1]][path.text]
        # the perturbed value of a set of mass m is -log(exp(-bound) - log(u) / m): the order is that of log(-log(u)) - log(m)
        cost = np.full(len(path.text), np.inf)
        open_ = np.flatnonzero((lattice.leave[path.edge] > NO_SET) & (path.place > beyond[path.text])) if len(path.edge) else np.zeros(0, np.int64)
        u = uniforms(seeds[path.text[open_]], path.place[open_].astype(np.uint64))
        cost[open_] = np.log(-np.log(u)) - prefix[open_] - lattice.leave[path.edge[open_]] if len(open_) else 0.0
        paths.append((path, cost, prefix, ends, bound))
        if len(path.edge):
            counts = (lattice.id_start[path.edge + 1] - lattice.id_start[path.edge]).astype(np.int64)
            upto = np.r_[0, np.cumsum(counts)]
            ids = lattice.id_flat[np.repeat(lattice.id_start[path.edge] - upto[:-1], counts) + np.arange(upto[-1])]
            id_ends = upto[ends]
        else:
            ids, id_ends = np.zeros(0, np.int32), ends
        for i in np.flatnonzero(alive):
            emitted[i].append((ids[id_ends[i] : id_ends[i + 1]], float(total[ends[i + 1]] - total[ends[i]])))
            self._next_of(paths, heaps, i, len(paths) - 1, 0)

    @staticmethod
    def _next_of(paths, heaps, i: int, number: int, step: int):
        """Pushes the best set of a path that is not pushed yet; step is -1 for what was left of an opened set."""
        if step < 0:
            return
        path, cost, prefix, ends, bound = paths[number]
        a, b = ends[i], ends[i + 1]
        if a < b:
            best = a + int(np.argmin(cost[a:b]))
            if cost[best] < np.inf:
                key = float(np.logaddexp(-bound[i], cost[best]))
                heapq.heappush(heaps[i], (key, number, best, (prefix[best], int(path.state[best]), int(path.place[best]), (int(path.edge[best]),))))
                cost[best] = np.inf

    def _push_rest(self, heaps, i, path, prefix, at, where, out, bound, seed):
        """Pushes what is left of a set when one more of its edges is opened."""
        lattice = self.lattice
        left = [e for e in range(lattice.start[at], lattice.start[at + 1]) if e not in out]
        if left:
            mass = prefix + float(np.logaddexp.reduce(lattice.log[left]))
            u = uniforms(seed ^ np.uint64(len(out)), np.array([where], np.uint64))[0]
            value = -float(np.logaddexp(-bound, np.log(-np.log(u)) - mass))
            heapq.heappush(heaps[i], (-value, path, -1, (prefix, at, where, out)))


_samplers: dict = {}


def sampler_of(path: str, k: int, alpha: float, seed: int) -> Sampler:
    """One sampler for each worker process: its vocabulary outlasts a task, its lattice does not."""
    if (path, k, alpha, seed) not in _samplers:
        _samplers.clear()
        _samplers[path, k, alpha, seed] = Sampler(path, k, alpha, seed)
    return _samplers[path, k, alpha, seed]


def sample_pieces(
    docs: DataFrame, model: str, k: int = PATHS, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """(doc_id, path, n_pieces, log_prob, log_inclusion, ids_crc32, round_trip, ids): k rows a text, at most.

    model is the path of a SentencePiece file, read on the executors. round_trip says whether decoding gives the text back.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, path int, n_pieces long, log_prob double, log_inclusion double, ids_crc32 long, round_trip boolean"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches):
        import pyarrow as pa

        sampler = sampler_of(model, k, alpha, seed)
        sampler.lattice.forget()
        decode = sampler.vocabulary.decode_bytes
        names = ["doc_id", "path", "n_pieces", "log_prob", "log_inclusion", "ids_crc32", "round_trip", "ids"]
        kinds = [None, pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
        for batch in batches:
            at = 0
            kinds[0] = batch.schema.types[0]
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and size < BATCH_CHARS:
                    texts.append(batch.column(1)[at + len(texts)].as_py())
                    size += len(texts[-1] or "")
                keys = batch.column(0).slice(at, len(texts)).to_pylist()
                at += len(texts)
                rows = []
                for key, text, paths in zip(keys, texts, sampler.batch(keys, texts)):
                    body = (text or "").encode("utf-8", "surrogatepass")
                    for r, (ids, logp, score) in enumerate(paths):
                        rows.append((key, r + 1, len(ids), logp, score, zlib.crc32(ids.astype("<u4").tobytes()), decode(ids) == body, ids))
                columns = list(zip(*rows))[: 8 if with_ids else 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names[: len(columns)])
                trim()
        sampler.lattice.forget()

    return docs.select(F.col(quoted(id_col)), F.col(quoted(text_col))).mapInArrow(lean(run), schema)


def decode_pieces(df: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the text of an array of ids in text_col; null ids give a null text."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voc = Vocabulary(model)
        for ids in batches:
            yield pd.Series([None if x is None else voc.decode(x) for x in ids], dtype=object)

    return df.withColumn(text_col, decoded(F.col(quoted(ids_col))))


def op7_sampled_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sample_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
