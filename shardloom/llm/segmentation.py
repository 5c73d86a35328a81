"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement.

Of all segmentations of a text, each with its probability under the lattice, the k with the greatest
Gumbel-perturbed log probabilities are a sample without replacement. They are found by a perturbed A*
search. A region is a set of segmentations: those that share a path up to a lattice node and leave it by
none of some edges. Its bound is the greatest perturbed value inside it, drawn for the region as a whole,
as the logarithms of its mass are known exactly from the sums over all ways to the end. The search takes
the region of the greatest bound, draws its best segmentation, and splits what is left into regions that
turn off within ranges of later nodes. Bounds are exact, so the k-th region that is taken gives the k-th best
segmentation, and the work is k walks over the lattice whatever the number of segmentations.

The greatest bound that is left at the end is the threshold; a segmentation's inclusion score is the log
probability that its perturbed value exceeds it.

All draws follow from the row key (id and whole text), the number of the walk and the place, so that
equal rows have equal samples on any machine and at any partitioning.

Defined cases: null and empty texts have one segmentation without ids; a text with fewer than k
segmentations has as many rows as segmentations, and those have inclusion score 0 if none is left; characters without a piece are
encoded by their bytes; a text with U+2581 decodes to a space there; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm import textops as T
from shardloom.llm.common import row_key
from shardloom.llm.pieces import Lattices, Pieces, distinct
from shardloom.llm.units import spread

SAMPLES = 2
SLICE_BYTES = 1 << 19
_STEP, _UNIT, _WALK = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA3B195354A39B70D, 0x8BB84B93962EACC9))


def _times(n: int, factor: np.uint64) -> np.uint64:
    """The product modulo 2**64."""
    return np.uint64(n * int(factor) & (1 << 64) - 1)

_pieces: dict[tuple[str, float], Pieces] = {}


def pieces(path: str, steep: float) -> Pieces:
    """One vocabulary a worker and file."""
    if (path, steep) not in _pieces:
        _pieces[path, steep] = Pieces(path, steep)
    return _pieces[path, steep]


class Paths:
    """Edges of each text's path, one text after the other; ``sums``: log probabilities up to each step and to the end, from ``sums_at`` on."""

    def __init__(self, lattices: Lattices, edges: np.ndarray, at: np.ndarray, unit: np.ndarray):
        self.edges, self.at, self.unit = edges, at, unit
        self.sums_at = at[:-1] + np.arange(len(at) - 1)
        self.sums, log_p = np.zeros(len(edges) + len(at) - 1), lattices.log_p[edges]
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            np.cumsum(log_p[a:b], out=self.sums[a + i + 1 : b + i + 1])
        self.log_p = self.sums[self.sums_at + np.diff(at)]


def _below(top: float, log_mass: float, u: float) -> float:
    """The greatest of a Gumbel process of this mass, given that it is below ``top``."""
    return -np.inf if log_mass == -np.inf else -float(np.logaddexp(-top, math.log(-math.log(u)) - log_mass))


class Search:
    """The k best perturbed segmentations of every text of a slice.

    A region is (bound, walk, row of the walk, low, high, shut): the segmentations that leave the walk's path at a step from low
    to high (excluded). Of a region of one step, shut has the edges that they don't take; otherwise that is the path's own.
    """

    def __init__(self, p: Pieces, s: T.Slice, keys: np.ndarray, k: int):
        chars, starts, self.text_unit = p.units(s)
        where, self.back = distinct(chars, starts)
        self.n, self.keys = s.n, keys
        self.left = np.full(s.n, -np.inf)
        self.found: list[tuple[np.ndarray, Paths | None]] = []
        self.regions: list[list[tuple]] = [[] for _ in range(s.n)]
        if not len(where):
            self.found.append((np.arange(s.n), None))
            return
        self.lattices = Lattices(p, chars, starts[where], starts[where + 1])
        size = np.diff(self.text_unit)
        del chars, starts, where
        number = np.arange(len(self.back)) - np.repeat(self.text_unit[:-1], size)
        self.unit_key = T.mix(np.repeat(keys, size) + number.astype(np.uint64) * _UNIT)
        self._run(k)

    def _walk(self, unit: np.ndarray, node: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a random way from each node to its unit's end, and where each unit's begin (one more than units)."""
        lat, n = self.lattices, len(unit)
        key = self.unit_key[unit] + _times(walk, _WALK)
        on = np.flatnonzero(~lat.end[node])
        node, steps, step = node[on], [], 0
        count = np.zeros(n, np.int64)
        while len(on):
            edge = lat.first[node]
            some = np.flatnonzero(lat.cdf[edge] < np.inf)  # the others have one edge
            u = T.unit_interval(T.mix(key[on[some]] + _times(step, _STEP)))
            over = np.flatnonzero(u > lat.cdf[edge[some]])
            some, u = some[over], u[over]
            while len(some):
                edge[some] += 1
                over = np.flatnonzero(u > lat.cdf[edge[some]])
                some, u = some[over], u[over]
            steps.append((on.astype(np.int32), edge.astype(np.int32)))
            count[on] += 1
            node = lat.to[edge]
            go = np.flatnonzero(~lat.end[node])
            on, node, step = on[go], node[go], step + 1
        at = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(int(at[-1]), np.int32)
        for k, (who, edge) in enumerate(steps):
            out[at[who] + k] = edge
        return out, at

    def _run(self, k: int) -> None:
        units = np.arange(len(self.back))
        edges, at = self._walk(units, self.lattices.root[self.back], 0)
        texts, paths = np.arange(self.n), Paths(self.lattices, edges, at[self.text_unit], np.repeat(units, np.diff(at)))
        value = -np.log(-np.log(T.unit_interval(T.seeded(self.keys, 11))))  # the best of all: a Gumbel of mass 1
        turn = np.full(self.n, -1)
        for walk in range(k):
            self.found.append((texts, paths))
            self._ranges(walk, texts, paths, value, turn + 1)
            taken = [(t, r.pop(max(range(len(r)), key=lambda i: r[i][0]))) for t, r in enumerate(self.regions) if r] if walk + 1 < k else []
            if not taken:
                break
            value = np.array([r[0] for _, r in taken])
            texts, paths, turn = self._draw(taken, walk + 1)
        for t, r in enumerate(self.regions):
            if r:
                self.left[t] = max(x[0] for x in r)

    def _ranges(self, walk: int, texts: np.ndarray, paths: Paths, value: np.ndarray, start: np.ndarray) -> None:
        """Adds the regions that leave the paths at or after their start, in ranges of 1, 1, 2, 4, ... steps.

        The mass of a range is the difference of the probabilities of the paths up to its ends, so it needs no look at its steps.
        """
        first, size = paths.sums_at, np.diff(paths.at)
        key = T.mix(self.keys[texts] + _times(walk + 1, _WALK))
        low, width, j = start, 1, 0
        on = np.flatnonzero(low < size)
        while len(on):
            high = np.minimum(start[on] + width, size[on])
            a, b = paths.sums[first[on] + low[on]], paths.sums[first[on] + high]
            u = T.unit_interval(T.mix(key[on] + _times(j, _STEP)))
            with np.errstate(divide="ignore"):
                mass = a + np.log(-np.expm1(b - a))
                bound = -np.logaddexp(-value[on], np.log(-np.log(u)) - mass)
            for i, x, y, g, m in zip(on.tolist(), low[on].tolist(), high.tolist(), bound.tolist(), mass.tolist(), strict=True):
                if m > -np.inf:
                    self.regions[texts[i]].append((g, walk, i, x, y, None))
            low, width, j = start + width, 2 * width, j + 1
            on = np.flatnonzero(low < size)

    def _draw(self, taken: list, walk: int) -> tuple[np.ndarray, Paths, np.ndarray]:
        """The best segmentation of each region: a step, an edge that isn't shut, and a random rest. What the region has besides goes back, but
        for what leaves the new path later."""
        lat = self.lattices
        texts = np.array([t for t, _ in taken])
        own = T.mix(self.keys[texts] + _times(walk, _WALK))
        draws = np.stack([T.unit_interval(T.mix(own + np.uint64(101 + i))) for i in range(5)], 1).tolist()
        heads, head_units, edges, units, turns = [], [], [], [], []
        for (t, (top, w, i, low, high, shut)), u in zip(taken, draws, strict=True):
            base = self.found[w][1]
            a = int(base.at[i])
            sums = base.sums[int(base.sums_at[i]) :][low : high + 1]
            turn = low
            if high - low > 1:
                level = sums[0] + math.log1p(u[0] * math.expm1(sums[-1] - sums[0]))
                turn = low + max(0, min(int(np.searchsorted(-sums, -level, side="right")) - 1, high - low - 1))
                while turn > low and sums[turn - low] == sums[turn - low + 1]:  # a step without another edge
                    turn -= 1
                while sums[turn - low] == sums[turn - low + 1]:
                    turn += 1
            taken_edge = int(base.edges[a + turn])
            shut = shut or frozenset((taken_edge,))
            node = int(np.searchsorted(lat.first, taken_edge, side="right")) - 1
            free = [e for e in range(int(lat.first[node]), int(lat.first[node + 1])) if e not in shut]
            p = np.exp(lat.log_p[free] - lat.log_p[free].max()).cumsum()
            k = min(int(np.searchsorted(p, u[1] * p[-1])), len(free) - 1)
            before = float(sums[turn - low])
            back = self.regions[t]
            if len(free) > 1:
                rest = float(np.logaddexp.reduce(lat.log_p[free[:k] + free[k + 1 :]]))
                back.append((_below(top, before + rest, u[2]), w, i, turn, turn + 1, shut | {free[k]}))
            for x, y, v in ((low, turn, u[3]), (turn + 1, high, u[4])):
                if x < y and sums[x - low] > sums[y - low]:
                    mass = float(sums[x - low]) + math.log(-math.expm1(float(sums[y - low] - sums[x - low])))
                    back.append((_below(top, mass, v), w, i, x, y, None))
            heads.append(base.edges[a : a + turn])
            head_units.append(base.unit[a : a + turn + 1])
            edges.append(free[k])
            units.append(int(base.unit[a + turn]))
            turns.append(turn)
        unit, turn = np.array(units), np.array(turns)
        runs = self.text_unit[texts + 1] - unit
        first = np.concatenate(([0], np.cumsum(runs)))
        later = np.arange(int(first[-1])) + np.repeat(unit - first[:-1], runs)
        node = lat.root[self.back[later]]
        node[first[:-1]] = lat.to[edges]
        rest, at = self._walk(later, node, walk)
        steps, cut = np.repeat(later, np.diff(at)), at[first]
        out_e, out_u = [], []
        for i in range(len(taken)):
            out_e += [heads[i], [edges[i]], rest[cut[i] : cut[i + 1]]]
            out_u += [head_units[i], steps[cut[i] : cut[i + 1]]]
        ends = np.concatenate(([0], np.cumsum(turn + 1 + np.diff(cut))))
        return texts, Paths(lat, np.concatenate(out_e).astype(np.int32), ends, np.concatenate(out_u)), turn

    def samples(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each rank: texts, all ids, where each text's begin, log probability, inclusion score."""
        for texts, paths in self.found:
            if paths is None:
                yield texts, np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts)), np.zeros(len(texts))
                continue
            lat = self.lattices
            if len(lat.ids) == len(lat.log_p):
                ids, at = lat.ids[paths.edges], paths.at
            else:
                ids = spread(lat.ids, lat.ids_at, paths.edges)
                at = np.concatenate(([0], np.cumsum(lat.ids_at[paths.edges + 1] - lat.ids_at[paths.edges])))[paths.at]
            with np.errstate(divide="ignore", over="ignore"):
                gap = paths.log_p - self.left[texts]
                inclusion = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700)))))
            yield texts, ids, at, paths.log_p, inclusion


FIELDS = "doc_id long, rank int, n_ids long, ids_crc32 long, log_p double, log_inclusion double, decoded_crc32 long, decoded boolean"


def sample(docs: DataFrame, model: str, k: int = SAMPLES, steep: float = 1.0, ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its k sampled segmentations by rank: doc_id, rank, n_ids, ids_crc32 (little-endian unsigned 32-bit), log_p,
    log_inclusion, decoded_crc32 (of the text decoded from the ids), decoded (is that the text) and, on demand, ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model, steep)
        for b in batches:
            keys = b["k"].to_numpy().view(np.uint64)
            for s in T.slices(b["t"], SLICE_BYTES):
                source = s.data.tobytes()
                own = np.array([zlib.crc32(source[x:y]) for x, y in zip(s.text_at[:-1].tolist(), s.text_at[1:].tolist(), strict=True)], np.int64)
                search = Search(p, s, keys[s.row : s.row + s.n], k)
                for rank, (texts, found, at, log_p, inclusion) in enumerate(search.samples()):
                    raw, raw_at = p.decode(found, at)
                    small, raw = memoryview(found.astype("<u4")).cast("B"), memoryview(raw)
                    raw_from, raw_to = raw_at[:-1] + (np.diff(raw_at) > 0), raw_at[1:]  # without the leading space
                    crc = [zlib.crc32(small[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    back = np.array([zlib.crc32(raw[x:y]) for x, y in zip(raw_from.tolist(), raw_to.tolist(), strict=True)], np.int64)
                    same = (back == own[texts]) & (raw_to - raw_from == np.diff(s.text_at)[texts])
                    columns = [b["d"].take(pa.array(texts + s.row)), pa.array(np.full(len(texts), rank, np.int32)), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(log_p), pa.array(inclusion), pa.array(back), pa.array(same)]
                    names = ["doc_id", "rank", "n_ids", "ids_crc32", "log_p", "log_inclusion", "decoded_crc32", "decoded"]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), row_key(doc_id, text).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(encode, FIELDS + (", ids array<int>" if ids else ""))
