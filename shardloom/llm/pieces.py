"""The pieces of a SentencePiece model, and the segmentation lattices of many strings at once.

A text is a space and the text, with U+2581 for spaces, as the model has it. Between two characters that
are neighbours in no piece there is always a cut, so a text falls into units that are segmented apart
from each other. A batch of texts has few different units; their lattices are built together.
"""

from __future__ import annotations

import numpy as np

from shardloom.llm import textops as T

SPACE = 0x2581
OFF = -1e8
"""Longer pieces with a lower score than this are switched off in the model; a single character never is."""


class Pieces:
    """Pieces with their log probabilities: of a merge of rank r in proportion to ``(r + 2) ** -steep``."""

    def __init__(self, path: str, steep: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names, scores = [model.id_to_piece(i) for i in range(n)], np.array([model.get_score(i) for i in range(n)])
        self.byte_id = np.full(256, -1, np.int64)
        raw: list[bytes] = [b""] * n
        self.words: dict[str, int] = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                raw[i] = bytes([int(name[3:5], 16)])
                self.byte_id[raw[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw[i] = name.replace(chr(SPACE), " ").encode()
                if scores[i] > OFF or len(name) == 1:
                    self.words.setdefault(name, i)
        weight = -steep * np.log(2 - np.clip(scores, -n, 0))
        known = np.array(sorted(self.words.values()))
        self.log_p = weight - np.log(np.exp(weight[known]).sum())
        self.byte_log_p = float(self.log_p[known].min())
        self.raw, self.raw_size = raw, np.array([len(x) for x in raw])
        self._neighbours()
        self._tree()

    def _neighbours(self) -> None:
        pairs = {(ord(a), ord(b)) for w in self.words for a, b in zip(w, w[1:])}
        chars = sorted({c for p in pairs for c in p})
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[chars] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in pairs:
            self.joined[self.kind[a], self.kind[b]] = True

    def _tree(self) -> None:
        """A prefix tree; children are found in an open table of (node, character)."""
        nodes: dict[tuple[int, int], int] = {}
        piece = [-1]
        for w, i in self.words.items():
            node = 0
            for c in w:
                key = (node, ord(c))
                if key not in nodes:
                    nodes[key] = len(piece)
                    piece.append(-1)
                node = nodes[key]
            piece[node] = i
        self.node_piece = np.array(piece, np.int32)
        self.longest = max(map(len, self.words), default=1)
        keys = np.array([a << 21 | c for a, c in nodes], np.uint64)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table, self.child = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.full(1 << bits, -1, np.int32)
        for key, slot, to in zip(keys.tolist(), (T.mix(keys) >> self.shift).tolist(), nodes.values(), strict=True):
            while self.child[slot] >= 0:
                slot = (slot + 1) % len(self.table)
            self.table[slot], self.child[slot] = key, to

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each node by a character; -1 where there is none."""
        key = node.astype(np.uint64) << np.uint64(21) | char.astype(np.uint64)
        slot = (T.mix(key) >> self.shift).astype(np.int64)
        out = np.where(self.table[slot] == key, self.child[slot], np.int32(-1))
        on = np.flatnonzero((out < 0) & (self.child[slot] >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) % len(self.table)
            hit = self.table[slot[on]] == key[on]
            out[on[hit]] = self.child[slot[on[hit]]]
            on = on[~hit & (self.child[slot[on]] >= 0)]
        return out

    def units(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The characters of a slice's texts, where units start (and the end), and each text's first unit (one more than texts)."""
        chars = np.frombuffer(s.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.concatenate(([0], np.cumsum((s.data & 0xC0) != 0x80)))[s.text_at]
        some = np.diff(heads) > 0
        chars = np.insert(np.where(chars == 32, np.uint32(SPACE), chars), heads[:-1][some], SPACE)
        heads = heads + np.concatenate(([0], np.cumsum(some)))
        kinds = self.kind[chars]
        cut = np.ones(len(chars) + 1, bool)
        if len(chars):
            cut[1:-1] = ~self.joined[kinds[:-1], kinds[1:]]
        cut[heads] = True
        starts = np.flatnonzero(cut)
        return chars, starts, np.searchsorted(starts, heads)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of texts from their ids, each with a leading space unless it is empty, and where each begins."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw, np.concatenate(([0], np.cumsum(self.raw_size[ids])))[at]


def distinct(chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the units that stand for all, and for each unit which of those is equal to it, character by character."""
    return T.distinct_runs(np.ascontiguousarray(chars, "<u4").view(np.uint8), 4 * starts[:-1], 4 * starts[1:])


class Lattices:
    """The lattices of different units. A node is a place in a unit; an edge is a piece or a character's bytes.

    ``first``: a node's edges, from the likeliest on (one more than nodes); ``cdf`` and ``log_p``: of an edge
    given its node, summed over all ways to the end; ``to``: the node that it leads to; ``ids``, ``ids_at``:
    the ids of an edge; ``root``: a unit's first node; ``end``: which nodes are ends.
    """

    def __init__(self, p: Pieces, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        at = np.concatenate(([0], np.cumsum(size)))
        n = int(at[-1])
        own = chars[np.arange(n) + np.repeat(starts - at[:-1], size)]
        unit = np.repeat(np.arange(len(size)), size)
        left = at[1:][unit] - np.arange(n)
        place, length, piece = [], [], []
        left = left.astype(np.int32)
        where, node = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
        for k in range(1, p.longest + 1):
            node = p.step(node, own[where + k - 1])
            found = node >= 0
            where, node = where[found], node[found]
            known = p.node_piece[node] >= 0
            place.append(where[known])
            length.append(np.full(int(known.sum()), k, np.int8))
            piece.append(p.node_piece[node[known]])
            on = left[where] > k
            where, node = where[on], node[on]
            if not len(where):
                break
        alone = np.ones(n, bool)
        alone[place[0] if place else []] = False
        odd = np.flatnonzero(alone).astype(np.int32)
        place, length, piece = np.concatenate([*place, odd]), np.concatenate([*length, np.ones(len(odd), np.int8)]), np.concatenate([*piece, np.full(len(odd), -1, np.int32)])
        del where, node, alone
        width = np.ones(len(place), np.int8)
        if len(odd):
            code = own[odd]
            width[-len(odd) :] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        score = np.where(piece >= 0, p.log_p[piece], width * p.byte_log_p)

        order = np.argsort(left[place].astype(np.int64) * (n + 1) + place, kind="stable")  # all ways to the end, from the ends back
        place, length, piece, width, score = (x[order] for x in (place, length, piece, width, score))
        total = np.zeros(n + 1)
        value = np.empty(len(place))
        head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        step = np.searchsorted(left[place[head]], np.arange(1, int(left.max(initial=0)) + 2))
        last = length == left[place]
        for a, b in zip(step[:-1].tolist(), step[1:].tolist(), strict=True):
            if a < b:
                x, y = head[a], head[b] if b < len(head) else len(place)
                v = score[x:y] + np.where(last[x:y], 0, total[np.minimum(place[x:y] + length[x:y], n)])
                value[x:y] = v
                most = np.maximum.reduceat(v, head[a:b] - x)
                runs = np.diff(np.append(head[a:b], y))
                total[place[head[a:b]]] = most + np.log(np.add.reduceat(np.exp(v - np.repeat(most, runs)), head[a:b] - x))
        log_p = value - total[place]

        # the order of a node's edges depends on nothing else in the batch
        del value, total, score, head, last
        order = np.argsort((place.astype(np.int64) << 20) - (np.exp(np.minimum(log_p, 0)) * (1 << 19)).astype(np.int64), kind="stable")
        place, length, piece, width = (x[order] for x in (place, length, piece, width))
        self.log_p = np.minimum(log_p[order], 0)
        del log_p, order
        node = place + unit[place].astype(np.int32)
        count = np.bincount(node, minlength=n + len(size))
        self.first = np.concatenate(([0], np.cumsum(count)))
        self.to = node + length
        self.end = count == 0
        self.root = at[:-1] + np.arange(len(size))
        self.cdf = np.exp(self.log_p)
        for k in range(1, int(count.max(initial=0))):
            e = self.first[:-1][count > k] + k
            self.cdf[e] += self.cdf[e - 1]
        self.cdf[self.first[1:][count > 0] - 1] = np.inf
        one = count[node] == 1
        self.log_p[one] = 0
        self.ids_at = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        self.ids = np.repeat(piece, width)
        for e in np.flatnonzero(piece < 0).tolist():
            self.ids[self.ids_at[e] : self.ids_at[e + 1]] = p.byte_id[np.frombuffer(chr(own[place[e]]).encode("utf-8", "surrogatepass"), np.uint8)]
