"""Tokenizing by distinct units.

Tokenizers with the usual byte-level pattern (contractions, `` ?letters``, `` ?digits``, `` ?others``,
white space) split every text before they merge. A new part always starts at a single space or a
single line feed between two visible characters, and at ASCII punctuation after a letter, so a text
may be cut there and its cuts encoded apart. Strings of added tokens are never cut. A batch of texts
has few distinct cuts; each is encoded once and the results are put together with numpy. Cuts are found equal
by a hash and then compared byte by byte, and the store of a worker is keyed by their bytes. The ids are those of the whole text.

Vocabulary files with another pattern, a normalizer or added tokens that take spaces in are not cut: each text is one unit.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np

from shardloom.llm import textops as T

MOST_HELD = 600_000
"""Units that a worker keeps between batches, to bound its memory; beyond it the store starts anew."""


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[0x21:0x7F] = True
_PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _letter_before(d: np.ndarray) -> np.ndarray:
    """Where the byte before ends a letter: ASCII, or U+00C0 to U+00FF without the two signs among them."""
    out = np.zeros(len(d), bool)
    out[1:] = _LETTER[d[:-1]]
    out[2:] |= (d[:-2] == 0xC3) & (d[1:-1] != 0x97) & (d[1:-1] != 0xB7)
    return out


def cuts(s: T.Slice, whole: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where units start (and the end of the data), and for each text its first unit (one more than texts).

    whole: strings that are never cut inside.
    """
    d, n = s.data, len(s.data)
    if not n:
        return np.zeros(1, np.int64), np.zeros(s.n + 1, np.int64)
    ascii_seen = (d > 0x20) & (d < 0x7F)
    lead = (d >= 0xC3) & (d <= 0xDF)
    before = ascii_seen.copy()
    before[1:] |= lead[:-1] & (d[1:] >= 0x80)
    after = ascii_seen | lead
    at = np.zeros(n + 1, bool)
    between = np.zeros(n, bool)
    between[1:-1] = before[:-2] & after[2:]
    first, last = s.text_at[:-1], s.text_at[1:] - 1
    some = last >= first
    between[first[some]] = False  # a text's first and last byte have no neighbour
    between[last[some]] = False
    feed = between & (d == 10)
    at[:-1] = between & (d == 32) | feed
    at[1:] |= feed
    at[:-1] |= _PUNCT[d] & _letter_before(d)
    for w in whole:
        data = d.tobytes()
        k = data.find(w)
        while k >= 0:
            at[k + 1 : k + len(w)] = False
            k = data.find(w, k + 1)
    at[s.text_at] = True
    at[n] = True
    starts = np.flatnonzero(at)
    return starts, np.searchsorted(starts, s.text_at)


def spread(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs values[at[w]:at[w + 1]] for w in which, one after the other."""
    lens = at[which + 1] - at[which]
    ends = np.cumsum(lens)
    out = np.arange(int(ends[-1]) if len(ends) else 0)
    out += np.repeat(at[which] - (ends - lens), lens)
    return values[out]


class UnitEncoder:
    """ids of texts by way of their distinct units. encode: a list of strings to a list of id lists; n_ids: one more than the greatest id.

    cut: may texts be cut, or are they units as they are.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], n_ids: int, whole: tuple[bytes, ...] = (), cut: bool = True):
        self.encode, self.n_ids, self.whole, self.cut = encode, n_ids, whole, cut
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)

    def _add(self, new: list[bytes]) -> None:
        found = self.encode([t.decode() for t in new])
        first, n = len(self.known), len(found)
        self.known.update(zip(new, range(first, first + n), strict=True))
        ends = self.at[first] + np.cumsum(np.fromiter(map(len, found), np.int64, n))
        while first + n >= len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.at[first] : ends[-1]] = np.fromiter(chain.from_iterable(found), np.uint32, ends[-1] - self.at[first])
        self.at[first + 1 : first + n + 1] = ends

    def units(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """The store's number of every unit, and each text's first unit (one more than texts)."""
        starts, text_unit = cuts(s, self.whole) if self.cut else (s.text_at, np.arange(s.n + 1))
        if len(starts) < 2:
            return np.empty(0, np.int64), text_unit
        if len(self.known) > MOST_HELD:
            self.clear()
        where, back = T.distinct_runs(s.data, starts[:-1], starts[1:])
        data = s.data.tobytes()
        runs = [data[a:b] for a, b in zip(starts[where].tolist(), starts[where + 1].tolist(), strict=True)]
        known = self.known
        if new := [r for r in dict.fromkeys(runs) if r not in known]:
            self._add(new)
        return np.fromiter(map(known.__getitem__, runs), np.int64, len(runs))[back], text_unit

    def encoded(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and where each text's begin (one more than texts)."""
        units, text_unit = self.units(s)
        ends = np.concatenate(([0], np.cumsum(self.at[units + 1] - self.at[units])))
        return spread(self.ids, self.at, units), ends[text_unit]

    def counts(self, s: T.Slice) -> np.ndarray:
        """Number of ids of each text."""
        units, text_unit = self.units(s)
        return np.diff(np.concatenate(([0], np.cumsum(self.at[units + 1] - self.at[units])))[text_unit])


_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


# Fixed value: the pattern that the cuts fit; byte-level tokenizers use it unless they name another.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def may_be_cut(spec: dict) -> bool:
    """Does a vocabulary file (as JSON) split texts by the pattern, byte by byte, without changing them before."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    free = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or [])
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    return bool(byte_level and plain and free and model.get("type", "BPE") == "BPE" and not spec.get("normalizer"))


def bpe_file(path: str) -> UnitEncoder:
    """By the tokenizers library, without special tokens added. Units of one word go straight to its model."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(path)
    n_ids = max(held.get_vocab(with_added_tokens=True).values(), default=0) + 1
    with open(path, encoding="utf-8") as f:
        cut = may_be_cut(json.load(f))
    if not cut:
        return UnitEncoder(lambda texts: [e.ids for e in held.encode_batch_fast(texts, add_special_tokens=False)], n_ids, cut=False)
    added = tuple(t.content for t in held.get_added_tokens_decoder().values())
    letters, model = _byte_letters(), held.model
    word = _WORD.fullmatch if not any(map(_WORD.fullmatch, added)) else lambda t: _WORD.fullmatch(t) and not any(a in t for a in added)

    def encode(texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if word(t):
                out[i] = [x.id for x in model.tokenize(t.encode().decode("latin-1").translate(letters))]
            else:
                rest.append(i)
        for i, e in zip(rest, held.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    return UnitEncoder(encode, n_ids, tuple(a.encode() for a in added))


def rank_file(path: str, pattern: str) -> UnitEncoder:
    """By tiktoken, from a file of ranks."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    held = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return UnitEncoder(lambda texts: [held.encode_ordinary(t) for t in texts], max(ranks.values()) + 1, cut=pattern == PATTERN)
