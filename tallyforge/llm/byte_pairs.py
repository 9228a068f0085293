"""Byte-level BPE over many short pieces at once, in numpy, with the tokenizer file's own merges.

A piece is a word with or without one space before it. Its code points fall into
letters, numbers, other signs and line feeds, and runs of one kind (the first with the
space) are merged for themselves: in each, the pair of lowest rank, leftmost first,
until no pair is left. Pieces that this does not surely cover are refused, and the
tokenizer takes them: apostrophes (contractions), other white space, code points whose
category is not the same in old and new Unicode, runs above 63 bytes.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_buffer

LETTER, NUMBER, SIGN, FEED, REFUSED = range(5)
#: Bits of a key that hold the place in a run; the rank is above.
PLACE = 6
LONGEST = (1 << PLACE) - 1
NONE = 1 << 24
#: Upper lengths of runs that are merged together.
LENGTHS = (4, 6, 8, 10, 12, 16, 24, LONGEST)


def _kinds() -> np.ndarray:
    """The kind of each code point of the basic plane; all others are refused."""
    old = unicodedata.ucd_3_2_0.category
    out = np.full(0x10001, REFUSED, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        k = unicodedata.category(c)
        if k == old(c) and not c.isspace() and k[0] not in "ZC":
            out[i] = {"L": LETTER, "N": NUMBER}.get(k[0], SIGN)
    out[ord("'")], out[ord("\n")] = REFUSED, FEED
    return out


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class BytePairs:
    """``path`` must be what :meth:`covers` accepts."""

    @staticmethod
    def covers(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = not any(spec.get(x) for x in ("normalizer", "post_processor", "truncation", "padding"))
        level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        merged = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        return bool(plain and level and merged and all(x in model["vocab"] for x in _byte_letters()) and max(model["vocab"].values()) < 65_535)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.kinds = _kinds()
        self.first = np.array([vocab[x] for x in _byte_letters()], np.int32)
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        ranks = {vocab[a] << 16 | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        keys = np.array(sorted(ranks), np.uint32)
        self.keys = np.append(keys, np.uint32(0xFFFFFFFF))
        self.ranks = np.array([*(ranks[x] for x in keys.tolist()), NONE], np.int32)
        pair = (self.first.astype(np.uint32)[:, None] << np.uint32(16)) | self.first.astype(np.uint32)[None, :]
        self.start = self._rank(pair.ravel())

    def _rank(self, pair: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, pair)
        return np.where(self.keys[at] == pair, self.ranks[at], np.int32(NONE))

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self._rank(left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32))

    def encode(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all pieces in a row, how many each has, and which pieces are refused (with none)."""
        sizes = pc.utf8_length(pieces).to_numpy().astype(np.int64)
        data, _ = text_buffer(pieces)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64), np.zeros(len(pieces), bool)
        ends = np.cumsum(sizes)
        heads = (ends - sizes)[sizes > 0]
        kind = self.kinds[np.minimum(points, 0x10000)]
        fresh = np.append(True, kind[1:] != kind[:-1])  # where a run starts
        fresh[heads] = True
        bad = kind == REFUSED
        bad[1:] |= (kind[1:] == FEED) & ~fresh[1:]  # a feed after a feed
        spaced = heads[points[heads] == 0x20]
        bad[spaced] = False
        after = spaced + 1
        single = ~np.isin(after, heads) & (after < len(points))
        bad[spaced[~single]] = True
        after = after[single]
        bad[after] |= kind[after] == FEED
        fresh[after] = False
        wide = (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000) + 1
        reach = np.concatenate([[0], np.cumsum(wide)])  # bytes before each code point
        runs = np.flatnonzero(fresh)
        starts = reach[runs]
        lengths = np.diff(np.append(starts, reach[-1]))
        bad[runs[lengths > LONGEST]] = True
        refused = np.zeros(len(pieces), bool)
        refused[np.searchsorted(ends, np.flatnonzero(bad), side="right")] = True
        well = ~refused[np.searchsorted(ends, runs, side="right")]
        symbols, alive = self._merge(data, starts[well], lengths[well])
        before = np.concatenate([[0], np.cumsum(alive)])[reach[np.concatenate([[0], ends])]]
        return symbols[alive], np.diff(before), refused

    def _merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each byte, and whether it stands (in the runs given, at its first byte)."""
        end = len(data)  # stands for no neighbour
        symbol = np.append(self.first[data], np.int32(0xFFFF))
        right, left = np.arange(1, end + 2, dtype=np.int32), np.arange(-1, end, dtype=np.int32)
        right[starts + lengths - 1], left[starts] = end, end
        rank = np.append(self.start[data[:-1].astype(np.int64) << 8 | data[1:]], np.int32(NONE))
        edge = np.zeros(end + 1, np.int32)
        edge[starts] += 1  # no two runs share a start or an end
        edge[starts + lengths] -= 1
        alive = np.cumsum(edge)[:-1] > 0
        at_least = 1  # runs of one byte are done
        for at_most in LENGTHS:
            own = (lengths > at_least) & (lengths <= at_most)
            at_least = at_most
            start, last = starts[own].astype(np.int32), (lengths[own] - 1).astype(np.int32)
            place = np.arange(at_most - 1, dtype=np.int32)[:, None]
            inside = place < last
            key = np.where(inside, rank[np.where(inside, start + place, 0)], np.int32(NONE)) << PLACE | place
            while key.shape[1]:
                best = key.min(axis=0)
                go = best < NONE << PLACE
                if not go.all():
                    key, start, best = key[:, go], start[go], best[go]
                column = np.arange(len(start))
                here = start + (best & LONGEST)
                new = self.made[best >> PLACE]
                gone = right[here]
                beyond, back = right[gone], left[here]
                symbol[here], alive[gone], right[here], left[beyond] = new, False, beyond, here
                place_gone = gone - start
                inner = np.flatnonzero(place_gone < len(key))
                key[place_gone[inner], inner] = NONE << PLACE
                key[here - start, column] = self._pair_rank(new, symbol[beyond]) << PLACE | (here - start)
                inner = np.flatnonzero(back != end)
                back = back[inner]
                key[back - start[inner], inner] = self._pair_rank(symbol[back], new[inner]) << PLACE | (back - start[inner])
        return symbol[:-1], alive
