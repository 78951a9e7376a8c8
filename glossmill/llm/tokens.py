"""Byte-level BPE ids of whole texts, vectorised over batches of documents.

The pre-tokens of a batch are found with array arithmetic over code points, hashed, and looked up in
a cache of encoded pre-tokens; only those not seen before are encoded.  Texts with a code point
whose class isn't the same in every Unicode version, or that spell out a special token, go to the
tokenizer itself.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

_SPACE = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_LETTER, _NUMBER, _OTHER, _WHITE, _EDGE, _UNSURE = 0, 1, 2, 3, 4, 5
_TABLE = 0x30000
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 18


@lru_cache(1)
def _classes() -> np.ndarray:
    def of(c: int) -> int:
        now, old = unicodedata.category(chr(c)), unicodedata.ucd_3_2_0.category(chr(c))
        if old == "Cn" or 0x1C <= c <= 0x1F or 0xD800 <= c <= 0xDFFF or (now[0] != old[0]):
            return _UNSURE
        if c in _SPACE:
            return _WHITE
        return {"L": _LETTER, "N": _NUMBER, "Z": _UNSURE}.get(now[0], _OTHER)

    t = np.fromiter((of(c) for c in range(_TABLE)), np.uint8, _TABLE)
    return t


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + n)] = b
            n += 1
    return out


class Encoder:
    """ids of texts under a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, slots: int = 1 << 21, most: int = 1_500_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        special = self.special = {x["content"] for x in said.get("added_tokens", [])}
        stand = _byte_of_char()
        ranks = {bytes(stand[c] for c in k): v for k, v in said["model"]["vocab"].items() if k not in special}
        self.one = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.mask, self.most = np.uint64(slots - 1), most
        self.power = self.inverse = np.zeros(0, np.uint64)
        self._reset()

    def _reset(self) -> None:
        self.key, self.at = np.zeros(int(self.mask) + 1, np.uint64), np.full(int(self.mask) + 1, -1, np.int32)
        self.off, self.len, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)
        self.n = self.filled = 0

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            inv = np.uint64(pow(int(_MULT), -1, 1 << 64))
            size = max(n, _CHUNK + 8)
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _MULT)], dtype=np.uint64)
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inv)], dtype=np.uint64)

    def _add(self, ids: list[list[int]]) -> np.ndarray:
        lens = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.int32, int(lens.sum()))
        while self.n + len(ids) > len(self.off):
            self.off, self.len = np.r_[self.off, self.off], np.r_[self.len, self.len]
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.r_[self.pool, self.pool]
        new = np.arange(self.n, self.n + len(ids), dtype=np.int32)
        self.off[new] = self.filled + np.cumsum(lens) - lens
        self.len[new] = lens
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.n += len(ids)
        self.filled += len(flat)
        return new

    def _starts(self, cp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """True where a pre-token begins; lo and hi are the bounds of the texts that aren't empty."""
        cls = _classes()[cp]
        before, after = np.empty_like(cls), np.empty_like(cls)
        before[1:], after[:-1] = cls[:-1], cls[1:]
        before[lo], after[hi - 1] = _EDGE, _EDGE
        white = cls == _WHITE
        free = np.ones(len(cp), bool)
        free[1:] = cp[:-1] != 32
        start = np.where(white, (before != _WHITE) | (after < _WHITE), np.where(before == _WHITE, free, cls != before))
        quotes = np.flatnonzero((cp == 39) & start)
        if len(quotes):
            end = hi[np.searchsorted(lo, quotes, "right") - 1]
            one = np.where(quotes + 1 < end, cp[np.minimum(quotes + 1, len(cp) - 1)], 0)
            two = np.where(quotes + 2 < end, cp[np.minimum(quotes + 2, len(cp) - 1)], 0)
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for which, width in ((single, 2), (double, 3)):
                q, e = quotes[which], end[which]
                start[q + 1] = False
                if width == 3:
                    start[q + 2] = False
                q = q[q + width < e]
                start[q + width] = True
        return start

    def _chunk(self, text: str, cp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each pre-token of the texts cp[lo:hi], one after the other, and how many each text has."""
        if self.n > self.most:
            self._reset()
        full = hi > lo
        if not full.any():
            return np.zeros(0, np.int32), np.zeros(len(lo), np.int64)
        begin = np.flatnonzero(self._starts(cp, lo[full], hi[full]))
        end = np.r_[begin[1:], len(cp)]
        self._powers(len(cp) + 1)
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * self.power[: len(cp)], out=total[1:])
        h = (total[end] - total[begin]) * self.inverse[begin]
        h = (h ^ (h >> np.uint64(29))) * _MIX + (end - begin).astype(np.uint64)
        h ^= h >> np.uint64(32)
        slot = (h & self.mask).astype(np.int64)
        entry = np.where(self.key[slot] == h, self.at[slot], -1)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            keys, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            p = miss[first]
            one = self.one
            new = self._add([one(text[a:b].encode()) for a, b in zip(begin[p].tolist(), end[p].tolist(), strict=True)])
            entry[miss] = new[back]
            slots = (keys & self.mask).astype(np.int64)
            self.key[slots] = keys
            self.at[slots] = new
        cuts = np.searchsorted(begin, np.r_[lo, len(cp)])
        return entry, np.diff(cuts)

    def encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of each); ``last`` is put after every text.

        The texts must lie one after the other in raw, without gaps.
        """
        from .common import runs

        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for i, j in runs(starts, ends, _CHUNK):
            part = raw[starts[i] : ends[j - 1]]
            text = part.tobytes().decode("utf-8", "replace")
            cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            heads = np.zeros(len(part) + 1, np.int64)
            np.cumsum((part & 0xC0) != 0x80, out=heads[1:])
            lo, hi = heads[starts[i:j] - starts[i]], heads[ends[i:j] - starts[i]]
            low = np.minimum(cp, _TABLE - 1)
            odd = (_classes()[low] == _UNSURE) | (cp >= _TABLE)
            for x in self.special:  # a text that spells an added token out
                k = text.find(x)
                while k >= 0:
                    odd[k] = True
                    k = text.find(x, k + 1)
            if odd.any():
                sums = np.r_[0, np.cumsum(odd)]
                strange = (sums[hi] - sums[lo]) > 0
                for k in range(j - i):
                    if strange[k]:
                        x = self.whole.encode(text[lo[k] : hi[k]], add_special_tokens=False).ids
                        a = np.array(x + ([] if last is None else [last]), np.int32)
                        ids.append(a)
                        counts.append(np.array([len(a)]))
                    else:
                        self._plain(text[lo[k] : hi[k]], cp[lo[k] : hi[k]], np.array([0]), np.array([hi[k] - lo[k]]), last, ids, counts)
            else:
                self._plain(text, cp, lo, hi, last, ids, counts)
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))

    def _plain(self, text, cp, lo, hi, last, ids, counts) -> None:
        if len(lo) == 1 and len(cp) > 2 * _CHUNK:  # a very long text: cut before single spaces, where a pre-token begins anyhow
            cls = _classes()[cp]
            cut = np.flatnonzero((cp[1:-1] == 32) & (cls[:-2] != _WHITE) & (cls[2:] != _WHITE)) + 1
            edges, at = [0], 0
            while len(cp) - at > _CHUNK and (k := int(np.searchsorted(cut, at + _CHUNK))) < len(cut):
                at = int(cut[k])
                edges.append(at)
            edges.append(len(cp))
            total = 0
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                entry, _ = self._chunk(text[a:b], cp[a:b], np.array([0]), np.array([b - a]))
                ids.append(self._flat(entry))
                total += len(ids[-1])
            if last is not None:
                ids.append(np.array([last], np.int32))
                total += 1
            counts.append(np.array([total]))
            return
        entry, words = self._chunk(text, cp, lo, hi)
        stop = np.cumsum(words)
        if last is not None:
            mark = self._add([[last]])[0]
            entry = np.insert(entry, stop, mark)
            words = words + 1
            stop = np.cumsum(words)
        sums = np.r_[0, np.cumsum(self.len[entry])]
        ids.append(self._flat(entry))
        counts.append(sums[stop] - sums[stop - words])

    def _flat(self, entry: np.ndarray) -> np.ndarray:
        lens = self.len[entry]
        before = np.cumsum(lens) - lens
        return self.pool[np.repeat(self.off[entry] - before, lens) + np.arange(int(lens.sum()))]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
