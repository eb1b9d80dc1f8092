"""Subword lattices of many short strings at once, by numpy.

A vocabulary gives each piece a log probability.  Strings ("units") are handled together: all pieces at all positions
are looked up by rolling hashes, longer ones only where a piece begins like that, and the forward recursion in log
space runs over positions for all units at once.  A character without a piece is spelled by byte pieces.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa

from tranchery.llm.text import mix

MARK = 0x2581
#: units over this length are worked on one by one
LONG = 64
#: characters whose lattices are built at once, so that they stay in a core's cache
_BLOCK = 1 << 15
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        row = np.full(size + 1, base, np.uint64)
        row[0] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 20, 1 << max(n, 1).bit_length()))


@lru_cache(maxsize=1)
def _of_code() -> np.ndarray:
    """A number for each character, which its places in texts are hashed by."""
    return mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x51ED27))


def rolling(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which any slice's hash follows."""
    total, power, of_code = np.zeros(len(codes) + 1, np.uint64), powers(len(codes))[0], _of_code()
    for a in range(0, len(codes), _BLOCK):
        b = min(a + _BLOCK, len(codes))
        np.cumsum(of_code[codes[a:b]] * power[a:b], out=total[a + 1 : b + 1])
        total[a + 1 : b + 1] += total[a]
    return total


def slices(total: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """Hashes of the slices of that size at the given starts."""
    return mix((total[start + size] - total[start]) * powers(len(total))[1][start] + np.asarray(size, np.uint64))


def utf8_width(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))


class Vocabulary:
    """Pieces, ids and log probabilities of a SentencePiece model.

    A unigram model's scores are log probabilities and are taken as they are.  A BPE model's scores are merge ranks
    (0, -1, -2, ...): they are read as Zipf's law, p(piece) proportional to 1 / (rank + 1); byte pieces rank last.
    Both are normalised over all pieces that text can use.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        self.byte_ids = np.full(256, -1, np.int32)
        pieces, piece_ids, scores = [], [], []
        for i in ids:
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces.append(sp.id_to_piece(i))
                piece_ids.append(i)
                scores.append(sp.get_score(i))
        scores = np.array(scores)
        if np.all(scores == np.round(scores)) and len(scores) > 1:
            rank = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
            weight = -np.log(rank + 1.0)
            low = -np.log(len(scores) + 1.0)
        else:
            weight, low = scores, scores.min() - 1
        n_bytes = int((self.byte_ids >= 0).sum())
        total = np.log(np.exp(weight).sum() + n_bytes * np.exp(low))
        #: by index of a piece; the last entry (index -1) stands for no piece
        self.logp = np.append(weight - total, -np.inf)
        self.byte_logp = low - total
        self.pieces = pieces
        self.ids = np.append(np.array(piece_ids, np.int32), -1)
        self.text_of = dict(zip(piece_ids, pieces, strict=True))
        raw = [sp.id_to_piece(i).encode() for i in ids]
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                raw[i] = bytes([b])
        #: by id: its bytes, and its characters
        self.id_bytes = pa.array(raw, pa.large_binary())
        self.id_chars = np.array([len(sp.id_to_piece(i)) for i in ids], np.int32)
        self.longest = max(map(len, pieces))
        # marks only at the start of pieces: a mark after another character is a sure boundary
        self.mark_cuts = all("▁" not in p.lstrip("▁") for p in pieces)
        joined = {c for p in pieces if len(p) > 1 for c in p}
        self.joined = np.zeros(0x110000, bool)
        self.joined[[ord(c) for c in joined]] = True
        #: by character: the piece that it is (-1: none), and whether a longer one begins with it
        self.one, self.begins = np.full(0x110000, -1, np.int32), np.zeros(0x110000, bool)
        for i, p in enumerate(pieces):
            if len(p) == 1:
                self.one[ord(p)] = i
            else:
                self.begins[ord(p[0])] = True
        #: by the low bits of a hash: 1 where a piece has it, 2 where the beginning of a longer piece has it
        self.filter = np.zeros(1 << 20, np.uint8)
        known, index = [np.full(1, np.iinfo(np.uint64).max)], [np.full(1, -1, np.int32)]
        for size in range(1, self.longest + 1):
            at = [k for k, p in enumerate(pieces) if len(p) == size]
            if at:
                total = rolling(np.frombuffer("".join(pieces[k] for k in at).encode("utf-32-le"), np.uint32))
                first = np.arange(len(at)) * size
                for part in range(1, size):
                    self.filter[self._low(slices(total, first, part))] |= 2
                known.append(slices(total, first, size))
                index.append(np.array(at, np.int32))
                self.filter[self._low(known[-1])] |= 1
        known = np.concatenate(known)
        order = np.argsort(known, kind="stable")
        #: the hashes of all pieces in order, the pieces, and the first hash of each value of the high bits
        self.known, self.index = known[order], np.concatenate(index)[order]
        self.bucket = np.searchsorted(self.known, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << 20) - 1)).astype(np.int64)

    def lookup(self, total: np.ndarray, size: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The starts at which a piece of that size stands, the indexes of these pieces, and the starts at which a
        longer one may stand."""
        h = slices(total, start, size)
        flag = self.filter[self._low(h)]
        maybe = np.flatnonzero(flag & 1)
        h = h[maybe]
        place = self.bucket[(h >> np.uint64(48)).astype(np.int64)]
        less = np.flatnonzero(self.known[place] < h)
        while len(less):
            place[less] += 1
            less = less[self.known[place[less]] < h[less]]
        piece = self.index[place]
        hit = np.flatnonzero((self.known[place] == h) & (piece >= 0))
        return start[maybe[hit]], piece[hit], start[flag > 1]


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


class Lattice:
    """The lattices of the units ``codes[start:start+size]``: pieces at every position and forward log sums.

    A unit has one node more than characters, ``node[u]`` is its first.  The arcs that end at node x are those from
    ``first[x]`` to ``first[x+1]``, short ones first: ``length``, ``piece`` (-1: a character spelled by bytes) and
    ``weight``, its log probability.  ``forward[x]`` is the log sum over all segmentations of the unit up to there.
    """

    def __init__(self, vocab: Vocabulary, codes: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.vocab, self.codes, self.start, self.size = vocab, codes, start, size
        self.node = start + np.arange(len(start))
        total = rolling(codes)
        #: units between which blocks end
        self.cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(codes), _BLOCK)), len(start))).tolist()
        parts = [self._part(total, a, b) for a, b in pairwise(self.cuts)]
        self.count, self.length, self.piece, self.weight, self.forward = map(np.concatenate, zip(*parts, strict=True))
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        for u in np.flatnonzero(size > LONG).tolist():
            self._alone(u)

    def _part(self, total: np.ndarray, a: int, b: int) -> tuple[np.ndarray, ...]:
        """Arcs per node, lengths, pieces and weights of the arcs and forward sums of the units ``a`` to ``b``; the
        sums of long units are left out."""
        vocab, size, low = self.vocab, self.size[a:b], int(self.start[a])
        unit = np.repeat(np.arange(b - a), size)
        n = len(unit)
        codes = self.codes[low : low + n]
        before = np.arange(n) + unit  # node before each character
        # characters from each place to the end of its unit: longer pieces need not be looked up
        room = (self.start[a:b] + size - low)[unit] - np.arange(n)
        one = vocab.one[codes]
        spelled, weight = np.flatnonzero(one < 0), vocab.logp[one]
        weight[spelled] = utf8_width(codes[spelled]) * vocab.byte_logp
        places, pieces, weights = [np.arange(n)], [one], [weight]
        place, k = np.flatnonzero(vocab.begins[codes]), 1
        while len(place):
            k += 1
            where, piece, place = vocab.lookup(total, k, place[room[place] >= k] + low)
            place -= low
            places.append(where - low)
            pieces.append(piece)
            weights.append(vocab.logp[piece])
        ends, nodes = [before[where] + k for k, where in enumerate(places, 1)], n + b - a
        end = np.concatenate(ends)
        order = np.argsort(end.astype(np.uint16 if nodes <= 1 << 16 else np.int64), kind="stable")
        count = np.bincount(end, minlength=nodes)
        length, piece, weight = np.repeat(np.arange(1, len(ends) + 1, dtype=np.int32), [len(e) for e in ends]), np.concatenate(pieces), np.concatenate(weights)
        if size.max(initial=0) > LONG:
            short = [(size <= LONG)[unit[where]] for where in places]
            places, ends, weights = ([v[s] for v, s in zip(x, short, strict=True)] for x in (places, ends, weights))
        inside = np.arange(n) - (self.start[a:b] - low)[unit]
        forward = self._forward(nodes, ends, weights, [(inside[where] + k).astype(np.uint8) for k, where in enumerate(places, 1)])
        return count, length[order], piece[order], weight[order], forward

    @staticmethod
    def _forward(nodes: int, ends: list, weights: list, places: list) -> np.ndarray:
        """The recursion for all units of at most ``LONG`` characters, given the arcs of each length: by the place in
        the unit they end at, then length."""
        forward = np.zeros(nodes)
        number = np.stack([np.bincount(place, minlength=LONG + 1) for place in places], 1)
        order = np.argsort(np.concatenate(places), kind="stable")
        end, weight = np.concatenate(ends)[order], np.concatenate(weights)[order]
        a = 0
        for row in number[: int(np.max(np.flatnonzero(number.any(1)), initial=-1)) + 1].tolist():
            for k, m in enumerate(row):
                if m:
                    e = end[a : a + m]
                    to = forward[e - k - 1] + weight[a : a + m]
                    forward[e] = to if k == 0 else np.logaddexp(forward[e], to)
                    a += m
        return forward

    def _alone(self, unit: int) -> None:
        """The same recursion for one long unit, in time linear in its length."""
        at, n = int(self.node[unit]), int(self.size[unit])
        first = self.first[at : at + n + 2]
        length, weight = self.length[first[0] : first[-1]].tolist(), self.weight[first[0] : first[-1]].tolist()
        first = (first - first[0]).tolist()
        alpha = [0.0]
        for j in range(1, n + 1):
            every = [alpha[j - length[i]] + weight[i] for i in range(first[j], first[j + 1])]
            top = max(every)
            alpha.append(top + math.log(sum(math.exp(x - top) for x in every)) if len(every) > 1 else top)
        self.forward[at : at + n + 1] = alpha

    def totals(self) -> np.ndarray:
        return self.forward[self.node + self.size]

    def shares_below(self) -> np.ndarray:
        """For each arc the share of all segmentations up to its end whose last arc is a shorter one; -1 for the
        shortest."""
        out = np.empty(len(self.length), np.float32)
        bounds = [*self.node[self.cuts[:-1]].tolist(), len(self.count)]
        for a, b in pairwise(bounds):
            out[self.first[a] : self.first[b]] = self._shares_below(a, b)
        return out

    def _shares_below(self, a: int, b: int) -> np.ndarray:
        """The same for the arcs that end at the nodes ``a`` to ``b``."""
        count, first = self.count[a:b], self.first[a : b + 1] - self.first[a]
        every, end = slice(int(self.first[a]), int(self.first[b])), np.repeat(np.arange(a, b), count)
        out = np.exp(self.forward[end - self.length[every]] + self.weight[every] - self.forward[end]).astype(np.float32)
        some, step = np.flatnonzero(count > 1), 1
        while len(some):
            at = first[some] + step
            out[at] += out[at - 1]
            step += 1
            some = some[count[some] > step]
        some = np.flatnonzero(count)
        out /= np.repeat(np.maximum(out[first[some + 1] - 1], np.float32(1e-30)), count[some])
        out[1:] = out[:-1].copy()
        out[first[some]] = -1
        return out

    def arc_probabilities(self, node: int) -> tuple[list[int], list[float]]:
        """The lengths of the arcs that end at a node and their probabilities."""
        length, weight, forward = self.length.item, self.weight.item, self.forward.item
        some, end = range(self.first.item(node), self.first.item(node + 1)), forward(node)
        lengths = [length(i) for i in some]
        return lengths, [math.exp(forward(node - k) + weight(i) - end) for i, k in zip(some, lengths, strict=True)]


def log_marginals(vocab: Vocabulary, units: list[str], longest: int = 64) -> np.ndarray:
    """Natural log of the total probability of all segmentations of each unit."""
    out = np.zeros(len(units))
    short = [i for i, u in enumerate(units) if 0 < len(u) <= longest]
    for a in range(0, len(short), 20_000):
        some = short[a : a + 20_000]
        codes = np.frombuffer("".join(units[i] for i in some).encode("utf-32-le"), np.uint32)
        size = np.array([len(units[i]) for i in some])
        out[some] = Lattice(vocab, codes, np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size).totals()
    for i, u in enumerate(units):
        if len(u) > longest:
            out[i] = _one(vocab, u)
    return out


def _one(vocab: Vocabulary, unit: str) -> float:
    """The same recursion for one long unit, in time linear in its length."""
    codes = np.frombuffer(unit.encode("utf-32-le"), np.uint32)
    total, n = rolling(codes), len(codes)
    pid = np.full((vocab.longest + 1, n), -1, np.int32)
    for k in range(1, min(vocab.longest, n) + 1):
        where, piece, _ = vocab.lookup(total, k, np.arange(n - k + 1))
        pid[k, where] = piece
    alpha = np.full(n + 1, -np.inf)
    alpha[0] = 0
    width = len(unit[0].encode())
    for j in range(1, n + 1):
        width = len(chr(codes[j - 1]).encode())
        best = [alpha[j - 1] + (vocab.logp[pid[1][j - 1]] if pid[1][j - 1] >= 0 else width * vocab.byte_logp)]
        best += [alpha[j - k] + vocab.logp[p] for k in range(2, min(j, vocab.longest) + 1) if (p := pid[k][j - k]) >= 0]
        top = max(best)
        alpha[j] = top + np.log(np.exp(np.array(best) - top).sum())
    return float(alpha[n])
