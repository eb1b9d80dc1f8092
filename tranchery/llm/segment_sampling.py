"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement.

The text, with a mark in front and marks for spaces, is a lattice of pieces.  It falls apart into units at places that
no piece can cross (before a mark that follows another character, and around characters that occur in no longer
piece), however long they are.  The probability of a segmentation is its share of the lattice's total.

Perturbed A* search: a region is a set of segmentations (units before unit i fixed, some segmentations of unit i
excluded, the rest free) with its exact log mass, and its priority is the maximum of the Gumbel-perturbed log
probabilities in it, a Gumbel variate at that mass, truncated at the maximum of the region it came from.  The best
region is popped, its best segmentation sampled and emitted, and what is left of it split into one region per unit
behind the branch.  k pops give the k segmentations of largest perturbed log probability: distinct samples without
replacement.  The largest priority that is left is the threshold kappa, and a segmentation of log probability phi has
the inclusion score 1 - exp(-exp(phi - kappa)).  All variates are hashes of (seed, row key, sample, unit, step), so a
row gives the same samples whatever the partitioning.

Decoding joins pieces and bytes and takes the marks back: ``decode`` of any sample is the text itself (a text that
itself contains the mark character U+2581 decodes with spaces there, as SentencePiece does).  Each sample is decoded;
``round_trip`` says whether that gives the text again (null for a null text).

Defined cases: a null or empty text has one segmentation, the empty one; a text with fewer than k segmentations
emits all it has, with inclusion score 1; what is left of a region below ``_LEAST_MASS`` of its mass, where doubles
hold rounding only, counts as empty; ties go by unit; very long texts are a slice of their own; rows with equal keys and texts get equal samples; other columns pass unread.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranchery.llm.lattice import MARK, Lattice, Vocabulary, rolling, slices, utf8_width, vocabulary
from tranchery.llm.shared import in_batches
from tranchery.llm.text import mix, pieces_of

_LEAST_MASS = 1e-12
#: units sampled at once, so that what is drawn for them stays in a core's cache
_BLOCK = 1 << 15


_STEP, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def uniforms(key: np.ndarray, tag: int) -> np.ndarray:
    """Uniforms in (0, 1), hashes of (key, tag)."""
    h = mix(key + np.uint64(tag * _STEP & _ALL))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def uniform(key: int, tag: int) -> float:
    """The same for one key."""
    x = (key + tag * _STEP) & _ALL
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _ALL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _ALL
    x ^= x >> 31
    return ((x >> 11) + 0.5) * 2.0**-53


def _tag(which: int, purpose: int, step: int = 0) -> int:
    """A number for each use of a variate: sample, purpose (0 free, 1 branch, 2 rest, 3 rest of a branch, 4 root), step."""
    use = which * 5 + purpose
    return (use << 8) + step + 1 if step < 255 else (use << 40) + (1 << 39) + step


def truncated_gumbel(u, mass, top):
    """A Gumbel variate at ``mass`` given that it is at most ``top``."""
    with np.errstate(divide="ignore", over="ignore"):
        return mass - np.log(np.exp(mass - top) - np.log(u))


def truncated_gumbel_one(u: float, mass: float, top: float) -> float:
    """The same for one region."""
    return mass - math.log(math.exp(min(mass - top, 700.0)) - math.log(u))


def cut_units(vocab: Vocabulary, codes: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Starts of the units of texts that begin at ``text_start``."""
    start = np.zeros(len(codes), bool)
    start[text_start] = True
    mark = codes == MARK
    if vocab.mark_cuts:
        start[1:] |= mark[1:] & ~mark[:-1]
    alone = ~vocab.joined[codes]
    start |= alone
    start[1:] |= alone[:-1]
    return np.flatnonzero(start)


class Sampler:
    """The lattices of a chunk of texts and their sampled segmentations.

    A segmentation is a row of symbols: the id of a piece, or ``~c`` for a character ``c`` that is spelled by bytes."""

    def __init__(self, vocab: Vocabulary, texts: list[str], keys: np.ndarray):
        self.vocab, self.keys = vocab, keys
        marked = ["▁" + t.replace(" ", "▁") for t in texts]
        #: what samples are decoded to; a mark in the text itself is decoded as a space
        self.raw, self.has_mark = [t.encode() for t in marked], ["▁" in t for t in texts]
        self.codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in marked])
        self.text_start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.at = cut_units(vocab, self.codes, self.text_start)
        self.size = np.diff(np.append(self.at, len(self.codes)))
        h = slices(rolling(self.codes), self.at, self.size)
        #: the units, equal ones together, and numbers of the distinct units in that order and by unit
        self.by_kind = np.argsort(h, kind="stable")
        h = h[self.by_kind]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        self.kinds, self.kind, first = np.cumsum(new) - 1, np.empty(len(h), np.int64), self.by_kind[new]
        self.kind[self.by_kind] = self.kinds
        # distinct units, one after the other
        length = self.size[first]
        begin = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        codes = self.codes[np.repeat(self.at[first] - begin, length) + np.arange(int(length.sum()))]
        x = self.lattice = Lattice(vocab, codes, begin, length)
        self.below = x.shares_below()
        self.total = x.totals()
        #: the longest arc that ends at each node; -1: a unit's first
        self.last = x.first[1:] - 1
        self.last[x.node] = -1
        #: the symbol of each arc
        self.symbol = vocab.ids[x.piece]
        spelled = np.flatnonzero(x.piece < 0)
        if len(spelled):
            # the shortest arc of a node is its character; a unit has a node more than characters
            shortest = x.first[np.arange(len(codes)) + np.repeat(np.arange(len(first)), length) + 1]
            self.symbol[spelled] = ~codes[np.searchsorted(shortest, spelled)].astype(np.int32)
        self.unit_first = np.searchsorted(self.at, self.text_start)
        self.unit_after = np.append(self.unit_first[1:], len(self.at))
        self.text_of = np.repeat(np.arange(len(texts)), self.unit_after - self.unit_first)
        unit_in_text = np.arange(len(self.at)) - self.unit_first[self.text_of]
        self.unit_key = mix(keys[self.text_of] + mix(unit_in_text.astype(np.uint64) + np.uint64(1)))
        self.key_by_kind = self.unit_key[self.by_kind]

    def sample(self, which: int, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Free samples of the units that are ``drawn``: symbols, one unit after the other, and for every unit their
        number and log probability.  Equal units are drawn together, so that their lattices stay in a core's cache."""
        x, below, after, steps = self.lattice, self.below, self.last, []
        number, logp = np.zeros(len(self.at), np.int32), np.zeros(len(self.at))
        for a in range(0, len(self.at), _BLOCK):
            some = np.flatnonzero(drawn[self.by_kind[a : a + _BLOCK]]) + a
            kind, unit, key, step = self.kinds[some], self.by_kind[some], self.key_by_kind[some], 0
            node, lp = x.node[kind] + x.size[kind], -self.total[kind]
            arc = after[node]
            while len(unit):
                u = uniforms(key, _tag(which, 0, step)).astype(np.float32)
                shorter = np.flatnonzero(below[arc] >= u)
                while len(shorter):
                    arc[shorter] -= 1
                    shorter = shorter[below[arc[shorter]] >= u[shorter]]
                steps.append((step, unit, self.symbol[arc]))
                node = node - x.length[arc]
                lp = lp + x.weight[arc]
                arc, step = after[node], step + 1
                done = arc < 0
                more, done = np.flatnonzero(~done), np.flatnonzero(done)
                number[unit[done]], logp[unit[done]] = step, lp[done]
                unit, key, node, arc, lp = unit[more], key[more], node[more], arc[more], lp[more]
        ends = np.cumsum(number, dtype=np.int32 if len(self.codes) < 1 << 31 else np.int64)
        out = np.empty(int(ends[-1]), np.int32)
        for step, unit, symbol in steps:
            out[ends[unit] - (step + 1)] = symbol
        return out, number, logp

    def ends_of(self, symbols: np.ndarray) -> list[int]:
        """The places where the pieces of one unit end, last first, with 0 behind them."""
        return [*accumulate(1 if i < 0 else self.vocab.id_chars.item(i) for i in symbols.tolist())][::-1] + [0]

    def sample_other(self, which: int, unit: int, excluded: list[tuple[list[int], float]]) -> tuple[np.ndarray, float]:
        """One segmentation of a unit that is not among the excluded (ends, log probability): exact, by walking back
        with each step's probability less that of the excluded segmentations which agree so far."""
        x, kind = self.lattice, int(self.kind[unit])
        end, symbols, logp, agree = int(x.size[kind]), [], 0.0, list(excluded)
        step, key, first = 0, int(self.unit_key[unit]), int(x.node[kind])
        while end:
            lengths, row = x.arc_probabilities(first + end)
            p = list(row)
            by_length: dict[int, list] = {}
            # those that agree so far have taken as many steps
            for m, lp in agree:
                by_length.setdefault(end - m[step + 1], []).append((m, lp))
            for k, ones in by_length.items():
                i = lengths.index(k)
                p[i] = max(p[i] - sum(math.exp(lp - logp) for _, lp in ones), 0.0)
            sums = list(accumulate(p))
            i = min(bisect_right(sums, uniform(key, _tag(which, 1, step)) * sums[-1]), len(p) - 1)
            symbols.append(self.symbol.item(x.first.item(first + end) + i))
            k = lengths[i]
            logp += math.log(max(row[i], 1e-300))
            agree = by_length.get(k, [])
            end -= k
            step += 1
        return np.array(symbols[::-1], np.int32), logp

    def top_k(self, k: int):
        """For each text a list of (symbols, log probability, perturbed value, log probabilities and numbers of symbols
        by unit), best first, and kappa."""
        n = len(self.text_start)
        every = np.arange(len(self.at))
        leaves: list[list] = [[] for _ in range(n)]
        queues: list[list] = [[] for _ in range(n)]  # (priority, leaf, unit, excluded; None: the leaf's own)
        root = -np.log(-np.log(uniforms(self.keys, _tag(0, 4))))
        branch = [(float(root[d]), None, int(self.unit_first[d]), []) for d in range(n)]
        kappa = np.full(n, -np.inf)
        for which in range(k):
            open_ = [d for d in range(n) if branch[d] is not None]
            if not open_:
                break
            # only the units behind a branch are drawn anew
            from_unit = np.array([len(every) if b is None else b[2] + (b[1] is not None) for b in branch])
            drawn = every >= from_unit[self.text_of] if which else np.ones(len(every), bool)
            who = np.flatnonzero(drawn)
            out, number, logp = self.sample(which, drawn)
            before = np.concatenate([[0], np.cumsum(number)])
            begin, after = before[self.unit_first].tolist(), before[self.unit_after].tolist()
            symbols = [out[a:b] for a, b in zip(begin, after, strict=True)]
            for d in open_:
                _, leaf, unit, excluded = branch[d]
                if leaf is not None:
                    a = self.unit_first[d]
                    old, _, _, old_logp, old_number = leaves[d][leaf]
                    other, logp[unit] = self.sample_other(which, unit, excluded)
                    logp[a:unit], number[a:unit], number[unit] = old_logp[: unit - a], old_number[: unit - a], len(other)
                    symbols[d] = np.concatenate([old[: int(number[a:unit].sum())], other, symbols[d]])
            # masses of what is left of each popped region, unit by unit
            before = np.cumsum(logp) - logp
            before -= before[self.unit_first[self.text_of]]
            lp = np.minimum(logp[who], 0.0)
            with np.errstate(divide="ignore"):
                rest = np.where(lp > -_LEAST_MASS, -np.inf, before[who] + np.log(-np.expm1(lp)))
            top = np.array([b[0] if b is not None else 0.0 for b in branch])[self.text_of[who]]
            draw = np.full(len(every), -np.inf)
            draw[who] = truncated_gumbel(uniforms(self.unit_key[who], _tag(which, 2)), rest, top)
            for d in open_:
                g, leaf, unit, excluded = branch[d]
                a, b = self.unit_first[d], self.unit_after[d]
                leaves[d].append((symbols[d], float(logp[a:b].sum()), g, logp[a:b], number[a:b]))
                mine, me = queues[d], len(leaves[d]) - 1
                if excluded:
                    out = [*excluded, self._drawn(leaves[d][me], unit - a)]
                    left = 1.0 - sum(math.exp(lp) for _, lp in out)
                    if left > _LEAST_MASS:
                        u = uniform(int(self.unit_key[unit]), _tag(which, 3))
                        mine.append((truncated_gumbel_one(u, float(before[unit]) + math.log(left), g), me, int(unit), out))
                    first = unit + 1
                else:
                    first = unit
                some = draw[first:b]
                need = k - which
                pick = np.argpartition(-some, need - 1)[:need] if len(some) > need else np.arange(len(some))
                for i in pick.tolist():
                    if np.isfinite(some[i]):
                        t = int(first + i)
                        mine.append((float(some[i]), me, t, None))
                mine.sort(key=lambda r: -r[0])
                del mine[need:]
                kappa[d] = mine[0][0] if mine else -np.inf
                branch[d] = mine.pop(0) if mine and which + 1 < k else None
                if branch[d] is not None and branch[d][3] is None:
                    # looked up for the few regions that are sampled again
                    g, me, t, _ = branch[d]
                    branch[d] = g, me, t, [self._drawn(leaves[d][me], t - a)]
        return leaves, kappa

    def _drawn(self, leaf: tuple, i: int) -> tuple[list[int], float]:
        """The segmentation of unit ``i`` of a sampled text: (ends, log probability)."""
        symbols, _, _, logp, number = leaf
        a = int(number[:i].sum())
        return self.ends_of(symbols[a : a + int(number[i])]), float(logp[i])

    def ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of symbols, and where those of each symbol begin (one more than symbols)."""
        times = np.ones(len(symbols), np.int64)
        spelled = np.flatnonzero(symbols < 0)
        if not len(spelled):
            return symbols, np.arange(len(symbols) + 1)
        chars = (~symbols[spelled]).astype(np.uint32)
        width = utf8_width(chars)
        times[spelled] = width
        begin = np.concatenate([[0], np.cumsum(times)])
        at = begin[spelled]
        out = np.repeat(symbols, times)
        raw = np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8)
        first = np.cumsum(width) - width
        for i in range(4):
            on = width > i
            out[at[on] + i] = self.vocab.byte_ids[raw[first[on] + i]]
        return out, begin

    def samples(self, k: int):
        """(text, sample number, token ids, log probability, perturbed value, inclusion score) of each sample."""
        return (x[:6] for x in self.decoded(k))

    def decoded(self, k: int):
        """The same with whether the sample decodes to its text."""
        leaves, kappa = self.top_k(k)
        for s in range(k):
            some = [d for d in range(len(leaves)) if len(leaves[d]) > s]
            if not some:
                break
            parts = [leaves[d][s][0] for d in some]
            out, begin = self.ids(np.concatenate(parts))
            ends = begin[np.cumsum([len(x) for x in parts])].tolist()
            back, token_byte = decode_bytes(self.vocab, out)
            last_byte = token_byte[ends].tolist()
            for d, first, end, a, b in zip(some, [0, *ends], ends, [0, *last_byte], last_byte, strict=False):
                _, phi, g, *_ = leaves[d][s]
                q = -math.expm1(-math.exp(min(phi - kappa[d], 700.0))) if np.isfinite(kappa[d]) else 1.0
                yield d, s + 1, out[first:end], phi, g, q, back[a:b] == self.raw[d] and not self.has_mark[d]


def decode_bytes(vocab: Vocabulary, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of token ids, marks still in them, and where each id's bytes begin (one more than ids)."""
    _, at, raw = vocab.id_bytes.take(pa.array(ids)).buffers()
    return raw.to_pybytes(), np.frombuffer(at, np.int64, len(ids) + 1)


def decode(vocab: Vocabulary, ids) -> str:
    """The text of token ids: pieces and bytes joined, marks as spaces, without the one in front."""
    byte_of = {int(i): b for b, i in enumerate(vocab.byte_ids) if i >= 0}
    raw = b"".join(bytes([byte_of[int(i)]]) if int(i) in byte_of else vocab.text_of[int(i)].encode() for i in ids)
    return raw.decode().replace("▁", " ")[1:]


def row_keys(keys: list, seed: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{x}".encode(), digest_size=8).digest(), "little") for x in keys], np.uint64)


def sample_segmentations(docs: DataFrame, model_file: str, k: int = 4, seed: int = 0, doc_id: str = "doc_id", text: str = "text", ids: bool = True, chunk: int = 1 << 18) -> DataFrame:
    """One row per document and sample: id, sample (1 is the largest perturbed value), n_pieces, log_prob, perturbed,
    inclusion, round_trip (the sample decodes to the text), and the token ids (``ids``), or their SHA-256 as little-endian 32-bit integers (``ids_sha256``).  Texts
    are worked on in slices of about ``chunk`` bytes, which bounds memory (a longer text is a slice of its own)."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    kinds = {"sample": pa.int32(), "n_pieces": pa.int64(), "log_prob": pa.float64(), "perturbed": pa.float64(), "inclusion": pa.float64(), "round_trip": pa.bool_()}

    def run(batches):
        vocab = vocabulary(model_file)
        for whole in batches:
            for batch in pieces_of(whole, "text", chunk):
                keys = batch.column("doc_id").to_pylist()
                given = batch.column("text").to_pylist()
                texts = [t or "" for t in given]
                full = [i for i, t in enumerate(texts) if t]
                rows: dict[str, list] = {c: [] for c in ("row", *kinds, "out")}

                def add(i, s, seq, phi, g, q, same, rows=rows):
                    rows["row"].append(i)
                    for c, v in zip(kinds, (s, len(seq), phi, g, q, same), strict=True):
                        rows[c].append(v)
                    rows["out"].append(seq if ids else hashlib.sha256(seq.astype("<i4").tobytes()).hexdigest())

                if full:
                    seeds = row_keys([keys[i] for i in full], seed)
                    for d, s, seq, phi, g, q, same in Sampler(vocab, [texts[i] for i in full], seeds).decoded(k):
                        add(full[d], s, seq, phi, g, q, same)
                for i, t in enumerate(texts):
                    if not t:
                        add(i, 1, np.zeros(0, np.int32), 0.0, 0.0, 1.0, None if given[i] is None else True)
                take = pa.array(rows["row"], pa.int64())
                if ids:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows["out"]])]).astype(np.int32)
                    last = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows["out"]]).astype(np.int32)))
                else:
                    last = pa.array(rows["out"], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), *(pa.array(rows[c], t) for c, t in kinds.items()), last], ["doc_id", *kinds, "out"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    done = in_batches(given).mapInArrow(run, f"doc_id {id_type}, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, round_trip boolean, out {'array<int>' if ids else 'string'}")
    return done.withColumnsRenamed({"doc_id": doc_id, "out": "ids" if ids else "ids_sha256"})
