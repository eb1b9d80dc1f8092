"""N-gram Jaccard join with multiple-global-order prefix filters.

A document's tokens are its distinct word shingles (64-bit hashes; two documents link when the Jaccard similarity of
their sets reaches ``threshold`` percent).  Equal sets are one set from the start.  The texts are read three times,
whatever their size.

1. *Digests.*  Every set gets a 128-bit digest.  Tokens that many sets of one slice of text have are noted; the
   ``FREQUENT`` most frequent ones, a table of fixed size, are broadcast.
2. *Open sets.*  Under any one order of all tokens, two sets that link share a token among the first
   |x| - ceil(t |x|) + 1 of each (the prefix).  Half of the tokens, those with an even hash, are counted: tasks pack
   (token, set) postings into binary blocks by token range, and each range returns the postings of tokens that two sets
   or more have.  In an order that begins with counted tokens of one set alone, these fill the prefix of most sets,
   which then link with nothing; the other sets are open.  Frequent tokens take no part, so no token has more postings
   than a fixed part of all.
3. *Prefixes under several global orders.*  The texts of open sets are fetched, and all their tokens are counted in the
   same way among open sets.  In every order the tokens of one open set alone come first, unemitted; order 0 goes on
   by document frequency (passages that many documents share come last), order k by hash k.
4. *Groups of near copies* have long posting lists.  Instead of all pairs of a list, each list names its centre, the
   member with the least share of tokens of its own, and each set takes the best centre of its lists as its hub.
   Where the prefixes of a set and its hub also meet under all other orders, their tokens are compared: that links
   them, and it gives the set's common tokens with the hub as a bit map.
5. *The rest, exactly.*  Pairs in one list of order 0 but not yet in one component are candidates when what follows
   the list's token in either set allows the overlap (the first common token of a pair that links always does), and
   when their bit maps do.  For sets of one hub, common tokens inside the hub are the common bits; those outside are
   bounded by the sketch: tokens are hashed to ``SKETCH`` bits, and each bit that one set has alone is a token at
   least that the other lacks.  For other pairs a sketch of all shared tokens gives the bound.  The candidates'
   prefixes must meet under the other orders as well; only then do tokens move, and verification counts the common ones.

Defined cases: null or wordless texts have no tokens and link with nothing; a text of fewer words than a shingle is
one token, its whole sequence; very long texts are a slice of their own; ties in frequency go by hash; repeated ids:
each row is reported, with the least id of its component; null ids are reported with a null component unless linked; an
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranchery.llm.components import components
from tranchery.llm.shared import discard, in_batches, staged
from tranchery.llm.text import Words, mix, pieces_of, shingles

ORDERS = 3
#: Postings in one range of tokens, on average
BLOCK = 1_000_000
#: Frequent tokens that are broadcast, and the sets of a slice that must have a token for it to be noted
FREQUENT, NOTED = 100_000, 16
#: Digests of candidate sets that are broadcast; beyond that they are joined by a shuffle
FEW = 1_000_000
#: The document frequency that stands for that of a frequent token: behind all others
LAST = (1 << 32) - 1
#: Bits of a set's sketch (a multiple of 64)
SKETCH = 512
_SLICE = 2 << 20
_COLLIDES = "two different token sets have one 64-bit digest; another seed is needed"


def _sets(batch: pa.RecordBatch, words: int, seed: int):
    """(row bounds, tokens) of a batch's distinct shingles and the digests (two halves) of its rows' sets."""
    w = Words(batch.column("text"))
    row, token = shingles(w, words)
    bounds = np.searchsorted(row, np.arange(w.rows + 1))
    total = np.zeros((2, len(token) + 1), np.uint64)
    for half in range(2):
        np.cumsum(mix(token + np.uint64(2 * seed + 11 + half)), out=total[half, 1:])
    a, b = total[:, bounds[1:]] - total[:, bounds[:-1]]
    n = np.diff(bounds)
    return bounds, token, mix(a + n.astype(np.uint64)), mix(b ^ n.astype(np.uint64))


def _new(sid: np.ndarray, n: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows bring a set that is not empty and that this task has not seen; ``seen`` holds a task's sets only."""
    out = np.zeros(len(sid), bool)
    for r, s in enumerate(sid.tolist()):
        if s not in seen and n[r]:
            seen.add(s)
            out[r] = True
    return out


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, np.int64)


def _within(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of x is in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _dealt(part: np.ndarray, *columns: np.ndarray):
    """Parts that occur and, for each of them, the bytes of its share of the columns."""
    order = np.argsort(part, kind="stable")
    at = _edges(part[order])
    cut = [[x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] for x in (c[order] for c in columns)]
    return part[order][at[:-1]], *[pa.array(c, pa.binary()) for c in cut]


def digests(docs: DataFrame, words: int, doc_id: str, text: str, seed: int = 0) -> DataFrame:
    """(doc_id, n, sid, check, noted): the size and the 128-bit digest (two halves) of each document's token set.
    Where ``noted``, sid is a token instead, and n the number of sets of one slice that have it."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        seen: set[int] = set()
        for whole in batches:
            for batch in pieces_of(whole, "text", _SLICE):
                bounds, token, a, b = _sets(batch, words, seed)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.zeros(len(n), bool))], ["doc_id", "n", "sid", "check", "noted"])
                many = np.sort(token[np.repeat(_new(a, n, seen), n)])
                at = _edges(many)
                times = np.diff(at)
                often = np.flatnonzero(times >= NOTED)
                no_id = pa.nulls(len(often), batch.schema.field("doc_id").type)
                yield pa.RecordBatch.from_arrays([no_id, pa.array(times[often], pa.int64()), pa.array(many[at[:-1][often]].view(np.int64)), pa.array(np.zeros(len(often), np.int64)), pa.array(np.ones(len(often), bool))], ["doc_id", "n", "sid", "check", "noted"])

    return in_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, f"doc_id {kind}, n long, sid long, check long, noted boolean")


def frequent_tokens(noted: DataFrame) -> np.ndarray:
    """At most ``FREQUENT`` tokens, the most frequent of those noted, sorted."""
    top = noted.groupBy("sid").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sid").limit(FREQUENT)
    return np.sort(top.select("sid").toArrow().column("sid").to_numpy().view(np.uint64))


def shared_postings(docs: DataFrame, words: int, text: str, seed: int, frequent, blocks: int, half: bool) -> DataFrame:
    """Blocks dealt by set (``blocks`` parts): the sets (sids; counts: size and number of counted tokens of each), and
    the postings (sids, tokens, counts) of counted tokens that two sets or more have.  Counted are the tokens with an
    even hash (``half``) or all, but for the frequent ones; with all, the postings of these come as well, ``LAST``."""

    def set_part(sid):
        return (mix(sid) % np.uint64(blocks)).astype(np.int64)

    def pack(batches):
        seen: set[int] = set()
        names = ["part", "sids", "tokens", "counts"]
        for whole in batches:
            for batch in pieces_of(whole, "text", _SLICE):
                bounds, token, sid, _ = _sets(batch, words, seed)
                n = np.diff(bounds)
                new = _new(sid, n, seen)
                sent, often = np.repeat(new, n), np.zeros(len(token), bool)
                if half:
                    sent &= token & np.uint64(1) == 0
                often[sent] = _within(frequent.value, token[sent])
                sent &= ~often
                before = np.append(0, np.cumsum(sent))
                counts = np.stack([n, before[bounds[1:]] - before[bounds[:-1]]], 1).astype(np.uint32)[new]
                part, sids, counts = _dealt(set_part(sid[new]), sid[new], counts)
                yield pa.RecordBatch.from_arrays([pa.array(-1 - part), sids, pa.nulls(len(part), pa.binary()), counts], names)
                owner = np.repeat(sid, n)
                if not half:
                    part, *cut = _dealt(set_part(owner[often]), owner[often], token[often], np.full(int(often.sum()), LAST, np.uint32))
                    yield pa.RecordBatch.from_arrays([pa.array(-1 - part), *cut], names)
                owner, token = owner[sent], token[sent]
                part, sids, tokens = _dealt(((token >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), owner, token)
                yield pa.RecordBatch.from_arrays([pa.array(part), sids, tokens, pa.nulls(len(part), pa.binary())], names)

    def count(group: pa.Table) -> pa.Table:
        if group.column("part")[0].as_py() < 0:  # on its way to the set's part
            return group.set_column(0, "part", pa.array(-1 - group.column("part").to_numpy()))
        token, sid = _joined(group, "tokens"), _joined(group, "sids")
        order = np.argsort(token, kind="stable")
        token, sid = token[order], sid[order]
        alike = np.zeros(len(token), bool)  # has a neighbour with the same token
        alike[1:] = token[1:] == token[:-1]
        alike[:-1] |= alike[1:].copy()
        token, sid = token[alike], sid[alike]
        order = np.lexsort((sid, token))
        token, sid = token[order], sid[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])  # a set that several tasks packed counts once
        token, sid = token[new], sid[new]
        df = np.diff(_edges(token))
        df = np.repeat(df, df)
        many = df > 1
        token, sid, df = token[many], sid[many], df[many].astype(np.uint32)
        part, *cut = _dealt(set_part(sid), sid, token, df)
        return pa.table([pa.array(part), *cut], ["part", "sids", "tokens", "counts"])

    shape = "part long, sids binary, tokens binary, counts binary"
    return in_batches(docs.select(F.col(text).alias("text"))).mapInArrow(pack, shape).groupBy("part").applyInArrow(count, shape)


def _joined(t: pa.Table, column: str, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), kind)


def prefix_length(n, threshold: int):
    """|x| - ceil(t |x|) + 1, in integers."""
    return n - (n * threshold + 99) // 100 + 1


def _hash(k: int, token: np.ndarray) -> np.ndarray:
    return mix(token * np.uint64(2 * k + 1) + np.uint64(0xA5A5 + k))


def open_sets(postings: DataFrame, threshold: int) -> DataFrame:
    """(sid, n, own, tokens, counts): the sets whose counted tokens of their own do not fill the prefix, the number of
    these, and the other tokens at hand (sorted) with their document frequencies."""

    def gather(group: pa.Table) -> pa.Table:
        sets = group.filter(group.column("tokens").is_null())
        lists = group.filter(group.column("tokens").is_valid())
        every, first = np.unique(_joined(sets, "sids"), return_index=True)
        n, counted = _joined(sets, "counts", np.uint32).reshape(-1, 2)[first].astype(np.int64).T
        sid, token, df = _joined(lists, "sids"), _joined(lists, "tokens"), _joined(lists, "counts", np.uint32)
        order = np.lexsort((token, sid))
        sid, token, df = sid[order], token[order], df[order]
        a, b = np.searchsorted(sid, every), np.searchsorted(sid, every, "right")
        before = np.append(0, np.cumsum(df < LAST))
        own = counted - (before[b] - before[a])
        some = np.flatnonzero(own < prefix_length(n, threshold)).tolist()
        cut = lambda x: pa.array([x[a[i] : b[i]].tobytes() for i in some], pa.binary())
        return pa.table([pa.array(every[some].view(np.int64)), pa.array(n[some]), pa.array(own[some]), cut(token), cut(df)], ["sid", "n", "own", "tokens", "counts"])

    return postings.groupBy("part").applyInArrow(gather, "sid long, n long, own long, tokens binary, counts binary")


def texts_of(docs: DataFrame, words: int, text: str, seed: int, wanted: DataFrame) -> DataFrame:
    """(sid, text): a text of each wanted set."""
    spark = docs.sparkSession
    few = wanted.limit(FEW + 1).count() <= FEW
    ids = spark.sparkContext.broadcast(np.sort(wanted.select("sid").toArrow().column("sid").to_numpy()) if few else None)

    def run(batches):
        seen: set[int] = set()
        for whole in batches:
            for batch in pieces_of(whole, "text", _SLICE):
                bounds, _, sid, _ = _sets(batch, words, seed)
                new = _new(sid, np.diff(bounds), seen)
                if ids.value is not None:
                    new[new] = _within(ids.value, sid[new].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(sid[new].view(np.int64)), batch.column("text").filter(pa.array(new))], ["sid", "text"])

    return in_batches(docs.select(F.col(text).alias("text"))).mapInArrow(run, "sid long, text string").groupBy("sid").agg(F.first("text").alias("text"))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.append(0, np.cumsum([len(x) for x in arrays], dtype=np.int64)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def _sketch(token: np.ndarray) -> list[int]:
    bits = np.zeros(SKETCH, bool)
    bits[_hash(77, token) % np.uint64(SKETCH)] = True
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def prefixes(sets: DataFrame, threshold: int, orders: int) -> DataFrame:
    """(sid, n, own, tokens, head, heads, sketch): for each set the tokens it shares (sorted), those of its prefix in
    order 0 and in each other order, and the sketch of the tokens it shares."""

    def run(batches):
        for batch in batches:
            head, heads, sketch = [], [], []
            for n, own, t, c in zip(*(batch.column(x) for x in ("n", "own", "tokens", "counts")), strict=True):
                token, room = _u64(t.as_buffer()), prefix_length(n.as_py(), threshold) - own.as_py()
                head.append(token[np.lexsort((_hash(0, token), np.frombuffer(c.as_buffer(), np.uint32)))[:room]])
                heads += [token[np.argsort(_hash(k, token), kind="stable")[:room]] for k in range(1, orders)]
                sketch.append(_sketch(token))
            other = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * (orders - 1), pa.int32()), _lists(heads))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sid", "n", "own", "tokens")), _lists(head), other, pa.array(sketch, pa.list_(pa.int64()))], ["sid", "n", "own", "tokens", "head", "heads", "sketch"])

    return in_batches(sets).mapInArrow(run, "sid long, n long, own long, tokens binary, head array<bigint>, heads array<array<bigint>>, sketch array<bigint>")


def _u64(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def _sides(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    for v in ("x", "y"):
        pairs = pairs.join(sets.select(F.col("sid").alias(v), *[F.col(c).alias(f"{c}_{v}") for c in columns]), v)
    return pairs


def hubs(sets: DataFrame) -> DataFrame:
    """(x, y): each set and its hub, the best centre of its posting lists (least share of own tokens, then hash)."""
    rank = F.struct((F.col("own") / F.col("n")).alias("own"), F.xxhash64("sid").alias("h"), "sid")
    lists = sets.select("sid", rank.alias("r"), F.explode("head").alias("token"))
    # aggregates only: no list is ever gathered
    centres = lists.groupBy("token").agg(F.min("r").alias("r"), F.count("*").alias("members")).where("members > 1").select("token", "r")
    return lists.select("sid", "token").join(centres, "token").groupBy("sid").agg(F.min("r").alias("r")).select(F.col("sid").alias("x"), F.col("r.sid").alias("y"))


def meeting(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose prefixes share a token under every order but order 0."""
    met = F.zip_with("heads_x", "heads_y", F.arrays_overlap)
    return _sides(pairs, sets, ["heads"]).where(F.forall(met, lambda ok: ok)).select("x", "y")


def compared(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(x, y, linked, outside, bits, beyond): a set and its hub; the number and the sketch of the set's shared tokens
    outside the hub, and a bit map (64 per word) of the hub's tokens that the set has."""

    def run(batches):
        for batch in batches:
            out = []
            for x, y, na, nb, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n_x", "n_y", "tokens_x", "tokens_y")), strict=True):
                ta, tb = _u64(ta), _u64(tb)
                has = _within(ta, tb)
                both = int(has.sum())
                bits = np.packbits(np.append(has, np.zeros(-len(has) % 64, bool)), bitorder="little").view(np.int64)
                out.append((x, y, x != y and 100 * both >= threshold * (na + nb - both), len(ta) - both, bits.tolist(), _sketch(ta[~_within(tb, ta)])))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["x", "y", "linked", "outside", "bits", "beyond"])

    return in_batches(_sides(pairs, sets, ["n", "tokens"])).mapInArrow(run, "x long, y long, linked boolean, outside long, bits array<bigint>, beyond array<bigint>")


def candidates_left(sets: DataFrame, labels: DataFrame, by_hub: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(x, y): the pairs of different components in one posting list whose remainders, bit maps and sketches allow a
    link; and the staged lists they are made of."""
    known = sets.select("sid", "n", "own", "head", "sketch", (F.octet_length("tokens") / 8).cast("long").alias("shared"))
    known = known.join(labels.select(F.col("v").alias("sid"), "c"), "sid", "left").join(by_hub.select(F.col("x").alias("sid"), F.col("y").alias("hub"), "outside", "bits", "beyond"), "sid", "left")
    # of a pair without a common hub the whole sketches are needed, of one with a hub those beyond it
    lists = known.select("sid", "n", "own", F.coalesce("c", "sid").alias("c"), "hub", "shared", "sketch", "outside", "bits", "beyond", F.posexplode("head").alias("place", "token"))
    lists = lists.withColumn("rest", F.col("n") - F.col("own") - F.col("place")).drop("own", "place")
    # lists of one component have nothing left
    mixed = lists.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("token")
    left = staged(lists.join(mixed, "token"), "lists-left")
    # each pair of a list is tested on whole columns, cheapest test first
    a, b = left.alias("a"), left.alias("b")
    total = F.col("a.n") + F.col("b.n")
    fits = lambda both: 100 * both >= threshold * (total - both)
    inside = F.aggregate(F.zip_with("a.bits", "b.bits", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    ok = (F.col("a.token") == F.col("b.token")) & (F.col("a.c") != F.col("b.c")) & (F.col("a.sid") < F.col("b.sid"))
    ok &= fits(F.least("a.rest", "b.rest"))

    def common(size, sketch):
        """No more than this many of ``size`` sketched tokens are common."""
        alone = lambda v, w: sum(F.bit_count(F.col(f"{v}.{sketch}")[i].bitwiseAND(F.bitwise_not(F.col(f"{w}.{sketch}")[i]))) for i in range(SKETCH // 64))
        return F.least(F.col(f"a.{size}") - alone("a", "b"), F.col(f"b.{size}") - alone("b", "a"))

    ok &= F.when(F.col("a.hub") == F.col("b.hub"), fits(inside + common("outside", "beyond"))).otherwise(fits(common("shared", "sketch")))
    return a.join(b, ok).select(F.col("a.sid").alias("x"), F.col("b.sid").alias("y")).distinct(), left


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs that reach the threshold."""

    def run(batches):
        for batch in batches:
            keep = [100 * (both := int(_within(_u64(ta), _u64(tb)).sum())) >= threshold * (na + nb - both) for na, nb, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("n_x", "n_y", "tokens_x", "tokens_y")), strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return in_batches(_sides(pairs, sets, ["n", "tokens"])).mapInArrow(run, "x long, y long")


def classes(docs: DataFrame, words: int = 5, threshold: int = 80, orders: int = ORDERS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row: the size of its set, the least id it can reach by links,
    and the number of verified links its set has (copies and links implied by a component are not counted)."""
    spark = docs.sparkSession
    for seed in range(8):
        rows = staged(digests(docs, words, doc_id, text, seed), "sets")
        own = rows.where("not noted").select("doc_id", "n", "sid", "check")
        per_set = own.where("n > 0").groupBy("sid").agg(F.min("check").alias("lo"), F.max("check").alias("hi"), F.max("n").alias("n"), F.min("doc_id").alias("least"))
        per_set = staged(per_set, "distinct-sets")
        if not per_set.where("lo != hi").limit(1).count():
            break
        discard(rows, per_set)
    else:
        raise RuntimeError(_COLLIDES)
    total = per_set.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = spark.sparkContext.broadcast(frequent_tokens(rows.where("noted")))
    first = staged(shared_postings(docs, words, text, seed, frequent, -(-total // (2 * BLOCK)) or 1, True), "postings")
    open_ = staged(open_sets(first, threshold), "open-sets")
    discard(first)
    texts = staged(texts_of(docs, words, text, seed, open_), "open-texts")
    total = open_.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    second = staged(shared_postings(texts, words, "text", seed, frequent, -(-2 * total // BLOCK) or 1, False), "open-postings")
    # staged in between: two Python steps in one stage take two workers a task, and each keeps its memory
    tokens = staged(open_sets(second, threshold), "open-tokens")
    discard(open_, texts, second)
    sets = staged(prefixes(tokens, threshold, orders), "prefixes")
    discard(tokens)
    by_hub = staged(compared(meeting(hubs(sets), sets), sets, threshold), "hubs")
    links = by_hub.where("linked").select("x", "y")
    labels = components(links)
    pairs, lists = candidates_left(sets, labels, by_hub, threshold)
    more = staged(verified(meeting(pairs, sets), sets, threshold), "other-links")
    every = links.unionByName(more)
    if more.limit(1).count():
        discard(labels)
        labels = components(every)
    number = every.select(F.explode(F.array("x", "y")).alias("sid")).groupBy("sid").agg(F.count("*").alias("n_links"))
    linked = labels.select(F.col("v").alias("sid"), "c").join(per_set.select("sid", "least"), "sid")
    linked = linked.join(linked.groupBy("c").agg(F.min("least").alias("component_id")), "c").join(number, "sid").select("sid", "component_id", "n_links")
    final = staged(per_set.join(linked, "sid", "left").select("sid", F.coalesce("component_id", "least").alias("component_id"), "n_links"), "classes")
    discard(sets, by_hub, labels, lists, more, per_set)
    out = own.join(final, (own["sid"] == final["sid"]) & (own["n"] > 0), "left")
    return out.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component: that of the least id, nulls last, ties by the text's hash; of rows with equal ids and
    texts any one.  Rows are told apart by a key of their own, so repeated and null ids are no exception.  Each row
    without words is a component."""
    row = "_kept_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = classes(rows, doc_id=row, text=text, **options).select(F.col(row).alias("r"), F.col("component_id").alias("c"))
    ids = rows.select(F.col(row).alias("own"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"))
    best = found.join(ids, found["r"] == ids["own"]).groupBy("c").agg(F.min(F.struct(F.col("id").isNull(), "id", "h", "r")).alias("m"))
    first = best.select(F.col("m.r").alias("r"))
    return rows.join(first, rows[row] == first["r"], "left_semi").drop(row)
