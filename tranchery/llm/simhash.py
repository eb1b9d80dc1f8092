"""SimHash near-duplicate classes: fingerprints of word shingles, linked through BK-trees.

Fingerprints: a text's words (ASCII lower case) give shingles of three, repeats included; a bit of the fingerprint is
set where over half of the shingles' XXH64 values have it.  A text of fewer words is one shingle, one without words has
fingerprint zero.

Links: two fingerprints of at most ``radius`` differing bits agree in one of radius + 1 bands of bits, so the distinct
fingerprints are cut into shards by (band, value), each of which holds all partners its members have in that band.  A
BK-tree is built per shard in Spark tasks (a shard of more than ``part`` fingerprints gets several trees), the trees of
about ``nodes`` fingerprints at a time are broadcast, and the members of their shards follow only edges within the
radius.  The work grows with the fingerprints and what is near them, not with all pairs; a dense shard costs no pairs
either, as a tree knows classes of nodes that met a near ancestor on their way down, and a task reports each class of
a batch once.

Defined cases: null and empty texts and texts without words have fingerprint zero and link like any other; repeated
rows and repeated ids each get a row; a null id gets a row and never becomes a component's id (a component of null ids
only has a null one); texts are read whole, in slices of shingles; an empty table gives an empty table.  Only the id
and the text are read, so further columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranchery.llm.components import components
from tranchery.llm.shared import discard, fresh_path, in_batches, joined_by_weight, staged
from tranchery.llm.text import Words, pieces_of

SHINGLE = 3
SEED = 42
RADIUS = 3
#: fingerprints of one tree, and of the trees that are broadcast together (about 30 bytes each)
PART = 1 << 12
NODES = 1 << 20

_CHUNK = 1 << 16


def shingle_hashes(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, XXH64) of every shingle, in order; a row of fewer words gives its whole sequence."""
    length = words.end - words.start
    first = np.cumsum(length + 1) - (length + 1)
    clean = np.full(int(length.sum()) + len(length), 0x20, np.uint8)  # all words, one space after each
    inside = np.arange(int(length.sum())) + np.repeat(words.start - (np.cumsum(length) - length), length)
    clean[np.arange(len(inside)) + np.repeat(np.arange(len(length)), length)] = words.data[inside]
    begin = np.cumsum(words.counts) - words.counts
    shingles = np.where(words.counts >= n, words.counts - n + 1, (words.counts > 0).astype(words.counts.dtype))
    row = np.repeat(np.arange(words.rows), shingles)
    a = np.repeat(begin, shingles) + np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    b = np.minimum(a + n, (begin + words.counts)[row]) - 1
    data, digest = clean.tobytes(), xxhash.xxh64_intdigest
    found = (digest(data[i:j], SEED) for i, j in zip(first[a].tolist(), (first[b] + length[b]).tolist(), strict=True))
    return row, np.fromiter(found, np.uint64, len(row))


def majority(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Per row the bits that over half of its hashes have; zero for a row without hashes."""
    counts = np.zeros((rows, 64), np.int64)
    for i in range(0, len(row), _CHUNK):
        part = row[i : i + _CHUNK]
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        bits = np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[part[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    total = np.bincount(row, minlength=rows)
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of every row, as a long."""

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole, "text", 1 << 19):
                words = Words(batch.column("text"))
                fp = majority(*shingle_hashes(words, n), words.rows) if words.rows else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return in_batches(given).mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, fp long")


def _classes(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least vertex that each of 0 .. n-1 reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


class Forest:
    """BK-trees over fingerprints: a node's children are keyed by their Hamming distance to it, one per distance.

    ``key`` is 128 * parent + distance, ascending, so that the children at some distances are one slice; the roots of
    a block of trees lie before all its other nodes.  ``cls`` is a node of the same tree that links lead to.
    """

    def __init__(self, fp, key, cls, shard, root):
        self.fp, self.key, self.cls, self.shard, self.root = fp, key, cls, shard, root

    @classmethod
    def build(cls, fp: np.ndarray, tree: np.ndarray, shard: np.ndarray, radius: int) -> Forest:
        """All trees at once, level by level; rows ascend by tree and are inserted in their order: the first that comes
        to a place becomes its node, later ones go on below it."""
        first = np.flatnonzero(np.diff(tree, prepend=tree[:1] - 1))
        node, keys = [first], [np.full(len(first), -1, np.int64)]
        rest = np.delete(np.arange(len(fp)), first)
        place = np.searchsorted(first, rest, "right") - 1  # the node each one has come to
        item, links = first, []
        while len(rest):
            away = np.bitwise_count(fp[rest] ^ fp[item[place]]).astype(np.int64)
            near = away <= radius
            links.append(np.stack([rest[near], item[place[near]]]))
            want = place * 128 + away
            order = np.argsort(want, kind="stable")
            rest, want = rest[order], want[order]
            new = np.diff(want, prepend=-1) != 0
            node.append(rest[new])
            keys.append(want[new])
            place = (len(item) + np.cumsum(new) - 1)[~new]
            item, rest = np.concatenate([item, rest[new]]), rest[~new]
        node = np.concatenate(node)
        a, b = np.concatenate(links, axis=1) if links else (np.zeros(0, np.int64),) * 2
        at = np.empty(len(fp), np.int64)
        at[node] = np.arange(len(node))
        return cls(fp[node], np.concatenate(keys), _classes(len(node), at[a], at[b]), shard[first], np.arange(len(first)))

    @classmethod
    def joined(cls, parts: list[Forest]) -> Forest:
        at = np.cumsum([0] + [len(p.fp) for p in parts])
        shard = np.concatenate([p.shard for p in parts])
        order = np.argsort(shard, kind="stable")
        moved = lambda name: np.concatenate([getattr(p, name) + k for p, k in zip(parts, at, strict=False)])
        key = np.concatenate([p.key + 128 * k for p, k in zip(parts, at, strict=False)])
        return cls(np.concatenate([p.fp for p in parts]), key, moved("cls"), shard[order], moved("root")[order])

    def near(self, fp: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(probe, node) of all nodes within the radius in the trees of the probes' shards."""
        probe, root = _slices(np.arange(len(fp)), np.searchsorted(self.shard, shard), np.searchsorted(self.shard, shard, "right"))
        node, found = self.root[root], []
        while len(probe):
            away = np.bitwise_count(fp[probe] ^ self.fp[node]).astype(np.int64)
            hit = away <= radius
            found.append(np.stack([probe[hit], node[hit]]))
            low = np.searchsorted(self.key, node * 128 + np.maximum(away - radius, 0))
            high = np.searchsorted(self.key, node * 128 + away + radius, "right")
            probe, node = _slices(probe, low, high)
        return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64),) * 2

    def links(self, fp: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of fingerprints that join all that is linked to the probes: each to its class in the tree that holds
        it, and these classes to those of the other nodes found."""
        probe, node = self.near(fp, shard, radius)
        found, own = self.fp[self.cls[node]], fp.copy()
        itself = self.fp[node] == fp[probe]
        own[probe[itself]] = found[itself]
        x, y = np.concatenate([fp, own[probe]]), np.concatenate([own, found])
        pairs = np.unique(np.stack([x, y])[:, x != y], axis=1)
        ends, at = np.unique(pairs, return_inverse=True)
        least = ends[_classes(len(ends), *at.reshape(pairs.shape))]
        return ends[ends != least], least[ends != least]


def _slices(owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = high - low
    out = np.repeat(owner, count)
    return out, np.arange(len(out)) + np.repeat(low - (np.cumsum(count) - count), count)


def _bands(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of radius + 1 bands, all 64 bits together; bands of over 16 bits use 16 of them, so
    that shards can be counted on the driver."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, min(b - a, 16)) for a, b in zip(edges, edges[1:], strict=False)]


def _sharded(fps: DataFrame, radius: int, part: int, nodes: int) -> tuple[DataFrame, int]:
    """(shard, fp, tree, block, low, high): the fingerprints of every shard with at least two, the block of trees that
    each one is a node of, and the blocks that hold trees of its shard.  Staged in the order of shards, so a block reads
    its files only.  The driver sees the sizes of (radius + 1) * 65,536 shards at most."""
    shards = F.array(*[F.shiftrightunsigned("fp", a).bitwiseAND((1 << w) - 1) + F.lit(i << 16) for i, (a, w) in enumerate(_bands(radius))])
    rows = fps.select("fp", F.explode(shards).alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").toPandas().sort_values("shard")
    if not len(sizes):
        return None, 0
    sizes["trees"] = -(-sizes["n"] // part)
    sizes["at"] = sizes["n"].cumsum() - sizes["n"]
    plan = fps.sparkSession.createDataFrame(sizes[["shard", "n", "trees", "at"]].astype("int64"))
    tree = F.pmod(F.xxhash64("fp"), "trees")
    block = lambda x: F.floor((F.col("at") + x) / nodes).cast("int")
    placed = rows.join(F.broadcast(plan), "shard").select("shard", "fp", tree.alias("tree"), block(tree * part).alias("block"), block(F.lit(0)).alias("low"), block((F.col("trees") - 1) * part).alias("high"))
    last = int(((sizes["at"] + (sizes["trees"] - 1) * part) // nodes).max())
    return staged(placed.repartitionByRange("shard", "fp").sortWithinPartitions("shard", "fp"), "shards"), last + 1


def _forest(rows: DataFrame, radius: int) -> Forest:
    """The trees of one block: built where the shuffle brings each tree, at most about NODES nodes in all."""

    def run(batches):
        have = [b for b in batches if b.num_rows]
        if have:
            t = pa.Table.from_batches(have)
            shard, tree, fp = (t.column(c).to_numpy() for c in ("shard", "tree", "fp"))
            change = (np.diff(shard, prepend=-1) != 0) | (np.diff(tree, prepend=-1) != 0)
            f = Forest.build(fp.view(np.uint64), np.cumsum(change), shard, radius)
            values = [f.fp, f.key, f.cls, f.shard, f.root]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], _ARRAYS)

    built = rows.repartition("shard", "tree").sortWithinPartitions("shard", "tree", "fp").mapInArrow(run, ", ".join(f"{c} binary" for c in _ARRAYS))
    kinds = [np.uint64, *[np.int64] * 4]
    return Forest.joined([Forest(*[np.frombuffer(r[c], k) for c, k in zip(_ARRAYS, kinds, strict=True)]) for r in built.collect()])


_ARRAYS = ["fp", "key", "cls", "shard", "root"]


def _probed(rows: DataFrame, forest, radius: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            fp, shard = batch.column("fp").to_numpy().view(np.uint64), batch.column("shard").to_numpy()
            x, y = forest.value.links(fp, shard, radius)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["x", "y"])

    return rows.select("fp", "shard").mapInArrow(run, "x long, y long")


def near_links(fps: DataFrame, radius: int = RADIUS, part: int = PART, nodes: int = NODES) -> DataFrame | None:
    """(x, y), staged: links between distinct fingerprints ``fp`` that join exactly those of at most ``radius``
    differing bits, through others where need be; None where no two share a band."""
    spark = fps.sparkSession
    rows, blocks = _sharded(fps, radius, part, nodes)
    if not blocks:
        return None
    path = fresh_path(spark, "fingerprint-links")
    for b in range(blocks):
        forest = spark.sparkContext.broadcast(_forest(rows.where(F.col("block") == b), radius))
        _probed(rows.where((F.col("low") <= b) & (F.col("high") >= b)), forest, radius).write.parquet(f"{path}/block={b}")
        forest.destroy()
    discard(rows)
    out = spark.read.schema("x long, y long").parquet(*[f"{path}/block={b}" for b in range(blocks)])
    out.staged_path = path
    return out


def classes(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text", part: int = PART, nodes: int = NODES) -> DataFrame:
    """Per row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the least id whose
    fingerprint links to its own, directly or through others."""
    marked = staged(fingerprints(docs, doc_id, text), "fingerprints")
    fps = staged(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    links = near_links(fps.select("fp"), radius, part, nodes)
    if links is None:
        known = fps.select("fp", "n", F.col("least").alias("component_id"))
    else:
        labels = components(links)
        discard(links)
        linked = staged(fps.join(labels.withColumnRenamed("v", "fp"), "fp", "left"), "labelled")
        discard(labels)
        whole = linked.where("c is not null").groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("w"))
        known = joined_by_weight(linked.where("c is not null").select("fp", "n", "c"), whole, "c", "w").select("fp", "n", "component_id")
        known = known.union(linked.where("c is null").select("fp", "n", "least"))
    out = joined_by_weight(marked, known, "fp", "n")
    return out.select(F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
