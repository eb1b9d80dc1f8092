"""Merkle manifests of a dataset as append logs in postorder, with proofs read from the logs by address.

Rows become leaves.  A tree has the leaves of one group in order; every FANOUT neighbours of a level, the last run being
shorter, become one node of the next, until one is left.  The groups' roots are the leaves of one more tree.

Logs: a builder takes an aligned run of FANOUT**HEIGHT leaves, a whole subtree, and appends each node when its last leaf
has come, so its log is the subtree in postorder.  The place of node i of level h follows from the subtree sizes alone:
with e the last leaf under it, h + e + e // FANOUT + e // FANOUT**2 + ... (``place``).  The builders' roots are leaves of
the next layer of builders, and so on; a row of a layer's table is one builder's log, packed.

Proofs go from the top layer down: a builder's leaf has as its path the siblings in its own log, read at their places,
and then the path of the builder's root in the layer above.  Nothing but a log of FANOUT**HEIGHT leaves is ever in one
task at a time; leaves are numbered by a range sort and sums over its partitions, so a group of any size is spread.

Defined cases: null fields are "-"; the null group is the first tree; null ids come first in their tree; rows of equal id
are ordered by their leaves, and equal rows give as many equal leaves; texts are read whole; an empty table has no
rows, and its manifest no root.  Only the five fields are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tranchery.llm.shared import discard, in_batches, staged

FANOUT = 8
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def place(level, last, fanout: int = FANOUT):
    """Position in postorder, from 0, of the node of ``level`` whose last leaf is number ``last`` (arrays too)."""
    at, left = level + last, last // fanout
    while np.any(left):
        at, left = at + left, left // fanout
    return at


def last_leaf(level: int, index, leaves: int, fanout: int = FANOUT):
    return np.minimum((np.asarray(index) + 1) * fanout**level, leaves) - 1


def _height(leaves: int, fanout: int) -> int:
    h = 0
    while leaves > 1:
        leaves, h = -(-leaves // fanout), h + 1
    return h


class Builder:
    """The log of one aligned subtree: digests in the order of completion."""

    def __init__(self, height: int, fanout: int):
        self.height, self.fanout, self.open, self.log = height, fanout, [[] for _ in range(height + 1)], []

    def add(self, digest_: str) -> None:
        level = 0
        while True:
            self.log.append(digest_)
            self.open[level].append(digest_)
            if level == self.height or len(self.open[level]) < self.fanout:
                return
            digest_, level = self._closed(level), level + 1

    def _closed(self, level: int) -> str:
        run, self.open[level] = self.open[level], []
        return digest(*run)

    def end(self) -> list[str]:
        """Closes the runs that are short, up to the root."""
        for level in range(self.height):
            if self.open[level]:
                run = self._closed(level)
                self.log.append(run)
                self.open[level + 1].append(run)
                # a run of the next level that is full now closes in turn, as the next pass does in any case
        return self.log


def numbered(leaves: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``leaves`` with ``pos``, the place in the tree by ``order``, and ``leaves``, the tree's size; staged once sorted."""
    by = [tree, *order]
    placed = staged(leaves.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    starts = placed.groupBy(tree, part.alias("part")).agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    of_tree = Window.partitionBy(tree)
    before = F.coalesce(F.sum("n").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(F.col(tree).alias("_tree"), "part", "first", before.alias("before"), F.sum("n").over(of_tree).alias("leaves"))
    met = placed.join(starts, F.col(tree).eqNullSafe(F.col("_tree")) & (part == F.col("part")))
    out = met.select(*leaves.columns, (F.col("before") + F.col("_at") - F.col("first")).alias("pos"), "leaves")
    out.staged_path = placed.staged_path
    return out


_LOG = "tree string, block long, leaves long, ids array<long>, log array<string>, tampered array<string>"


def build(leaves: DataFrame, name: str, fanout: int = FANOUT, height: int = HEIGHT) -> list[DataFrame]:
    """The layers of logs, lowest first, each staged (_LOG): ``leaves`` is the size of the tree in the layer's leaves,
    ``ids`` and ``tampered`` go with the leaves.

    Given: tree (string), pos, leaves, id, leaf and tampered (a leaf or null), as ``numbered`` leaves them."""
    size, layers = fanout**height, []

    def run(batches):
        open_ = None
        for batch in batches:
            tree, block, total, ids, leaf_, tampered = (batch.column(c).to_pylist() for c in ("tree", "block", "leaves", "id", "leaf", "tampered"))
            for i in range(batch.num_rows):
                if open_ is None or open_[:2] != (tree[i], block[i]):
                    if open_ is not None:
                        yield _logged(open_)
                    whole = height if total[i] > size else _height(total[i], fanout)
                    open_ = (tree[i], block[i], total[i], Builder(whole, fanout), [], [])
                open_[3].add(leaf_[i])
                open_[4].append(ids[i])
                open_[5].append(tampered[i])
        if open_ is not None:
            yield _logged(open_)

    while True:
        rows = leaves.withColumn("block", F.expr(f"pos div {size}")).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        layer = staged(in_batches(rows.select("tree", "block", "leaves", "id", "leaf", "tampered")).mapInArrow(run, _LOG), f"{name}-{len(layers)}")
        layers.append(layer)
        above = layer.where(F.col("leaves") > size)
        if not above.limit(1).count():
            return layers
        none = F.lit(None)
        leaves = above.select("tree", F.col("block").alias("pos"), F.expr(f"(leaves + {size - 1}) div {size}").alias("leaves"), none.cast("long").alias("id"), F.element_at("log", -1).alias("leaf"), none.cast("string").alias("tampered"))


def _logged(done: tuple) -> pa.RecordBatch:
    tree, block, total, builder, ids, tampered = done
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
    values = [tree, block, total, ids, builder.end(), tampered]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["tree", "block", "leaves", "ids", "log", "tampered"])


def subroots(layers: list[DataFrame], fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """(tree, subroot): the last node of each tree's only log in its top layer."""
    tops = [x.where(F.col("leaves") <= fanout**height).select("tree", F.element_at("log", -1).alias("subroot")) for x in layers]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def log_nodes(layers: list[DataFrame], fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """The whole log of each tree, one row per node: tree, position (postorder in the tree), level, digest."""
    size = fanout**height

    def run(batches):
        for batch in batches:
            layer, tree, block, total, log, count = (batch.column(c).to_pylist() for c in ("layer", "tree", "block", "total", "log", "n"))
            for i in range(batch.num_rows):
                rows = []
                base, n = layer[i] * height, count[i]
                whole = height if total[i] > size**(layer[i] + 1) else _height(n, fanout)
                for h in range(1 if layer[i] else 0, whole + 1):
                    for k in range(-(-n // fanout**h)):
                        local = int(last_leaf(h, k, n, fanout))
                        last = min((block[i] * size + local + 1) * fanout**base, total[i]) - 1
                        rows.append((tree[i], int(place(base + h, last, fanout)), base + h, log[i][int(place(h, local, fanout))]))
                yield pa.RecordBatch.from_pylist([dict(zip(("tree", "position", "level", "digest"), r, strict=True)) for r in rows], pa.schema([("tree", pa.string()), ("position", pa.int64()), ("level", pa.int32()), ("digest", pa.string())]))

    all_ = None
    for k, layer in enumerate(layers):
        total = layers[0].groupBy("tree").agg(F.max("leaves").alias("total")).withColumnRenamed("tree", "_tree")
        part = layer.select(F.lit(k).alias("layer"), "tree", "block", "log", F.size("ids").alias("n")).join(total, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
        all_ = part if all_ is None else all_.unionByName(part)
    return in_batches(all_).mapInArrow(run, "tree string, position long, level int, digest string")


def _sides(log: list[str], n: int, height: int, fanout: int) -> list[list[tuple[str, str]]]:
    """For each level of a log, the digests before and after every node in its run, joined."""
    out = []
    for h in range(height):
        nodes = [log[k] for k in place(h, last_leaf(h, np.arange(-(-n // fanout**h)), n, fanout), fanout).tolist()]
        out.append([("".join(nodes[k // fanout * fanout : k]), "".join(nodes[k + 1 : (k // fanout + 1) * fanout])) for k in range(len(nodes))])
    return out


def _paths(layer: DataFrame, above: DataFrame, schema: str, emit, fanout: int, height: int) -> DataFrame:
    """Rows that ``emit`` makes of each leaf: its log row's values, its number, and its sides from its level up.

    ``above``: tree, block (null for a tree's only log) and the rest of the path (before, after, subroot, root)."""
    up = above.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), "before", "after", "subroot", "root")
    alone = F.when(F.col("leaves") > fanout**height, F.col("block"))
    met = layer.join(up, F.col("tree").eqNullSafe(F.col("_tree")) & alone.eqNullSafe(F.col("_block"))).drop("_tree", "_block")
    names = [p.split(" ")[0] for p in schema.split(", ")]

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 1) for i in range(whole.num_rows)):
                r = batch.to_pylist()[0]
                n = len(r["ids"])
                levels = height if r["leaves"] > fanout**height else _height(n, fanout)
                sides = _sides(r["log"], n, levels, fanout)
                rest = list(zip(r["before"], r["after"], strict=True))
                rows = []
                for i in range(n):
                    path = [sides[h][i // fanout**h] for h in range(levels)] + rest
                    rows.append(emit(r, i, r["log"][int(place(0, i, fanout))], path))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _kinds(schema), strict=True)], names)

    return in_batches(met).mapInArrow(run, schema)


def _kinds(schema: str) -> list[pa.DataType]:
    known = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return [known[p.split(" ")[1]] for p in schema.split(", ")]


_PATH = "tree string, block long, before array<string>, after array<string>, subroot string, root string"
_PROOF = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _upper(r: dict, i: int, _leaf: str, path: list) -> tuple:
    return r["tree"], r["block"] * r["_size"] + i, [b for b, _ in path], [a for _, a in path], r["subroot"], r["root"]


def _proved(r: dict, i: int, leaf_: str, path: list) -> tuple:
    at = r["tampered"][i] or leaf_
    for before, after in path:
        at = digest(before, at, after)
    return r["ids"][i], leaf_, r["subroot"], r["root"], digest(*[s for side in path for s in side]), at, at == r["root"]


def proofs(layers: list[DataFrame], top: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """_PROOF for every leaf of the lowest layer.  ``top``: _PATH with null blocks, what lies above each tree's root."""
    above = top
    for layer in reversed(layers[1:]):
        path = _paths(layer.withColumn("_size", F.lit(fanout**height).cast("long")), above, _PATH, _upper, fanout, height)
        above = staged(path.unionByName(top), "merkle-paths")
    return _paths(layers[0], above, _PROOF, _proved, fanout, height)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", doc_id: str = "doc_id", text: str = "text", tampers: Column | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> tuple[list[DataFrame], list[DataFrame], str | None]:
    """(layers of the groups' trees, layers of the tree of their roots, root); the layers are staged.

    ``tampers``: rows whose proof is later folded from the leaf of their text in lower case (A-Z)."""
    plain = {f: F.col(f) for f in fields}
    folded = plain | {text: F.translate(F.col(text), _UPPER, _LOWER)}
    changed = F.when(F.lit(False) if tampers is None else tampers, leaf([folded[f] for f in fields]))
    rows = docs.select(F.col(group).cast("string").alias("tree"), F.col(doc_id).cast("long").alias("id"), leaf([plain[f] for f in fields]).alias("leaf"), changed.alias("tampered"))
    placed = numbered(rows, "tree", ["id", "leaf"], "merkle-leaves")
    layers = build(placed, "merkle-log", fanout, height)
    discard(placed)
    tops = subroots(layers, fanout, height).select(F.lit("").alias("all"), F.col("tree").alias("of"), F.col("subroot").alias("leaf"))
    placed = numbered(tops, "all", ["of"], "merkle-subroots")
    order = placed.select(F.col("all").alias("tree"), "pos", "leaves", F.lit(None).cast("long").alias("id"), "leaf", F.col("of").alias("tampered"))
    crown = build(order, "merkle-crown", fanout, height)
    discard(placed)
    root = subroots(crown, fanout, height).first()
    return layers, crown, root and root["subroot"]


def _crowned(r: dict, i: int, leaf_: str, path: list) -> tuple:
    return r["tampered"][i], None, [b for b, _ in path], [a for _, a in path], leaf_, r["root"]


def verify(layers: list[DataFrame], crown: list[DataFrame], root: str | None, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """_PROOF of every leaf of a manifest: its proof, the root folded from it and whether that is the root."""
    spark = layers[0].sparkSession
    none = F.array().cast("array<string>")
    top = spark.range(1).select(F.lit("").alias("tree"), F.lit(None).cast("long").alias("block"), none.alias("before"), none.alias("after"), F.lit(root).cast("string").alias("subroot"), F.lit(root).cast("string").alias("root"))
    above = top
    for layer in reversed(crown[1:]):
        path = _paths(layer.withColumn("_size", F.lit(fanout**height).cast("long")), above, _PATH, _upper, fanout, height)
        above = staged(path.unionByName(top), "merkle-paths")
    # the leaves of the crown are the groups' roots; their names travel in ``tampered``
    groups = staged(_paths(crown[0], above, _PATH, _crowned, fanout, height), "merkle-groups")
    return proofs(layers, groups, fanout, height)
