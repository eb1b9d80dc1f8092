"""SimHash classes, zone clusters and the Merkle manifest: brute force, and the values of the defined cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import LONG, odd

from tranchery.llm import merkle_manifest as M
from tranchery.llm import simhash as S
from tranchery.llm import zone_clusters as Z
from tranchery.llm.components import components


def brute_fingerprint(text, n=3):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", lower) if x]
    grams = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, radius=3):
    """The classes of fingerprints, each named by its first place."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_engine_and_library_hash_alike(spark):
    texts = ["a", "the quick brown", "x" * 40, "été 日本 😀", "0123456789abcdefghijklmnopqrstuvwxyz"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(r["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest(r["t"].encode(), S.SEED) for r in rows)


def test_simhash_classes(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(200)]
    base = [[r.choice(vocab) for _ in range(r.randint(40, 400))] for _ in range(12)]
    rows = []
    for w in base:
        for _ in range(6):
            v = list(w)
            for _ in range(r.randint(0, 3)):
                v[r.randrange(len(v))] = r.choice(vocab)
            rows.append((len(rows), r.choice([" ", "\n", "\t "]).join(v).upper()))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "two words"), (504, "Two  Words"), (505, "one"), (None, rows[0][1]), (3, rows[20][1]), (3, rows[20][1]), (506, LONG), (None, "alone and without an id")]
    rows += [(600, "one two three ONE two three one")]  # ties: exactly half of the shingles is not enough
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("fp", "id", "least", "n", "c", "w", "v")})
    got = collections.Counter(map(tuple, S.classes(docs, part=8, nodes=20).collect()))
    values = [brute_fingerprint(t) for _, t in rows]
    names = linked(values)
    least = collections.defaultdict(list)
    for (i, _), c in zip(rows, names, strict=True):
        least[c] += [i] if i is not None else []
    want = collections.Counter((i, f"{v:016x}", min(least[c], default=None)) for (i, _), v, c in zip(rows, values, names, strict=True))
    assert got == want
    assert len({x[2] for x in want}) < 60 and want[(500, "0" * 16, 500)] == 1


def test_long_texts_are_counted_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "_CHUNK", 7)
    texts = [LONG[:900], None, "a b c d", "", "x y"]
    w = S.Words(__import__("pyarrow").array(texts))
    assert S.majority(*S.shingle_hashes(w), w.rows).tolist() == [brute_fingerprint(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1)), min_size=1, max_size=60, unique=True), st.integers(0, 4), st.randoms())
def test_trees_find_all_within_the_radius(rows, radius, rnd):
    near = [(t, f ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 5)))) for t, f in rows]
    rows = sorted(set(rows) | set(near))
    tree, fp = np.array([t for t, _ in rows]), np.array([f for _, f in rows], np.uint64)
    forest = S.Forest.build(fp, tree, tree, radius)
    parts = [S.Forest.build(fp[tree == t], tree[tree == t], tree[tree == t], radius) for t in sorted(set(tree.tolist()), reverse=True)]
    want = {(i, f) for i, (t, p) in enumerate(rows) for u, f in rows if t == u and (p ^ f).bit_count() <= radius}
    for f in (forest, S.Forest.joined(parts)):
        probe, node = f.near(fp, tree, radius)
        assert sorted(zip(probe.tolist(), f.fp[node].tolist(), strict=True)) == sorted(want)
        assert sorted(f.fp.tolist()) == sorted(fp.tolist()) and (np.diff(f.key) >= 0).all()


@pytest.mark.parametrize(("part", "nodes"), [(32, 200), (5, 40), (4096, 1 << 20)])
def test_dense_shards_make_few_links(spark, part, nodes):
    r = random.Random(1)
    values = set()
    for b in [r.getrandbits(64) for _ in range(4)]:
        for _ in range(120):
            for k in r.sample(range(64), r.randint(0, 2)):
                b ^= 1 << k
            values.add(b)
        values |= {b ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    values = sorted(values | {r.getrandbits(64) for _ in range(100)})
    links = S.near_links(spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long"), 3, part, nodes)
    label = {int(np.int64(x["v"]).view(np.uint64)): x["c"] for x in components(links).collect()}
    names, got = linked(values), collections.defaultdict(set)
    want = collections.defaultdict(set)
    for v, c in zip(values, names, strict=True):
        got[label.get(v, str(v))].add(v)
        want[c].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    if part == 4096:
        assert links.count() <= 16 * len(values)


def brute_clusters(rows, k, rounds, dims):
    rows = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    q = [[math.floor(256 * x) for x in v] for _, v in rows]
    name = lambda i: (rows[i][0] is None, hashlib.sha256(f"2:{rows[i][0]}".encode()).hexdigest(), rows[i][1])
    c = [q[i] for i in sorted(range(len(q)), key=name)[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((away(v, m), j) for j, m in enumerate(c)) for v in q]
    for _ in range(rounds):
        of = assign()
        for j in range(len(c)):
            mine = [v for v, (_, m) in zip(q, of, strict=True) if m == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else c[j]
    return collections.Counter((rows[i][0], j, d) for i, (d, j) in enumerate(assign())), c


@pytest.mark.parametrize("size", [4, 256])
def test_zone_clusters(spark, size):
    r = random.Random(5)
    centres = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in r.choice(centres)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(7, rows[7][1])] * 2 + [(None, rows[3][1]), (300, [0.0] * 8), (301, [-0.001] * 8)]
    rows += [(400, None), (401, []), (402, [0.0] * 7), (403, [0.0] * 9), (404, [None] + [0.0] * 7), (405, [math.nan] + [0.0] * 7), (406, [math.inf] + [0.0] * 7)]
    rows += [(500, [200.0, -300.0] + [0.0] * 6)]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("z") for c in ("id", "v", "x", "key", "n", "s", "c", "low", "cluster", "distance")})
    assigned, centroids = Z.cluster(df, k=6, rounds=4, dims=8, size=size)
    want, c = brute_clusters(rows, 6, 4, 8)
    assert centroids.tolist() == c
    got = Z.with_inertia(assigned, centroids).collect()
    assert collections.Counter((x["vec_id"], x["cluster"], x["distance"]) for x in got) == want
    total = collections.Counter()
    for (_, j, d), n in want.items():
        total[j] += d * n
    for x in got:
        assert x["cluster_inertia"] == total[x["cluster"]] and x["inertia"] == sum(total.values())
        assert x["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[x["cluster"]])).encode()).hexdigest()


def test_zone_clusters_of_few_and_of_huge(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert Z.with_inertia(*Z.cluster(empty, dims=2)).count() == 0
    two = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.5, 0.5])], "vec_id long, embedding array<double>")
    assigned, c = Z.cluster(two, dims=2)
    assert len(c) == 2 and sorted(x["distance"] for x in assigned.collect()) == [0, 0]
    with pytest.raises(Exception, match="might not fit"):
        Z.cluster(spark.createDataFrame([(1, [1e30, 0.5])], "vec_id long, embedding array<double>"), dims=2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**26), 2**26), min_size=3, max_size=3), min_size=1, max_size=12), st.lists(st.lists(st.integers(-(2**26), 2**26), min_size=3, max_size=3), min_size=1, max_size=9))
def test_boxes_keep_the_nearest(points, centroids):
    x, c = np.array(points, np.int64), np.array(centroids, np.int64)
    away = [[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in centroids] for p in points]
    some = Z.candidates(x.min(0), x.max(0), c)
    at, d = Z.nearest(x, c[some])
    assert some[at].tolist() == [row.index(min(row)) for row in away] and d.tolist() == [min(row) for row in away]


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (5, 1)])
def test_the_curve_steps_to_neighbours(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = [k.tobytes() for k in Z.hilbert_keys(points, bits)]
    steps = np.abs(np.diff(points[sorted(range(len(keys)), key=keys.__getitem__)], axis=0)).sum(1)
    assert len(set(keys)) == len(keys) and (steps == 1).all()


def test_boxes_of_separate_groups_leave_one_candidate():
    r = np.random.default_rng(1)
    centres = r.integers(-200, 200, (12, 16))
    x = (centres[np.repeat(np.arange(12), 64)] + r.integers(-4, 5, (768, 16))).astype(np.int64)
    left = [len(Z.candidates(x[i : i + 64].min(0), x[i : i + 64].max(0), centres)) for i in range(0, 768, 64)]
    assert left == [1] * 12


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """(root, for each leaf the digests before and after it, level by level)."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for p, i in zip(paths, at, strict=True):
            run = i // 8 * 8
            p.append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        level, at = [sha(*level[i : i + 8]) for i in range(0, len(level), 8)], [i // 8 for i in at]
    return level[0], paths


def brute_manifest(rows):
    lower = lambda t: t and "".join(c.lower() if c.isascii() else c for c in t)
    leaf = lambda r, t: sha(*[enc(v) for v in (*r[:4], t)])
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r, leaf(r, r[4])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = brute_tree([x for _, x in groups[g]])
    root, crown = brute_tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, crown, strict=True):
        for (r, x), path in zip(groups[g], trees[g][1], strict=True):
            path = path + up
            crc = __import__("zlib").crc32(str(r[0]).encode())
            f = leaf(r, lower(r[4])) if r[0] is not None and crc % 3 == 0 else x
            for a, b in path:
                f = sha(a, f, b)
            out.append((r[0], x, trees[g][0], root, sha(*[s for p in path for s in p]), f, f == root))
    return collections.Counter(out)


def cases():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


@pytest.mark.parametrize("height", [1, 2, 3])
def test_merkle_manifest(spark, height):
    r = random.Random(height)
    groups = [("de", 1), ("en", 150), ("fr", 64), (None, 65), ("", 8), ("zz", 9), ("é", 3)] + [(f"l{i}", 2) for i in range(70)]
    rows = []
    for g, n in groups:
        rows += [(len(rows), r.choice([None, "web", "Büch"]), g, r.choice([None, 5, -1]), r.choice([None, "", "Some Text", "kleiner text", "ÄÖ Ü"])) for _ in range(n)]
    rows += [(None, None, None, None, None), (None, "a", "en", 1, "No Id"), (5, "a", "en", 1, "B"), (5, "a", "en", 1, "B"), (6, "a", "en", 1, LONG)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(0) for c in ("tree", "id", "leaf", "pos", "leaves", "block", "of", "all")})
    layers, crown, root = M.manifest(docs, tampers=cases(), height=height)
    got = collections.Counter(map(tuple, M.verify(layers, crown, root, height=height).collect()))
    want = brute_manifest(rows)
    assert got == want and 0 < sum(n for x, n in want.items() if not x[-1]) < len(rows)
    nodes = collections.defaultdict(dict)
    for x in M.log_nodes(layers, height=height).collect():
        assert x["position"] not in nodes[x["tree"]]
        nodes[x["tree"]][x["position"]] = (x["level"], x["digest"])
    leaves = collections.defaultdict(list)
    for x in layers[0].orderBy("tree", "block").collect():
        leaves[x["tree"]] += [x["log"][int(M.place(0, i))] for i in range(len(x["ids"]))]
    for tree, have in leaves.items():
        assert [nodes[tree][i] for i in range(len(nodes[tree]))] == postorder(have)


def postorder(leaves):
    """A whole tree's (level, digest), children before their parent."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    out = []

    def walk(h, i):
        if h:
            for k in range(i * 8, min(i * 8 + 8, len(levels[h - 1]))):
                walk(h - 1, k)
        out.append((h, levels[h][i]))

    walk(len(levels) - 1, 0)
    return out


def test_merkle_of_nothing_and_of_one(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    layers, crown, root = M.manifest(spark.createDataFrame([], schema))
    assert root is None and M.verify(layers, crown, root).count() == 0
    row = (1, "s", None, 2, "x")
    layers, crown, root = M.manifest(spark.createDataFrame([row], schema))
    alone = sha(*map(enc, row))
    assert root == alone and [tuple(x) for x in M.verify(layers, crown, root).collect()] == [(1, alone, alone, alone, sha(), alone, True)]


def test_odd_rows_keep_their_number(spark):
    docs = odd(spark)
    assert S.classes(docs).count() == docs.count() and S.classes(odd(spark, [])).count() == 0
    layers, crown, root = M.manifest(docs.withColumn("n_chars", F.lit(1)), tampers=cases())
    assert M.verify(layers, crown, root).count() == docs.count()
