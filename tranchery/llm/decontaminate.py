"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

Words are runs of ASCII letters or digits and of anything beyond ASCII, ASCII-lower-cased.  A test item gives its
windows of ``n`` consecutive words; an item of fewer words is one window.  Each document's windows are looked up in a
broadcast table of window hashes and every hit is verified word by word.  The table is broadcast in blocks of at most
``block_windows`` windows, so its size has a fixed bound; a benchmark with more windows takes several passes over the
documents, whose hits are united.  Documents are never shuffled in the usual one-block case.

Defined cases: a null or wordless text has no words and no hits; a test item with null id or without words is
ignored; repeated items and ids count once; other columns of either table are not read and pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranchery.llm.shared import in_batches
from tranchery.llm.text import ALNUM, Words, chain, pieces_of

BLOCK_WINDOWS = 1_000_000


def benchmark_windows(items: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    """Distinct (size, hash, phrase, item) windows of the test items, in Spark."""

    def run(batches):
        for batch in batches:
            out = []
            ids = batch.column(0).to_pylist()
            for part_at, part in _with_offsets(batch):
                w = Words(part.column(1), ALNUM)
                h, first = w.hashes(), np.concatenate([[0], np.cumsum(w.counts)])
                for r in range(w.rows):
                    size = min(n, int(w.counts[r]))
                    if size:
                        hs = chain(h[first[r] : first[r + 1]], size)
                        out += [(size, int(x.view(np.int64)), w.phrase(int(first[r]) + i, size), ids[part_at + r]) for i, x in enumerate(hs)]
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.string())], ["size", "hash", "phrase", "item"])

    given = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    return in_batches(given).mapInArrow(run, "size int, hash long, phrase binary, item string").distinct()


def _with_offsets(batch):
    at = 0
    for part in pieces_of(batch, "text"):
        yield at, part
        at += part.num_rows


class WindowSet:
    """One broadcast block: window hashes by size, a bit filter in front of them, and the words and items of each."""

    def __init__(self, rows):
        self.known = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for size, h, phrase, item in rows:
            self.known[size][np.int64(h).view(np.uint64).item()][bytes(phrase)].add(item)
        self.known = {s: {h: {p: sorted(i) for p, i in x.items()} for h, x in v.items()} for s, v in self.known.items()}
        self.mask = np.uint64((1 << 22) - 1)
        self.filters = {}
        for size, hashes in self.known.items():
            bits = np.zeros(1 << 22, bool)
            bits[(np.fromiter(hashes, np.uint64, len(hashes)) & self.mask).astype(np.int64)] = True
            self.filters[size] = bits

    def hits(self, w: Words) -> list[tuple[int, int, list[str]]]:
        """Verified (first word, size, items) of a batch's words."""
        out, h = [], w.hashes()
        for size, bits in self.filters.items():
            grams = chain(h, size)
            if not len(grams):
                continue
            maybe = np.flatnonzero(bits[(grams & self.mask).astype(np.int64)] & (w.row[: len(grams)] == w.row[size - 1 :]))
            table = self.known[size]
            for i in maybe.tolist():
                if (found := table.get(grams[i].item())) and (items := found.get(w.phrase(i, size))):
                    out.append((i, size, items))
        return out


def hit_spans(docs: DataFrame, windows: WindowSet, text: str, keep: list[str]) -> DataFrame:
    """Each document with n_words, its hit runs (word index, exclusive end, character start, end) and item ids."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(windows)
    schema = docs.select(*keep).schema
    names = [f.name for f in schema.fields]

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole, text):
                w = Words(batch.column(text), ALNUM)
                cover, items = np.zeros(len(w.start) + 1, np.int64), defaultdict(set)
                for i, size, found in shared.value.hits(w):
                    cover[i] += 1
                    cover[i + size] -= 1
                    items[int(w.row[i])].update(found)
                on = np.cumsum(cover)[:-1] > 0
                runs: list[list[dict]] = [[] for _ in range(w.rows)]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
                first = np.concatenate([[0], np.cumsum(w.counts)])
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    while a < b:  # a run that crosses into the next row is cut there
                        r = int(w.row[a])
                        e = min(b, int(first[r + 1]))
                        row = w.data[w.offsets[r] : w.offsets[r + 1]]
                        chars = lambda x, row=row, r=r: int(np.count_nonzero((row[: x - w.offsets[r]] & 0xC0) != 0x80))
                        runs[r].append({"first": a - int(first[r]), "after": e - int(first[r]), "start": chars(w.start[a]), "end": chars(w.end[e - 1])})
                        a = e
                arrays = [batch.column(c) for c in names]
                arrays += [pa.array(w.counts, pa.int64()), pa.array(runs, RUNS), pa.array([sorted(items.get(r, ())) for r in range(w.rows)], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "n_words", "runs", "items"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return in_batches(docs.select(*dict.fromkeys([*keep, text]))).mapInArrow(run, f"{out}, n_words long, runs array<struct<first:int,after:int,start:int,end:int>>, items array<string>")


RUNS = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: the kept columns, n_words, merged hit ``runs`` and the ``items`` (sorted) whose windows occur."""
    keep = list(dict.fromkeys([doc_id, *(keep or [])]))
    windows = benchmark_windows(benchmark, n, item_id, item_text)
    total = windows.count()
    blocks = -(-total // block_windows) or 1
    if blocks == 1:
        return hit_spans(docs, WindowSet(windows.collect()), text, keep)
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    found = None
    for b in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == b).collect()
        part = hit_spans(numbered, WindowSet(rows), text, [*keep, "_row"])
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("_row", *keep, "n_words").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    step = "aggregate(array_sort(runs), cast(array() as array<struct<first:int,after:int,start:int,end:int>>), (a, x) -> if(size(a) > 0 and x.first <= element_at(a, -1).after, concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'after', greatest(element_at(a, -1).after, x.after), 'start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))), concat(a, array(x))))"
    return merged.select(*keep, "n_words", F.expr(step).alias("runs"), "items")


def report(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The digest of :func:`contamination`: counts, and the sorted item ids as one SHA-256."""
    n_hit = F.expr("aggregate(runs, 0L, (a, x) -> a + x.after - x.first)")
    return found.select(doc_id, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", drop_share: float = 0.5, doc_id: str = "doc_id", **names) -> DataFrame:
    """Cut the hit runs out of the texts; drop a document of which at least ``drop_share`` of the words are hit."""
    columns = docs.columns
    plain = [f"_c{i}" for i in range(len(columns))]  # whatever the columns are called, none clashes with the results
    body = plain[columns.index(text)]
    found = contamination(docs.toDF(*plain), benchmark, n, doc_id=plain[columns.index(doc_id)], text=body, keep=plain, **names)
    hit = F.expr("aggregate(runs, 0L, (a, x) -> a + x.after - x.first)")
    cut = "concat(aggregate(runs, named_struct('t', '', 'p', 0), (a, x) -> named_struct('t', concat(a.t, substring({t}, a.p + 1, x.start - a.p)), 'p', x.end), a -> a.t), substring({t}, element_at(runs, -1).end + 1))".format(t=body)
    kept = found.where((F.size("runs") == 0) | (hit < F.lit(drop_share) * F.col("n_words")))
    return kept.withColumn(body, F.when(F.size("runs") > 0, F.expr(cut)).otherwise(F.col(body))).select(*plain).toDF(*columns)


def items_digest(items) -> str:
    """SHA-256 of item ids sorted as strings and joined by commas (for tests)."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
