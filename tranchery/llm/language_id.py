"""Language identification by error-correcting output codes.

Every language gets a codeword of bits.  For each bit one binary classifier over hashed byte n-grams (naive Bayes with
a log-odds weight per n-gram: languages whose bit is 1 against the others) is fitted from the n-gram counts of all
training texts; the counts are summed by Spark into a table of fixed size (buckets x languages).  A text's margins,
the mean weight of its n-grams under each classifier, are decoded by loss: the language whose codeword has the least
sum of logistic losses wins.  A text is flagged ambiguous when the runner-up is nearly as close.

Up to six languages use the exhaustive code (2**(L-1) - 1 bits, every pair differs in about half of them); beyond
that, ``bits`` columns are drawn from a seeded hash, the best of several draws by least pairwise distance.

Up to six languages the code is exhaustive (all ways to part them), beyond that 31 bits are drawn for large distances.
A bucket that training texts hit once only has no weight.

Defined cases: a null or letterless text is ``und`` with score 0; without any labelled text every document is ``und``;
an empty table gives an empty result; rows with null label or text teach nothing; repeated rows count as often as they
occur; columns other than those named are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tranchery.llm.shared import in_batches
from tranchery.llm.text import LOWER, mix, pieces_of, utf8

ORDERS = (2, 3)
BUCKET_BITS = 16
UNKNOWN = "und"
#: ASCII other than letters is one separator byte; everything beyond ASCII and the letters stand for themselves
_FOLD = LOWER.copy()
_FOLD[:0x80] = 0x20
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order: the buckets of all n-grams of a column's texts in order of rows, and their number per row.

    Separator runs are one byte, and each text is set between separators."""
    data, offsets = utf8(column)
    rows = len(offsets) - 1
    padded = np.full(len(data) + 2 * rows, 0x20, np.uint8)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    padded[np.arange(len(data)) + 2 * row + 1] = _FOLD[data]
    begin = offsets[:-1] + 2 * np.arange(rows)
    first = np.zeros(len(padded) + 1, bool)
    first[begin] = True
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 0x20) | (padded[:-1] != 0x20) | first[1:-1]
    begin = np.concatenate([[0], np.cumsum(keep)])[np.append(begin, len(padded))]
    data = padded[keep].astype(np.uint32)
    sizes, out = np.diff(begin), []
    for k in ORDERS:
        size = max(len(data) - k + 1, 0)
        code = np.zeros(size, np.uint32)
        for i in range(k):
            code |= data[i : i + size] << np.uint32(8 * i)
        ok = np.ones(size, bool)
        for i in range(1, k):  # grams across the end of a row
            cross = begin[1:-1] - i
            ok[cross[(cross >= 0) & (cross < size)]] = False
        code = code[ok] * np.uint32(0x9E3779B1) + np.uint32(k)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        out.append(((code >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), np.maximum(sizes - k + 1, 0)))
    return out


def ngram_counts(train: DataFrame, labels: list[str], label: str, text: str) -> np.ndarray:
    """Counts (language x bucket) over all training rows: summed in each task, then by Spark over tasks."""
    code = {x: i for i, x in enumerate(labels)}
    size = 1 << BUCKET_BITS

    def run(batches):
        total = np.zeros((len(code), size), np.int64)
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                lab = np.array([code[x] for x in batch.column("lang").to_pylist()], np.int64)
                for bucket, counts in features(batch.column("text")):
                    total += np.bincount(np.repeat(lab, counts) * size + bucket, minlength=total.size).reshape(total.shape)
        for i in range(len(code)):
            if total[i].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i].tobytes()], pa.binary())], ["code", "counts"])

    def add(batches):
        total = {}
        for batch in batches:
            for i, x in zip(batch.column("code").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(x, np.int64)
        for i, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["code", "counts"])

    given = train.select(F.col(text).alias("text"), F.col(label).alias("lang"))
    parts = in_batches(given).mapInArrow(run, "code int, counts binary")
    # a tree of sums: whatever the number of tasks, at most eight tables of fixed size per language reach the driver
    width = math.isqrt(given.rdd.getNumPartitions())
    for width in (width, 8) if width > 16 else (8,):
        parts = parts.repartition(width).mapInArrow(add, "code int, counts binary")
    out = np.zeros((len(labels), size), np.int64)
    for r in parts.collect():
        out[r["code"]] += np.frombuffer(r["counts"], np.int64)
    return out


def codewords(count: int, bits: int = 31) -> np.ndarray:
    """A codeword of +1/-1 for each of ``count`` languages."""
    if count <= 6:
        cols = [[1 if i == 0 else (1 if b >> (i - 1) & 1 else -1) for i in range(count)] for b in range((1 << max(count - 1, 0)) - 1)]
        return np.array(cols, np.int8).T if cols else np.ones((count, 1), np.int8)
    best, best_far = None, (-1, -1)
    for draw in range(200):
        h = mix(np.arange(count * bits, dtype=np.uint64) + np.uint64(draw << 32))
        m = np.where(h.reshape(count, bits) >> np.uint64(63), 1, -1).astype(np.int8)
        far = (bits - m.astype(int) @ m.T.astype(int)) // 2
        np.fill_diagonal(far, bits)
        usable = int((np.abs(m.sum(0)) < count).sum())
        if (usable, far.min()) > best_far:
            best, best_far = m, (usable, far.min())
    return best


class Model:
    """Labels, codewords and one weight per (bit, bucket)."""

    def __init__(self, labels: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.labels, self.code = labels, codewords(len(labels))
        rate = (counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * counts.shape[1])
        weights = []
        for bit in self.code.T:
            one, zero = rate[bit > 0], rate[bit < 0]
            odds = np.log(one.mean(0)) - np.log(zero.mean(0)) if len(one) and len(zero) else np.full(counts.shape[1], 1.0 if len(one) else -1.0)
            odds[counts.sum(0) < 2] = 0 if len(labels) > 1 else odds[0]
            weights.append(odds)
        self.weights = np.array(weights, np.float32)

    def predict(self, column: pa.Array, margin: float):
        """(label, score, ambiguous) per row.

        The score is the softmax of minus the total loss over languages, with margins scaled by the evidence."""
        n = len(column)
        sums, grams = np.zeros((n, len(self.weights))), np.ones(n)
        for bucket, counts in features(column):
            some = np.flatnonzero(counts)
            if len(some):
                at = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
                for b, w in enumerate(self.weights):
                    sums[some, b] += np.add.reduceat(w.take(bucket), at)
                grams += counts
        # weight sums of n-grams of all orders overlap, so evidence is damped to the square root of their number
        f = sums / np.sqrt(grams)[:, None]
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None, :, :]).sum(2)
        order = np.argsort(loss, 1, kind="stable")
        best = order[:, 0]
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        top = np.take_along_axis(loss, order, 1)
        close = (top[:, 1] - top[:, 0]) < margin if loss.shape[1] > 1 else np.zeros(n, bool)
        return best, p[np.arange(n), best], close


def fit(train: DataFrame, label: str = "lang", text: str = "text") -> Model | None:
    """Fit from the labelled rows; None when there is none.  The labels are few: their distinct list goes to the driver."""
    rows = train.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    labels = sorted(r[0] for r in rows.select(label).distinct().collect())
    return Model(labels, ngram_counts(rows, labels, label, text)) if labels else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", margin: float = 0.5) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous; no other column than the text is looked at."""
    schema = docs.schema
    names = [f"_c{i}" for i in range(len(schema.fields))]
    body = names[docs.columns.index(text)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for whole in batches:
            for batch in pieces_of(whole, body):
                column = batch.column(body)
                n = len(column)
                texts = column.to_pylist()
                letters = [bool(x) and any(map(str.isalpha, x)) for x in texts]  # ends at the first letter
                if m is None:
                    label, score, close = [UNKNOWN] * n, [0.0] * n, [False] * n
                else:
                    best, p, near = m.predict(column, margin)
                    label = [m.labels[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letters, strict=True)]
                    score = [x if ok else 0.0 for x, ok in zip(p.tolist(), letters, strict=True)]
                    close = [bool(x) and ok for x, ok in zip(near.tolist(), letters, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], [*names, "lang_pred", "score", "ambiguous"])

    out = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema.fields, strict=True))
    done = in_batches(docs.toDF(*names)).mapInArrow(run, f"{out}, lang_pred string, score double, ambiguous boolean")
    return done.toDF(*docs.columns, "lang_pred", "score", "ambiguous")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
