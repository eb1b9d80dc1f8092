"""Language-model scores by subword lattice likelihood.

A text is its words and one end.  The scores of an existing subword vocabulary weight all segmentations of a word; the
forward recursion in log space sums them up, so a word's probability is that of all its spellings.  Since no piece
crosses white space, the marginal probability of a document is the product over its words and the end.  What is
learnt from the training texts enters as one more arc across each whole word: with N training tokens, of which n1 are
words seen once, the whole-word arc of a word seen c times has probability (1 - n1/N) * c/N and the pieces share the
mass n1/N of unseen words (Good-Turing).  The end has (1 - n1/N) times its share of the tokens, so that all shares sum
to one.

Counts cover all training texts (Python counts words per batch, Spark sums them up).  The most frequent
``hot`` words, a table of fixed size, are broadcast and scored in place; all others are joined to the counts by a
shuffle, so a document's hot words never meet in one task.

Defined cases: a null text is empty (the end alone); without training texts, or where all of their words are seen once
and there is next to nothing else, every word is spelled by pieces and the end has the base's probability; texts are
read whole; words of equal count that are at the edge of ``hot`` score alike on either side; equal ids and repeated rows
are separate rows; an empty table gives an empty result; columns other than those named are not read, whatever their
names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tranchery.llm.lattice import log_marginals, vocabulary
from tranchery.llm.shared import discard, in_batches, staged
from tranchery.llm.text import pieces_of

HOT_WORDS = 200_000
_FLUSH = 400_000


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) over all texts; each task sums up what it has before the shuffle."""

    def run(batches):
        seen: Counter = Counter()
        for whole in batches:
            for batch in pieces_of(whole, "text", 4 << 20):
                for body in batch.column("text").to_pylist():
                    if body:
                        seen.update(body.encode().lower().split())
                if len(seen) > _FLUSH:
                    yield _count_batch(seen)
                    seen.clear()
        if seen:
            yield _count_batch(seen)

    return in_batches(texts.select("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _count_batch(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


class WordScores:
    """Training totals and the two probabilities of a word, from its count and its spelling's log probability."""

    def __init__(self, words: int, distinct: int, once: int, ends: int):
        self.tokens, self.types = words + ends, distinct + (ends > 0)
        self.ends = ends
        self.unseen = min(max(once, 1) / (self.tokens + 1), 1.0) if self.tokens else 1.0

    def base(self, count: int) -> float:
        return math.log10((count + 0.1) / (self.tokens + 0.1 * (self.types + 1)))

    def model(self, count: int, spelled: float) -> float:
        """``spelled``: log10 of the lattice's marginal."""
        if not count:
            return math.log10(self.unseen) + spelled
        return math.log10((1 - self.unseen) * count / self.tokens + self.unseen * 10.0 ** max(spelled, -300))

    def end(self) -> float:
        """The end's share of what the learnt tokens have: with the words, known and spelled, it sums to one."""
        return math.log10((1 - self.unseen) * self.ends / self.tokens) if self.ends and self.unseen < 1 else self.base(self.ends)

    def base_sql(self, count: Column) -> Column:
        return F.log10((count + F.lit(0.1)) / F.lit(self.tokens + 0.1 * (self.types + 1)))

    def model_sql(self, count: Column, spelled: Column) -> Column:
        known = F.log10(F.lit((1 - self.unseen) / max(self.tokens, 1)) * count + F.lit(self.unseen) * F.pow(F.lit(10.0), F.greatest(spelled, F.lit(-300.0))))
        return F.when(count > 0, known).otherwise(F.lit(math.log10(self.unseen)) + spelled)


def spelled(model_file: str, words: list[bytes]) -> np.ndarray:
    """log10 of the marginal probability of each word (with the mark that opens a word)."""
    return log_marginals(vocabulary(model_file), ["▁" + w.decode() for w in words]) / math.log(10)


def score(docs: DataFrame, train: Column, model_file: str, text: str = "text", keep: list[str] | None = None, hot: int = HOT_WORDS) -> DataFrame:
    """The kept columns with n_tokens, n_known, train_tokens, base_score and score (log10).  ``train`` says which rows teach."""
    keep = keep or [c for c in docs.columns if c != text]
    plain = [f"_k{i}" for i in range(len(keep))]
    given = docs.select(*[F.col(c).alias(p) for c, p in zip(keep, plain, strict=True)], F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("_train"))
    counts = staged(word_counts(given.where("_train")), "word-counts")
    ends = given.where("_train").count()
    n, types, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)).first()
    totals = WordScores(n, types, once, ends)
    top = counts.orderBy(F.desc("n"), "word").limit(hot).toArrow()
    words, often = top.column("word").to_pylist(), top.column("n").to_pylist()
    table = {w: (totals.base(n), totals.model(n, s)) for w, n, s in zip(words, often, spelled(model_file, words).tolist(), strict=True)}
    del top, words, often
    shared = docs.sparkSession.sparkContext.broadcast(table)
    end, last = totals.base(ends), totals.end()
    fields = {p: docs.schema[c].dataType.simpleString() for c, p in zip(keep, plain, strict=True)}
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64()), ("spelled", pa.float64())]))

    def run(batches):
        known = shared.value
        for whole in batches:
            for batch in pieces_of(whole, "text", 4 << 20):
                tokens, hits, base, model, rare = [], [], [], [], []
                for body in batch.column("text").to_pylist():
                    seen = Counter(body.encode().lower().split()) if body else {}
                    b, m, h, left = end, last, 0, []
                    for w, k in seen.items():
                        if (x := known.get(w)) is not None:
                            b += k * x[0]
                            m += k * x[1]
                            h += k
                        else:
                            left.append((w, k))
                    tokens.append(sum(seen.values()) + 1)
                    hits.append(h + (ends > 0))
                    base.append(b)
                    model.append(m)
                    rare.append(left)
                unique = sorted({w for left in rare for w, _ in left})
                spell = dict(zip(unique, spelled(model_file, unique).tolist(), strict=True))
                tail = pa.array([[(w, k, spell[w]) for w, k in left] for left in rare], tail_type)
                yield pa.RecordBatch.from_arrays([*(batch.column(p) for p in plain), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64()), tail], [*plain, "n_tokens", "hits", "base", "model", "tail"])

    out = ", ".join(f"{p} {t}" for p, t in fields.items())
    partial = in_batches(given.select(*plain, "text")).mapInArrow(run, f"{out}, n_tokens long, hits long, base double, model double, tail array<struct<word:binary,n:long,spelled:double>>")
    partial = staged(partial.withColumn("_row", F.monotonically_increasing_id()), "word-scores")
    rare = partial.select("_row", F.explode("tail").alias("t")).select("_row", F.col("t.word").alias("word"), F.col("t.n").alias("k"), "t.spelled")
    count = F.coalesce(F.col("n"), F.lit(0))
    joined = rare.join(counts, "word", "left").select("_row", (F.col("k") * F.when(count > 0, 1).otherwise(0)).alias("h"), (F.col("k") * totals.base_sql(count)).alias("b"), (F.col("k") * totals.model_sql(count, F.col("spelled"))).alias("m"))
    sums = joined.groupBy("_row").agg(F.sum("h").alias("h"), F.sum("b").alias("b"), F.sum("m").alias("m"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    done = partial.drop("tail").join(sums, "_row", "left")
    return done.select(*[F.col(p).alias(c) for p, c in zip(plain, keep, strict=True)], "n_tokens", (F.col("hits") + zero("h")).alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), (F.col("model") + zero("m")).alias("score"))
