r"""Secret scans with multipart credential linking.

One pass over each text finds strong spans (kinds ``assign``, ``access``, ``hex``) and weak parts: endpoints (URLs and
dotted host names with a port), access identifiers (short key ids, user= and client_id= values) and secret-like tokens
(long mixed base64 runs).  A weak part alone says little.  The parts are then joined by interval: two parts of
different roles link when their spans lie within ``window`` characters of each other in the same text (the scope); the
join runs on (document, scope block), so a text full of parts is spread over blocks.  A weak part is reported, as kind
``linked_<role>``, only when parts of both other roles lie within its window: identifier, secret and endpoint
complement each other.  Strong spans serve as identifiers (``access``) and secrets (``assign``, ``hex``) in the join.  A
weak part that overlaps a strong span, as a URL with a token in it, is a complement for others; it isn't reported itself.

Defined cases: a null or empty text has no spans; repeated secrets are reported at each place; equal ids (repeated
rows) are kept apart by a row key; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tranchery.llm.shared import in_batches, staged
from tranchery.llm.text import pieces_of

# The kinds, in their order within one start.
KINDS = ["assign", "access", "hex", "linked_identifier", "linked_secret", "linked_endpoint"]
WINDOW = 200

# The patterns.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ENDPOINT = re.compile(r"\b(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D\"'<>|]+|\b[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}\b")
IDENTIFIER = re.compile(r"\b(?ai:user(?:name)?|login|client_id|access_?key_?id|account)\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})|\b(?:ASIA|AIDA|AROA|GOOG)[A-Z0-9]{12,}")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_HINT_ASSIGN = re.compile(r"(?ai:passw|secret|token|api_?key)")


def strong_spans(body: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong spans, sorted; matches of too few characters are dropped."""
    out = []
    if _HINT_ASSIGN.search(body):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(body) if len(m[2]) >= 8]
    if "AKIA" in body:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(body) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(body)]
    return sorted(out)


def _mixed(x: str) -> bool:
    return any(c.isdigit() for c in x) and any(c.islower() for c in x) and any(c.isupper() for c in x)


def weak_parts(body: str, strong: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, role, end); roles 0 identifier, 1 secret, 2 endpoint.  Parts that overlap a strong span come second."""
    out = []
    if ":" in body:
        out += [(m.start(), 2, m.end()) for m in ENDPOINT.finditer(body)]
    if "=" in body or ":" in body or "A" in body:
        out += [(m.start(), 0, m.end()) for m in IDENTIFIER.finditer(body)]
    out += [(m.start(), 1, m.end()) for m in SECRET.finditer(body) if _mixed(m[0])]
    taken, free, over, k = [(s, e) for s, _, e in strong], [], [], 0
    for start, role, end in sorted(out):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        (over if k < len(taken) and taken[k][0] < end else free).append((start, role, end))
    return free, over


def parts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: id, strong spans, weak parts and weak parts over strong spans, as arrays of (start, kind or role, end)."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                strong, weak, over = [], [], []
                for body in batch.column("text").to_pylist():
                    found = strong_spans(body) if body else []
                    for out, some in zip((strong, weak, over), (found, *(weak_parts(body, found) if body else ((), ()))), strict=True):
                        out.append([{"start": s, "kind": k, "end": e} for s, k, e in some])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, spans) for x in (strong, weak, over))], ["doc_id", "strong", "weak", "over"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = "array<struct<start:int,kind:int,end:int>>"
    return in_batches(given).mapInArrow(run, f"doc_id {id_type}, strong {kind}, weak {kind}, over {kind}")


def link(found: DataFrame, window: int) -> DataFrame:
    """Weak parts that both other roles complement: (row, start, kind, end).  ``found`` has row, strong, weak and over."""
    role = F.when(F.col("p.kind") == 1, 0).otherwise(1)
    strong = found.select("row", F.explode("strong").alias("p")).select("row", F.col("p.start"), role.alias("role"), F.col("p.end"), F.lit(False).alias("weak"))
    part = lambda c, own: found.select("row", F.explode(c).alias("p")).select("row", F.col("p.start"), F.col("p.kind").alias("role"), F.col("p.end"), F.lit(own).alias("weak"))
    weak = part("weak", True)
    # only rows with a weak part matter
    every = strong.unionByName(part("over", False)).join(weak.select("row").distinct(), "row", "left_semi").unionByName(weak)
    # a block is as wide as the window, so it holds few parts, and a row full of parts is spread over its blocks
    block = lambda c: F.floor(c / F.lit(window))
    at = every.withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("end")))))
    left = weak.withColumn("block", F.explode(F.sequence(block(F.col("start") - window), block(F.col("end") + window))))
    pair = left.alias("a").join(at.alias("b"), (F.col("a.row") == F.col("b.row")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.role") != F.col("b.role")) & (F.col("b.start") <= F.col("a.end") + window) & (F.col("b.end") >= F.col("a.start") - window))
    linked = pair.groupBy("a.row", "a.start", "a.role", "a.end").agg(F.count_distinct("b.role").alias("others"))
    return linked.where("others = 2").select("row", "start", (F.col("role") + 3).alias("kind"), "end")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: id, ``base`` (the strong spans) and ``spans`` (all spans), sorted arrays of (start, kind, end)."""
    found = staged(parts(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "secret-parts")
    linked = link(found.where(F.size("weak") > 0), window).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    joined = found.select("row", "doc_id", "strong").join(linked, "row", "left")
    every = F.when(F.col("linked").isNull(), F.col("strong")).otherwise(F.array_sort(F.concat("strong", "linked")))
    return joined.select(F.col("doc_id").alias(doc_id), F.col("strong").alias("base"), every.alias("spans"))


def written(spans) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
