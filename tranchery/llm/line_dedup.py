r"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines are the ``\n``-separated parts of a text, compared without the white space around them; lines of fewer than
``min_chars`` characters take no part.  A line goes when an equal line stands earlier in the corpus (by document id,
then line number), or when a line within ``tau`` edits of it has its first place earlier.

1. Equal lines meet by a 128-bit hash; each distinct line keeps its first place.
2. Each line is cut into ``tau + 1`` segments of even length.  At most ``tau`` edits leave one segment
   whole, so every partner at most as long as a line has a segment that occurs in the line near its own place:
   the line probes, for each partner length within ``tau``, the substrings whose start agrees with the edits that
   the left and the right side can hold.  Index entries (a line's own segments) and probes are rows of one table,
   dealt by a hash of (length, segment number, substring) and made distinct; an index entry is also the probe of its
   own place.  Keys at which two lines meet, one of them by an index entry, are live.
3. Only lines with live keys have their texts fetched and letters counted.  Pairs at a live key whose letter counts
   allow ``tau`` edits are verified by a bit-parallel edit distance over the diagonals of
   the band: bit d of a state word stands for diagonal d - tau, and one word per error count advances all of them.
4. Removed places go back to their documents, whose remaining lines are joined again.

Defined cases: null ids sort first; a null text stays null; empty and short lines stay, even where they repeat; rows
with equal id and text count as one document (all keep the same lines), rows with equal id and other text are ordered
by a text hash; very long lines and texts are no exception; an empty table stays empty; other columns pass unread, even
if their names clash with those in here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tranchery.llm.shared import discard, staged

TAU = 2
MIN_CHARS = 20
#: Lines that are probed once instead of at every place, and ids that are broadcast: both bounds are fixed
FREQUENT, FEW = 10_000, 500_000
_SPACE = " \t\n\x0b\f\r"
_LETTERS = "eanitrosh ldcuw"


def probes(tau: int) -> list[tuple[int, int, int]]:
    """(gap, segment, shift): for each partner length (the line's own less ``gap``) and segment, the shifts that the
    edits before the segment (at most its number) and behind it (at most tau less its number) allow.  The first
    ``tau + 1`` are the line's own segments, its index entries."""
    every = [(gap, k, shift) for gap in range(tau + 1) for k in range(tau + 1) for shift in range(max(-k, gap - (tau - k)), min(k, gap + (tau - k)) + 1)]
    return sorted(every, key=lambda p: p[0] != 0 or p[2] != 0)


def keyed(lines: DataFrame, tau: int) -> tuple[DataFrame, DataFrame]:
    """(key, h1, own) for the lines (line, h1): hashes of (length, segment, substring), and whether the row is an index
    entry; and the staged table they are read from.  A line's keys are staged as one array, as generated code would
    work the array out again for each of its entries.  Substrings are cut from UTF-32, where places are offsets."""
    ready = lines.select("h1", F.char_length("line").alias("n"), F.encode("line", "UTF-32").alias("body"))
    n, entries = F.col("n"), []
    for gap, k, shift in probes(tau):
        of = n - gap
        base = F.call_function("div", of, F.lit(tau + 1)).cast("int")
        short = F.lit(tau + 1) - (of - base * (tau + 1))  # so many first segments are one shorter
        at = base * k + F.greatest(F.lit(0), F.lit(k) - short) + shift
        size = base + F.when(F.lit(k) >= short, 1).otherwise(0)
        entries.append(F.when((at >= 0) & (at + size <= n), F.xxhash64(of, F.lit(k), F.substring("body", at * 4 + 1, size * 4))))
    table = staged(ready.select("h1", F.array(*entries).alias("keys")), "line-keys")
    rows = table.select("h1", F.posexplode("keys").alias("p", "key"))
    return rows.where("key is not null").select("key", "h1", (F.col("p") <= tau).alias("own")), table


def letters(line: Column) -> Column:
    """The counts of fifteen letters and the length, each modulo 16, in one 64-bit number."""
    out = F.char_length(line).cast("long").bitwiseAND(F.lit(15))
    for i, c in enumerate(_LETTERS, 1):
        count = F.char_length(line) - F.char_length(F.replace(line, F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(count.cast("long").bitwiseAND(F.lit(15)), 4 * i))
    return out


def may_be_close(a: Column, b: Column, tau: int) -> Column:
    """A bound that the ``letters`` of every pair within ``tau`` pass: one edit changes two counts by one at most, and
    counts apart by d modulo 16 are at least min(d, 16 - d) apart."""
    apart = F.lit(0)
    for i in range(1, len(_LETTERS) + 1):
        d = F.abs(_digit(a, i) - _digit(b, i))
        apart = apart + F.least(d, F.lit(16) - d)
    return apart <= 2 * tau


def _digit(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, 4 * i).bitwiseAND(F.lit(15)).cast("int")


def within(a: Column, b: Column, tau: int) -> Column:
    """Whether the edit distance of two strings is at most ``tau``, by bit-parallel automata over the band's diagonals.

    After i characters of ``a``, bit d of word e tells whether a[:i] becomes b[:i + d - tau] with at most e edits.  A
    character that matches stays on its diagonal; a replaced one too, with one more edit; one that is missing from b
    moves a diagonal down, one that b has in addition a diagonal up (closed over, as it takes no character of a).
    """
    width = 2 * tau + 1
    full = (1 << width) - 1

    def closed(words: list[Column]) -> list[Column]:
        out = [words[0]]
        for e in range(1, tau + 1):
            out.append(words[e].bitwiseOR(F.shiftleft(out[e - 1], 1).bitwiseAND(F.lit(full))))
        return out

    chars_a, chars_b = F.split(a, ""), F.split(b, "")
    start = closed([F.lit(1 << tau)] + [F.lit(1 << tau)] * tau)
    fields = ", ".join(f"e{e}:int" for e in range(tau + 1))

    def merge(state: Column, item: Column, other: Column) -> Column:
        i, x = item["i"], item["x"]
        match = None
        for d in range(width):
            bit = F.when(F.get(other, i + (d - tau)) == x, F.lit(1 << d)).otherwise(F.lit(0))
            match = bit if match is None else match.bitwiseOR(bit)
        # a match word is bound once; rows of both words then use it
        bound = F.transform(F.array(match), lambda m: F.struct(*[w.alias(f"e{e}") for e, w in enumerate(_advance(state, m, tau, full))]))
        return F.get(bound, F.lit(0)).cast(f"struct<{fields}>")

    first = F.struct(*[w.cast("int").alias(f"e{e}") for e, w in enumerate(start)]).cast(f"struct<{fields}>")
    items = F.transform(chars_a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    last = F.transform(F.array(chars_b), lambda other: F.aggregate(items, first, lambda s, it: merge(s, it, other)))
    end = F.char_length(b) - F.char_length(a) + tau
    return F.when(F.char_length(a) == 0, F.char_length(b) <= tau).otherwise((end >= 0) & (end < width) & (F.call_function("shiftright", F.get(last, F.lit(0))[f"e{tau}"], F.greatest(end, F.lit(0))).bitwiseAND(F.lit(1)) == 1))


def _advance(state: Column, match: Column, tau: int, full: int) -> list[Column]:
    out = []
    for e in range(tau + 1):
        word = state[f"e{e}"].bitwiseAND(match)
        if e:
            before = state[f"e{e - 1}"]
            word = word.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1))  # replaced, or missing from b
            word = word.bitwiseOR(F.shiftleft(out[e - 1], 1).bitwiseAND(F.lit(full)))  # b has one more
        out.append(word)
    return out


def lines_of(docs: DataFrame, row: str, text: str, min_chars: int) -> DataFrame:
    """(here, line, h1, h2) of the lines that take part: place (row and line number, which sorts), the line and the
    halves of its 128-bit hash."""
    at = docs.select(F.col(row).alias("row"), F.posexplode(F.split(F.col(text), "\n")).alias("place", "raw"))
    lines = at.select(F.struct("row", "place").alias("here"), F.btrim("raw", F.lit(_SPACE)).alias("line")).where(F.char_length("line") >= min_chars)
    return lines.select("here", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def once_if_frequent(lines: DataFrame, first: DataFrame) -> DataFrame:
    """``lines`` with each of the most frequent ones (at most ``FREQUENT``, a broadcast of fixed size) at its first place
    only, so that a line in a third of all rows makes no hot keys."""
    often = first.where("n >= 50").orderBy(F.desc("n"), "h1", "h2").limit(FREQUENT).select("h1", "h2", "at")
    return lines.join(F.broadcast(often), ["h1", "h2"], "left").where("at is null or at = here")


def only(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines with a wanted h1: by a broadcast of these up to ``FEW`` of them, beyond that by a shuffle."""
    few = wanted.limit(FEW + 1).count() <= FEW
    return lines.join(F.broadcast(wanted) if few else wanted, "h1", "left_semi")


def near_lines(lines: DataFrame, first: DataFrame, tau: int) -> DataFrame:
    """Ids (h1, h2) of the distinct lines that have a line within ``tau`` edits and an earlier first place, staged.

    ``lines``: here, h1, h2, line; ``first``: h1, h2, at (the first place, which sorts), n.  Keys carry h1 alone; text is
    shuffled for lines with live keys only."""
    # one exchange serves both sides; the aggregate also keeps filters from being pushed below it, which would part them
    rows, keys = keyed(once_if_frequent(lines, first), tau)
    rows = rows.repartition("key").groupBy("key", "h1").agg(F.max("own").alias("own"))
    alive = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("any")).where("n > 1 and any").select("key")
    live = staged(rows.join(alive.hint("shuffle_hash"), "key"), "line-live")
    wanted = staged(live.select("h1").distinct(), "line-wanted")
    text = only(lines, wanted).groupBy("h1", "h2").agg(F.first("line").alias("line")).join(first, ["h1", "h2"])
    text = staged(text.select(F.struct("h1", "h2").alias("id"), "line", "at", letters(F.col("line")).alias("letters")), "line-texts")
    met = live.join(text.select(F.col("id.h1").alias("h1"), "id", "letters"), "h1").select("key", "own", "id", "letters")
    a, b = met.alias("a"), met.where("own").alias("b")
    # two index entries probe each other: one of both directions is enough
    ok = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id")) & (~F.col("a.own") | (F.col("a.id") < F.col("b.id")))
    close = a.join(b, ok & may_be_close(F.col("a.letters"), F.col("b.letters"), tau))
    pairs = close.select(F.least("a.id", "b.id").alias("x"), F.greatest("a.id", "b.id").alias("y")).distinct()
    side = lambda v: text.select(F.col("id").alias(v), F.struct("at", "line").alias(f"of_{v}"))
    linked = pairs.join(side("x"), "x").join(side("y"), "y").where(within(F.col("of_x.line"), F.col("of_y.line"), tau))
    near = linked.select(F.when(F.col("of_x.at") < F.col("of_y.at"), F.col("y")).otherwise(F.col("x")).alias("id")).distinct()
    near = staged(near.select("id.h1", "id.h2"), "line-near")
    discard(keys, live, wanted, text)
    return near


def removed_lines(docs: DataFrame, row: str, text: str, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row of ``docs`` with removed lines, staged: row, exact and near (arrays of 0-based line numbers).  ``row`` sorts: the least is the earliest."""
    lines = lines_of(docs, row, text, min_chars)
    places = staged(lines.select("h1", "h2", "here"), "line-places")
    first = staged(places.groupBy("h1", "h2").agg(F.min("here").alias("at"), F.count("*").alias("n")), "line-firsts")
    near = near_lines(lines, first, tau)
    known = first.drop("n").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    # of a line that stays, the first place stays; of a near line no place does
    gone = places.join(known, ["h1", "h2"]).where("near or here != at")
    gone = gone.select(F.col("here.row").alias(row), F.col("here.place").alias("place"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = gone.groupBy(row).agg(F.collect_list(F.when(~F.col("near"), F.col("place"))).alias("exact"), F.collect_list(F.when(F.col("near"), F.col("place"))).alias("near"))
    gone = staged(gone, "line-removed")
    discard(places, first, near)
    return gone


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with duplicate lines cut out of the texts, and n_lines, n_exact, n_near (lines before, lines removed)."""
    columns = docs.columns
    plain = [f"_c{i}" for i in range(len(columns))]
    id_col, body = plain[columns.index(doc_id)], plain[columns.index(text)]
    # equal ids are told apart by their texts; rows with equal id and text are one document
    numbered = docs.toDF(*plain).withColumn("_row", F.struct(F.col(id_col).alias("id"), F.xxhash64(body).alias("hash")))
    gone = removed_lines(numbered, "_row", body, tau, min_chars)
    joined = numbered.join(gone, "_row", "left")
    lines = F.split(F.col(body), "\n")
    places = F.concat("exact", "near")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(places, i)), "\n")
    out = joined.select(*plain, F.when(F.col("exact").isNull(), F.col(body)).otherwise(left).alias("_left"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("_n"), *[F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(f"_{c}") for c in ("exact", "near")])
    return out.select(*["_left" if c == body else c for c in plain], "_n", "_exact", "_near").toDF(*columns, "n_lines", "n_exact", "n_near")


def drop_emptied(deduped: DataFrame, text: str = "text") -> DataFrame:
    """Without the documents of which lines were removed and no word is left."""
    return deduped.where((F.col("n_exact") + F.col("n_near") == 0) | (F.btrim(F.col(text), F.lit(_SPACE)) != ""))
