"""Licence scans by sentence rules.

Known licence sentences are found as runs of words (ASCII-lower-case, anything but ASCII letters and digits parts words)
that start and end at a line end, at . ! ? ; : before white space, behind a list mark or at the text's ends.  Wrapped
lines are joined: a known sentence may run over line ends, comment marks, ':' and ';', but not over a blank line (one
without letters and digits) or over . ! ? before white space.  The rest of the text falls into sentences at blank lines
and at . ! ? ; : before white space.  The identifiers found, in order of position, are matched against licence rules: a
rule is an ordered list of identifiers which must occur one after the other with at most ``max_gap`` unknown sentences
in between.  Where the sentences of one match lie among those of another, whose rule holds all identifiers of the first
one's and more, the longer rule stands alone.

Both tables are DataFrames (``sentence_table``, ``rule_table`` are the given ones); they are read whole, up to a bound
that is checked, and broadcast.  Documents are neither shuffled nor exploded.

Defined cases: a null or empty text has no sentences and no licence; texts are read whole, however long; repeated
matches count each; rules that overlap otherwise are reported beside each other, ordered by place and then by name; of
known sentences that overlap, as where one is the beginning of the other, each is found, and they are one sentence in
the count; repeated rows and ids give a row each; an empty table gives an empty one; columns other than the id and the
text are not read, so they may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tranchery.llm.shared import in_batches
from tranchery.llm.text import pieces_of

# Sentences of public licences and licence notices, normalised, by identifier.
_FREE = "this {} is free software you can redistribute it and or modify it under the terms of the gnu {}general public license"
_LATER = " as published by the free software foundation either version {} of the license or at your option any later version"
_USEFUL = "this {} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
SENTENCES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "apache-2.0-notice-the-license": "licensed under the apache license version 2 0 the license",
    "apache-2.0-compliance": "you may not use this file except in compliance with the license",
    "apache-2.0-copy": "you may obtain a copy of the license at",
    "apache-2.0-title": "apache license version 2 0 january 2004",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-include": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free-software": _FREE.format("program", "") + _LATER.format("3"),
    "gpl-useful": _USEFUL.format("program"),
    "gpl-3.0-title": "gnu general public license version 3 29 june 2007",
    "gpl-2.0-free-software": _FREE.format("program", "") + _LATER.format("2"),
    "gpl-2.0-only-free-software": _FREE.format("program", "") + " version 2 as published by the free software foundation",
    "gpl-2.0-title": "gnu general public license version 2 june 1991",
    "lgpl-2.1-free-software": _FREE.format("library", "lesser ") + _LATER.format("2 1"),
    "lgpl-3.0-free-software": _FREE.format("library", "lesser ") + _LATER.format("3"),
    "lgpl-useful": _USEFUL.format("library"),
    "lgpl-2.1-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl-3.0-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl-3.0-free-software": _FREE.format("program", "affero ") + _LATER.format("3"),
    "agpl-3.0-title": "gnu affero general public license version 3 19 november 2007",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-2.0-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-2.0-copy-https": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-2.0-title": "mozilla public license version 2 0",
    "epl-2.0-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0-dedicated": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0-warranty": "this software is distributed without any warranty",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl-1.0-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "cc-by-nc-4.0-notice": "licensed under cc by nc 4 0",
    "cc-by-4.0-notice": "licensed under cc by 4 0",
    "cc-by-sa-4.0-notice": "licensed under cc by sa 4 0",
    "cc-by-4.0-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4.0-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4.0-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}
# Ordered rules by licence.
RULES = [
    ("Apache-2.0", ["apache-2.0-notice"]),
    ("Apache-2.0", ["apache-2.0-notice-the-license", "apache-2.0-compliance", "apache-2.0-copy"]),
    ("Apache-2.0", ["apache-2.0-title"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-include", "mit-as-is"]),
    ("GPL-3.0", ["gpl-3.0-notice"]),
    ("GPL-3.0", ["gpl-3.0-title"]),
    ("GPL-3.0-or-later", ["gpl-free-software", "gpl-useful"]),
    ("GPL-2.0", ["gpl-2.0-title"]),
    ("GPL-2.0-only", ["gpl-2.0-only-free-software", "gpl-useful"]),
    ("GPL-2.0-or-later", ["gpl-2.0-free-software", "gpl-useful"]),
    ("LGPL-2.1", ["lgpl-2.1-title"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-free-software", "lgpl-useful"]),
    ("LGPL-3.0", ["lgpl-3.0-title"]),
    ("LGPL-3.0-or-later", ["lgpl-3.0-free-software", "lgpl-useful"]),
    ("AGPL-3.0", ["agpl-3.0-title"]),
    ("AGPL-3.0-or-later", ["agpl-3.0-free-software", "gpl-useful"]),
    ("MPL-2.0", ["mpl-2.0-notice", "mpl-2.0-copy"]),
    ("MPL-2.0", ["mpl-2.0-notice", "mpl-2.0-copy-https"]),
    ("MPL-2.0", ["mpl-2.0-title"]),
    ("EPL-2.0", ["epl-2.0-notice"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("0BSD", ["0bsd-grant", "isc-as-is"]),
    ("Unlicense", ["unlicense-domain", "unlicense-anyone"]),
    ("CC0-1.0", ["cc0-dedicated", "cc0-warranty"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant"]),
    ("BSL-1.0", ["bsl-1.0-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-work"]),
    ("CC-BY-4.0", ["cc-by-4.0-notice"]),
    ("CC-BY-4.0", ["cc-by-4.0-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-work"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
]
# a licence's short identifier, as files carry it in their first lines, is a sentence and a rule of its own
for _name in sorted({licence for licence, _ in RULES}):
    SENTENCES[f"spdx-{_name.lower()}"] = "spdx license identifier " + " ".join(re.findall("[a-z0-9]+", _name.lower()))
    RULES.append((_name, [f"spdx-{_name.lower()}"]))
#: Sentences and rules that may be broadcast
MOST_KNOWN = 100_000
MAX_GAP = 2
#: A known sentence starts and ends at a line feed, or at . ! ? ; : before white space or the end.
_BREAK = re.compile(r"\n|[.!?;:](?=[\x20\x09-\x0D]|\Z)")
#: It does not run over a blank line or over . ! ? before white space.
_HARD = re.compile(r"\n[^\w\n]*\n|[.!?](?=[\x20\x09-\x0D]|\Z)")
#: Other sentences end there, and at ; : before white space.
_END = re.compile(r"\n[^\w\n]*\n|[.!?;:](?=[\x20\x09-\x0D]|\Z)")
_INSIDE = re.compile(r"\w")
_WORD = re.compile(r"[A-Za-z0-9]+")
_NO_WORD = re.compile(r"[^A-Za-z0-9]*")
#: Comment marks made of letters, which wrapped lines may begin with.
_COMMENT = {"dnl", "rem"}
#: What may stand in a line before a known sentence: comment marks and one list mark, as 1. (a) iii)
_MARKS = re.compile(r"[^A-Za-z0-9]*(?:(?:dnl|rem)[^A-Za-z0-9]+)?(?:[0-9A-Za-z]{1,4}[.)\]][^A-Za-z0-9]*)?", re.I | re.A)
_MARKS_LONG = 80
_LOWER = {c: c + 32 for c in range(65, 91)}


def n_sentences(text: str) -> int:
    """Sentences that have a letter or digit, of any script."""
    return sum(1 for x in _END.split(text) if _INSIDE.search(x))


class Known:
    """The known sentences (normalised text to identifier) as a tree of words, and a pattern of their first two words."""

    def __init__(self, by_text: dict[str, str]):
        self.tree: dict = {}
        for text, name in by_text.items():
            node = self.tree
            for word in text.split():
                node = node.setdefault(word, {})
            node[None] = name
        gap = rf"[^a-z0-9]+(?:(?:{'|'.join(sorted(_COMMENT))})[^a-z0-9]+)?"
        heads = sorted({tuple(x.split()[:2]) for x in by_text})
        some = "|".join(f"{w[0][0]}(?={gap.join([w[0][1:], *w[1:]])}(?![a-z0-9]))" for w in heads)
        self.heads = re.compile(f"(?<![a-z0-9])(?:{some})", re.I | re.A)

    def at(self, body: str, place: int) -> list[tuple[int, str]]:
        """(end, identifier) of the known sentences whose words begin at a place and which end at a break."""
        out, node, last = [], self.tree, None
        while True:
            gap = body[last : _NO_WORD.match(body, last).end() + 1] if last is not None else ""
            name = node.get(None) if last is not None else None
            if name is not None:
                m = _BREAK.search(gap)
                if m:
                    out.append((last + m.start(), name))
                elif _NO_WORD.fullmatch(gap):
                    out.append((len(body), name))
            if _HARD.search(gap):
                return out
            m = _WORD.search(body, place if last is None else last)
            word = m and m[0].translate(_LOWER)
            if word in _COMMENT and word not in node and "\n" in gap:
                m = _WORD.search(body, m.end())
                word = m and m[0].translate(_LOWER)
            node = node.get(word) if word else None
            if node is None:
                return out
            last = m.end()

    def find(self, body: str) -> list[tuple[int, int, str]]:
        """(start, end, identifier), sorted."""
        out = []
        for m in self.heads.finditer(body):
            begin = before = m.start()
            while before and not (body[before - 1].isascii() and body[before - 1].isalnum()):
                before -= 1
            breaks = [before + x.end() for x in _BREAK.finditer(body[before : begin + 1])]
            if breaks or not before:
                start = breaks[-1] if breaks else 0
            else:
                line = body.rfind("\n", 0, begin) + 1
                if begin - line > _MARKS_LONG or not _MARKS.fullmatch(body, line, begin):
                    continue
                start = begin
            out += [(start, end, name) for end, name in self.at(body, begin)]
        return sorted(out)


def numbered(body: str, found: list[tuple[int, int, str]]) -> tuple[int, list[int]]:
    """The number of sentences, and which sentence each known one is; ``found`` is sorted."""
    n, at, out = 0, 0, []
    for start, end, _ in found:
        if not out or start >= at:
            n += n_sentences(body[at:start]) + 1
        at = max(at, end)
        out.append(n - 1)
    return n + n_sentences(body[at:]), out


def match_rules(found: list[tuple[int, str]], rules, max_gap: int) -> list[tuple[str, int, int]]:
    """(licence, first, last) indexes into ``found`` (sentence number, identifier); from each start the nearest next
    identifier is taken.  A match among the sentences of one whose rule holds its own is left out."""
    places: dict[str, list[int]] = {}
    for k, (_, name) in enumerate(found):
        places.setdefault(name, []).append(k)
    out = []
    for licence, wanted in rules:
        for first in places.get(wanted[0], ()):
            taken = [first]
            for name in wanted[1:]:
                later = places.get(name, [])
                i = bisect_left(later, taken[-1] + 1)
                while i < len(later) and found[later[i]][0] == found[taken[-1]][0]:
                    i += 1
                if i == len(later) or found[later[i]][0] - found[taken[-1]][0] - 1 > max_gap:
                    break
                taken.append(later[i])
            else:
                out.append((licence, taken))
    by_place: dict[int, list[set[int]]] = {}
    for _, taken in out:
        for k in taken:
            by_place.setdefault(k, []).append(set(taken))
    alone = [(x, taken[0], taken[-1]) for x, taken in out if not any(len(o) > len(taken) and o.issuperset(taken) for o in by_place[taken[0]])]
    return sorted(alone, key=lambda x: (x[1], x[2], x[0]))


def sentence_table(spark: SparkSession) -> DataFrame:
    """The given known sentences: sentence_id, text."""
    return spark.createDataFrame(list(SENTENCES.items()), "sentence_id string, text string")


def rule_table(spark: SparkSession) -> DataFrame:
    """The given rules: licence, sentence_ids in order."""
    return spark.createDataFrame(RULES, "licence string, sentence_ids array<string>")


def _bounded(df: DataFrame, what: str) -> list:
    rows = df.limit(MOST_KNOWN + 1).collect()
    if len(rows) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} {what}")
    return rows


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: DataFrame | None = None, rules: DataFrame | None = None, max_gap: int = MAX_GAP) -> DataFrame:
    """Per document: id, n_sentences, found (identifier, sentence number, start, end) and matches (licence, start, end).

    ``sentences`` (sentence_id, text) and ``rules`` (licence, sentence_ids) default to the given tables; at most
    MOST_KNOWN of each.  Texts of sentences are normalised here; of equal ones the least identifier counts."""
    spark = docs.sparkSession
    known = _bounded((sentence_table(spark) if sentences is None else sentences).select("sentence_id", "text"), "known sentences")
    by_text = {}
    for name, body in sorted((r["sentence_id"], r["text"]) for r in known if r["sentence_id"] is not None and r["text"]):
        words = " ".join(w.translate(_LOWER) for w in _WORD.findall(body))
        if words:
            by_text.setdefault(words, name)
    order = [(r["licence"], list(r["sentence_ids"])) for r in _bounded((rule_table(spark) if rules is None else rules).select("licence", "sentence_ids"), "rules") if r["sentence_ids"]]
    shared = spark.sparkContext.broadcast((by_text, order))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        table, wanted = shared.value
        sought = Known(table)
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                counts, every, matched = [], [], []
                for body in batch.column("text").to_pylist():
                    spans = sought.find(body) if body else []
                    n, place = numbered(body or "", spans)
                    found = [(k, name, start, end) for k, (start, end, name) in zip(place, spans, strict=True)]
                    counts.append(n)
                    every.append([{"sentence_id": x[1], "sentence": x[0], "start": x[2], "end": x[3]} for x in found])
                    matched.append([{"licence": x, "start": found[a][2], "end": found[b][3]} for x, a, b in match_rules([y[:2] for y in found], wanted, max_gap)] if found else [])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(every, _FOUND), pa.array(matched, _MATCH)], ["doc_id", "n_sentences", "found", "matches"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return in_batches(given).mapInArrow(run, f"doc_id {id_type}, n_sentences long, found array<struct<sentence_id:string,sentence:int,start:int,end:int>>, matches array<struct<licence:string,start:int,end:int>>").withColumnRenamed("doc_id", doc_id)


_FOUND = pa.list_(pa.struct([("sentence_id", pa.string()), ("sentence", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_MATCH = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
