"""The values that the operators define for odd rows: nulls, empty and long texts, repeated rows, missing ids, names
that clash with their own columns."""

import collections

from pyspark.sql import functions as F
from test_operators import LONG, MODEL, ODD, odd

from tranchery.llm import decontaminate, jaccard_join, language_id, lattice_score, license_scan, line_dedup, secret_scan, segment_sampling, simhash, token_cache, weak_quality
from tranchery.llm.shared import fresh_path

SAME = ODD[3][1]
EMPTY = (1, 2, 7)  # null, empty and white space only


def values(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_jaccard_values(spark):
    got = values(jaccard_join.classes(odd(spark)), "doc_id", "n_shingles", "component_id")
    assert got[(4, 5, 4)] == 2 and got[(None, 1, None)] == 1 and got[(3, 12, 3)] == 1 and got[(8, 2, 8)] == 1
    assert all(got[(i, 0, i)] == 1 for i in EMPTY) and sum(got.values()) == len(ODD)


def test_kept_rows(spark):
    got = values(jaccard_join.keep_one(odd(spark)), "doc_id", "text")
    assert got == collections.Counter({(i, t): 1 for i, t, *_ in ODD})  # of the repeated row one stays


def test_line_values(spark):
    got = values(line_dedup.dedup(odd(spark)), "doc_id", "text", "n_lines", "n_exact", "n_near")
    assert got[(1, None, 0, 0, 0)] == 1 and got[(2, "", 1, 0, 0)] == 1 and got[(3, LONG, 1, 0, 0)] == 1
    assert got[(4, SAME, 1, 0, 0)] == 2  # rows of equal id and text are one document
    assert got[(None, "no id but words", 1, 0, 0)] == 1 and got[(8, ODD[7][1], 1, 0, 0)] == 1


def test_token_values(spark):
    got = values(token_cache.token_counts(odd(spark), fresh_path(spark, "cache")), "doc_id", "n_bytes", "n_tokens")
    assert got[(1, 0, 0)] == got[(2, 0, 0)] == 1 and sum(got.values()) == len(ODD)
    byte = {i: b for i, b, _ in got}
    assert byte[8] == len(ODD[7][1].encode()) and byte[3] == len(LONG) and byte[None] == 15


def test_language_values(spark):
    docs = odd(spark)
    got = values(language_id.predict(docs, language_id.fit(docs)), "doc_id", "lang_pred")
    assert all(got[(i, "und")] == 1 for i in EMPTY) and got[(3, "en")] == 1 and got[(8, "fr")] == 1
    assert values(language_id.predict(docs, None), "lang_pred") == {("und",): len(ODD)}


def test_licence_values(spark):
    got = {(r["doc_id"], r["n_sentences"]) for r in license_scan.scan(odd(spark)).collect()}
    assert got == {(1, 0), (2, 0), (3, 400), (4, 1), (None, 1), (7, 0), (8, 1)}


def test_quality_values(spark):
    got = values(weak_quality.score(odd(spark)), "doc_id", "n_words", "n_symbols", "n_dup_lines")
    assert all(got[(i, 0, 0, 0)] == 1 for i in EMPTY) and got[(4, 9, 0, 0)] == 2 and got[(3, 4800, 0, 0)] == 1 and got[(None, 4, 0, 0)] == 1


def test_secret_values(spark):
    got = secret_scan.scan(odd(spark, [*ODD, (9, "token=abcdefgh1\ntoken=abcdefgh1", None, None), (9, "token=abcdefgh1", None, None)])).collect()
    assert collections.Counter((r["doc_id"], len(r["base"])) for r in got if r["base"]) == {(9, 2): 1, (9, 1): 1} and len(got) == len(ODD) + 2


def test_contamination_values(spark):
    items = spark.createDataFrame([("b", SAME), ("a", SAME.upper()), ("c", None), ("d", ""), (None, SAME)], "item_id string, text string")
    got = {(r["doc_id"], r["n_words"], len(r["runs"]), tuple(r["items"])) for r in decontaminate.contamination(odd(spark), items).collect()}
    assert (4, 9, 1, ("a", "b")) in got and (1, 0, 0, ()) in got and (2, 0, 0, ()) in got and (3, 4800, 0, ()) in got
    left = values(decontaminate.remove_contamination(odd(spark), items), "doc_id")
    assert left == {(i,): 1 for i in (1, 2, 3, None, 7, 8)}  # all of 4 is a benchmark item


def test_simhash_values(spark):
    got = values(simhash.classes(odd(spark)), "doc_id", "fingerprint", "component_id")
    assert all(got[(i, "0" * 16, 1)] == 1 for i in EMPTY) and sum(n for x, n in got.items() if x[0] == 4) == 2


def test_score_values(spark):
    docs = odd(spark)
    got = {r["doc_id"]: r for r in lattice_score.score(docs, F.col("doc_id") > 1, MODEL, keep=["doc_id"], hot=5).collect()}
    assert all(got[i]["n_tokens"] == 1 for i in EMPTY) and len({got[i]["score"] for i in EMPTY}) == 1  # the end alone
    assert got[4]["n_tokens"] == 10 and got[4]["score"] < got[2]["score"] < 0


def test_sampled_values(spark):
    got = segment_sampling.sample_segmentations(odd(spark), MODEL, k=2).collect()
    of = collections.Counter(r["doc_id"] for r in got)
    assert of[4] == 4 and of[None] == 2 and of[8] == 2 and {r["doc_id"] for r in got if not r["round_trip"]} <= {1}  # a null text has nothing to come back to
    assert all(of[i] <= 1 for i in (1, 2))
