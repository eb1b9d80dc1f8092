"""The pipeline, stage by stage against brute-force versions, and as a whole."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import MODEL, brute_components, brute_contamination, distance, words

from tranchery.llm import lattice, segment_sampling

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SPACE = " \t\n\x0b\f\r"


def corpus():
    r = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    item = line(14)
    texts = ["\n".join(line(r.randint(8, 16)) for _ in range(r.randint(2, 6))) for _ in range(24)]
    texts += [t.replace(" ", "  ", 1) for t in texts[:4]]  # an edit in the first line
    long = [line(90) for _ in range(4)]
    texts += long + [t.rsplit(" ", 1)[0] for t in long]  # near copies of one line
    texts += [f"{line(30)} {item} {line(20)}", item, "123 !!", "", None, texts[0], "short\nshort"]
    rows = [(i, t, "en" if i % 3 else "de", "web", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (None, line(40), None, None, None), (5, line(12), None, "clash", 0)], [("q1", item), ("q2", None), ("q3", "no such words here")]


def brute_lines(rows):
    """Texts without equal and near lines, of rows (id, text); the earliest place stays."""
    ids = lambda i: (i is not None, i or 0)
    places = [(ids(i), t, p, x.strip(SPACE)) for i, t in rows if t is not None for p, x in enumerate(t.split("\n")) if len(x.strip(SPACE)) >= 20]
    assert len({(i, p) for i, _, p, _ in places if i != (True, 5)}) == sum(i != (True, 5) for i, *_ in places)
    first = {}
    for i, t, p, x in places:
        first[x] = min(first.get(x, (i, p)), (i, p))
    near = {a for a in first for b in first if first[b] < first[a] and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    out = []
    for i, t in rows:
        keep = [x for p, x in enumerate((t or "").split("\n")) if len(y := x.strip(SPACE)) < 20 or (y not in near and first[y] == (ids(i), p))]
        out.append((i, None if t is None else "\n".join(keep)))
    return out


def test_pipeline(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.collect()]
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "segmentations":
            assert now.columns == COLUMNS
        seen[name] = before, [tuple(r) for r in now.collect()]
    key = lambda rows: sorted(map(repr, rows))
    before, after = seen["language_id"]
    assert key(after) == key(r for r in before if any(map(str.isalpha, r[1] or "")))

    before, after = seen["line_dedup"]
    want = [(i, t) for (i, t), old in zip(brute_lines([r[:2] for r in before]), before, strict=True) if t == old[1] or words(t)]
    assert key((r[0], r[1]) for r in after) == key(want)
    assert all(r[4] == len(r[1]) for r in after) and len(after) < len(before)

    before, after = seen["near_duplicates"]
    label = brute_components([(k, r[1]) for k, r in enumerate(before)])
    kept = [before.index(r) for r in after]
    assert len({label[k][1] for k in kept}) == len(kept) == len({c for _, c in label.values()}) < len(before)

    before, after = seen["decontamination"]
    hit = brute_contamination([(k, r[1]) for k, r in enumerate(before)], items)
    clean = [r for k, r in enumerate(before) if not hit[k][1]]
    assert {repr(r) for r in clean} <= {repr(r) for r in after} and len(clean) < len(before)
    again = brute_contamination([(k, r[1]) for k, r in enumerate(after)], items)
    assert not any(x[1] for x in again.values())

    before, after = seen["segmentations"]
    vocab = lattice.vocabulary(MODEL)
    rows = spark.read.parquet(f"{tmp_path}/segmentations").collect()
    texts = {}
    for r in before:
        texts.setdefault(r[0], set()).add(r[1])
    assert all(segment_sampling.decode(vocab, r["ids"]) in texts[r["doc_id"]] and r["round_trip"] for r in rows)
    assert {r["doc_id"] for r in rows} == set(texts)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert key(map(tuple, whole.select(*now.columns).collect())) == key(map(tuple, rows))


def test_pipeline_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.by_language(spark, docs, "").collect()] == [1]
    assert corpus_pipeline.by_language(spark, docs.where(F.lit(False)), "").count() == 0
