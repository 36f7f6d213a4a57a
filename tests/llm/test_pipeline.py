from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import langid, packing, simhash
from strata.llm.tokens import encoder, vocabulary_path
from strata.spark import read_table


def test_stages(spark, tiny):
    docs = read_table(spark, tiny, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = dict(corpus_pipeline.STAGES)

    accepted = stages["language"](spark, docs, tiny).cache()
    assert accepted.columns == docs.columns
    model = langid.learned(docs)
    expected = set()
    for r in docs.collect():
        (name,), (score,) = model.predict([(r["text"] or "").encode()])
        if name != langid.UNKNOWN and score >= model.threshold:
            expected.add(r["doc_id"])
    assert {r["doc_id"] for r in accepted.collect()} == expected and len(expected) > 190

    lined = stages["lines"](spark, accepted, tiny).cache()
    assert lined.columns == docs.columns and lined.count() == accepted.count()
    seen, texts = set(), {}
    for r in sorted(accepted.collect(), key=lambda r: r["doc_id"]):
        lines, gone = r["text"].split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not re.search(r"[^\x20\x09-\x0D]", "".join(w)):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        texts[r["doc_id"]] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in lined.collect())

    single = stages["near_duplicates"](spark, lined, tiny).cache()
    prints = {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(prints)
    for k, i in enumerate(order):
        for j in order[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert {r["doc_id"] for r in single.collect()} == {i for i in prints if root(i) == i}
    assert single.columns == docs.columns

    mixed = stages["mix"](spark, single, tiny).cache()
    words = sum(len(r["text"].split()) for r in single.collect())
    assert mixed.columns == docs.columns
    assert abs(sum(len(r["text"].split()) for r in mixed.collect()) - words) <= 0.2 * words

    pieces = stages["sequences"](spark, mixed, tiny).collect()
    enc = encoder(vocabulary_path())
    assert sum(r["length"] for r in pieces) == sum(len(enc.ids([r["text"].encode()])[0]) // 4 + 1 for r in mixed.collect())
    held: dict = {}
    for r in pieces:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in held.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= packing.CAPACITY


def test_run_agrees_with_itself(spark, tiny):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, tiny).drop("sequence_id", "offset").collect())) for _ in range(2))
    assert a == b and a


def test_odd_rows(spark, tiny):
    """Nulls, repeated rows and equal ids pass through all stages."""
    docs = read_table(spark, tiny, "documents").limit(60)
    odd = [(None, "some words of a document without id", "en", None, None), (7, None, None, None, None), (8, "", "en", "src1", 0), (9, "123 456", "en", "src1", 7), (1, "another text with the same id as one", "en", "src2", 5)] * 2
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, tiny).cache()
        assert rows.count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, tiny)
        assert empty.columns == docs.columns and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, tiny).count() == 0


def test_columns_of_any_name(spark, tiny):
    """Also names that the stages use themselves."""
    names = ["_r1", "_r2", "_starts", "_lines", "_kept", "_lang_pred", "_lang_score", "_total", "_copy", "_first", "odd.name"]
    docs = read_table(spark, tiny, "documents").limit(40).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny).cache()
        assert docs.count() > 30
        assert docs.columns[-len(names) :] == names
        assert all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in docs.collect())
