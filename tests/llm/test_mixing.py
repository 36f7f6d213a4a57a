from __future__ import annotations

import random

import pytest

from strata.llm import mixing


def level(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Targets by handing the excess on, source after source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        share = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] >= most * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def make(spark, n=3000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["a", "b", "c", "é", "zz", None])
        rows.append((i, " ".join(["w"] * rng.randrange(0, 80)) if i % 50 else None, source, i % 7))
    rows += rows[:40] + [(None, "one two", "a", 1), (5, "other text", "b", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(6)


@pytest.mark.parametrize("group,fan", [(512, 64), (40, 3)])
def test_mix(spark, monkeypatch, group, fan):
    monkeypatch.setattr(mixing, "GROUP", group)
    monkeypatch.setattr(mixing, "FAN_IN", fan)
    rows, df = make(spark)
    out = mixing.copies(df).collect()
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = level(sizes)
    assert sum(r["n_rows"] for r in out) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["total"] <= 3 * r["n_rows"] and (r["size"] or not r["total"])
        expected = r["n_rows"] * r["target"] / r["source_size"] if r["size"] else 0
        assert abs(r["total"] - expected) < 1 + 1e-6
        taken[r["source"]] += r["total"] * r["size"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 80
    again = mixing.copies(df.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_mixed_rows(spark):
    rows, df = make(spark, 400)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    plan: dict = {}
    for r in mixing.copies(df).collect():
        plan[r["doc_id"], r["source"], r["size"]] = plan.get((r["doc_id"], r["source"], r["size"]), 0) + r["total"]
    got: dict = {}
    for r in out.collect():
        k = (r["doc_id"], r["source"], len((r["text"] or "").split()))
        got[k] = got.get(k, 0) + 1
    assert got == {k: v for k, v in plan.items() if v}


def test_query_rows(spark, tiny):
    rows = mixing.query(spark, tiny).collect()
    assert len(rows) == 200 and all(r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"] for r in rows)
    by: dict = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert sum(sum(v) for v in by.values()) == pytest.approx(sum(r["size"] for r in rows), rel=0.15)


def test_small_and_empty(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.copies(spark.createDataFrame([], schema)).collect() == []
    assert mixing.mixed(spark.createDataFrame([], schema)).collect() == []
    nothing = mixing.copies(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema)).collect()
    assert [r["total"] for r in nothing] == [0, 0]


def test_trades_keep_the_words():
    rng = random.Random(4)
    rows = [{"size": rng.randrange(1, 90), "part": rng.random(), "up": None, "k": i} for i in range(200)]
    before = sum(r["size"] * r["part"] for r in rows)
    done, held = mixing._trade(rows, "seed")
    after = sum(r["size"] for r in done if r["up"]) + (held["size"] * held["part"] if held else 0)
    assert after == pytest.approx(before) and len(done) >= 199


def test_every_chance_is_kept():
    """Over many seeds a row is taken as often as its part says."""
    hits = [0] * 4
    parts, sizes = [0.2, 0.5, 0.7, 0.6], [3, 10, 4, 3]
    n = 6000
    for seed in range(n):
        rows = [{"size": s, "part": p, "up": None, "k": i} for i, (s, p) in enumerate(zip(sizes, parts, strict=True))]
        done, held = mixing._trade(rows, str(seed))
        for r in done:
            hits[r["k"]] += r["up"]
        if held:
            hits[held["k"]] += held["part"]
    assert [h / n for h in hits] == pytest.approx(parts, abs=0.03)


def test_a_row_that_repeats_very_often(spark):
    """It is dealt out in parts, and each copy keeps the columns, whatever their names."""
    from pyspark.sql import functions as F

    one = spark.range(9_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.lit("a").alias("source"), F.lit(1).alias("_first"), F.lit(2).alias("_r1"), F.lit(3).alias("_total"))
    rest = spark.range(100, 110).select("id", F.lit("a " * 300).alias("text"), F.lit("b").alias("source"), F.lit(4).alias("_first"), F.lit(5).alias("_r1"), F.lit(6).alias("_total")).withColumnRenamed("id", "doc_id")
    docs = one.unionByName(rest)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    n = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    taken = {r["doc_id"]: r["total"] for r in mixing.copies(docs).collect()}
    assert n == {k: v for k, v in taken.items() if v}
    assert {tuple(r) for r in out.filter("doc_id = 7").select("_first", "_r1", "_total").distinct().collect()} == {(1, 2, 3)}


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 500_000, "a"), (2, "w", "a"), (3, "v " * 10, "b")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.copies(docs).collect()}
    assert got[1]["size"] == 500_000 and got[1]["source_size"] == 500_001
