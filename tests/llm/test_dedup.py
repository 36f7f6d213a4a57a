from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from strata.llm import embeddings, linededup, simhash
from strata.llm.components import components


def union(n: int, links) -> list[int]:
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# --- components -----------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 90)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(7, 7), (3, 2)]
    roots = union(400, edges)
    df = spark.createDataFrame(edges, "x long, y long").repartition(6)
    found = {r["node"]: r["root"] for r in components(df).collect()}
    assert found == {i: r for i, r in enumerate(roots) if r != i}
    assert components(df.limit(0)).collect() == []


# --- lines ------------------------------------------------------------------------


def brute_lines(rows):
    """(id, n_lines, n_removed, text), rows in (id, row) order decided by id."""
    seen, out = set(), []
    for i, text in rows:
        if text is None:
            out.append((i, 0, 0, None))
            continue
        lines, gone = text.split("\n"), set()
        own = []
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not "".join(w).strip(" \t\n\r\x0b\x0c"):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            own.append(w)
            seen.add(w)
        out.append((i, len(lines), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    return sorted(out, key=repr)


def test_lines(spark):
    rng = random.Random(6)
    block = [f"common {k}" for k in range(9)]
    rows = [(None, "\n".join(block[:4])), (1, None), (2, ""), (3, "one\ntwo"), (4, "\n\n\n\n  \n\n\n"), (5, "a\nb\nc\na\nb\nc\na\nb\nc"), (6, "\n".join(block))]
    rows += [(10 + i, "\n".join([f"own {i}", *block[rng.randrange(4) :], f"end {i}", *rng.choices(["x", "y", "é"], k=8)])) for i in range(25)]
    rows += [(50, "l\n" * 3000), (51, "\n".join(block) + "\n")]
    schema = "doc_id long, text string, n_lines string, pos int, `odd.name` int"
    df = spark.createDataFrame([(i, t, "own", 1, None) for i, t in rows], schema).repartition(4)
    out = linededup.dedup(df, n_lines="lines_", n_removed="removed_")
    assert out.columns[:5] == df.columns
    found = sorted((tuple(r) for r in out.select("doc_id", "lines_", "removed_", "text").collect()), key=repr)
    assert found == brute_lines(rows)
    assert linededup.dedup(df).columns == df.columns and linededup.dedup(df.limit(0)).collect() == []


def test_repeated_rows_stand_for_each_other(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd")] * 2 + [(2, "a\nb\nc\ne")], "doc_id long, text string")
    assert sorted(tuple(r) for r in linededup.dedup(df).collect()) == [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, "e")]


def test_lines_run_no_python(spark):
    plan = linededup.dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- SimHash ------------------------------------------------------------------------


def slow_fingerprint(text: str) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgÉ") for _ in range(5))
    base = [word() for _ in range(400)]
    texts = [" ".join(word() for _ in range(rng.randrange(1, 50))) for _ in range(40)]
    for i in range(60):
        near = list(base)
        near[rng.randrange(400)] = word()
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 9 + [" ".join(base).upper(), None, "", " \n", "one", "One", "one two", " "]
    ids = [None if i == 5 else i for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, root string, fp int").repartition(5)
    prints = [slow_fingerprint(t or "") for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = union(len(texts), links)
    first = {r: min((ids[i] for i in range(len(ids)) if roots[i] == r and ids[i] is not None), default=None) for r in roots}
    expected = sorted(((i, p, first[r]) for i, p, r in zip(ids, prints, roots, strict=True)), key=repr)
    got = simhash.groups(simhash.fingerprints(df)).collect()
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=repr) == expected
    assert len(links) > 200 and simhash.groups(simhash.fingerprints(df.limit(0))).collect() == []


def test_dense_and_spread_fingerprints(spark, monkeypatch):
    """More members in a shard than a block holds, and every cut of the bits."""
    from strata.llm import blocks

    rng = random.Random(7)
    codes = {0, (1 << 64) - 1}
    for _ in range(30):
        c = rng.getrandbits(64)
        codes |= {c ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(30)} | {c ^ 7 << 20, c ^ 15 << 30}
    codes = sorted(codes)
    links = [(i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 3]
    roots = union(len(codes), links)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    monkeypatch.setattr(simhash, "paired", lambda rows, keys, member: blocks.paired(rows, keys, member, 8))
    for cut in (4, 5, 6):
        monkeypatch.setattr(simhash, "CUTS", ((cut, None),))
        found = {r["doc_id"]: r["component_id"] for r in simhash.groups(df).collect()}
        assert found == dict(enumerate(roots))


def test_bk_tree():
    rng = random.Random(3)
    codes = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for c in codes:
        tree.add(c)
    for q in codes[:60]:
        assert sorted(tree.within(q, 2)) == [i for i, c in enumerate(codes) if (c ^ q).bit_count() <= 2]
    assert simhash.BKTree().within(1, 3) == []


# --- embeddings -----------------------------------------------------------------------


def vectors():
    rng = np.random.default_rng(2)
    rows = [rng.normal(size=64) for _ in range(300)]
    for c in range(12):
        center = rng.normal(size=64)
        for k in range(2, 14 + 6 * c):
            noise = rng.normal(size=64)
            rows.append(center + noise * rng.uniform(0.1, 0.38))
    rows += [rows[5]] * 4 + [rows[6] * 3.0, -rows[7]]
    labels = [i % 3 for i in range(300)] + [1] * (len(rows) - 300)
    return [v.astype(np.float32) for v in rows], labels


@pytest.mark.parametrize("block,dense", [(512, 8), (16, 8), (16, 0), (512, 0), (512, 10**6)])
def test_embeddings(spark, monkeypatch, block, dense):
    from strata.llm import blocks

    monkeypatch.setattr(embeddings, "dealt", lambda rows, keys, member: blocks.dealt(rows, keys, member, block))
    rows, labels = vectors()
    x = np.stack(rows).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = (x @ x.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(linked, False)
    roots = union(len(rows), np.argwhere(linked).tolist())
    data = [(i, v.tolist(), k, 1) for i, (v, k) in enumerate(zip(rows, labels, strict=True))]
    n = len(data)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 64, [nan] + [1.0] * 63, [inf] + [1.0] * 63, [None] + [1.0] * 63, rows[0].tolist()]
    data += [(n + i, v, None if i == 6 else 1, 1) for i, v in enumerate(odd)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, n int").repartition(4)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.linked(df, dense=dense).collect()}
    expected = {i: (int(linked[i].sum()), roots[i], roots[i] == i) for i in range(n)} | {n + i: (0, n + i, True) for i in range(len(odd))}
    total = int(linked.sum())
    assert total > 2000
    got = sum(found[i][0] for i in range(n))
    assert got >= 0.995 * total and all(found[i][0] <= expected[i][0] for i in range(n))
    same = sum(found[i] == expected[i] for i in found)
    assert same >= 0.97 * len(found) and len(found) == len(expected)
    assert embeddings.linked(df.limit(0)).collect() == []


def test_vectors_of_several_lengths_and_types(spark):
    data = [(1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (3, [1.0, 0.0, 0.0], 1), (4, [2.0, 0.0, 0.0], 1), (5, [1.0, 0.0], 2), (6, [1.0, 0.0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.linked(df).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (2, 1)}


def test_very_large_and_small_components(spark):
    """Also of one component, and with labels that aren't numbers."""
    data = [(1, [1e300, 1e300], "x"), (2, [1e-300, 1e-300], "x"), (3, [3.0, 3.1], "x"), (4, [3.0, 3.0], "y"), (5, [7.0], "x"), (6, [5e-324], "x"), (7, [-1.0], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.linked(df).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2, 20_000, 64))
    x, y = embeddings.unit(x), embeddings.unit(y - (x * y).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x)
    z = 0.93 * x + np.sqrt(1 - 0.93**2) * embeddings.unit(y - (x * y).sum(1, keepdims=True) * x)
    unlike = np.bitwise_count(embeddings.sketches(x) ^ embeddings.sketches(z)).sum(1)
    most = embeddings.most_unlike(0.93)
    assert unlike.max() <= most < 80 and (np.bitwise_count(embeddings.sketches(x) ^ embeddings.sketches(y)).sum(1) > most).all()


def test_fingerprints_of_long_texts(spark):
    words = [f"w{i % 997}" for i in range(120_000)]
    rows = spark.createDataFrame([(1, " ".join(words), "a"), (2, "x" * 1_000_000, "b"), (3, None, "c")], "doc_id long, text string, fp string")
    got = {r["doc_id"]: r["fp"] for r in simhash.groups(simhash.fingerprints(rows)).collect()}
    for i, text in ((1, words), (2, ["x" * 1_000_000])):
        grams = [" ".join(text[k : k + 3]) for k in range(len(text) - 2)] or [" ".join(text)]
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i] == bits - (1 << 64 if bits >> 63 else 0)
    assert got[3] == 0


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 8))
    h = np.array([[1.0]])
    for _ in range(3):
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(embeddings.hadamard(x), x @ h.T)
    assert embeddings.choose(10**9, 64).hashes > embeddings.choose(1000, 64).hashes
