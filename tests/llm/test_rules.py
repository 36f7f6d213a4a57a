"""Quality rules and language identification."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from strata.llm import langid, quality


def brute(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows: dict[tuple, list[int]] = {}
    for p in range(len(words) - 7):
        windows.setdefault(tuple(words[p : p + 8]), []).append(p)
    covered = {p + k for places in windows.values() if len(places) > 1 for p in places for k in range(8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def texts() -> list[str | None]:
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    out: list[str | None] = [None, "", "  \n ", "a b c\x0bd\x85e", "one line\none line\n\n\none line", "a " * 300, " ".join("abcdefgh") * 2]
    for _ in range(60):
        part = [word() for _ in range(rng.randrange(0, 60))]
        out.append(rng.choice([" ", "\n", "\t", "  "]).join(part + (part[: rng.randrange(0, 20)] if rng.random() < 0.4 else [])) + rng.choice(["", "###", " | | $", "\n"]))
    return out


def test_counts(spark):
    rows = list(enumerate(texts()))
    rows += rows[:3]
    df = spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id long, text string, n_words int, score string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (999, 0)], "doc_id long, quality int")
    out = quality.judge(df, labels).collect()
    got = sorted((r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"]) for r in out)
    assert got == sorted((i, *brute(t)) for i, t in rows)
    assert all(not r["kept"] for r in out if r["base_failed"])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(docs, labels).collect() == []
    assert quality.judge(spark.createDataFrame([(1, None)], "doc_id long, text string"), labels).first()["kept"] is False


def test_forest_isolates_what_is_far():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(size=(2000, 3)), rng.normal(size=(20, 3)) * 0.1 + 8])
    score = quality.Forest(rows).score(rows)
    assert score[2000:].min() > np.quantile(score[:2000], 0.99)
    same = quality.Forest(np.ones((300, 2)))
    assert len(set(same.score(np.ones((5, 2))))) == 1


def test_paths_follow_the_trees():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(500, 2))
    f = quality.Forest(rows, trees=5, subsample=64, depth=5)
    for x, got in zip(rows[:50], f.score(rows[:50]), strict=True):
        total = 0.0
        for t in range(5):
            node = 0
            for _ in range(5):
                node = 2 * node + 1 if x[f.feature[t, node]] < f.split[t, node] else 2 * node + 2
            total += f.path[t, node]
        assert got == pytest.approx(2 ** (-total / 5 / f.usual(64)))


def test_verdict_on_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    out = quality.query(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = out.join(labels, "doc_id").filter("not base_failed").collect()
    good, poor = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(poor) <= 0.2 * len(poor)


def test_languages(spark):
    folder = "/root/testdata/sf0.01"
    rows = langid.query(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_odd_rows(spark):
    train = [(i, f"the cat and the dog number {i} went home together", "en", "x") for i in range(60)] + [(100 + i, f"der hund und die katze nummer {i} gingen zusammen heim", "de", "x") for i in range(60)]
    odd = [(500, None, "en", "x"), (501, "", None, "x"), (502, "123 + 456 !!", "en", "x"), (503, "日本", None, "x"), (None, "the dog", "en", "x"), (504, "der hund " * 20_000, None, "x"), (504, "der hund " * 20_000, None, "x")]
    df = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, score string").repartition(3)
    model = langid.learned(df)
    assert model.languages == ["de", "en"]
    out = {r["doc_id"]: r for r in langid.identify(df.drop("score"), model).collect()}
    assert [out[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and out[500]["score"] == 0.0
    assert out[503]["lang_pred"] in ("de", "en") and out[504]["lang_pred"] == "de" and out[None]["lang_pred"] == "en"
    assert len(langid.identify(df, model, name="l", score="s").collect()) == len(train) + len(odd)


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    out = langid.identify(df, langid.learned(df)).first()
    assert (out["lang_pred"], out["score"]) == ("und", 0.0)
    assert langid.identify(df.limit(0), langid.learned(df.limit(0))).collect() == []


def test_prediction_is_the_mean_of_the_table():
    rng = np.random.default_rng(1)
    m = langid.Model(["a", "b"], rng.normal(size=(langid.BUCKETS, 2)), rng.normal(size=2), 2.0, 0.0)
    raw = [b"The quick fox", "Größe".encode(), b"x"]
    names, scores = m.predict(raw)
    for t, name, score in zip(raw, names, scores, strict=True):
        _, bucket = langid.subwords([t])
        z = (m.table[bucket].mean(0) + m.bias) / 2.0
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert name == "ab"[p.argmax()] and score == pytest.approx(p.max())


def buckets_by_hand(text: bytes) -> list[int]:
    """Every n-gram of letters and boundaries, hashed sign by sign."""
    signs = [0, *(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in text), 0]
    out = []
    for n in (2, 3, 4):
        for p in range(len(signs) - n + 1):
            gram = signs[p : p + n]
            if 0 in gram[1:-1] or not any(gram):
                continue
            code = n * 2654435761 & 0xFFFFFFFF
            for sign in gram:
                code = (code ^ sign) * 16777619 & 0xFFFFFFFF
                code ^= code >> 15
            out.append(code % langid.BUCKETS)
    return sorted(out)


def test_predictions_by_hand(spark):
    """The model's answer, from its embeddings' table and nothing else of its code."""
    train = [(i, f"the cat and the dog number {i} went home together", "en") for i in range(80)] + [(100 + i, f"der hund und die katze nummer {i} gingen zusammen heim", "de") for i in range(80)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.learned(df)
    odd = ["", "a", "Größe, 12 日本!", "THE end\n\nof a Line", "x" * 5000, " der  hund ", "é"]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in langid.identify(rows, model).collect():
        found = buckets_by_hand(r["text"].encode())
        _, index = langid.subwords([r["text"].encode()])
        assert sorted(index.tolist()) == found
        z = (np.mean([model.table[b] for b in found], axis=0) if found else 0) + model.bias
        e = np.exp(z / model.temperature - np.max(z / model.temperature))
        if r["text"]:
            assert r["lang_pred"] == model.languages[int(np.argmax(e))] and r["score"] == pytest.approx((e / e.sum()).max())
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_strange_texts_are_rejected():
    """Words of no learned language mostly go, those of known ones stay."""
    import duckdb

    rows = duckdb.sql("SELECT text, lang FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL AND lang IS NOT NULL AND length(text) > 300 ORDER BY doc_id").fetchall()
    languages = sorted({x for _, x in rows})
    known = [(t.encode(), languages.index(x)) for t, x in rows]
    counted = [langid.counted(t) for t, _ in known]
    strange = [langid.counted(langid.scrambled(t)) for t, _ in known[::5]]
    model = langid.train(languages, [k for _, k in known], [b for b, _ in counted], [n for _, n in counted], strange)
    other = [langid.scrambled(t + b"x") for t, _ in known[1::5]]
    assert sorted(other[0].decode()) == sorted(known[1][0].decode() + "x") and other[0] != known[1][0] + b"x"
    rejected = model.predict(other)[1] < model.threshold
    kept = model.predict([t for t, _ in known])[1] >= model.threshold
    print(rejected.mean(), kept.mean(), model.threshold)
    assert kept.mean() >= 0.99 and rejected.mean() >= 0.5


def test_subwords_end_at_boundaries():
    index, bucket = langid.subwords([b"ab", b"ab cd", b""])
    per = [sorted(bucket[index == i].tolist()) for i in range(3)]
    assert per[2] == [] and set(per[0]) < set(per[1]) and len(per[0]) == 3 + 2 + 1


def test_weights_follow_the_labels(spark):
    """Shares that tell labelled rows apart are looked at most."""
    rng = np.random.default_rng(3)
    poor, good = rng.normal(size=(50, 3)), rng.normal(size=(400, 3))
    poor[:, 1] += 5
    poor[:, 2] -= 5
    told = quality.separation(poor, good)
    assert told[0] < 0.3 and told[1] > 0.99 and told[2] > 0.99
    stats = quality.statistics(spark.createDataFrame([(i, f"word{i} " * 30) for i in range(5)], "doc_id long, text string"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.weights(stats, none).tolist() == [1.0] * len(quality.SHARES)


def test_one_very_long_text(spark):
    words = 400_000
    docs = spark.createDataFrame([(1, "some words " * (words // 2)), (2, "x" * 1_000_000), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.judge(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert got[1]["n_words"] == words and got[1]["n_repeat_words"] == words and got[1]["base_failed"]
    assert got[2]["n_words"] == 1 and got[2]["word_chars"] == 1_000_000 and not got[3]["kept"]
