from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from strata.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text: str) -> str:
    found = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if passes(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def texts() -> list[str | None]:
    rng = random.Random(5)
    alphabet = ["1", "2", "25", "255", "300", "0", "007", ".", ".", "-", " ", "(", ")", "+", "+1", "@", "a", "b.c", "%", "é", "😀", "\n", "4111 1111 1111 1111", "+1 (437) 555-0689", "x@y.z", "10.0.0.1", ",", "1.2.3.4"]
    out: list[str | None] = ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(400)]
    out += [None, "", " ", "a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "x@y@z.com", "++1 2345678901", "1.2.3.0255 1.2.3.0256", "4111-1111-1111-1111-", "😀 mail me@here.org"]
    out += ["1" * 20_000, "a" * 20_000 + "@", "1." * 5_000, "+" + "1 " * 5_000, "x" * 30_000, "a@" + "b." * 5_000 + "c"]
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts())]
    rows += rows[:5]
    df = spark.createDataFrame([(i, t, "k", 9, "m") for i, t in rows], "doc_id long, text string, kind string, row int, match string").repartition(5)
    return rows, pii.by_document(df)


def test_base_spans(found):
    rows, out = found
    got = sorted(((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in out.collect()), key=repr)
    expected = []
    for i, t in rows:
        spans = base_spans(t or "")
        kinds = [s.split(":")[0] for s in spans.split(",")]
        expected.append((i, hashlib.sha256(spans.encode()).hexdigest(), *(kinds.count(k) for k in PATTERNS)))
    assert got == sorted(expected, key=repr)


def test_base_spans_stay_among_all(found):
    rows, out = found
    by = {i: base_spans(t or "") for i, t in rows if i is not None}
    for r in out.filter("doc_id is not null").collect():
        kept = [s for s in r["spans"].split(",") if not s.startswith("found")]
        assert ",".join(kept) == by[r["doc_id"]]


def test_no_python_runs(found):
    plan = found[1]._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_contexts_discover(spark):
    """Seeds teach a context; what else stands there is found, here and, once
    known, in other contexts that lead to more."""
    good = ["+1 (437) 555-0689", "+1 (325) 555-8094", "+1 (788) 555-2942"]
    rows = [(i, f"please reach me under the number {n} any day") for i, n in enumerate(good)]
    rows += [(10, "please reach me under the number 0437-555-0689 any day"), (11, "order 0437-555-0689 was sent"), (12, "in the year 20240 they met 12345 people"), (13, "again the number 0437-555-0689"), (14, "a number 0437-555-0689")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.by_document(df).collect()}
    at = rows[3][1].index("0437")
    assert got[10] == f"found:{at}:{at + 13}"
    assert got[11] == got[12] == "" and got[0].startswith("phone:")
    assert got[13] == "found:17:30" and got[14] == ""


def key(rng: random.Random, n: int = 40) -> str:
    return "".join(rng.choices("0123456789abcdef", k=n))


def prose(rng: random.Random) -> str:
    return " ".join(rng.choices(["the", "of", "and", "house", "river", "walks", "old,", "green."], k=12))


def test_key_contexts(spark):
    """Long hexadecimal values teach a context; values of other shapes in it are
    found, and digits in prose are not, however many seeds stand in prose."""
    rng = random.Random(8)
    rows, expected, at = [], {}, 0
    for i in range(300):
        a, b = prose(rng), prose(rng)
        kind = i % 6
        value = key(rng) if kind < 3 else rng.choice(["ab-12", "x9", "s3cret_" + "word" * 30]) if kind == 3 else None
        if value:
            rows.append((i, f'{a} token = "{value}" {b}'))
            expected[i] = f"found:{len(a) + 10}:{len(a) + 10 + len(value)}"
        else:
            rows.append((i, f"{a} {rng.randrange(10**15, 10**16)} {b}" if kind == 4 else f"{a} reader{i}@mail.example.com {b}"))
    rows += [(1000 + i, f"{prose(rng)} {key(rng)} {prose(rng)}") for i in range(3)]
    rows += [rows[0]] * 50  # equal rows count alike beside a value and without one
    out = pii.by_document(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    got = {r["doc_id"]: ",".join(s for s in r["spans"].split(",") if s.startswith("found")) for r in out}
    assert len(out) == len(rows)
    assert {i: s for i, s in got.items() if s} == expected
    assert all(r["private"] == (r["spans"] != "") for r in out)


def test_long_words_in_contexts(spark):
    long = "w" * 5_000
    rows = [(i, f"{long} {key(random.Random(i))}") for i in range(10)] + [(20, f"{long} v1"), (21, "w" * 4_999 + " v1"), (22, "1" * 200_000)]
    got = {r["doc_id"]: r["n_found"] for r in pii.by_document(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict.fromkeys(range(10), 1), 20: 1, 21: 0, 22: 0}


def test_longer_patterns_overrule(spark):
    """Beside "key" stand keys, but beside "public key" mostly other things."""
    rng = random.Random(2)
    rows = [(i, f"{prose(rng)} {rng.choice(['my', 'our', 'one', 'an', 'her', 'his'])}{'abcdefghij'[i % 10]} key {key(rng)}") for i in range(40)]
    rows += [(100 + i, f"{prose(rng)} public key {i}9") for i in range(6)] + [(200, f"{prose(rng)} spare key 55")]
    got = {r["doc_id"]: r["n_found"] for r in pii.by_document(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 1 for i in range(40)) and got[200] == 1 and not any(got[100 + i] for i in range(6))


def test_rounds(spark):
    edges = [("L a", f"s{i}", 1.0) for i in range(4)] + [("L a", "x", 0.0), ("L b", "x", 0.0), ("L b", "y", 0.0), ("L c", "s1", 1.0), *(("L d", f"s{i}", 1.0) for i in range(2)), *(("L d", f"n{i}", 0.0) for i in range(9))]
    df = spark.createDataFrame(edges, "pattern string, instance string, seed double")
    got = {r["pattern"]: r["confidence"] for r in pii.confident(df).collect()}
    assert set(got) == {"L a"} and got["L a"] > 4 / 6
    assert pii.confident(df.limit(0)).collect() == []


def test_empty_table(spark):
    assert pii.by_document(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_check_digit(spark):
    df = spark.createDataFrame([("4111111111111111",), ("4111111111111112",), ("79927398713",), ("0",)], "d string")
    assert [r[0] for r in df.select(pii.luhn(F.col("d"))).collect()] == [True, False, True, True]
