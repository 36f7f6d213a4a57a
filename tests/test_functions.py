from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strata.functions import histogram, identity, ring
from strata.functions.correlation import correlate, distance, share

BYTES = [(bytearray(bytes(100)),), (bytearray(b"\xff" * 50),), (bytearray(b"\x00\xff\x55\xaa"),), (bytearray(range(256)),), (bytearray(b""),)]
GOLDEN = [
    (b"test", [0, 0, 0, 0, 3, 1, 0, 0, 0], 4.25, 0.1875, 1.342857, "Structured"),
    (b"The quick brown fox jumps over the lazy dog.", [0, 8, 0, 7, 14, 10, 5, 0, 0], 3.75, 2.414773, 0.897993, "Structured"),
    (bytes(range(256)), [1, 8, 28, 56, 70, 56, 28, 8, 1], 4.0, 2.0, 0.0, "Random"),
    (b"\x00\xff\x55\xaa", [1, 0, 0, 0, 2, 0, 0, 0, 1], 4.0, 8.0, 31.914286, "Dense"),
]


@pytest.fixture(scope="module")
def ring_rows(spark):
    x = F.col("id").cast("int")
    y = ((F.col("id") * 7 + 3) % 256).cast("int")
    ops = {"neg2": ring.neg(ring.neg(x)), "bnot2": ring.bnot(ring.bnot(x)), "succ": ring.succ(x), "pred": ring.pred(x), "xor": ring.xor(x, x), "bits": ring.stratum(x) + ring.stratum(ring.bnot(x)), "and": ring.band(x, y), "or": ring.bor(x, y)}
    return spark.range(256).select(x.alias("x"), y.alias("y"), *(c.alias(n) for n, c in ops.items())).collect()


def test_ring_identities(ring_rows):
    for r in ring_rows:
        assert r["neg2"] == r["bnot2"] == r["x"]
        assert r["succ"] == (r["x"] + 1) % 256 and r["pred"] == (r["x"] - 1) % 256
        assert r["xor"] == 0 and r["bits"] == 8
        assert r["and"] == r["x"] & r["y"] and r["or"] == r["x"] | r["y"]


def test_triads(spark):
    x = F.col("id").cast("int")
    rows = {r["id"]: r for r in spark.range(256).select("id", ring.triad(x).alias("t"), ring.set_positions(x).alias("p")).collect()}
    assert rows[0]["p"] == [] and rows[255]["p"] == list(range(8)) and rows[0x55]["p"] == [0, 2, 4, 6]
    assert rows[0x55]["t"]["spectrum"] == [True, False] * 4 and rows[7]["t"]["stratum"] == 3


def test_histograms_agree(spark):
    df = spark.createDataFrame(BYTES, "data binary")
    native = df.select(*histogram.bins(F.col("data"))).collect()
    arrow = histogram.with_bins(df).select(*histogram.BINS).collect()
    assert native == arrow
    assert list(native[3]) == [1, 8, 28, 56, 70, 56, 28, 8, 1]


@pytest.mark.parametrize("data,bins,mean,variance,chi,kind", GOLDEN)
def test_moments(spark, data, bins, mean, variance, chi, kind):
    df = histogram.with_bins(spark.createDataFrame([(bytearray(data),)], "data binary"))
    r = df.select(*histogram.BINS, histogram.mean().alias("m"), histogram.variance().alias("v"), histogram.chi_square().alias("c"), histogram.classify().alias("k")).first()
    assert list(r)[:9] == bins and (r["m"], r["k"]) == (mean, kind)
    assert r["v"] == pytest.approx(variance, abs=1e-6) and r["c"] == pytest.approx(chi, abs=1e-6)


def test_classes_and_summaries(spark):
    cases = [(bytes(1000), "Sparse"), (b"\xff" * 1000, "Sparse"), (bytes(range(256)) * 100, "Random"), (b"\x01" * 100, "Dense"), (b"\x07" * 40 + bytes(60), "Dense"), (b"", "Sparse")]
    df = spark.createDataFrame([(i, bytearray(d)) for i, (d, _) in enumerate(cases)], "i int, data binary")
    rows = histogram.profiled(df).select("i", "class", histogram.summary().alias("s"), histogram.extreme_density().alias("e"), histogram.density(0).alias("d")).orderBy("i").collect()
    assert [r["class"] for r in rows] == [k for _, k in cases]
    assert rows[0]["s"] == [255] + [0] * 8 and rows[0]["e"] == rows[0]["d"] == 1.0 and rows[5]["e"] == 0.0


def test_identity(spark):
    h = identity.chunk_id(F.col("x"))
    r = spark.createDataFrame([("test",)], "x string").select(h.alias("h"), identity.urn(h).alias("u"), identity.braille_iri(h).alias("i"), identity.debug(h).alias("d"), identity.from_bytes(identity.to_bytes(h)).alias("b")).first()
    assert r["h"] == r["b"] == "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
    assert r["u"].endswith(":9f86d081884c7d65") and r["d"] == "ChunkId(9f86d081884c7d65)"
    assert r["i"].endswith("⢟⢆⣐⢁⢈⡌⡽⡥⢚⠯⣪⢠⣅⡚⣐⠕⢣⢿⡏⠛⠫⠋⢂⠬⣑⡝⡬⠕⢰⣰⠊⠈")


def test_correlation(spark):
    pairs = [(b"\x42\x55\xaa", b"\x42\x55\xaa", 0, 1.0), (b"\x55", b"\xaa", 8, 0.0), (b"\x00", b"\x01", 1, 0.875), (b"\x00\x00", b"\xff\xff", 16, 0.0), (b"", b"", 0, 1.0)]
    df = spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, (a, b, *_) in enumerate(pairs)], "i int, a binary, b binary")
    for r, (a, b, bits, fidelity) in zip(df.select("i", *correlate(F.col("a"), F.col("b"))).orderBy("i").collect(), pairs, strict=True):
        assert (r["hamming"], r["fidelity"]) == (bits, fidelity) == (distance(a, b), share(bits, len(a)))
    unequal = spark.createDataFrame([(bytearray(b"a"), bytearray(b"ab"))], "a binary, b binary")
    with pytest.raises(Exception, match="can't be correlated"):
        unequal.select(*correlate(F.col("a"), F.col("b"))).collect()
