from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strata import cli
from strata.functions import fixed_values as V
from strata.operators.chunking import SMALL, chunks
from strata.streaming import chunks as stream


def test_chunks_of_a_stream_are_stored_once(spark, tmp_path):
    texts = [bytes([i % 7]) * 1500 + bytes(range(200)) * 3 for i in range(6)]
    source, out = tmp_path / "in", str(tmp_path / "out")
    rows = [(i, bytearray(t)) for i, t in enumerate(texts)]
    schema = "file_id long, content binary"
    for part in (rows[:3], rows[3:], rows[:1]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(source))
        stream.start(spark.readStream.schema(schema).parquet(str(source)), out, SMALL).awaitTermination()
    expected = chunks(spark.createDataFrame(rows, schema), SMALL).select("chunk_id").distinct()
    found = stream.stored(spark, out).select("chunk_id")
    assert found.count() == expected.count() and found.exceptAll(expected).count() == 0
    assert spark.read.parquet(f"{out}/file_map").select("file_id").distinct().count() == 6


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    batch = spark.createDataFrame([(1, bytearray(bytes(3000)))], "file_id long, content binary")
    for _ in range(2):
        stream.ingest(batch, 0, str(tmp_path), SMALL)
    assert stream.stored(spark, str(tmp_path)).groupBy("chunk_id").count().filter("count > 1").count() == 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    contents = {"a.bin": bytes(100_000), "b.txt": b"some words " * 50, "c.bin": b""}
    for name, data in contents.items():
        (tmp_path / "in" / name).write_bytes(data)
    packed, out = str(tmp_path / "packed"), str(tmp_path / "out")
    assert cli.main(["compress", str(tmp_path / "in"), "-o", packed, "-l", "best", "--manifest"], spark) == 0
    assert cli.main(["inspect", packed, "--chunks"], spark) == 0
    assert cli.main(["inspect", packed, "--manifest"], spark) == 0
    assert cli.main(["verify", packed], spark) == 0
    assert cli.main(["decompress", packed, "-o", out, "--verify"], spark) == 0
    restored = {p.name[-5:]: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    assert restored == contents
    levels = cli.bench(spark.createDataFrame([("x", bytearray(b"abc" * 9000))], "file_id string, content binary")).collect()
    assert [r["level"] for r in levels] == ["fast", "default", "best"] and all(r["ratio"] > 10 for r in levels)
    with pytest.raises(SystemExit):
        cli.main(["compress", packed, "-m", "odd"], spark)
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / f"x{V.EXTENSION}").write_bytes(b"not an archive at all" * 9)
    with pytest.raises(Exception, match="magic"):
        cli.main(["verify", str(broken)], spark)
    capsys.readouterr()


def test_float_sources(spark, tiny):
    from strata.sources import files

    rows = files.embeddings(spark, tiny)
    assert rows.filter(F.octet_length("content") != 256).count() == 0
