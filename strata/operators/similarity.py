"""Near-duplicate chunks: the best earlier chunk of equal length, if close.

Candidates of a chunk are the unique chunks of equal length among the ``window``
before it.  One look at the first bytes drops most; of the others the closest
wins, the earliest among equals.

Scale: chunks are dealt into stretches of ``STRETCH`` numbers, and those at the
end of a stretch go into the next one too, as candidates.  So a window is always
in one group of bounded size, also where one length is very common, and each
chunk moves once or twice instead of once for every candidate.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import fixed_values as V
from strata.functions.correlation import share
from strata.functions.histogram import BIT_COUNT

STRETCH = 2048


def numbered(cut: DataFrame, scope: str = "file") -> DataFrame:
    """The first occurrence of each chunk, with ``useq``, its number among the
    unique chunks of its file or of the corpus."""
    keys = ["file_id", "chunk_id"] if scope == "file" else ["chunk_id"]
    # places are compared first; the bytes of the first occurrence are joined back
    first = cut.groupBy(*keys).agg(F.min(F.struct("file_id", "offset")).alias("f")).select("chunk_id", "f.*")
    rows = cut.select("file_id", "offset", "seq", "length", "data").join(first, ["file_id", "offset"])
    if scope == "file":
        return rows.withColumn("useq", (F.row_number().over(Window.partitionBy("file_id").orderBy("offset")) - 1).cast("long")).withColumn("space", F.col("file_id").cast("string"))
    per_file = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    kind = dict(per_file.dtypes)["file_id"]
    # numbers of files from counts before each one; rows of this table are files
    counted = per_file.sort("file_id").rdd.zipWithIndex().map(lambda x: (x[0]["file_id"], x[0]["n"], x[1]))
    ranked = per_file.sparkSession.createDataFrame(counted, f"file_id {kind}, n long, k long")
    part = F.floor(F.col("k") / 4096)
    in_part = F.sum("n").over(Window.partitionBy(part).orderBy("k")) - F.col("n")
    parts = ranked.groupBy(part.alias("part")).agg(F.sum("n").alias("n"))
    # sums over parts of 4096 parts, and over these: no window holds more rows
    upper = F.floor(F.col("part") / 4096)
    uppers = parts.groupBy(upper.alias("upper")).agg(F.sum("n").alias("n")).sort("upper").collect()
    ahead = list(zip((r["upper"] for r in uppers), accumulate((r["n"] for r in uppers), initial=0), strict=False))
    ahead = per_file.sparkSession.createDataFrame(ahead, "upper long, ahead long")
    in_upper = F.sum("n").over(Window.partitionBy("upper").orderBy("part")) - F.col("n")
    before = parts.withColumn("upper", upper).withColumn("in_upper", in_upper).join(F.broadcast(ahead), "upper").select(F.col("part").alias("of_part"), (F.col("in_upper") + F.col("ahead")).alias("before"))
    starts = ranked.select("file_id", part.alias("part"), in_part.alias("in_part")).join(before, F.col("part") == F.col("of_part")).select("file_id", (F.col("in_part") + F.col("before")).alias("start"))
    own = F.row_number().over(Window.partitionBy("file_id").orderBy("offset")) - 1
    return rows.withColumn("own", own).join(starts, "file_id").withColumn("useq", (F.col("start") + F.col("own")).cast("long")).drop("own", "start").withColumn("space", F.lit("corpus"))


def best_bases(unique: DataFrame, threshold: float = V.FIDELITY, window: int = V.WINDOW, everything: bool = False) -> DataFrame:
    """(space, file_id, useq, chunk_id, base_chunk_id, base_useq, hamming,
    max_bits, fidelity) of the chunks that have a base.

    With ``everything``, all candidate pairs without any threshold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, near = None, deque()
        for b in batches:
            out = []
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for space, stretch, length, useq, halo, file_id, chunk, data in zip(*columns, strict=True):
                if (space, stretch, length) != group:
                    group, near = (space, stretch, length), deque()
                while near and useq - near[0][0] > window:
                    near.popleft()
                own = np.frombuffer(data, dtype=np.uint8)
                if not halo:
                    best = None
                    for base_useq, base_chunk, base in near:
                        if not everything:
                            head = int(BIT_COUNT[own[: V.PREFIX] ^ base[: V.PREFIX]].sum(dtype=np.int64))
                            if share(head, min(V.PREFIX, length)) < threshold * V.PREFIX_PART:
                                continue
                        bits = int(BIT_COUNT[own ^ base].sum(dtype=np.int64))
                        close = share(bits, length)
                        row = (space, file_id, useq, chunk, base_chunk, base_useq, bits, 8 * length, close)
                        if everything:
                            out.append(row)
                        elif best is None or close > best[-1]:
                            best = row
                    if best is not None and best[-1] >= threshold:
                        out.append(best)
                near.append((useq, chunk, own))
            found = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = [pa.string(), b.schema.field("file_id").type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            names = ["space", "file_id", "useq", "chunk_id", "base_chunk_id", "base_useq", "hamming", "max_bits", "fidelity"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names=names)

    own = F.floor(F.col("useq") / STRETCH)
    last = F.col("useq") % STRETCH >= STRETCH - window
    placed = unique.select("space", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))).alias("stretch"), F.col("length").cast("long").alias("length"), "useq", "file_id", "chunk_id", "data")
    placed = placed.withColumn("halo", F.col("stretch") != F.floor(F.col("useq") / STRETCH))
    keys = ["space", "stretch", "length"]
    rows = placed.select(*keys, "useq", "halo", "file_id", "chunk_id", "data").repartition(*keys).sortWithinPartitions(*keys, "useq")
    kind = dict(unique.dtypes)["file_id"]
    return rows.mapInArrow(run, f"space string, file_id {kind}, useq long, chunk_id string, base_chunk_id string, base_useq long, hamming long, max_bits long, fidelity double")
