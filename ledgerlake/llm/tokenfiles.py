"""Token ids in ORC files.

Documents are dealt in ascending order of their ids, encoded where they lie and
written as ORC: integer run-length encoding keeps ids small, the row index and a
Bloom filter on the document id let a reader skip stripes and row groups, and
each stripe can be read by another task. ``place`` numbers the rows in file
order, so what stands before a document can be counted from the files alone.

Null texts are empty and have the end id alone. Null ids come first; rows that
repeat are written as often as they come, equal ids in the order of their
texts. Other columns are ignored.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.llm.text import whole
from ledgerlake.llm.tokens import encoder, vocabulary

#: ORC's own settings: bytes of a stripe, rows of a row group in the index.
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000
#: monotonically_increasing_id counts rows below this bit and partitions above.
_PART_BIT = 33


def _encoded(path):
    def work(batches):
        own = encoder(path)
        for batch in batches:
            for begin, end, ids, offsets in own.batches(batch.column(1)):
                some = batch.slice(begin, end - begin)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), lists], names=["_id", "place", "ids"])

    return work


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Write columns ``id_col``, ``place`` and ``ids`` (array of int) to ``path``."""
    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"))
    dealt = rows.repartitionByRange("_id", F.xxhash64("_text")).sortWithinPartitions("_id", F.xxhash64("_text"), "_text")
    placed = dealt.withColumn("place", F.monotonically_increasing_id())
    kind = docs.schema[id_col].dataType.simpleString()
    encoded = placed.mapInArrow(_encoded(tokenizer or vocabulary()), f"_id {kind}, place long, ids array<int>")
    (
        encoded.withColumnRenamed("_id", id_col)
        .write.option("orc.bloom.filter.columns", id_col)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.stripe.size", STRIPE_BYTES)
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_ids`` wrote. A filter on the id is pushed to the files."""
    return spark.read.orc(path)


def _summed(batches):
    for batch in batches:
        lists = batch.column(2)
        first = lists.offsets.to_numpy()
        ids = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(first).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["_id", "place", "n_tokens", "ids_crc32"],
        )


def manifest(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """From the files: each row's ``id_col``, ``start`` (ids of all rows before
    it), ``n_tokens`` and ``ids_crc32`` (of its ids as little-endian 32-bit
    numbers). Sums by file part, then of the parts, of which there are as many
    as files."""
    files = read_ids(spark, path)
    kind = files.schema[id_col].dataType.simpleString()
    rows = files.select(id_col, "place", "ids").mapInArrow(_summed, f"_id {kind}, place long, n_tokens long, ids_crc32 long")
    rows = rows.withColumn("part", F.shiftright("place", _PART_BIT))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = files.select(F.shiftright("place", _PART_BIT).alias("part"), F.size("ids").alias("n"))
    totals = totals.groupBy("part").agg(F.sum("n").alias("n"))
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(bases, "part").select(
        F.col("_id").alias(id_col), (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )
