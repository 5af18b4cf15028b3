"""Best-fit packing of token sequences.

Documents longer than a sequence are cut; each piece is placed whole in the
smallest gap that takes it, the longest pieces first. Pieces are range-sorted by
length and ranked in Spark; since lengths and gaps are whole numbers up to the
sequence length, both lists are runs: so many pieces of a length, so many sequences
with a gap. The matching itself is one serial sweep on the driver over these runs,
from the longest length to the shortest: a run of pieces takes the smallest gaps
that hold it, and the gaps that are left go back into the list. Only runs pass
through the driver, whose number depends on the sequence length, not on the
documents. What a run was given is turned into a place for each piece, by its rank,
where the piece lies.

This gives what best-fit decreasing gives piece by piece. Null texts are empty
and have the end id alone. Rows that repeat are packed as often as they come.
Other columns are ignored.
"""

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.llm.text import whole
from ledgerlake.llm.tokens import encoder, vocabulary
from ledgerlake.sources.shared import materialise

SEQUENCE = 4096
_PART_BIT = 33  # of monotonically_increasing_id


def _cut(path, limit, with_ids):
    def work(batches):
        own = encoder(path)
        for batch in batches:
            for begin, end, ids, offsets in own.batches(batch.column(1)):
                ids = ids.astype("<u4", copy=False)
                n = np.diff(offsets)
                pieces = -(-n // limit)
                row = np.repeat(np.arange(end - begin), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = offsets[row] + piece * limit
                last = np.minimum(first + limit, offsets[row + 1])
                spans = list(zip(first.tolist(), last.tolist(), strict=True))
                columns = {
                    "_id": batch.column(0).take(pa.array(row + begin)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(piece * limit, pa.int64()),
                    "length": pa.array(last - first, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in spans], pa.int64()),
                }
                if with_ids:
                    places = pa.array(np.concatenate((first, last[-1:])).astype(np.int32))
                    columns["ids"] = pa.ListArray.from_arrays(places, pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    return work


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if
    wanted, ``ids`` of each piece of at most ``sequence`` ids."""
    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    cut = rows.mapInArrow(_cut(tokenizer or vocabulary(), sequence, with_ids), schema)
    return cut.withColumnRenamed("_id", id_col)


def sweep(runs: list[tuple[int, int]], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Where runs (length, number of pieces) go: rows of length, first rank,
    first sequence, pieces of this length in each sequence, offset of the
    first. A row holds up to the next row's first rank."""
    given, opened = [], 0
    gaps: list[int] = []  # sizes that occur, ascending
    lists: dict[int, list[tuple[int, int]]] = {}  # by size: first sequence, number of sequences

    def add(size, first, n):
        if size and n:
            if size not in lists:
                lists[size] = []
                insort(gaps, size)
            lists[size].append((first, n))

    for length, count in sorted(runs, reverse=True):
        rank = 0
        while rank < count:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                size = gaps[at]
                first, n = lists[size].pop()
                if not lists[size]:
                    del lists[size], gaps[at]
            else:  # no gap takes it
                size = sequence
                first, n = opened, -(-(count - rank) // (sequence // length))
                opened += n
            each = size // length
            full = min(n, (count - rank) // each)
            if full:
                given.append((length, rank, first, each, sequence - size))
                add(size - each * length, first, full)
                rank += full * each
            if full < n and rank < count:
                given.append((length, rank, first + full, count - rank, sequence - size))
                add(size - (count - rank) * length, first + full, 1)
                rank, full = count, full + 1
            add(size, first + full, n - full)
    return given


def _placed(given, sequence):
    table = np.array(given, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    keys = (table[:, 0] << 48) + table[:, 1]

    def work(batches):
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("rank")).to_numpy()
            row = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            k = rank - row[:, 1]
            out = {n: batch.column(n) for n in names if n != "rank"}
            out["sequence_id"] = pa.array(row[:, 2] + k // row[:, 3])
            out["offset"] = pa.array(row[:, 4] + k % row[:, 3] * length)
            yield pa.RecordBatch.from_pydict(out)

    return work


def pack(parts: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``parts`` (with a ``length`` from 1 to ``sequence``) with the columns
    ``sequence_id`` and ``offset``. Lengths out of that range are an error."""
    parts = materialise(parts, "cut")  # dealing by range reads its input twice
    others = [c for c in parts.columns if c != "length" and parts.schema[c].dataType.typeName() != "array"]
    dealt = parts.repartitionByRange("length", *others[:2]).sortWithinPartitions("length", *others)
    dealt = materialise(dealt.withColumn("_place", F.monotonically_increasing_id()), "pieces")
    dealt = dealt.withColumn("_part", F.shiftright("_place", _PART_BIT))
    counts = materialise(dealt.groupBy("length", "_part").agg(F.count("*").alias("n")), "piece-counts")
    # at most one row for each length
    runs = [tuple(r) for r in counts.groupBy("length").agg(F.sum("n")).collect()]
    if any(not 1 <= length <= sequence for length, _ in runs):
        raise ValueError(f"lengths must be from 1 to {sequence}")
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(W.partitionBy("length", "_part").orderBy("_place"))
    ranked = dealt.withColumn("_inside", inside).join(bases, ["length", "_part"])
    ranked = ranked.select(*parts.columns, (F.col("_base") + F.col("_inside") - 1).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(_placed(sweep(runs, sequence), sequence), schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``length`` and their ``ids``.
    A sequence has a bounded number of ids, so a group is small."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_parts")).select(
        "sequence_id", "length", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids")
    )
