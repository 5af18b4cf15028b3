"""Where texts with like sets of word shingles meet.

A text is the set of its word shingles. For each of 125 hash functions the
smallest value in the set is kept; two texts agree in such a minimum as often as
their sets are alike (Jaccard). Five minima together are a band, and texts that
agree in one of 25 bands meet: of pairs alike to 0.8 all but 5 in 100,000 do,
whatever the edit that sets them apart, and more of those that are closer.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.text import mixed

SEED = 42
BAND = 5
BANDS = 25
MINIMA = BAND * BANDS
_BAND_BITS = 5  # of a value, which name its band
_SHINGLES = 512  # hashed by all functions at once
#: Members of a value that are compared in one task; more are dealt in blocks.
BLOCK = 2000
#: Smallest hashes of a set that go with it: all of most sets.
SKETCH = 512

_FACTORS = mixed(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
_TERMS = mixed(np.arange(MINIMA + 1, 2 * MINIMA + 1, dtype=np.uint64))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending."""
    cut = text.lower().split()  # A-Z and ASCII white space only, as these are bytes
    if not cut:
        return np.zeros(0, np.uint64)
    ends = range(words, max(words, len(cut)) + 1)
    hash64 = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hash64(b" ".join(cut[e - words : e]), SEED) for e in ends), np.uint64))


def set_key(hashes: np.ndarray) -> int:
    """One number for the whole set, signed."""
    key = xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)
    return key - (1 << 64) if key >> 63 else key


def minima(hashes: np.ndarray) -> np.ndarray:
    found = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), _SHINGLES):
        some = hashes[i : i + _SHINGLES, None] * _FACTORS + _TERMS
        found = np.minimum(found, (some.min(axis=0) >> np.uint64(32)).astype(np.uint32))
    return found


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, MINIMA)


def _banded(batches):
    for batch in batches:
        bands = _matrix(batch.column(1)).reshape(-1, BANDS, BAND).astype(np.uint64)
        values = np.zeros(bands.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(BAND):
            values = mixed(values + bands[:, :, k])
        values = (values >> np.uint64(_BAND_BITS) << np.uint64(_BAND_BITS)) | np.arange(BANDS, dtype=np.uint64)
        nodes = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(values.ravel().view(np.int64)), pa.array(nodes)], names=["value", "node"])


def meetings(nodes: DataFrame) -> DataFrame:
    """``value``, ``node`` wherever two of the ``nodes`` (``node``, ``minima``)
    or more have a band in common."""
    banded = nodes.select("node", "minima").mapInArrow(_banded, "value long, node long")
    shared = banded.groupBy("value").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("value")
    return banded.join(shared, "value", "left_semi")


def to_centres(met: DataFrame, turn: int) -> DataFrame:
    """Pairs ``a`` < ``b``: where nodes of several roots meet (``value``,
    ``node``, ``root``), each with one of them, another one in each turn."""
    own = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root")
    centres = met.groupBy("value").agg(F.min(own).alias("c"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y")
    both = met.join(centres.select("value", "c"), "value").filter("root <> c.root")
    return both.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def _likeness(x: np.ndarray, y: np.ndarray, size: int) -> tuple[float, bool]:
    """Jaccard similarity by the ``size`` smallest hashes of two sets, and whether
    these are all hashes."""
    ends = [z[-1] for z in (x, y) if len(z) >= size]
    if ends:
        x, y = (z[: np.searchsorted(z, min(ends), side="right")] for z in (x, y))
    if not len(x) or not len(y):
        return 0.0, not ends
    same = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return same / (len(x) + len(y) - same), not ends


def _lists(column) -> np.ndarray:
    """Each row's array, unsigned."""
    flat, places = column.flatten().to_numpy().view(np.uint64), np.cumsum([0, *column.value_lengths().to_pylist()])
    out = np.empty(len(column), object)
    out[:] = [flat[i:j] for i, j in zip(places, places[1:], strict=False)]
    return out


def _across(similarity: float, size: int):
    """Pairs of different roots that are alike as far as minima and sketches
    tell, in the first band that they have in common."""
    spread = similarity * (1 - similarity)
    least, close = similarity - 5 * (spread / MINIMA) ** 0.5, similarity - 5 * (spread / size) ** 0.5

    def work(batches):
        held = None
        for batch in batches:
            now = [np.asarray(batch.column(i)) for i in range(6)] + [_matrix(batch.column(6)), _lists(batch.column(7))]
            rows = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(rows[0]):
                continue
            new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])) + 1
            starts = [0, *new.tolist()]
            for i, j in zip(starts, starts[1:], strict=False):
                yield from found([x[i:j] for x in rows])
            # the last group may go on in the next batch
            held = [x[starts[-1] :].copy() for x in rows]
        if held is not None:
            yield from found(held)

    def found(rows):
        value, low, high, block, node, root, signs, sketches = rows
        band, apart = int(value[0]) & ((1 << _BAND_BITS) - 1), low[0] != high[0]
        # the members of the largest root stand last: they have none behind them
        _, at, often = np.unique(root, return_inverse=True, return_counts=True)
        order = np.lexsort((at, often[at]))
        block, node, signs, sketches = block[order], node[order], signs[order], sketches[order]
        ends = np.flatnonzero(np.diff(at[order], append=-1)) + 1
        behind = ends[np.searchsorted(ends, np.arange(len(node)), side="right")]
        a, b = [], []
        for i in np.flatnonzero(behind < len(node)).tolist():
            same = signs[behind[i] :] == signs[i]
            near = np.count_nonzero(same, axis=1) >= least * MINIMA
            if apart:
                near &= block[behind[i] :] != block[i]
            near = np.flatnonzero(near)
            first = same[near].reshape(-1, BANDS, BAND).all(axis=2).argmax(axis=1)
            others = []
            for j in (behind[i] + near[first == band]).tolist():
                likely, sure = _likeness(sketches[i], sketches[j], size)
                if likely >= (similarity - 1e-9 if sure else close):
                    others.append(int(node[j]))
            own = int(node[i])
            a += [min(own, x) for x in others]
            b += [max(own, x) for x in others]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return work


def dealt(met: DataFrame) -> DataFrame:
    """Members of values with several roots, dealt into pairs of blocks (``value``,
    ``low``, ``high``) so that any two of different roots are in one of them.

    Members of a value's largest root have no pairs among them: they only go to the
    blocks of the others. So a family of millions that meets a few others is
    moved a few times, not once for each of its own blocks."""
    counts = met.groupBy("value", "root").agg(F.count("*").alias("n"))
    several = counts.groupBy("value").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots"))
    several = several.filter("roots > 1").withColumn("few", F.col("n") <= BLOCK).select(
        "value",
        F.col("most.root").alias("most"),
        F.when(F.col("few"), 1).otherwise(F.ceil((F.col("n") - F.col("most.n")) / BLOCK)).cast("int").alias("blocks"),
        F.when(F.col("few"), 0).otherwise(F.ceil(F.col("most.n") / BLOCK)).cast("int").alias("behind"),
    )
    rows = met.join(several, "value").withColumn("late", (F.col("root") == F.col("most")) & (F.col("behind") > 0))
    rows = rows.withColumn("block", F.expr("cast(if(late, blocks + pmod(xxhash64(node), greatest(behind, 1)), pmod(xxhash64(node), blocks)) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, if(late, blocks, blocks + behind) - 1)")))
    return rows.select("value", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root")


def across(met: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs ``a`` < ``b`` of nodes of different roots that meet, but for
    those whose minima (``nodes``) or smallest hashes (``sets``) agree five
    standard errors less than ``similarity``."""
    signs = nodes.select("node", "minima").join(sets.select("node", F.slice("shingles", 1, SKETCH).alias("sketch")), "node")
    rows = dealt(met).join(signs, "node").select("value", "low", "high", "block", "node", "root", "minima", "sketch")
    rows = rows.repartition("value", "low", "high").sortWithinPartitions("value", "low", "high")
    return rows.mapInArrow(_across(similarity, SKETCH), "a long, b long")
