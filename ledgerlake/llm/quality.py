"""Quality classifier: logistic regression on hashed word n-grams, trained by
follow-the-regularised-leader and scored as sparse dot products.

Words are what stands between white space. A document's features are its word
and word-pair frequencies, and the same of the words' shapes: runs of small
letters, capitals and digits count as one sign each, other signs as they are, and
a word that repeats the one before is marked. Each feature is hashed to one of
``2 ** bits`` weights; each of the four kinds sums to one in a document.

Training uses a bounded sample of the labelled rows (``rows``, drawn by a hash
of the id). The sample is cut into shards; in each round every shard runs FTRL
over its rows from the common state, and the sum of the changes gives the next
state, so a state of bounded size is all that reaches the driver.

A null or empty text has the bias alone. Labels that are null are left out; of
labels that repeat, or differ, for an id the smallest counts. If no label is
left every score is 0.5. Rows that repeat are scored each. Ids, languages and
sources are never features, and other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.text import Spans, as_bytes, chunks, mixed, runs, whole
from ledgerlake.sources.shared import materialise

BITS = 18
#: Labelled rows that are used for training at most.
SAMPLE_ROWS = 12_000
SHARDS = 6
ROUNDS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-3

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def _shapes(data, starts, ends):
    """Hashes of the words' shapes."""
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ~np.isin(shape[1:], list(b"aA0"))
    keep[starts] = True
    until = np.concatenate(([0], np.cumsum(keep)))
    return Spans(shape[keep]).hash(until[starts], until[ends])


def features(texts: pa.Array, bits: int):
    """By chunk: first row, last row + 1, and of each feature's occurrence its
    row, index and weight; indexes start at 1, as 0 is the bias."""
    data, offsets = as_bytes(texts)
    for begin, end in chunks(offsets):
        some = data[offsets[begin] : offsets[end]]
        places = offsets[begin : end + 1] - offsets[begin]
        starts, ends = runs(~_IS_SPACE[some], places)
        rows = np.searchsorted(places, starts, side="right") - 1
        first = np.searchsorted(rows, np.arange(end - begin + 1))
        n = np.maximum(np.diff(first), 1)
        words = Spans(some).hash(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        shapes = _shapes(some, starts, ends) if len(starts) else words
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
        shapes = shapes + same.astype(np.uint64)
        pairs = rows[1:] == rows[:-1]
        out_rows, out_index, out_weight = [], [], []
        for kind, single in ((1, words), (3, shapes)):
            two = (single[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[1:])[pairs]
            for k, values, own in ((kind, single, rows), (kind + 1, two, rows[1:][pairs])):
                spread = mixed(values + np.uint64(k))
                out_rows.append(own)
                out_index.append(((spread >> np.uint64(64 - bits)) % np.uint64((1 << bits) - 1)).astype(np.int64) + 1)
                out_weight.append(1.0 / (n[own] if k == kind else np.maximum(n[own] - 1, 1)))
        yield begin, end, out_rows, out_index, out_weight


def _weights(z, n):
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _epoch(z, n, texts, labels, bits):
    """One pass of FTRL over the rows, in their order."""
    for begin, end, rows, index, weight in features(texts, bits):
        rows, index, weight = np.concatenate(rows), np.concatenate(index), np.concatenate(weight)
        order = np.argsort(rows, kind="stable")
        rows, index, weight = rows[order], index[order], weight[order]
        first = np.searchsorted(rows, np.arange(end - begin + 1))
        for row in range(end - begin):
            at = slice(first[row], first[row + 1])
            own, where = np.unique(index[at], return_inverse=True)
            x = np.concatenate(([1.0], np.bincount(where, weight[at], len(own))))
            own = np.concatenate(([0], own))
            w = _weights(z[own], n[own])
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[begin + row]) * x
            z[own] += g - (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / ALPHA * w
            n[own] += g * g


def _round(state_z, state_n, bits):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("text", "ascending")])
        z, n = state_z.copy(), state_n.copy()
        _epoch(z, n, table.column("text").combine_chunks(), table.column("label").to_numpy(), bits)
        changed = np.flatnonzero((z != state_z) | (n != state_n))
        return pa.table({"index": changed, "z": (z - state_z)[changed], "n": (n - state_n)[changed]})

    return work


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept out of training: crc32 of its id as text is
    divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``order``, ``text`` and ``label`` of the training rows."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_label_id")).agg(F.min(label_col).cast("double").alias("label"))
    known = known.withColumn("order", F.xxhash64("_label_id")).orderBy("order", "_label_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("text"))
    # bounded by ``rows``
    drawn = texts.join(F.broadcast(known), F.col("_id") == F.col("_label_id"))
    return drawn.groupBy("_id").agg(F.min("order").alias("order"), F.min("text").alias("text"), F.min("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS, bits: int = BITS, rounds: int = ROUNDS) -> np.ndarray:
    """The weights: the bias, then ``2 ** bits - 1`` of features."""
    drawn = sample(docs, labels, id_col, text_col, label_col, rows)
    drawn = materialise(drawn.select("order", "text", "label", (F.pmod("order", F.lit(SHARDS))).cast("int").alias("shard")), "quality-sample")
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    for _ in range(rounds):
        changes = drawn.groupBy("shard").applyInArrow(_round(z, n, bits), "index long, z double, n double")
        total = changes.groupBy("index").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()  # at most 2 ** bits rows
        at = total.column("index").to_numpy()
        z[at] += total.column("z").to_numpy()
        n[at] += total.column("n").to_numpy()
    return _weights(z, n).astype(np.float32)


def score(
    docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: str = "score"
) -> DataFrame:
    """``out``, from 0 to 1, for every row, with ``id_col`` and the columns of
    ``keep`` (but for one named ``out``)."""
    bits = int(len(weights)).bit_length() - 1
    taken = list(dict.fromkeys(c for c in (id_col, *keep) if c != out))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in taken)

    def work(batches):
        for batch in batches:
            z = np.full(batch.num_rows, float(weights[0]))
            for begin, end, rows, index, weight in features(batch.column(len(taken)), bits):
                for own, at, x in zip(rows, index, weight, strict=True):
                    z[begin:end] += np.bincount(own, weights[at] * x, end - begin)
            scores = 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(taken)], pa.array(scores)], names=[*taken, out])

    rows = docs.select(*[F.col(c) for c in taken], whole(F.col(text_col)).alias("_whole_text"))
    return rows.mapInArrow(work, f"{fields}, `{out}` double")
