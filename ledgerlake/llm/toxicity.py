"""Toxicity classifier that doesn't mind which group a text names.

A logistic regression on hashed words and word beginnings, trained by
follow-the-regularised-leader with counterfactual pairs: in every labelled text
that names an identity group, the terms are swapped for others of the same kind
(``GROUPS``), and the squared difference of both scores is a penalty beside the
log loss. A group that is mostly named in toxic texts of the labels thereby gets
no weight of its own, and neutral mentions of it are not held against a text.

Words are runs of letters and digits (any character beyond ASCII counts as one),
A-Z lower-cased. Each word of a text has its share of the text's words as its
value, but ``MOST`` at most, so that neither a very short text nor one that repeats
a word rests on that word alone. A feature, which is a word or a beginning of
``BEGINNINGS`` bytes, has the sum of its words' values, times ``SCALE``. Ids,
languages and sources are never features.

Training uses a bounded sample of the labelled rows (``rows``, drawn by a hash of
the id), cut into shards that each run over their rows from the common state; the
mean of their changes, a table of at most ``2 ** bits`` rows, gives the next one.

A null or empty text has the bias alone. Labels that are null are left out; of
labels that repeat, or differ, for an id the smallest counts. If no label is left
every score is 0.5. Rows that repeat are scored each; other columns are ignored.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.text import Spans, as_bytes, chunks, mixed, runs, whole
from ledgerlake.sources.shared import materialise

BITS = 18
#: Lengths in bytes of the word beginnings that are features beside the word.
BEGINNINGS = (3, 4, 5, 6)
MOST = 0.02
SCALE = 50.0
#: Labelled rows that are used for training at most.
SAMPLE_ROWS = 12_000
SHARDS = 6
ROUNDS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.5, 1e-3
#: Weight of the squared difference between a text's score and its counterfactual's.
FAIRNESS = 1.0

#: Terms that may stand for each other without making a text more or less toxic.
GROUPS = [
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("american", "german", "french", "spanish", "mexican", "chinese", "turkish", "polish"),
    ("immigrants", "refugees", "natives"), ("deaf", "blind", "disabled"), ("old", "young"),
    ("frauen", "männer"), ("christen", "muslime", "juden", "hindus"), ("deutsche", "türken", "polen", "franzosen"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs", "hindous"), ("français", "allemands", "arabes", "espagnols"),
    ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos", "hindúes"), ("españoles", "mexicanos", "franceses", "alemanes"),
]

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Swaps:
    """Texts with their identity terms swapped, by a turn of each group."""

    def __init__(self, groups: list[tuple[str, ...]]):
        self.place = {term: (group, i) for group in groups for i, term in enumerate(group)}
        # longest first, and no letter, digit or character beyond ASCII beside it
        terms = sorted(map(re.escape, self.place), key=len, reverse=True)
        edge = "[0-9A-Za-z\x80-\U0010ffff]"
        self.pattern = re.compile(f"(?<!{edge})(?:{'|'.join(terms)})(?!{edge})", re.IGNORECASE | re.ASCII) if terms else None

    def swapped(self, text: str, turn: int) -> str | None:
        """``text`` with each term replaced by the one ``turn`` places on; None
        if it names no group."""

        def other(found):
            term = found[0].lower()
            if term not in self.place:
                return found[0]
            group, i = self.place[term]
            return group[(i + 1 + turn % (len(group) - 1)) % len(group)]

        out = self.pattern.sub(other, text) if self.pattern else text
        return out if out != text else None


def features(texts: pa.Array, bits: int):
    """By chunk: first row, last row + 1, and of each different word of a row
    that row, the indexes of its features (one column each; 0, the bias, where
    the word is too short for a beginning), and its value."""
    data, offsets = as_bytes(texts)
    lowest = np.uint64((1 << bits) - 1)
    for begin, end in chunks(offsets):
        some = _LOWER[data[offsets[begin] : offsets[end]]]
        places = offsets[begin : end + 1] - offsets[begin]
        starts, ends = runs(_IS_WORD[some], places)
        rows = np.searchsorted(places, starts, side="right") - 1
        per_row = np.bincount(rows, minlength=end - begin)
        spans = Spans(some)
        _, word = np.unique(spans.hash(starts, ends), return_inverse=True)
        _, first, times = np.unique(rows * (len(starts) + 1) + word, return_index=True, return_counts=True)
        starts, ends, rows = starts[first], ends[first], rows[first]
        columns = [spans.hash(starts, ends)]
        columns += [spans.hash(starts, np.minimum(starts + n, ends)) for n in BEGINNINGS]
        index = np.empty((len(starts), len(columns)), np.int64)
        for k, hashes in enumerate(columns):
            index[:, k] = (mixed(hashes + np.uint64(k)) >> np.uint64(64 - bits)) % lowest + np.uint64(1)
            if k:
                index[ends - starts < BEGINNINGS[k - 1], k] = 0
        yield begin, end, rows, index, SCALE * np.minimum(times / per_row[rows], MOST)


def _weights(z, n):
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _vectors(texts: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indexes and values of each text, without the bias."""
    out = []
    for begin, end, rows, index, value in features(pa.array(texts, pa.string()), bits):
        first = np.searchsorted(rows, np.arange(end - begin + 1))
        for row in range(end - begin):
            at = slice(first[row], first[row + 1])
            own, where = np.unique(index[at], return_inverse=True)
            x = np.bincount(where.ravel(), np.repeat(value[at], index.shape[1]), len(own))
            keep = own > 0
            out.append((own[keep], x[keep]))
    return out


def _step(z, n, own, gradient):
    w = _weights(z[own], n[own])
    z[own] += gradient - (np.sqrt(n[own] + gradient * gradient) - np.sqrt(n[own])) / ALPHA * w
    n[own] += gradient * gradient


def learn(z, n, texts, labels, bits, swaps, turn, fairness):
    """One pass over the rows, in their order. Each row takes a step on its log
    loss; one that names a group also takes a step on
    ``fairness * (score - counterfactual score) ** 2``, scores before the sigmoid."""
    others = [swaps.swapped(t, turn) if fairness else None for t in texts]
    named = [i for i, t in enumerate(others) if t is not None]
    own_of = _vectors(texts, bits)
    other_of = dict(zip(named, _vectors([others[i] for i in named], bits), strict=True)) if named else {}
    for i, (own, x) in enumerate(own_of):
        at, values = np.concatenate(([0], own)), np.concatenate(([1.0], x))
        p = 1.0 / (1.0 + np.exp(-np.clip(_weights(z[at], n[at]) @ values, -35, 35)))
        _step(z, n, at, (p - labels[i]) * values)
        if i in other_of:
            other, y = other_of[i]
            both, where = np.unique(np.concatenate((own, other)), return_inverse=True)
            change = np.bincount(where, np.concatenate((x, -y)), len(both))
            both, change = both[change != 0], change[change != 0]
            apart = _weights(z[both], n[both]) @ change
            _step(z, n, both, 2.0 * fairness * apart * change)


def _round(state_z, state_n, bits, groups, turn, fairness):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("text", "ascending")])
        z, n = state_z.copy(), state_n.copy()
        labels = table.column("label").to_numpy()
        learn(z, n, table.column("text").to_pylist(), labels, bits, Swaps(groups), turn, fairness)
        changed = np.flatnonzero((z != state_z) | (n != state_n))
        return pa.table({"index": changed, "z": (z - state_z)[changed], "n": (n - state_n)[changed]})

    return work


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of training: crc32 of its id as text leaves 1
    when divided by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``order``, ``text`` and ``label`` of the training rows."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_label_id")).agg(F.min(label_col).cast("double").alias("label"))
    known = known.withColumn("order", F.xxhash64("_label_id")).orderBy("order", "_label_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("text"))
    # bounded by ``rows``
    drawn = texts.join(F.broadcast(known), F.col("_id") == F.col("_label_id"))
    return drawn.groupBy("_id").agg(F.min("order").alias("order"), F.min("text").alias("text"), F.min("label").alias("label"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = SAMPLE_ROWS,
    bits: int = BITS,
    rounds: int = ROUNDS,
    groups: list[tuple[str, ...]] = GROUPS,
    fairness: float = FAIRNESS,
) -> np.ndarray:
    """The weights: the bias, then ``2 ** bits - 1`` of features. Every round
    swaps by another turn of the groups."""
    drawn = sample(docs, labels, id_col, text_col, label_col, rows)
    shard = F.pmod("order", F.lit(SHARDS)).cast("int")
    drawn = materialise(drawn.select("order", "text", "label", shard.alias("shard")), "toxicity-sample")
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    for turn in range(rounds):
        work = _round(z, n, bits, groups, turn, fairness)
        changes = drawn.groupBy("shard").applyInArrow(work, "index long, z double, n double")
        total = changes.groupBy("index").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()  # at most 2 ** bits rows
        at = total.column("index").to_numpy()
        z[at] += total.column("z").to_numpy() / SHARDS
        n[at] += total.column("n").to_numpy() / SHARDS
    return _weights(z, n).astype(np.float32)


def logits(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Scores before the sigmoid."""
    bits = int(len(weights)).bit_length() - 1
    feature_weights = weights.copy()
    feature_weights[0] = 0.0
    z = np.full(len(texts), float(weights[0]))
    for begin, end, rows, index, value in features(texts, bits):
        z[begin:end] += np.bincount(rows, feature_weights[index].sum(axis=1) * value, end - begin)
    return z


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``score`` from 0 to 1 for every row, with ``id_col`` and the columns of
    ``keep``; one named ``score`` among these is kept as it is, and the result
    is then ``toxicity_score``."""
    taken = list(dict.fromkeys((id_col, *keep)))
    out = "toxicity_score" if "score" in taken else "score"
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in taken)

    def work(batches):
        for batch in batches:
            z = logits(batch.column(len(taken)), weights)
            scores = 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(taken)], pa.array(scores)], names=[*taken, out])

    rows = docs.select(*[F.col(c) for c in taken], whole(F.col(text_col)).alias("_whole_text"))
    return rows.mapInArrow(work, f"{fields}, `{out}` double")
