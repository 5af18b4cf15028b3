"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words of digits, letters a-z and all
characters beyond ASCII. A benchmark item is looked for in windows of 13 words;
an item of fewer words is one window. A document word inside an occurrence of
a window is hit.

Winnowing keeps the smallest hash of each run of neighbouring k-grams. Two
texts that share a span of ``t`` words keep the same k-gram in it, if k + run
- 1 = t. So documents and items are joined on kept hashes alone, and each hit is
extended to the windows around it, which are compared as text. Shorter items
have levels of their own, with a smaller ``t``; a level is only run if there
are such items.

* A null or wordless text has no words, no hits and isn't contaminated.
* A null item id isn't counted or listed; its windows still hit.
* Items that repeat count once by id; document rows that repeat each get a row.
* Other columns are ignored, so their names can't clash.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.text import Spans, as_bytes, chunks, mixed, runs, whole, window_minima
from ledgerlake.sources.shared import materialise

WINDOW = 13
#: (shortest span found, words in a hashed gram); runs have span - gram + 1 grams.
LEVELS = ((13, 5), (7, 4), (4, 2), (2, 1), (1, 1))
#: Bytes of benchmark hashes or windows that are sent to every executor; beyond it the join shuffles.
BROADCAST_BYTES = 16_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def _words(column):
    """By chunk: first row, the lower-cased bytes, and the words' rows, starts
    and ends in them; rows count from the chunk's first."""
    data, offsets = as_bytes(column)
    for begin, end in chunks(offsets):
        some = _LOWER[data[offsets[begin] : offsets[end]]]
        places = offsets[begin : end + 1] - offsets[begin]
        starts, ends = runs(_IS_WORD[some], places)
        rows = np.searchsorted(places, starts, side="right") - 1
        yield begin, end, some, rows, starts, ends


def _kept(hashes, rows, level):
    """Winnowing: places (of words) whose grams are kept, and their hashes."""
    span, gram = LEVELS[level]
    n = len(hashes) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for i in range(gram):
        value = value * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    value = mixed(value + np.uint64(level))
    width = span - gram + 1
    lowest = window_minima(value, width)
    # only spans of words of one row
    inside = rows[: len(lowest)] == rows[span - 1 : span - 1 + len(lowest)]
    mark = np.zeros(n, bool)
    mark[lowest[inside]] = True
    places = np.flatnonzero(mark)
    return places, value[places]


def _cut(data, starts, ends):
    return [data[s:e].tobytes().decode("utf-8") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def _level(n_words):
    return next(i for i, (span, _) in enumerate(LEVELS) if n_words >= span)


def _prints(levels, headers):
    """Rows of hash, level and place for each row's kept grams; with
    ``headers``, also a row of place -1 that has the number of words as level."""

    def work(batches):
        for batch in batches:
            for begin, end, data, rows, starts, ends in _words(batch.column(2)):
                hashes = Spans(data).hash(starts, ends)
                first = np.searchsorted(rows, np.arange(end - begin + 1))
                out = []
                if headers:
                    out.append((np.arange(end - begin), np.zeros(end - begin, np.uint64), np.diff(first), np.full(end - begin, -1)))
                for level in levels:
                    places, values = _kept(hashes, rows, level)
                    own = rows[places]
                    out.append((own, values, np.full(len(own), level), places - first[own]))
                own, values, level, place = (np.concatenate(x) for x in zip(*out, strict=True))
                picked = pa.array(own + begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(picked),
                        batch.column(1).take(picked),
                        pa.array(values.view(np.int64)),
                        pa.array(level.astype(np.int32)),
                        pa.array(place.astype(np.int32)),
                    ],
                    names=["_id", "_key", "hash", "level", "place"],
                )

    return work


def _item_windows(batches):
    """The windows of each item, their numbers of words and the grams that winnowing keeps there."""
    for batch in batches:
        out = ([], [], [])
        for begin, end, data, rows, starts, ends in _words(batch.column(1)):
            first = np.searchsorted(rows, np.arange(end - begin + 1))
            for row in np.flatnonzero(np.diff(first)):
                words = _cut(data, starts[first[row] : first[row + 1]], ends[first[row] : first[row + 1]])
                n = min(WINDOW, len(words))
                windows = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
                out[0].extend([begin + int(row)] * len(windows))
                out[1].extend(windows)
                out[2].extend([n] * len(windows))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())],
            names=["item", "window", "size"],
        )


def _item_prints(batches):
    for batch in batches:
        found = set()
        for begin, end, data, rows, starts, ends in _words(batch.column(0)):
            hashes = Spans(data).hash(starts, ends)
            first = np.searchsorted(rows, np.arange(end - begin + 1))
            for row in np.flatnonzero(np.diff(first)):
                at = slice(first[row], first[row + 1])
                level = _level(at.stop - at.start)
                _, values = _kept(hashes[at], rows[at], level)
                found.update((int(v), level) for v in values.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int32())], names=["hash", "level"]
        )


def _extended(sizes):
    """Every window around a row's hits, as text. ``sizes``: by level, the
    numbers of words that its items' windows have."""

    def work(batches):
        for batch in batches:
            hits = batch.column(3).to_pylist()
            out = ([], [], [], [])
            for begin, end, data, rows, starts, ends in _words(batch.column(2)):
                first = np.searchsorted(rows, np.arange(end - begin + 1))
                for row in range(end - begin):
                    s, e = starts[first[row] : first[row + 1]], ends[first[row] : first[row + 1]]
                    seen = set()
                    for hit in hits[begin + row]:
                        gram = LEVELS[hit["level"]][1]
                        for size in sizes.get(hit["level"], ()):
                            low, high = max(0, hit["place"] + gram - size), min(hit["place"], len(s) - size)
                            seen.update((i, size) for i in range(low, high + 1))
                    if seen:
                        words = _cut(data, s, e)
                        for at, size in seen:
                            out[0].append(begin + row)
                            out[1].append(at)
                            out[2].append(size)
                            out[3].append(" ".join(words[at : at + size]))
            picked = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(picked),
                    batch.column(1).take(picked),
                    pa.array(out[1], pa.int32()),
                    pa.array(out[2], pa.int32()),
                    pa.array(out[3], pa.string()),
                ],
                names=["_id", "_key", "place", "size", "window"],
            )

    return work


def _joined(left, right, on, how, size):
    """``right`` has ``size`` bytes: sent to every executor only if that is little."""
    return left.join(F.broadcast(right) if size <= BROADCAST_BYTES else right, on, how)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: each row's ``_id``, ``_key`` (a hash of its text) and
    ``n_words``; the windows that occur (``_id``, ``_key``, ``place``, ``size``
    in words, ``window``); the items' windows (``item``, ``window``)."""
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"))
    rows = rows.select("_id", F.xxhash64("_text").alias("_key"), "_text")

    texts = items.select(F.col(item_col).alias("item"), whole(F.col(item_text)).alias("text"))
    windows = texts.mapInArrow(_item_windows, f"item {item_kind}, window string, size int").distinct()
    windows = materialise(windows, "benchmark-windows")
    prints = materialise(texts.select("text").mapInArrow(_item_prints, "hash long, level int").distinct(), "benchmark-prints")
    # 16 bytes a row, and a window's text
    prints_size = 16 * prints.count()
    windows_size = windows.agg(F.coalesce(F.sum(F.octet_length("window") + 16), F.lit(0))).first()[0]
    # at most one row for each number of words up to the window
    sizes: dict[int, list[int]] = {}
    for (size,) in windows.select("size").distinct().collect():
        sizes.setdefault(_level(size), []).append(size)

    found = rows.mapInArrow(
        _prints(sorted(sizes), headers=True), f"_id {kind}, _key long, hash long, level int, place int"
    )
    known = prints.select("hash", "level", F.lit(True).alias("known"))
    found = _joined(found, known, ["hash", "level"], "left", prints_size).filter("known OR place < 0")
    found = materialise(found.select("_id", "_key", "level", "place"), "prints")
    heads = found.filter("place < 0").select("_id", "_key", F.col("level").cast("long").alias("n_words"))
    hits = found.filter("place >= 0").groupBy("_id", "_key").agg(F.collect_set(F.struct("level", "place")).alias("hits"))

    same = rows["_id"].eqNullSafe(hits["_id"]) & (rows["_key"] == hits["_key"])
    near = rows.join(hits, same).select(rows["_id"], rows["_key"], "_text", "hits")
    around = near.mapInArrow(_extended(sizes), f"_id {kind}, _key long, place int, size int, window string")
    occurring = _joined(around, windows.select("window").distinct(), "window", "left_semi", windows_size)
    return heads, materialise(occurring, "benchmark-hits"), windows.select("item", "window").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every row's ``id_col``, ``text_key`` (xxhash64 of its text), ``n_words``,
    ``n_hit``, ``n_items``, ``items`` (sorted ids as text) and ``contaminated``:
    at least one word hit, and at least a twentieth of them."""
    heads, hits, windows = matches(docs, items, id_col, text_col, item_col, item_text)
    spans = F.sort_array(F.collect_set(F.struct(F.col("place").alias("s"), (F.col("place") + F.col("size")).alias("e"))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["to"]))).cast("long").alias("n"),
            F.greatest(acc["to"], x["e"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )
    hit = hits.groupBy("_id", "_key").agg(spans.alias("spans")).select("_id", "_key", covered.alias("n_hit"))
    named = (
        hits.select("_id", "_key", "window").distinct().join(windows.filter("item IS NOT NULL"), "window")
        .select("_id", "_key", F.col("item").cast("string").alias("item")).distinct()
        .groupBy("_id", "_key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    both = hit.join(named, hit["_id"].eqNullSafe(named["_id"]) & (hit["_key"] == named["_key"]), "left")
    both = materialise(both.select(hit["_id"], hit["_key"], "n_hit", "items"), "benchmark-counts")
    joined = heads.join(both, heads["_id"].eqNullSafe(both["_id"]) & (heads["_key"] == both["_key"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        heads["_id"].alias(id_col),
        heads["_key"].alias("text_key"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        listed.alias("items"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )
