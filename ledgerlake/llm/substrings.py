"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

Every byte that a string of 100 bytes covers which also starts earlier (in a
row with a smaller id, or further left in the same row) is removed. Strings are
judged on the input; texts are taken as UTF-8 and matches never cross rows.

A suffix array of all positions would be many times the text, so it is sparse:
a suffix is kept where a 32-byte gram has the smallest hash of all grams in some
string of 100 bytes. Equal strings keep the same suffix at the same place, and
each string belongs to just one, so an entry stands for a run of neighbouring
strings. Its content is all bytes that these strings cover.

1. Each batch of texts gets its sorted suffix array. It is merge-scanned
   against the levels of its task: entries whose content stands in an earlier
   place are repeats as a whole. What is left becomes a new level, and levels of
   like size are merged, so there are logarithmically many.
2. What is left of all tasks is dealt by gram and sorted, which merges all
   families into one; one scan finds the first place of each content. All
   others are repeats.
3. Where one gram has different contents, their strings are compared one by
   one, in the same way: only these are looked up in the texts again.

Ids of an integer type that are distinct and not null number the rows;
otherwise rows are numbered in the order of ids (nulls first) and of hashes of
their texts, and rows with equal id and text are one document whose result each
of them gets. A null text is empty. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.rows import keyed, placed
from ledgerlake.llm.text import Spans, as_bytes, chunks, mixed, whole
from ledgerlake.sources.shared import materialise

LENGTH = 100
GRAM = 32
#: Entries that a task's levels hold at most; beyond it a new family begins, and the common scan finds the rest.
HELD = 600_000

_ENTRY = ["h", "content", "n", "s", "e"]


def suffixes(data: np.ndarray, places: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Entries of a chunk: where their strings start (first and last), the
    grams' hashes and the contents' hashes."""
    n, width = len(data) - length + 1, length - gram + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    spans = Spans(data)
    grams = np.arange(len(data) - gram + 1)
    value = spans.hash(grams, grams + gram)
    bits = np.uint64(int(len(grams)).bit_length())
    low = (value >> bits << bits) | grams.astype(np.uint64)
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[reach:], low[:-reach])
        reach *= 2
    if reach < width:
        low = np.minimum(low[width - reach :], low[: reach - width])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # strings that would cross the end of a row
    edge = np.zeros(len(data) + 1, np.int32)
    ends = places[1:]
    np.add.at(edge, np.maximum(ends - length + 1, places[:-1]), 1)
    np.add.at(edge, ends, -1)
    inside = np.cumsum(edge)[:n] == 0
    change = at[1:] != at[:-1]
    first = np.flatnonzero(inside & np.concatenate(([True], change | ~inside[:-1])))
    last = np.flatnonzero(inside & np.concatenate((change | ~inside[1:], [True])))
    content = spans.hash(first, last + length)
    return first, last, value[at[first]], mixed(content + (at[first] - first).astype(np.uint64))


def union(n, s, e):
    """Intervals [s, e) of rows n, sorted, with those that meet made one."""
    if not len(n):
        return n, s, e
    order = np.lexsort((s, n))
    n, s, e = n[order], s[order], e[order]
    head = np.concatenate(([True], n[1:] != n[:-1]))
    group = np.cumsum(head) - 1
    step = int(e.max()) + 1
    reach = np.maximum.accumulate(e + group * step) - group * step
    new = head | np.concatenate(([True], s[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return n[at], s[at], reach[np.concatenate((at[1:], [len(n)])) - 1]


class Levels:
    """Sorted arrays of contents with the place of each; every level is more
    than twice as large as the next."""

    def __init__(self):
        self.levels = []

    def repeats(self, content, h, n, s):
        """Which entries stand in a level, in an earlier place."""
        found = np.zeros(len(content), bool)
        for c, g, m, t in self.levels:
            at = np.minimum(np.searchsorted(c, content), len(c) - 1)
            found |= (c[at] == content) & (g[at] == h) & ((m[at] < n) | ((m[at] == n) & (t[at] < s)))
        return found

    def add(self, *run):
        """A run sorted by content."""
        if not len(run[0]):
            return
        while self.levels and len(self.levels[-1][0]) <= 2 * len(run[0]):
            both = [np.concatenate(x) for x in zip(self.levels.pop(), run, strict=True)]
            order = np.lexsort((both[3], both[2], both[0]))
            run = tuple(x[order] for x in both)
        self.levels.append(run)
        if sum(len(x[0]) for x in self.levels) > HELD:
            self.levels = []


def _batch(rows):
    """By column, as a record batch of the entries' schema."""
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(x).astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64)) for x in rows], names=_ENTRY
    )


def _entries(length, gram):
    """Entries that aren't known repeats, and intervals of those that are: for
    these, content is 0 and e is negative."""

    def work(batches):
        family = Levels()
        for batch in batches:
            number = batch.column(0).to_numpy()
            data, offsets = as_bytes(batch.column(1))
            for begin, end in chunks(offsets):
                places = offsets[begin : end + 1] - offsets[begin]
                first, last, h, content = suffixes(data[offsets[begin] : offsets[end]], places, length, gram)
                row = np.searchsorted(places, first, side="right") - 1
                n, s = number[begin + row], first - places[row]
                e = last - places[row] + length
                order = np.lexsort((s, n, content))
                first, h, content, n, s, e = (x[order] for x in (first, h, content, n, s, e))
                again = np.zeros(len(n), bool)
                again[1:] = (content[1:] == content[:-1]) & (h[1:] == h[:-1])
                again |= family.repeats(content, h, n, s)
                yield _batch([x[~again] for x in (h, content, n, s, e)])
                family.add(*(x[~again] for x in (content, h, n, s)))
                un, us, ue = union(n[again], s[again], e[again])
                yield _batch([mixed(un.view(np.uint64)), np.zeros(len(un), np.uint64), un, us, -ue])

    return work


def _scan(edges):
    """Over entries sorted by gram, content and place: all but the first of
    each content are repeats (h is 0 in what is returned). With ``edges``, also
    the first ones of grams that have more than one content."""

    def work(batches):
        last = None  # the last entry; whether its gram's first content is still to be given
        for batch in batches:
            h, content, n, s, e = (x.to_numpy() for x in batch.columns)
            known = e < 0
            out = [[n[known]], [s[known]], [-e[known]], [np.zeros(int(known.sum()), np.int64)]]
            h, content, n, s, e = (x[~known] for x in (h, content, n, s, e))
            if last is not None:
                h, content, n, s, e = (np.concatenate(([a], x)) for a, x in zip(last[0], (h, content, n, s, e), strict=True))
            if len(h):
                new_h = np.concatenate(([True], h[1:] != h[:-1]))
                new = new_h | np.concatenate(([True], content[1:] != content[:-1]))
                again = ~new
                carried = last is not None
                for x, values in zip(out, (n, s, e, np.zeros(len(n), np.int64)), strict=True):
                    x.append(values[again])
                if edges:
                    group = np.cumsum(new_h) - 1
                    contents = np.bincount(group, new)
                    given = new & (contents[group] > 1)
                    if carried and last[1] != "first":
                        # the carried entry's content was given, or is a later one of its gram
                        given |= new & (group == 0)
                        given[0] = False
                    for x, values in zip(out, (n, s, e, h), strict=True):
                        x.append(values[given])
                    # what a later batch has to know of the last gram
                    own = group == group[-1]
                    one = int(contents[-1]) == 1 and not (group[-1] == 0 and carried and last[1] != "first")
                    first = np.flatnonzero(own)[0]
                    if one:
                        last = ([x[first] for x in (h, content, n, s, e)], "first")
                    else:
                        last = ([x[-1] for x in (h, content, n, s, e)], "given")
                else:
                    last = ([x[-1] for x in (h, content, n, s, e)], "given")
            columns = [np.concatenate(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["n", "s", "e", "h"])

    return work


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(t.as_buffer()) for t in texts], pa.binary())], names=["n", "z"])


def _unpacked(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(z.as_buffer()) for z in column], pa.large_binary())


def _lists(column: pa.Array, fields):
    """Of a column of lists of structs: each element's row, and its fields."""
    column = column.cast(pa.large_list(column.type.value_type))
    first = column.offsets.to_numpy()
    values = column.values.slice(first[0], first[-1] - first[0])
    count = np.diff(first)
    if column.null_count:
        count = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, count)
    return np.repeat(np.arange(len(column)), count), *(np.asarray(values.field(f)) for f in fields)


def _strings(length):
    """For each entry of a text, the hashes of its strings."""

    def work(batches):
        for batch in batches:
            number = batch.column(0).to_numpy()
            data, offsets = as_bytes(_unpacked(batch.column(1)))
            row, s, e, h = _lists(batch.column(2), ("s", "e", "h"))
            for begin, end in chunks(offsets):
                a, b = np.searchsorted(row, [begin, end])
                spans = Spans(data[offsets[begin] : offsets[end]])
                starts = offsets[row[a:b]] - offsets[begin] + s[a:b]
                count = e[a:b] - s[a:b] - length + 1
                first = np.cumsum(count) - count
                at = np.repeat(starts - first, count) + np.arange(int(count.sum()))
                hashes = spans.hash(at, at + length).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate((first, [len(at)])).astype(np.int32)), pa.array(hashes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[a:b]), pa.array(number[row[a:b]]), pa.array(s[a:b]), lists], names=["h", "n", "s", "strings"]
                )

    return work


def _cut(batches):
    for batch in batches:
        data, offsets = as_bytes(_unpacked(batch.column(1)))
        row, s, e = _lists(batch.column(2), ("s", "e"))
        row, s, e = union(row, s, e)
        gone = np.zeros(len(data) + 1, np.int8)
        gone[offsets[row] + s] = 1
        gone[offsets[row] + e] -= 1
        left = np.cumsum(gone[:-1], dtype=np.int8) == 0
        until = np.concatenate(([0], np.cumsum(left)))[offsets]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(until.astype(np.int64)), pa.py_buffer(data[left])])
        size = np.diff(offsets)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(size),
                pa.array(size - np.diff(until)),
                pa.array(np.bincount(row, minlength=batch.num_rows)),
                kept.cast(pa.binary()),
            ],
            names=["n", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Distinct texts by number (``n``, ``_text``), and every row's ``_id`` and
    ``n``; None if the number is the id."""
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        ids = docs.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("rows"))
        if not ids.filter("rows > 1 OR _id IS NULL").limit(1).count():
            texts = docs.select(F.col(id_col).cast("long").alias("n"), whole(F.col(text_col)).alias("_text"))
            return texts, None
    rows = keyed(docs, id_col, text_col)
    numbers = placed(rows.select("_id", "_a", "_b").distinct(), "_id", "_a").select("_a", "_b", F.col("_place").alias("n"))
    numbers = materialise(numbers, "row-numbers")
    numbered = rows.join(numbers, ["_a", "_b"])
    texts = numbered.groupBy("n").agg(F.min("_text").alias("_text"))
    return texts, numbered.select("_id", "n")


def repeated(texts: DataFrame, packed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Intervals ``n``, ``s``, ``e`` of bytes that repeat earlier ones; they may overlap."""
    entry = "h long, content long, n long, s long, e long"
    verdict = "n long, s long, e long, h long"
    found = texts.select("n", "_text").mapInArrow(_entries(length, gram), entry)
    merged = found.repartition("h").sortWithinPartitions("h", "content", "n", "s")
    judged = materialise(merged.mapInArrow(_scan(True), verdict), "suffixes")
    edges = judged.filter("h <> 0").groupBy("n").agg(F.collect_list(F.struct("s", "e", "h")).alias("entries"))
    strings = packed.join(edges, "n").select("n", "z", "entries")
    strings = strings.mapInArrow(_strings(length), "h long, n long, s long, strings array<long>")
    # equal strings have one gram, so they are dealt out by themselves and a hot gram isn't one task
    each = strings.select("n", "s", F.posexplode("strings").alias("i", "h")).select("h", "n", (F.col("s") + F.col("i")).alias("s"))
    each = each.repartition("h").sortWithinPartitions("h", "n", "s")
    each = each.select("h", F.col("h").alias("content"), "n", "s", (F.col("s") + length).alias("e"))
    singles = each.mapInArrow(_scan(False), verdict)
    return judged.filter("h = 0").unionByName(singles).select("n", "s", "e")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` (runs of removed
    bytes) and ``kept`` (the remaining bytes) of every row."""
    texts, rows = _numbered(docs, id_col, text_col)
    packed = texts.mapInArrow(_packed, "n long, z binary")
    spans = repeated(texts, packed, length, gram).groupBy("n").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    whole_again = packed.join(spans, "n", "left").select("n", "z", "spans")
    out = whole_again.mapInArrow(_cut, "n long, n_bytes long, n_removed long, n_spans long, kept binary")
    if rows is None:
        kind = docs.schema[id_col].dataType
        return out.select(F.col("n").cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
    return rows.join(out, "n").select(F.col("_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
