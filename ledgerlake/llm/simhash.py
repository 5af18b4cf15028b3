"""SimHash near-duplicates by multi-index hashing.

Each text gets a 64-bit fingerprint: a bit is set if it is set in more than
half of the hashes of its word shingles. Two texts are linked if their
fingerprints differ in at most so many bits. Fingerprints are stored under each
of their segments and looked up under all values within one bit of a segment;
whatever meets there is compared in all 64 bits.

* Three bits: two fingerprints that near agree in one of their two 32-bit halves
  up to one bit, so halves find every link.
* More bits need more and shorter segments, cut from further fingerprints of the
  same shingles; these find links with a probability that grows with the number
  of segments.

Equal fingerprints are one node, so copies never form pairs. Where many
fingerprints meet under one value, a task compares them in blocks and emits only
links that join what was apart, the closest ones first, never all pairs.

With ``similarity``, texts are linked by the Jaccard similarity of their sets of
word shingles. Nodes are the sets, so that texts which share a fingerprint and no
more are never taken for copies. Fingerprints linked as above at three bits, and
those shared, give the first pairs; as fingerprints alone miss pairs that are alike,
nodes also meet by ``minhash``. Each link is a pair whose sets were compared. Nodes
that meet are first compared with a few of those they meet, which joins most of
a large family; then all pairs that meet and are still apart are compared, so a
text stays alone only if none that it meets is alike.

Null texts count as empty; texts without words have fingerprint zero and are
linked like any other. Null ids are kept; a component is named by its smallest
id that isn't null. Rows that repeat keep one result row each. Other columns
are ignored.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import minhash
from ledgerlake.llm.text import mixed, whole
from ledgerlake.sources.shared import materialise

BITS = 3
SHINGLE = 3
SEED = 42
#: Turns in which nodes are compared with a few of those they meet, before all that are still apart.
TURNS = 2
_BLOCK = 1_000_000  # pairs compared at once
_MANY = 2_000  # rows behind a home from which on it is a block of its own
_HASHES = 1 << 16  # hashes whose bits are counted at once


def fingerprint(text: bytes, shingle: int = SHINGLE, further: int = 0) -> list[int]:
    """The fingerprint and ``further`` ones, from the same hashes mixed anew."""
    words = text.lower().split()  # A-Z and ASCII white space only, as these are bytes
    if not words:
        return [0] * (further + 1)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hash64 = xxhash.xxh64_intdigest
    ones = np.zeros((further + 1, 64), np.int64)
    for i in range(0, len(starts), _HASHES):
        spans = zip(starts[i : i + _HASHES].tolist(), ends[i : i + _HASHES].tolist(), strict=True)
        hashes = np.array([hash64(line[s:e], SEED) for s, e in spans], "<u8")
        for k in range(further + 1):
            own = mixed(hashes + np.uint64(k)) if k else hashes
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] += np.add.reduce(bits, axis=0, dtype=np.uint32).astype(np.int64)
    return np.packbits(ones * 2 > len(starts), axis=1, bitorder="little").view("<i8").ravel().tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, further: int = 0) -> DataFrame:
    """``id_col``, ``text_key`` (xxhash64 of the text), ``fingerprint`` (a
    long) and ``words`` (it and the further ones) of every row."""

    def work(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            found = [fingerprint(t.as_py(), shingle, further) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([x[0] for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["_id", "text_key", "fingerprint", "words"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"))
    rows = rows.select("_id", F.xxhash64("_text").alias("text_key"), "_text")
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(work, f"_id {kind}, text_key long, fingerprint long, words array<long>")
    return found.withColumnRenamed("_id", id_col)


def _blocks(homes, starts, ends):
    """Pairs of rows to compare: each home and the rows behind it under the
    same value (homes stand first), some at a time; a home of many rows alone."""
    first = np.flatnonzero(homes)
    group = np.searchsorted(starts, first, side="right") - 1
    rest = ends[group] - first - 1
    first, rest = first[rest > 0], rest[rest > 0]
    i = 0
    while i < len(first):
        n = max(1, int(np.searchsorted(np.cumsum(rest[i : i + _BLOCK]), _BLOCK, side="right")))
        if rest[i] > _MANY:
            n = 1
        else:
            large = np.flatnonzero(rest[i : i + n] > _MANY)
            n = int(large[0]) if len(large) else n
        left, count = first[i : i + n], rest[i : i + n]
        x = np.repeat(left, count)
        yield x, np.repeat(left + 1 - (np.cumsum(count) - count), count) + np.arange(len(x))
        i += n


def _top(up: list, x: int) -> int:
    while up[x] != x:
        up[x] = x = up[up[x]]
    return x


def _links(bits, steps):
    """``steps``: distances up to which links are joined one after the other."""

    def work(batches):
        held = None
        for batch in batches:
            now = [np.asarray(batch.column(i)) for i in range(3)]
            rows = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            # the last value may go on in the next batch
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            held = [x[cut:] for x in rows]
            yield from found([x[:cut] for x in rows])
        if held is not None:
            yield from found(held)

    def found(rows):
        values, rank, prints = rows
        if not len(values):
            return
        starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        ends = np.concatenate((starts[1:], [len(values)]))
        nodes, own = np.unique(prints, return_inverse=True)
        bare = nodes.view(np.uint64)
        up, links = list(range(len(nodes))), []
        root = np.arange(len(nodes))
        homes = rank == 0
        for most, (x, y) in ((s, p) for s in steps for p in _blocks(homes, starts, ends)):
            x, y = own[x], own[y]
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
            distance = np.bitwise_count(bare[x] ^ bare[y])
            near = np.flatnonzero(distance <= most)
            near = near[np.argsort(distance[near], kind="stable")]
            before = len(links)
            for a, b in zip(x[near].tolist(), y[near].tolist(), strict=True):
                p, q = _top(up, a), _top(up, b)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    links.append((a, b))
            if len(links) > before:
                root = np.array(up)
                while ((above := root[root]) != root).any():
                    root = above
        if links:
            a, b = np.array(links).T
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    return work


def links(nodes: DataFrame, bits: int = BITS, segment: int = 32) -> DataFrame:
    """Links ``a``, ``b`` between distinct ``fingerprint`` values that join
    those within ``bits`` of each other: not all such pairs, but a path for
    each. ``segment`` is the length of the segments that ``words`` are cut to."""
    each = 64 // segment
    segments = nodes.select("fingerprint", F.posexplode("words").alias("at", "word"))
    segments = segments.select("fingerprint", "at", "word", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("k"))
    value = F.expr(f"shiftrightunsigned(word, k * {segment}) & {(1 << segment) - 1}L")
    named = F.expr(f"shiftleft(cast(at * {each} + k as long), {segment})")
    # rank 0: the value itself, under which the fingerprint is stored
    around = segments.select("fingerprint", (value + named).alias("value"), F.explode(F.sequence(F.lit(0), F.lit(segment))).alias("rank"))
    looked = around.select(
        F.expr("CASE WHEN rank = 0 THEN value ELSE value ^ shiftleft(1L, rank - 1) END").alias("value"),
        (F.col("rank") > 0).cast("tinyint").alias("rank"),
        "fingerprint",
    )
    dealt = looked.repartition("value").sortWithinPartitions("value", "rank", "fingerprint")
    steps = [s for s in (4, 6, 8) if s < bits] + [bits]
    return dealt.mapInArrow(_links(bits, steps), "a long, b long").distinct()


def _signed(shingle, words):
    def work(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            sets = (minhash.shingles(t, words) for t in texts)
            found = [(minhash.set_key(x), minhash.minima(x).astype("<u4").tobytes()) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([fingerprint(t, shingle)[0] for t in texts], pa.int64()),
                    pa.array([x for x, _ in found], pa.int64()),
                    pa.array([x for _, x in found], pa.binary()),
                ],
                names=["_id", "text_key", "fingerprint", "node", "minima"],
            )

    return work


def _shingle_sets(words):
    def work(batches):
        for batch in batches:
            sets = [minhash.shingles(t.as_py(), words) for t in batch.column(1).cast(pa.large_binary())]
            places = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "shingles"])

    return work


def shingle_sets(chosen: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``node`` and ``shingles``, the set of each of the ``chosen`` nodes, from
    the text that it names (``_id``, ``text_key``)."""
    rows = docs.select(F.col(id_col).alias("_own"), whole(F.col(text_col)).alias("_text"))
    rows = rows.withColumn("_key", F.xxhash64("_text"))
    texts = rows.join(chosen, rows["_own"].eqNullSafe(chosen["_id"]) & (rows["_key"] == chosen["text_key"]))
    sets = texts.select("node", "_text").mapInArrow(_shingle_sets(words), "node long, shingles array<long>")
    return sets.dropDuplicates(["node"])


def alike(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The candidates ``a``, ``b`` whose sets have the Jaccard similarity."""
    side = lambda c, n: sets.select(F.col("node").alias(c), F.col("shingles").alias(n))
    both = candidates.join(side("a", "_x"), "a").join(side("b", "_y"), "b")
    both = both.withColumn("_same", F.size(F.array_intersect("_x", "_y")))
    whole_set = F.size("_x") + F.size("_y") - F.col("_same")
    return both.where((F.col("_same") > 0) & (F.col("_same") >= similarity * whole_set)).select("a", "b")


def components(pairs: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``root``, the smallest node that links lead to, of all
    nodes in the links ``a``, ``b``.

    Alternates between linking each node's larger neighbours and its smaller
    ones to the smallest, until nothing changes: some logarithm of the number
    of nodes in rounds, each written to the shared folder.
    """
    edges = materialise(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .filter("u > v")
            .distinct()
        )
        edges = materialise(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE,
    segment: int = 32, further: int = 0, similarity: float | None = None, words: int = 5,
) -> DataFrame:
    """Every row's ``id_col``, ``text_key`` (xxhash64 of its text),
    ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest
    id among the texts that links reach. With ``similarity``, links are between
    texts whose sets of shingles of ``words`` are that much alike; fingerprints then
    meet at three bits, and ``bits``, ``segment`` and ``further`` aren't used."""
    if similarity:
        return _alike_duplicates(docs, id_col, text_col, shingle, similarity, words)
    if bits > 3 and not further:
        raise ValueError("halves of one fingerprint find links of three bits; give further ones for more")
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, further), "simhash")
    nodes = prints.groupBy("fingerprint").agg(F.min(id_col).alias("_first"), F.min_by("words", "text_key").alias("words"))
    found = components(links(nodes, bits, segment), "simhash-links")
    prints = prints.select(F.col(id_col).alias("_id"), "text_key", "fingerprint", F.col("fingerprint").alias("node"))
    return _named(prints, nodes.select(F.col("fingerprint").alias("node"), "_first"), found, id_col)


def _named(prints: DataFrame, nodes: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """``prints`` (``_id``, ``text_key``, ``fingerprint``, ``node``) with the
    smallest id (``_first``) among the ``nodes`` of each root in ``found``."""
    found = found.select(F.col("node").alias("_linked"), "root")
    rooted = nodes.join(found, F.col("node") == F.col("_linked"), "left").select("node", "_first", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = materialise(rooted.join(named, "root").select("node", "component_id"), "simhash-components")
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return prints.join(named, "node").select(F.col("_id").alias(id_col), "text_key", shown, "component_id")


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of ``nodes`` (``node``, ``fingerprint``): one for each
    link between fingerprints, and those that share one with the first of them."""
    homes = nodes.groupBy("fingerprint").agg(F.min("node").alias("home"))
    homes = materialise(homes.select("fingerprint", F.array("fingerprint").alias("words"), "home"), "simhash-homes")
    near = links(homes)
    for side in ("a", "b"):
        home = homes.select(F.col("fingerprint").alias(side), F.col("home").alias(f"_{side}"))
        near = near.join(home, side)
    shared = nodes.join(homes, "fingerprint").filter("node <> home").select(F.col("home").alias("_a"), F.col("node").alias("_b"))
    pairs = near.select("_a", "_b").unionByName(shared)
    return pairs.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()


def _alike_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, words: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"))
    rows = rows.select("_id", F.xxhash64("_text").alias("text_key"), "_text")
    kind = docs.schema[id_col].dataType.simpleString()
    prints = rows.mapInArrow(_signed(shingle, words), f"_id {kind}, text_key long, fingerprint long, node long, minima binary")
    prints = materialise(prints, "minhash")
    nodes = prints.groupBy("node").agg(F.min("_id").alias("_first"), F.min(F.struct("_id", "text_key", "minima", "fingerprint")).alias("_n"))
    nodes = materialise(nodes.select("node", "_first", "_n.*"), "minhash-nodes")
    met = materialise(minhash.meetings(nodes), "minhash-meetings")
    near = materialise(_by_fingerprint(nodes.select("node", "fingerprint")), "simhash-links")
    paired = met.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node")))
    chosen = paired.distinct().join(nodes.select("node", "_id", "text_key"), "node")
    sets = materialise(shingle_sets(chosen, docs, id_col, text_col, words), "shingles")
    found, tested, linked = None, None, None
    for turn in range(TURNS + 1):
        if found is None:
            placed = met.withColumn("root", F.col("node"))
        else:
            known = found.select(F.col("node").alias("_linked"), "root")
            placed = met.join(known, F.col("node") == F.col("_linked"), "left").select("value", "node", F.coalesce("root", "node").alias("root"))
        pairs = minhash.to_centres(placed, turn) if turn < TURNS else minhash.across(placed, nodes, sets, similarity)
        if not turn:
            pairs = near.unionByName(pairs).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "minhash-candidates")
        good = materialise(alike(pairs, sets, similarity), "minhash-links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        linked = good if linked is None else linked.unionByName(good)
        found = components(linked, "minhash-components")
    return _named(prints.drop("minima"), nodes.select("node", "_first"), found, id_col)
