"""Merkle manifest: a root over all rows, and for each row the siblings that lead
from its leaf to the root.

A leaf is the hash of a row's fields. Within each group the leaves ascend by id;
every ``fanout`` neighbours become the hash of their hashes (the last run may be
shorter, also a single one) until one is left, the group's subroot. The subroots,
ordered by group (null first, then by UTF-8 bytes), likewise become the root.

The rank of a leaf is a number of base ``fanout``. Rows are dealt once into blocks
of ``fanout ** levels`` neighbours and sorted by their digits; then one digit column
after the other is grouped away, each group's rows becoming the children in its
row's struct, until a block is one nested struct. All these groupings run on the
one exchange and the one sort of the block. The blocks' hashes are leaves of the
next round, so memory is bounded by a block however many rows a group has. On the
way down, a block meets the path of its own root in one grouping by its number, and
a transform over the nested structs and an explode give each leaf its siblings;
nothing is joined.

Rows without an id come first in their group; rows of equal ids ascend by leaf, and
equal leaves take any order, which changes nothing. Repeated rows are leaves each.
An empty table has no rows and no root. Columns that aren't asked for are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.llm.rows import placed
from ledgerlake.sources.shared import materialise

FANOUT = 2
#: Levels of a block: 1024 leaves of a binary tree.
LEVELS = 10

#: Columns of the result beside those that are carried.
RESULT = ["leaf", "proof", "subroot", "root"]


def leaf_hash(values: list[Column]) -> Column:
    """Hash of a row: each value as its UTF-8 length, a colon and itself; ``-``
    if it is null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``_rank`` (from 0) and ``_total`` within ``_group``.

    Only one row per partition and group is counted, so a group may hold all rows;
    equal rows are told apart by a number, so they spread as well.
    """
    numbered = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    dealt = materialise(placed(numbered, "_group", *order, "_row"), "leaves-in-order")
    parts = dealt.groupBy("_part", "_group").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    group = W.partitionBy("_group")
    before = F.sum("_rows").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(
        "_part", "_group", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("_total")
    )
    joined = dealt.join(parts, ["_part", "_group"])
    return joined.withColumn("_rank", F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift", "_row")


def _blocks(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """One row per block: ``_group``, ``_total``, ``_block`` and its nested ``node``."""
    digits = [F.expr(f"_rank div {fanout**k} % {fanout}").alias(f"_d{k}") for k in range(levels)]
    rows = nodes.select("_group", "_total", F.expr(f"_rank div {fanout**levels}").alias("_block"), *digits, "node")
    keys = ["_group", "_total", "_block", *[f"_d{k}" for k in reversed(range(levels))]]
    rows = rows.repartition("_group", "_block").sortWithinPartitions(*keys)
    for k in range(levels):
        digit = F.col(keys.pop())
        kids = [F.first(F.when(digit == j, F.col("node")), ignorenulls=True) for j in range(fanout)]
        rows = rows.groupBy(*keys).agg(F.array_compact(F.array(*kids)).alias("kids"))
        # a level that has one node left is not hashed again
        hashed = F.col("_total") > fanout**k
        joined = F.array_join(F.transform("kids", lambda x: x["h"]), "")
        h = F.when(hashed, F.sha2(joined, 256)).otherwise(F.col("kids")[0]["h"])
        rows = rows.select(*keys, F.struct(h.alias("h"), hashed.alias("hashed"), "kids").alias("node"))
    return rows


def _tree(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Blocks of the leaves, blocks of their roots, and so on up to one block a group."""
    size = fanout**levels
    rounds = []
    while True:
        rounds.append(materialise(_blocks(nodes, fanout, levels), "blocks"))
        largest = rounds[-1].agg(F.max("_total")).first()[0] or 0
        if largest <= size:
            return rounds
        node = F.struct(F.col("node.h").alias("h"), F.struct(F.col("_block").alias("at")).alias("leaf"))
        total = F.expr(f"(_total + {size - 1}) div {size}").alias("_total")
        nodes = rounds[-1].select("_group", total, F.col("_block").alias("_rank"), node.alias("node"))


def _proofs(node: Column, levels: int, path: Column) -> Column:
    """Array of a block's leaves, each with its path."""
    if not levels:
        return F.array(F.struct(node["h"].alias("h"), node["leaf"].alias("leaf"), path.alias("path")))
    kids = node["kids"]

    def beside(start: Column, n: Column) -> Column:
        return F.array_join(F.transform(F.slice(kids, start, n), lambda x: x["h"]), "")

    def each(kid: Column, i: Column) -> Column:
        step = F.struct(beside(F.lit(1), i).alias("before"), beside(i + 2, F.size(kids)).alias("after"))
        return _proofs(kid, levels - 1, F.concat(F.array(F.when(node["hashed"], step)), path))

    return F.flatten(F.transform(kids, each))


def _leaves(blocks: DataFrame, up: DataFrame, levels: int) -> DataFrame:
    """Each leaf of the blocks with its path to the root. ``up``: of each block
    (``_group``, ``_block``) a struct that holds the path from its root on."""
    own = blocks.select("_group", "_block", "node", F.lit(None).cast(up.schema["up"].dataType).alias("up"))
    above = up.select("_group", "_block", F.lit(None).cast(blocks.schema["node"].dataType).alias("node"), "up")
    both = own.unionByName(above).groupBy("_group", "_block")
    met = both.agg(F.first("node", ignorenulls=True).alias("node"), F.first("up", ignorenulls=True).alias("up"))
    found = F.explode(_proofs(F.col("node"), levels, F.col("up.path")))
    return met.select("_group", "up", found.alias("_found")).select("_group", "up", "_found.*")


def _descend(rounds: list[DataFrame], up: DataFrame, levels: int) -> DataFrame:
    """From the last round's paths down to the first round's leaves."""
    rest = [f.name for f in up.schema["up"].dataType.fields if f.name != "path"]
    for blocks in reversed(rounds[1:]):
        leaves = _leaves(blocks, up, levels)
        below = F.struct("path", *[F.col("up")[c].alias(c) for c in rest])
        up = leaves.select("_group", F.col("leaf.at").alias("_block"), below.alias("up"))
    return _leaves(rounds[0], up, levels)


def manifest(
    docs: DataFrame,
    fields: list[str],
    id_col: str = "doc_id",
    group_col: str = "lang",
    carry: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: the columns of ``carry`` (names and what they
    are of ``docs``; the id by default), ``leaf`` (hash of ``fields``), ``proof``
    (array of the siblings before and after, from the leaf up), ``subroot`` and
    ``root``. ``fold(leaf, proof)`` is the root."""
    carry = carry or {id_col: F.col(id_col)}
    if set(carry) & set(RESULT):
        raise ValueError(f"names of the result: {RESULT}")
    # null first, then by bytes
    group = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(
        group.alias("_group"),
        F.col(id_col).alias("_id"),
        leaf_hash([F.col(c) for c in fields]).alias("_h"),
        F.struct(*[c.alias(name) for name, c in carry.items()]).alias("_leaf"),
    )
    node = F.struct(F.col("_h").alias("h"), F.col("_leaf").alias("leaf")).alias("node")
    within = _tree(_ranked(rows, ["_id", "_h"]).select("_group", "_total", "_rank", node), fanout, levels)
    subroots = within[-1].select(F.lit("").alias("_group"), F.col("_group").alias("_name"), F.col("node.h").alias("_h"))
    named = F.struct(F.col("_h").alias("h"), F.struct("_name").alias("leaf")).alias("node")
    over = _tree(_ranked(subroots, ["_name"]).select("_group", "_total", "_rank", named), fanout, levels)
    no_path = F.expr("cast(array() as array<struct<before:string,after:string>>)")
    start = over[-1].select("_group", "_block", F.struct(no_path.alias("path"), F.col("node.h").alias("root")).alias("up"))
    tops = _descend(over, start, levels)
    up = F.struct("path", F.col("h").alias("subroot"), F.col("up.root").alias("root"))
    found = _descend(within, tops.select(F.col("leaf._name").alias("_group"), F.lit(0).cast("long").alias("_block"), up.alias("up")), levels)
    return found.select(
        *[F.col("leaf")[name].alias(name) for name in carry],
        F.col("h").alias("leaf"),
        F.array_compact("path").alias("proof"),
        F.col("up.subroot").alias("subroot"),
        F.col("up.root").alias("root"),
    )
