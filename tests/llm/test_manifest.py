"""The Merkle manifest against a plain one."""

import brute
import cases
import pytest
from ledgerlake.llm import manifest, queries
from pyspark.sql import functions as F


def awkward():
    docs = cases.documents()
    docs = [(i, t, ["en", "de", None, "ü", ""][i % 5], s if i % 3 else None, n if i % 4 else None) for i, t, _, s, n in docs]
    docs += docs[:6] + [(None, "x", "en", None, 1), (None, None, None, None, None), (None, "x", "en", None, 1)]
    return docs


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_query(spark, tmp_path):
    docs = awkward()
    spark.createDataFrame(docs, cases.SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_manifest(spark, str(tmp_path))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    expected = brute.manifest(docs)
    assert rows(got, *names) == sorted(expected, key=repr)
    assert {r[6] for r in expected} == {True, False}


@pytest.mark.parametrize("fanout,levels,n", [(2, 1, 9), (2, 2, 33), (3, 2, 100), (5, 1, 26), (2, 3, 1)])
def test_many_rounds_of_small_blocks(spark, fanout, levels, n):
    docs = [(i, f"text {i}", f"l{i % 3 * (n > 30)}", "s", i) for i in range(n)]
    frame = spark.createDataFrame(docs, cases.SCHEMA)
    found = manifest.manifest(frame, queries.MANIFEST_FIELDS, fanout=fanout, levels=levels)
    expected = {r[0]: r for r in brute.manifest(docs, fanout)}
    folded = found.withColumn("folded", manifest.fold(F.col("leaf"), F.col("proof")))
    for r in folded.withColumn("all", manifest.siblings(F.col("proof"))).collect():
        assert (r.leaf, r.subroot, r.root, brute.sha(r["all"])) == expected[r.doc_id][1:5]
        assert r.folded == r.root


def test_one_group_of_equal_rows_and_clashing_columns(spark):
    docs = [(7, "same", "en", "s", 4)] * 40
    frame = spark.createDataFrame(docs, cases.SCHEMA)
    for name in ("_group", "_rank", "_leaf", "leaf", "root", "node", "h", "kids", "up", "_row", "_place", "proof"):
        frame = frame.withColumn(name, F.lit("x"))
    found = manifest.manifest(frame, queries.MANIFEST_FIELDS, levels=2, carry={"doc_id": F.col("doc_id"), "h": F.col("h"), "_group": F.col("node")})
    got = found.collect()
    assert len(got) == 40 and {(r.doc_id, r.h, r["_group"]) for r in got} == {(7, "x", "x")}
    assert {r.root for r in got} == {brute.manifest(docs)[0][3]}
    with pytest.raises(ValueError):
        manifest.manifest(frame, ["doc_id"], carry={"leaf": F.col("doc_id")})


def test_empty_table(spark):
    frame = spark.createDataFrame([], cases.SCHEMA)
    assert manifest.manifest(frame, queries.MANIFEST_FIELDS).count() == 0
