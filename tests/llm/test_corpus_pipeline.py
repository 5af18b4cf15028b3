"""Each stage of the pipeline against a plain version, on what the one before kept."""

import math
import random
from collections import defaultdict

import brute
import cases
import corpus_pipeline
import pytest
from ledgerlake.llm import quality, queries
from ledgerlake.sources.shared import materialise
from pyspark.sql import functions as F


def corpus():
    """Documents with junk, boilerplate, near copies and benchmark passages, and the other tables."""
    rng = random.Random(12)
    notice = "This notice stands below every page of the site."
    item = cases.words(rng, 30)
    docs = []
    for i in range(160):
        text = cases.words(rng, rng.choice([20, 60, 200]))
        if i % 4 == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 20 == 2:
            text += "\n" + item
        docs.append((i, f"{text}\n{notice}", "en", f"site{i % 14}"))
    for k in range(12):
        base = docs[4 * k + 3][1].split("\n")[0].split()
        for j in range(3):
            some = list(base)
            some[(7 * j) % len(some)] = "other"
            docs.append((200 + 3 * k + j, " ".join(some), "en", f"site{j}"))
    docs += [(300, None, "en", "site1"), (301, "", "en", None), (302, docs[3][1], "de", "site2"), (303, cases.words(rng, 9000), "en", "site3")]
    docs = [(*row, len(row[1] or "")) for row in docs]
    labels = [(i, int(i % 4 != 1), 0) for i in range(160)]
    return docs, [(1, item), (2, None)], labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, items, labels = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, tables):
    """The input of every stage, and the last one's result."""
    frames = [spark.read.parquet(f"{tables}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(materialise(stage(spark, frames[-1], tables), name))
    return frames


def texts(frame):
    return {r.doc_id: r.text or "" for r in frame.select("doc_id", "text").collect()}


def test_stages_return_the_columns_of_documents(steps):
    for frame in steps[1:-1]:
        assert frame.columns == steps[0].columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_filter", "line_dedup", "near_duplicates", "benchmark_decontamination", "best_fit_packing",
    ]


def test_quality_filter_drops_what_the_classifier_rejects(spark, tables, steps):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    scored = quality.score(steps[0], quality.train(steps[0], labels)).where("score >= 0.3")
    kept = texts(steps[1])
    assert kept.keys() == {r.doc_id for r in scored.collect()}
    assert sum((i in kept) == (i % 4 != 1) for i in range(160)) >= 0.95 * 160


def test_line_dedup(steps):
    before = steps[1].collect()
    gone = brute.boilerplate([(r.text, r.source) for r in before])
    assert gone
    expected = {}
    for r in before:
        lines = (r.text or "").split("\n")
        left = [x for x in lines if x.strip(" ") not in gone]
        expected[r.doc_id] = "\n".join(left if any(x.strip(" ") for x in left) else lines)
    assert texts(steps[2]) == expected
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_one_document_of_each_group_stays(steps):
    before, kept = texts(steps[2]), texts(steps[3])
    sets = {i: brute.shingles(t) for i, t in before.items()}
    up = {i: i for i in before}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in before:
        for b in before:
            if a < b and (brute.jaccard(sets[a], sets[b]) >= 0.8 or before[a] == before[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    assert kept.keys() == {top(i) for i in before}
    assert len(kept) < len(before)


def test_contaminated_documents_go(spark, tables, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    before = texts(steps[3])
    bad = {r[0] for r in brute.contamination(before.items(), items) if r[5]}
    assert bad and texts(steps[4]).keys() == before.keys() - bad


def test_all_that_is_left_is_packed(steps):
    placed = defaultdict(list)
    for r in steps[5].collect():
        placed[r.sequence_id].append((r.offset, r.length))
    assert {r.doc_id for r in steps[5].select("doc_id").collect()} == texts(steps[4]).keys()
    total = 0
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
        total += end
    assert len(placed) == math.ceil(total / 4096)


def test_run_applies_the_stages(spark, tables, steps):
    got = corpus_pipeline.run(spark, tables)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, steps[5].select(columns).collect()))


def test_stages_on_nulls_repeats_and_empty_tables(spark, tables):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "some words that repeat here and there " * 8
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, text, "en", "s", 1), (None, None, None, None, None), (2, "", "", "", 0)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema).withColumn("text_key", F.lit("x")).withColumn("score", F.lit("y"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, tables)
            n = out.count()
            if name == "near_duplicates":
                # the row that repeats stays once; rows without an id stay
                assert n == len(table) - (1 if table else 0)
            elif not table:
                assert n == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_columns_named_like_our_own_are_kept(spark, tables, name, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id < 60 OR doc_id > 200")
    plain = stage(spark, docs, tables)
    own = ["score", "quality_score", "n_lines", "n_removed", "text_key", "_id", "row", "bad_id", "component_id", "contaminated"]
    clashing = docs
    for c in own:
        clashing = clashing.withColumn(c, F.concat(F.lit("own"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    got = stage(spark, clashing, tables)
    key = ["doc_id", "piece", "length"] if name == "best_fit_packing" else docs.columns
    assert sorted(map(repr, got.select(key).collect())) == sorted(map(repr, plain.select(key).collect()))
    if name != "best_fit_packing":
        assert got.columns == clashing.columns
        assert all(r[c] == f"own{r.doc_id}" for r in got.collect() for c in own)


def test_lines_agree_with_their_sql(spark, tables):
    import duckdb

    connection = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet/*.parquet'")
    theirs = connection.execute(queries.ORACLE["op7_line_dedup"]).fetchall()
    ours = queries.op7_line_dedup(spark, tables).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, ours)) == sorted(theirs)
