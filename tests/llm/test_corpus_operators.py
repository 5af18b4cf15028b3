"""The operators against plain versions, over awkward tables."""

import math
import random

import brute
import cases
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from ledgerlake.llm import (
    decontaminate, fingerprints, lines, minhash, packing, personal, quality, queries, secrets, simhash, substrings, tokenfiles, tokens,
)
from ledgerlake.sources.shared import new_folder
from pyspark.sql import functions as F

DOCS = cases.documents()
TEXTS = {row[0]: row[1] for row in DOCS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, cases.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The awkward table as the queries read it."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(DOCS, cases.SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(cases.benchmark(DOCS), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(i % 3 > 0), 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_contamination(spark, folder):
    got = queries.op1_decontaminate(spark, folder)
    expected = brute.contamination([r[:2] for r in DOCS], cases.benchmark(DOCS))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(expected, key=repr)


def test_contamination_by_shuffle_join(spark, folder, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    test_contamination(spark, folder)


def test_every_shared_window_is_found(spark):
    """Windows of 13 words at any place, among words that repeat a lot."""
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "and", "x", "y"])
    docs = [(i, " ".join(word() for _ in range(120))) for i in range(40)]
    items = [(i, " ".join(docs[i][1].split()[i : i + 13 + i % 5])) for i in range(40)] + [(50 + n, " ".join(["the", "of"] * n)) for n in range(1, 7)]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    expected = [x[:4] for x in brute.contamination(docs, items)]
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items") == sorted(expected, key=repr)


def test_simhash(spark, folder):
    expected = brute.components([(i, brute.simhash(t)) for i, t in TEXTS.items()])
    assert rows(queries.op10_simhash(spark, folder), "doc_id", "fingerprint", "component_id") == sorted(expected, key=repr)


@pytest.mark.parametrize("many", [2000, 3])
def test_links_join_all_that_are_near(spark, monkeypatch, many):
    """Dense groups, chains and strangers, whatever the blocks."""
    monkeypatch.setattr(simhash, "_MANY", many)
    rng = random.Random(5)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    chain = rng.getrandbits(64)
    for i in range(0, 60, 3):
        chain ^= 7 << i
        values.add(chain)
    values |= {rng.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    nodes = spark.createDataFrame([(v, [v]) for v in signed], "fingerprint long, words array<long>")
    found = simhash.components(simhash.links(nodes))
    got = {r.node: r.root for r in found.collect()}
    expected = brute.components([(v, v % (1 << 64)) for v in signed])
    groups = lambda pairs: sorted(sorted(g) for g in pairs.values())
    mine, theirs = {}, {}
    for v, (_, _, least) in zip(signed, expected, strict=True):
        mine.setdefault(got.get(v, v), []).append(v)
        theirs.setdefault(least, []).append(v)
    assert groups(mine) == groups(theirs)


def test_near_copies_are_found(spark):
    """One word in fifty changed: word 5-shingles alike to 0.8 or so."""
    rng = random.Random(9)
    rows_ = []
    for i in range(40):
        text = cases.words(rng, 300).split()
        rows_.append((2 * i, " ".join(text)))
        for at in rng.sample(range(300), 5):
            text[at] = "zz" + text[at]
        rows_.append((2 * i + 1, " ".join(text)))
    # half of the words are new: not a copy
    for i in range(10):
        text = rows_[2 * i][1].split()
        rows_.append((1000 + i, " ".join(text[:200] + cases.words(rng, 100).split())))
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    found = simhash.near_duplicates(docs, bits=10, segment=21, further=3, similarity=0.8)
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert all(got[1000 + i] == 1000 + i for i in range(10))
    joined = sum(got[2 * i + 1] == 2 * i for i in range(40))
    assert joined >= 38 and all(got[2 * i] == 2 * i for i in range(40))


def near_groups(spark, texts):
    """Component of each text, and brute force over all pairs."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, **corpus_pipeline.NEAR).collect()}
    sets = [brute.shingles(t) for t in texts]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if least[i] != least[j] and brute.jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    return got, dict(enumerate(least))


def test_isolated_pairs_are_found_whatever_the_edit(spark):
    """Pairs alike to 0.80-0.85 that differ in one stretch or in scattered words."""
    rng = random.Random(21)
    texts = []
    for i in range(160):
        text = cases.words(rng, 304).split()
        new = cases.words(rng, 75).split()
        edits = [text + new[:70], text[:-58], text[:120] + new[:28] + text[148:], [w + "zz" if k % 50 == 9 else w for k, w in enumerate(text)]]
        texts += [" ".join(text), " ".join(edits[i % 4])]
    likely = [brute.jaccard(*map(brute.shingles, texts[i : i + 2])) for i in range(0, len(texts), 2)]
    assert all(0.8 <= x < 0.85 for x in likely)
    got, expected = near_groups(spark, texts)
    assert got == expected and all(got[i + 1] == i for i in range(0, len(texts), 2))


def test_equal_fingerprints_are_no_proof(spark):
    rng = random.Random(22)
    texts = [cases.words(rng, 150) + " |" * 180 for _ in range(6)]
    texts += [texts[0].upper(), texts[1].replace(" ", "  ", 3)]
    assert len({brute.simhash(t) for t in texts}) == 1
    got, expected = near_groups(spark, texts)
    assert got == expected == {**{i: i for i in range(6)}, 6: 0, 7: 1}


def test_fingerprints_give_pairs_by_themselves(spark, monkeypatch):
    """The pairs that multi-index hashing finds are compared, also where no minima meet."""
    rng = random.Random(24)
    texts = []
    while len(texts) < 12:
        text = cases.words(rng, 300)
        pair = [text, text + " tail"]
        a, b = (simhash.fingerprint(t.encode())[0] for t in pair)
        if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
            texts += pair
    same = cases.words(rng, 40) + " |" * 180  # one fingerprint, sets that are alike or not
    texts += [same, same + " |", same + " x", cases.words(rng, 150) + " |" * 180]
    assert len({brute.simhash(t) for t in texts[12:]}) == 1
    monkeypatch.setattr(minhash, "meetings", lambda nodes: nodes.select(F.col("node").alias("value"), "node").filter("false"))
    got, expected = near_groups(spark, texts)
    assert got == expected and all(got[i + 1] == i for i in range(0, 12, 2)) and got[14] == 12


def test_members_of_a_template_are_compared_with_each_other(spark, monkeypatch):
    """Texts that are closer to a template than to each other, but only alike to each other."""
    rng = random.Random(23)
    texts = []
    for _ in range(6):
        base = cases.words(rng, 200).split()
        for _ in range(8):
            member = base[: 200 - rng.randint(0, 60)] + cases.words(rng, rng.randint(0, 50)).split()
            member[rng.randint(0, 60)] += "q"
            texts += [" ".join(member), " ".join(member[: -rng.randint(5, 35)] + cases.words(rng, 2).split())]
    got, expected = near_groups(spark, texts)
    assert got == expected and len({*got.values()}) > 12
    monkeypatch.setattr(simhash, "TURNS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "SKETCH", 150)
    assert near_groups(spark, texts)[0] == expected


@pytest.mark.parametrize("roots", [{1: 40, 2: 1}, {1: 9, 2: 9, 3: 3}, {1: 2, 2: 2}, {1: 7}, {n: 1 for n in range(11)}])
def test_any_two_roots_meet_in_one_block(spark, monkeypatch, roots):
    """One value whose members are of some roots: a large family isn't copied for a straggler."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    members = [(64, 100 * root + i, root) for root, n in roots.items() for i in range(n)] + [(8, 1, 1), (9, 1, 1), (9, 200, 2)]
    met = spark.createDataFrame(members, "value long, node long, root long")
    tasks = {}
    for r in minhash.dealt(met).filter("value = 64").collect():
        tasks.setdefault((r.low, r.high), []).append(r)
    pairs = [
        (min(a.node, b.node), max(a.node, b.node))
        for (low, high), rows in tasks.items() for i, a in enumerate(rows) for b in rows[:i]
        if a.root != b.root and (low == high or a.block != b.block)
    ]
    of = [m for m in members if m[0] == 64]
    assert sorted(pairs) == sorted((a[1], b[1]) for a in of for b in of if a[1] < b[1] and a[2] != b[2])
    if len(roots) == 2 and roots[1] == 40:
        assert sum(map(len, tasks.values())) == 40 + 1 + 10
    nodes = [(n, np.arange(minhash.MINIMA, dtype="<u4").tobytes()) for n in sorted({m[1] for m in members})]
    sets = spark.createDataFrame([(n, [1, 2, 3]) for n, _ in nodes], "node long, shingles array<long>")
    found = minhash.across(met.filter("value = 64"), spark.createDataFrame(nodes, "node long, minima binary"), sets, 0.8)
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(pairs)


def test_substrings(spark, folder):
    got = queries.op8_suffix_dedup(spark, folder)
    expected = brute.repeats([r[:2] for r in DOCS])
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(expected, key=repr)


@pytest.mark.parametrize("held", [600_000, 200])
def test_substrings_among_periodic_and_shared_text(spark, monkeypatch, held):
    monkeypatch.setattr(substrings, "HELD", held)
    rng = random.Random(11)
    parts = [cases.words(rng, rng.choice([10, 18, 25, 40])) for _ in range(12)]
    docs = [(i, " ".join(rng.choice([*parts, "ab" * 70, "x" * 130, cases.words(rng, 12)]) for _ in range(rng.randint(1, 8)))) for i in range(150)]
    got = substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("k"))
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "k") == sorted(brute.repeats(docs), key=repr)


def test_substrings_with_ids_that_do_not_number_rows(spark):
    """Nulls first, equal ids by text, and rows that repeat are one document."""
    rng = random.Random(2)
    text = cases.words(rng, 60)
    docs = [("b", text), ("a", "start " + text), (None, text + " end"), ("b", text), ("c", None)]
    got = rows(substrings.dedup(spark.createDataFrame(docs, "doc_id string, text string")), "doc_id", "n_removed", "n_spans")
    n = len(text)
    assert got == sorted([("a", n, 1), ("b", n, 1), ("b", n, 1), ("c", 0, 0), (None, 0, 0)], key=repr)


def reference_ids(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.vocabulary())
    return {k: [*own.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}


def test_encoder_agrees_with_the_tokenizer():
    rng = random.Random(1)
    signs = ["a", "B", "é", "É", "ß", "×", "Σ", "́", " ", "\n", "'", "s", "!", ".", "<|endoftext|>", "<|", "1", "½", " ", "中", "İ"]
    texts = ["it's we'll DON'T.", "Éclair!!", "a" * 3000, *("".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(2000))]
    ids, offsets = tokens.Encoder(tokens.vocabulary()).encode(pa.array([*texts, None]))
    expected = reference_ids(dict(enumerate([*texts, None])))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == list(expected.values())


def test_token_files(spark, folder):
    expected, start = [], 0
    for doc, ids in sorted(reference_ids(TEXTS).items()):
        expected.append((doc, start, len(ids), brute.crc(ids)))
        start += len(ids)
    got = queries.op9_token_files(spark, folder)
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)


def test_token_files_round_trip_and_lookup(spark, docs):
    path = new_folder(spark, "ids")
    tokenfiles.write_ids(docs, path)
    read = tokenfiles.read_ids(spark, path)
    assert {r.doc_id: r.ids for r in read.collect()} == reference_ids(TEXTS)
    one = read.filter("doc_id = 9")
    assert [r.ids for r in one.collect()] == [reference_ids(TEXTS)[9]]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,9)]" in one._jdf.queryExecution().toString()


def test_packing(spark, folder):
    ids = reference_ids(TEXTS)
    got = queries.op3_best_fit_packing(spark, folder).collect()
    placed = {}
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(own) == r.length and brute.crc(own) == r.ids_crc32
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(got) == sum(math.ceil(len(x) / 4096) for x in ids.values())
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(placed) == best_fit([r.length for r in got])


def best_fit(lengths, size=4096):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            gaps.append(size - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_sweep_is_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, rng.choice([4, 12, 32])) for _ in range(rng.randint(0, 300))]
    runs = [(n, lengths.count(n)) for n in set(lengths)]
    given = packing.sweep(runs, 32)
    used = set()
    for n, count in runs:
        own = sorted(x for x in given if x[0] == n)
        for i, (_, rank, first, each, _) in enumerate(own):
            until = own[i + 1][1] if i + 1 < len(own) else count
            used |= {first + k // each for k in range(until - rank)}
    assert len(used) == best_fit(lengths, 32)


def test_packed_sequences_hold_the_ids(spark, docs):
    parts = packing.pieces(docs, with_ids=True, sequence=512)
    packed = packing.pack(parts, 512)
    assert "ids" in packed.columns
    ids = reference_ids(TEXTS)
    got = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in got) == sum(map(len, ids.values())) and all(len(r.ids) == r.length <= 512 for r in got)


def test_fingerprints(spark, folder):
    got = {r.doc_id: r for r in queries.op4_fingerprints(spark, folder).collect()}
    order = sorted(TEXTS)
    off = []
    for i, doc in enumerate(order):
        text, following = TEXTS[doc] or "", TEXTS[order[(i + 1) % len(order)]] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha(edited))
        off.append(abs(r.near_edited - brute.jaccard(brute.shingles(text), brute.shingles(edited))))
        off.append(abs(r.near_next - brute.jaccard(brute.shingles(text), brute.shingles(following))))
    assert sum(off) / len(off) < 0.04 and max(off) < 0.5
    same = [got[d].fingerprint for d, t in TEXTS.items() if t == TEXTS[10]]
    assert len(same) == 6 and len(set(same)) == 1


def test_secrets(spark, folder):
    got = {r.doc_id: r for r in queries.op5_secrets(spark, folder).collect()}
    for doc, text in TEXTS.items():
        base = brute.secrets(text)
        r = got[doc]
        assert r.base_sha256 == brute.sha(",".join(base))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_ledger_scans_a_blob_once(spark, monkeypatch):
    ledger = new_folder(spark, "ledger")
    table = lambda rows_: spark.createDataFrame(rows_, "path string, text string")
    first = secrets.scan(table([("a", "token=abcdefgh"), ("b", "token=abcdefgh"), (None, None)]), ledger, "path")
    assert secrets.findings(spark, ledger).count() == 1
    scanned = spark.read.parquet(f"{ledger}/scanned")
    assert scanned.count() == 2
    second = secrets.scan(table([("c", "token=abcdefgh"), ("a", "x password: qwertyuiop")]), ledger, "path")
    assert spark.read.parquet(f"{ledger}/scanned").count() == 3
    paths = first.unionByName(second)
    found = secrets.report(paths, secrets.findings(spark, ledger), "path")
    assert sorted((r.path or "", len(r.findings)) for r in found.collect()) == [("", 0), ("a", 1), ("a", 1), ("b", 1), ("c", 1)]
    secrets.scan(table([("a", "token=abcdefgh")]), ledger, "path", rules="2")
    assert secrets.findings(spark, ledger, "2").count() == 1 and secrets.findings(spark, ledger).count() == 2


def test_personal_data(spark, folder):
    got = {r.doc_id: r for r in queries.op6_personal_data(spark, folder).collect()}
    for doc, text in TEXTS.items():
        base = brute.personal(text)
        r = got[doc]
        assert r.base_sha256 == brute.sha(",".join(base)), doc
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k) for x in base) for k in personal.KINDS)
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_personal_data_patterns_read_long_runs_once(spark):
    texts = [("a" * 200_000,), ("1 " * 50_000,), ("1." * 50_000,), ("a@" * 50_000,), ("+1" + "(" * 100_000,)]
    frame = spark.createDataFrame([(i, t) for i, (t,) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [f"{x.kind}:{x.start}:{x.end}" for x in r.found if x.base] for r in personal.find(frame).collect()}
    assert got == {i: brute.personal(t) for i, (t,) in enumerate(texts)}


def test_octets_are_compared_whole(spark):
    texts = ["built 2024.1.2.3 here", "v 1.2.3.1000 x", "at 1000.1.1.1", "from 0001.2.3.4 on", "0000.000.0255.1", "0256.1.1.1", "9" * 30 + ".1.1.1"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [f"{x.kind}:{x.start}:{x.end}" for x in r.found if x.base] for r in personal.find(frame).collect()}
    assert got == {i: brute.personal(t) for i, t in enumerate(texts)}
    assert [i for i, found in got.items() if found] == [3, 4]


def test_reliabilities_trust_labelers_that_agree():
    counts = [("ip", 1, 1, 0, 1, 80), ("ip", -1, -1, 0, -1, 40), ("ip", 1, -1, 0, 1, 5), ("ip", -1, 1, 0, -1, 5)]
    likely = personal.reliabilities(counts)
    assert likely["ip", 1, 1, 0, 1] > 0.95 and likely["ip", -1, -1, 0, -1] < 0.05


def test_lines(spark):
    rng = random.Random(4)
    shared = "All of this may be copied freely."
    docs = [(i, f"{cases.words(rng, 8)}\n  {shared}\n\n{cases.words(rng, 8)}", f"s{i % 10}") for i in range(20)]
    # one document copied to many sites stays, as does a line on nine sites
    copy = "\n".join(cases.words(rng, 8) for _ in range(4))
    docs += [(100 + i, copy, f"s{i % 12}") for i in range(24)]
    nine = cases.words(rng, 8)
    docs += [(200 + i, f"{cases.words(rng, 5)}\n{nine}", f"s{i}") for i in range(9)]
    docs += [(300, shared, "s1"), (301, None, None), (302, "\n \n", "s2")]
    got = lines.strip(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3))
    for r in got.collect():
        text = dict((d, t) for d, t, _ in docs)[r.doc_id] or ""
        expected = "\n".join(x for x in text.split("\n") if x.strip() != shared) if r.doc_id < 100 else text
        assert (r.text, r.n_lines) == (expected, text.count("\n") + 1)
        assert r.n_removed == (1 if r.doc_id < 100 else 0)


def test_footers_of_many_lines(spark):
    """A footer of three lines goes, also where it stands in a hot family of
    copies; what copies and near copies share stays."""
    rng = random.Random(14)
    footer = "\n".join(cases.words(rng, 6) for _ in range(3))
    docs = [(i, f"{cases.words(rng, 30)}\n{footer}", f"s{i}") for i in range(40)]
    copy = "\n".join(cases.words(rng, 12) for _ in range(9))
    docs += [(100 + i, f"{copy}\n{footer}", f"s{i % 15}") for i in range(300)]
    near = [cases.words(rng, 12) for _ in range(9)]
    docs += [(500 + i, "\n".join([*near, cases.words(rng, 10)]), f"s{i % 15}") for i in range(60)]
    gone = brute.boilerplate([d[1:] for d in docs])
    assert gone == set(footer.split("\n"))
    got = lines.strip(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5))
    removed = {r.doc_id: r.n_removed for r in got.collect()}
    assert removed == {d[0]: 3 if d[0] < 500 else 0 for d in docs}


def test_line_rule_against_plain_counts(spark):
    rng = random.Random(15)
    pool = [cases.words(rng, rng.randint(1, 9)) for _ in range(30)]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else cases.words(rng, 5) for _ in range(rng.randint(0, 7))), rng.choice([None, *[f"s{j}" for j in range(16)]])) for i in range(150)]
    gone = brute.boilerplate([d[1:] for d in docs])
    assert 0 < len(gone) < 30
    for r in lines.strip(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect():
        left = dict(d[:2] for d in docs)[r.doc_id].split("\n")
        if any(x not in gone and x for x in left):
            left = [x for x in left if x not in gone]
        assert r.text == "\n".join(left)


def test_quality(spark):
    rng = random.Random(8)
    good = lambda: cases.words(rng, 60)
    bad = lambda: " ".join(w.upper() + "!!" for w in cases.words(rng, 60).split())
    rows_ = [(i, good() if i % 3 else bad()) for i in range(240)] + [(900, None), (901, "")]
    labels = [(i, int(i % 3 > 0)) for i in range(240)] + [(1, None), (None, 1), (2, 1)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    weights = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    scored = quality.score(docs, weights).withColumn("held", quality.held_out()).collect()
    assert len(scored) == len(rows_) and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.held and r.doc_id < 240]
    assert held and all((r.score >= 0.3) == (r.doc_id % 3 > 0) for r in held)


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], cases.SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, path).count() == 0, name


def test_empty_benchmark_and_labels(spark, docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, nothing).filter("n_hit > 0 OR contaminated").count() == 0
    weights = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, weights).collect()} == {0.5}


CLASHES = ["n", "h", "_id", "_key", "hash", "level", "place", "fingerprint", "node", "root", "label", "start", "end", "score", "n_lines", "ids"]


def test_clashing_columns_nulls_and_repeats(spark):
    """Extra columns named like our own, null ids, ties and repeated rows."""
    rng = random.Random(6)
    text = cases.words(rng, 80)
    base = [(1, text), (1, text), (None, text), (None, None), (2, text + " more"), (2, "other words here"), (3, "")]
    docs = spark.createDataFrame(base, "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("x"))
    items = spark.createDataFrame([(1, " ".join(text.split()[:15]))], "item_id long, text string").withColumn("window", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").withColumn("text", F.lit("t"))
    ledger = new_folder(spark, "ledger")
    results = [
        decontaminate.decontaminate(docs, items),
        quality.score(docs, quality.train(docs, labels)),
        packing.pack(packing.pieces(docs)),
        fingerprints.edited_pairs(docs),
        secrets.report(secrets.scan(docs, ledger), secrets.findings(spark, ledger)),
        personal.find(docs),
        lines.strip(docs),
        substrings.dedup(docs),
        simhash.near_duplicates(docs),
    ]
    for frame in results:
        ids = sorted(str(r[0]) for r in frame.select("doc_id").collect())
        assert ids == ["1", "1", "2", "2", "3", "None", "None"]
    path = new_folder(spark, "ids")
    tokenfiles.write_ids(docs, path)
    assert tokenfiles.manifest(spark, path).count() == len(base)
