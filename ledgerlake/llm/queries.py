"""The registered queries of the operators, with their production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import (
    collocations, decontaminate, fingerprints, lines, manifest, packing, personal, quality, secrets, simhash, substrings, tokenfiles, toxicity,
)
from ledgerlake.llm.rows import reachable
from ledgerlake.sources.shared import new_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document that occur in windows of the benchmark."""
    found = decontaminate.decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


#: Scores from here on count as good: a document is only dropped if it is likely bad.
GOOD = 0.3


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of each document, learnt from the labels outside the fold."""
    docs = _table(spark, folder, "documents")
    weights = quality.train(docs, _table(spark, folder, "labels"))
    return quality.score(docs, weights).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of each document's pieces in sequences of 4096 tokens."""
    return packing.pack(packing.pieces(_table(spark, folder, "documents")))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness."""
    pairs = fingerprints.edited_pairs(_table(spark, folder, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def _spans(found, chosen=lambda x: F.lit(True)):
    """kind:start:end of the chosen ones, comma-joined."""
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    return F.array_join(F.transform(F.filter(found, chosen), text), ",")


def _count(found, kind: str):
    return F.size(F.filter(found, lambda x: x["base"] & (x["kind"] == kind))).cast("long")


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in each document, from a ledger that starts empty."""
    ledger = new_folder(spark, "secret-ledger")
    paths = secrets.scan(_table(spark, folder, "documents"), ledger)
    found = secrets.report(paths, secrets.findings(spark, ledger))
    return found.select(
        "doc_id",
        *[_count("findings", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_spans("findings", lambda x: x["base"]), 256).alias("base_sha256"),
        _spans("findings").alias("spans"),
    )


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in each document."""
    found = personal.find(_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *[_count("found", k).alias(f"n_{k}") for k in personal.KINDS],
        F.sha2(_spans("found", lambda x: x["base"]), 256).alias("base_sha256"),
        _spans("found").alias("spans"),
    )


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Each document without the lines that stand on ten sites or more."""
    found = lines.strip(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Each document without the bytes that repeat 100 earlier ones."""
    found = substrings.dedup(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """What stands in the ORC files of all documents' token ids."""
    path = new_folder(spark, "token-files")
    tokenfiles.write_ids(_table(spark, folder, "documents"), path)
    return tokenfiles.manifest(spark, path)


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    return simhash.near_duplicates(_table(spark, folder, "documents")).drop("text_key")


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, proof and root of each document, and what a tampered one folds to."""
    docs = _table(spark, folder, "documents")
    # a null stays null
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampered = manifest.leaf_hash([more if c == "n_chars" else F.col(c) for c in MANIFEST_FIELDS])
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = manifest.manifest(
        docs, MANIFEST_FIELDS, carry={"doc_id": F.col("doc_id"), "tampered": F.when(chosen, tampered)}
    )
    folded = found.withColumn("folded_root", manifest.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(manifest.siblings(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: Scores from here on count as toxic: a document is only marked if it is likely toxic.
TOXIC = 0.7


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of each document, learnt from the labels outside the fold."""
    docs = _table(spark, folder, "documents")
    weights = toxicity.train(docs, _table(spark, folder, "labels"))
    return toxicity.score(docs, weights).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted")
    )


#: Phrases of each language in the report.
PHRASES = 2000


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest phrases of each language."""
    found = collocations.strongest(collocations.mine(_table(spark, folder, "documents")), PHRASES)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_secrets": op5_secrets,
    "op6_personal_data": op6_personal_data,
    "op7_line_dedup": op7_line_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_files": op9_token_files,
    "op10_simhash": op10_simhash,
    "op11_manifest": op11_manifest,
    "op12_toxicity": op12_toxicity,
    "op13_collocations": op13_collocations,
}

# The spread of a line with exact counts throughout.
_LINES_STRIPPED = """
texts AS (SELECT row_number() OVER () AS id, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT id, doc_id, source, i, ls[i] AS line, trim(ls[i]) AS t FROM texts, unnest(generate_series(1, len(ls))) AS s(i)
),
many AS (SELECT t FROM lines WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10),
own AS (
  SELECT id FROM lines WHERE t <> '' GROUP BY id
  HAVING 100 * coalesce(sum(strlen(t)) FILTER (WHERE t IN (SELECT t FROM many)), 0) <= 80 * sum(strlen(t))
),
spread AS (
  SELECT t FROM lines WHERE t IN (SELECT t FROM many) AND id IN (SELECT id FROM own)
  GROUP BY t HAVING count(DISTINCT source) >= 10
),
marked AS (SELECT l.*, (l.t IN (SELECT t FROM spread)) AS gone FROM lines l),
docs AS (
  SELECT id, count(*) AS n_lines, coalesce(bool_or(NOT gone AND t <> ''), false) AS some
  FROM marked GROUP BY id
),
stripped AS (
  SELECT any_value(m.doc_id) AS doc_id, any_value(d.n_lines) AS n_lines,
         count(*) FILTER (WHERE m.gone AND d.some) AS n_removed,
         string_agg(m.line, chr(10) ORDER BY m.i) FILTER (WHERE NOT (m.gone AND d.some)) AS text
  FROM marked m JOIN docs d ON d.id = m.id GROUP BY m.id
)
"""

# crc32 of the digits of an id, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), repeat([0::BIGINT], 8)), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))
    ))"""


def _encoded(column: str, value: str | None = None) -> str:
    text = f"({value or column})::VARCHAR"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _tree_sql(name: str, leaves: str) -> str:
    """Every level of the binary trees over ``leaves`` (g, idx, h)."""
    return f"""
{name} AS (
  SELECT g, 0 AS level, idx, h FROM {leaves}
  UNION ALL
  SELECT g, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS nodes FROM {name})
  WHERE nodes > 1 GROUP BY g, level, idx // 2
)"""


_LEAF_SQL = " || ".join(_encoded(c) for c in MANIFEST_FIELDS)
_TAMPERED_SQL = " || ".join(_encoded(c, "n_chars + 1" if c == "n_chars" else None) for c in MANIFEST_FIELDS)

_MANIFEST = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, sha256({_LEAF_SQL}) AS leaf,
         CASE WHEN {_CRC32} % 7 = 0 THEN sha256({_TAMPERED_SQL}) END AS tampered
  FROM documents
),
docs AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER () AS id
  FROM hashed
),
leaves AS (SELECT g, idx, leaf AS h FROM docs),
{_tree_sql("inner_nodes", "leaves")},
subroots AS (SELECT g AS name, '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, max_by(h, level) AS h FROM inner_nodes GROUP BY inner_nodes.g),
{_tree_sql("outer_nodes", "subroots")},
steps AS (
  SELECT d.id, 0 AS tree, n.level, d.idx >> n.level AS at, n.g, d.idx FROM docs d
  JOIN (SELECT g, level, count(*) AS nodes FROM inner_nodes GROUP BY g, level) n ON n.g = d.g AND n.nodes > 1
  UNION ALL
  SELECT d.id, 1, n.level, s.idx >> n.level, '', s.idx FROM docs d JOIN subroots s ON s.name = d.g,
  (SELECT level, count(*) AS nodes FROM outer_nodes GROUP BY level) n WHERE n.nodes > 1
),
both_trees AS (SELECT 0 AS tree, * FROM inner_nodes UNION ALL SELECT 1, * FROM outer_nodes),
proofs AS (
  SELECT s.id, list({{'b': CASE WHEN s.at % 2 = 1 THEN t.h ELSE '' END, 'a': CASE WHEN s.at % 2 = 0 THEN coalesce(t.h, '') ELSE '' END}}
                    ORDER BY s.tree, s.level) AS path
  FROM steps s LEFT JOIN both_trees t ON t.tree = s.tree AND t.g = s.g AND t.level = s.level AND t.idx = xor(s.at, 1)
  GROUP BY s.id
),
folded AS (
  SELECT d.doc_id, d.leaf, s.h AS subroot, (SELECT max_by(h, level) FROM outer_nodes) AS root,
         sha256(coalesce(array_to_string(list_transform(p.path, lambda x: x.b || x.a), ''), '')) AS proof_sha256,
         list_reduce(list_prepend({{'b': coalesce(d.tampered, d.leaf), 'a': ''}}, coalesce(p.path, [])),
                     lambda acc, x: {{'b': sha256(x.b || acc.b || x.a), 'a': ''}}).b AS folded_root
  FROM docs d JOIN subroots s ON s.name = d.g LEFT JOIN proofs p ON p.id = d.id
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

_COLLOCATIONS = """
WITH pieces AS (
  SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\n\x0B\x0C\r]')) AS piece
        FROM documents)
),
grams AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM pieces, (SELECT unnest([1, 2, 3]) AS k), unnest(generate_series(1, len(w) - k + 1)) AS s(i)
),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
sizes AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, i, l.f AS l, r.f AS r,
         1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f) AS score
  FROM candidates c, unnest(generate_series(1, c.k - 1)) AS s(i)
  JOIN f l ON l.lang = c.lang AND l.k = i AND l.phrase = array_to_string(list_slice(c.w, 1, i), ' ')
  JOIN f r ON r.lang = c.lang AND r.k = c.k - i AND r.phrase = array_to_string(list_slice(c.w, i + 1, c.k), ' ')
),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
longer AS (
  SELECT lang, array_to_string(list_slice(w, i, i + 1), ' ') AS phrase, max(a) AS a
  FROM candidates, unnest([1, 2]) AS s(i) WHERE k = 3 GROUP BY ALL
),
kept AS (
  SELECT c.* FROM weakest c LEFT JOIN longer o ON c.k = 2 AND o.lang = c.lang AND o.phrase = c.phrase
  WHERE coalesce(100 * o.a < 50 * c.a, true)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op11_manifest": _MANIFEST,
    "op13_collocations": _COLLOCATIONS,
    "op7_line_dedup": f"WITH {_LINES_STRIPPED} SELECT doc_id, n_lines, n_removed, sha256(text) AS kept_sha256 FROM stripped",
}
