"""Secret scans with an incremental blob ledger.

A text is addressed by its content (SHA-256). The ledger, two Parquet tables in
a folder, names the blobs that each version of the rules has scanned and what it
found there. A scan takes every version of every path, leaves out blobs that
the ledger has under the current rules, scans each remaining blob once however
often it occurs, and adds blobs and findings to the ledger. Findings are joined
back to all paths that have the blob. Findings only count once their batch is
listed among the scanned blobs, so a scan that broke off is scanned again.

A null text is empty. Null paths are kept. Rows that repeat are reported each.
Everything is DataFrame functions.
"""

import posixpath
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.rows import located
from ledgerlake.llm.text import whole

#: Kinds in order: name, pattern (Java), text that a match must contain, whether it is of the base set.
RULES = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", None, True),
    ("access", r"AKIA[A-Z0-9]{16,}", "AKIA", True),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", None, True),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "PRIVATE KEY-----", False),
    ("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ", False),
    ("url_password", r"(?<![a-z0-9])[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{6,128}@", "://", False),
]
#: Part of the ledger's key: a change of the rules scans everything anew.
RULE_VERSION = "1"
#: Characters of an assigned value at least.
ASSIGNED = 6

_ORDER = {name: i for i, (name, *_) in enumerate(RULES)}
_FINDING = "blob string, kind string, start long, end long, base boolean, rules string, batch string"
_SCANNED = "blob string, rules string, batch string"


def _table(spark: SparkSession, ledger: str, name: str, schema: str) -> DataFrame:
    path = posixpath.join(ledger, name)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([], schema).write.parquet(path)
        return spark.read.schema(schema).parquet(path)


def _scan(blobs: DataFrame) -> DataFrame:
    found = located(blobs, ["blob"], "text", [rule[:3] for rule in RULES])
    # of an assignment only the value counts: what stands behind the first separator
    value = F.regexp_extract("match", r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)
    long_enough = (F.col("label") != "assign") | (F.length(value) >= ASSIGNED)
    base = F.col("label").isin([name for name, _, _, base in RULES if base])
    return found.filter(long_enough).select(
        "blob", F.col("label").alias("kind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), base.alias("base")
    )


def scan(versions: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text", rules: str = RULE_VERSION) -> DataFrame:
    """Scan what the ledger hasn't; returns ``path_col`` and ``blob`` of every row."""
    spark = versions.sparkSession
    addressed = versions.select(F.col(path_col), whole(F.col(text_col)).alias("text"))
    addressed = addressed.select(path_col, F.sha2("text", 256).alias("blob"), "text")
    seen = _table(spark, ledger, "scanned", _SCANNED).filter(F.col("rules") == rules).select("blob")
    _table(spark, ledger, "findings", _FINDING)
    unseen = addressed.select("blob", "text").join(seen, "blob", "left_anti").dropDuplicates(["blob"])
    batch = uuid.uuid4().hex
    stamp = [F.lit(rules).alias("rules"), F.lit(batch).alias("batch")]
    # findings first: a blob counts as scanned only when they are there
    _scan(unseen).select("*", *stamp).write.mode("append").parquet(posixpath.join(ledger, "findings"))
    unseen.select("blob", *stamp).write.mode("append").parquet(posixpath.join(ledger, "scanned"))
    return addressed.select(path_col, "blob")


def findings(spark: SparkSession, ledger: str, rules: str = RULE_VERSION) -> DataFrame:
    """``blob``, ``kind``, ``start``, ``end``, ``base`` of all finished scans."""
    done = _table(spark, ledger, "scanned", _SCANNED).filter(F.col("rules") == rules).select("batch").distinct()
    found = _table(spark, ledger, "findings", _FINDING).filter(F.col("rules") == rules)
    return found.join(done, "batch", "left_semi").drop("batch", "rules")


def _ordered(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in _ORDER.items() for x in pair]), kind)


def report(paths: DataFrame, found: DataFrame, path_col: str = "doc_id") -> DataFrame:
    """Every path with its ``findings``: structs of ``start``, ``order``,
    ``kind``, ``end``, ``base``, by start, then kind; empty if there are none.
    Findings are gathered once for each blob, and joined last."""
    one = F.struct("start", _ordered(F.col("kind")).alias("order"), "kind", "end", "base")
    by_blob = found.groupBy("blob").agg(F.sort_array(F.collect_list(one)).alias("findings"))
    kind = by_blob.schema["findings"].dataType.simpleString()
    joined = paths.join(by_blob, "blob", "left")
    return joined.select(path_col, "blob", F.coalesce("findings", F.expr(f"cast(array() as {kind})")).alias("findings"))
