"""Line deduplication by spread over sites.

A line (without the spaces around it) that stands on many sites is boilerplate
and is removed wherever it stands. Each line's hash has a HyperLogLog sketch of its
sites, which merges as a partial aggregate; near the threshold, exact distinct
counts decide.

Lines of copied documents also stand on many sites, but copies are left to document
deduplication: a document more than ``COPY`` hundredths of which (in bytes, blank
lines apart) are lines on many sites is a copy, or nearly one, and what it holds
doesn't count. So the sites are counted twice: in all documents, and then, of the
lines that stand on many, in those that aren't copies. A footer of any length is
found by the documents that have something of their own, and is then removed from
copies as well.

Blank lines aren't counted and never removed. A document whose lines would all
go stays whole, so none becomes empty. A null text is empty; a null site is no
site. Rows that repeat are occurrences each. Everything is DataFrame functions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.text import whole
from ledgerlake.sources.shared import materialise

#: Distinct sites from which on a line is boilerplate.
SITES = 10
#: Percent of a document that lines on many sites may make up before it counts as a copy.
COPY = 80
#: log2 of a sketch's size, and how far an estimate may be off: four standard errors.
SKETCH = 12
_OFF = 4 * 1.04 / 2 ** (SKETCH / 2)

_KEY = ["_h1", "_h2"]


def _key(line: Column) -> list[Column]:
    """96 bits of hash."""
    return [F.xxhash64(line).alias("_h1"), F.hash(line).alias("_h2")]


def _occurrences(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """Hash, bytes, site and row of every line that isn't blank, and the bytes of
    all such lines of the row."""
    trimmed = F.transform(F.split(whole(F.col(text_col)), "\n"), lambda x: F.trim(x))
    each = F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.struct(*_key(x), F.octet_length(x).cast("long").alias("bytes")))
    # numbered before the lines are taken apart
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(site_col).alias("site"), each.alias("lines"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda t, x: t + x["bytes"])
    return rows.select("row", "site", total.alias("total"), F.explode("lines").alias("l")).select("row", "site", "total", "l.*")


def _on_many_sites(lines: DataFrame, sites: int) -> DataFrame:
    """Hashes of ``lines`` (hash, site) on at least ``sites`` sites."""
    known = lines.filter(F.col("site").isNotNull())
    sketched = known.groupBy(*_KEY).agg(F.hll_sketch_agg(F.xxhash64("site"), F.lit(SKETCH)).alias("s"), F.count("*").alias("n"))
    # fewer occurrences than sites asked for: no need to estimate
    counted = sketched.filter(F.col("n") >= sites).select(*_KEY, F.hll_sketch_estimate("s").alias("s"))
    sure = F.col("s") >= sites * (1 + _OFF)
    counted = materialise(counted.filter(F.col("s") >= sites * (1 - _OFF)).withColumn("sure", sure), "line-spread")
    unsure = counted.filter(~F.col("sure")).select(*_KEY)
    exact = known.join(unsure, _KEY, "left_semi").select(*_KEY, "site").distinct()
    decided = exact.groupBy(*_KEY).agg(F.count("*").alias("s")).filter(F.col("s") >= sites)
    return materialise(counted.filter("sure").select(*_KEY).unionByName(decided.select(*_KEY)), "lines-on-many-sites")


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """Hashes of the lines on at least ``sites`` sites, copies apart."""
    lines = _occurrences(docs, text_col, site_col)
    # a row's number holds from here on, as it is written once
    spread = materialise(lines.join(_on_many_sites(lines, sites), _KEY), "lines-on-many-sites")
    documents = spread.groupBy("row").agg(F.sum("bytes").alias("spread"), F.first("total").alias("total"))
    own = documents.filter(F.col("spread") * 100 <= F.col("total") * COPY).select("row")
    return _on_many_sites(spread.join(own, "row", "left_semi"), sites)


def strip(docs: DataFrame, text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col`` (a null becomes
    empty), and the columns ``n_lines`` (all lines) and ``n_removed``; columns
    of these names are replaced."""
    removed = boilerplate(docs, text_col, site_col, sites).withColumn("_spread", F.lit(True))
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    # a row's number only has to hold within this one pass over the input
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*others).alias("_rest"), whole(F.col(text_col)).alias("_text"))
    lines = rows.select("_row", "_rest", F.posexplode(F.split("_text", "\n")).alias("_i", "_line"))
    lines = lines.select("_row", F.when(F.col("_i") == 0, F.col("_rest")).alias("_rest"), "_i", "_line", *_key(F.trim("_line")))
    marked = lines.join(removed, _KEY, "left")
    gone = F.coalesce("_spread", F.lit(False)) & (F.trim("_line") != "")
    one = F.struct(F.col("_i").alias("i"), F.col("_line").alias("line"), gone.alias("gone"))
    whole_again = marked.groupBy("_row").agg(F.first("_rest", ignorenulls=True).alias("_rest"), F.sort_array(F.collect_list(one)).alias("_lines"))
    kept = F.filter("_lines", lambda x: ~x["gone"])
    nothing_left = ~F.exists("_lines", lambda x: ~x["gone"] & (F.trim(x["line"]) != ""))
    lines_kept = F.when(nothing_left, F.col("_lines")).otherwise(kept)
    out = whole_again.select("_rest", F.size("_lines").cast("long").alias("n_lines"), lines_kept.alias("_kept"))
    text = F.array_join(F.transform("_kept", lambda x: x["line"]), "\n")
    out = out.select(
        *[F.col("_rest")[c].alias(c) for c in others],
        text.alias(text_col),
        "n_lines",
        (F.col("n_lines") - F.size("_kept")).alias("n_removed"),
    )
    order = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*order, "n_lines", "n_removed")
