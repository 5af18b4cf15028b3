"""Document fingerprints by one-permutation MinHash.

Words are what stands between white space, in lower case; a shingle is five
words, or all of fewer. Each shingle is hashed once: the high bits choose one of
256 bins, and a bin keeps its smallest hash. An empty bin is filled by optimal
densification: it looks at bins that a universal hash of its number and the
attempt names, until one isn't empty, and takes its value. Of each bin the low
four bits are stored, 16 bins to a number. Two fingerprints' likeness is the
share of equal bins, less what four bits agree on by chance: an estimate of the
Jaccard similarity of the texts' shingles.

A null text is empty. A text without words has a fingerprint of zeros; its
likeness is 1 to another one and 0 to anything else. Everything is DataFrame
functions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.blocks import let
from ledgerlake.llm.rows import keyed, placed, with_next
from ledgerlake.sources.shared import materialise

SHINGLE = 5
BIN_BITS = 8
LOW_BITS = 4
#: Rounds of densification; a bin that is then still empty (only in texts of a few shingles) takes the next full bin.
ROUNDS = 512

_BINS = 1 << BIN_BITS
_REST = 64 - BIN_BITS
_EMPTY = (1 << _REST) - 1  # all bits below the bin's: stands for no shingle
_PER_LONG = 64 // LOW_BITS


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), "")


def _shingles(words: Column) -> Column:
    """Hashes of all shingles."""
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.when(
            F.size(h) > SHINGLE,
            F.transform(
                F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)])
            ),
        )
        .when(F.size(h) > 0, F.array(F.xxhash64(h)))
        .otherwise(F.array().cast("array<bigint>")),
    )


def _bins(hashes: Column) -> Column:
    """The smallest hash of each bin, in the order of bins: after sorting, the
    first of those with the same high bits. One marker for each bin stands
    behind all its hashes."""
    markers = F.transform(
        F.sequence(F.lit(0), F.lit(_BINS - 1)), lambda b: F.shiftleft(b.cast("long"), _REST).bitwiseOR(F.lit(_EMPTY))
    )
    bin_of = lambda h: F.shiftrightunsigned(h, _REST)
    return let(
        F.sort_array(F.concat(hashes, markers)),
        lambda s: F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1)))),
    )


def _dense(values: Column) -> Column:
    """Fill bins of value -1."""
    n_empty = lambda a: F.size(F.filter(a, lambda v: v < 0))

    def attempt(full: Column):
        def step(acc: Column, r: Column) -> Column:
            probe = lambda i: F.pmod(F.xxhash64(i, r), F.lit(_BINS)).cast("int")
            filled = lambda: F.transform(acc["v"], lambda v, i: F.when(v < 0, F.get(full, probe(i))).otherwise(v))
            return F.when(acc["left"] == 0, acc).otherwise(let(filled(), lambda a: F.struct(a.alias("v"), n_empty(a).alias("left"))))

        return step

    def follow(full: Column, v: Column) -> Column:
        known = lambda a: F.filter(a, lambda x: x >= 0)
        return F.when(v["left"] == 0, v["v"]).otherwise(
            F.transform(
                v["v"],
                lambda x, i: F.when(x < 0, F.get(known(F.concat(F.slice(full, i + 1, _BINS), full)), F.lit(0))).otherwise(x),
            )
        )

    return F.when(n_empty(values) == 0, values).otherwise(
        F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)),
            F.struct(values.alias("v"), n_empty(values).alias("left")),
            attempt(values),
            lambda acc: follow(values, acc),
        )
    )


def fingerprint(text: Column) -> Column:
    """The fingerprint, an array of 16 longs."""
    low = lambda h: F.when(h.bitwiseAND(F.lit(_EMPTY)) == _EMPTY, F.lit(-1)).otherwise(
        h.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int")
    )
    pack = lambda v: F.transform(
        F.sequence(F.lit(0), F.lit(_BINS // _PER_LONG - 1)),
        lambda k: F.aggregate(
            F.slice(v, k * _PER_LONG + 1, _PER_LONG),
            F.lit(0).cast("long"),
            lambda acc, x: F.shiftleft(acc, LOW_BITS).bitwiseOR(x.cast("long")),
        ),
    )
    return let(
        _shingles(_words(text)),
        lambda s: F.when(F.size(s) == 0, _nothing()).otherwise(
            let(F.transform(_bins(s), low), lambda v: let(_dense(v), pack))
        ),
    )


def _nothing() -> Column:
    return F.array_repeat(F.lit(0).cast("long"), _BINS // _PER_LONG)


def as_text(print_: Column) -> Column:
    """One hexadecimal digit for each bin."""
    return F.lower(F.array_join(F.transform(print_, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, corrected for bins whose low bits agree by chance."""
    ones = F.lit(0x1111111111111111)

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        any_bit = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        return F.bit_count(any_bit.bitwiseAND(ones))

    unlike = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, n: acc + n)
    chance = 1.0 / (1 << LOW_BITS)
    share = (1 - unlike / F.lit(float(_BINS)) - chance) / (1 - chance)
    return (
        F.when(a == b, F.lit(1.0))
        .when((a == _nothing()) | (b == _nothing()), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), share))
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_chars`` and ``fingerprint`` of every row."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return rows.select(id_col, F.length("_text").cast("long").alias("n_chars"), fingerprint(F.col("_text")).alias("fingerprint"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with an edited text: its last quarter gives way to as many
    characters from the start of the next document.

    The next document is the one with the next id (nulls first, equal ids by
    hash of their text); after the last comes the first; rows with equal id and
    text are one document, and each gets a row. Columns: ``id_col``,
    ``n_chars``, ``edited`` (the text), ``fingerprint``, ``edited_fingerprint``,
    ``next_fingerprint``.
    """
    rows = keyed(docs, id_col, text_col)
    small = rows.select(
        "_id", "_a", "_b", F.length("_text").cast("long").alias("n_chars"), fingerprint(F.col("_text")).alias("fingerprint")
    )
    small = materialise(placed(small.dropDuplicates(["_a", "_b"]), "_id", "_a"), "fingerprints")
    follow = with_next(small, ["_a", "_b", "fingerprint"])
    follow = follow.withColumn("_taken", F.floor(F.col("n_chars") / 4).cast("int"))
    # what a document has to know, and for whom it has to cut its beginning
    wanted = follow.select(
        F.col("next._a").alias("_a"), F.col("next._b").alias("_b"), F.struct("_a", "_b", "_taken").alias("_for")
    )
    known = follow.select("_a", "_b", "_id", "n_chars", "_taken", "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"))
    info = materialise(known.join(wanted, ["_a", "_b"]), "followers")
    both = rows.select("_a", "_b", "_text").join(info, ["_a", "_b"])
    starts = both.select(F.col("_for._a").alias("_a"), F.col("_for._b").alias("_b"), F.substring("_text", F.lit(1), F.col("_for._taken")).alias("_start"))
    starts = starts.groupBy("_a", "_b").agg(F.min("_start").alias("_start"))
    edited = F.concat(F.substring("_text", F.lit(1), (F.col("n_chars") - F.col("_taken")).cast("int")), F.col("_start"))
    joined = both.join(starts, ["_a", "_b"]).select("_id", "n_chars", "fingerprint", "next_fingerprint", edited.alias("edited"))
    return joined.select(
        F.col("_id").alias(id_col), "n_chars", "edited", "fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint",
    )
