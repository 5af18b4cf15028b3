"""Phrase collocations by stripes: each prefix keys an associative counter of the
words that follow it.

Texts (A-Z lower-cased) are cut into pieces at ``. , ; : ! ?`` and line ends, and
pieces into words at spaces and tabs. A phrase is two or three neighbouring words of
a piece. Everything is counted per language (null: ``und``); a null text is empty,
rows that repeat count each, other columns are ignored.

A task builds the stripes of the texts it has in hand: of a prefix of one or two
words, how often it occurs and how often each next word follows. Stripes of a prefix
are merged elementwise after one shuffle, by a hash aggregate that spills. A merged
stripe yields the extensions of its prefix (the phrases one word longer), the
prefix's total, and what subsumes the prefix; totals of prefixes are all that the
scores need, since both parts of a phrase are prefixes.

Nothing that occurs fewer than ``least`` times matters, so stripes are only built of
prefixes, and of followers, that occur so often. What does is known from the pass
before (words, then pairs) by a bitmap of ``2 ** FILTER_BITS`` hashes, whose size is
fixed: a collision lets a rare phrase through to the exact counts and nothing else.
The stripe of a prefix that occurs ``HOT`` times is dealt out in ``PARTS`` by its
next words, so that no prefix has to be in one task.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.text import Spans, as_bytes, chunks, mixed, runs, whole
from ledgerlake.sources.shared import materialise

#: Occurrences from which on a phrase is a candidate.
LEAST = 10
#: A longer phrase subsumes one inside it that it makes up this share of, in percent.
SHARE = 50
FILTER_BITS = 26
HOT_BITS = 20
HOT = 1 << 16
PARTS = 256
#: Bytes of text whose stripes are built at once.
IN_HAND = 2_500_000
UNIT = 1_000_000

_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_IS_WORD = ~_IS_BREAK
_IS_WORD[[9, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PAIR = np.uint64(0x9E3779B97F4A7C15)

#: ``counter``: next words, a tab and the count behind each that follows more than
#: once, joined by spaces (neither sign is in a word); the empty word stands for all.
_STRIPES = "lang string, prefix string, part int, counter string"


def _hashes(strings: pa.Array) -> np.ndarray:
    data, offsets = as_bytes(strings)
    return Spans(data).hash(offsets[:-1], offsets[1:])


def _joint(lang_hashes, word_hashes):
    return mixed(lang_hashes + mixed(word_hashes))


class _Marked:
    """A bitmap of hashes."""

    def __init__(self, rows, bits: int):
        self.bits = bits
        self.map = np.zeros(1 << (bits - 3), np.uint8)
        for bucket, bitmap in rows:
            self.map[bucket << 12 : (bucket + 1) << 12] = np.frombuffer(bitmap, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _marked(phrases: DataFrame, bits: int) -> _Marked:
    """The hashes of ``phrases`` (lang, w1, and w2 or null). Their bitmap, of a
    fixed size, is built by the executors and comes to the driver."""

    def places(batches):
        for batch in batches:
            langs = _hashes(batch.column(0))
            h = _joint(langs, _hashes(batch.column(1)))
            second = batch.column(2)
            pair = mixed(h * _PAIR + _joint(langs, _hashes(second)))
            h = np.where(np.asarray(second.is_null()), h, pair)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - bits)).astype(np.int64))], names=["at"])

    at = phrases.select("lang", "w1", "w2").mapInArrow(places, "at long")
    maps = at.groupBy(F.shiftright("at", 15).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("map"))
    return _Marked([(r.bucket, bytes(r.map)) for r in maps.collect()], bits)


class _Words:
    """Words of some texts: every occurrence's term (a word of a language), and
    whether the next occurrence follows it in the same piece."""

    def __init__(self, data, places, langs, lang_of_row):
        inside = _IS_WORD[data]
        starts, ends = runs(inside, places)
        rows = np.searchsorted(places, starts, side="right") - 1
        breaks = np.cumsum(_IS_BREAK[data])[starts]
        self.follows = (rows[1:] == rows[:-1]) & (breaks[1:] == breaks[:-1])
        ends_kept = np.concatenate(([0], np.cumsum(ends - starts)))
        buffers = [None, pa.py_buffer(ends_kept.astype(np.int64)), pa.py_buffer(data[inside])]
        words = pa.Array.from_buffers(pa.large_string(), len(starts), buffers).dictionary_encode()
        n = max(1, len(words.dictionary))
        codes = lang_of_row[rows] * n + words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes, self.term, self.times = np.unique(codes, return_inverse=True, return_counts=True)
        self.lang, word = codes // n, codes % n
        self.langs, self.words = langs, words.dictionary.take(pa.array(word))
        self.hash = _joint(_hashes(langs)[self.lang], _hashes(words.dictionary)[word])


def _in_hand(batches):
    """The words of ``batches`` (lang, text), some megabytes at a time."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        lang_of_row = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = as_bytes(batch.column(1))
        for begin, end in chunks(offsets, IN_HAND):
            some = _LOWER[data[offsets[begin] : offsets[end]]]
            yield _Words(some, offsets[begin : end + 1] - offsets[begin], langs.dictionary, lang_of_row[begin:end])


def _word_counts(batches):
    for words in _in_hand(batches):
        columns = [words.langs.take(pa.array(words.lang)).cast(pa.string()), words.words.cast(pa.string()), pa.array(words.times)]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])


def _stripes(words: _Words, prefixes: pa.Array, lang, times, hot, of, following) -> pa.RecordBatch:
    """The stripes of some prefixes, of which ``times`` are the occurrences. ``of``
    and ``following``: prefix and next term, wherever one follows. All of a
    prefix's occurrences count for the empty word."""
    terms = max(1, len(words.words))
    pairs, n = np.unique(of * terms + following, return_counts=True)
    of, following = pairs // terms, pairs % terms
    part = np.where(hot[of], 1 + (words.hash[following] % np.uint64(PARTS)).astype(np.int64), 0)
    every = np.arange(len(times))
    key = np.concatenate((of * (PARTS + 1) + part, every * (PARTS + 1)))
    following = np.concatenate((following, np.full(len(times), -1)))
    n = np.concatenate((n, times))
    order = np.argsort(key, kind="stable")
    key, following, n = key[order], following[order], n[order]
    keys, first = np.unique(key, return_index=True)
    offsets = pa.array(np.append(first, len(key)), pa.int32())
    nexts = pc.fill_null(words.words.cast(pa.string()).take(pa.array(following, mask=following < 0)), "")
    counted = pc.binary_join_element_wise(nexts, pa.array(n).cast(pa.string()), "\t")
    entries = pc.if_else(pa.array(n > 1), counted, nexts)
    own = keys // (PARTS + 1)
    columns = [
        words.langs.take(pa.array(lang[own])).cast(pa.string()),
        prefixes.cast(pa.string()).take(pa.array(own)),
        pa.array(keys % (PARTS + 1), pa.int32()),
        pc.binary_join(pa.ListArray.from_arrays(offsets, entries), " "),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "prefix", "part", "counter"])


def _word_stripes(often: _Marked, hot: _Marked):
    """Stripes of words: what follows each word that occurs often enough."""

    def work(batches):
        for words in _in_hand(batches):
            chosen = often.has(words.hash)
            at = np.cumsum(chosen) - 1
            here, after = words.term[:-1], words.term[1:]
            pair = words.follows & chosen[here] & chosen[after]
            terms = np.flatnonzero(chosen)
            yield _stripes(
                words, words.words.take(pa.array(terms)), words.lang[terms], words.times[terms], hot.has(words.hash[terms]),
                at[here[pair]], after[pair],
            )

    return work


def _pair_stripes(often: _Marked, pairs_often: _Marked, hot: _Marked):
    """Stripes of pairs of words."""

    def work(batches):
        for words in _in_hand(batches):
            chosen = often.has(words.hash)
            here, after = words.term[:-1], words.term[1:]
            places = np.flatnonzero(words.follows & chosen[here] & chosen[after])
            n = max(1, len(words.words))
            codes, pair, times = np.unique(here[places] * n + after[places], return_inverse=True, return_counts=True)
            first, second = codes // n, codes % n
            hashes = mixed(words.hash[first] * _PAIR + words.hash[second])
            kept = pairs_often.has(hashes)
            at = np.cumsum(kept) - 1
            # where two such pairs overlap, the second one's last word follows the first
            three = (places[1:] == places[:-1] + 1) & kept[pair[1:]] & kept[pair[:-1]] if len(places) else np.zeros(0, bool)
            text = words.words.cast(pa.string())
            prefixes = pc.binary_join_element_wise(text.take(pa.array(first[kept])), text.take(pa.array(second[kept])), " ")
            yield _stripes(
                words, prefixes, words.lang[first[kept]], times[kept], hot.has(hashes[kept]),
                at[pair[:-1][three]], second[pair[1:][three]],
            )

    return work


def _merged(stripes: DataFrame, least: int) -> DataFrame:
    """The stripes of each prefix as one: ``total`` (in part 0) and ``counter``, of
    the next words that occur ``least`` times."""
    key = ["lang", "prefix", "part"]
    dealt = stripes.repartition(*key)
    each = dealt.select(*key, F.explode(F.split("counter", " ", -1)).alias("e"))
    n = F.when(F.contains("e", F.lit("\t")), F.substring_index("e", "\t", -1).cast("long")).otherwise(1)
    summed = each.groupBy(*key, F.substring_index("e", "\t", 1).alias("next")).agg(F.sum(n).alias("n"))
    extension = F.when((F.col("next") != "") & (F.col("n") >= least), F.struct("next", "n"))
    whole_again = summed.groupBy(*key).agg(F.max(F.when(F.col("next") == "", F.col("n"))).alias("total"), F.collect_list(extension).alias("counter"))
    return materialise(whole_again.filter((F.col("total") >= least) | (F.size("counter") > 0)), "stripes")


def _extensions(merged: DataFrame) -> DataFrame:
    return merged.select("lang", "prefix", F.explode("counter").alias("e")).select("lang", "prefix", "e.next", F.col("e.n").alias("a"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """``floor(UNIT * a * a / (left * right))``, exact up to 10 ** 14 occurrences."""
    exact = [c.cast("decimal(14,0)") for c in (a, left, right)]
    over = F.lit(UNIT).cast("decimal(7,0)") * exact[0] * exact[0]
    return F.call_function("div", over, exact[1] * exact[2])


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, share: int = SHARE) -> DataFrame:
    """Phrases of two or three words that occur ``least`` times: ``lang``,
    ``phrase``, ``a`` (occurrences), ``l`` and ``r`` (of the parts of its weakest
    cut), ``n`` (all words of the language) and ``score``. A phrase inside a longer
    one that occurs ``share`` percent as often is left out."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole(F.col(text_col)).alias("text"))
    counts = texts.mapInArrow(_word_counts, "lang string, word string, n long")
    counts = materialise(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    none = F.lit(None).cast("string").alias("w2")
    words = counts.select("lang", F.col("word").alias("w1"), none, "n")
    often = _marked(words.filter(F.col("n") >= least), FILTER_BITS)
    hot = _marked(words.filter(F.col("n") >= HOT), HOT_BITS)

    singles = _merged(texts.mapInArrow(_word_stripes(often, hot), _STRIPES), least)
    pairs = _extensions(singles)
    known = pairs.select("lang", F.col("prefix").alias("w1"), F.col("next").alias("w2"), "a")
    pairs_often = _marked(known, FILTER_BITS)
    pairs_hot = _marked(known.filter(F.col("a") >= HOT), HOT_BITS)
    doubles = _merged(texts.mapInArrow(_pair_stripes(often, pairs_often, pairs_hot), _STRIPES), least)

    totals = singles.unionByName(doubles).filter("total IS NOT NULL").select("lang", "prefix", "total")
    second = F.substring_index("prefix", " ", -1)
    triples = _extensions(doubles).withColumn("rest", F.concat_ws(" ", second, "next"))
    phrase = F.concat_ws(" ", "prefix", "next").alias("phrase")

    def cut(rows: DataFrame, k: int, first: Column, rest: Column) -> DataFrame:
        return rows.select("lang", phrase, "a", F.lit(k).alias("k"), first.alias("first"), rest.alias("rest"))

    cuts = cut(pairs, 1, F.col("prefix"), F.col("next"))
    cuts = cuts.unionByName(cut(triples, 1, F.substring_index("prefix", " ", 1), F.col("rest")))
    cuts = cuts.unionByName(cut(triples, 2, F.col("prefix"), F.col("next")))
    left = totals.select("lang", F.col("prefix").alias("first"), F.col("total").alias("l"))
    right = totals.select("lang", F.col("prefix").alias("rest"), F.col("total").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    scored = scored.select("lang", "phrase", "a", F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut"))
    inside = [triples.select("lang", F.col(c).alias("phrase"), F.col("a").alias("longer")) for c in ("prefix", "rest")]
    longer = inside[0].unionByName(inside[1])
    best = scored.unionByName(longer, allowMissingColumns=True).groupBy("lang", "phrase")
    best = best.agg(F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    subsumed = F.coalesce(F.col("longer") * 100 >= F.col("a") * share, F.lit(False))
    kept = best.filter(F.col("a").isNotNull() & ~subsumed).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return kept.join(sizes, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def strongest(phrases: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each language by score and occurrences (both descending)
    and phrase, with ``rank``.

    Counts of logarithmic bands of the score, a thousand a language at most, say
    from which band on the first ``k`` come; only phrases from there are ranked.
    """
    banded = materialise(phrases.withColumn("band", F.floor(F.log2(F.col("score") + 1) * 50)), "phrases")
    counts = banded.groupBy("lang", "band").agg(F.count("*").alias("m"))
    higher = F.sum("m").over(Window.partitionBy("lang").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1))
    bands = counts.withColumn("higher", F.coalesce(higher, F.lit(0))).filter(F.col("higher") < k)
    chosen = banded.join(bands.select("lang", "band"), ["lang", "band"], "left_semi").drop("band")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return chosen.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
