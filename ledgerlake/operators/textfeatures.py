"""Word and character n-grams, vocabulary and TF-IDF weights.

Spark takes the texts apart into words; a task counts the terms of some documents
at once, by numbers of words and n-grams, so counting needs no grouping by document
and term. Only documents whose key repeats are added up afterwards.
"""

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import schema as S
from ledgerlake.sources.shared import materialise

ANALYSERS = {"char": S.CHAR_VOCABULARY_MAX, "word": S.WORD_VOCABULARY_MAX}
CHAR_SIZES = range(2, 6)
WORD = r"(?U)\w\w+"
#: Words and n-grams in hand at once, rows and bytes of keys that leave a task together.
_WORDS, _GRAMS, _ROWS, _BYTES = 1 << 18, 1 << 19, 1 << 18, 1 << 26


def _accent_map() -> tuple[str, str]:
    """Latin letters that decompose to one plain letter, and that letter;
    combining marks follow and have no counterpart, so they are deleted."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        plain = [
            c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)
        ]
        if len(plain) == 1 and plain[0] != chr(code):
            source.append(chr(code))
            target.append(plain[0])
    marks = [chr(code) for code in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target)


_ACCENTED, _PLAIN = _accent_map()


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), _ACCENTED, _PLAIN)


def word_ngrams(text: Column) -> Column:
    """Words of two or more letters, and adjacent pairs of them."""
    words = F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(fold(text), r"(?U)\s+"), "")


def char_ngrams(word: Column) -> Column:
    """Substrings of length 2 to 5 of a word padded with one space each side."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    length = F.length(padded)

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), length - n + 1)
        return F.when(
            length >= n, F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_size(n) for n in CHAR_SIZES])


def by_document(docs: DataFrame, key: str) -> DataFrame:
    """Partition by document once; later steps per document reuse it."""
    return docs.repartition(key)


def _spans(sizes: np.ndarray, most: int):
    """Bounds of runs of neighbours whose sizes add up to ``most`` or less, or of
    single ones that are larger."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
        yield i, j
        i = j


def _summed(at: np.ndarray, weight: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of ``at``, which are below ``size``, ascending, and
    the sum of each one's weights (1 by default)."""
    if size <= 16 * len(at):
        total = np.bincount(at, weight, size)
        found = np.flatnonzero(total)
        return found, total[found].astype(np.int64)
    found, place = np.unique(at, return_inverse=True)
    return found, np.bincount(place, weight, len(found)).astype(np.int64)


def _word_terms(words: pa.Array, row: np.ndarray, rows: int):
    """Of some rows' words, each with the number of its row: rows, numbers of
    terms and counts, ascending, and the terms that these numbers stand for."""
    coded = words.dictionary_encode()
    code, known = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    beside = row[1:] == row[:-1]
    pairs, pair = np.unique(code[:-1][beside] * known + code[1:][beside], return_inverse=True)
    first, second = (coded.dictionary.take(pa.array(k)) for k in divmod(pairs, known))
    terms = pa.concat_arrays([coded.dictionary, pc.binary_join_element_wise(first, second, " ")])
    size = known + len(pairs)
    at = np.concatenate((row * size + code, row[1:][beside] * size + known + pair))
    found, tf = _summed(at, None, rows * size)
    yield *divmod(found, size), tf, terms


def _grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Numbers of the character n-grams of some words, word by word; where each
    word's numbers end, after a first 0; the n-grams that they stand for. An n-gram
    is numbered by the one that lacks its last letter, and that letter."""
    whole = "".join([f" {word} " for word in words])
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    letters, letter = np.unique(np.frombuffer(whole.encode("utf-32-le"), np.uint32), return_inverse=True)
    word, left = np.repeat(np.arange(len(words)), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(whole))
    shorter, grams, owners, numbers = letter, [], [], []
    for n in CHAR_SIZES:
        starts = np.flatnonzero(left >= n)
        of_size, first, place = np.unique(
            shorter[starts] * len(letters) + letter[starts + n - 1], return_index=True, return_inverse=True
        )
        owners.append(word[starts])
        numbers.append(place + len(grams))
        grams += [whole[i : i + n] for i in starts[first].tolist()]
        shorter = np.zeros(len(whole), np.int64)
        shorter[starts] = place
    owner, number = np.concatenate(owners), np.concatenate(numbers)
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))
    return number[np.argsort(owner, kind="stable")], ends, grams


def _char_terms(words: pa.Array, row: np.ndarray, rows: int):
    """As ``_word_terms``, of character n-grams, some rows at a time."""
    coded = words.dictionary_encode()
    code, known = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    numbers, ends, grams = _grams_of(coded.dictionary.to_pylist())
    terms, size = pa.array(grams, pa.string()), max(len(grams), 1)
    found, often = _summed(row * known + code, None, rows * known)
    own, word = divmod(found, known)
    lengths = np.diff(ends)[word]
    per_row = np.bincount(own, lengths, rows).astype(np.int64)
    of_row = np.searchsorted(own, np.arange(rows + 1))
    for i, j in _spans(per_row, _GRAMS):
        some = slice(of_row[i], of_row[j])
        length, before = lengths[some], np.cumsum(lengths[some]) - lengths[some]
        place = np.arange(length.sum()) + np.repeat(ends[word[some]] - before, length)
        at = np.repeat(own[some] - i, length) * size + numbers[place]
        sums, tf = _summed(at, np.repeat(often[some], length), (j - i) * size)
        of, term = divmod(sums, size)
        yield of + i, term, tf, terms


_TERMS = {"char": _char_terms, "word": _word_terms}


def _counted(batches, analyser: str):
    """Keys of some rows; rows, numbers of terms and counts; the terms."""
    for batch in batches:
        keys, lists = batch.column(0), batch.column(1)
        sizes, words = lists.value_lengths().to_numpy(), lists.flatten()
        ends = np.concatenate(([0], np.cumsum(sizes)))
        for i, j in _spans(sizes, _WORDS):
            row = np.repeat(np.arange(j - i), sizes[i:j])
            for counts in _TERMS[analyser](words.slice(ends[i], ends[j] - ends[i]), row, j - i):
                yield keys.slice(i, j - i), *counts


def _together(keys: pa.Array, row: np.ndarray, columns: list[tuple[str, pa.Array]]):
    """Batches of the rows' keys and other columns; long keys in smaller ones."""
    binary = pa.types.is_string(keys.type) or pa.types.is_binary(keys.type)
    wide = pc.max(pc.binary_length(keys)).as_py() if binary else 0
    step = max(1, min(_ROWS, _BYTES // ((wide or 0) + 1)))
    for i in range(0, len(row), step):
        own = keys.take(pa.array(row[i : i + step]))
        rest = [c.slice(i, step) for _, c in columns]
        yield pa.RecordBatch.from_arrays([own, *rest], names=["key", *[n for n, _ in columns]])


def _counting(analyser: str):
    def work(batches):
        for keys, row, term, tf, terms in _counted(batches, analyser):
            yield from _together(keys, row, [("term", terms.take(pa.array(term))), ("tf", pa.array(tf))])

    return work


def _weighing(analyser: str, vocab: pa.Table):
    """Terms of the vocabulary with their weight, length one per row."""
    known, numbers, idf = (vocab.column(c).combine_chunks() for c in ("term", "idx", "idf"))

    def work(batches):
        inverse = idf.to_numpy()
        for keys, row, term, tf, terms in _counted(batches, analyser):
            place = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy()[term]
            row, tf, place = (x[place >= 0] for x in (row, tf, place))
            weight = (1 + np.log(tf)) * inverse[place]
            norm = np.sqrt(np.bincount(row, weight * weight, len(keys)))
            place, weight = pa.array(place), pa.array(weight / norm[row])
            yield from _together(keys, row, [("idx", numbers.take(place)), ("term", known.take(place)), ("weight", weight)])

    return work


def _worded(docs: DataFrame, key: str, text: str, analyser: str) -> DataFrame:
    words = F.regexp_extract_all(fold(F.col(text)), F.lit(WORD), F.lit(0)) if analyser == "word" else words_of(F.col(text))
    return docs.select(F.col(key), words.alias("_words"))


def _keyed(docs: DataFrame, key: str, rest: str) -> T.StructType:
    return T.StructType([T.StructField(key, docs.schema[key].dataType), *T.StructType.fromDDL(rest).fields])


def _row_counts(docs: DataFrame, key: str, text: str, analyser: str) -> DataFrame:
    """(key, term, tf) of every row by itself."""
    schema = _keyed(docs, key, "term string, tf long")
    return _worded(docs, key, text, analyser).mapInArrow(_counting(analyser), schema)


def _apart(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key no other row has, and the others."""
    several = docs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows")).where("_rows > 1")
    again = docs[key].eqNullSafe(several["_key"])
    return docs.join(several, again, "left_anti"), docs.join(several, again, "left_semi")


def _added(docs: DataFrame, key: str, text: str, analyser: str) -> DataFrame:
    counts = _row_counts(docs, key, text, analyser)
    return counts.groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def term_counts(docs: DataFrame, key: str, text: str, analyser: str) -> DataFrame:
    """(key, term, tf). Character n-grams are cut from the distinct words of some
    documents, each counted as often as its word occurs.

    Rows whose key no other row has are counted by themselves; the counts of
    others are added up.
    """
    single, others = _apart(docs, key)
    return _row_counts(single, key, text, analyser).unionByName(_added(others, key, text, analyser))


def term_statistics(counts: DataFrame, copies: Column | None = None) -> DataFrame:
    """Document and corpus frequency per term; ``copies`` is how many
    documents a counted row stands for. Frequent terms combine before the
    shuffle."""
    copies = F.lit(1).cast("long") if copies is None else copies
    return counts.groupBy("term").agg(
        F.sum(copies).alias("df"), F.sum(F.col("tf") * copies).alias("cf")
    )


def vocabulary(
    statistics: DataFrame,
    documents: Column,
    size: int,
    min_documents: int = S.MIN_DOCUMENT_FREQUENCY,
) -> DataFrame:
    """The ``size`` most frequent terms found in ``min_documents`` or more
    documents, with index and inverse document frequency. ``documents``: number
    of documents.

    At most ``size`` rows leave the top-N, so numbering them in one task and
    broadcasting them later are both bounded.
    """
    top = (
        statistics.where(F.col("df") >= min_documents)
        .orderBy(F.desc("cf"), F.asc("term"))
        .limit(size)
    )
    idf = F.log((1 + documents) / (1 + F.col("df"))) + 1
    return top.select(
        (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"),
        "term", "df", "cf", idf.alias("idf"),
    )


def tfidf(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, idx, term, weight): sublinear TF times IDF, length one per document.

    The vocabulary is at most 60,000 terms by construction and is broadcast;
    a document's window holds no more rows than that.
    """
    weighted = counts.join(F.broadcast(vocab.select("term", "idx", "idf")), "term").withColumn(
        "_w", (1 + F.log("tf")) * F.col("idf")
    )
    document = Window.partitionBy(key)
    return weighted.select(
        key, "idx", "term",
        (F.col("_w") / F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(document))).alias("weight"),
    )


def document_tfidf(
    docs: DataFrame,
    key: str,
    text: str,
    analyser: str,
    size: int | None = None,
    min_documents: int = S.MIN_DOCUMENT_FREQUENCY,
) -> DataFrame:
    """Vocabulary and weights of one corpus in one go.

    Terms are counted twice, for the vocabulary and for the weights, as that moves
    far less than storing all counts. A row whose key no other row has is weighed
    where it lies; the vocabulary, at most 60,000 terms, goes to the tasks.
    """
    docs = docs.select(key, text)
    total = docs.agg(F.count("*")).scalar()
    statistics = term_statistics(term_counts(docs, key, text, analyser))
    vocab = vocabulary(statistics, total, size or ANALYSERS[analyser], min_documents)
    vocab = materialise(vocab, "vocabulary")
    single, others = _apart(docs, key)
    schema = _keyed(docs, key, "idx int, term string, weight double")
    work = _weighing(analyser, vocab.select("term", "idx", "idf").toArrow())
    weights = _worded(single, key, text, analyser).mapInArrow(work, schema)
    return weights.unionByName(tfidf(_added(others, key, text, analyser), vocab, key))
