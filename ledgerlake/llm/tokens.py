"""Token ids of whole text columns, with a public tokenizer.

The tokenizer cuts at white space, so each distinct stretch between ASCII white
space of a batch is encoded once and its ids are copied to all its places. Of
stretches that are plain letters with plain punctuation behind, the two parts
are words of their own to this kind of tokenizer, and the letters are encoded by
the model itself. Ids are kept for later batches, up to a bounded number.
"""

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerlake.llm.text import as_bytes, chunks

#: The id that ends each document.
END = 1
#: Words whose ids a worker keeps from batch to batch.
KEPT = 450_000
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 8_000_000

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters (ASCII and those of Latin-1) that have one small form each, with marks behind.
_PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+[!-/:-@\[-`{-~]*$"
_encoders: dict[str, "Encoder"] = {}


def vocabulary() -> str:
    """The public vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "Encoder":
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _behind(texts: pa.Array, starts: pa.Array) -> pa.Array:
    """What stands in each text behind its start."""
    data, offsets = as_bytes(texts)
    cut = pc.binary_length(starts).to_numpy().astype(np.int64)
    size = np.diff(offsets) - cut
    until = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(offsets[:-1] + cut - until[:-1], size) + np.arange(until[-1])
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(until.astype(np.int64)), pa.py_buffer(data[at]))


def _gathered(flat: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces that the codes name, of pieces that lie one behind the other."""
    begin = np.cumsum(size) - size
    each = size[codes]
    until = np.cumsum(each)
    total = int(until[-1]) if len(until) else 0
    return flat[np.repeat(begin[codes] - (until - each), each) + np.arange(total)], each


class Encoder:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Parts are only taken apart for a tokenizer that lower-cases, drops white
    space and cuts letters from punctuation; any other one gets whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self._kept: dict[str, bytes] = {}
        whole = lambda t: self._tokenizer.encode(t, add_special_tokens=False).ids
        self._apart = (
            whole("Ab c,. \n d' \u00c9") == whole("ab") + whole("c") + whole(",.") + whole("d") + whole("'") + whole("\u00e9")
            and self._word("ab\u00e9t") == _packed(whole("ab\u00e9t"))
        )

    def _word(self, word: str) -> bytes:
        """Ids of small letters: one word to the model, which takes bytes as letters."""
        if not word.isascii():
            word = self._bytes.pre_tokenize_str(word)[0][0]
        return _packed([t.id for t in self._model.tokenize(word)])

    def _found(self, distinct: list[str], how) -> list[bytes]:
        kept = self._kept
        out = [kept.get(x) for x in distinct]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, how([distinct[i] for i in rest]), strict=True):
            out[i] = kept[distinct[i]] = ids
        return out

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [_packed(x.ids) for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of a column, ``END`` after each row, and where each
        row's begin (one more than rows). A null is an empty text."""
        if self._apart:
            if len(self._kept) > KEPT:
                self._kept.clear()
            lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
            first = lists.offsets.to_numpy().astype(np.int64)
            parts = lists.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
            first, codes = first - first[0], parts.indices.to_numpy()
            # a distinct stretch is a word and marks, or one unit that is encoded as it is
            plain = pc.match_substring_regex(parts.dictionary, _PLAIN)
            is_plain = plain.to_numpy(zero_copy_only=False)
            both = parts.dictionary.filter(plain)
            words = pc.utf8_rtrim(both, characters=_MARKS)
            small = pc.utf8_lower(words).dictionary_encode()
            marks = _behind(both, words).dictionary_encode()
            others = parts.dictionary.filter(pc.invert(plain)).to_pylist()
            ids = self._found(small.dictionary.to_pylist(), lambda x: [self._word(w) for w in x])
            n_words = len(ids)
            ids += self._found(marks.dictionary.to_pylist(), self._encoded)
            n_marks = len(ids)
            ids += self._found(others, self._encoded)
            unit = np.empty((len(is_plain), 2), np.int64)
            unit[is_plain, 0] = small.indices.to_numpy()
            unit[is_plain, 1] = n_words + marks.indices.to_numpy()
            unit[~is_plain, 0] = n_marks + np.arange(len(others))
            ids.append(b"")
            unit[~is_plain, 1] = len(ids) - 1
        else:
            ids = self._encoded(texts.fill_null("").to_pylist())
            ids.append(b"")
            codes, first = np.arange(len(texts)), np.arange(len(texts) + 1)
            unit = np.stack((codes, np.full(len(codes), len(ids) - 1)), axis=1)
        # the ids of each distinct stretch, one behind the other
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        flat, size = _gathered(flat, size, unit.ravel())
        size = size.reshape(-1, 2).sum(axis=1)
        flat, each = _gathered(flat, size, codes)
        offsets = np.concatenate(([0], np.cumsum(each)))[first]
        return np.insert(flat, offsets[1:], END), offsets + np.arange(len(offsets))

    def batches(self, texts: pa.Array):
        """(first row, last row + 1, ids, offsets) by pieces of bounded size."""
        _, offsets = as_bytes(texts)
        for begin, end in chunks(offsets, CHUNK_BYTES):
            yield begin, end, *self.encode(texts.slice(begin, end - begin))
