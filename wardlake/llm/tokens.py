"""Token ids of whole texts by a ``tokenizers`` vocabulary, word by word with a memo.

The vocabularies used here drop white space before they merge, so the ids of a
text are the ids of its white-space separated words, one after the other.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: White space as the vocabulary's own normaliser sees it.
BLANKS = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Texts in which a comma or full stop before a blank may belong to a longer run of
#: signs, or that hold anything but ASCII and Latin-1 letters.
UNUSUAL = re.compile(r"[!-/:-@\[-`{-~]{2}|[\x1c-\x1f\x80-\xbf\xd7\xf7]|[^\x00-\xff]")
#: Words kept by one worker process before it starts anew (about 400 MB).
MEMO_WORDS = 1_600_000


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    """ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {}
        self.memo_words = memo_words

    def _one(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() and word.islower() or word == word.lower() and unicodedata.is_normalized("NFC", word) and not UNUSUAL.search(word)):
            # a single run of letters in its final form: the merges alone decide
            spelled = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            ids = [x.id for x in self.model.tokenize(spelled)]
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        if UNUSUAL.search(text):
            words = BLANKS.split(text)
        else:  # signs stand alone: split off those before a blank, so fewer different words are left
            text = text.lower() + " "
            for sign in ",.":
                for blank in " \n":
                    text = text.replace(sign + blank, f" {sign}{blank}")
            words = text.split()
        memo = self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            if len(memo) > self.memo_words:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = self._one(w)
            return b"".join([memo[w] for w in words])


_models: dict[tuple[str, int], WordTokenizer] = {}


def word_tokenizer(path: str, memo_words: int = MEMO_WORDS) -> WordTokenizer:
    """One per worker process."""
    if (path, memo_words) not in _models:
        _models[path, memo_words] = WordTokenizer(path, memo_words)
    return _models[path, memo_words]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text", end_id: int = 0, with_ids: bool = False, memo_words: int = MEMO_WORDS, keep_model: bool = True) -> DataFrame:
    """Each document's ids and an end id, cut into pieces of at most ``limit`` ids.

    NULL texts are empty (one id); the key may be NULL and passes unchanged.
    ``keep_model`` leaves vocabulary and memo with the worker for its next task.
    ``with_ids`` adds the ids themselves (binary, little-endian 32 bit).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_tokenizer(path, memo_words) if keep_model else WordTokenizer(path, memo_words)
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                rows: list[tuple] = []
                for k, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = model.encode(text or "") + end
                    for p, start in enumerate(range(0, len(ids), 4 * limit)):
                        part = ids[start : start + 4 * limit]
                        rows.append((k, p, start // 4, len(part) // 4, crc32(part), part if with_ids else None))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(columns[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(docs[key].cast("long"), docs[text]).mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))
