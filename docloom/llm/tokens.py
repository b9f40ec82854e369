"""Token ids of whole texts, cut into bounded pieces."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batched, text_of

#: Words per generation of a worker's cache; two generations are kept, which bounds memory and never results.
CACHE_WORDS = 500_000
#: Words encoded at once.
BLOCK_WORDS = 500
#: Where Python sees blanks but the vocabularies don't; texts with these are split at plain blanks alone.
SEPARATORS = "\x1c\x1d\x1e\x1f"
BLANKS = re.compile(r"[ \n\t]+")


def blank_split(text: str) -> list[str]:
    """A text cut at blanks, at each of which every supported vocabulary starts a new word."""
    return BLANKS.split(text) if any(c in text for c in SEPARATORS) else text.split()


_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes a text word by word, remembering each word's ids as bytes.

    Sound for vocabularies that drop white space and never join across it; ``whole`` is the plain encoding
    that tests compare with.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        """Encode new words as one text and tell their ids apart by where each token starts."""
        for k in range(0, len(words), BLOCK_WORDS):
            part = words[k : k + BLOCK_WORDS]
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4")
            at = np.array([o[0] for o in e.offsets], dtype=np.int64)
            cuts = np.searchsorted(at, starts).tolist()
            raw = ids.tobytes()
            self.words.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, cuts, cuts[1:], strict=False))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) > CACHE_WORDS:
            self.words, self.older = {}, self.words
        split, fresh, get = [blank_split(t) for t in texts], set(), self.words.get
        for words in split:
            found = list(map(get, words))
            if None in found:
                fresh.update([w for w, ids in zip(words, found, strict=True) if ids is None])
        for w in fresh & self.older.keys():
            self.words[w] = self.older[w]
        self._learn([w for w in fresh if w not in self.words])
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]


def encoder(path: str) -> WordEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, *, max_tokens: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most max_tokens tokens: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its text's ids followed by end_id; only longer ones are cut. A null or empty text gives the
    one-token piece [end_id]. Repeated rows give repeated pieces; an empty table gives none; other columns
    are ignored. ids is little-endian unsigned 32-bit binary.
    """
    tail = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, body in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist()), strict=True):
                ids = body + tail
                for piece, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    for column, value in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:keep], types, strict=False)], names=names[:keep])

    return batched(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), run, PIECES + (", ids binary" if with_ids else ""))
