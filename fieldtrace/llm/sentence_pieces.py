"""Operator 13: SentencePiece encoding and decoding by a table of distinct marked words.

A normalised text is a row of marked words, each a run of white-space markers and what
follows up to the next marker.  Where no piece of the vocabulary goes on past the end of
such a word, words are segmented independently of each other.  Each Python worker keeps a
table of the distinct words it has met; a word is segmented once, and the ids of a text are
those of its words, joined by position.  Texts are handled a segment at a time.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Characters of a text that are handled together.
SEGMENT = 1 << 19
#: Words a table holds before a new one is begun (the one before is still looked at), and the longest word it keeps.
TABLE, WORD = 1 << 19, 64
#: Longer words are cut where no piece can join the characters, into parts of about this many characters.
PART = 4096
#: A character that stands before a part that is no word start, so that no marker is put there.
GUARD = "\n"
#: Values in a batch that goes back to Spark.
BATCH = 1 << 18

_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
_EDGE = re.compile(f"[^{MARK}]{MARK}").search


class Coder:
    """Encodes and decodes as the library does with the model in the file ``path``."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Whether pieces end where marked words do; else texts are encoded whole.
        self.by_words = not any(_EDGE(p) for p in pieces)
        inside = [p for i, p in enumerate(pieces) if not self.model.is_byte(i) and not self.model.is_control(i)]
        self.pairs = np.unique(np.array([ord(p[k]) << 32 | ord(p[k + 1]) for p in inside for k in range(len(p) - 1)], np.int64))
        self.guarded = not any(GUARD in p for p in inside) and self.model.normalize(GUARD).endswith(GUARD)
        self.before_part = len(self.model.encode(GUARD))
        #: Whether decoding drops the marker that ids begin with.
        self.drops_mark = self.model.decode(self.model.encode("a")) == "a" and self.model.normalize("a") == MARK + "a"
        #: Ids (int32 as bytes) and decoded text of each word.
        self.new: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def encode(self, text: str) -> np.ndarray:
        return self.encoded(text)[0]

    def encoded(self, text: str) -> tuple[np.ndarray, str]:
        """The ids of ``text``, and what decode() makes of them."""
        marked = self.model.normalize(text) if text else ""
        ids, texts = [], []
        for segment in _segments(marked) if self.by_words else [None]:
            found = self._joined(segment) if segment else None
            if found is None:  # pieces cross words, or normalisation alters a word that stands alone
                whole = self.model.encode(text)
                return np.array(whole, np.int32), self.model.decode(whole)
            ids.append(found[0])
            texts.append(found[1])
        plain = "".join(texts)
        return np.frombuffer(b"".join(ids), np.int32), plain[1:] if marked[:1] == MARK and self.drops_mark else plain

    def _joined(self, segment: str) -> tuple[bytes, str] | None:
        words = _WORDS(segment)
        got = list(map(self.new.get, words))
        if None in got and self.old:
            got = [self._known(w) if g is None else g for w, g in zip(words, got, strict=True)]
        if None in got:
            missing = list({w for w, g in zip(words, got, strict=True) if g is None})
            ids = self._segmented(missing)
            if None in ids:
                return None
            # A word that decodes alone loses its first marker as if it began a text.
            texts = [" " + t if w[0] == MARK and self.drops_mark else t for w, t in zip(missing, self.model.decode(ids, num_threads=1), strict=True)]
            fresh = {w: (array("i", i).tobytes(), t) for w, i, t in zip(missing, ids, texts, strict=True)}
            for w, found in fresh.items():
                if len(w) <= WORD:
                    self._keep(w, found)
            got = [fresh[w] if g is None else g for w, g in zip(words, got, strict=True)]
        return b"".join([g[0] for g in got]), "".join([g[1] for g in got])

    def _known(self, word: str) -> tuple[bytes, str] | None:
        found = self.old.get(word)
        if found is not None:
            self._keep(word, found)
        return found

    def _keep(self, word: str, found: tuple[bytes, str]) -> None:
        if len(self.new) >= TABLE:
            self.new, self.old = {}, self.new
        self.new[word] = found

    def _segmented(self, words: list[str]) -> list[list[int] | None]:
        """Ids of each word; None where its plain form is not normalised to the word again."""
        plain = [w[1:].replace(MARK, " ") if w[0] == MARK and self.drops_mark else w.replace(MARK, " ") for w in words]
        again = self.model.normalize(plain)
        short = [k for k, w in enumerate(words) if len(w) <= PART or not self.guarded]
        found: list[list[int] | None] = [None] * len(words)
        for k, ids in zip(short, self.model.encode([plain[k] for k in short], num_threads=1), strict=True):
            found[k] = ids
        for k in set(range(len(words))).difference(short):
            found[k] = list(chain.from_iterable(self._parts(words[k], plain[k])))
        return [ids if w == a else None for w, a, ids in zip(words, again, found, strict=True)]

    def _parts(self, word: str, plain: str) -> Iterator[list[int]]:
        """Ids of the parts of a long word, cut between characters that stand together in no piece."""
        lost, lo = len(word) - len(plain), 0
        while lo < len(word):
            hi = lo + PART
            while hi < len(word):
                codes = np.frombuffer(word[hi - 1 : hi + PART].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                free = np.flatnonzero(~np.isin(codes[:-1] << 32 | codes[1:], self.pairs))
                if len(free):
                    hi += int(free[0])
                    break
                hi += PART
            hi = min(hi, len(word))
            part = plain[max(lo - lost, 0) : hi - lost]
            yield self.model.encode(GUARD + part)[self.before_part :] if lo else self.model.encode(part)
            lo = hi


def _segments(marked: str) -> Iterator[str]:
    """Parts of ``marked`` of about SEGMENT characters that end where a marked word does."""
    lo = 0
    while len(marked) - lo > SEGMENT and (edge := _EDGE(marked, lo + SEGMENT)):
        yield marked[lo : edge.start() + 1]
        lo = edge.start() + 1
    if lo < len(marked):
        yield marked[lo:]


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The coder of the model file ``path``; kept by the Python worker."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded for every row of ``docs`` (doc_id, text).

    ids are those of the library's encode() without begin and end ids, decoded what its
    decode() makes of them.  A null or empty text has no ids and decodes to an empty text.
    Every row is encoded on its own: rows may repeat, ids be null; other columns are
    ignored.  A text of many megabytes is encoded in segments, a word of any length in
    parts between characters that no piece joins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            done, ids, texts, size = 0, [], [], 0
            for row, text in enumerate(batch.column(1)):
                found = own.encoded(text.as_py() or "")
                ids.append(found[0])
                texts.append(found[1])
                size += len(ids[-1]) + 1
                if size >= BATCH:
                    yield _rows(batch.column(0).slice(done, row + 1 - done), ids, texts)
                    done, ids, texts, size = row + 1, [], [], 0
            if ids:
                yield _rows(batch.column(0).slice(done), ids, texts)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _rows(doc_id: pa.Array, ids: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, ids)])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
    return pa.RecordBatch.from_arrays([doc_id, lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the rows of ``encoded``."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
