"""SentencePiece encoding and decoding, exact for a BPE model.

The model of the vocabulary is a BPE model: its scores are the ranks of merges,
so the pieces of a text come from merging neighbours, best rank first, and not
from a best path. Merges stay inside parts that no piece can span, so a text is
cut into units there and each distinct unit is merged once a task, by
SentencePiece itself:

- before a word mark that follows no other mark (all pieces with a mark
  further on consist of marks only; ``Model`` checks that);
- in a unit of more than ``LONGEST`` characters, also between two characters
  that lie side by side in no piece. A long run without such a place stays
  whole.

A character that no piece covers is spelled by its UTF-8 byte pieces. Texts
take their units' ids where they lie: nothing is shuffled, and a task holds one
slice of texts, ``CACHE`` units and one unit of any length.

Defined cases: a null or empty text has no ids; rows that repeat an id get a
row each; the ids are those of the words (ASCII white space between them) with
single blanks between, and decoding gives that text; a word mark inside a text
is SentencePiece's blank and reads as one; ids of control pieces, and outside
the vocabulary, decode to nothing, and bytes that are no UTF-8 to U+FFFD.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.llm.common import WORD, id_and_text, package_on_workers, text_slices
from tripcast.llm.quality import words

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
LONGEST = 4096
CACHE = 200_000  # units a task remembers
AT_ONCE = 1 << 16  # characters of units that one call merges, about
GUARD = "\n"  # in no piece and in no word: nothing merges across it

_WORDS = re.compile(WORD)
_MARKED = re.compile(f"(?<!{MARK})(?={MARK})")


class Model:
    """The vocabulary, and the ids of the units met so far."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        silent = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        first = next(i for i in range(n) if sp.is_byte(i))
        self.guard = first + ord(GUARD)
        self.bytes = pa.array([b"" if silent[i] else bytes([i - first]) if sp.is_byte(i) else sp.id_to_piece(i).encode()
                               for i in range(n)] + [b""], pa.binary())
        whole = [sp.id_to_piece(i) for i in range(n) if not silent[i] and not sp.is_byte(i)]
        if any(GUARD in p or (MARK in p[1:] and p.strip(MARK)) for p in whole):
            raise ValueError(f"units are not separate in {model_file}")
        self.pairs = np.unique(np.concatenate([self._pairs(p) for p in whole]))
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.starts = np.zeros(1 << 20, np.int32), np.zeros(CACHE, np.int64)
        self.used = 0  # ids; unit k has those from starts[k] to starts[k + 1]

    @staticmethod
    def _pairs(s: str) -> np.ndarray:
        p = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64)
        return (p[:-1] << 21) | p[1:]

    def units(self, text: str) -> list[str]:
        """Units of a text, in order, each without its first mark; one that
        does not begin a word has ``GUARD`` there."""
        out = _WORDS.findall(text)
        if out and MARK in text:
            out = [u[1:] for u in _MARKED.split(MARK + MARK.join(out)) if u]
        if any(len(u) > LONGEST for u in out):
            out = [part for u in out for part in (self._cut(u) if len(u) > LONGEST else [u])]
        return out

    def _cut(self, unit: str) -> Iterator[str]:
        marked = MARK + unit
        free = np.flatnonzero(~np.isin(self._pairs(marked), self.pairs)) + 1
        lo = 0
        while lo < len(marked):  # about LONGEST characters each, if there are places
            k = np.searchsorted(free, lo + LONGEST)
            hi = int(free[k]) if k < len(free) else len(marked)
            yield marked[1:hi] if lo == 0 else GUARD + marked[lo:hi]
            lo = hi

    def _learn(self, new: list[str]) -> None:
        lo = 0
        while lo < len(new):
            hi, size = lo, 0
            while hi < len(new) and (hi == lo or size + len(new[hi]) < AT_ONCE):
                size += len(new[hi]) + 1
                hi += 1
            ids = np.asarray(self.sp.encode_as_ids("".join(
                u if u[:1] == GUARD else f"{GUARD}{MARK}{u}" for u in new[lo:hi])), np.int32)
            at = np.flatnonzero(ids == self.guard)  # SentencePiece's own mark lies before the first
            keep = ids[at[0]:]
            at = at - at[0]
            first = len(self.at)
            self.at.update((u, first + k) for k, u in enumerate(new[lo:hi]))
            starts = self.used + at - np.arange(len(at))
            keep = keep[keep != self.guard]
            while self.used + len(keep) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            while first + len(at) + 1 > len(self.starts):
                self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            self.ids[self.used:self.used + len(keep)] = keep
            self.used += len(keep)
            self.starts[first:first + len(at)] = starts
            self.starts[first + len(at)] = self.used
            lo = hi

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and where each text's begin and end."""
        if len(self.at) > CACHE:
            self.clear()
        units = [self.units(t) for t in texts]
        flat = [u for us in units for u in us]
        self._learn([u for u in dict.fromkeys(flat) if u not in self.at])
        which = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        begin, size = self.starts[which], self.starts[which + 1] - self.starts[which]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
        return ids, ends[np.concatenate(([0], np.cumsum([len(us) for us in units])))]

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of a list array of ids."""
        flat = pc.fill_null(ids.flatten(), -1).to_numpy()
        flat = np.where((flat >= 0) & (flat < len(self.bytes) - 1), flat, len(self.bytes) - 1)
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes)))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.bytes.take(pa.array(flat))), b"")
        return pa.array([b.decode("utf-8", "replace").replace(MARK, " ").lstrip(" ") for b in joined.to_pylist()], pa.string())


@lru_cache(maxsize=2)
def model(model_file: str) -> Model:
    return Model(model_file)


def encode(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """``(doc_id, ids)``: all piece ids of every text, in order."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in text_slices(batches):
            ids, ends = model(model_file).encode([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))],
                ["doc_id", "ids"])

    package_on_workers(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def _with_text(encoded: DataFrame, model_file: str) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, model(model_file).decode(part.column(1))], ["doc_id", "ids", "text"])

    package_on_workers(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(
        run, "doc_id long, ids array<int>, text string")


def decode(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` of rows with ``doc_id`` and ``ids``."""
    return _with_text(encoded, model_file).select("doc_id", "text")


def digests(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """``(doc_id, n_units, n_pieces, checksum, text_sha256)``: a digest of the
    ids that :func:`encode` gives, and the words and digest of the text that
    :func:`decode` makes of them."""
    return _with_text(encode(docs, model_file), model_file).select(
        "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_units"), F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("checksum"), F.sha2("text", 256).alias("text_sha256"))
