"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word (with the word mark in front, lower case) has as its probability the
sum over all of its segmentations into pieces, found by the forward algorithm;
a text has the product over its words, and the posterior under equal priors
names its language. Piece probabilities come from expectation maximisation
(forward-backward counts) over the words of a bounded sample of documents.

Bounds, all parameters: ``SAMPLE`` documents a language for the fit (picked by
a hash of the id), ``LANGUAGES`` languages of ``LEAST`` documents or more. Scoring reads whole texts. A word is one lattice, however
long: as long as no product of its characters' smallest probabilities can leave
the range of a double, plain products are summed, and beyond that logarithms; a
word of more than ``BROAD`` characters goes by itself, block by block.

Defined cases: ``und`` with score 0 for a null or empty text and for one with
no letter (number signs like a superscript two are none); equal scores go to the first language by name; documents with a
null id or a null language teach nothing; with nothing to learn from, every
document is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.llm.common import learnable, with_results

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SAMPLE = 2000
ROUNDS = 3
SMOOTHING = 0.02
SAFE = 600.0  # exp(-SAFE) and all its factors lie well inside the doubles
BROAD = 512  # characters of words that share one pass
UNKNOWN = 1e-9  # probability of a character that no piece covers
CACHE = 80_000  # words a task remembers
BLOCK = 5_000  # words that one pass over the lattice takes
LONG_BLOCK = 160  # of words for which logarithms are summed
STRETCH = 2_048  # characters of one very long word at hand at once
PART = 100_000  # words of texts at hand at once, and those of one more text
MARK = "▁"
LANGUAGES = 200  # learned at most: those with the most documents
LEAST = 2  # learnable documents of a language that is learned

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(points: np.ndarray) -> np.ndarray:
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Lattice:
    """Finds the pieces inside words, many words at a time."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        prefixes = sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)})
        keys = np.array([self._hash(p) for p in prefixes], dtype=np.uint64)
        index = {p: i for i, p in enumerate(pieces)}
        ids = np.array([index.get(p, -1) for p in prefixes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        # Where the keys of each 18-bit prefix begin: lookups then need few steps.
        self.bits = np.uint64(64 - 18)
        self.first = np.searchsorted(self.keys >> self.bits, np.arange(1 << 18, dtype=np.uint64))
        self.steps = int(np.bincount((self.keys >> self.bits).astype(np.int64)).max())
        self.keys = np.append(self.keys, np.zeros(self.steps, np.uint64))
        self.ids = np.append(self.ids, np.full(self.steps, -1))

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in _codes(np.frombuffer(piece.encode("utf-32-le"), np.uint32)):
            h = h * _BASE + c
        return h[0]

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Is it the beginning of a piece, and which piece is it (or -1)?"""
        at = self.first[h >> self.bits]
        known, ids = np.zeros(len(h), bool), np.full(len(h), -1, np.int64)
        for _ in range(self.steps):
            hit = self.keys[at] == h
            known |= hit
            ids = np.where(hit, self.ids[at], ids)
            at = at + 1
        return known, ids

    def edges(self, words: list[str]) -> tuple[np.ndarray, dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]:
        """Word lengths and, by (start, length), the words and piece ids; id
        -1 stands for a single character that is no piece."""
        lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
        width = int(lengths.max(initial=0))
        points = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"),
                               np.uint32).reshape(len(words), width)
        codes = _codes(points)
        found = {}
        for start in range(width):
            rows = np.flatnonzero(lengths > start)
            h = np.zeros(len(rows), np.uint64)
            for n in range(1, min(self.longest, width - start) + 1):
                if n > 1:
                    keep = lengths[rows] >= start + n
                    rows, h = rows[keep], h[keep]
                if not len(rows):
                    break
                h = h * _BASE + codes[rows, start + n - 1]
                known, ids = self._find(h)
                hit = ids >= 0
                if n == 1:
                    found[start, 1] = rows, ids  # a character outside all pieces keeps id -1
                elif hit.any():
                    found[start, n] = rows[hit], ids[hit]
                rows, h = rows[known], h[known]
        return lengths, found

    def _parts(self, words: list[str], logs: np.ndarray) -> Iterator[tuple[list[int], int]]:
        """Numbers of words of like length, and how they are summed: 0 by
        products, 1 by logarithms, 2 one word block by block."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        # Each single character is an edge, so a word of n characters has at
        # least the n-th power of the smallest probability.
        safe = int(SAFE / max(1.0, -float(logs.min(initial=0))))
        lengths = np.fromiter((len(words[i]) for i in order), np.int64, len(order))
        short, broad = np.searchsorted(lengths, [safe + 1, max(BROAD, safe) + 1])
        for lo, hi, size, kind in ((0, short, BLOCK, 0), (short, broad, LONG_BLOCK, 1), (broad, len(order), 1, 2)):
            for at in range(lo, hi, size):
                yield order[at:min(hi, at + size)], kind

    def forward(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """Log probability of each word under each column of ``probs`` (one
        row a piece, and a last row for the unknown character)."""
        out = np.empty((len(words), probs.shape[1]))
        logs = np.log(probs)
        for part, kind in self._parts(words, logs):
            if kind == 2:
                out[part[0]] = self._forward_one(words[part[0]], logs)[-1]
                continue
            lengths, found = self.edges([words[i] for i in part])
            alpha = self._forward_logs(lengths, found, logs) if kind else self._forward(lengths, found, probs)
            last = alpha[lengths, np.arange(len(part))]
            out[part] = last if kind else np.log(last)
        return out

    @staticmethod
    def _forward(lengths, found, probs) -> np.ndarray:
        alpha = np.zeros((int(lengths.max(initial=0)) + 1, len(lengths), probs.shape[1]))
        alpha[0] = 1.0
        for (start, n), (rows, ids) in found.items():  # by ascending start
            alpha[start + n][rows] += alpha[start][rows] * probs[ids]
        return alpha

    @staticmethod
    def _forward_logs(lengths, found, logs) -> np.ndarray:
        alpha = np.full((int(lengths.max(initial=0)) + 1, len(lengths), logs.shape[1]), -np.inf)
        alpha[0] = 0.0
        for (start, n), (rows, ids) in found.items():
            alpha[start + n][rows] = np.logaddexp(alpha[start + n][rows], alpha[start][rows] + logs[ids])
        return alpha

    def _stretches(self, word: str, logs: np.ndarray, back: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Blocks of a word: the first start, and by (length - 1, start) the
        piece ids (-1: a character that is no piece) and their log
        probabilities (-inf: no piece)."""
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        none = np.vstack((logs, np.full((1, logs.shape[1]), -np.inf)))
        blocks = range(0, len(points), STRETCH)
        for lo in reversed(blocks) if back else blocks:
            codes = _codes(points[lo:lo + STRETCH + self.longest - 1])
            size = min(STRETCH, len(points) - lo)
            ids = np.full((self.longest, size), len(logs), np.int64)
            h = np.zeros(size, np.uint64)
            for n in range(1, self.longest + 1):
                m = min(size, len(codes) - n + 1)  # starts with so many characters after them
                if m <= 0:
                    break
                h = h[:m] * _BASE + codes[n - 1:n - 1 + m]
                hit = self._find(h)[1]
                ids[n - 1, :m] = hit if n == 1 else np.where(hit >= 0, hit, len(logs))
            yield lo, ids, none[np.where(ids < 0, len(logs) - 1, ids)]

    def _forward_one(self, word: str, logs: np.ndarray, keep: bool = False) -> np.ndarray:
        """Log sums at every place of one word, or only at its end."""
        ahead = np.full((self.longest + 1, logs.shape[1]), -np.inf)  # this place and those that it reaches
        ahead[0] = 0.0
        out = [ahead[0].copy()]
        for _, _, edge in self._stretches(word, logs):
            for k in range(edge.shape[1]):
                reached = np.logaddexp(ahead[1:], ahead[0] + edge[:, k])
                ahead[:-1] = reached
                ahead[-1] = -np.inf
                if keep:
                    out.append(ahead[0].copy())
        return np.array(out) if keep else ahead[:1]

    def _expected_one(self, word: str, count: float, logs: np.ndarray, total: np.ndarray) -> None:
        alpha = self._forward_one(word, logs, keep=True)[:, 0]
        beta = np.full(len(word) + self.longest + 1, -np.inf)
        beta[len(word)] = 0.0
        for lo, ids, edge in self._stretches(word, logs, back=True):
            edge = edge[:, :, 0]
            for k in reversed(range(edge.shape[1])):
                beta[lo + k] = np.logaddexp.reduce(edge[:, k] + beta[lo + k + 1:lo + k + 1 + self.longest])
            for n in range(1, self.longest + 1):
                at = np.flatnonzero(ids[n - 1] < len(logs))
                uses = np.exp(alpha[lo + at] + edge[n - 1, at] + beta[lo + at + n] - alpha[-1]) * count
                total += np.bincount(ids[n - 1, at] % len(logs), uses, len(logs))

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words."""
        total = np.zeros(len(prob))
        logs = np.log(prob)[:, None]
        for part, kind in self._parts(words, logs):
            if kind == 2:
                self._expected_one(words[part[0]], float(counts[part[0]]), logs, total)
                continue
            lengths, found = self.edges([words[i] for i in part])
            here = np.arange(len(part))
            if kind == 1:
                alpha = self._forward_logs(lengths, found, logs)[:, :, 0]
                beta = np.full_like(alpha, -np.inf)
                beta[lengths, here] = 0.0
                last = alpha[lengths, here]
                for (start, n), (rows, ids) in reversed(found.items()):
                    through = logs[ids, 0] + beta[start + n][rows]
                    beta[start][rows] = np.logaddexp(beta[start][rows], through)
                    uses = np.exp(alpha[start][rows] + through - last[rows]) * counts[part][rows]
                    total += np.bincount(ids % len(prob), uses, len(prob))
                continue
            alpha = self._forward(lengths, found, prob[:, None])[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[lengths, here] = 1.0
            share = counts[part] / alpha[lengths, here]
            for (start, n), (rows, ids) in reversed(found.items()):
                through = prob[ids] * beta[start + n][rows]
                beta[start][rows] += through
                total += np.bincount(ids % len(prob), alpha[start][rows] * through * share[rows], len(prob))
        return total


@lru_cache(maxsize=2)
def lattice(model_file: str) -> Lattice:
    return Lattice(model_file)


def has_letter(text: str) -> bool:
    """Whether a character of a Unicode letter category occurs."""
    return any(map(str.isalpha, text))


def words_of(text: str) -> list[str]:
    """Marked lower-case words."""
    return [MARK + w for w in text.lower().split()]


def learn_pieces(words: list[str], counts: np.ndarray, model_file: str = VOCABULARY) -> np.ndarray:
    """Piece probabilities of one language, and the unknown character's."""
    lat = lattice(model_file)
    prob = np.full(len(lat.pieces) + 1, 1.0 / len(lat.pieces))
    prob[-1] = UNKNOWN
    for _ in range(ROUNDS):
        uses = lat.expected(words, counts, prob)[:-1] + SMOOTHING
        prob[:-1] = uses / uses.sum()
    return prob


def learn(docs: DataFrame, sample: int = SAMPLE, model_file: str = VOCABULARY, languages: int = LANGUAGES,
          least: int = LEAST) -> tuple[list[str], np.ndarray]:
    """Languages, by name, and their piece probabilities (one column each),
    from the learnable documents: the ``languages`` values with the most
    documents (the first by name of equal ones) that have ``least`` or more, so
    that stray values neither grow the model nor draw texts. One number a piece
    and language, whatever the input."""
    known = docs.filter(learnable(F.col("doc_id")) & F.col("lang").isNotNull()).select(
        "doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    sizes = known.groupBy("lang").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "lang").limit(
        languages).collect()
    if not sizes:
        return [], np.zeros((1, 0))
    size = F.element_at(F.create_map(*[F.lit(v) for r in sizes for v in r]), F.col("lang"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    picked = known.filter(F.col("lang").isin([r[0] for r in sizes])).filter(share * size < F.lit(1_000_000 * sample))
    words = picked.select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).filter("word <> ''")
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        table: dict[str, int] = {}
        for word, n in zip(group["word"], group["n"]):
            for w in words_of(word):
                table[w] = table.get(w, 0) + n
        prob = learn_pieces(list(table), np.fromiter(table.values(), float, len(table)), model_file)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "prob": [prob]})

    fitted = counts.groupBy("lang").applyInPandas(fit, "lang string, prob array<double>")
    rows = sorted(fitted.collect(), key=lambda r: r[0])
    return [r[0] for r in rows], np.array([r[1] for r in rows]).T


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], model_file: str = VOCABULARY) -> DataFrame:
    """``(row, lang_pred, score, fit)``: the input row, the language of the whole
    text, its posterior, and the log probability under it for each character
    (with a mark for each word). ``fit`` is null for a text without a letter and
    0 where nothing was learned."""
    names = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1])  # pieces x languages
    cache: dict[str, int] = {}
    state: dict = {}

    def score(texts: list[str]) -> dict[str, pa.Array]:
        preds, scores, fits = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts)
        known = [k for k, t in enumerate(texts) if has_letter(t)]
        if not names:
            for k in known:
                fits[k] = 0.0
            known = []
        at = 0
        while at < len(known):  # part by part, so that words at hand stay few
            part, n = [], 0
            while at < len(known) and (not part or n < PART):
                part.append((known[at], words_of(texts[known[at]])))
                n += len(part[-1][1])
                at += 1
            if len(cache) > CACHE:
                cache.clear()
                state.clear()
            new = list({w for _, ws in part for w in ws if w not in cache})
            if new:
                first = len(cache)
                cache.update((w, first + i) for i, w in enumerate(new))
                logs = lattice(model_file).forward(new, shared.value)
                if "used" not in state or state["used"] + len(new) > len(state["logs"]):
                    grown = np.empty((max(1 << 16, 2 * (first + len(new))), len(names)))
                    grown[:first] = state["logs"][:first] if first else 0
                    state["logs"] = grown
                state["logs"][first:first + len(new)] = logs
                state["used"] = first + len(new)
            for k, ws in part:
                total = state["logs"][np.fromiter((cache[w] for w in ws), np.int64, len(ws))].sum(axis=0)
                best = int(total.argmax())
                preds[k], scores[k] = names[best], 1.0 / np.exp(total - total[best]).sum()
                fits[k] = float(total[best]) / sum(map(len, ws))
        return {"lang_pred": pa.array(preds, pa.string()), "score": pa.array(scores), "fit": pa.array(fits, pa.float64())}

    return with_results(docs, score, "lang_pred string, score double, fit double")


def identify_documents(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    return identify(docs, learn(docs if learn_from is None else learn_from))
