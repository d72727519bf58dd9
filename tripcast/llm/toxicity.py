"""Toxicity by a subsequence string-kernel support vector machine.

Kernel: a term is described by all its three-letter subsequences that span at
most ``SPAN`` characters, each weighted ``DECAY ** span``; other characters
inside only widen the gap. The description is scaled by the root of its
summed squared weights, so the kernel of two terms is a scaled inner product,
and gapped or padded spellings ("i-d-i-o-t", "idxiot") stay near the plain
word. Single letters set apart by blanks are joined to one term.

Nystroem: the kernel to ``LANDMARKS`` terms, whitened by the landmarks' own
kernel matrix, gives the features of a linear support vector machine. The
weights then fold back into one number for each letter triple, so scoring a
term is a table look-up (the same value, without a loop over landmarks).

Training: sentences of a bounded, hashed sample of labelled documents
(``SAMPLE`` a class; equal texts once). A toxic document's sentences are
toxic only somewhere, so the positive terms are the witnesses: terms of toxic
sentences and beginnings of terms that hardly occur in clean ones, with
support in at least ``SUPPORT`` of the toxic documents. Negative terms come
from clean sentences, half by hash and half as the worst so far scored. A
document is described by its worst term's margin and the logarithm of how many
of its terms have a positive one; a logistic function of the two, fitted on
the sample's documents, is the score.

Defined cases: a null or empty text has the margin of no term at all; with no
toxic or no clean sample every score is the toxic share (0 without labels);
a document with several label rows is toxic if one of them says so.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.llm.common import learnable, with_results, written

SPAN, DECAY = 8, 0.7
LANDMARKS = 64
SAMPLE = 3000  # documents a class
SUPPORT = 0.02  # least share of the sampled toxic documents that hold a witness
IMPURE = 0.05  # most clean documents with a witness, against toxic ones
WITNESSES = 240
NEGATIVES, HARD = 3000, 30_000
COST, BALANCE = 1.0, 3.0  # of a slack, and the most by which a rare class weighs more
ALIKE = 0.9  # no two landmarks are nearer than this
FLAT = 1e-2  # eigenvalues of the landmarks' kernel below this share are left out
WINDOW, STEP = 24, 8  # longer terms are scored by overlapping windows
THRESHOLD = 0.3
NOTHING = -2.0  # margin of a text without terms
CACHE = 500_000

LETTERS = 28  # 0: no letter, 1-26: a-z, 27: any other letter
LOOKS_LIKE = str.maketrans("01345@", "oieasa")
SET_APART = re.compile(r"(?<!\S)\w(?:[ \t]\w){2,}(?!\S)")
SENTENCE = r"[.!?]+\s|\n"


def terms_of(text: str) -> set[str]:
    low = text.lower()
    found = set(low.split())
    for run in SET_APART.findall(low):
        found.add("".join(run.split()))
    return found


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


@lru_cache(maxsize=1)
def _code_table() -> np.ndarray:
    return np.array([_code(chr(i)) for i in range(0x3000)], dtype=np.int32)


@lru_cache(maxsize=64)
def _triples(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    found = [(i, j, k, DECAY ** (k - i + 1)) for i in range(length)
             for k in range(i + 2, min(length, i + SPAN)) for j in range(i + 1, k)]
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0)
    i, j, k, w = zip(*found)
    return np.array(i), np.array(j), np.array(k), np.array(w)


def windows(term: str) -> list[str]:
    term = term.translate(LOOKS_LIKE) if any("a" <= c <= "z" for c in term) else term
    if len(term) <= WINDOW:
        return [term]
    return [term[at:at + WINDOW] for at in range(0, len(term) - WINDOW + STEP, STEP)]


def describe(parts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For parts grouped by length: their places, triple numbers and scaled
    weights (0 where a triple touches a character that is no letter)."""
    by_length: dict[int, list[int]] = {}
    for at, p in enumerate(parts):
        by_length.setdefault(len(p), []).append(at)
    out = []
    table = _code_table()
    for length, places in by_length.items():
        i, j, k, w = _triples(length)
        if not len(i):
            continue
        for at in range(0, len(places), 4096):
            some = places[at:at + 4096]
            points = np.frombuffer("".join(parts[p] for p in some).encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 27).reshape(-1, length)
            a, b, c = codes[:, i], codes[:, j], codes[:, k]
            weight = np.where((a > 0) & (b > 0) & (c > 0), w, 0.0)
            norm = np.sqrt((weight * weight).sum(axis=1, keepdims=True))
            out.append((np.array(some), (a * LETTERS + b) * LETTERS + c, weight / np.where(norm > 0, norm, 1.0)))
    return out


@dataclass
class Model:
    triples: np.ndarray  # weight of each letter triple
    bias: float
    curve: tuple[float, float, float]  # of the worst margin, the log count and 1
    base: float  # the score where nothing could be learned

    def margins(self, terms: list[str]) -> np.ndarray:
        """Margin of each term: its worst window's."""
        parts, owner = [], []
        for at, t in enumerate(terms):
            for p in windows(t):
                parts.append(p)
                owner.append(at)
        value = np.zeros(len(parts))
        for places, triple, weight in describe(parts):
            value[places] = (self.triples[triple] * weight).sum(axis=1)
        out = np.full(len(terms), -np.inf)
        np.maximum.at(out, np.array(owner, dtype=np.int64), value)
        return np.maximum(out + self.bias, NOTHING)

    def score(self, margin: np.ndarray, hits: np.ndarray) -> np.ndarray:
        if not self.triples.any():
            return np.full(len(margin), self.base)
        a, b, c = self.curve
        return 1.0 / (1.0 + np.exp(-(a * margin + b * np.log1p(hits) + c)))


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Kernel matrix of two lists of terms (the first window of each)."""
    def dense(terms):
        m = np.zeros((len(terms), LETTERS ** 3))
        for places, triple, weight in describe([windows(t)[0] for t in terms]):
            for p, u, v in zip(places, triple, weight):
                np.add.at(m[p], u, v)
        return m
    right = dense(b)
    return np.vstack([dense(a[at:at + 512]) @ right.T for at in range(0, len(a), 512)]) if a else np.zeros((0, len(b)))


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Linear support vector machine (hinge loss, balanced classes) by dual
    coordinate descent; the last feature is the constant."""
    cost = np.where(y > 0, COST * min(BALANCE, (y < 0).sum() / max(1, (y > 0).sum())), COST)
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    square = (x * x).sum(axis=1)
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            if square[i] > 0:
                new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0.0), cost[i])
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _apart(terms: list[str], most: int) -> list[str]:
    """The first terms of which no two are alike."""
    near = kernel(terms, terms)
    kept: list[int] = []
    for at in range(len(terms)):
        if len(kept) < most and near[at, at] > 0 and not (near[at, kept] > ALIKE).any():
            kept.append(at)
    return [terms[at] for at in kept]


def _fit_terms(positive: list[str], negative: list[str], hard: list[str]) -> Model:
    landmarks = _apart(positive, LANDMARKS * 3 // 4)
    landmarks = landmarks + _apart(negative[:4 * LANDMARKS], LANDMARKS - len(landmarks))
    # Padded spellings of the witnesses are witnesses too.
    padded = [t[:at] + c + t[at:] for t in _apart(positive, LANDMARKS) if len(t) > 3
              for at, c in ((len(t) // 2, "x"),)]
    positive = positive + padded
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = values > FLAT * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    own = np.zeros((len(landmarks), LETTERS ** 3))
    for places, triple, weight in describe([windows(t)[0] for t in landmarks]):
        for p, u, v in zip(places, triple, weight):
            np.add.at(own[p], u, v)
    model, extra = None, []
    for _ in range(3):
        rest = negative + extra
        x = np.hstack([kernel(positive + rest, landmarks) @ whiten, np.ones((len(positive) + len(rest), 1))])
        w = _svm(x, np.array([1.0] * len(positive) + [-1.0] * len(rest)))
        model = Model((whiten @ w[:-1]) @ own, float(w[-1]), (0.0, 0.0, 0.0), 0.0)
        worst = np.argsort(-model.margins(hard))[:NEGATIVES // 4] if hard else []
        extra = sorted({hard[i] for i in worst} | set(extra))
    return model


def _calibrate(margin: np.ndarray, hits: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Logistic function by Newton steps, with a small ridge."""
    x = np.stack([margin, np.log1p(hits), np.ones(len(margin))], axis=1)
    y = (label > 0).astype(float)
    w, ridge = np.zeros(3), np.array([0.5, 0.5, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled, learnable documents (see the module text)."""
    known = (labels.filter(learnable(F.col("doc_id")) & F.col("toxic").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    size = dict(known.groupBy("toxic").count().collect())
    share = size.get(1, 0) / max(1, sum(size.values()))
    nothing = Model(np.zeros(LETTERS ** 3), 0.0, (0.0, 0.0, 0.0), share)
    if not size.get(1) or not size.get(0):
        return nothing
    by_hash = F.xxhash64("doc_id")
    picked = (known.filter("toxic = 1").orderBy(by_hash, "doc_id").limit(sample)
              .unionByName(known.filter("toxic = 0").orderBy(by_hash, "doc_id").limit(sample)))
    # At most 2 * sample ids, hence small whatever the input.
    rows = written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
                   .join(F.broadcast(picked), "doc_id").dropDuplicates(["text", "toxic"]), "toxic-sample")
    sentences = rows.select("doc_id", "toxic", F.explode(F.split(F.lower("text"), SENTENCE)).alias("s"))
    strip = F.regexp_replace("t", r"^[^\p{L}]+|[^\p{L}]+$", "")
    terms = (sentences.select("doc_id", "toxic", F.explode(F.split("s", r"\s+")).alias("t"))
             .select("doc_id", "toxic", strip.alias("t")).filter(F.length("t").between(3, WINDOW)).distinct())
    starts = F.explode(F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.length("t"))),
                                   lambda n: F.substring("t", F.lit(1), n)))
    counts = written(terms.select("doc_id", "toxic", "t", F.length("t").alias("whole"), starts.alias("start"))
                     .groupBy("doc_id", "toxic", "start").agg(F.max(F.col("whole") == F.length("start")).alias("whole"))
                     .groupBy("start").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"),
                                           F.max("whole").alias("whole")), "toxic-terms")
    n_bad = rows.filter("toxic = 1").count()
    pure = (F.col("bad") >= max(3.0, SUPPORT * n_bad)) & (F.col("n") - F.col("bad") <= IMPURE * F.col("bad"))
    witnesses = [r[0] for r in counts.filter(pure).orderBy(F.desc("bad"), "start").limit(WITNESSES).collect()]
    if not witnesses:
        return nothing
    clean = counts.filter(F.col("whole") & (F.col("n") - F.col("bad") > IMPURE * F.col("bad"))).orderBy(F.xxhash64("start"), "start").limit(NEGATIVES + HARD)
    clean = [r[0] for r in clean.select("start").collect()]  # a fixed number of short terms
    model = _fit_terms(witnesses, clean[:NEGATIVES], clean[NEGATIVES:])
    found = np.array(score_texts(rows, model).select("margin", "hits", F.col("row.toxic").cast("double")).collect())
    model.curve = _calibrate(*found.T)
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``(row, margin, hits, score, predicted)`` for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[str, float] = {}

    def score(texts: list[str]) -> dict[str, pa.Array]:
        margins, hits = np.full(len(texts), NOTHING), np.zeros(len(texts), np.int32)
        at = 0
        while at < len(texts):  # part by part, so that new terms stay few
            part, n = [], 0
            while at < len(texts) and (not part or n < 100_000):
                found = terms_of(texts[at])
                part.append((at, found))
                n += len(found)
                at += 1
            if len(cache) > CACHE:
                cache.clear()
            new = list({t for _, found in part for t in found if t not in cache})
            if new:
                cache.update(zip(new, shared.value.margins(new).tolist()))
            for k, found in part:
                if found:
                    of = [cache[t] for t in found]
                    margins[k], hits[k] = max(of), sum(m > 0 for m in of)
        value = shared.value.score(margins, hits)
        return {"margin": pa.array(margins), "hits": pa.array(hits), "score": pa.array(value),
                "predicted": pa.array((value >= THRESHOLD).astype(np.int32))}

    return with_results(docs, score, "margin double, hits int, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_texts(docs, learn(docs, labels))
