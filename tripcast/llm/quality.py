"""Quality rules: a base of counts, and a hashed n-gram log-likelihood ratio
between a trusted target and the raw corpus.

Words and pairs of neighbouring words of every document fall into ``BUCKETS``
hash buckets. Two multinomials, of the trusted documents (label quality 1) and
of all documents, give each bucket the logarithm of its probability ratio, kept
as whole micro-nats so that sums are exact in any order. A document's score is
the mean over its words and pairs; it passes at ``THRESHOLD`` or more. The
model has ``BUCKETS`` rows, whatever the input.

DataFrame operations only. Defined cases: a null or empty text has all counts
0 and fails the base; repeated rows are judged each; without trusted documents
the target is uniform; a document with several label rows is trusted if one of
them says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripcast.llm.common import written

BUCKETS = 4096  # three hexadecimal digits of the md5 of a word
PAIR = 31  # a pair's bucket is (PAIR * first + second + 1) modulo BUCKETS
THRESHOLD = -0.35  # mean nats a word or pair
MICRO = 1_000_000
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


def words(text: Column) -> Column:
    for c in SPACES[:-1]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def symbols(text: Column) -> Column:
    kept = text
    for c in SYMBOLS:
        kept = F.replace(kept, F.lit(c), F.lit(""))
    return F.length(text) - F.length(kept)


def repeat_words(ws: Column) -> Column:
    """From the sorted hashes of three-word windows: how many words lie in a
    window found twice or more. Two projections later the caller gets a
    number; see :func:`base_counts`."""
    window = F.transform(
        F.sequence(F.lit(0), F.size(ws) - 3),
        lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("p")))
    return F.when(F.size(ws) >= 3, F.sort_array(window))


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) and the base columns; ``words``
    holds the words."""
    text = F.col("text")
    d = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).withColumn("words", words(text))
    d = d.select("doc_id", "text", "words", repeat_words(F.col("words")).alias("__w"))
    sorted_windows = F.col("__w")

    def same(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(sorted_windows, i)["h"] == x["h"], F.lit(False))

    found = F.filter(sorted_windows, lambda x, i: same(x, i - 1) | same(x, i + 1))
    starts = F.sort_array(F.transform(found, lambda x: x["p"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"])
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return d.select(
        "doc_id", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        symbols(F.col("text")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def features(ws: Column) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    return F.transform(ws, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 3), 16, 10).cast("int"))


def pairs(buckets: Column) -> Column:
    return F.when(F.size(buckets) >= 2, F.transform(
        F.sequence(F.lit(1), F.size(buckets) - 1),
        lambda i: (F.get(buckets, i - 1) * PAIR + F.get(buckets, i) + 1) % BUCKETS)).otherwise(
        F.array().cast("array<int>"))


def ratio_model(found: DataFrame, labels: DataFrame) -> DataFrame:
    """``(bucket, micro)`` for each of the ``BUCKETS`` buckets, from rows with
    ``doc_id`` and the word buckets ``b``."""
    spark = found.sparkSession
    trusted = (labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
               .withColumn("__trusted", F.lit(1)))
    # The same join at every size: a broadcast of the labels has no bound.
    d = found.select("doc_id", "b").join(trusted.hint("shuffle_merge"), "doc_id", "left")
    counts = (d.select("__trusted", F.explode(F.concat("b", pairs(F.col("b")))).alias("bucket"))
              .groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__trusted").alias("target")))
    full = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    full = written(full.repartition(1), "quality-model")  # BUCKETS rows, counted before they meet
    totals = full.agg(F.sum("raw").alias("r"), F.sum("target").alias("t")).first()  # two numbers
    log = (F.log((F.col("target") + 1.0) / F.lit(float(totals.t + BUCKETS)))
           - F.log((F.col("raw") + 1.0) / F.lit(float(totals.r + BUCKETS))))
    return full.select("bucket", F.round(log * MICRO).cast("long").alias("micro"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base columns, ``base_failed``, the method's ``ratio_sum`` (micro-nats)
    over ``n_features``, and ``kept``. The texts are read once: base columns
    and word buckets go to a stored table."""
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = written(base_counts(docs).select(F.monotonically_increasing_id().alias("__row"), *base,
                                             features(F.col("words")).cast("array<smallint>").alias("b")), "quality")
    found = found.withColumn("b", F.col("b").cast("array<int>"))
    model = ratio_model(found, labels)
    d = found.select("__row", *base, F.explode_outer(F.concat("b", pairs(F.col("b")))).alias("bucket"))
    # The model has BUCKETS short rows, hence the hint.
    d = d.join(F.broadcast(model), "bucket", "left").groupBy("__row", *base).agg(
        F.count("bucket").alias("n_features"), F.coalesce(F.sum("micro"), F.lit(0)).alias("ratio_sum"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = F.col("ratio_sum") >= F.lit(int(threshold * MICRO)) * F.col("n_features")
    return d.select(*base, failed.alias("base_failed"), (~failed & passed).alias("kept"), "n_features", "ratio_sum")


# The same in DuckDB.
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
tri AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
cov AS (
  SELECT r, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE n >= 2) GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
b AS (
  SELECT r, doc_id, list_transform(w, lambda x: ('0x' || md5(x)[1:3])::INTEGER) AS h FROM d),
f AS (
  SELECT r, doc_id, unnest(h) AS bucket FROM b
  UNION ALL
  SELECT r, doc_id, (h[i] * {PAIR} + h[i + 1] + 1) % {BUCKETS}
  FROM (SELECT r, doc_id, h, unnest(range(1, len(h))) AS i FROM b)),
c AS (
  SELECT k.bucket, count(f.r) AS raw, count(t.doc_id) AS target
  FROM (SELECT unnest(range({BUCKETS})) AS bucket) k LEFT JOIN f USING (bucket)
  LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) t ON f.doc_id = t.doc_id GROUP BY k.bucket),
m AS (
  SELECT bucket, round({MICRO} * (
      ln((target + 1.0::DOUBLE) / ((SELECT sum(target) FROM c) + {BUCKETS})::DOUBLE)
    - ln((raw + 1.0::DOUBLE) / ((SELECT sum(raw) FROM c) + {BUCKETS})::DOUBLE)))::BIGINT AS micro FROM c),
s AS (
  SELECT r, count(*) AS n_features, sum(micro)::BIGINT AS ratio_sum FROM f JOIN m USING (bucket) GROUP BY r),
a AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_features, 0)::BIGINT AS n_features, coalesce(ratio_sum, 0)::BIGINT AS ratio_sum
  FROM d LEFT JOIN cov USING (r) LEFT JOIN lines USING (r) LEFT JOIN s USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)
    AND ratio_sum >= {int(THRESHOLD * MICRO)} * n_features AS kept,
  n_features, ratio_sum
FROM a
"""
