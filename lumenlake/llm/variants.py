"""Grouping of spelling variants by full neighbourhoods.

Each word emits every distinct string that is one deletion, replacement or insertion away, over
the letters that the words hold. Candidates meet the vocabulary by a hash join; what meets is one
edit away by construction, so no distance is computed. Candidates are numbers until they meet: a
polynomial hash of the word gives the hash of each edit in constant time. A filter of the
vocabulary (``most_bits`` at most, 16 bits a word below that) stops nearly all candidates that
are no words before the shuffle; beyond its bound more of them are shuffled, with the same result.
Candidates that meet are written out as strings and compared, so a hash collision adds no pair.

Edge cases: a null or empty text has no words; a null key counts as the empty text; repeated rows
count each; words of any length are treated alike; of near words with equal counts the smallest
is the form; an empty table gives no row. Other columns have no influence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import map_texts, stored
from lumenlake.llm.components import _jump

U = np.uint64
#: The hash's base, odd and so with an inverse, and the multipliers that spread its bits.
BASE, SPREAD, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
BACK = pow(BASE, -1, 1 << 64)
PROBES = 4
#: Candidates that are made at a time.
SLICE = 1 << 20


def letter_values(codes: np.ndarray) -> np.ndarray:
    """A fixed 64-bit value for each code point."""
    x = (codes.astype(U) + U(1)) * U(BASE)
    x = (x ^ (x >> U(30))) * U(SPREAD)
    x = (x ^ (x >> U(27))) * U(SECOND)
    return x ^ (x >> U(31))


def code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)


def powers(n: int) -> np.ndarray:
    """The base to the powers 0 to n - 1."""
    return np.cumprod(np.concatenate([np.ones(1, U), np.full(max(0, n - 1), BASE, U)]), dtype=U)


def hashes(words: list[str]) -> np.ndarray:
    """The polynomial hash of each word."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    weights = powers(int(sizes.max(initial=1)))[np.arange(sizes.sum()) - np.repeat(starts, sizes)]
    ends = np.concatenate([np.zeros(1, U), np.cumsum(letter_values(code_points(words)) * weights, dtype=U)])
    return ends[starts + sizes] - ends[starts]


def probes(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of each hash in a filter of ``bits`` (a power of two)."""
    first, second = (h * U(SPREAD)) >> U(32), ((h * U(SECOND)) >> U(32)) | U(1)
    return (first + U(k) * second) & U(bits - 1)


class Neighbourhood:
    """All words one edit away over an alphabet, of which only those that pass a filter are returned."""

    def __init__(self, alphabet: str, words: np.ndarray):
        self.letters = code_points([alphabet])
        self.values, self.words = letter_values(self.letters), words

    def passing(self, h: np.ndarray, keep: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(keep)
        for k in range(PROBES):
            bit = probes(h[at], k, len(self.words) * 64)
            at = at[(self.words[bit >> U(6)] >> (bit & U(63))) & U(1) == 1]
        return at

    def edits(self, words: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        """(word's place, hash, position, kind, letter) of candidates: kind 0 deletes, 1 replaces, 2 inserts.

        Of equal letters in a row only the first is deleted, and nothing is inserted before its own
        equal, so that no candidate comes twice.
        """
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for size, own in by_size.items():
            own = np.array(own)
            codes = code_points([words[i] for i in own]).reshape(len(own), size)
            weights, none = powers(size + 1), np.zeros(1, np.uint32)
            before = np.zeros((len(own), size + 1), U)
            np.cumsum(letter_values(codes) * weights[:size], axis=1, dtype=U, out=before[:, 1:])
            behind = before[:, -1:] - before
            step = max(1, SLICE // max(1, len(own) * len(self.letters)))
            for low in range(0, size + 1, step):
                i = np.arange(low, min(size + 1, low + step))
                j = i[i < size]
                added = weights[i][:, None] * self.values
                new = np.ones((len(own), len(i), len(self.letters)), bool)
                new[:, : len(j)] = codes[:, j, None] != self.letters
                runs = (codes[:, j] != codes[:, np.maximum(j - 1, 0)]) | (j == 0)
                rest = before[:, j] + behind[:, j + 1]
                for kind, h, keep, letters in (
                    (0, (before[:, j] + behind[:, j + 1] * U(BACK))[:, :, None], runs[:, :, None], none),
                    (1, rest[:, :, None] + added[: len(j)], new[:, : len(j)], self.letters),
                    (2, (before[:, i] + behind[:, i] * U(BASE))[:, :, None] + added, new, self.letters),
                ):
                    at = self.passing(h.ravel(), keep.ravel())
                    word, place, letter = np.unravel_index(at, h.shape)
                    yield own[word], h.ravel()[at], place + low, np.full(len(at), kind), letters[letter]


def numbered(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with an ``id`` and the hash ``h``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            h = hashes(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(np.arange(at, at + len(h))), pa.array(h.view(np.int64))], names=["word", "n", "id", "h"])
            at += len(h)

    return map_texts(words.select("word", F.col("n").cast("long").alias("n")), run, "word string, n long, id long, h long")


def word_filter(words: DataFrame, most_bits: int = 1 << 27) -> np.ndarray:
    """The filter that all words pass; it comes to the driver: ``most_bits / 64`` rows of 16 bytes at most."""
    bits = min(most_bits, max(1 << 12, 1 << (16 * words.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(U)
            bit = np.unique(np.concatenate([probes(h, k, bits) for k in range(PROBES)]))
            word, starts = np.unique(bit >> U(6), return_index=True)
            if len(word):
                values = np.bitwise_or.reduceat(U(1) << (bit & U(63)), starts)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(values.view(np.int64))], names=["word", "bits"])

    found = words.select("h").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(U)


def near_words(words: DataFrame, most_bits: int = 1 << 27) -> DataFrame:
    """(id, n, near, near_n) for each word of a stored ``numbered`` table and each word one edit away."""
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    # as many rows as there are code points, at most
    alphabet = "".join(sorted(r.c for r in letters.collect()))
    bits = words.sparkSession.sparkContext.broadcast(word_filter(words, most_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = Neighbourhood(alphabet, bits.value)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for word, h, at, kind, letter in around.edits(batch.column("word").to_pylist()):
                if len(word):
                    added = pa.array([chr(c) if c else "" for c in letter.tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[word]), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(kind.astype(np.int32)), added], names=["id", "h", "at", "kind", "letter"])

    candidates = map_texts(words.select("id", "word"), run, "id long, h long, at int, kind int, letter string")
    met = candidates.join(words.select("h", F.col("word").alias("near"), F.col("n").alias("near_n")), "h")
    edited = F.expr("concat(substring(word, 1, at), letter, substring(word, at + if(kind = 2, 1, 2)))")
    return met.join(words.select("id", "word", "n"), "id").filter(F.col("near") == edited).select("id", "n", "near", "near_n")


def grouped(words: DataFrame, ratio: int = 10, most_bits: int = 1 << 27) -> DataFrame:
    """``words`` (word, n; each word once) with ``form``, ``form_n``, ``n_near`` and ``root``.

    A word's form is its near word with the largest n, if that is at least ``ratio`` times its own.
    Each step to a form multiplies n, so the way to the root is short.
    """
    table = stored(numbered(words), "variants-words")
    best = near_words(table, most_bits).groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    good = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best"))
    judged = table.join(best, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), good.alias("form"))
    judged = stored(judged.select("word", "n", "n_near", F.col("form.near").alias("form"), (-F.col("form.n")).alias("form_n")), "variants-forms")
    roots = _jump(judged.filter("form is not null").select(F.col("word").alias("node"), F.col("form").alias("parent")))
    return judged.join(roots.select(F.col("node").alias("word"), F.col("parent").alias("root")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def runs(docs: DataFrame, least: int = 7, letters: str = "A-Za-zÀ-ÿ", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key as text, run): the maximal runs of at least ``least`` letters of whole texts, A-Z lower-cased."""
    run = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"([{letters}]{{{least},}})"), 1))
    found = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), run.alias("run"))
    return found.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("run")))


def op12_variants(spark, sf_dir: str) -> DataFrame:
    """Runs whose hash 31 divides lose a letter, as the contract of this query says."""
    found = runs(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("h", F.crc32(F.concat_ws(":", "key", "run").cast("binary")))
    word = F.expr("if(h % 31 = 0, concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2)), run)")
    words = found.select(word.alias("word")).filter("length(word) >= 7").groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")
    return grouped(words).select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = """
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda t, k: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END)) AS t
), runs AS (
  SELECT coalesce(cast(doc_id AS varchar), '') || ':' AS k, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS r FROM documents
), low AS (
  SELECT k, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS m FROM runs GROUP BY ALL
), bytes AS (
  SELECT r, m, flatten(list_transform(string_split(k || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::bigint] ELSE [192 + (unicode(c) >> 6)::bigint, (128 + (unicode(c) & 63))::bigint] END)) AS b FROM low
), hashed AS (
  SELECT r, m, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, tab
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) ELSE r END AS word, sum(m)::bigint AS n FROM hashed GROUP BY 1
), vocabulary AS (
  SELECT word, n FROM words WHERE length(word) >= 7 AND n >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
), pairs AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.a = y.a AND x.z = y.z AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM cut x JOIN vocabulary y ON x.a || x.z = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM cut x JOIN vocabulary y ON x.a || x.z = y.word
), best AS (
  SELECT word, n, count(*) AS n_near, min((-near_n, near)) AS b FROM pairs GROUP BY ALL
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * v.n THEN b[2] END AS form, CASE WHEN -b[1] >= 10 * v.n THEN -b[1] END AS form_n FROM vocabulary v LEFT JOIN best USING (word)
), ways AS (
  SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON w.root = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(root, n) AS root FROM (SELECT w.word, w.root, f.n FROM ways w JOIN forms f ON w.root = f.word) GROUP BY word
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN roots USING (word)
"""
