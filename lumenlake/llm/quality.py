"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The units are UTF-8 bytes, so five of them fit exactly in a 64-bit key and no symbol is unknown.
There is a model for each language. Counts come from every trusted document that is not held out,
lower orders count the distinct bytes seen to the left, and each order has three discounts from its
counts of counts.

Documents are dealt to blocks by a hash of their key, compressed, and each block asks for its
distinct n-grams. The requests join the model's shards by n-gram, and the answers go back to the
block: ``alpha``, the discounted share of an n-gram, and ``gamma``, what its context leaves to the
lower order. So neither the model nor a text's n-grams are ever in one place, and what is shuffled
beside the compressed texts grows with the distinct n-grams of blocks of fixed size.

A document is kept unless its perplexity exceeds a quantile of its language's held-out trusted
documents.

Edge cases: null texts and languages are empty; an empty text has no perplexity and is not kept;
a language without held-out trusted text uses the quantile of all; without any trusted text
nothing is judged and every document with text is kept; repeated rows have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenlake.llm.common import stored, text_slices

ORDER = 5
BITS = 8 * ORDER
PAD = b"\n" * (ORDER - 1)
#: Bytes of text that are compressed together: small payloads cost more to open.
SLICE = 8 << 20


def key_of(k: int, gram) -> int:
    """The key of a k-gram: its length above its bytes."""
    return gram | (k << BITS)


def _minis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block within a slice to one compressed row."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    for batch in batches:
        for part in text_slices(batch, "text", SLICE):
            part = part.take(pc.sort_indices(part.column("block")))
            block = part.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            blocks, payloads = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    sink = pa.BufferOutputStream()
                    own = pa.Table.from_batches([part.slice(a, b - a)]).drop_columns(["block"]).combine_chunks()
                    with pa.ipc.new_stream(sink, own.schema, options=options) as w:
                        w.write_table(own)
                    blocks.append(int(block[a]))
                    payloads.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(payloads, pa.binary())], names=["block", "payload"])


def _opened(table: pa.Table) -> Iterator[tuple[pa.Table, str, np.ndarray]]:
    """A block's rows by mini and language."""
    for payload in table.column("payload"):
        rows = pa.ipc.open_stream(payload.as_py()).read_all()
        langs = np.array(rows.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            yield rows, lang, np.flatnonzero(langs == lang)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each byte of each text, and the text's number."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    data = np.frombuffer(PAD.join([b"", *raw]), np.uint8)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    at = np.arange(total) + (ORDER - 1) * (owner + 1)
    gram = np.zeros(total, dtype=np.int64)
    for i in range(ORDER):
        gram = (gram << 8) | data[at - (ORDER - 1) + i]
    return gram, owner


def _parts(keys: list, limit: int = 2 << 20) -> Iterator[list]:
    """Cuts (text, ...) rows so that each part's texts have about ``limit`` characters."""
    part, n = [], 0
    for row in keys:
        if part and n + len(row[0]) > limit:
            yield part
            part, n = [], 0
        part.append(row)
        n += len(row[0])
    if part:
        yield part


def _count(key: tuple, minis: pa.Table, trusted: pa.Table) -> pa.Table:
    """N-gram counts of a block's trusted documents."""
    known = set(trusted.column("key").to_pylist())
    counts: dict[str, list] = {}
    for rows, lang, which in _opened(minis):
        ids, texts = rows.column("key").to_pylist(), rows.column("text").to_pylist()
        own = [(texts[i] or "",) for i in which if ids[i] in known]
        for part in _parts(own):
            found = pc.value_counts(pa.array(grams_of([t for t, *_ in part])[0]))
            counts.setdefault(lang, []).append((found.field("values").to_numpy(), found.field("counts").to_numpy()))
    out = []
    for lang, parts in counts.items():
        values, where = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        n = np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)
        out.append(pa.table([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(n)], names=["lang", "gram", "c"]))
    return pa.concat_tables(out) if out else pa.table([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=["lang", "gram", "c"])


def _ask(key: tuple, minis: pa.Table) -> pa.Table:
    """The distinct n-grams of all orders of a block."""
    grams: dict[str, list] = {}
    for rows, lang, which in _opened(minis):
        texts = rows.column("text").to_pylist()
        for part in _parts([(texts[i] or "",) for i in which]):
            grams.setdefault(lang, []).append(pc.unique(pa.array(grams_of([t for t, *_ in part])[0])).to_numpy())
            if len(grams[lang]) > 16:
                grams[lang] = [np.unique(np.concatenate(grams[lang]))]
    langs, keys = [], []
    for lang, parts in grams.items():
        own = np.unique(np.concatenate(parts))
        needed = [np.zeros(1, dtype=np.int64)]  # the empty context
        for k in range(1, ORDER + 1):
            needed.append(key_of(k, np.unique(own & ((1 << 8 * k) - 1))))
            if k < ORDER:  # contexts
                needed.append(key_of(k, np.unique((own >> 8) & ((1 << 8 * k) - 1))))
        needed = np.unique(np.concatenate(needed))
        langs.append(np.full(len(needed), lang, dtype=object))
        keys.append(needed)
    n = sum(len(k) for k in keys)
    return pa.table(
        [pa.array([key[0].as_py()] * n, pa.int64()), pa.array(np.concatenate(langs) if langs else [], pa.string()), pa.array(np.concatenate(keys) if keys else [], pa.int64())],
        names=["block", "lang", "key"],
    )


def probabilities(grams: np.ndarray, keys: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Interpolated probabilities of the last bytes, from a sorted part of the model."""

    def look(wanted: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), default)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    p = np.full(len(grams), 1 / 256)
    for k in range(1, ORDER + 1):
        own = grams & ((1 << 8 * k) - 1)
        context = own >> 8
        p = look(key_of(k, own), alpha, 0.0) + look(key_of(k - 1, context), gamma, 1.0) * p
    return p


def _scorer(kind):
    """``_score`` for keys of a Spark type; a block without documents has an empty result."""
    own = to_arrow_type(kind)
    none = pa.table([pa.array([], t) for t in (own, pa.string(), pa.float64())], names=["key", "lang", "perplexity"])
    return lambda key, minis, answers: t if (t := _score(key, minis, answers)) is not None else none


def _score(key: tuple, minis: pa.Table, answers: pa.Table) -> pa.Table | None:
    langs = np.array(answers.column("lang").to_pylist(), dtype=object)
    columns = {c: answers.column(c).to_numpy() for c in ("key", "alpha", "gamma")}
    models = {}
    for lang in set(langs):
        at = np.flatnonzero(langs == lang)
        at = at[np.argsort(columns["key"][at])]
        models[lang] = tuple(columns[c][at] for c in ("key", "alpha", "gamma"))
    none = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))
    ids, of, values = [], [], []
    for rows, lang, which in _opened(minis):
        kind, own, texts = rows.column("key").type, rows.column("key").to_pylist(), rows.column("text").to_pylist()
        for part in _parts([(texts[i] or "", own[i]) for i in which]):
            grams, owner = grams_of([t for t, _ in part])
            coded = pa.array(grams).dictionary_encode()
            p = np.log(probabilities(coded.dictionary.to_numpy(), *models.get(lang, none)))
            n = np.bincount(owner, minlength=len(part))
            total = np.bincount(owner, p[coded.indices.to_numpy()], minlength=len(part))
            ids.append(pa.array([i for _, i in part], kind))
            of += [lang] * len(part)
            values += [float(np.exp(-t / m)) if m else None for t, m in zip(total, n, strict=True)]
    return pa.table([pa.chunked_array(ids), pa.array(of, pa.string()), pa.array(values, pa.float64())], names=["key", "lang", "perplexity"]) if ids else None


def model_of(counts: DataFrame) -> DataFrame:
    """Counts (lang, gram, c) of the highest order to the model: (lang, key, alpha, gamma)."""
    level = counts.groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    levels = [level.withColumn("k", F.lit(ORDER))]
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count("*").alias("c"))
        levels.append(level.withColumn("k", F.lit(k)))
    table = levels[0]
    for other in levels[1:]:
        table = table.unionByName(other)
    table = stored(table.withColumn("context", F.shiftright("gram", 8)), "quality-levels")
    n = [F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = "(n1 / (n1 + 2 * n2))"
    ok = "(n1 > 0 and n2 > 0 and n3 > 0 and n4 > 0)"  # tiny corpora have no counts of counts
    bounded = lambda i, x: f"case when {ok} then greatest(0.05, least({i} - 0.05, {x})) else {i} * 0.6 end as d{i}"
    discounts = table.groupBy("lang", "k").agg(*n).selectExpr(
        "lang", "k", bounded(1, f"1 - 2 * {y} * n2 / n1"), bounded(2, f"2 - 3 * {y} * n3 / n2"), bounded(3, f"3 - 4 * {y} * n4 / n3")
    )
    w = Window.partitionBy("lang", "k", "context")  # 256 rows at most
    d = "(case when c = 1 then d1 when c = 2 then d2 else d3 end)"
    parts = table.join(discounts, ["lang", "k"]).select(
        "lang", "k", "gram", "context",
        (F.expr(f"c - {d}") / F.sum("c").over(w)).alias("alpha"),
        (F.sum(F.expr(d)).over(w) / F.sum("c").over(w)).alias("gamma"),
    )
    parts = stored(parts, "quality-parts")
    as_gram = parts.select("lang", F.expr(f"gram | shiftleft(cast(k as bigint), {BITS})").alias("key"), "alpha", F.lit(None).cast("double").alias("gamma"))
    as_context = parts.groupBy("lang", "k", "context").agg(F.first("gamma").alias("gamma")).select(
        "lang", F.expr(f"context | shiftleft(cast(k - 1 as bigint), {BITS})").alias("key"), F.lit(None).cast("double").alias("alpha"), "gamma"
    )
    both = as_gram.unionByName(as_context).groupBy("lang", "key")
    return both.agg(F.coalesce(F.max("alpha"), F.lit(0.0)).alias("alpha"), F.coalesce(F.max("gamma"), F.lit(1.0)).alias("gamma"))


def perplexities(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", block_bytes: int = 32 << 20) -> DataFrame:
    """(``key``, ``lang``, ``perplexity``) for each document; ``trusted`` holds the keys to learn from."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(8, -(-total // block_bytes))
    at = lambda c: F.expr(f"pmod(xxhash64({c}), {blocks})").alias("block")
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text"))
    minis = rows.select("key", "lang", "text", at("key")).mapInArrow(_minis, "block long, payload binary")
    by_block = minis.repartition(blocks, "block").groupBy("block")  # a task's share stays a few blocks
    learned = trusted.select(F.col(key).cast(kind).alias("key")).distinct().select("key", at("key")).repartition(blocks, "block")
    counts = by_block.cogroup(learned.groupBy("block")).applyInArrow(_count, "lang string, gram long, c long")
    model = stored(model_of(stored(counts, "quality-counts")), "quality-model")
    asked = by_block.applyInArrow(_ask, "block long, lang string, key long")
    answers = asked.join(model, ["lang", "key"]).select("block", "lang", "key", F.col("alpha").cast("float").alias("alpha"), F.col("gamma").cast("float").alias("gamma"))
    answers = answers.repartition(blocks, "block")
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(_scorer(kind), f"key {kind.simpleString()}, lang string, perplexity double")


def judged(docs: DataFrame, labels: DataFrame, quantile: float = 0.995) -> DataFrame:
    """``doc_id``, ``lang``, ``perplexity``, the bound of its language, and ``kept``."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    good = good.select("doc_id", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").alias("held"))
    scores = stored(perplexities(docs, good.filter("not held")), "quality-scores")
    checked = scores.join(good.filter("held").withColumnRenamed("doc_id", "key"), "key").filter("perplexity is not null")
    bound = lambda g: g.agg(F.percentile_approx("perplexity", quantile, 10000).alias("b"))
    own = bound(checked.groupBy("lang"))
    out = scores.join(own, "lang", "left").crossJoin(F.broadcast(bound(checked.groupBy()).withColumnRenamed("b", "all")))  # one row
    most = F.coalesce("b", "all")
    return out.select(
        F.col("key").alias("doc_id"), "lang", "perplexity", most.alias("highest"),
        F.coalesce(F.col("perplexity") <= F.coalesce(most, F.lit(float("inf"))), F.lit(False)).alias("kept"),
    )


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
