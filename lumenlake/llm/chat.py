r"""Chat formatting by columnar byte assembly.

A turn becomes ``### {role}: {text}</turn>\n``. Inside roles and texts a backslash is doubled and
``### `` and ``</turn>`` get one in front (a role's colons too), so removing the first backslash of
each pair gives back what was there, and an unescaped marker is never part of a text.

Conversations are cut into runs of turns so that none is formatted by one task alone. The bytes
of all turns of a batch go into one preallocated buffer: segment lengths give offsets by cumulative
sums, and scatter indices copy headers, roles and texts to their places at once. Only the finished
runs, a row for up to ``run`` turn numbers, come together by conversation.

Edge cases: null roles and texts are empty; a null conversation id is a conversation; turns that
share a number are ordered by role and text; a null turn comes first; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import text_slices

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
_turn = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
_pair = re.compile(r"\\(.)", re.DOTALL)


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    for plain in ["\\", HEAD, END.strip(), *([":"] if role else [])]:
        column = pc.replace_substring(column, plain, "\\" + plain)
    return column


def unescape(text: str) -> str:
    return _pair.sub(r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def assemble(parts: list[pa.Array | str], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleaves string columns and constants: the bytes of all rows, and where each row starts."""
    lengths = [np.full(rows, len(p.encode()), dtype=np.int64) if isinstance(p, str) else pc.binary_length(p).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts]
    ends = np.cumsum(np.sum(lengths, axis=0)) if rows else np.zeros(0, dtype=np.int64)
    starts = np.concatenate([[0], ends])
    out = np.empty(int(starts[-1]), dtype=np.uint8)
    at = starts[:-1].copy()
    for part, n in zip(parts, lengths, strict=True):
        if isinstance(part, str):
            raw = np.frombuffer(part.encode(), np.uint8)
            out[at[:, None] + np.arange(len(raw))] = raw
        else:
            offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + rows + 1].astype(np.int64)
            raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            out[np.repeat(at - (offsets[:-1] - offsets[0]), n) + np.arange(len(raw))] = raw
        at += n
    return out, starts


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation and run to formatted runs; one that a batch cuts gives two rows."""
    seq = 0
    for whole in batches:
        for batch in text_slices(whole, "text"):
            n = batch.num_rows
            if not n:
                continue
            role_raw = pc.fill_null(batch.column("role"), "")
            role, text = escape(role_raw, role=True), escape(pc.fill_null(batch.column("text"), ""))
            data, starts = assemble([HEAD, role, MIDDLE, text, END], n)
            conv, run = batch.column("conv_id"), batch.column("run")
            new = np.ones(n, dtype=bool)
            for c in (conv, run):
                a, b = c.slice(1), c.slice(0, n - 1)
                same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
                new[1:] = ~same if c is conv else new[1:] | ~same
            first = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            head = pc.utf8_length(role).to_numpy(zero_copy_only=False).astype(np.int64) + len(HEAD) + len(MIDDLE)
            size = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(head + size + len(END))
            before = np.concatenate([[0], ends])[first][which]
            begin = ends - len(END) - size - before
            said = pc.equal(role_raw, "assistant").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(which[said], minlength=len(first)))]).astype(np.int32)
            loss = lambda x: pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[said]))  # noqa: B023, E731
            bounds = pa.array(np.append(starts[first], starts[-1]).astype(np.int32)).buffers()[1]
            formatted = pa.StringArray.from_buffers(len(first), bounds, pa.py_buffer(data))
            rows = pa.array(first)
            yield pa.RecordBatch.from_arrays(
                [conv.take(rows), run.take(rows), pa.array(np.arange(seq, seq + len(first))), pa.array(np.bincount(which)), formatted, loss(begin), loss(begin + size)],
                names=["conv_id", "run", "seq", "turns", "formatted", "loss_from", "loss_till"],
            )
            seq += len(first)


def format_conversations(turns: DataFrame, run: int = 64) -> DataFrame:
    """``conv_id``, ``n_turns``, ``formatted``, and ``loss``: code point ranges of assistant texts."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", "role", "text", F.expr(f"cast(floor(turn / {run}) as bigint)").alias("run"))
    dealt = rows.repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", "turn", "role", "text")
    runs = dealt.select("conv_id", "run", "role", "text").mapInArrow(
        _runs, f"conv_id {kind}, run long, seq long, turns long, formatted string, loss_from array<long>, loss_till array<long>"
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("run").asc_nulls_first(), "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("at", F.coalesce(F.sum(F.length("formatted")).over(order), F.lit(0)))
    placed = placed.withColumn("loss", F.expr("transform(loss_from, (x, i) -> named_struct('start', at + x, 'end', at + loss_till[i]))"))
    whole = placed.groupBy("conv_id").agg(F.sum("turns").alias("n_turns"), F.expr("array_sort(collect_list(named_struct('at', at, 'seq', seq, 'formatted', formatted, 'loss', loss)))").alias("runs"))
    return whole.select("conv_id", "n_turns", F.expr("array_join(transform(runs, r -> r.formatted), '')").alias("formatted"), F.expr("flatten(transform(runs, r -> r.loss))").alias("loss"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for formatted, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            turns = read_back(formatted)
            learned = "".join([unescape(formatted[x["start"] : x["end"]]) for x in loss])
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            out.append((len(turns), sha("".join([f"{r}\n{t}\n" for r, t in turns])), len(learned), sha(learned), len(formatted)))
        columns = zip(*out, strict=True) if out else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def op6_chat(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema))
    return format_conversations(turns).mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


_ESCAPED = "replace(replace(replace({x}, '\\', '\\\\'), '### ', '\\### '), '</turn>', '\\</turn>')"
OP6_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(14 + length(replace({_ESCAPED.format(x='role')}, ':', '\\:')) + length({_ESCAPED.format(x='text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
