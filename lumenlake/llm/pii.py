r"""Personal data: base patterns, and terms that disclose them by corpus co-occurrence.

Everything is DataFrame and SQL expressions. The base kinds are found by ``regexp_extract_all``
and located by the lengths of the gaps that ``split`` leaves between them. The patterns are
written so that Java's matcher neither recurses nor rescans a run of characters: they find exactly
what these find, leftmost and without overlaps,

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)    each part at most 255
    card   [0-9]([\x20-]?[0-9])+                   12 to 19 digits that pass Luhn
    phone  \+[0-9][\x20().0-9-]+[0-9]              9 to 15 digits

and matches that fail the condition are dropped.

Terms: a protected entity is a distinct value of a base span, whatever its case or separators. A
word of at least four letters outside base spans discloses it by the pointwise mutual information
of both over the corpus's distinct texts, as a share of what naming the entity itself would
disclose: log(p(e|t) / p(e)) / -log p(e). A masked text gives its entity away only by what other
texts tell, so p(e|t) is taken over the term's texts without the one at hand: of n - 1 others,
k - 1 name the entity. It is the lower bound of its one-sided 90 % Wilson interval, so that few
texts prove less than many; copies of one text count once. A word that meets an entity in one text
only has no others that tell: counted by itself, each rare word of a text would be a term, and
chance meetings would mask words of unrelated texts. A word whose share reaches ``disclosure`` for
any entity is a span of kind ``term`` wherever it stands, in every text.

Edge cases: null counts as empty; a row is judged by itself, so repeated rows have equal results;
an empty table gives an empty result; positions are code points, ends exclusive; columns of any
name are carried in a struct, so none can clash. Lists of matches are built in blocks of the root
of their number, so a text with many matches costs n^1.5 steps and not n^2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import stored

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?=\.[A-Za-z0-9-])[A-Za-z0-9.-]*?[A-Za-z0-9-](?!\.?[A-Za-z0-9-])",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?[0-9](?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a kind cannot occur, to pass over most texts cheaply.
SIGNS = {"email": "contains({t}, '@')", "ip": "{t} rlike '[0-9][.][0-9]'", "card": "{t} rlike '[0-9][ -]?[0-9]'", "phone": "contains({t}, '+')"}
SPAN = "array<struct<start:int,ord:int,end:int,value:string>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _prefix(items: str, step: str) -> str:
    """Folds of the items before each item, from 0; ``step`` is of ``_c.at`` and ``_x``."""
    width = f"cast(ceil(sqrt(size({items}))) as int)"
    inner = f"""aggregate(slice({items}, _b * _w + 1, _w), named_struct('at', _a.at, 'own', cast(array() as array<int>)),
        (_c, _x) -> named_struct('at', {step}, 'own', concat(_c.own, array(_c.at))),
        _c -> named_struct('at', _c.at, 'out', concat(_a.out, array(_c.own))))"""
    blocks = f"aggregate(sequence(0, cast((size({items}) - 1) div _w as int)), named_struct('at', 0, 'out', cast(array() as array<array<int>>)), (_a, _b) -> {inner}, _a -> flatten(_a.out))"
    return _let(width, "_w", blocks)


def _found(df: DataFrame, text: str, pattern: str, ord_: int, sign: str, out: str) -> DataFrame:
    """Adds the located matches of ``pattern``, an SQL expression, as ``out``."""
    m, g = f"_{out}_m", f"_{out}_g"
    df = df.withColumns(
        {
            m: F.expr(f"case when {sign.format(t=text)} then regexp_extract_all({text}, {pattern}, 0) end"),
            g: F.expr(f"case when {sign.format(t=text)} then split({text}, {pattern}, -1) end"),
        }
    )
    sizes = f"transform({m}, (_x, _i) -> length({g}[_i]) + length(_x))"
    span = f"named_struct('start', _at[_i] + length({g}[_i]), 'ord', {ord_}, 'end', _at[_i] + length({g}[_i]) + length(_m), 'value', _m)"
    located = _let(sizes, "_n", _let(_prefix("_n", "_c.at + _x"), "_at", f"transform({m}, (_m, _i) -> {span})"))
    return df.withColumn(out, F.expr(f"case when coalesce(size({m}), 0) <= 0 then cast(array() as {SPAN}) else {located} end")).drop(m, g)


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    return f"""aggregate(sequence(1, length({d})), 0, (a, i) -> a + case
        when i % 2 = 1 then cast(substring({d}, -i, 1) as int)
        else 2 * cast(substring({d}, -i, 1) as int) - case when substring({d}, -i, 1) > '4' then 9 else 0 end end) % 10 = 0"""


CHECKS = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(cast(nullif(ltrim('0', p), '') as int), 0) <= 255)",
    "card": f"length({_digits('x.value')}) between 12 and 19 and {_luhn(_digits('x.value'))}",
    "phone": f"length({_digits('x.value')}) between 9 and 15",
}


def base_spans(df: DataFrame, text: str, out: str = "spans") -> DataFrame:
    """Adds the base spans, sorted by start, then kind. ``text`` must not be null."""
    parts = []
    for i, kind in enumerate(PATTERNS):
        df = _found(df, text, _quoted(PATTERNS[kind]), i, SIGNS[kind], f"_{kind}")
        parts.append(f"filter(_{kind}, x -> {CHECKS[kind]})")
    df = df.withColumn(out, F.expr(f"array_sort(concat({', '.join(parts)}))"))
    return df.drop(*[f"_{k}" for k in PATTERNS])


def _replaced(text: str, spans: str, label: str) -> str:
    """``text`` with each span exchanged for ``label`` (of ``_x``); overlapping spans become one."""
    ends = f"transform({spans}, _s -> _s.end)"
    merged = "transform(_first, (_i, _k) -> named_struct('start', {s}[_i].start, 'ord', {s}[_i].ord, 'end', case when _k + 1 < size(_first) then _before[_first[_k + 1]] else array_max({e}) end))".format(s=spans, e=ends)
    merged = _let(_let(ends, "_e", _prefix("_e", "greatest(_c.at, _x)")), "_before", _let(f"filter(sequence(0, size({spans}) - 1), _i -> {spans}[_i].start >= _before[_i])", "_first", merged))
    # a substring costs its distance from the start, so texts are cut into blocks of spans first
    low = "case when {b} = 0 then 0 else _m[{b} * _w - 1].end end"
    block = "cast(_i div _w as int)"
    pieces = f"transform(sequence(0, cast((size(_m) - 1) div _w as int)), _b -> substring({text}, {low.format(b='_b')} + 1, _m[least((_b + 1) * _w, size(_m)) - 1].end - {low.format(b='_b')}))"
    prev = "case when _i = 0 then 0 else _m[_i - 1].end end"
    parts = f"transform(_m, (_x, _i) -> concat(substring(_p[{block}], {prev} - {low.format(b=block)} + 1, _x.start - {prev}), {label}))"
    whole = f"concat(array_join({parts}, ''), substring({text}, _m[size(_m) - 1].end + 1))"
    out = _let(merged, "_m", _let("cast(ceil(sqrt(size(_m))) as int)", "_w", _let(pieces, "_p", whole)))
    return f"case when size({spans}) = 0 then {text} else {out} end"


def _lowered(text: str, spans: str) -> str:
    """``text`` in lower case with blanks for base spans; positions stay. Only U+0130 would grow."""
    return f"lower(translate({_replaced(text, spans, "repeat(' ', _x.end - _x.start)")}, '\u0130', 'i'))"


#: One value for each entity: its kind, and its digits or lower case.
ENTITY = f"concat(s.ord, ':', case when s.ord in (2, 3) then {_digits('s.value')} else lower(s.value) end)"
#: The lower bound of p(entity | term) over the other texts, one-sided, 90 %: of n texts k name the entity. For k > 1.
WILSON = "({k} / {n} + {zz} / (2 * {n}) - {z} * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + {zz} / (4 * {n} * {n}))) / (1 + {zz} / {n})".format(k="(k - 1)", n="(n - 1)", z=1.2816, zz=1.2816**2)
#: A text's distinct words of four letters or more.
WORDS = "filter(array_distinct(split(low, '[^\\\\p{L}]+')), w -> length(w) >= 4)"
#: The most terms that are broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: The most bytes of texts' terms that are broadcast; with more, texts that may hold some are shuffled.
BROADCAST_BYTES = 32 << 20


def _by_copy(base: DataFrame) -> DataFrame:
    """Adds ``low``, and ``copy`` and ``check``, two hashes of it."""
    return base.withColumn("low", F.expr(_lowered("text", "spans"))).withColumns({"copy": F.xxhash64("low"), "check": F.xxhash64(F.lit(7), "low")})


def _few(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def _split(rows: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` without and with a chance of a ``copy`` in ``held``, told by a filter of at most 8 MB, so
    that few texts or words are shuffled."""
    bits = 1 << min(26, max(16, (64 * held.count()).bit_length()))
    word, bit = F.expr(f"shiftright(pmod(copy, {bits}), 6)"), F.expr("cast(pmod(copy, 64) as int)")
    words = held.groupBy(word.alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(copy, 64) as int))")).alias("_bits"))
    marked = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.expr("shiftright(_bits, _bit) & 1 = 1"), F.lit(False))
    return marked.filter(~hit).select(*rows.columns), marked.filter(hit).select(*rows.columns)


def disclosing_terms(texts: DataFrame, disclosure: float = 0.8) -> DataFrame:
    """The ``term``s that disclose an entity of ``texts`` (by ``_by_copy``, with ``spans``).

    Only words that meet an entity in two texts are counted in the others, and of these only those
    whose share could be large enough by the texts with entities. A word's texts are its rows whose
    text surely occurs once, and its distinct texts among the other rows.
    """
    each = F.explode(F.expr(WORDS)).alias("term")
    entities = F.expr(f"array_distinct(transform(spans, s -> {ENTITY}))")
    narrow = stored(texts.select("copy", "check", entities.alias("entities"), F.expr(f"case when size(spans) > 0 then {WORDS} end").alias("words")), "pii-narrow")
    copies = stored(narrow.groupBy("copy", "check").agg(F.count("*").alias("n")), "pii-copies")
    named = stored(narrow.filter("size(entities) > 0").dropDuplicates(["copy", "check"]).select("entities", "words"), "pii-named")
    entity_docs = named.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("entity_docs"))
    twice = named.select(F.explode("entities").alias("entity"), "words").join(entity_docs.filter("entity_docs > 1"), "entity", "left_semi")  # in a single text no other tells
    pairs = twice.select("entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("k")).filter("k > 1")
    e = F.col("entity_docs") / F.lit(float(max(copies.count(), 1)))
    share = F.when(e >= 1, F.lit(0.0)).otherwise(F.log(F.expr(WILSON) / e) / -F.log(e))
    # a share falls with n, and the texts with entities alone are a part of a word's texts
    in_named = named.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    able = pairs.join(in_named, "term").join(entity_docs, "entity").filter(share >= disclosure).drop("n")
    able = stored(able, "pii-pairs")
    candidates = _few(stored(able.select("term").distinct(), "pii-candidates"))
    once, others = _split(texts, copies.filter("n > 1"))
    counted = once.select(each).join(candidates, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    rest = others.select("copy", "check", each).join(candidates, "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n"))
    in_docs = counted.unionByName(rest).groupBy("term").agg(F.sum("n").alias("n"))
    return stored(able.join(in_docs, "term").filter(share >= disclosure).select("term").distinct(), "pii-terms")


def _held(texts: DataFrame, told: DataFrame) -> DataFrame:
    """``copy, check, terms`` of the distinct texts that hold told terms, stored."""
    words = texts.select("copy", "check", F.explode(F.expr(WORDS)).alias("term")).join(_few(told), "term", "left_semi")
    return stored(words.groupBy("copy", "check").agg(F.array_join(F.sort_array(F.collect_set("term")), "|").alias("terms")), "pii-held")


def find(docs: DataFrame, carry: list[str], text: str = "text", **settings) -> DataFrame:
    """``row`` (a struct of ``carry``), ``text``, ``base`` (base spans) and ``spans`` (with terms)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    base = base_spans(rows, "text")
    texts = _by_copy(base.select("text", "spans"))
    held = _held(texts, disclosing_terms(texts, **settings))
    size = held.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("terms")), F.lit(0)).alias("chars")).first()
    pattern = "concat('(?<!\\\\p{L})(?:', terms, ')(?!\\\\p{L})')"

    def told(rows: DataFrame) -> DataFrame:
        rows = _found(rows, "low", pattern, len(KINDS) - 1, "terms is not null", "more")
        spans = F.expr("case when terms is null then spans else array_sort(concat(spans, more)) end")
        return rows.select("row", "text", F.col("spans").alias("base"), spans.alias("spans"))

    if 64 * size["n"] + 4 * size["chars"] <= BROADCAST_BYTES:
        return told(_by_copy(base).join(F.broadcast(held), ["copy", "check"], "left"))
    clear, doubtful = _split(_by_copy(base), held)
    return clear.select("row", "text", F.col("spans").alias("base"), "spans").unionByName(told(doubtful.join(held, ["copy", "check"], "left")))


def listed(spans: str) -> F.Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({kinds}), x.ord + 1), ':', x.start, ':', x.end)), ',')")


def redacted(text: str, spans: str) -> F.Column:
    """``text`` with each span generalised to its kind; overlapping spans become one."""
    kinds = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    return F.expr(_replaced(text, spans, f"element_at(array({kinds}), _x.ord + 1)"))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    counts = [F.expr(f"cast(size(filter(base, x -> x.ord = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return found.select("row.doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
