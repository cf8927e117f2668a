"""Evidence spans of provisions, their validation and the units made of them."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.functions.text import is_headless, strip

SPANS = T.ArrayType(
    T.StructType()
    .add("span_idx", T.IntegerType())
    .add("span_id", T.StringType())
    .add("text", T.StringType())
    .add("start", T.IntegerType())
    .add("end", T.IntegerType())
)

# The marks at which a provision splits.
_AFTER = r"(?:^|(?<=[\n.;:]))\s*"
_ENUM = r"\(\s*(?:\d+|[a-z]|([a-z])\1|i{1,3}|iv|v|vi{0,3}|ix|x)\s*\)"
PRIORITY = re.compile(rf"(?m){_AFTER}(?=\b(?:Provided\s+that|Explanation|Illustration)\b)", re.I)
ENUMERATOR = re.compile(rf"(?m)(?:^|(?<=[\n.;:—–]))\s*(?={_ENUM})", re.I)
CONJUNCTIVE = re.compile(rf"(?m){_AFTER}(?=\b(?:Where|Unless|Except|Notwithstanding)\b)", re.I)
BRANCH = re.compile(r"(?<=;)\s*(?=(?:(?:or|and)\s*,?\s*)?if\b)", re.I)
SENTENCE = re.compile(r'(?<=\.)\s+(?=[A-Z"(])')
OPENS_ENUM = re.compile(_ENUM, re.I)
HEADER_ONLY = re.compile(r"\s*(?:Provided\s+that|Explanation|Illustration)\s*[:.\-–—]?\s*\Z", re.I)
NEAR_PRIORITY, SHORT = 8, 30


def _cut_points(text: str) -> tuple[list[int], set[int]]:
    """Sorted split points, and the starts (before and behind white space) of branches."""
    at = lambda pattern: [m.start() for m in pattern.finditer(text)]
    strong = at(PRIORITY)
    branches = [m.span() for m in BRANCH.finditer(text)]

    def far(p: int) -> bool:
        k = bisect_left(strong, p - NEAR_PRIORITY)
        return k == len(strong) or strong[k] > p + NEAR_PRIORITY

    points = {0, len(text), *strong, *at(ENUMERATOR), *at(CONJUNCTIVE), *(a for a, _ in branches), *filter(far, at(SENTENCE))}
    return sorted(points), {p for span in branches for p in span}


def _visible(text: str, points: list[int]) -> list[tuple[int, int, str]]:
    """(start behind white space, end, stripped text) of the non-blank stretches between points."""
    out = []
    for a, b in zip(points, points[1:], strict=False):
        if shown := text[a:b].strip():
            out.append((b - len(text[a:b].lstrip()), b, shown))
    return out


def split_provision(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of the spans of one provision: a header joins what follows it, a short rest what precedes it."""
    if not text:
        return []
    points, branches = _cut_points(text)
    out: list[tuple[int, int, str]] = []
    header = None
    stretches = _visible(text, points)
    for k, (start, end, shown) in enumerate(stretches):
        if header is not None:
            out.append((header[0], end, f"{header[2]} {shown}"))
            header = None
        elif HEADER_ONLY.match(shown) and k + 1 < len(stretches):
            header = (start, end, shown)
        elif out and len(shown) < SHORT and start not in branches and not OPENS_ENUM.match(shown):
            first, _, before = out[-1]
            out[-1] = (first, end, f"{before} {shown}")
        else:
            out.append((start, end, shown))
    return out


_SPAN_FIELDS = [pa.field("span_idx", pa.int32()), pa.field("span_id", pa.string()), pa.field("text", pa.string()), pa.field("start", pa.int32()), pa.field("end", pa.int32())]


@F.arrow_udf(SPANS)
def make_spans(texts: pa.Array) -> pa.Array:
    """Structural spans of each text; the fold over one string has no built-in form. Lists are built as columns, without an object for each span."""
    ends, rows = [0], []
    for text in texts.to_pylist():
        if text is None:
            ends[-1] = None  # a null list begins where nothing is added
        else:
            rows.extend((i, f"P{i}", t, a, b) for i, (a, b, t) in enumerate(split_provision(text), 1))
        ends.append(len(rows))
    columns = zip(*rows, strict=True) if rows else [[]] * len(_SPAN_FIELDS)
    spans = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPAN_FIELDS, strict=True)], fields=_SPAN_FIELDS)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)


def sentence_spans(c: Column) -> Column:
    """Spans cut at sentence ends only, in built-in functions; offsets as in make_spans."""
    chunks = F.split(c, r'(?U)(?<=\.)(?=\s+[A-Z"(])')
    placed = F.aggregate(
        chunks,
        F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<text:string,start:int,end:int>>))"),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x)).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        strip(x).alias("text"),
                        (acc["at"] + F.length(x) - F.length(F.regexp_replace(x, r"(?U)^\s+", ""))).cast("int").alias("start"),
                        (acc["at"] + F.length(x)).cast("int").alias("end"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: F.filter(acc["out"], lambda x: x["text"] != ""),
    )
    return F.transform(
        placed,
        lambda x, i: F.struct((i + 1).alias("span_idx"), F.concat(F.lit("P"), (i + 1).cast("string")).alias("span_id"), x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end")),
    ).cast(SPANS)


def explode_spans(df: DataFrame, spans: str = "spans") -> DataFrame:
    """One row per span: provision_id, span_idx, span_id, text, start, end."""
    # Not inline alone: its inferred filter on the list would make the list a second time.
    return df.select("provision_id", F.inline_outer(spans)).where("span_idx is not null")


def _span_reason(x: Column, repeated: Column, size: Column) -> Column:
    return (
        F.when(F.coalesce(x["span_id"], F.lit("")) == "", "missing_id")
        .when(repeated, "duplicate_id")
        .when(F.coalesce(strip(x["text"]), F.lit("")) == "", "empty_text")
        .when((x["start"] < 0) | (x["end"] < 0) | (x["start"] >= x["end"]) | x["start"].isNull() | x["end"].isNull(), "invalid_offsets")
        .when(x["end"] > size, "end_out_of_bounds")
    )


def spans_reason(spans: Column, text: Column) -> Column:
    """Why a span list is unusable, by the first span at fault; null for a usable one."""
    ids = F.transform(spans, lambda x: x["span_id"])
    reasons = F.filter(
        F.transform(spans, lambda x, i: _span_reason(x, F.array_contains(F.slice(ids, F.lit(1), i), x["span_id"]), F.length(text))),
        lambda r: r.isNotNull(),
    )
    return F.when(spans.isNull() | (F.size(spans) == 0), "no_spans").otherwise(F.try_element_at(reasons, F.lit(1)))


def validate_spans(spans: DataFrame, provisions: DataFrame) -> DataFrame:
    """(provision_id, reason) for every provision, from one row per span; an id counts as repeated from its second row on."""
    grouped = spans.groupBy("provision_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("span_idx", "span_id", "text", "start", "end"))), lambda x: x).alias("spans")
    )
    met = provisions.select("provision_id", F.col("text").alias("source")).join(grouped, "provision_id", "left")
    return met.select("provision_id", spans_reason(F.col("spans"), F.col("source")).alias("reason"))


def spans_with_fallback(df: DataFrame, text: str = "text", given: str | None = None) -> DataFrame:
    """df with spans, span_status, span_method and span_reason: structural, else by sentences, else the whole text, which is kept where it fails too.

    given: a column of spans that another extractor made, which take the structural ones' place.
    """
    c = F.col(text)
    whole = F.array(F.struct(F.lit(1).alias("span_idx"), F.lit("P1").alias("span_id"), c.alias("text"), F.lit(0).alias("start"), F.length(c).alias("end"))).cast(SPANS)
    # Each tier and its reason is a column of its own, computed once, and only where the tiers before failed.
    bad = [F.col(f"_r{k}").isNotNull() for k in (1, 2, 3)]
    tiers = df.withColumn("_1", F.col(given).cast(SPANS) if given else make_spans(c)).withColumn("_r1", spans_reason(F.col("_1"), c))
    tiers = tiers.withColumn("_2", F.when(bad[0], sentence_spans(c))).withColumn("_r2", F.when(bad[0], spans_reason(F.col("_2"), c)))
    tiers = tiers.withColumn("_3", whole).withColumn("_r3", F.when(bad[1], spans_reason(F.col("_3"), c)))
    return tiers.select(
        "*",
        F.when(~bad[0], F.col("_1")).when(~bad[1], F.col("_2")).otherwise(F.col("_3")).alias("spans"),
        F.when(~bad[0], "success").when(~bad[1] | ~bad[2], "fallback").otherwise("failed").alias("span_status"),
        F.when(~bad[0], None).when(~bad[1], "sentence_splitter").when(~bad[2], "full_provision").alias("span_method"),
        F.col("_r3").alias("span_reason"),
    ).drop("_1", "_2", "_3", "_r1", "_r2", "_r3")


def evidence_units(spans: DataFrame) -> DataFrame:
    """Each span with what it needs to stand alone: a headless one is joined to the nearest span before it that isn't."""
    before = Window.partitionBy("provision_id").orderBy("span_idx").rowsBetween(Window.unboundedPreceding, -1)
    bare = is_headless(F.col("text"))
    head = F.last(F.when(~bare, F.struct(F.col("span_id").alias("id"), F.col("text").alias("t"))), ignorenulls=True).over(before)
    joined = spans.withColumn("_head", F.when(bare, head))
    return joined.select(
        "provision_id",
        F.col("span_idx").alias("unit_idx"),
        F.col("span_id").alias("selected_id"),
        F.when(F.col("_head").isNull(), F.array("span_id")).otherwise(F.array("_head.id", "span_id")).alias("ids"),
        F.when(F.col("_head").isNull(), F.col("text")).otherwise(F.concat_ws(" ", "_head.t", "text")).alias("premise"),
        F.col("text").alias("own_text"),
    )
