"""Spans as arrays in a row: extraction with offsets, greedy selection, splicing. Time grows with the row, not its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,entity:string,score:double,text:string,source:string,det:int>"
SPANS = f"array<{SPAN}>"
#: Entries that one step of a fold over an array appends to; a fold that appends copies what it has.
CHUNK = 256
#: Code points in a block of a text that is cut up before pieces are taken from it.
BLOCK = 1024


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, entity: str | Column, score: float, text: Column, source: str, det: int) -> Column:
    named = F.lit(entity) if isinstance(entity, str) else entity
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), named.alias("entity"), F.lit(score).alias("score"), text.alias("text"), F.lit(source).alias("source"), F.lit(det).alias("det"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each entry of an array of whole numbers from 0 what op makes of 0 and all entries before it. Chunks are folded by
    themselves and then their ends."""
    state = "struct<s:bigint,a:array<bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a"))

    def step(value: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
        return lambda acc, x: F.struct(op(acc["s"], value(x)).cast("bigint").alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")).cast(state)

    def folded(whole: Column) -> Column:
        count = F.greatest(F.ceil(F.size(whole) / CHUNK).cast("int"), F.lit(1))
        parts = F.transform(F.sequence(F.lit(1), count), lambda i: F.aggregate(F.slice(whole, (i - 1) * CHUNK + 1, F.lit(CHUNK)), start, step(lambda x: x)))
        return let(parts, lambda p: F.flatten(F.zip_with(p, F.aggregate(p, start, step(lambda x: x["s"]), lambda acc: acc["a"]), lambda c, base: F.transform(c["a"], lambda x: op(base, x)))))

    return let(F.transform(values, lambda x: x.cast("bigint")), folded)


def added(a: Column, b: Column) -> Column:
    return a + b


def match_places(text: Column, pattern: str, groups: int | list[int] = 0) -> Column:
    """Array of (start, g0, g1, ...) of the leftmost non-overlapping matches of pattern in text and of its groups: up to a
    number, or those listed, which then are g0, g1 ... in that order (the first is the whole match). Starts are code points;
    they come from the gaps between matches."""
    listed = list(range(groups + 1)) if isinstance(groups, int) else groups
    fields = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{i}") for i, g in enumerate(listed)]
    found = F.filter(F.arrays_zip(*fields, F.split(text, pattern, -1).alias("gap")), lambda x: x["g0"].isNotNull())
    length = lambda x: F.length(x["gap"]) + F.length(x["g0"])
    whole = lambda x, at: F.struct((at + F.length(x["gap"])).cast("int").alias("start"), *[x[f"g{i}"].alias(f"g{i}") for i in range(len(listed))])
    return let(found, lambda f: F.zip_with(f, running(F.transform(f, length), added), whole))


def has(text: Column, pattern: str, needs: str) -> Column:
    """Whether text has the pattern; where the quicker `needs` (plain text, or a pattern after re:) is missing it isn't tried."""
    if not needs:
        return text.rlike(pattern)
    return (text.rlike(needs[3:]) if needs.startswith("re:") else text.contains(needs)) & text.rlike(pattern)


def pattern_spans(text: Column, pattern: str, entity: str, score: float, source: str, det: int, keep: Callable[[Column, list[Column]], Column] | None = None, groups: int = 0, needs: str = "", value: int = 0) -> Column:
    """Spans of the matches that `keep` (of the match and its groups) lets pass. `needs` is a quicker pattern that every text
    with a match has. value: the group that is the span, which must be the last thing in the match; 0 is the whole match."""
    found = match_places(text, pattern, max(groups, value))
    if keep is not None:
        found = F.filter(found, lambda x: F.coalesce(keep(x["g0"], [x[f"g{g}"] for g in range(1, groups + 1)]), F.lit(False)))

    def one(x: Column) -> Column:
        end = x["start"] + F.length(x["g0"])
        return span(end - F.length(x[f"g{value}"]), end, entity, score, x[f"g{value}"], source, det)

    return F.when(has(text, pattern, needs), F.transform(found, one)).otherwise(no_spans())


def each_span(df: DataFrame, spans: Column | str, *columns: Column | str) -> DataFrame:
    """columns and s, a row for each span. The outer form keeps the planner from evaluating the spans once more in a filter
    for rows that have any."""
    return df.select(*columns, F.explode_outer(spans).alias("s")).filter("s is not null")


def _greedy(spans: Column) -> Column:
    """The chosen ones among spans that meet: longest first, then best score, start, detector."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("k0"), (-s["score"]).alias("k1"), s["start"].alias("k2"), s["det"].alias("k3"), s.alias("s"))))
    free = lambda acc, s: ~F.exists(acc, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    chosen = F.aggregate(keyed, no_spans(), lambda acc, k: F.when(free(acc, k["s"]), F.concat(acc, F.array(k["s"]))).otherwise(acc))
    return F.array_sort(chosen)


def merge_spans(spans: Column) -> Column:
    """Greedy selection: longest first, then best score, start, detector; what overlaps a chosen span goes. By start.

    Spans by start are cut into islands that no span crosses, and each island is settled by itself."""

    def islands(by_start: Column) -> Column:
        reach = running(F.transform(by_start, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        opens = F.zip_with(F.zip_with(by_start, reach, lambda s, r: s["start"] >= r), F.sequence(F.lit(0), F.size(by_start) - 1), lambda new, i: F.when(new | (i == 0), i))
        heads = F.array_compact(opens)
        return let(heads, lambda h: F.zip_with(h, F.concat(F.slice(h, F.lit(2), F.size(h)), F.array(F.size(by_start))), lambda a, b: F.slice(by_start, a + 1, b - a)))

    settled = lambda s: F.flatten(F.transform(islands(s), lambda one: F.when(F.size(one) > 1, _greedy(one)).otherwise(one)))
    return let(F.array_sort(spans), lambda s: F.when(F.size(s) > 1, settled(s)).otherwise(s))


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of a text cut in blocks; only the blocks that hold them are touched."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor(F.greatest(end - 1, start) / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), start - first * BLOCK + 1, end - start)


def splice(text: Column, marks: Column) -> Column:
    """text with each of marks (start, end, tag), which are sorted and don't overlap, replaced by its tag."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def joined(b: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(marks, lambda m: m["end"].cast("int")))
        starts = F.concat(F.transform(marks, lambda m: m["start"].cast("int")), F.array(F.length(text)))
        tags = F.concat(F.transform(marks, lambda m: m["tag"]), F.array(F.lit("")))
        return F.array_join(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b"), tags.alias("tag")), lambda x: F.concat(_piece(b, x["a"], x["b"]), x["tag"])), "")

    return let(blocks, joined)
