"""Chat formatting: roles of transcript lines by a hidden Markov model and Viterbi, then canonical turns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import skew_join, staged

ROLES = ("system", "user", "assistant")
#: Names in speaker markers, by role. Words that often start a line of content (context, question, answer, me)
#: are none; single letters count with a colon alone.
MARKERS = {"system": ("system",), "user": ("user", "human", "customer", "prompter"), "assistant": ("assistant", "ai", "bot", "agent", "model")}
LETTERS = {"user": "q", "assistant": "a"}
_NAMES = "|".join(sorted((m for ms in MARKERS.values() for m in ms), key=len, reverse=True))
#: `Name:`, `### Name`, `[Name]`, `**Name:**`, `<Name>` and `Q:` at the start of a line, with a number after the name or none.
MARKER = rf"(?i)^\s*(?:#{{1,4}}\s*({_NAMES})(?:\s*\d+)?\s*(?::|$)|\*\*\s*({_NAMES})(?:\s*\d+)?\s*(?::\s*\*\*|\*\*\s*:?)|\[({_NAMES})(?:\s*\d+)?\]:?|<\|?({_NAMES})\|?>:?|({_NAMES})(?:\s*\d+)?\s*:|([qa]):)\s*"
#: Lines that a block takes through Viterbi on its own; longer transcripts are several blocks.
BLOCK = 256
#: Conversations from which the model is fitted, at most.
SAMPLE = 4_000
#: Lines that one task decodes at a time, about.
GROUP_LINES = 8_000
N_FEATURES = 6


def marker_role(line: Column) -> Column:
    """Index of the role that a line's speaker marker names, else -1."""
    name = F.lower(F.concat(*[F.regexp_extract(line, MARKER, g) for g in range(1, 7)]))
    out = F.lit(-1)
    for i, role in enumerate(ROLES):
        out = F.when(name.isin(*MARKERS[role], *LETTERS.get(role, "")), F.lit(i)).otherwise(out)
    return out


def features(line: Column, first: Column) -> Column:
    """Small integers: marker (0 none, 1 + role), question mark, length class, list or code, blank, first line."""
    length = F.length(line)
    return F.array(
        (marker_role(line) + 1).cast("int"),
        F.when(line.rlike(r"\?\s*$"), 1).otherwise(0),
        F.when(length < 40, 0).when(length < 120, 1).when(length < 300, 2).otherwise(3),
        F.when(line.rlike(r"^\s*([-*]|\d+[.)]|```)"), 1).otherwise(0),
        F.when(line.rlike(r"^\s*$"), 1).otherwise(0),
        F.when(first, 1).otherwise(0),
    )


WIDTHS = (4, 2, 4, 2, 2, 2)


@dataclass(frozen=True)
class Model:
    """Log probabilities: start (roles), step (roles, roles), emit[f] (roles, values)."""

    start: np.ndarray
    step: np.ndarray
    emit: tuple[np.ndarray, ...]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return sum((self.emit[f][:, rows[:, f]].T for f in range(N_FEATURES)), np.zeros((len(rows), len(ROLES))))


def fit(lines: DataFrame) -> Model:
    """From labelled lines (conv, n, role, x): counts of roles, steps and feature values with one added; unknown roles are left out.
    The counts are aggregates over the sample's rows, at most roles by values of them reach the driver."""
    index = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(ROLES)])
    known = lines.withColumn("r", index).filter("r is not null")
    before = F.lag("r").over(Window.partitionBy("conv").orderBy("n"))
    start, step = np.ones(len(ROLES)), np.ones((len(ROLES), len(ROLES)))
    for row in known.select("r", before.alias("b")).groupBy("b", "r").count().collect():
        if row["b"] is None:
            start[row["r"]] += row["count"]
        else:
            step[row["b"], row["r"]] += row["count"]
    emit = []
    for f, w in enumerate(WIDTHS):
        table = np.ones((len(ROLES), w))
        for row in known.select("r", F.col("x")[f].alias("v")).groupBy("r", "v").count().collect():
            table[row["r"], row["v"]] += row["count"]
        emit.append(np.log(table / table.sum(1, keepdims=True)))
    return Model(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), tuple(emit))


def forward(model: Model, rows: np.ndarray) -> np.ndarray:
    """Best log score of a path through rows from each role before them (axis 0) to each role at their end (axis 1)."""
    e = model.scores(rows)
    best = np.full((len(ROLES), len(ROLES)), -np.inf)
    np.fill_diagonal(best, 0.0)
    for x in e:
        best = (best[:, :, None] + model.step[None, :, :]).max(1) + x[None, :]
    return best


def viterbi(model: Model, rows: np.ndarray, before: np.ndarray, last: int) -> list[int]:
    """The best path through rows that starts from scores `before` and ends in role `last` (-1: any)."""
    e, best, back = model.scores(rows), before, []
    for x in e:
        through = best[:, None] + model.step
        back.append(through.argmax(0))
        best = through.max(0) + x
    at = int(best.argmax()) if last < 0 else last
    path = []
    for pointers in reversed(back):
        path.append(at)
        at = int(pointers[at])
    return path[::-1]


def numbered_lines(transcripts: DataFrame) -> DataFrame:
    """conv, n (from 0), line, x for each line of transcripts (conv, text); null and empty texts have none."""
    some = transcripts.filter("text is not null and text != ''")
    lines = some.select("conv", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return lines.select("conv", F.col("n").cast("long"), "line", features(F.col("line"), F.col("n") == 0).alias("x"))


def with_roles(lines: DataFrame, model: Model) -> DataFrame:
    """lines (conv, n, line, x) with the role of each, by Viterbi over whole transcripts.

    Transcripts of up to BLOCK lines are decoded as they are, many in a group. Longer ones are cut in blocks of BLOCK lines,
    each reduced in parallel to a matrix of best scores; the matrices of a transcript (roles by roles numbers a block) are
    multiplied in order in the (max, plus) sense, which gives each block the scores at its start and the role at its end;
    then the blocks are decoded in parallel. So no task holds the lines of a long transcript; one does hold its matrices, one
    for BLOCK lines. Equal rows of lines are decoded one after the other. Of equally good paths the one with the earlier
    roles at its end is taken. No lines give no rows."""
    lines = staged(lines, "lines")
    groups = max(1, -(-lines.count() // GROUP_LINES))
    groups = F.pmod(F.xxhash64("conv", "block"), F.lit(groups)).cast("int")
    cut = lines.groupBy("conv").count().filter(F.col("count") > BLOCK).select("conv", F.lit(True).alias("long"))
    blocked = skew_join(lines, cut, "conv", "left", F.col("n")).withColumn("long", F.coalesce("long", F.lit(False))).withColumn("block", F.when(F.col("long"), F.floor(F.col("n") / BLOCK)).otherwise(F.lit(0))).withColumn("at", groups)
    short, long = blocked.filter("not long"), blocked.filter("long")
    first = start_scores(model)
    out = "conv long, n long, line string, r int"

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["conv", "n"], kind="stable")
        rows, conv = np.array(pdf["x"].tolist(), int).reshape(-1, N_FEATURES), pdf["conv"].to_numpy()
        cuts = np.flatnonzero(np.diff(conv)) + 1
        path = [r for part in np.split(rows, cuts) if len(part) for r in viterbi(model, part, first, -1)]
        return pd.DataFrame({"conv": conv, "n": pdf["n"].to_numpy(), "line": pdf["line"].to_numpy(), "r": path})

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [(conv, block, forward(model, np.array(g.sort_values("n")["x"].tolist(), int)).ravel().tolist()) for (conv, block), g in pdf.groupby(["conv", "block"])]
        return pd.DataFrame(found, columns=["conv", "block", "m"])

    def chained(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        matrices = [np.array(m).reshape(len(ROLES), len(ROLES)) for m in pdf["m"]]
        scores = [first]
        for m in matrices:
            scores.append((scores[-1][:, None] + m).max(0))
        ends, at = [], int(scores[-1].argmax())
        for s, m in zip(reversed(scores[:-1]), reversed(matrices), strict=True):
            ends.append(at)
            at = int((s + m[:, at]).argmax())
        return pd.DataFrame({"conv": key[0], "block": pdf["block"].to_numpy(), "before": [s.tolist() for s in scores[:-1]], "last": ends[::-1]})

    def decoded(pdf: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        edge = {(c, b): (np.array(s), int(x)) for c, b, s, x in zip(edges["conv"], edges["block"], edges["before"], edges["last"], strict=True)}
        parts = [pd.DataFrame({"conv": np.empty(0, np.int64), "n": np.empty(0, np.int64), "line": np.empty(0, object), "r": np.empty(0, np.int32)})]
        for key, g in pdf.groupby(["conv", "block"]):
            g = g.sort_values("n")
            parts.append(pd.DataFrame({"conv": key[0], "n": g["n"].to_numpy(), "line": g["line"].to_numpy(), "r": viterbi(model, np.array(g["x"].tolist(), int), *edge[key])}))
        return pd.concat(parts)

    matrices = long.groupBy("at").applyInPandas(reduced, "conv long, block long, m array<double>")
    edges = matrices.groupBy("conv").applyInPandas(chained, "conv long, block long, before array<double>, last int").withColumn("at", groups)
    roles = short.groupBy("at").applyInPandas(whole, out).union(long.groupBy("at").cogroup(edges.groupBy("at")).applyInPandas(decoded, out))
    return roles.withColumn("role", F.get(F.array(*[F.lit(r) for r in ROLES]), F.col("r"))).drop("r")


def start_scores(model: Model) -> np.ndarray:
    """Scores before the first line from which one step of the model gives nearly the start probabilities: the best fit by role."""
    return (model.start[None, :] - model.step).min(1)


def canonical(lines: DataFrame) -> DataFrame:
    """conv, turn, role, first_line, n_lines, raw, text, rendered of lines (conv, n, line, role; a written table, n from 0
    without gaps): neighbouring lines of one role make a turn, and so does each confirmed marker.

    A marker is confirmed, and only then cut off, where it names the role that the model gives its line; any other stays as
    content. raw has the lines as they were, so the raws of a transcript, joined by line breaks, are the transcript. text is
    raw less confirmed markers, blank lines in front and blanks at the end. rendered is `<|role|>`, the text and `<|end|>`,
    each on lines of its own. Turns are numbered by blocks of BLOCK lines first and then over the blocks of a transcript."""
    index = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(ROLES)])
    rows = lines.select("conv", "n", "line", "role", F.floor(F.col("n") / BLOCK).alias("block"), (marker_role(F.col("line")) == index).alias("marked"))
    inside = Window.partitionBy("conv", "block").orderBy("n")
    before = lines.filter(F.pmod("n", F.lit(BLOCK)) == BLOCK - 1).select("conv", (F.floor(F.col("n") / BLOCK) + 1).alias("block"), F.col("role").alias("last"))
    rows = rows.join(before, ["conv", "block"], "left").withColumn("previous", F.coalesce(F.lag("role").over(inside), "last"))
    new = (F.col("previous").isNull() | (F.col("previous") != F.col("role")) | F.coalesce("marked", F.lit(False))).cast("int")
    rows = rows.withColumn("new", new)
    counts = rows.groupBy("conv", "block").agg(F.sum("new").alias("news"))
    offsets = counts.select("conv", "block", (F.sum("news").over(Window.partitionBy("conv").orderBy("block")) - F.col("news")).alias("offset"))
    turns = rows.join(offsets, ["conv", "block"]).withColumn("turn", F.col("offset") + F.sum("new").over(inside) - 1)
    turns = turns.withColumn("said", F.when(F.col("marked"), F.regexp_replace("line", MARKER, "")).otherwise(F.col("line")))
    every = F.array_sort(F.collect_list(F.struct("n", "line", "said")))
    out = turns.groupBy("conv", "turn").agg(F.first("role").alias("role"), F.min("n").alias("first_line"), F.count("*").alias("n_lines"), every.alias("every"))
    raw, text = F.array_join(F.transform("every", lambda x: x["line"]), "\n"), F.array_join(F.transform("every", lambda x: x["said"]), "\n")
    out = out.select("conv", "turn", "role", "first_line", "n_lines", raw.alias("raw"), F.regexp_replace(text, r"\A(?:[ \t\r]*\n)+|\s+\z", "").alias("text"))
    return out.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))


def said(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with said, as a transcript would have it: markers in one of four styles by
    conversation, and none on every third turn, where the role must be told from the lines."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    title = F.initcap("role")
    human = F.when(F.col("role") == "user", F.lit("Human")).when(F.col("role") == "assistant", F.lit("AI")).otherwise(title)
    marker = F.when(style == 0, F.concat(title, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), title, F.lit(":\n"))).when(style == 2, F.concat(F.lit("["), title, F.lit("] "))).otherwise(F.concat(human, F.lit(": ")))
    bare = F.coalesce(F.pmod(F.col("turn"), F.lit(3)) == 2, F.lit(True)) | F.col("role").isNull()
    return turns.filter("conv_id is not null").withColumn("said", F.concat(F.when(bare, F.lit("")).otherwise(marker), F.coalesce("text", F.lit(""))))


#: Turns whose lines are numbered in one task at a time.
TURNS = 64


def transcribed(turns: DataFrame) -> DataFrame:
    """Lines (conv, n, role, line, x) of the transcripts that turns make, in the order of turn, role and text, null turns
    first. The role is the true one, for fitting and for measuring. Lines are numbered over TURNS turns by themselves and
    then over a conversation. Turns without conv_id belong to no conversation and have no lines; a null text is an empty one,
    and equal rows are turns one after the other. An empty table gives no rows. Other columns are ignored."""
    rows = said(turns.select("conv_id", "turn", "role", "text")).withColumn("lines", F.split("said", "\n", -1)).withColumn("part", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(1 << 60))))
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "said").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.groupBy("conv_id", "part").agg(F.sum(F.size("lines")).alias("size"))
    offsets = sizes.select("conv_id", "part", (F.sum("size").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("size")).alias("offset"))
    rows = rows.withColumn("upto", F.sum(F.size("lines")).over(order) - F.size("lines")).join(offsets, ["conv_id", "part"])
    lines = rows.select(F.col("conv_id").alias("conv"), "role", (F.col("offset") + F.col("upto")).alias("upto"), F.posexplode("lines").alias("k", "line"))
    return lines.select("conv", (F.col("upto") + F.col("k")).cast("long").alias("n"), "role", "line").withColumn("x", features(F.col("line"), F.col("n") == 0))


def sampled(turns: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Turns of at most `sample` conversations, the first by hash of conv_id."""
    chosen = turns.filter("conv_id is not null").select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(sample)
    return turns.join(F.broadcast(chosen), "conv_id", "left_semi")  # at most `sample` rows


def formatted(transcripts: DataFrame, model: Model) -> DataFrame:
    """Canonical turns of transcripts (conv, text), one row a conv. Null or empty texts have no turns."""
    return canonical(staged(with_roles(numbered_lines(transcripts), model), "roles"))
