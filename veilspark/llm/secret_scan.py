"""Secret scans with an incremental ledger of content-addressed blobs; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.spans import let, match_places, running, splice
from veilspark.llm.common import is_hot, new_table_path, skew_join, staged


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern, of which those with a group of `least` characters or more count."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
#: A private key: its header and all up to the END line (no other header or END between). Where END is missing, the header's
#: fields, lines of 16 or more base64 characters (at most 300) and a last shorter one that ends in =, with its line or with the text.
BREAK, BASE64 = r"(?:[\t\n\f\r\x20]|\\[nr])", r"[A-Za-z0-9+/=]"
KEY_TEXT = r"[^-]*(?:-{1,4}[^-]+){0,20}-----END [A-Z ]{0,30}PRIVATE KEY-----"
KEY_CUT = rf"(?:{BREAK}+(?:Proc-Type|DEK-Info|X-[A-Za-z-]+):[^\r\n\\]*){{0,5}}(?:{BREAK}+{BASE64 * 16}{BASE64}*){{0,300}}(?:{BREAK}+(?:[A-Za-z0-9+/]+={{1,2}}|{BASE64}+\z)|{BREAK}*[\r\n]{BREAK}*{BASE64}+[\r\n])?"
#: What the method adds.
ADDED = (
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", 2, rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----(?:{KEY_TEXT}|{KEY_CUT})"),
    Rule("bearer", 1, r"(?i)bearer\x20+[A-Za-z0-9+/_.=-]{20,}"),
)
RULES = BASE + ADDED
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: As the ledger keeps them: with the key of the rule, not its place among the rules of one caller.
KEPT = "array<struct<start:int,end:int,rule:string>>"


def rule_spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end, rule) of the rule's matches in code points, as KEPT."""
    found = F.filter(match_places(text, rule.pattern, [0, rule.group]), lambda x: F.length(x["g1"]) >= rule.least)
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["g0"])).cast("int").alias("end"), F.lit(rule.key).alias("rule")))
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(KEPT))


def ledger_schema() -> str:
    return f"blob binary, rules array<string>, spans {KEPT}, copies bigint"


def blob_of(text: str | Column = "text") -> Column:
    """Content address; a null text has that of the empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


def scan_new(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan blobs of `versions` (text) under rules that the ledger (a path) has not seen for them; append the findings, and
    return the ledger. A blob that many paths share is scanned once; a rule with a new version is run over old blobs alone.
    Each row of the ledger holds what one run found in one blob, under which rules, and how many rows had that blob then."""
    spark = versions.sparkSession
    blobs = versions.select(blob_of().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    todo = F.array(*[F.lit(r.key) for r in rules])
    known = read_ledger(spark, ledger)
    if known is None:
        pending = blobs.withColumn("todo", todo)
    else:
        seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))  # as many as rule versions
        pending = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
    text = F.col("text")
    parts = [F.when(F.array_contains("todo", r.key), rule_spans(text, r)).otherwise(F.array().cast(KEPT)) for r in rules]
    pending.select("blob", F.col("todo").alias("rules"), F.array_sort(F.concat(*parts)).alias("spans"), "copies").write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger at a path, null if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(ledger_schema()).parquet(ledger)


def spans_by_blob(book: DataFrame, rules: tuple[Rule, ...], fresh: bool) -> DataFrame:
    """blob and spans, as SPAN, of blobs with any span of the rules asked for, at the versions asked for; what the ledger
    holds of others is left out. kind is the place in `rules`. fresh: the ledger has one row a blob."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    if not fresh:
        book = book.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # as many rows as runs that saw the blob anew
    mine = F.filter("spans", lambda s: F.array_contains(keys, s["rule"]))
    placed = F.transform(mine, lambda s: F.struct(s["start"].alias("start"), (F.array_position(keys, s["rule"]) - 1).cast("int").alias("kind"), s["end"].alias("end")))
    return book.select("blob", F.array_sort(placed).alias("spans")).filter(F.size("spans") > 0)


def findings(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions (doc_id, text) with the spans of each whole text: doc_id, blob, spans, sorted by start, then kind.

    Offsets are code points, ends exclusive; kind is the place of the rule in `rules`. Null or empty texts have no spans.
    Equal texts have equal spans, whatever their number; repeated rows stay. A very long text, or one with very many secrets,
    costs time in proportion. An empty table gives no rows. Other columns are ignored. ledger: a path, which is added to and
    may hold findings of other rules, other versions of rules and other tables; null starts anew.
    """
    book = scan_new(versions, ledger or new_table_path(versions.sparkSession, "ledger"), rules)
    paths = staged(versions.select("doc_id", blob_of().alias("blob")), "paths")
    out = skew_join(paths, spans_by_blob(book, rules, ledger is None), "blob", "left", F.col("doc_id"))
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _only(kind: int):
    return lambda k: F.when(k == kind, k)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _only(i)))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret replaced by [kind]; overlapping secrets are replaced as one, named after the first. Rows and
    other columns stay; n_chars, where there is one, is set anew where a text has changed. Null texts stay null, repeated rows
    fare alike, an empty table gives no rows. Blobs with very many copies, of which the empty text may be one, are salted."""
    book = scan_new(docs, new_table_path(docs.sparkSession, "ledger"), rules)
    total = book.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = book.filter(is_hot("copies", total)).select(F.col("blob").alias("_blob"))
    found = spans_by_blob(book, rules, True).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    marked = skew_join(docs.withColumn("_blob", blob_of()), found, "_blob", "left", F.struct(*[F.col(c) for c in docs.columns if c != "text"]), hot=hot)
    names = F.array(*[F.lit(f"[{r.kind}]") for r in rules])

    def merged(spans: Column) -> Column:
        """One mark for each stretch of overlapping spans, from the first's start to the last end among them."""
        reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        opens = F.array_compact(F.zip_with(reach, F.sequence(F.lit(0), F.size(spans) - 1), lambda r, i: F.when((i == 0) | (F.get(spans, i)["start"] >= r), i)))
        ends = let(opens, lambda h: F.zip_with(h, F.concat(F.slice(h, F.lit(2), F.size(h)), F.array(F.size(spans))), lambda a, b: F.struct(a.alias("a"), F.array_max(F.transform(F.slice(spans, a + 1, b - a), lambda s: s["end"])).alias("end"))))
        return F.transform(ends, lambda x: F.struct(F.get(spans, x["a"])["start"].alias("start"), x["end"].alias("end"), F.get(names, F.get(spans, x["a"])["kind"]).alias("tag")))

    clean = let(let(F.col("_spans"), merged), lambda marks: splice(F.col("text"), marks))
    out = marked.withColumn("text", F.when(F.col("_spans").isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
