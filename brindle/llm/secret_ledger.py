"""Secret scans over an incremental ledger of blobs, in DataFrame operations alone.

Every version of every path is content-addressed: its blob is the SHA-256 of its whole text. The ledger is a table in a
shared folder with a row for each scan of a blob: the marks (rule and version) that were scanned, and the spans found. A
scan takes the distinct blobs of the versions at hand, looks up which pairs of blob and mark the ledger lacks, scans
only these, and appends one batch. Findings are then joined back to all paths by blob, so a text that stands under
thousands of paths, or in every commit of a history, is scanned once, and a new version of one rule rescans that rule
alone.

Offsets come from the text between matches: a rule splits the text, and the running sum of the lengths of gaps and
matches gives each match's place. Sums are taken in blocks, so a text with many matches stays linear.

Blobs meet by one shuffle of the texts, which are combined where they are read, so copies don't travel. If the ledger
knows most of them and few are due, only these travel (a broadcast of at most `DUE` digests, checked by count). Findings
go to paths by `hot_join`: a blob under a great share of all paths is broadcast, and its paths stay where they are. A
batch that was cut off halfway leaves whole rows only, which are as good as any; what it lacks is due again.

Defined results: a null text counts as empty; a blob without findings has a row in the ledger and empty spans; repeated
rows and copies get the same spans each; a pair that two runs scanned at once counts once; an empty table gives an empty
result; extra columns of the versions (whatever their names) aren't read. Offsets are code points, ends exclusive;
matches are leftmost and don't overlap within a rule; those of different rules may.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_at_end, fresh_path, ship
from .common import hot_join, load, staged, unstage

SCHEMA = "blob string, scanned array<string>, spans array<struct<mark: string, start: bigint, end: bigint>>"
#: So many due digests (of 64 bytes) are broadcast.
DUE = 100_000
#: Lengths that are summed one by one; longer lists are summed by blocks of so many.
RUN = 256


@dataclass(frozen=True)
class Rule:
    """A pattern and its version; of its matches those stay whose group has so many characters at least."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def mark(self) -> str:
        return f"{self.name}@{self.version}"


# The base rules. A run's least length stands in the pattern where a shorter one would be dropped anyway.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, "[0-9a-f]{32,}"),
)
#: Further secrets: private keys and signed tokens.
RULES = (*BASE, Rule("pem", 1, "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"), Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"))


def running_sums(lengths: Column) -> Column:
    """The sums of the first 1, 2, ... numbers of a list of one or more: within blocks, and of blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda b: F.slice(lengths, b * RUN + 1, F.lit(RUN)))
    onto = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, x: a + x))
    bases = F.aggregate(totals, F.array(F.lit(0).cast("long")), onto)
    each = F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(totals)), lambda block, base: F.slice(F.aggregate(block, F.array(base), onto), F.lit(2), F.size(block)))
    return F.flatten(each)


def _span_of(rule: Rule) -> Callable[[Column, Column], Column]:
    def span(hit: Column, end: Column) -> Column:
        fits = F.char_length(F.regexp_extract(hit, rule.pattern, rule.group)) >= rule.least
        return F.when(fits, F.struct(F.lit(rule.mark).alias("mark"), (end - F.char_length(hit)).alias("start"), end.alias("end")))

    return span


def with_spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blobs (blob, body, due) with spans in place of body: those of the rules whose marks are due."""
    for i, rule in enumerate(rules):
        rx, body = F.lit(rule.pattern), F.col("body")
        hits = F.regexp_extract_all(body, rx, F.lit(0))
        lengths = F.zip_with(F.split(body, rule.pattern, -1), hits, lambda gap, hit: (F.char_length(gap) + F.coalesce(F.char_length(hit), F.lit(0))).cast("long"))
        found = F.struct(hits.alias("hits"), lengths.alias("lengths"))
        blobs = blobs.withColumn(f"_{i}", F.when(F.array_contains("due", rule.mark) & F.rlike(body, rx), found))
    blobs = blobs.select("blob", "due", *(f"_{i}" for i in range(len(rules))))
    for i, rule in enumerate(rules):
        hits = F.col(f"_{i}.hits")
        ends = F.slice(running_sums(F.col(f"_{i}.lengths")), F.lit(1), F.size(hits))
        blobs = blobs.withColumn(f"_spans{i}", F.when(F.col(f"_{i}").isNotNull(), F.filter(F.zip_with(hits, ends, _span_of(rule)), lambda s: s.isNotNull())))
    none = F.from_json(F.lit("[]"), "array<struct<mark: string, start: bigint, end: bigint>>")
    return blobs.select("blob", F.col("due").alias("scanned"), F.concat(*(F.coalesce(f"_spans{i}", none) for i in range(len(rules)))).alias("spans"))


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the ledger in a folder that driver and executors share; an empty one is begun where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/begun")
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(path)


def _body(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _blob(text_col: str) -> Column:
    return F.sha2(_body(text_col).cast("binary"), 256)


def due_pairs(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blobs (blob, ...) with due: the marks of rules that the ledger has no scan of; blobs with none are left out."""
    marks = F.array(*(F.lit(r.mark) for r in rules))
    seen = ledger.select("blob", F.explode("scanned").alias("mark")).where(F.array_contains(marks, F.col("mark"))).groupBy("blob").agg(F.collect_set("mark").alias("seen"))
    found = blobs.join(seen, "blob", "left").withColumn("due", F.array_except(marks, F.coalesce("seen", F.array().cast("array<string>"))))
    return found.where(F.size("due") > 0).drop("seen")


def scan(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
    """Scans what the ledger at path lacks for the texts of versions, and appends it as one batch."""
    spark = versions.sparkSession
    ledger, rows = open_ledger(spark, path), versions.select(_blob(text_col).alias("blob"), _body(text_col).alias("body"))
    if not ledger.isEmpty():  # digests first: most texts needn't travel if most blobs are known
        due = staged(due_pairs(rows.select("blob").distinct(), ledger, rules).select("blob"), "due")
        n_due = due.count()
        if not n_due:
            return
        if n_due <= DUE:
            rows = rows.join(F.broadcast(due), "blob", "left_semi")
    blobs = rows.groupBy("blob").agg(F.first("body").alias("body"))
    with_spans(due_pairs(blobs, ledger, rules), rules).write.parquet(f"{path}/{uuid.uuid4().hex}")


def findings(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns named of each version, and spans: its (start, kind, end, name) in order, kind the rule's place in rules."""
    spark = versions.sparkSession
    paths = staged(versions.select(F.struct(*columns).alias("path"), _blob(text_col).alias("blob")), "paths")
    marks = F.array(*(F.lit(r.mark) for r in rules))
    names = F.array(*(F.lit(r.name) for r in rules))
    kind = F.array_position(marks, F.col("s.mark"))
    spread = open_ledger(spark, path).where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).where(kind > 0)
    one = F.struct(F.col("s.start").alias("start"), (kind - 1).alias("kind"), F.col("s.end").alias("end"), F.element_at(names, kind.cast("int")).alias("name"))
    spans = spread.groupBy("blob").agg(F.sort_array(F.collect_set(one)).alias("spans"))
    counts = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n"))
    groups = staged(counts.join(spans, "blob", "left").select("blob", "n", F.coalesce("spans", F.from_json(F.lit("[]"), dict(spans.dtypes)["spans"])).alias("spans")), "found")
    found = hot_join(paths, groups, "blob", "n", paths.count())
    return found.select("path.*", "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secret_ledger(spark, sf_dir):
    ship(spark)
    docs, path = load(spark, sf_dir, "documents"), fresh_path(spark, "ledger")
    drop_at_end(spark, path)
    scan(docs, path)
    found = findings(docs, path)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    """Each rule on whole texts: gaps and matches side by side, places by running sums."""
    rules = [
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        *((r.name, r.pattern, r.group, r.least) for r in RULES[1:]),
    ]
    each = " UNION ALL ".join(
        f"SELECT row, {kind} AS kind, '{name}' AS name, regexp_extract_all(text, '{rx}', 0) AS hits, regexp_extract_all(text, '{rx}', {group}) AS parts, {least} AS least, regexp_split_to_array(text, '{rx}') AS gaps FROM d WHERE regexp_matches(text, '{rx}')" for kind, (name, rx, group, least) in enumerate(rules)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
     m AS ({each}),
     e AS (SELECT row, kind, name, least, generate_subscripts(hits, 1) AS i, unnest(hits) AS hit, unnest(parts) AS part, unnest(gaps[1:len(hits)]) AS gap FROM m),
     p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY row, kind ORDER BY i) AS stop FROM e),
     s AS (SELECT row, kind, name || ':' || CAST(stop - length(hit) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span, stop - length(hit) AS start FROM p WHERE length(part) >= least),
     g AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM s GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)
"""


OP12_SQL = _sql()
