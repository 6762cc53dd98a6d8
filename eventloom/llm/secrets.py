"""Secret scan over an incremental ledger of blobs: DataFrame functions only.

Every version of a path is addressed by the SHA-256 of its content. The ledger
lists which (blob, rule, rule version) were scanned; only unseen ones are scanned
now, in the rows of one path for each content, and findings are joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.session import durable


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches count if group ``group`` has ``least`` characters."""

    name: str
    version: int
    pattern: str
    group: int
    least: int


# The three kinds of secrets, in the order in which equal starts are listed.
RULES = (
    Rule(
        "assign",
        1,
        "(?:(?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        1,
        12,
    ),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, "[0-9a-f]{16,}", 0, 16),  # whole runs either way, so short ones need not be visited
)

LEDGER_SCHEMA = "blob string, rule string, version int"
FINDING_SCHEMA = "blob string, rule string, version int, start int, end int"


def matches(text: Column, rule: Rule) -> Column:
    """Array of ``(rule, version, gap, long, counts)`` for all matches of one rule in turn, in code points.

    The text splits into the pieces between matches; ``gap`` is the length of the piece before a match, so
    that sums of gaps and lengths give each place. ``counts`` is false for matches that are too short.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(
        F.transform(F.slice(gaps, F.lit(1), F.size(whole)), lambda x: F.length(x)).alias("gap"),
        F.transform(whole, lambda x: F.length(x)).alias("long"),
        F.transform(groups, lambda x: F.length(x)).alias("chars"),
    )

    def named(part: Column) -> Column:
        kind = F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version")
        return F.struct(*kind, part["gap"].alias("gap"), part["long"].alias("long"), (part["chars"] >= rule.least).alias("counts"))

    return F.transform(parts, named)


def _found(rule: Rule) -> Column:
    """The matches of one rule in ``text`` if ``rules`` asks for it; a plain search passes over most texts first."""
    text = F.col("text")
    hit = F.array_contains("rules", rule.name) & text.rlike(rule.pattern)
    nothing = F.array().cast("array<struct<rule:string,version:int,gap:int,long:int,counts:boolean>>")
    return F.when(hit, matches(text, rule)).otherwise(nothing)


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


class BlobLedger:
    """Scanned blobs and their findings, as two parquet tables below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.ledger_path, self.findings_path = f"{folder}/ledger", f"{folder}/findings"
        self.append(_empty(spark, LEDGER_SCHEMA), _empty(spark, FINDING_SCHEMA))

    def append(self, scanned: DataFrame, found: DataFrame) -> None:
        """Findings first: a run that dies in between scans again, and equal findings count once."""
        found.write.mode("append").parquet(self.findings_path)
        scanned.write.mode("append").parquet(self.ledger_path)

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(self.ledger_path)

    def findings(self) -> DataFrame:
        return self.spark.read.schema(FINDING_SCHEMA).parquet(self.findings_path).distinct()

    def unseen(self, versions: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """``(path, blob, rules)``: one path for each blob that some rule has not seen, with those rules' names."""
        wanted = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
        blobs = versions.groupBy("blob").agg(F.min("row").alias("row"))
        pairs = blobs.select("row", "blob", F.explode(wanted).alias("r")).select("row", "blob", "r.rule", "r.version")
        fresh = pairs.join(self.scanned(), ["blob", "rule", "version"], "left_anti")
        return fresh.groupBy("row", "blob").agg(F.collect_set("rule").alias("rules"))

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what is unseen of ``versions(row, blob, text)``.

        Only hashes are grouped, so a content with very many copies is one row
        before any text moves. Texts then move once, to meet the rows to scan.
        """
        todo = durable(self.unseen(versions.select("row", "blob"), rules))
        texts = versions.join(todo.hint("shuffle_hash"), ["row", "blob"])
        # Only matches are shuffled, to add up the lengths before each; ``scan`` tells apart rows that hold the same content.
        listed = texts.select("blob", F.monotonically_increasing_id().alias("scan"), F.concat(*[_found(r) for r in rules]).alias("listed"))
        listed = listed.select("blob", "scan", F.posexplode("listed").alias("at", "f"))
        before = Window.partitionBy("blob", "scan", "rule").orderBy("at")
        end = F.sum(F.col("gap") + F.col("long")).over(before.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
        found = listed.select("blob", "scan", "at", "f.*").withColumn("end", end).where("counts")
        found = found.select("blob", "rule", "version", (F.col("end") - F.col("long")).alias("start"), "end")
        versions_of = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.version))])
        self.append(todo.select("blob", F.explode("rules").alias("rule")).withColumn("version", versions_of[F.col("rule")]), found)


def _addressed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    ident = F.col(f"`{id_column}`").cast("long")
    row = F.coalesce(ident.cast("string"), F.lit("-"))
    return docs.select(ident.alias("id"), row.alias("row"), text.alias("text"), F.sha2(text, 256).alias("blob"))


def scan_blobs(
    ledger: BlobLedger, docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(blob, found)`` for each content of ``docs`` with secrets, after scanning what the ledger has not seen.

    ``found`` is an array of ``(start, rank, rule, end)``, sorted.
    """
    versions = _addressed(docs, id_column, text_column)
    ledger.scan(versions.select("row", "blob", "text"), rules)
    names = F.array(*[F.lit(r.name) for r in rules])
    current = [f"{r.name}:{r.version}" for r in rules]
    entry = F.struct("start", F.array_position(names, F.col("rule")).alias("rank"), "rule", "end")
    found = ledger.findings().where(F.concat_ws(":", "rule", "version").isin(current)).groupBy("blob")
    # Of a known partitioning of its own, so that a content with very many rows can be split when rows join it.
    return durable(found.agg(F.sort_array(F.collect_list(entry)).alias("found")))


def scan_documents(
    ledger: BlobLedger, docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(id, found)`` for every row; ``found`` is an array of ``(start, rank, rule, end)``, sorted.

    Rows are versions of paths: one id may come with several texts, each addressed
    by its own content. Null text counts as empty; a row without an id is scanned
    as well. A text scanned before under the same rule versions is not read
    again. Repeated rows stay repeated, other columns are ignored, and an empty
    table gives no rows.
    """
    found = scan_blobs(ledger, docs, rules, id_column, text_column)
    nothing = F.array().cast("array<struct<start:int,rank:long,rule:string,end:int>>")
    rows = _addressed(docs, id_column, text_column).select("id", "blob").join(found, "blob", "left")
    return rows.select("id", F.coalesce("found", nothing).alias("found"))


def redact(
    ledger: BlobLedger, docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """All rows and columns of ``docs``; in ``text`` each found secret is replaced by its kind in brackets.

    Of spans that overlap, those that begin inside an earlier one end with it and
    leave no mark of their own. Rows whose text holds no secret, or is null, stay as they are.
    """
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    found = scan_blobs(ledger, docs, rules, id_column, text_column)
    # The end of all spans before each, by the window that a list of a blob's spans is.
    each = found.select("blob", F.posexplode("found").alias("at", "f")).select("blob", "at", "f.*")
    before = Window.partitionBy("blob").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
    listed = F.sort_array(F.collect_list(F.struct("at", "start", "end", "rule", "done"))).alias("spans")
    found = durable(each.groupBy("blob").agg(listed, F.max("end").alias("last")))
    # The row in one struct, so that none of its names can meet those used here; characters of four bytes can be cut at any place.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.sha2(text, 256).alias("blob"))
    rows = rows.join(found, "blob", "left")
    rows = rows.select("row", "spans", "last", F.explode(F.array(F.when(F.col("spans").isNotNull(), F.encode("text", "UTF-32")))).alias("wide"))

    def cut(start: Column, characters: Column) -> Column:
        return F.decode(F.substring(F.col("wide"), start * 4 + 1, characters * 4), "UTF-32")

    def piece(span: Column) -> Column:
        gap = cut(span["done"], F.greatest(span["start"] - span["done"], F.lit(0)))
        return F.concat(gap, F.when(span["start"] >= span["done"], F.concat(F.lit("["), span["rule"], F.lit("]"))).otherwise(F.lit("")))

    rest = cut(F.col("last"), F.length("wide"))
    new = F.when(F.col("spans").isNull(), F.col("row")[text_column]).otherwise(F.concat(F.array_join(F.transform("spans", piece), ""), rest))
    return rows.select(*[new.alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns])
