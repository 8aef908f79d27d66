"""Secret scans over an incremental ledger of blobs.

Method: every version of a text is a blob named by the SHA-256 of its bytes. A
ledger tells which pairs of blob and rule version were scanned before. Only pairs
that the ledger misses are scanned, each blob once however many paths hold it, and
findings are joined back to all paths. Everything is DataFrame expressions.

Places of matches come from the text between them: splitting at a rule's matches
gives the gaps, so that running sums of the lengths of gaps and matches are the
starts. Lengths count code points.

Defined results: a null text is the empty blob, without findings; repeated rows
keep their rows; null ids keep their row; empty tables give empty tables. Only the
id and text columns are read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from placelens.scratch import materialize


class Rule(NamedTuple):
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


# The kinds of secrets, in the order of listing.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

FINDINGS = "blob string, kind string, version int, place int, start int, end int"


def blobs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, blob): null texts become empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("blob", F.sha2("text", 256))


def lengths(text: Column, rule: Rule, place: int) -> Column:
    """Of each match of a rule, leftmost and not overlapping: lengths of the text before it, of the match and of what is tested."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    tested = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else found
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("found"), tested.alias("tested"))
    named = (F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(place).alias("place"))
    return F.transform(zipped, lambda x, i: F.struct(*named, i.alias("i"), x["gap"].alias("gap"), x["found"].alias("found"), (x["tested"] >= rule.least).alias("counts")))


LENGTHS = "array<struct<kind:string,version:int,place:int,i:int,gap:int,found:int,counts:boolean>>"


def scan(documents: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """New findings (FINDINGS) and new ledger rows (blob, kind, version) of the blobs of ``documents``.

    ``ledger`` holds the pairs scanned before; findings of those are already known.
    """
    every = blobs(documents, id_col, text_col)
    kinds = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    # the smallest id stands for a blob's paths
    holder = every.groupBy("blob").agg(F.min("doc_id").alias("holder"))
    due = holder.select("blob", "holder", F.inline(kinds))
    if ledger is not None:
        due = due.join(ledger.select("blob", "kind", "version").distinct(), ["blob", "kind", "version"], "left_anti")
    due = materialize(due, "ledger")
    todo = due.groupBy("holder", "blob").agg(F.collect_set("kind").alias("kinds"))
    one = every.alias("e").join(todo.alias("t"), F.col("e.doc_id").eqNullSafe(F.col("t.holder")) & (F.col("e.blob") == F.col("t.blob"))).select("e.blob", "e.text", "t.kinds")
    hit = None
    for k, r in enumerate(rules):
        asked = F.array_contains("kinds", r.kind) & F.col("text").rlike(r.pattern)
        rows = F.coalesce(F.when(asked, lengths(F.col("text"), r, k)), F.array().cast(LENGTHS))
        hit = rows if hit is None else F.concat(hit, rows)
    # a blob in several rows of its holder counts once
    found = one.select("blob", F.explode(hit).alias("f")).select("blob", "f.*").distinct()
    upto = Window.partitionBy("blob", "place").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("found")).over(upto).cast("int")).where("counts")
    found = found.select("blob", "kind", "version", "place", (F.col("end") - F.col("found")).alias("start"), "end")
    return found, due.select("blob", "kind", "version")


def current(known: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings of the rules' present versions."""
    return known.where(F.struct("kind", "version").isin(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules)))


def all_findings(documents: DataFrame, ledger: DataFrame | None, known: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New findings and, of those that an earlier scan left in ``known`` under ``ledger``, the ones of present rules."""
    found, _ = scan(documents, ledger, id_col=id_col, text_col=text_col)
    return materialize(found if known is None else found.unionByName(current(known).select(*found.columns)).distinct(), "findings")


def joined_back(documents: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): for every row the array of (start, place, end, kind) of its blob's findings, in order."""
    per_blob = findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "place", "end", "kind"))).alias("spans"))
    every = blobs(documents, id_col, text_col).select("doc_id", "blob")
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    return every.join(per_blob, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def report(documents: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Findings per document, with those that an earlier scan left in ``known`` under ``ledger``."""
    return joined_back(documents, all_findings(documents, ledger, known))


#: Blobs with findings up to which they are broadcast to the texts (about 100 bytes each).
BROADCAST_BLOBS = 200_000


def redact(documents: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``documents`` with each secret, new or ``known`` under ``ledger``, replaced by its kind in brackets; the length column follows."""
    found = all_findings(documents, ledger, known, id_col, text_col)
    per_blob = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "place", "end", "kind"))).alias("spans"))
    per_blob = per_blob.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    if per_blob.count() <= BROADCAST_BLOBS:
        per_blob = F.broadcast(per_blob)
    blob = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    joined = documents.join(per_blob, blob == F.col("__blob"), "left")
    hit = F.col("__spans").isNotNull()
    # the length is that of the finished text, in a projection of its own
    changed = joined.withColumn(text_col, F.when(hit, redacted(F.col(text_col), F.col("__spans"))).otherwise(F.col(text_col)))
    if length_col in documents.columns:
        length = F.length(text_col).cast(documents.schema[length_col].dataType)
        changed = changed.withColumn(length_col, F.when(hit, length).otherwise(F.col(length_col)))
    return changed.select(*documents.columns)


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by [kind]; of overlapping spans the earlier one counts."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        fits = s["start"] >= acc["at"]
        return F.struct(F.when(fits, s["end"]).otherwise(F.greatest(acc["at"], s["end"])).alias("at"), F.when(fits, piece).otherwise(acc["out"]).alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, end))
