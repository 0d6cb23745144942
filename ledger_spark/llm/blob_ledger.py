"""Secret scans by an incremental ledger of blobs.

Every version of a text is a blob, named by its SHA-256.  The ledger is a folder of two tables: `scanned` (blob,
rules) and `findings` (blob, rules, kind, start, end).  A run scans only pairs of blob and rule version that the ledger lacks,
reads each blob once however many paths carry it, adds to the ledger, and joins the findings back to all paths.
DataFrame functions throughout.

Positions come from marking matches with control characters and adding up the lengths of the parts; such
characters in a text are first replaced by others, which keeps lengths and matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ledger_spark.session import empty_frame, scratch_path

_OPEN, _CLOSE, _NEUTRAL = "\x01", "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`, of which those stay whose group `group` has `least` characters."""
    kind: str
    pattern: str
    group: int
    least: int


#: The version names the rules' content: change it with them.
VERSION = "base-1"
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # Whole runs only, so the least length can stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)


def _blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _parts(text: Column, rule: Rule) -> Column:
    """(match length, length up to the next match, valid) of each match; the first entry is the text before all of them."""
    marked = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, _NEUTRAL * 2), F.lit(rule.pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))
    pieces = F.split(marked, _OPEN)

    def measured(piece: Column) -> Column:
        match = F.substring_index(piece, _CLOSE, 1)
        kept = F.regexp_extract(match, rule.pattern, rule.group) if rule.group else match
        held = F.contains(piece, F.lit(_CLOSE))
        return F.struct(F.when(held, F.char_length(match)).otherwise(0).cast("long").alias("size"),
                        (F.char_length(piece) - held.cast("int")).cast("long").alias("step"),
                        (held & (F.char_length(kept) >= rule.least)).alias("valid"))

    return F.when(F.size(pieces) > 1, F.transform(pieces, measured))


def scan(texts: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """(blob, rules, kind, start, end) of all matches in `texts` (blob, text); code points, end exclusive."""
    marked = texts.select("blob", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(r.kind).alias("kind"), _parts(F.col("text"), r).alias("parts"))
                      for i, r in enumerate(rules)])
    each = marked.select("blob", "row", F.inline(kinds)).where("parts is not null")
    steps = each.select("blob", "row", "place", "kind", F.posexplode("parts").alias("at", "part")).select(
        "blob", "row", "place", "kind", "at", "part.*")
    before = W.partitionBy("blob", "row", "place").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    return steps.withColumn("start", F.sum("step").over(before)).where("valid").select(
        "blob", F.lit(version).alias("rules"), "kind", F.col("place").cast("long").alias("place"), "start",
        (F.col("start") + F.col("size")).alias("end")).distinct()


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    exists = spark._jvm.org.apache.hadoop.fs.Path(path)
    if exists.getFileSystem(spark._jsc.hadoopConfiguration()).exists(exists):
        return spark.read.schema(schema).parquet(path)
    return empty_frame(spark, schema)


def update(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """Scan what `ledger` lacks of `docs` (doc_id, text), write it there, and return the findings of this rule version.

    A run that dies before its last step leaves findings without their `scanned` rows; the next run scans those
    blobs again and the reader drops repeated findings.
    """
    spark = docs.sparkSession
    paths = docs.select("doc_id", _blob(F.col("text")).alias("blob"))
    known = _table(spark, f"{ledger}/scanned", "blob string, rules string").where(F.col("rules") == version)
    unseen = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(known, "blob", "left_anti")
    first = unseen.select(F.col("blob").alias("new"), F.col("doc_id").alias("at"))
    texts = docs.select("doc_id", "text", _blob(F.col("text")).alias("blob")).join(
        first, (F.col("blob") == F.col("new")) & F.col("doc_id").eqNullSafe(F.col("at"))).select("blob", "text")
    scan(texts, rules, version).write.mode("append").parquet(f"{ledger}/findings")
    unseen.select("blob", F.lit(version).alias("rules")).write.mode("append").parquet(f"{ledger}/scanned")
    return _table(spark, f"{ledger}/findings", "blob string, rules string, kind string, place long, start long, end long").where(
        F.col("rules") == version).dropDuplicates(["blob", "kind", "start", "end"])


def spans(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """`docs` and a column found: array of (start, place, kind, end) by start, then kind as listed; never null.

    Null texts are empty.  Repeated rows and copies all get their blob's findings.  A column `found` of `docs` is replaced.
    """
    found = update(docs.select("doc_id", "text"), ledger, rules, version).groupBy(F.col("blob").alias("of")).agg(
        F.sort_array(F.collect_list(F.struct("start", "place", "kind", "end"))).alias("found"))
    docs = docs.drop("found")
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    none = F.expr("cast(array() as array<struct<start:bigint,place:bigint,kind:string,end:bigint>>)")
    return docs.alias("d").join(found, _blob(F.col("d.text")) == F.col("of"), "left").select(
        *names, F.coalesce("found", none).alias("found"))


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """`text` with the union of its spans replaced by marks; `found` is sorted by start."""
    empty = F.expr("cast(array() as array<struct<start:bigint,upto:bigint>>)")
    merged = F.aggregate(found, empty, lambda done, s: F.when(
        (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["upto"] >= s["start"]),
        F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
            F.get(done, F.size(done) - 1)["start"].alias("start"),
            F.greatest(F.get(done, F.size(done) - 1)["upto"], s["end"]).alias("upto"))))).otherwise(
        F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("upto"))))))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(merged, lambda s: s["upto"]))
    ends = F.concat(F.transform(merged, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    kept = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.substring(
        text, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")))
    return F.when(F.size(found) > 0, F.array_join(kept, mark)).otherwise(text)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # Only findings travel with the paths: the texts stay where they are scanned.
    found = update(docs, scratch_path(spark, "blob-ledger")).groupBy(F.col("blob").alias("of")).agg(
        F.sort_array(F.collect_list(F.struct("start", "place", "kind", "end"))).alias("found"))
    paths = docs.select("doc_id", _blob(F.col("text")).alias("blob"))
    rows = paths.join(found, F.col("blob") == F.col("of"), "left")
    spelled = F.coalesce(F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), F.lit(""))

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("found", lambda s: s["kind"] == kind)), F.lit(0))

    return rows.select("doc_id", *[F.greatest(count(r.kind), F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in RULES],
                       F.sha2(spelled, 256).alias("base_sha256"), spelled.alias("spans"))


SQL6 = r"""
with d as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) as t from documents),
k as (select * from (values
  (0, 'assign', '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24)) v(place, kind, pattern, grp, least)),
m as (select r, doc_id, 0 as place, 'assign' as kind, string_split(regexp_replace(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', chr(1) || '\0' || chr(2), 'g'), chr(1)) as p from d
  union all select r, doc_id, 1, 'access', string_split(regexp_replace(t, 'AKIA[A-Z0-9]+', chr(1) || '\0' || chr(2), 'g'), chr(1)) from d
  union all select r, doc_id, 2, 'hex', string_split(regexp_replace(t, '[0-9a-f]+', chr(1) || '\0' || chr(2), 'g'), chr(1)) from d),
e as (select r, place, kind, unnest(p) as piece, generate_subscripts(p, 1) as i from m),
s as (select r, place, kind, i, split_part(piece, chr(2), 1) as hit, contains(piece, chr(2)) as held,
  sum(length(piece) - contains(piece, chr(2))::int) over (partition by r, place order by i rows between unbounded preceding and 1 preceding) as start from e),
f as (select r, place, kind, start::bigint as start, (start + length(hit))::bigint as fin from s where held and
  case place when 0 then length(regexp_extract(hit, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 6
    when 1 then length(hit) >= 20 else length(hit) >= 24 end),
g as (select r, sum((place = 0)::int)::bigint as n0, sum((place = 1)::int)::bigint as n1, sum((place = 2)::int)::bigint as n2,
  string_agg(kind || ':' || start || ':' || fin, ',' order by start, place) as spans from f group by r)
select doc_id, coalesce(n0, 0) as n_assign, coalesce(n1, 0) as n_access, coalesce(n2, 0) as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (r)
"""
