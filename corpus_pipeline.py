"""A corpus pipeline of five of the operators: each stage's table is the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledger_spark.llm import blob_ledger, bpe_codec, decontaminate, jaccard_join, language_crf
from ledger_spark.session import scratch_path, written

#: Share of a document's words that its language must hold.
SURE = 0.5
ORACLE_SQL = None


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that `docs` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not decided go: null and empty texts, texts without a letter, texts of a score below `SURE`.

    Rows are judged one by one, so repeated ones and those without id fare alike; other columns pass through.  An empty table stays empty.
    """
    model = language_crf.learned(docs, ~language_crf.held_out())
    marked = language_crf.labelled(docs, model)
    return marked.where((F.col("lang_pred") != language_crf.UNDECIDED) & (F.col("score") >= SURE)).select(docs.columns)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` and a row key of id and text, which rows without id have too, and the key's name; only rows equal in both share it."""
    key = fresh("_row_key", docs)
    return docs.withColumn(key, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")), key


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked rows (five words, similarity 0.8) those of the smallest doc_id stay, and of these those of one text.

    Rows without id come last, and one of those with one text stays.  A row that comes again with id and text is
    the same document and stays as often as it came.  Rows without a word link with nothing and all stay.
    """
    rows, key = keyed(docs)
    linked = written(jaccard_join.linked_groups(rows.select(F.col(key).alias("doc_id"), "text"), words=5, percent=80).select(
        F.col("doc_id").alias(key), "component_id").distinct(), "linked")
    many = linked.groupBy("component_id").count().where("count > 1").select("component_id")
    of = written(linked.join(many, "component_id").join(rows.select(key, "doc_id").distinct(), key), "linked")
    first = of.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("first")).select(
        "component_id", F.col(f"first.{key}").alias("first"))
    gone = written(of.join(first, "component_id").where(F.col(key) != F.col("first")).select(key), "gone")
    left = rows.join(gone, key, "left_anti")
    bare = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    once = left.where(bare).groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return left.where(~bare).select(docs.columns).union(once)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a test item go, with or without id; another text under the same doc_id stays."""
    rows, key = keyed(docs)
    found = decontaminate.contaminated(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = written(found.select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return rows.join(gone, key, "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows it.  Texts without secrets, null ones too, stay as they are."""
    spans, clean, own = (fresh(name, docs) for name in ("_spans", "_clean", "_own_found"))
    found = blob_ledger.spans(docs.withColumnRenamed("found", own), scratch_path(spark, "blob-ledger")).withColumnRenamed("found", spans)
    # The new text is a column of its own first: in one step its name would mean the new text inside the expression too.
    done = found.withColumn(clean, blob_ledger.redacted(F.col("text"), F.col(spans)))
    size = F.when(F.size(spans) > 0, F.char_length(clean)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col(clean), "n_chars": size, "found": F.col(own)} if "found" in docs.columns else {"text": F.col(clean), "n_chars": size}
    return done.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row each; null and empty texts have no tokens."""
    return bpe_codec.encoded(docs, *bpe_codec.default_ranks())


STAGES = [("language", language), ("near_copies", near_copies), ("leaks", leaks), ("secrets", secrets), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again.  An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
