"""File scans.  All values are read as strings; typing happens in the normaliser."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ledger_spark import settings
from ledger_spark.functions import values as V

_FILE, _BLOCK, _POS = "_src_file", "_src_block", "_src_pos"
#: Lines of a split that are put in order together, and bytes of the files whose lines one task puts in order.
PIECE_LINES, TASK_BYTES = 8192, 4 << 20


def _tidy_header(name: str) -> str:
    return name.strip().replace("\r\n", " ").replace("\n", " ").replace("\r", " ")


def _read_csv(spark: SparkSession, path, with_position: bool = False, extra: list[str] = (), multi_line: bool = False,
              fallback: bool = False) -> DataFrame:
    """String columns under tidied headers; `_read_records` reads line ends inside quotes and files that are not UTF-8."""
    if multi_line or fallback:
        return _read_records(spark, path, with_position, extra, fallback)
    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    data = [F.col(f"`{c}`").cast("string").alias(_tidy_header(c)) for c in raw.columns if c not in extra]
    kept = [F.col(c).cast("string").alias(c) for c in extra]
    where = [F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK)] \
        if with_position else []
    return raw.select(*data, *kept, *where)


# -- records over lines --------------------------------------------------------
#
# A file is read by lines, so its splits go to many tasks.  Whether a line begins inside a quoted cell depends on all
# before it, but a line does to either state what its own quotes say: it keeps it, turns it over, or ends in one state
# whatever came before.  Such steps can be put together in any grouping.  A split is cut into pieces of a bounded number of lines.
# Each piece is run through for both states that it may begin in, the pieces of a file are put together in order, and then every
# piece knows its state and its first record's number.  So no task sorts a split, whose lines may need twenty times its bytes.

def _quote_step(state: Column, before: Column) -> Column:
    """The state behind a quote; `before` is the text between it and the quote before.

    -1 at a record's first character, 0 outside quotes, 1 inside, 2 behind a quote that closes the cell unless the
    next one follows at once.  Elsewhere than at a cell's start, a quote outside quotes is an ordinary character.
    """
    opens = before.endswith(",") | ((state == -1) & (before == ""))
    return F.when(state == 1, 2).when((state == 2) & (before == ""), 1).when(opens, 1).otherwise(0)


def _inside_after(line: Column, start: int) -> Column:
    """1 if a line that begins at a record's start (0) or inside quotes (1) ends inside quotes, else 0."""
    parts = F.split(line, '"', -1)
    quotes = F.slice(parts, F.lit(1), F.size(parts) - 1)
    last = F.aggregate(quotes, F.lit(1 if start else -1), _quote_step)
    return F.when(F.contains(line, F.lit('"')), (last == 1).cast("int")).otherwise(start)


def _state(first: Column, turns: Column, fixed: Column) -> Column:
    """A state from the one at the start, the turns since then, and the last fixed state (with the turns up to there)."""
    return F.pmod(F.coalesce(fixed, first) + turns, F.lit(2))


def _marked_lines(spark: SparkSession, path, extra: list[str], fallback: bool) -> DataFrame:
    """Lines with `_on`/`_off`, the ends from either state, `_turns` and `_fixed` before them in their piece, and
    `_starts0`/`_starts1`, the records that begin in the piece up to them if it begins in state 0 or 1."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", *extra, F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias("_at"))
    if fallback:
        lines = utf8_or_latin1(lines, "value", _FILE)
    # A given number of partitions is not merged again by the size of their compressed bytes.
    size = scan_binary(spark, path).agg(F.sum("length")).first()[0] or 0
    lines = lines.withColumn("_piece", F.floor(F.col("_at") / PIECE_LINES)).repartition(-(-size // TASK_BYTES) or 1, _FILE, _BLOCK, "_piece")
    ends = lines.withColumns({"_off": _inside_after(F.col("value"), 0), "_on": _inside_after(F.col("value"), 1)})
    piece = W.partitionBy(_FILE, _BLOCK, "_piece").orderBy("_at")
    turn = ((F.col("_off") == 1) & (F.col("_on") == 0)).cast("long")
    turned = ends.withColumn("_upto", F.sum(turn).over(piece))
    fixed = F.when(F.col("_off") == F.col("_on"), F.col("_off") + F.col("_upto"))
    before = piece.rowsBetween(W.unboundedPreceding, -1)
    marked = turned.withColumns({"_turns": F.col("_upto") - turn, "_mark": fixed,
                                 "_fixed": F.last(fixed, ignorenulls=True).over(before)})
    filled = F.trim(F.regexp_replace("value", "\r$", "")) != ""
    return marked.withColumns({f"_starts{first}": F.sum(
        ((_state(F.lit(first), F.col("_turns"), F.col("_fixed")) == 0) & filled).cast("long")).over(piece) for first in (0, 1)})


def _piece_starts(marked: DataFrame) -> DataFrame:
    """(file, block, piece, _first, _before, _crlf): the state at each piece's start, the records that begin before it in the
    file, and whether the file's first line ends in \\r\\n."""
    pieces = marked.groupBy(_FILE, _BLOCK, "_piece").agg(
        F.max("_upto").alias("_all"), F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("_at"))).alias("_last"),
        F.min_by(F.col("value").endswith("\r"), "_at").alias("_cr"), *[F.max(f"_starts{i}").alias(f"_starts{i}") for i in (0, 1)])
    order = W.partitionBy(_FILE).orderBy(_BLOCK, "_piece")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    # The same sums once more, over the few pieces of a file.
    upto = pieces.withColumn("_sum", F.sum("_all").over(order))
    fixed = F.when(F.col("_last").isNotNull(), F.col("_last") + F.col("_all") + F.col("_sum"))
    first = upto.withColumn("_first", _state(F.lit(0), F.col("_sum") - F.col("_all"), F.last(fixed, ignorenulls=True).over(before)))
    count = F.when(F.col("_first") == 0, F.col("_starts0")).otherwise(F.col("_starts1"))
    return first.select(F.col(_FILE).alias("_of"), F.col(_BLOCK).alias("_from"), F.col("_piece").alias("_part"), "_first",
                        F.coalesce(F.sum(count).over(before), F.lit(0)).alias("_before"), F.first("_cr").over(order).alias("_crlf"))


def csv_records(spark: SparkSession, path, extra: list[str] = (), fallback: bool = False) -> DataFrame:
    """(_FILE, _BLOCK, _POS, record, extra): the records of CSV files, a header being record 1 of its file.

    Line ends are \\n or \\r\\n; inside quotes they are kept, but for files whose first line ends in \\r\\n, where that becomes
    \\n there too.  Blank lines between records are not records.  A file is split over tasks by bytes wherever its line ends
    are; only lines of records that go over several are gathered, by record.  A quote that is never closed makes one
    record of the rest of its file.
    """
    marked = _marked_lines(spark, path, list(extra), fallback)
    starts = _piece_starts(marked)
    known = marked.join(starts, (F.col(_FILE) == F.col("_of")) & (F.col(_BLOCK) == F.col("_from")) & (F.col("_piece") == F.col("_part")))
    inside = _state(F.col("_first"), F.col("_turns"), F.col("_fixed"))
    after = F.when(inside == 1, F.col("_on")).otherwise(F.col("_off"))
    blank = F.trim(F.regexp_replace("value", "\r$", "")) == ""
    place = F.col("_before") + F.when(F.col("_first") == 0, F.col("_starts0")).otherwise(F.col("_starts1"))
    lines = known.withColumns({"_starts": (inside == 0) & ~blank, "_ends": after == 0, _POS: place}).where(~((inside == 0) & blank))
    whole = F.col("_starts") & F.col("_ends")
    clean = lambda c: F.regexp_replace(c, "\r$", "").alias("record")
    single = lines.where(whole).select(_FILE, _BLOCK, _POS, clean("value"), *extra)
    parts = F.array_sort(F.collect_list(F.struct(_BLOCK, "_at", "value")))
    text = F.array_join("_parts.value", "\n")
    several = lines.where(~whole).groupBy(_FILE, _POS, "_crlf", *extra).agg(F.min(_BLOCK).alias(_BLOCK), parts.alias("_parts")).select(
        _FILE, _BLOCK, _POS, clean(F.when(F.col("_crlf"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text)), *extra)
    return single.unionByName(several)


def _read_records(spark: SparkSession, path, with_position: bool, extra: list[str], fallback: bool) -> DataFrame:
    reader = lambda charset: spark.read.option("header", True).option("inferSchema", False).option("multiLine", True) \
        .option("escape", '"').option("encoding", charset).csv(path)
    names = reader("UTF-8").columns  # the first record only
    if fallback and any("\ufffd" in n for n in names):
        names = reader("ISO-8859-1").columns
    names = [n for n in names if n not in extra]
    records = csv_records(spark, path, extra, fallback)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    cells = records.where(F.col(_POS) > 1).select(
        F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), {"escape": '"', "multiLine": "true"}).alias("_cells"), *extra, _FILE, _BLOCK, _POS)
    return cells.select(*[F.col(f"_cells.c{i}").alias(_tidy_header(n)) for i, n in enumerate(names)],
                        *[F.col(c).cast("string").alias(c) for c in extra], *([_FILE, _BLOCK, _POS] if with_position else []))


def utf8_or_latin1(rows: DataFrame, column: str, file: str) -> DataFrame:
    """`column`, read as raw bytes, as UTF-8 in files whose every value is valid UTF-8, else as ISO-8859-1.

    Whether a file is UTF-8 is an aggregate over its rows, so a file may lie in any number of tasks.
    """
    valid = rows.groupBy(F.col(file).alias("_valid_of")).agg(F.bool_and(F.expr(f"is_valid_utf8({column})")).alias("_valid"))
    latin = F.decode(F.col(column).cast("binary"), "ISO-8859-1")
    return rows.join(valid, F.col(file) == F.col("_valid_of")).withColumn(
        column, F.when(F.col("_valid"), F.col(column)).otherwise(latin)).drop("_valid", "_valid_of")


def _any_value(columns: list[str]) -> Column:
    return F.coalesce(*[F.col(f"`{c}`") for c in columns]).isNotNull()


def scan_csv(spark: SparkSession, path, multi_line: bool = False, fallback: bool = False) -> DataFrame:
    """Trimmed strings, blank -> null, rows without any value dropped, source marked 'CSV'.

    `multi_line` reads line ends inside quotes, in cells and headers, and `fallback` reads files that are not valid
    UTF-8 as ISO-8859-1; with either, files are split over tasks as they are without, for one shuffle of the lines.
    Without `multi_line`, a line end always ends a record.
    """
    raw = _read_csv(spark, path, multi_line=multi_line, fallback=fallback)
    cols = raw.columns
    return (raw.select(*[V.blank_to_null(F.col(f"`{c}`")).alias(c) for c in cols])
               .where(_any_value(cols)).withColumn("_source_sheet", F.lit("CSV")))


def _row_numbers(df: DataFrame, group: list[str], name: str, offset: int) -> DataFrame:
    """Number rows inside `group` in file order without sorting or gathering them.

    `monotonically_increasing_id` counts rows inside a scan task.  Its smallest value per file
    split turns it into a position in the split; a running total over the few splits of a group
    gives where each split begins.
    """
    key = [*group, _FILE, _BLOCK]
    if _POS in df.columns:  # records, which tasks no longer hold in order: their places count, in pieces of a file
        df = df.withColumn(_BLOCK, F.floor(F.col(_POS) / PIECE_LINES))
        marked = df.withColumn("_mono", F.row_number().over(W.partitionBy(*key).orderBy(_POS))).drop(_POS)
    else:
        marked = df.withColumn("_mono", F.monotonically_increasing_id())
    splits = marked.groupBy(*key).agg(F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    in_order = W.partitionBy(*group).orderBy(_FILE, _BLOCK).rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select(*[F.col(c).alias(f"_at{i}") for i, c in enumerate(key)], "_first",
                           F.coalesce(F.sum("_rows").over(in_order), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_mono") - F.col("_first") + offset
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_at{i}"))
    return (marked.join(starts, same).withColumn(name, number.cast("long"))
                  .drop("_mono", "_first", "_before", *[f"_at{i}" for i in range(len(key))]))


def scan_csv_na(spark: SparkSession, path, na_tokens: list[str] | None = None, multi_line: bool = False,
                fallback: bool = False) -> DataFrame:
    """NA tokens -> null; rows and columns without any value dropped; 1-based `_row_number` per file.  See `scan_csv`."""
    tokens = settings.NA_TOKENS if na_tokens is None else na_tokens
    raw = _read_csv(spark, path, with_position=True, multi_line=multi_line, fallback=fallback)
    place = [c for c in (_FILE, _BLOCK, _POS) if c in raw.columns]
    cols = [c for c in raw.columns if c not in place]
    clean = raw.select(*[V.blank_to_null(F.col(f"`{c}`"), tokens).alias(c) for c in cols], *place)
    filled = clean.agg(*[F.count(f"`{c}`").alias(c) for c in cols]).first()
    kept = [c for c in cols if filled[c]]
    rows = clean.select(*kept, *place).where(_any_value(kept))
    return _row_numbers(rows, [_FILE], "_row_number", 1).drop(_FILE, _BLOCK)


def scan_sheets(spark: SparkSession, path: str, sheet: str = "sheet", multi_line: bool = False, fallback: bool = False) -> DataFrame:
    """A workbook as a folder `sheet=<name>/*.csv`: `_sheet_name`, `_row_index` (data row + 2), nulls tidied.

    Spark discovers the sheets as partitions, so any number of them is one scan.
    """
    raw = _read_csv(spark, path, with_position=True, extra=[sheet], multi_line=multi_line, fallback=fallback)
    cols = [c for c in raw.columns if c not in (_FILE, _BLOCK, _POS, sheet)]
    numbered = _row_numbers(raw, [sheet], "_row_index", 2)
    return (numbered.select(*[V.clean_text(F.col(f"`{c}`")).alias(c) for c in cols],
                            F.col(sheet).alias("_sheet_name"), "_row_index")
                    .where(_any_value(cols)))


def scan_sheets_by_header(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sheets with different headers: one scan each, columns matched by name."""
    parts = [scan_csv(spark, p).withColumn("_sheet_name", F.lit(p.rstrip("/").split("/")[-1])) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def decode_files(files: DataFrame) -> DataFrame:
    """(path, text): UTF-8 where the bytes are valid UTF-8, else ISO-8859-1, which takes any byte."""
    as_utf8 = F.expr("is_valid_utf8(cast(content as string))")
    return files.select("path", F.when(as_utf8, F.col("content").cast("string"))
                                 .otherwise(F.decode("content", "ISO-8859-1")).alias("text"))


def file_lines(decoded: DataFrame) -> DataFrame:
    return (decoded.select("path", F.explode(F.split("text", "\r?\n")).alias("line"))
                   .where(F.col("line") != ""))


def admissible_files(files: DataFrame, extensions: list[str] = settings.UPLOAD_EXTENSIONS,
                     at_most: int = settings.MAX_UPLOAD_BYTES) -> DataFrame:
    """The upload gate over (path, length): allowed extension and no more than `at_most` bytes.  Other columns stay."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    ok_type = ext.isin(extensions)
    ok_size = F.col("length") <= at_most
    reason = F.when(~ok_type, "type").when(~ok_size, "size")
    return files.withColumns({"extension": ext, "admitted": reason.isNull(), "reason": reason})


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Newest first; the file contents are never read because `content` is not selected."""
    return (scan_binary(spark, path)
            .select(F.element_at(F.split("path", "/"), -1).alias("filename"),
                    F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
                    F.concat(F.lit("."), F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"))
            .orderBy(F.desc("modified"), "filename"))


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_jsonl(lines: DataFrame, column: str, schema: str, required: str) -> DataFrame:
    """The same over a text column: rows whose JSON lacks the required field are skipped."""
    parsed = lines.withColumn("_json", F.from_json(column, schema))
    return parsed.where(F.col(f"_json.{required}").isNotNull()).select(
        *[c for c in lines.columns if c != column], "_json.*")
