"""Period labels: cleaning, pattern and heuristic parsing, bounds, sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledger_spark import settings

PERIOD_FIELDS = ("period_type", "period_label", "start_date", "end_date")


def clean_period(c: Column) -> Column:
    """Drop a configured prefix, trim, squeeze blanks, turn long dashes into '-'."""
    text = F.translate(c, "–—", "--")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    prefixes = "|".join(settings.PERIOD_PREFIXES)
    return F.when(text.contains(":"), F.trim(F.regexp_replace(text, f"^(?i)({prefixes})", ""))).otherwise(text)


_MONTH_CODES = "".join(m[:3].lower() for m in settings.MONTHS)
_MONTH_NAMES = "|".join(m[:3].lower() for m in settings.MONTHS)


def month_number(code: Column) -> Column:
    """1-12 from a three-letter month code in lower case."""
    return ((F.position(code, F.lit(_MONTH_CODES)) + 2) / 3).cast("int")


def month_label(year: Column, month: Column) -> Column:
    return F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def canonical_text(cleaned_lc: Column) -> Column:
    """The six written forms turned into 'yyyy-mm', 'yyyy-mon', 'yyyy-qn' or 'yyyy' by a chain of rewrites.

    Whole-text rewrites exclude each other, so their order does not matter; other text passes unchanged.
    A two-digit fiscal year is read as 20YY.
    """
    text = cleaned_lc
    for pattern, form in ((r"^([0-9]{4})/([0-9]{2})$", "$1-$2"),
                          (rf"^({_MONTH_NAMES})[a-z]*\s+([0-9]{{4}})$", "$2-$1"),
                          (r"^q([1-4])\s*([0-9]{4})$", "$2-q$1"),
                          (r"^([1-4])q\s*([0-9]{4})$", "$2-q$1"),
                          (r"^(?:fy|cy)([0-9]{4})$", "$1"),
                          (r"^(?:fy|cy)([0-9]{2})$", "20$1")):
        text = F.regexp_replace(text, pattern, form)
    return text


def parse_canonical(text: Column) -> Column:
    """Struct (period_label, period_type) from the rewritten text; null when it is no period."""
    year = F.substring(text, 1, 4)

    def out(label: Column, kind: str) -> Column:
        return F.struct(label.alias("period_label"), F.lit(kind).alias("period_type"))

    return (F.when(text.rlike("^[0-9]{4}$"), out(text, "Yearly"))
             .when(text.rlike("^[0-9]{4}-q[1-4]$"), out(F.upper(text), "Quarterly"))
             .when(text.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), out(text, "Monthly"))
             .when(text.rlike(f"^[0-9]{{4}}-({_MONTH_NAMES})$"),
                   out(month_label(year, month_number(F.substring(text, 6, 3))), "Monthly")))


def period_start(label: Column, kind: Column) -> Column:
    """First day of a canonical label, null when the label does not fit its type."""
    year = F.regexp_extract(label, r"^(?:YTD )?([0-9]{4})", 1)
    month = (F.when((kind == "Monthly") & label.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"), F.substring(label, 6, 2))
              .when((kind == "Quarterly") & label.rlike(r"^[0-9]{4}-Q[1-4]$"),
                    F.lpad((F.substring(label, 7, 1).try_cast("int") * 3 - 2).cast("string"), 2, "0"))
              .when((kind == "Yearly") & label.rlike(r"^(YTD )?[0-9]{4}$"), F.lit("01")))
    return F.concat(year, F.lit("-"), month, F.lit("-01")).try_cast("date")


def canonical_start(label: Column, kind: Column) -> Column:
    """First day of a label known to be canonical, without testing its form again."""
    month = (F.when(kind == "Monthly", F.substring(label, 6, 2))
              .when(kind == "Quarterly", F.lpad((F.substring(label, 7, 1).try_cast("int") * 3 - 2).cast("string"), 2, "0"))
              .when(kind == "Yearly", F.lit("01")))
    return F.concat(F.substring(label, 1, 4), F.lit("-"), month, F.lit("-01")).try_cast("date")


def period_end(start: Column, kind: Column) -> Column:
    span = F.when(kind == "Monthly", 0).when(kind == "Quarterly", 2).when(kind == "Yearly", 11)
    return F.last_day(F.add_months(start, span))


def period_seq(start: Column, kind: Column) -> Column:
    """A dense number per period type, so that n periods back is exactly `seq - n`."""
    year, month = F.year(start), F.month(start)
    return (F.when(kind == "Monthly", year * 12 + month)
             .when(kind == "Quarterly", year * 4 + F.quarter(start))
             .when(kind == "Yearly", year))


def period_label(start: Column, kind: Column) -> Column:
    year = F.year(start).cast("string")
    return (F.when(kind == "Monthly", month_label(year, F.month(start)))
             .when(kind == "Quarterly", F.concat(year, F.lit("-Q"), F.quarter(start).cast("string")))
             .when(kind == "Yearly", year))


def parse_period(raw: Column, as_of: Column, kind: Column | None = None,
                 known_label: Column | None = None, known_type: Column | None = None) -> Column:
    """The forgiving parser: alias, then YTD, Qn, month name, date formats, then `as_of` as a fallback.

    `known_label`/`known_type` carry the result of an alias join where the caller has made one.
    Returns struct (period_type, period_label, start_date, end_date, label_as_written, is_fallback).
    """
    text = F.trim(raw)
    year = F.coalesce(F.nullif(F.regexp_extract(text, r"20[0-9]{2}", 0), F.lit("")),
                      F.year(as_of).cast("string"))
    default_type = F.coalesce(kind, F.lit(settings.DEFAULTS["period_type"])) if kind is not None \
        else F.lit(settings.DEFAULTS["period_type"])
    no = F.lit(False)

    def out(ptype, label, start, end, fallback=no):
        return F.struct(ptype.alias("period_type"), label.alias("period_label"), start.alias("start_date"),
                        end.alias("end_date"), text.alias("label_as_written"), fallback.alias("is_fallback"))

    def canonical(label, ptype):
        start = period_start(label, ptype)
        return out(ptype, label, start, period_end(start, ptype))

    quarter = F.regexp_extract(text, r"(?i)q([1-4])", 1)
    named = F.regexp_extract_all(F.lower(text), F.lit(f"({_MONTH_NAMES})"), F.lit(1))
    month = F.array_min(F.transform(named, month_number))
    written = F.lit(None).cast("date")
    for fmt in reversed(settings.DATE_FORMATS):
        written = F.coalesce(F.try_to_date(text, fmt), written)

    branches = F
    if known_label is not None:
        branches = branches.when(known_label.isNotNull(), canonical(known_label, known_type))
    branches = (branches
                .when(F.lower(text).contains("ytd"), canonical(F.concat(F.lit("YTD "), year), F.lit("Yearly")))
                .when(quarter != "", canonical(F.concat(year, F.lit("-Q"), quarter), F.lit("Quarterly")))
                .when(month.isNotNull(), canonical(month_label(year, month), F.lit("Monthly")))
                .when(written.isNotNull(), out(default_type, F.date_format(written, "yyyy-MM-dd"), written, written)))
    return F.when(text.isNotNull() & (text != ""),
                  branches.otherwise(out(default_type, text, as_of, as_of, F.lit(True))))
