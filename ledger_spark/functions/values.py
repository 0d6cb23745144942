"""Money, number, text and page parsing; guarded arithmetic; display formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledger_spark import settings

MONEY = "decimal(15,2)"


def lower_trim(c: Column) -> Column:
    return F.lower(F.trim(c))


def rlike_any(c: Column, words: list[str]) -> Column:
    """True when the lower-cased text contains any of the plain words."""
    lowered = F.lower(c)
    hit = F.lit(False)
    for word in words:
        hit = hit | lowered.contains(word)
    return hit


# -- money and numbers -------------------------------------------------------

def parse_money(c: Column, signs: str = settings.CURRENCY_SIGNS, to: str = MONEY) -> Column:
    """'$1,234.50' -> 1234.50, '(5)' and '(-5)' -> -5, '-5' -> -5; anything else -> null.

    Only text made of number characters is cast, because a failed cast is far dearer than the test.
    """
    bare = F.translate(c, signs + ", \t\n\r\f\x0b", "")
    inner = F.translate(bare, "()-", "")
    signed = F.when(bare.startswith("(") & bare.endswith(")"), F.concat(F.lit("-"), inner)).otherwise(bare)
    return F.when(signed.rlike(r"^[+-]?[0-9.]+$"), signed).try_cast(to)


def clean_numeric(c: Column) -> Column:
    """Struct (number double, is_integer): the loose cleaner, which keeps an inner sign."""
    text = F.regexp_replace(F.trim(F.regexp_replace(c, "[,$€£]", "")), r"^\((.*)\)$", "-$1")
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), text).try_cast("double")
    return F.struct(number.alias("number"),
                    F.when(number.isNotNull(), ~text.contains(".")).alias("is_integer"))


def pct_change(current: Column, previous: Column) -> Column:
    """(current - previous) / previous * 100, null when previous is null or zero."""
    cur, prev = current.cast("double"), previous.cast("double")
    return F.try_divide(cur - prev, prev) * 100


# -- text --------------------------------------------------------------------

def clean_text(c: Column) -> Column:
    """Trim; blank and the null words become null."""
    text = F.trim(c)
    return F.when((text != "") & ~F.lower(text).isin(settings.NULL_WORDS), text)


def blank_to_null(c: Column, tokens: list[str] | None = None) -> Column:
    text = F.trim(c)
    if tokens:
        return F.when(~text.isin(tokens), text)
    return F.when(text != "", text)


def page_number(page: Column, sheet: Column | None = None) -> Column:
    """The page as an integer, else its first run of digits, else the sheet's; zero counts as missing."""
    def first_number(c: Column) -> Column:
        text = clean_text(c)
        whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), text).try_cast("int")
        return F.coalesce(whole, F.nullif(F.regexp_extract(text, r"[0-9]+", 0), F.lit("")).try_cast("int"))
    number = F.nullif(first_number(page), F.lit(0))
    return F.coalesce(number, first_number(sheet)) if sheet is not None else number


def source_tags(path: Column) -> Column:
    """Struct (source_file, source_type) from a path: the base name and its upper-case extension."""
    base = F.substring_index(path, "/", -1)
    ext = F.when(F.position(F.lit("."), base) > 1, F.upper(F.substring_index(base, ".", -1)))
    return F.struct(base.alias("source_file"),
                    F.coalesce(F.nullif(ext, F.lit("")), F.lit(settings.DEFAULTS["source_type"])).alias("source_type"))


def display_source(c: Column) -> Column:
    """The name before its first dot, cut to 15 characters and '...' when longer than 18."""
    stem = F.element_at(F.split(c, r"\."), 1)
    short = F.when(F.length(stem) > 18, F.concat(F.substring(stem, 1, 15), F.lit("..."))).otherwise(stem)
    return F.when(c.contains("."), short).otherwise(c)


# -- hashes ------------------------------------------------------------------

def _joined(mark: str, parts: list[Column]) -> Column:
    """The parts in one string; a null part has a token of its own, so that parts never change places."""
    return F.concat_ws(mark, *[F.coalesce(p.cast("string"), F.lit(settings.NULL_PART)) for p in parts])


def row_hash(company: Column, period: Column, item: Column, value_type: Column, file: Column) -> Column:
    return F.md5(_joined("_", [company, period, item, value_type, file]))


def datapoint_hash(*parts: Column) -> Column:
    return F.sha2(_joined("|", list(parts)), 256)


def error_fingerprint(error_type: Column, module: Column, function: Column, message: Column,
                      characters: int = 100) -> Column:
    """The first 12 hex digits of md5(type:module:function:first `characters` of the message)."""
    signature = _joined(":", [error_type, module, function, F.substring(message, 1, characters)])
    return F.substring(F.md5(signature), 1, 12)


# -- display -----------------------------------------------------------------

def format_currency(c: Column) -> Column:
    """'$1,234.50'; null and zero read '$0.00'."""
    return F.concat(F.lit("$"), F.format_number(F.coalesce(c.cast("double"), F.lit(0.0)), 2))


def format_abs(c: Column) -> Column:
    return format_currency(F.abs(c))


def short_decimal(c: Column, places: int) -> Column:
    """The rounded number as text with no more zeros than it needs, at least one decimal."""
    text = F.coalesce(c, F.lit(0.0)).cast(f"decimal(30,{places})").cast("string")
    return F.regexp_replace(text, r"(\.[0-9]+?)0+$", "$1") if places > 1 else text


def priority_code(c: Column) -> Column:
    code = F.lit(settings.PRIORITY_CODES["medium"])
    for name, number in settings.PRIORITY_CODES.items():
        code = F.when(c == name, F.lit(number)).otherwise(code)
    return code


def priority_label(c: Column) -> Column:
    label = F.lit("Medium")
    for number, name in settings.PRIORITY_LABELS.items():
        label = F.when(c == number, F.lit(name)).otherwise(label)
    return label


def cut(c: Column, width: int = 80) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)
