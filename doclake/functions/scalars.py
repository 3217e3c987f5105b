"""File-name, size, date, JSON and id helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from doclake.functions import fixed as X


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------------ file names


def file_extension(filename) -> Column:
    """Lower-cased extension with its dot; leading dots of a name start no extension."""
    return F.lower(F.regexp_extract(_col(filename), r"(?s)^(?:.*/)?\.*[^./][^/]*?(\.[^./]*)$", 1))


def file_category(extension) -> Column:
    pairs = [F.lit(v) for cat, exts in X.FILE_CATEGORIES.items() for e in exts for v in (e, cat)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(extension)), F.lit("unknown"))


def is_supported_type(filename, extensions: list[str]) -> Column:
    return file_extension(filename).isin(list(extensions))


def clean_filename(filename) -> Column:
    """Replace characters that file systems forbid, squeeze underscores, trim the ends."""
    safe = F.regexp_replace(_col(filename), X.FORBIDDEN_IN_NAMES, "_")
    return F.btrim(F.regexp_replace(safe, "_+", "_"), F.lit(X.TRIMMED_FROM_NAMES))


def _fixed(value: Column, digits: int) -> Column:
    exact = value.cast("decimal(38,20)")
    return F.bround(exact, digits).cast(f"decimal(38,{digits})").cast("string")


def format_file_size(size) -> Column:
    """``0 B`` or two decimals with a 1024-based unit; exact ties round to even."""
    size = _col(size).cast("double")

    def shown(power: int) -> Column:
        return F.concat(_fixed(size / float(1024**power), 2), F.lit(" " + X.SIZE_UNITS[power]))

    text = F.when(size == 0, F.lit("0 B"))
    for power in range(len(X.SIZE_UNITS) - 1):
        text = text.when(size < float(1024 ** (power + 1)), shown(power))
    return text.otherwise(shown(len(X.SIZE_UNITS) - 1))


def validate_email(email) -> Column:
    # A trailing newline before the end is accepted by both regex dialects.
    return _col(email).rlike(X.EMAIL_PATTERN)


# ------------------------------------------------------------------------ ids, hashes


def md5_hash(content) -> Column:
    return F.md5(_col(content))


def unique_id(prefix: str = "") -> Column:
    """A random id; use :func:`stable_id` where a recomputed task must give the same value."""
    return F.concat(F.lit(f"{prefix}_" if prefix else ""), F.expr("uuid()"))


def stable_id(*parts, prefix: str = "") -> Column:
    """An id that depends on its parts only, so retries and replays cannot change it."""
    key = F.concat_ws("\u001f", *[_col(p).cast("string") for p in parts])
    return F.concat(F.lit(f"{prefix}_" if prefix else ""), F.sha2(key, 256))


# ------------------------------------------------------------------------------ JSON


def json_field(json, field: str) -> Column:
    """A top-level JSON field as a number, NULL when absent or not numeric."""
    return F.get_json_object(_col(json), f"$.{field}").try_cast("double")


def parse_json_safe(json) -> Column:
    """The document as VARIANT, NULL when it is not JSON."""
    return F.try_parse_json(_col(json))


def bytes_to_text(content) -> Column:
    """Bytes as UTF-8 text; bytes that are not UTF-8 are left out."""
    raw = _col(content).cast("string")
    fixed = F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(fixed)


def to_json_safe(df, columns: list[str] | None = None) -> Column:
    """One JSON object of the given columns: ISO times, bytes as text, non-ASCII kept."""
    fields = []
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        kind = f.dataType.typeName()
        value = F.col(f.name)
        if kind == "binary":
            value = bytes_to_text(value)
        elif kind in ("timestamp", "timestamp_ntz"):
            value = iso_timestamp(value)
        fields.append(value.alias(f.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


# ----------------------------------------------------------------------------- times


def iso_timestamp(ts) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` with microseconds only when there are some."""
    ts = _col(ts)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_trunc("second", ts) == ts, whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def to_day(ts) -> Column:
    return F.to_date(_col(ts))


def timestamp_string(ts) -> Column:
    return F.date_format(_col(ts), "yyyyMMdd_HHmmss")


# Shapes of an ISO timestamp: date, optional time (any one separator), optional offset.
ISO_SHAPE = (
    r"(?s)^(\d{4}-\d{2}-\d{2})(?:.(\d{2})(?::(\d{2})(?::(\d{2})(?:\.(\d{3}(?:\d{3})?))?)?)?"
    r"([+-]\d{2}:\d{2}(?::\d{2})?)?)?$"
)


def parse_timestamp(text) -> Column:
    """ISO text to a timestamp (``Z`` means UTC); NULL when the text has another shape."""
    iso = F.replace(_col(text), F.lit("Z"), F.lit("+00:00"))

    def part(i: int, default: str) -> Column:
        got = F.regexp_extract(iso, ISO_SHAPE, i)
        return F.when(got == "", F.lit(default)).otherwise(got)

    stamp = F.concat(
        part(1, ""), F.lit(" "), part(2, "00"), F.lit(":"), part(3, "00"), F.lit(":"), part(4, "00"),
        F.lit("."), part(5, "000"), F.regexp_extract(iso, ISO_SHAPE, 6),
    )
    return F.when(iso.rlike(ISO_SHAPE), stamp.try_cast("timestamp"))


def _count_ago(count: Column, unit: str) -> Column:
    return F.concat(
        count.cast("string"), F.lit(f" {unit}"), F.when(count != 1, F.lit("s")).otherwise(F.lit("")), F.lit(" ago")
    )


def time_ago(ts, as_of=None) -> Column:
    """How long before ``as_of`` the time was, in its largest unit; the future is 'just now'."""
    as_of = F.current_timestamp() if as_of is None else as_of
    seconds = F.timestamp_diff("SECOND", _col(ts), as_of)
    days = F.floor(seconds / 86400)
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, _count_ago(F.floor(seconds / 60), "minute"))
        .when(seconds < 86400, _count_ago(F.floor(seconds / 3600), "hour"))
        .when(days < 30, _count_ago(days, "day"))
        .when(days < 365, _count_ago(F.floor(days / 30), "month"))
        .when(days >= 365, _count_ago(F.floor(days / 365), "year"))
    )


def percent_text(rate) -> Column:
    """A non-negative rate with one decimal and a percent sign, rounded by its exact value.

    20 * rate is formed as a sum with its rounding error, so a rate like 12.35, whose double
    lies just below the tie, goes down, and only true ties go to the even neighbour.
    """
    rate = _col(rate).cast("double")
    a, b = rate * 16, rate * 4
    twice = a + b
    shift = twice - a
    error = (a - (twice - shift)) + (b - shift)
    tenths = F.floor(twice / 2)
    rest = twice - 2 * tenths
    up = (rest > 1) | ((rest == 1) & ((error > 0) | ((error == 0) & (tenths % 2 == 1))))
    tenths = tenths + up.cast("int")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
