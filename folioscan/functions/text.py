"""Column functions for paths, labels and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan import schema as S


def extension(path: Column) -> Column:
    """The extension of a path in small letters, with its dot; "" if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_name(path: Column) -> Column:
    """The last segment of a path."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def folder_path(path: Column) -> Column:
    """A path without its last segment and the separator before it."""
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def normalize_extension(value: Column) -> Column:
    """An extension with its dot in small letters, from an extension or a path.

    Null or blank gives "". A value with a separator is a path, of which the
    extension is taken; any other value is the extension, dot or not.
    """
    trimmed = F.trim(F.coalesce(value, F.lit("")), F.lit(" \t\r\n"))
    taken = F.when(trimmed.rlike(r"[/\\]"), F.regexp_extract(trimmed, r"(\.[^./\\]+)$", 1)).otherwise(trimmed)
    return F.lower(F.when(taken == "", "").when(taken.startswith("."), taken).otherwise(F.concat(F.lit("."), taken)))


def file_type(ext: Column) -> Column:
    """The label of an extension."""
    labels = F.create_map(*[F.lit(x) for kv in S.FILE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, F.lower(ext)), F.lit(S.OTHER_TYPE))


def icon_class(name: Column) -> Column:
    """The icon class of a file name."""
    ext, out = extension(name), F.lit("text")
    for icon, extensions in S.ICONS.items():
        out = F.when(ext.isin(extensions), icon).otherwise(out)
    return out


def format_size(size: Column) -> Column:
    """Bytes as B, whole KB, or MB with one decimal."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1048576, F.concat(F.floor(size / 1024).cast("string"), F.lit(" KB")))
        .otherwise(F.format_string("%.1f MB", size / 1048576.0))
    )


def format_date(time: Column) -> Column:
    """A time in the session's zone, to the minute."""
    return F.date_format(time, "yyyy/MM/dd HH:mm")


def format_age(time: Column, now: Column) -> Column:
    """How long ago ``time`` was at ``now``; null is never."""
    seconds = F.unix_micros(now) - F.unix_micros(time)
    whole = lambda unit: F.floor(seconds / (unit * 1_000_000)).cast("string")
    return (
        F.when(time.isNull(), S.NEVER)
        .when(seconds < 60_000_000, S.JUST_NOW)
        .when(seconds < 3_600_000_000, F.concat(whole(60), F.lit(S.MINUTES_AGO)))
        .when(seconds < 86_400_000_000, F.concat(whole(3600), F.lit(S.HOURS_AGO)))
        .when(seconds < 604_800_000_000, F.concat(whole(86400), F.lit(S.DAYS_AGO)))
        .otherwise(F.date_format(time, "MM/dd HH:mm"))
    )


def progress_percent(processed: Column, total: Column) -> Column:
    """Percent done, 0 if there is nothing to do."""
    return F.coalesce(F.try_divide(processed * 100.0, total.cast("double")), F.lit(0.0))


def progress_text(processed: Column, total: Column, errors: Column, unit: str) -> Column:
    """Progress in words; skipped files are named if there are any."""
    number = lambda c: F.format_number(c, 0)
    before, after = S.SKIPPED.split("{}")
    text = F.concat(number(processed), F.lit(" / "), number(total), F.lit(f" {unit}"))
    return F.when(errors > 0, F.concat(text, F.lit(before), number(errors), F.lit(after))).otherwise(text)


def highlight_position(line: Column, current: Column, total: Column) -> Column:
    """Where the reader is among the highlighted lines; null if there are none."""
    place = F.concat(current.cast("string"), F.lit("/"), total.cast("string"))
    return F.when(total > 0, F.when(line > 0, F.concat(line.cast("string"), F.lit(" 行目 ("), place, F.lit(")"))).otherwise(place))


def ticks(time: Column) -> Column:
    """100 ns units since 0001-01-01."""
    return (F.unix_micros(time) + S.TICKS_EPOCH_MICROS) * 10


def time_of_ticks(value: Column) -> Column:
    """The time of ticks to the microsecond; null for 0 or less."""
    return F.when(value > 0, F.timestamp_micros(F.floor(value / 10) - S.TICKS_EPOCH_MICROS))


def under_any(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the folders or lies in one, whatever its case."""
    low, out = F.lower(path), F.lit(False)
    for root in roots:
        name = root.rstrip("/\\").lower()
        out |= (low == name) | low.startswith(name + "/") | low.startswith(name + "\\")
    return out


def under_prefix(folder: Column, prefix: str) -> Column:
    """Whether a folder's path starts with ``prefix``, as it is written."""
    return folder.startswith(prefix)


def ancestors(path: Column) -> Column:
    """The folders above a path, the nearest last."""
    parts = F.split(path, r"[/\\]")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
