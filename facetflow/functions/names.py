"""Names of channels and textures, quoted string lists, parameter records and metadata maps as Column expressions. Null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a name's ending tells of a channel.
ENDINGS = ("_tex", "_curvature", "_UV")


def without_prefix(name: Column, prefix: Column) -> Column:
    """The name after a prefix that it must have; raises where it hasn't."""
    return F.when(F.startswith(name, prefix), F.substr(name, F.length(prefix) + 1)).when(name.isNotNull(), F.raise_error(F.concat(F.lit("no such prefix: "), name)).cast("string"))


def without_ending(name: Column) -> Column:
    """The name without one of the known endings."""
    return F.regexp_replace(name, "(?:" + "|".join(ENDINGS) + ")$", "")


def identifier(name: Column) -> Column:
    """Blanks and dashes as underscores."""
    return F.translate(name, " -", "__")


def base_name(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def parse_strings(text: Column) -> Column:
    """The strings of a list of quoted strings; a backslash keeps the next character from its meaning."""
    found = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.transform(found, lambda s: F.regexp_replace(s, r"\\(.)", "$1"))


def quote_strings(strings: Column) -> Column:
    """A list of quoted strings, read by parse_strings."""
    return F.array_join(F.transform(strings, lambda s: F.concat(F.lit('"'), F.regexp_replace(s, r'(["\\])', r"\\$1"), F.lit('"'))), " ")


def meta_number(meta: Column, key: str, default: float) -> Column:
    """A metadata value as a number; the default where there is none."""
    return F.coalesce(F.element_at(meta, key).try_cast("double"), F.lit(float(default)))


def meta_text(meta: Column, key: str, default: str = "") -> Column:
    return F.coalesce(F.element_at(meta, key), F.lit(default))


def shift_axis(meta: Column, source: int, target: int) -> Column:
    """Keys that end in the number of one axis, for another, whose own keys go."""
    kept = F.map_filter(meta, lambda k, _: ~F.regexp_like(k, F.lit(f"^(?:IniVal|Step|Coord|Units|Dimlen){target}$")))
    return F.transform_keys(kept, lambda k, _: F.regexp_replace(k, f"^(IniVal|Step|Coord|Units|Dimlen){source}$", f"$1{target}"))


def texture_scale(first: Column, step: Column, n: Column) -> tuple[Column, Column]:
    """(physical coordinate of a texture's lower edge, length of the whole texture) of an axis of pixel centres."""
    return first - step / 2, step * n


def appearance(texture: Column, color: Column, default: Column) -> Column:
    """A texture where there is one, else a colour, else the default (structs of one type)."""
    return F.coalesce(texture, color, default)


def updated(record: Column, **changes: Column) -> Column:
    """A copy of a struct with some of its fields changed; other names raise when the query is analysed."""
    known = [record[name].cast("string").isNull() & F.lit(False) for name in changes]  # resolves each name
    for name, value in changes.items():
        record = record.withField(name, value)
    for k in known:
        record = F.when(k, F.lit(None)).otherwise(record)
    return record


def now() -> Column:
    """The time of the query."""
    return F.current_timestamp()
