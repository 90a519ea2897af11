"""Scalar, string, array, map, JSON and vector functions: Column -> Column, all compiled by Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def substring(c: Column, start: int, end: int | None = None) -> Column:
    """Characters from ``start`` (from 0) to before ``end``."""
    return F.substring(c, start + 1, (end - start) if end is not None else 2**31 - 1)


def find(c: Column, needle: str, start: int = 0) -> Column:
    """Place of the needle from ``start`` on, or -1. An empty needle is an error."""
    if not needle:
        raise ValueError("empty needle")
    return F.locate(needle, c, start + 1) - 1


def starts_with(c: Column, prefix: str, at: int = 0) -> Column:
    return F.substring(c, at + 1, len(prefix)) == F.lit(prefix)


def char_at(c: Column, i: int) -> Column:
    return F.substring(c, i + 1, 1)


def decode_ascii(c: Column) -> Column:
    return F.decode(c, "US-ASCII")


def decode_utf8(c: Column) -> Column:
    return F.decode(c, "UTF-8")


def to_lower(c: Column) -> Column:
    return F.lower(c)


#: A character outside of words.
NON_WORD = r"[^\p{L}\p{Nd}_]"


def replace_non_word(c: Column, replacement: str = " ") -> Column:
    """Everything but Unicode letters, decimal digits and ``_`` replaced, character by character."""
    return F.regexp_replace(c, NON_WORD, replacement)


def tokenize(c: Column) -> Column:
    """Non-empty tokens between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def split_line(c: Column, delimiter: str) -> Column:
    """Fields between a literal delimiter; empty ones stay."""
    return F.split(c, r"\Q" + delimiter + r"\E")


def map_lookup(c: Column, key: str, pairs: str = ",", value: str = "=") -> Column:
    """The value of a key in a text of delimited pairs, or null."""
    return F.try_element_at(F.str_to_map(c, F.lit(pairs), F.lit(value)), F.lit(key))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def vector_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sublist(c: Column, start: int, end: int) -> Column:
    """Elements from ``start`` (from 0) to before ``end``."""
    return F.slice(c, start + 1, end - start)


def index_of(c: Column, value) -> Column:
    """Place (from 0) of the first equal element, or -1."""
    return F.array_position(c, value) - 1


def last_index_of(c: Column, value) -> Column:
    at = F.array_position(F.reverse(c), value)
    return F.when(at > 0, F.size(c) - at).otherwise(F.lit(-1))


def list_set(c: Column, i: int, value: Column) -> Column:
    return F.transform(c, lambda x, k: F.when(k == i, value).otherwise(x))


def retain_all(c: Column, other: Column) -> Column:
    """Elements, repeats included, that the other list holds."""
    return F.filter(c, lambda x: F.array_contains(other, x))


def remove_all(c: Column, other: Column) -> Column:
    return F.filter(c, lambda x: ~F.array_contains(other, x))


def map_put(c: Column, key, value) -> Column:
    """The map with one entry set."""
    rest = F.map_filter(c, lambda k, _: k != F.lit(key))
    return F.map_concat(rest, F.create_map(F.lit(key), F.lit(value)))


def map_put_all(c: Column, other: Column) -> Column:
    """Entries of both maps, the second's where both have a key."""
    return F.map_concat(F.map_filter(c, lambda k, _: ~F.map_contains_key(other, k)), other)


def map_remove(c: Column, key) -> Column:
    return F.map_filter(c, lambda k, _: k != F.lit(key))


def contains_value(c: Column, value) -> Column:
    return F.array_contains(F.map_values(c), value)


def json_get(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def json_set(c: Column, key: str, value: Column) -> Column:
    """A JSON object with one member set, behind all others; every member keeps its type."""
    members = F.from_json(c, "map<string,variant>")
    new = F.variant_get(F.parse_json(F.to_json(F.struct(value.alias("v")))), "$.v", "variant")
    return F.to_json(F.map_concat(F.map_filter(members, lambda k, _: k != F.lit(key)), F.create_map(F.lit(key), new)))


def year_after(c: Column, year: int) -> Column:
    """``year(c) > year`` as a range, which reaches the statistics of Parquet files."""
    return c >= F.make_timestamp(F.lit(year + 1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def year_is(c: Column, year: int) -> Column:
    """``year(c) = year`` as a range."""
    return year_after(c, year - 1) & ~year_after(c, year)


def parse_number(c: Column, kind: str = "double", decimal: str = ".", exponent: bool = True) -> Column:
    """A number from text, null where it is none; ``decimal`` may be a comma; without ``exponent`` 1e3 is none."""
    if not exponent:
        c = F.when(~c.rlike("[eE]"), c)
    if decimal != ".":
        c = F.replace(c, F.lit(decimal), F.lit("."))
    return F.trim(c).try_cast(kind)


def format_number(c: Column, pattern: str = "%.2f") -> Column:
    return F.format_string(pattern, c)


def log2_floor(c: Column) -> Column:
    """The place of an integer's highest bit: 0 for 1, null below 1."""
    return F.when(c > 0, F.length(F.bin(c)) - 1)


def is_power_of_two(c: Column) -> Column:
    return (c > 0) & (F.bit_count(c) == 1)


def next_power_of_two(c: Column) -> Column:
    """The least power of two that is not less."""
    return F.when(c <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(c - 1))))


def coalesce_fields(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def hash_id(c: Column) -> Column:
    """A 64-bit id of a text."""
    return F.xxhash64(c)
