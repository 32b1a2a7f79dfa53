"""Scalar functions over strings: splitting, counting, templates, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS, ALPHANUMERICS = "A-Za-z", "A-Za-z0-9"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_pieces(text: str | Column, delimiters: str = " ", keep: str | None = None, lower: bool = False) -> Column:
    """Pieces between any of the delimiter characters; characters outside the class `keep` are deleted (they do not
    split), empty pieces are dropped.  Null gives null."""
    klass = "[" + "".join("\\" + c if c in "\\]^-[" else c for c in delimiters) + "]"
    pieces = F.split(_col(text), klass)

    def clean(p: Column) -> Column:
        p = F.regexp_replace(p, f"[^{keep}]", "") if keep else p
        return F.lower(p) if lower else p

    return F.filter(F.transform(pieces, clean), lambda p: p != "")


def words(text: str | Column, newline_as_space: bool = False) -> Column:
    """The index's words: split at blanks only, everything but A-Z and a-z deleted, lower case.  Words join across line
    breaks, as the index builds them, unless newline_as_space."""
    c = _col(text)
    return split_pieces(F.translate(c, "\n\t", "  ") if newline_as_space else c, " ", LETTERS, True)


def piece_lengths(pieces: str | Column) -> Column:
    return F.transform(_col(pieces), F.length)


def first_index(text: str | Column, char: str) -> Column:
    """Zero-based index of the first `char`, -1 if there is none."""
    return F.instr(_col(text), char) - 1


def char_count(text: str | Column, char: str) -> Column:
    c = _col(text)
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def fill_template(template: str, *values: str | Column) -> Column:
    """Each `$` of the template replaced by the next value; a null value gives null."""
    parts = template.split("$")
    if len(parts) - 1 != len(values):
        raise ValueError(f"the template has {len(parts) - 1} places, {len(values)} values were given")
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:]):
        out += [_col(value).cast("string"), F.lit(part)]
    return F.concat(*out)


def to_number(text: str | Column, kind: str = "double") -> Column:
    """The number, 0 where the text is none."""
    return F.coalesce(_col(text).try_cast(kind), F.lit(0).cast(kind))


def normalize_title(title: str | Column) -> Column:
    """Only A-Z, a-z and digits of each piece, lower case, pieces joined by single blanks; empty if nothing is left."""
    return F.array_join(split_pieces(title, ": ", ALPHANUMERICS, True), " ")


def in_class(char: str | Column, klass: str) -> Column:
    """Whether a one-character string is in a character class such as A-Za-z."""
    return _col(char).rlike(f"^[{klass}]$")


def times33(text: str | Column) -> Column:
    """The hash h = 33 h + byte from 5381, in 64 bits, wrapped to a signed number; null for null.  Two halves of 32 bits
    carry it, so that no product overflows."""
    digits, half = F.hex(F.encode(_col(text), "UTF-8")), F.lit(0xFFFFFFFF)
    digit = lambda i: F.instr(F.lit("123456789ABCDEF"), F.substring(digits, i, F.lit(1)))
    bytes_ = F.transform(F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>")), lambda i: digit(i) * 16 + digit(i + 1))

    def step(h: Column, byte: Column) -> Column:
        low = h["low"] * 33 + byte
        return F.struct((h["high"] * 33 + F.shiftright(low, 32)).bitwiseAND(half).alias("high"), low.bitwiseAND(half).alias("low"))

    start = F.struct(F.lit(0).cast("long").alias("high"), F.lit(5381).cast("long").alias("low"))
    return F.when(_col(text).isNotNull(), F.aggregate(bytes_, start, step, lambda h: F.shiftleft(h["high"], 32).bitwiseOR(h["low"])))
