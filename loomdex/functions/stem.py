"""The Porter stemmer (with the reference's two departures) as one SQL expression.

A word is [C](VC)^m[V] with runs of consonants C and vowels V, so each test on the measure m is a regular expression;
a `y` is a vowel after a consonant only, so an initial one is upper-cased for the time being.  The expression is a
chain of CASEs over one column, evaluated natively; stem distinct terms and join.  The same rules are written for
Spark and for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The suffix rules of steps 2 to 4, longest first among those that end alike.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_RUN_C = "[^aeiou][^aeiouy]*"
M_POSITIVE = f"^({_RUN_C})?[aeiouy][aeiou]*{_RUN_C}"
M_ONE = f"^({_RUN_C})?[aeiouy][aeiou]*{_RUN_C}([aeiouy][aeiou]*)?$"
M_MORE = f"^({_RUN_C})?[aeiouy][aeiou]*{_RUN_C}[aeiouy][aeiou]*{_RUN_C}"
HAS_VOWEL = f"^({_RUN_C})?[aeiouy]"
CVC = f"^{_RUN_C}[aeiouy][^aeiouwxy]$"


def stem_steps(spark: bool = True) -> list[str]:
    """SQL expressions, each over the column w of the one before; DuckDB's dialect if not spark."""
    like = (lambda x, p: f"rlike({x}, '{p}')") if spark else (lambda x, p: f"regexp_matches({x}, '{p}')")
    cut = lambda n: f"substr(w, 1, length(w) - {n})" if n else "w"
    ends = lambda s: f"{'endswith' if spark else 'ends_with'}(w, '{s}')"

    def swap(rules: dict[str, str], test: str) -> str:
        order = sorted(rules, key=len, reverse=True)
        whens = " ".join(f"WHEN {ends(s)} THEN CASE WHEN {like(cut(len(s)), test)} THEN concat({cut(len(s))}, '{rules[s]}') ELSE w END" for s in order)
        return f"CASE {whens} ELSE w END"

    first = "CASE WHEN substr(w, 1, 1) = 'y' THEN concat('Y', substr(w, 2)) ELSE w END"
    plural = f"CASE WHEN {ends('sses')} OR {ends('ies')} THEN {cut(2)} WHEN {ends('s')} AND NOT {ends('ss')} THEN {cut(1)} ELSE w END"
    # -ed and -ing leave a mark, so that the next expression knows that the ending went
    past = f"CASE WHEN {ends('eed')} THEN CASE WHEN {like(cut(3), M_POSITIVE)} THEN {cut(1)} ELSE w END WHEN {ends('ed')} AND {like(cut(2), HAS_VOWEL)} THEN concat({cut(2)}, '+') WHEN {ends('ing')} AND {like(cut(3), HAS_VOWEL)} THEN concat({cut(3)}, '+') ELSE w END"
    bare = cut(1)
    last = "substr(w, length(w) - 1, 1)"  # before the mark
    twice = f"({last} = substr(w, length(w) - 2, 1) AND NOT {like(last, '[aeiou]')} AND NOT {like(bare, '[aeiou]yy$')})"
    mend = f"CASE WHEN NOT {ends('+')} THEN w WHEN {ends('at+')} OR {ends('bl+')} OR {ends('iz+')} THEN concat({bare}, 'e') WHEN length(w) > 2 AND {twice} THEN CASE WHEN {like(last, '[lsz]')} THEN {bare} ELSE {cut(2)} END WHEN {like(bare, M_ONE)} AND {like(bare, CVC)} THEN concat({bare}, 'e') ELSE {bare} END"
    y = f"CASE WHEN {ends('y')} AND {like(cut(1), HAS_VOWEL)} THEN concat({cut(1)}, 'i') ELSE w END"
    four = " ".join(f"WHEN {ends(s)} THEN CASE WHEN {like(cut(len(s)), M_MORE)}" + (f" AND {like(cut(3), '[st]$')}" if s == "ion" else "") + f" THEN {cut(len(s))} ELSE w END" for s in sorted(STEP4, key=len, reverse=True))
    final = f"CASE WHEN {ends('e')} AND ({like(cut(1), M_MORE)} OR ({like(cut(1), M_ONE)} AND NOT {like(cut(1), CVC)})) THEN {cut(1)} ELSE w END"
    double = f"CASE WHEN {ends('ll')} AND {like(cut(1), M_MORE)} THEN {cut(1)} ELSE w END"
    return [first, plural, past, mend, y, swap(STEP2, M_POSITIVE), swap(STEP3, M_POSITIVE), f"CASE {four} ELSE w END", final, double, "lower(w)"]


def with_stem(terms: DataFrame, column: str = "term", name: str = "stem") -> DataFrame:
    """Adds the stem of a column of lower-case words; words of one or two letters stay, null gives null."""
    others = terms.columns
    df = terms.withColumn("w", F.col(column))
    for step, expression in enumerate(stem_steps()):
        short = F.length("w") <= 1 if 5 <= step <= 9 else F.lit(False)  # one letter is left after the first steps: no more
        df = df.withColumn("w", F.when(short, F.col("w")).otherwise(F.expr(expression)))
    stem = F.when(F.length(column) <= 2, F.col(column)).otherwise(F.col("w"))
    return df.select(*others, stem.alias(name))


def stem_sql(source: str, column: str = "term", name: str = "stem") -> str:
    """The same as a DuckDB query over the relation `source`: its columns and the stem."""
    q = f"SELECT *, {column} AS w FROM {source}"
    for step, expression in enumerate(stem_steps(spark=False)):
        body = f"CASE WHEN length(w) <= 1 THEN w ELSE {expression} END" if 5 <= step <= 9 else expression
        q = f"SELECT * REPLACE ({body} AS w) FROM ({q})"
    return f"SELECT * EXCLUDE (w), CASE WHEN length({column}) <= 2 THEN {column} ELSE w END AS {name} FROM ({q})"

