"""French number words to values, and the numbers of a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import text as T

#: Number words, folded. Multipliers are apart.
WORDS = {
    "zero": 0, "un": 1, "une": 1, "premier": 1, "premiere": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "onze": 11, "douze": 12, "treize": 13, "quatorze": 14, "quinze": 15, "seize": 16,
    "vingt": 20, "vingts": 20, "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60, "cent": 100, "cents": 100, "mille": 1000, "million": 10**6, "millions": 10**6, "milliard": 10**9, "milliards": 10**9,
}
NONE = -1  # no word of a number


def _coded(c: Column) -> Column:
    """Tokens of a text as values of number words; 'et' is -2, any other token NONE, and one NONE ends the list."""
    table = F.create_map(*[F.lit(x) for w, v in {**WORDS, "et": -2}.items() for x in (w, v)])
    words = F.filter(F.split(F.lower(T.fold_letters(c)), "[^a-z0-9]+"), lambda w: w != "")
    return F.concat(F.transform(words, lambda w: F.coalesce(table[w].cast("long"), F.lit(NONE).cast("long"))), F.array(F.lit(NONE).cast("long")))


def word_values(c: Column) -> Column:
    """array<bigint>: the numbers that a text has in words, in order, each as long as the grammar lets it grow.

    State is what a number has come to: whole thousands (total), the part below (cur), the least multiplier used and a pending 'et'.
    A unit follows tens, 17 to 19 follow ten, 10 to 16 follow sixty and eighty, 'vingt' after four makes eighty, 'cent' multiplies
    a unit, 'mille', 'million' and 'milliard' what stands before them if they are less than the multipliers before. A word that
    can't go on with a number begins the next one.
    """
    big = lambda n: F.lit(n).cast("long")

    def step(s: Column, w: Column) -> Column:
        cur, tail = s["cur"], s["cur"] % 100
        # What the word makes of the part below a thousand; null if it can't follow.
        unit = F.when((tail == 0) | tail.isin(20, 30, 40, 50, 60, 80), cur + w).when((tail % 100).isin(10, 70, 90) & (w >= 7), cur + w)
        ten = F.when(tail.isin(0, 60, 80), cur + w)
        tens = F.when(tail == 0, cur + w).when((tail == 4) & (w == 20), cur + 76)
        grown = F.when(w.between(1, 9), unit).when(w.between(10, 16), ten).when(w.between(20, 60), tens).when((w == 100) & (cur < 10) & (cur != 1), F.greatest(cur, big(1)) * 100)
        grown = F.when(~s["et"] | (w.isin(1, 11) & tail.isin(20, 30, 40, 50, 60)), grown)
        grown = F.when(~s["zero"], grown)
        multiplied = F.when((w >= 1000) & (w < s["least"]) & ~s["et"] & ~s["zero"] & ((cur > 0) | ((w == 1000) & (s["total"] % 10**6 == 0))), s["total"] + F.greatest(cur, big(1)) * w)
        said = F.when(s["open"], F.array_append(s["out"], s["total"] + cur)).otherwise(s["out"])
        state = lambda total, cur, least, open_, et, zero, out: F.struct(total.alias("total"), cur.alias("cur"), least.alias("least"), open_.alias("open"), et.alias("et"), zero.alias("zero"), out.alias("out"))
        top, yes, no = big(10**12), F.lit(True), F.lit(False)
        fresh = state(F.when(w >= 1000, w).otherwise(big(0)), F.when(w < 1000, w).otherwise(big(0)), F.when(w >= 1000, w).otherwise(top), yes, no, w == 0, said)
        return (
            F.when((w == -2) & s["open"] & ~s["et"], state(s["total"], cur, s["least"], yes, yes, s["zero"], s["out"]))
            .when(w < 0, state(big(0), big(0), top, no, no, no, said))
            .when(s["open"] & multiplied.isNotNull(), state(multiplied, big(0), w, yes, no, no, s["out"]))
            .when(s["open"] & grown.isNotNull(), state(s["total"], grown, s["least"], yes, no, no, s["out"]))
            .otherwise(fresh)
        )

    start = F.struct(big(0).alias("total"), big(0).alias("cur"), big(10**12).alias("least"), F.lit(False).alias("open"), F.lit(False).alias("et"), F.lit(False).alias("zero"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(_coded(c), start, step, lambda s: s["out"])


#: A number in figures: groups of three after the first if there are several, apart by blanks.
FIGURES = "[0-9]{1,3}(?:[   ][0-9]{3})+(?![0-9])|[0-9]+"


def _value(s: Column) -> Column:
    """Digits without leading zeros, so that equal values are equal strings whatever their length."""
    return F.regexp_replace(F.regexp_replace(s, "[^0-9]", ""), "^0+(?=[0-9])", "")


def figures(c: Column) -> Column:
    """array<string>: the distinct numbers of a text in figures."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(FIGURES), F.lit(0)), _value))


def sourced_values(c: Column) -> Column:
    """array<string>: what a text vouches for: its numbers in figures, each group of digits, its numbers in words, each such word."""
    groups = F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), _value)
    single = F.transform(F.filter(_coded(c), lambda w: w >= 0), lambda w: w.cast("string"))
    words = F.transform(word_values(c), lambda n: n.cast("string"))
    return reduce(F.array_union, [figures(c), groups, words, single])


def unsourced(answer: Column, source: Column) -> Column:
    """array<string>: numbers of the answer, by value, that the source doesn't have; a number of several groups is vouched for by
    its groups as well."""
    known = sourced_values(source)
    groups = lambda s: F.transform(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)), _value)
    raw = F.array_distinct(F.regexp_extract_all(answer, F.lit(FIGURES), F.lit(0)))
    return F.transform(F.array(known), lambda k: F.filter(F.array_distinct(F.transform(F.filter(raw, lambda s: ~F.array_contains(k, _value(s)) & ~F.forall(groups(s), lambda g: F.array_contains(k, g))), _value)), lambda x: x != ""))[0]
