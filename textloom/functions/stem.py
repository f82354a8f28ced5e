"""Suffix stripping of English words: the published steps of 1980 with their author's two later changes (bli, logi).

Words are lower case. A y at the start or behind a vowel is a consonant; it is written Y on the way, so that
``[aeiouy]`` are the vowels and everything else, digits too, are consonants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Patterns over a stem: it has a vowel; at least one, at least two, exactly one run of vowels with consonants
# behind it; it ends with consonant, vowel, consonant other than w, x, y.
HAS_VOWEL = "[aeiouy]"
ONE = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
TWO = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"
JUST_ONE = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]*$"
SHORT_END = "[^aeiouy][aeiouy][^aeiouywxY]$"

# The suffixes of the second, third and fourth step with what replaces them.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = dict.fromkeys(
    ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
     "ous", "ive", "ize"], "",
)


def _cut(c: str, n: int) -> Column:
    return F.left(c, F.length(c) - n)


def _marked(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, "(^|[aeiou])y", "$1Y"), "yy", "yY")


def _swapped(df: DataFrame, table: dict[str, str], least: str) -> DataFrame:
    """Replace the longest suffix of the table where the rest matches ``least``."""
    longest_first = "|".join(sorted(table, key=len, reverse=True))
    df = df.withColumn("_end", F.regexp_extract("stem", f"({longest_first})$", 1))
    df = df.withColumn("_rest", F.left("stem", F.length("stem") - F.length("_end")))
    new = F.coalesce(*[F.when(F.col("_end") == k, F.lit(v)) for k, v in table.items()])
    fits = (F.col("_end") != "") & F.regexp_like("_rest", F.lit(least))
    if "ion" in table:
        fits = fits & ((F.col("_end") != "ion") | F.regexp_like("_rest", F.lit("[st]$")))
    return df.withColumn("stem", F.when(fits, F.concat("_rest", new)).otherwise(F.col("stem")))


def porter_stems(words: DataFrame, token: str = "token") -> DataFrame:
    """``token, stem`` for every distinct word. Words of up to two characters and null stay as they are."""
    w, like = F.col("stem"), lambda c, pattern: F.regexp_like(c, F.lit(pattern))
    df = words.select(F.col(token).alias("token")).distinct().withColumn("stem", _marked(F.col("token")))
    # Plurals.
    df = df.withColumn(
        "stem", F.when(F.endswith(w, F.lit("sses")) | F.endswith(w, F.lit("ies")), _cut("stem", 2)).when(like(w, "[^s]s$"), _cut("stem", 1)).otherwise(w)
    )
    # Past and progressive forms; what they leave is mended.
    df = df.withColumn("_end", F.regexp_extract("stem", "(eed|ed|ing)$", 1))
    df = df.withColumn("_rest", F.left("stem", F.length("stem") - F.length("_end")))
    df = df.withColumn("_off", F.col("_end").isin("ed", "ing") & like("_rest", HAS_VOWEL))
    rest = F.col("_rest")
    doubled = (F.right(rest, F.lit(1)) == F.substring(rest, -2, 1)) & (F.length(rest) > 1) & ~like(rest, "[aeiouylsz]$")
    doubled = doubled | F.endswith(rest, F.lit("yY"))
    mended = (
        F.when(like(rest, "(at|bl|iz)$"), F.concat(rest, F.lit("e")))
        .when(doubled, _cut("_rest", 1))
        .when(like(rest, JUST_ONE) & like(rest, SHORT_END), F.concat(rest, F.lit("e")))
        .otherwise(rest)
    )
    eed = (F.col("_end") == "eed") & like(rest, ONE)
    df = df.withColumn("stem", F.when(eed, _cut("stem", 1)).when(F.col("_off"), mended).otherwise(w))
    # A final y behind a vowel anywhere.
    df = df.withColumn("stem", F.when(like(w, f"{HAS_VOWEL}.*[yY]$"), F.concat(_cut("stem", 1), F.lit("i"))).otherwise(w))
    for table, least in ((SECOND, ONE), (THIRD, ONE), (FOURTH, TWO)):
        df = _swapped(df, table, least)
    # A final e, then a doubled l.
    df = df.withColumn("_rest", _cut("stem", 1))
    silent = F.endswith(w, F.lit("e")) & (like("_rest", TWO) | (like("_rest", JUST_ONE) & ~like("_rest", SHORT_END)))
    df = df.withColumn("stem", F.when(silent, F.col("_rest")).otherwise(w))
    df = df.withColumn("stem", F.when(F.endswith(w, F.lit("ll")) & like(w, TWO), _cut("stem", 1)).otherwise(w))
    return df.select("token", F.when(F.length("token") <= 2, F.col("token")).otherwise(F.lower("stem")).alias("stem"))
