"""Column expressions over text. Everything here stays inside the JVM except ``nfkd``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Explicit classes, so that a word and a space mean the same in every regex dialect.
WORD_CHAR = r"\p{L}\p{N}_"
WORD_RUN = rf"[{WORD_CHAR}]+"
ANY_RUN = rf"[{WORD_CHAR}]+|[^{WORD_CHAR}]+"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
# The characters of SPACE, for trimming without a regex.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)

# Abbreviations that do not end a sentence.
ABBREVIATIONS = [
    "Mr", "Mrs", "Dr", "Prof", "Gov", "Gen", "Col", "Lt", "Sgt", "Hon", "Rev",
    "Jr", "Sr", "St", "Vol", "No", "vs", "etc", "viz", "cf", "approx",
]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Trim, and collapse every run of white space to one blank."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def word_runs(c: Column) -> Column:
    """Lower-cased maximal runs of word characters, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_RUN), F.lit(0))


def ascii_gaps(c: Column) -> Column:
    """Text whose only characters outside of words are ASCII, for ``arrow.split_words``; others become blanks."""
    return F.regexp_replace(c, rf"[^\x00-\x7F{WORD_CHAR}]+", " ")


def split_words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(split_words(c)).cast("long")


# ---- ids and labels -------------------------------------------------------------------


def id_number(c: Column) -> Column:
    """First run of digits as a number; null when there is none."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"(\d+)", 1), F.lit("")).cast("long")


def id_label(c: Column) -> Column:
    """``Text #: N`` for anything holding digits, the trimmed value otherwise, null for blanks."""
    s = strip(c.cast("string"))
    digits = F.regexp_extract(s, r"0*(\d+)", 1)
    return F.when(s == "", None).when(digits != "", F.concat(F.lit("Text #: "), digits)).otherwise(s)


def id_bare(c: Column) -> Column:
    return strip(F.replace(strip(c.cast("string")), F.lit("Text #: "), F.lit("")))


def source_key(c: Column) -> Column:
    """Source label reduced to lower-case letters, digits and single blanks."""
    s = F.regexp_replace(F.lower(strip(c)), rf"^source:{SPACE}*", "")
    return F.coalesce(squeeze(F.regexp_replace(s, r"[^0-9a-z]", " ")), F.lit(""))


def keyword_list(c: Column) -> Column:
    """Comma separated keywords as a list of non-empty strings."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda k: k != "")


def trimmed_list(c: Column) -> Column:
    return F.filter(F.transform(c, strip), lambda k: k != "")


# ---- bodies, cleaning and splitting ---------------------------------------------------


def body_between(c: Column) -> Column:
    """Text between the ``Full Text:`` line and the ``Summary:`` line (or the end)."""
    body = F.regexp_extract(c, r"(?s)Full Text:\s*\n(.*?)(?:\n\s*Summary:|\z)", 1)
    return strip(body)


def body_after(c: Column) -> Column:
    """Everything after the first marker that occurs, tried in the order below, or an empty string."""
    def rest(marker: str) -> Column:
        at = F.locate(marker, c)
        return F.when(at > 0, strip(F.substring(c, at + F.lit(len(marker)), F.length(c))))

    # Body markers, in order of preference.
    markers = ["Full Text:\n", "Full Text: \n", "Full Text:"]
    return F.coalesce(*[rest(m) for m in markers], F.lit(""))


def parse_vector(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<double>"), F.array().cast("array<double>"))


def clean_text(c: Column, speaker: str | None = None) -> Column:
    """Unify line ends, drop ``Mr. <speaker>'s Speech/Reply`` headers, limit blanks and blank lines."""
    c = F.replace(c, F.lit("\\n\\n"), F.lit("\n\n"))
    c = F.regexp_replace(c, "\r\n?", "\n")
    if speaker:
        c = F.regexp_replace(c, rf"(?i)Mr\.?\s+\Q{speaker}\E'?s?\s+(?:Speech|Reply)\.?", "")
    c = F.regexp_replace(c, " {2,}", " ")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def interjections(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\[[^\n]*?\]")).cast("long")


def paragraphs(c: Column, separator: str = "\n\n") -> Column:
    return trimmed_list(F.split(c, rf"\Q{separator}\E"))


def sentences(c: Column) -> Column:
    """Split after ``.!?`` before a capital, unless an abbreviation stands there."""
    short = "|".join(ABBREVIATIONS)
    cut = rf"(?<=[.!?])(?<!(?<![{WORD_CHAR}])(?:{short})\.){SPACE}+(?=[A-Z])"
    return trimmed_list(F.split(c, cut))


def pack_parts(parts: Column, target: int = 700, limit: int = 900, glue: str = "\n\n") -> Column:
    """Greedily join parts into pieces of about ``target`` and, where possible, at most ``limit`` characters."""
    if limit < target:
        raise ValueError("limit must be at least target")
    gap = len(glue)

    def state(done: Column, cur: Column) -> Column:
        return F.struct(done.alias("done"), cur.alias("cur"))

    def step(acc: Column, part: Column) -> Column:
        held, new = F.length(acc["cur"]), F.length(part)
        joined = F.concat(acc["cur"], F.lit(glue), part)
        return (
            F.when(held == 0, state(acc["done"], part))
            .when(held + new + gap <= limit, state(acc["done"], joined))
            .when(held >= target, state(F.array_append(acc["done"], acc["cur"]), part))
            .otherwise(state(F.array_append(acc["done"], joined), F.lit("")))
        )

    start = state(F.array().cast("array<string>"), F.lit(""))
    return F.aggregate(
        parts, start, step,
        lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])),
    )


def chunk_text(c: Column, separator: str = "\n\n", target: int = 700, limit: int = 900) -> Column:
    """Paragraphs, long ones cut into sentences, packed into chunks."""
    parts = F.flatten(
        F.transform(
            paragraphs(c, separator),
            lambda p: F.when(F.length(p) > limit, sentences(p)).otherwise(F.array(p)),
        )
    )
    return pack_parts(parts, target, limit)


def word_segments(c: Column, size: int = 100, overlap: int = 50) -> Column:
    """Windows of ``size`` words that advance by ``size - overlap``."""
    step = size - overlap

    def cut(words: Column) -> Column:
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(step)))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))

    return F.coalesce(let(split_words(c), cut), F.array().cast("array<string>"))


def combined_field(text_id, source, context, body, summary, keywords, concepts) -> Column:
    """One searchable text of the non-empty parts, separated by blank lines."""
    def tagged(tag: str, c: Column) -> Column:
        return F.when(F.length(c) > 0, F.concat(F.lit(f"{tag}: "), c))

    return F.concat_ws(
        "\n\n", text_id, F.concat(F.lit("Source: "), source), context, body,
        tagged("Summary", summary), tagged("Keywords", F.array_join(keywords, ", ")),
        tagged("Concepts", concepts),
    )


def tagged_line(c: Column, tag: str) -> Column:
    """Value of the last line starting with ``TAG:``; empty when there is none."""
    hits = F.regexp_extract_all(c, F.lit(rf"(?m)^{tag}:(.*)$"), F.lit(1))
    return strip(F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit("")))


# ---- quotes in running text -----------------------------------------------------------


def _literal(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def whole_word_pattern(keyword: Column) -> Column:
    """Pattern that finds ``keyword`` between word boundaries on both sides."""
    wordy = rf"[{WORD_CHAR}]"
    left = F.when(keyword.rlike(rf"^{wordy}"), F.lit(rf"(?<!{wordy})")).otherwise(F.lit(rf"(?<={wordy})"))
    right = F.when(keyword.rlike(rf"{wordy}$"), F.lit(rf"(?!{wordy})")).otherwise(F.lit(rf"(?={wordy})"))
    return F.concat(left, _literal(keyword), right)


def highlight(text: Column, quote: Column) -> Column:
    """Wrap every occurrence of ``quote`` in ``<mark>``; ``a...b`` spans from a to b on one line."""
    parts = F.split(quote, r"\.\.\.")
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    pattern = F.when(
        F.size(parts) >= 2,
        F.concat(F.lit("(?iu)"), _literal(first), F.lit(r"\s*.*?\s*"), _literal(last), F.lit("[.;,]?")),
    ).otherwise(F.concat(F.lit("(?iu)"), _literal(quote), F.lit(r"\s*[.;,]?")))
    return F.regexp_replace(text, pattern, F.lit("<mark>$0</mark>"))


def locate_quote(text: Column, quote: Column) -> Column:
    """The quote itself if it occurs, else its first ``...`` piece over 20 characters that does."""
    pieces = F.filter(
        F.transform(F.split(quote, r"\.\.\."), strip),
        lambda p: (F.length(p) > 20) & F.contains(text, p),
    )
    return F.when(F.contains(text, quote), quote).otherwise(F.try_element_at(pieces, F.lit(1)))


def preview(c: Column, n: int = 160) -> Column:
    s = squeeze(F.coalesce(c, F.lit("")))
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("…"))).otherwise(s)


def fingerprint(c: Column) -> Column:
    return F.left(F.sha1(F.coalesce(c, F.lit(""))), F.lit(10))


# ---- normal forms for quote checking --------------------------------------------------


@pandas_udf(StringType())
def _nfkd(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


def nfkd(c: Column) -> Column:
    """Compatibility decomposition. Pure ASCII values reach Python only as nulls."""
    return F.coalesce(_nfkd(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def strict_form(c: Column, decomposed: bool = False) -> Column:
    """Lower case with unified quote marks, dashes and blanks, and without ``[...]`` insertions."""
    c = F.coalesce(c, F.lit(""))
    if not decomposed:
        c = nfkd(c)
    c = F.regexp_replace(c, "``|''", '"')
    c = F.translate(c, "`‘’“”", "'''\"\"")
    c = F.replace(c, F.lit("…"), F.lit("..."))
    c = F.regexp_replace(c, r"\\n|[\n\r]", " ")
    c = F.regexp_replace(c, "[-–—]+", " ")
    c = F.regexp_replace(c, r"(?s)\[.*?\]", "")
    c = F.lower(squeeze(c))
    return F.regexp_replace(c, rf"(?<![{WORD_CHAR}])[\"']|[\"'](?![{WORD_CHAR}])", "")


def loose_form(strict: Column) -> Column:
    """Strict form reduced to ``[0-9a-z]`` words."""
    return squeeze(F.regexp_replace(strict, r"[^0-9a-z]", " "))
