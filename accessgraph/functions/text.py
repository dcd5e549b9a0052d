"""Text helpers shared by slugs, search and exports."""

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that separate words inside a name.
WORD_BREAK = r"[\s,/:-]+"


def slug_base(name: Column) -> Column:
    """Lower-case name with spaces and slashes as dashes, percent-encoded.

    The JVM encoder keeps ``*`` and escapes ``~``; the wanted form is the reverse.
    """
    dashed = F.translate(F.lower(name), " /", "--")
    encoded = F.url_encode(dashed)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_name(name: Column) -> Column:
    """Trimmed name, null when nothing is left."""
    return F.nullif(F.regexp_replace(name, r"^\s+|\s+$", ""), F.lit(""))


def strip_gid(gid: Column) -> Column:
    """Global id without blanks and the outer braces."""
    return F.regexp_replace(F.trim(gid), r"^\{|\}$", "")


def fold_spaces(name: Column) -> Column:
    """Trimmed, lower-case, with runs of blanks as one space."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), r"\s+", " ")


def name_key(name: Column) -> Column:
    """Canonical composition, full case folding and single spaces.

    Spark has neither composition nor full case folding, so this one runs in
    Arrow batches. The inner function travels to the executors by value.
    """

    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in batches:
            yield names.map(
                lambda v: v if v is None else " ".join(unicodedata.normalize("NFC", v).casefold().split())
            )

    return F.pandas_udf(fold, T.StringType())(name)


def bare(value: Column) -> Column:
    """Lower-case text without accents, as a plain key for equality joins.

    A collation compares so, but gives no key that can be cut in pieces, and
    Spark cannot take letters apart; so this runs in Arrow batches.
    """

    def strip(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(
                lambda v: v
                if v is None or v.isascii()
                else "".join(c for c in unicodedata.normalize("NFD", v) if not unicodedata.combining(c))
            )

    return F.pandas_udf(strip, T.StringType())(F.lower(value))


def loose_true(value: Column) -> Column:
    """Booleans that arrive as true, "true", 1 or "1"."""
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1"), F.lit(False))


def xml_text(value: Column) -> Column:
    """Text with the five reserved XML characters escaped; the ampersand goes first."""
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return value


def without_accents(value: Column) -> Column:
    """Lower-case text under a collation that ignores accents and case."""
    return F.collate(value, "UNICODE_CI_AI")


def grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters."""
    count = F.length(text) - F.lit(size - 1)
    return F.when(
        count >= 1,
        F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, F.lit(size)))),
    ).otherwise(F.array().cast("array<string>"))


def one_shorter(text: Column) -> Column:
    """All texts obtained by dropping one character."""
    return F.when(
        F.length(text) >= 1,
        F.transform(
            F.sequence(F.lit(1), F.length(text)),
            lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))),
        ),
    ).otherwise(F.array().cast("array<string>"))


def dropped_forms(text: Column, depth: int) -> Column:
    """The text and every form of it with up to ``depth`` characters dropped.

    Two texts within edit distance ``depth`` share at least one such form, so
    an equality join on the forms finds every close pair.
    """
    forms = F.array(text)
    layer = forms
    for _ in range(depth):
        layer = F.array_distinct(F.flatten(F.transform(layer, one_shorter)))
        forms = F.concat(forms, layer)
    return F.array_distinct(forms)


def within_edits(left: Column, right: Column, limit: int) -> Column:
    """Edit distance of at most ``limit``; the search stops beyond it."""
    return F.levenshtein(left, right, limit) >= 0


def near_duplicate(left: Column, right: Column) -> Column:
    """Whether two folded names belong to one family of spellings."""
    longest = F.greatest(F.length(left), F.length(right))
    shortest = F.least(F.length(left), F.length(right))
    close = ((longest <= 7) & within_edits(left, right, 2)) | ((longest <= 12) & within_edits(left, right, 1))
    stem = (shortest >= 4) & (longest - shortest <= 2) & (left.startswith(right) | right.startswith(left))
    return (shortest > 0) & ((left == right) | close | stem)


def near_duplicate_keys(name: Column) -> Column:
    """Blocking keys: names that are near duplicates share at least one."""
    size = F.length(name)
    edits = (
        F.when(size <= 7, dropped_forms(name, 2))
        .when(size <= 12, dropped_forms(name, 1))
        .otherwise(F.array(name))
    )
    # A name of eight letters may pair with one of six or seven by stem, and
    # longer names only by equality or by stem; the stems cover both.
    stems = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.substring(name, F.lit(1), size - k))
    return F.array_distinct(F.concat(edits, F.filter(stems, lambda s: F.length(s) >= 4)))
