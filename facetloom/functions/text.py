"""Text expressions: Column in, Column out, evaluated inside the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from facetloom.functions import vocab as V

# Every character Python treats as white space in text.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
NOT_ASCII = r"[^\x00-\x7f]"


def words(values) -> str:
    return "|".join(values)


def collapse_white(c: Column) -> Column:
    return F.regexp_replace(c, WHITE, " ")


def clean_text(c: Column, limit: int | None = 180) -> Column:
    """Collapse white space, strip edge punctuation, keep ``limit`` characters."""
    stripped = F.btrim(collapse_white(c), F.lit(V.EDGE_CHARACTERS))
    if limit is None:
        return stripped
    return F.rtrim(F.substring(stripped, 1, limit))


def _fold_unicode():
    # Built on use, so that it travels to executors by value.
    def fold(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(
            lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold()
        )

    return pandas_udf(fold, StringType())


def fold_case(c: Column, unicode: bool = False) -> Column:
    """Compatibility-normalised, case-folded text.

    ASCII text only needs ``lower``.  With ``unicode`` the other rows (and only
    those; ASCII rows reach Python as nulls) go through an Arrow batch.
    """
    if not unicode:
        return F.lower(c)
    odd = F.when(c.rlike(NOT_ASCII), c)
    return F.coalesce(_fold_unicode()(odd), F.lower(c))


def fold_list(c: Column) -> Column:
    """Every item of a list folded with ``unicode``; a missing item is empty, NUL counts as a space.

    Python columns cannot stand inside a lambda, so the items travel as one text.
    """
    items = F.transform(c, lambda v: F.translate(F.coalesce(v, F.lit("")), "\0", " "))
    folded = F.split(fold_case(F.array_join(items, "\0"), True), "\0")
    return F.when(F.size(c) > 0, folded).otherwise(F.array().cast("array<string>"))


def normalize_value(c: Column, unicode: bool = False) -> Column:
    return F.trim(collapse_white(fold_case(c, unicode)))


def with_normalized(df: DataFrame, column: str, into: str) -> DataFrame:
    """``df`` with ``normalize_value`` of a column, each distinct non-ASCII value folded once.

    Values of plain ASCII never leave the JVM and match nothing in the join; their keys
    are hashes of whole rows, as a key they all share would put them into one task.
    """
    odd = (
        df.filter(F.col(column).rlike(NOT_ASCII)).select(F.col(column).alias("_odd")).distinct()
        .withColumn("_folded", normalize_value(F.col("_odd"), True))
    )
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    key = F.when(F.col(column).rlike(NOT_ASCII), F.col(column)).otherwise(F.xxhash64(*plain).cast("string"))
    return (
        df.withColumn("_key", key).join(odd, F.col("_key") == F.col("_odd"), "left")
        .withColumn(into, F.coalesce("_folded", normalize_value(F.col(column))))
        .drop("_key", "_odd", "_folded")
    )


def normalize_constraint(c: Column, unicode: bool = False) -> Column:
    return normalize_value(clean_text(c, None), unicode)


def flatten_list(c: Column) -> Column:
    """Non-empty items of a list; a missing list counts as empty."""
    items = F.filter(c, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(items, F.array().cast("array<string>"))


def flatten_map(c: Column, separator: str = ": ") -> Column:
    """``key: value`` items of a map whose value is not empty."""
    kept = F.filter(
        F.map_entries(c), lambda e: e["value"].isNotNull() & (e["value"] != "")
    )
    items = F.transform(kept, lambda e: F.concat(e["key"], F.lit(separator), e["value"]))
    return F.coalesce(items, F.array().cast("array<string>"))


def flatten_scalar(c: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(empty)


def searchable_items(
    title="title", features="features", details="details",
    description="description", categories="categories", store="store",
) -> Column:
    return F.concat(
        flatten_scalar(F.col(title)),
        flatten_list(F.col(features)),
        flatten_map(F.col(details)),
        flatten_list(F.col(description)),
        flatten_list(F.col(categories)),
        flatten_scalar(F.col(store)),
    )


def searchable_text() -> Column:
    return F.array_join(searchable_items(), " ")


def evaluator_text() -> Column:
    """Looser variant: details as ``key value``; empty items are kept."""
    def kept(c):
        return F.coalesce(c, F.array().cast("array<string>"))

    entries = F.transform(
        F.map_entries("details"),
        lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(e["value"], F.lit("None"))),
    )
    scalar = lambda name: F.when(F.col(name).isNotNull(), F.array(F.col(name)))
    parts = F.concat(
        kept(scalar("title")), kept(F.col("features")), kept(entries),
        kept(F.col("description")), kept(F.col("categories")), kept(scalar("store")),
    )
    return F.trim(F.array_join(parts, " "))


def product_document(limit: int = 300) -> Column:
    parts = F.array(
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))),
        F.concat(F.lit("Category: "), F.array_join(flatten_list(F.col("categories")), " > ")),
        F.concat(F.lit("Brand: "), F.coalesce("store", F.lit(""))),
        F.concat(
            F.lit("Features: "),
            F.array_join(F.slice(flatten_list(F.col("features")), 1, 2), " "),
        ),
        F.concat(
            F.lit("Description: "),
            F.array_join(F.slice(flatten_list(F.col("description")), 1, 1), " "),
        ),
    )
    kept = F.filter(parts, lambda p: ~p.endswith(": "))
    return F.substring(F.array_join(kept, " | "), 1, max(1, int(limit)))


def category_names(c: Column) -> Column:
    return F.filter(F.transform(flatten_list(c), lambda x: F.trim(x)), lambda x: x != "")


def coarse_category(c: Column) -> Column:
    """Last two informative category parts, or the default name."""
    pieces = F.flatten(F.transform(c, lambda x: F.split(x, ",")))
    pieces = F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")
    kept = F.filter(pieces, lambda x: ~F.lower(x).isin(*V.GENERIC_CATEGORIES))
    # A negative slice start before the first element would return nothing.
    tail = F.when(F.size(kept) > 2, F.slice(kept, -2, 2)).otherwise(kept)
    return F.when(F.size(kept) > 0, F.array_join(tail, " ")).otherwise(
        F.lit(V.DEFAULT_CATEGORY)
    )


def classify_constraint(c: Column, colors=V.CONVERSATION_COLORS) -> Column:
    """Attribute of a constraint text; the rules test substrings, in order."""
    low = F.lower(c)
    return (
        F.when(low.contains("budget") | low.rlike(r"(?:\$|<=|under)\s*\d"), "budget")
        .when(low.rlike(words(V.MATERIALS)), "material")
        .when(low.rlike(words(("color", *colors))), "color")
        .when(low.rlike(words(V.SIZE_WORDS)), "size")
        .when(low.rlike(words(V.STYLE_WORDS)), "style")
        .when(low.rlike(words(V.USE_CASE_WORDS)), "use_case")
        .otherwise("feature")
    )


def word_tags(c: Column, vocabulary) -> Column:
    """All whole-word mentions, lower case, in text order, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"\b({words(vocabulary)})\b"), F.lit(1))


def query_tokens(c: Column, max_tokens: int = 16, unicode: bool = False) -> Column:
    """First distinct informative words of a search text."""
    found = F.regexp_extract_all(fold_case(c, unicode), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    kept = F.filter(
        found,
        lambda t: ~t.isin(*V.QUERY_STOPWORDS)
        & ((F.char_length(t) >= 2) | t.rlike(r"^\p{N}$")),
    )
    return F.slice(F.array_distinct(kept), 1, max_tokens)


def document_terms(c: Column, unicode: bool = False) -> Column:
    """Index terms of a document: case-folded alphanumeric runs, repeats kept."""
    return F.regexp_extract_all(fold_case(c, unicode), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def normalize_utterance(c: Column, unicode: bool = True) -> Column:
    text = F.translate(fold_case(c, unicode), "’", "'")
    text = F.regexp_replace(text, r"(?<=\d),(?=\d{3}\b)", "")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9$.'-]+", " "))


def intent_text(c: Column) -> Column:
    """Wording only: lower case words and digits separated by single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "’", "'"), r"[^a-z0-9]+", " "))


def intent_words(text: str) -> str:
    """``intent_text`` of a fixed cue."""
    import re

    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def semantic_fragment(c: Column, has_operators: Column | None = None) -> Column:
    """Text safe to embed, or null: too short, or it carries logic words."""
    fragment = F.trim(collapse_white(c))
    unsafe = (F.char_length(fragment) < 3) | fragment.rlike(V.SEMANTIC_OPERATORS)
    if has_operators is not None:
        unsafe = unsafe | has_operators
    return F.when(~unsafe, fragment)
