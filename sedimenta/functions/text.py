"""Text functions as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Unicode whitespace characters.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: A word: letters and digits of any script.
WORD = r"[\p{L}\p{N}]+"


def strip(c: Column) -> Column:
    """Without surrounding Unicode whitespace; null stays null."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """True for texts of whitespace alone, the empty text included; null for null."""
    return strip(c) == ""


def words(c: Column) -> Column:
    """The words of a text in lower case, in order, repetitions included."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def collapse(c: Column) -> Column:
    """Runs of ASCII whitespace as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f\x0B]+", " "))


def folded_name(c: Column) -> Column:
    """A name for comparison: lower case, German umlauts spelt out, words joined by one space."""
    low = F.lower(c)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        low = F.replace(low, F.lit(a), F.lit(b))
    return F.array_join(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), " ")


def mail_address(c: Column) -> Column:
    """The address of `Name <address>` or a bare address, its domain in lower case."""
    bare = F.trim(F.when(c.contains("<"), F.regexp_extract(c, r"<([^>]*)>", 1)).otherwise(c))
    return F.concat(F.substring_index(bare, "@", 1), F.lit("@"), F.lower(F.substring_index(bare, "@", -1)))


def display_name(c: Column) -> Column:
    """The name of `Name <address>`; null for a bare address."""
    return F.when(c.contains("<"), F.trim(F.substring_index(c, "<", 1)))


def preview(c: Column, size: int = 1024) -> Column:
    """The first characters of a text."""
    return F.left(c, F.lit(size))


def formula_guard(c: Column) -> Column:
    """A cell that spreadsheet programs won't take for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def stem(c: Column) -> Column:
    """A word without one of the endings ation, ion, ing, ed, s if four characters or more are left."""
    out = c
    for ending in ("s", "ed", "ing", "ion", "ation"):
        out = F.when(c.endswith(ending) & (F.length(c) >= len(ending) + 4), F.left(c, F.length(c) - len(ending))).otherwise(out)
    return out


def canonical_json(row: Column) -> Column:
    """A struct as JSON without spaces, nulls included. Its fields come in the struct's order, so a canonical form needs them sorted by name."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def relative_path(uri: Column, root: str) -> Column:
    """The path below `root` that a file URI names, percent signs decoded; null for other URIs and for paths that lead out of it."""
    prefix = f"file://{root.rstrip('/')}/"
    path = F.url_decode(F.replace(F.substring(uri, len(prefix) + 1, 1 << 20), F.lit("+"), F.lit("%2B")))
    return F.when(uri.startswith(prefix) & ~F.arrays_overlap(F.split(path, "/"), F.array(F.lit(".."), F.lit(""))), path)


def day_relation(day: Column, event: Column, required: Column | None = None) -> Column:
    """How a day stands to that of an event: same, before or after; unknown if one of them isn't known, not_required where none is asked for."""
    out = F.when(day.isNull() | event.isNull(), "unknown").when(day == event, "same").when(day < event, "before").otherwise("after")
    return out if required is None else F.when(~required, "not_required").otherwise(out)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


#: English and German patterns of what restricts or qualifies a statement, by category.
RISK_MARKERS = {
    "negation": r"\b(?:not|no|never|neither|without|nicht|kein\w*|ohne)\b",
    "condition": r"\b(?:if|unless|provided|subject to|wenn|sofern|falls)\b",
    "exception": r"\b(?:except|excluding|however|but|ausser|außer|jedoch)\b",
    "date": r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|before|after|until|deadline|bis|vor|nach)\b",
    "amount": r"(?:\b(?:chf|eur|usd)\s*\d[\d.,'’]*|[$€£]\s*\d[\d.,]*|\b\d+(?:[.,]\d+)?\s*%)",
    "scope": r"\b(?:only|all|each|any|solely|limited|must|shall|nur|alle|muss)\b",
}


def marker_counts(c: Column) -> list[Column]:
    """How often each category of risk marker occurs in a text."""
    low = F.lower(c)
    return [F.size(F.regexp_extract_all(low, F.lit(p), F.lit(0))).cast("bigint").alias(n) for n, p in RISK_MARKERS.items()]
