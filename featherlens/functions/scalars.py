"""Scalar functions of identifiers, labels and text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keyword buckets of pathway names, in order of precedence.
PATHWAY_KEYWORDS = {
    "cell_cycle": ("cell cycle", "mitotic", "mitosis", "checkpoint", "DNA replication"),
    "metabolism": ("metabolic", "glycolysis", "TCA cycle", "fatty acid", "lipid"),
    "signaling": ("signaling", "receptor", "kinase", "MAPK", "PI3K", "Wnt"),
    "immune": ("immune", "inflammatory", "cytokine", "T cell", "B cell"),
    "apoptosis": ("apoptosis", "cell death", "caspase", "BCL2"),
    "transcription": ("transcription", "RNA polymerase", "chromatin", "histone"),
}
NUMBER = r"[-+]?\d+(?:\.\d+)?"


def normalize_id(s: Column, prefix: str = "TCGA", length: int = 15) -> Column:
    """Dots to dashes; ids with the prefix are cut to length."""
    d = F.regexp_replace(s, r"\.", "-")
    return F.when(d.startswith(prefix), F.substring(d, 1, length)).otherwise(d)


def strip_suffix(s: Column, suffixes: list[str]) -> Column:
    return F.regexp_replace(s, "(" + "|".join(suffixes) + ")$", "")


def first_token(s: Column, prefixes: list[str], sep: str = "_") -> Column:
    """The first token that begins with one of the prefixes, or NULL."""
    return F.try_element_at(F.filter(F.split(s, sep), lambda t: t.rlike("^(" + "|".join(prefixes) + ")")), F.lit(1))


def stable_seed(*parts: Column) -> Column:
    """The first 32 bits of the MD5 of parts joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def stable_u64(*parts: Column) -> Column:
    """The first eight bytes of the SHA-256, little-endian, as a decimal."""
    h = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]), 16, 10).cast("decimal(20,0)")


def selection_hash(features: Column) -> Column:
    """SHA-1 of a sorted list joined by commas."""
    return F.sha1(F.array_join(F.array_sort(features), ","))


def category(name: Column, buckets: dict[str, tuple[str, ...]] = PATHWAY_KEYWORDS, other: str = "other") -> Column:
    """The first bucket with a keyword in the name, whatever the case of either."""
    out, low = F.lit(other), F.lower(name)
    for bucket, words in reversed(buckets.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        out = F.when(hit, bucket).otherwise(out)
    return out


def fraction(s: Column) -> tuple[Column, Column]:
    """(n, d) of the first 'n/d' in s."""
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(s, r"(\d+)\s*/\s*(\d+)", i), F.lit("")), F.lit("999999999")).cast("long")
    return part(1), part(2)


def numbers(s: Column) -> Column:
    """All numbers in s, as doubles."""
    return F.transform(F.regexp_extract_all(s, F.lit(f"({NUMBER})"), F.lit(1)), lambda t: t.cast("double"))


def distinct_citations(s: Column, word: str) -> Column:
    """Sorted distinct numbers that follow word."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(rf"(?i){word}\s*(\d+)"), F.lit(1)), lambda t: t.cast("int"))))


def format_cell(x: Column) -> Column:
    """Four decimals under one in size, else two."""
    return F.when(F.abs(x) < 1, F.format_string("%.4f", x)).otherwise(F.format_string("%.2f", x))


def within(a: Column, b: Column, tol: float) -> Column:
    return F.coalesce(F.abs(a - b) <= tol, F.lit(False))


def safe_double(s: Column) -> Column:
    return s.try_cast("double")
