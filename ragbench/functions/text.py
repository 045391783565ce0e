"""Text normalisation as column expressions, each with the DuckDB text that says the same."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Portuguese articles, dropped from normalised tokens.
PT_ARTICLES = ("o", "a", "os", "as", "um", "uma", "uns", "umas")


def _plain_letters() -> tuple[str, str]:
    """Latin letters whose decomposition is one ASCII letter and marks, and those letters."""
    pairs = []
    for code in range(0xC0, 0x250):
        parts = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0].isascii():
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _plain_letters()


def strip_accents(text: Column) -> Column:
    """Accents dropped from precomposed Latin letters and from decomposed ones."""
    return F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{Mn}+", "")


def fold(text: Column) -> Column:
    """Lower case without accents, for comparing spellings."""
    return strip_accents(F.lower(text))


def one_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def name_key(text: Column) -> Column:
    """Lower case, single spaces."""
    return F.lower(one_space(text))


def normal_words(text: Column) -> Column:
    """Lower case; everything but letters and digits becomes single spaces."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def normal_words_sql(text: str) -> str:
    return rf"trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def words(text: Column) -> Column:
    """Lower-case tokens between white space."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")


def words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '\s+'), lambda t: t <> '')"


def pt_tokens(text: Column) -> Column:
    """Lower case, punctuation and symbols out, Portuguese articles dropped."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}]", " "), r"(?U)\s+"), lambda t: (t != "") & ~t.isin(*PT_ARTICLES))


def pt_tokens_sql(text: str) -> str:
    articles = ", ".join(f"'{a}'" for a in PT_ARTICLES)
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[\p{{P}}\p{{S}}]', ' ', 'g'), '\s+'), lambda t: t <> '' AND t NOT IN ({articles}))"


def split_list(cell: Column, separator: str = r"\|") -> Column:
    """Trimmed non-empty items of a separated cell; null counts as empty."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), separator, -1), F.btrim), lambda x: x != "")
