"""Text clean-up: missing tokens, stripping, title case, digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlens.schema import NA_TOKENS


def na_to_null(col: Column) -> Column:
    """Null for the texts a CSV reader takes as missing."""
    return F.when(~col.isin(*NA_TOKENS), col)


# Every character that counts as white space.
_WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_space(col: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` alone knows only the blank)."""
    return F.trim(col, F.lit(_WHITE))


# Letters with an upper and a lower case; others (Chinese, Arabic) count as gaps between words.
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def title_case(col: Column) -> Column:
    """Upper-case every cased letter that follows something else, lower-case the others.

    ``initcap`` starts a word only after a blank, so text with a letter after another kind of
    non-letter ("web2go", "o'neil") is cut into letter runs first. Other text takes the short way.
    """
    low = F.lower(col)
    runs = F.regexp_extract_all(low, F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    by_run = F.array_join(F.transform(runs, F.initcap), "")
    return F.when(low.rlike(f"[^{_CASED} ][{_CASED}]"), by_run).otherwise(F.initcap(low))


def canonical_channel(col: Column) -> Column:
    """Stripped, title-cased channel name; a missing name becomes the channel ``Nan``."""
    return title_case(strip_space(F.coalesce(na_to_null(col), F.lit("nan"))))
