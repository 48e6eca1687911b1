"""Addresses: canonical form, validity, identifiers, relative links."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.config import SITE, Site
from docloom.functions.text import strip

# RFC 3986, appendix B.
_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; "" where absent."""
    return F.regexp_extract(url, _PARTS, k)


def canonical(url: Column) -> Column:
    """scheme://authority/path?query: no fragment, no parameters of the last segment, no empty query, lower-case scheme."""
    query = part(url, 4)
    return F.concat(F.lower(part(url, 1)), F.lit("://"), part(url, 2), F.regexp_replace(part(url, 3), r";[^/]*$", ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def canonical_stripped(url: Column) -> Column:
    return canonical(strip(url))


def is_internal(url: Column, site: Site = SITE) -> Column:
    """On the site's host, in its section, under no excluded prefix."""
    path = F.lower(part(url, 3))
    ok = F.lower(part(url, 2)).isin(site.domain, f"www.{site.domain}") & path.contains(site.section)
    for prefix in (*site.language_prefixes, *site.excluded_prefixes):
        ok = ok & ~path.startswith(prefix.lower())
    return F.coalesce(ok, F.lit(False))


def is_pdf(url: Column) -> Column:
    return F.lower(url).endswith(".pdf")


def uid(url: Column, extra: Column | str = "") -> Column:
    """First 12 hex digits of SHA-1 of the address and a suffix."""
    return F.left(F.sha1(F.concat(url, F.lit(extra) if isinstance(extra, str) else extra)), F.lit(12))


def is_html(content_type: Column, site: Site = SITE) -> Column:
    low = F.lower(F.coalesce(content_type, F.lit("")))
    ok = F.lit(False)
    for t in site.content_types:
        ok = ok | low.contains(t)
    return ok


@F.pandas_udf(StringType())
def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    """Reference resolution of `link` against `base`; null if either is null or can't be parsed."""
    from urllib.parse import urljoin

    def one(b: str | None, x: str | None) -> str | None:
        try:
            return None if b is None or x is None else urljoin(b, x)
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype="object")
