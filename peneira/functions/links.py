"""Link expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peneira.config import TRACKING_PARAM
from peneira.functions.once import let


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    return F.nullif(found, F.lit(""))


def canonical_url(url: Column) -> Column:
    """Link key: https, lower-case host, no fragment, tracking parameter or closing slash.

    Other parameters stay, in sorted order: some boards name the posting in one.
    """
    return let(F.regexp_replace(F.trim(url), "#.*$", ""), _key)


def _key(bare: Column) -> Column:
    site = F.lower(F.regexp_extract(bare, r"^[A-Za-z]+://([^/?]+)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]+([^?]*)", 1), "/+$", "")
    params = F.array_sort(
        F.filter(
            F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"),
            lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).rlike(TRACKING_PARAM),
        )
    )
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&")))
    return F.when(
        site != "", F.concat(F.lit("https://"), site, path, F.coalesce(query, F.lit("")))
    )
