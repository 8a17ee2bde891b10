"""Addresses of posts: one form, kind and identity, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ["trk", "trackingid", "trkinfo", "lipi", "licu", "midtoken", "midsig", "tracking_id", "ref", "referrer", "originalsubdomain", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "vero_id", "vero_conv"]


def canonical_url(c: Column) -> Column:
    """Lower-case host without port and user, single slashes, no trailing slash or fragment, no tracking, sorted parameters; null if not http."""
    t = F.trim(c)
    bare = F.regexp_replace(t, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(bare, r"^[^:]+://([^/?]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    path = F.regexp_extract(bare, r"^[^:]+://[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING))
    kept = F.array_join(F.array_sort(pairs), "&")
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, path, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept))))


def url_kind(c: Column) -> Column:
    """The kind of place an address names, by its first path segment."""
    first = F.regexp_extract(canonical_url(c), r"^[^:]+://[^/?]*/([^/?]*)", 1)
    return F.when(canonical_url(c).isNull(), "none").when(first.isin("p", "post", "posts"), "post").when(first.isin("pulse", "articles", "article"), "article").when(first == "", "site").otherwise("other")


def source_id(c: Column) -> Column:
    """A short digest of the one form of an address."""
    return F.concat(F.lit("urn:saved:"), F.substring(F.sha2(canonical_url(c), 256), 1, 16))
