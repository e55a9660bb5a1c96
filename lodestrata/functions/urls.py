"""URL expressions; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def hostname(url: Column) -> Column:
    """Lower-case host without user, port or trailing dots; null where there is none."""
    authority = F.regexp_replace(F.lower(_part(url, 2)), r"^.*@", "")
    host = F.regexp_replace(F.regexp_replace(authority, r":[0-9]*$", ""), r"\.+$", "")
    return F.when(host != "", host)


def resolve(url: Column, base: Column) -> Column:
    """``url`` against ``base``: absolute ones stay, ``//host``, ``/path``, ``#fragment`` and plain relative ones are joined."""
    u = F.trim(url)
    root = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(F.when(_part(base, 3) == "", F.lit("/")).otherwise(_part(base, 3)), r"[^/]*$", "")
    own, rest = F.regexp_extract(u, r"^([^?#]*)", 1), F.regexp_extract(u, r"^[^?#]*(.*)$", 1)
    return (
        F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), u)
        .when(u.startswith("//"), F.concat(_part(base, 1), F.lit(":"), u))
        .when(u.startswith("/"), F.concat(root, without_dots(own), rest))
        .when(u.startswith("#") | (u == ""), F.concat(F.regexp_replace(base, r"#.*$", ""), u))
        .when(u.startswith("?"), F.concat(root, _part(base, 3), u))
        .otherwise(F.concat(root, without_dots(F.concat(folder, own)), rest))
    )


def without_dots(path: Column) -> Column:
    """A path from the root without the segments ``.`` and ``..``, which leave out the segment before; a path without dots is left alone."""
    none = F.array().cast("array<string>")
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(x)))
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")).otherwise(path)


def normalize_url(url: Column) -> Column:
    """Canonical form of an absolute http(s) URL; null where it is none, holds credentials, or has an invalid port.

    Scheme and host in lower case, no default port, single slashes in the path, none at its end, no fragment; the query stays.
    """
    u = F.trim(url)
    scheme, authority, path, query = F.lower(_part(u, 1)), F.lower(_part(u, 2)), _part(u, 3), _part(u, 4)
    port = F.regexp_extract(authority, r":([0-9]*)$", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r":[0-9]*$", ""), r"\.+$", "")
    number = F.when(F.length(port) <= 9, port.try_cast("int")).otherwise(F.lit(0))
    default = ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    single = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "/{2,}", "/")
    clean = F.when(single == "/", single).otherwise(F.regexp_replace(single, "/+$", ""))
    valid = scheme.isin("http", "https") & (host != "") & ~authority.contains("@") & ~host.rlike(r"\s") & ((port == "") | number.between(1, 65535))
    netloc = F.when((port == "") | default, host).otherwise(F.concat(host, F.lit(":"), number.cast("string")))
    return F.when(valid, F.concat(scheme, F.lit("://"), netloc, clean, F.when(query == "?", F.lit("")).otherwise(query)))


def canonical_source(url: Column) -> Column:
    """The URL by which mirrored sources are matched: lower-case scheme and authority, no query, fragment or final slash."""
    return F.when(url.rlike(_PARTS), F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), F.regexp_replace(_part(url, 3), "/+$", "")))


def is_private_host(host: Column) -> Column:
    """Local names and address literals outside the global ranges."""
    h = F.regexp_replace(F.lower(host), r"\.+$", "")
    private4 = r"^(?:0|10|127)\.\d+\.\d+\.\d+$|^(?:169\.254|192\.168|198\.1[89])\.\d+\.\d+$|^172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+$|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.\d+\.\d+$|^(?:22[4-9]|2[3-5]\d)\.\d+\.\d+\.\d+$|^192\.0\.[02]\.\d+$|^198\.51\.100\.\d+$|^203\.0\.113\.\d+$"
    return (h == "localhost") | h.endswith(".localhost") | (h == "localhost.localdomain") | h.rlike(private4) | h.rlike(r"^\[?(?:::1?|f[cd][0-9a-f:]*|fe[89ab][0-9a-f]?:[0-9a-f:]*)\]?$")


def source_type(url: Column) -> Column:
    """What kind of source a URL points to, by its host. The hosts are fixed values."""
    host = F.coalesce(hostname(url), F.lit(""))
    return (
        F.when(host.endswith(".gov"), "GOVERNMENT")
        .when(host.isin("github.com", "gitlab.com"), "REPOSITORY")
        .when(host.isin("arxiv.org", "pubmed.ncbi.nlm.nih.gov"), "PRIMARY_RESEARCH")
        .when(host.startswith("docs.") | url.contains("/docs/"), "OFFICIAL_DOCUMENTATION")
        .otherwise("UNKNOWN")
    )
