"""URL predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from doclake.functions import fixed as X

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_FILE_PATTERN = r"\.(" + "|".join(e[1:] for e in X.FILE_LINK_EXTENSIONS) + r")$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_host(url) -> Column:
    """Network location of a URL, with port and user when it has them; '' when it has none."""
    return F.regexp_extract(_col(url), _SCHEME + r"//([^/?#]*)", 1)


def url_scheme(url) -> Column:
    return F.lower(F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_path(url) -> Column:
    """Path of a URL without the parameters of its last segment."""
    path = F.regexp_extract(_col(url), _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, ";[^/]*$", "")


def without_fragment(url) -> Column:
    """What a server is asked for: the URL up to its fragment."""
    return F.substring_index(_col(url), "#", 1)


def is_file_url(url) -> Column:
    return F.lower(url_path(url)).rlike(_FILE_PATTERN)


def is_page_url(url) -> Column:
    """An http(s) URL that does not name a file."""
    return url_scheme(url).isin("http", "https") & ~is_file_url(url)


def is_valid_url(url, allowed_domains) -> Column:
    """A page URL on one of the allowed hosts (a list, or an array column)."""
    host = url_host(url)
    if isinstance(allowed_domains, Column):
        allowed = F.array_contains(allowed_domains, host)
    else:
        allowed = host.isin(list(allowed_domains))
    return is_page_url(url) & allowed
