"""Origins and link resolution as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme, //authority, path, query, fragment
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(url, _URL, index)


def _tidy(url: Column) -> Column:
    """Drop leading blanks and control characters, and tabs and line breaks anywhere."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def page_origin(url: Column) -> Column:
    """``scheme://host`` of a page."""
    tidy = _tidy(url)
    return F.concat(F.lower(_part(tidy, 1)), F.lit("://"), F.substring(_part(tidy, 2), 3, 1 << 30))


def _remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda stack, segment: F.when(segment == ".", stack)
        .when(segment == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
        .otherwise(F.concat(stack, F.array(segment))),
    )
    ends_in_dots = path.rlike(r"/\.\.?$")
    joined = F.array_join(F.when(ends_in_dots, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    rooted = F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(path.rlike(r"/\.\.?(/|$)"), rooted).otherwise(path)


def _resolve(scheme: Column, authority: Column, base_path: Column, base_query: Column, href: Column) -> Column:
    url = _tidy(href)
    own_scheme, own_authority = F.lower(_part(url, 1)), _part(url, 2)
    path, query, fragment = _part(url, 3), _part(url, 4), _part(url, 5)
    # An empty parameter part leaves no trace.
    path = F.when(F.endswith(path, F.lit(";")), F.regexp_replace(path, r"^(|.*/)([^;/]*);$", "$1$2")).otherwise(path)

    folder = F.when(base_path == "", "/").otherwise(F.regexp_extract(base_path, r"^(.*/)", 1))
    absolute = F.when(F.startswith(path, F.lit("/")), path).otherwise(
        F.regexp_replace(F.concat(folder, path), "/{2,}", "/")
    )
    has_authority = F.length(own_authority) > 2
    same_page = ~has_authority & (path == "")
    full_path = F.when(has_authority, path).when(same_page, base_path).otherwise(_remove_dots(absolute))
    full_query = F.when(same_page & (query == ""), base_query).otherwise(query)
    joined = F.concat(
        scheme,
        F.lit(":"),
        F.when(has_authority, own_authority).otherwise(authority),
        full_path,
        F.when(full_query != "", F.concat(F.lit("?"), full_query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
    return F.when((own_scheme != "") & (own_scheme != scheme), href).otherwise(joined)


def resolve_on_origin(page_url: Column, href: Column) -> Column:
    """Absolute link, with relative paths taken from the site root."""
    page = _tidy(page_url)
    return _resolve(F.lower(_part(page, 1)), _part(page, 2), F.lit(""), F.lit(""), href)


def resolve_on_page(page_url: Column, href: Column) -> Column:
    """Absolute link, with relative paths taken from the page's folder."""
    page = _tidy(page_url)
    return _resolve(F.lower(_part(page, 1)), _part(page, 2), _part(page, 3), _part(page, 4), href)


def base_of_page(page_url: Column, base_href: Column) -> Column:
    """What relative links of a page are taken from: its ``<base>``, resolved on the page, else the page itself.

    As in browsers, a null base and one of scheme ``data`` or ``javascript`` do not count.
    """
    usable = base_href.isNotNull() & ~F.lower(_part(_tidy(base_href), 1)).isin("data", "javascript")
    return F.when(usable, resolve_on_page(page_url, base_href)).otherwise(page_url)
