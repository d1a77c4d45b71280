"""URL expressions. No Python runs per row, and malformed URLs give a value, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardwalk.functions.binding import let

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"(?s)^[^?#]*\?([^#]*)"
_FRAGMENT = r"(?s)#(.*)$"
_PLAIN_ROOT_PATH = r"^/[^/?#\s\x00-\x20][^?#\s\x00-\x20]*$"


def _tidy(url: Column) -> Column:
    return F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def host(url: Column) -> Column:
    """Authority part as written: case, port and user info are kept; '' when there is none."""
    return F.regexp_extract(_tidy(url), _AUTHORITY, 1)


def origin(url: Column) -> Column:
    """scheme://authority"""
    return F.concat(scheme(_tidy(url)), F.lit("://"), host(url))


def normalize(url: Column) -> Column:
    """Cut at the first '?', then drop trailing slashes; a fragment stays."""
    return F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")


def same_page(url: Column, page_url: Column) -> Column:
    return normalize(url) == normalize(page_url)


def is_http(url: Column) -> Column:
    return F.startswith(url, F.lit("http"))


def slash_count(url: Column) -> Column:
    return F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))


def _without_dots(path: Column, rooted: Column) -> Column:
    """Resolve '.' and '..'; steps above the root are ignored. A path that was merged with the
    base path also loses its empty inner segments."""

    def walk(parts: Column) -> Column:
        size = F.size(parts)
        kept = F.filter(parts, lambda s, i: rooted | (s != "") | (i == 0) | (i == size - 1))
        walked = F.aggregate(
            kept,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(
                s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
            )
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        ending = F.when(F.get(parts, size - 1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return F.array_join(F.concat(walked, ending), "/")

    return let(
        let(F.split(path, "/", -1), walk),
        lambda p: F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p)),
    )


def _parts(url: Column) -> Column:
    return let(
        _tidy(url),
        lambda u: F.struct(
            scheme(u).alias("scheme"),
            F.regexp_extract(u, _AUTHORITY, 1).alias("authority"),
            F.regexp_extract(u, _PATH, 1).alias("path"),
            F.regexp_extract(u, _QUERY, 1).alias("query"),
            F.regexp_extract(u, _FRAGMENT, 1).alias("fragment"),
        ),
    )


def _join(href: Column, ref: Column, base: Column) -> Column:
    """Reference resolution on the parts of both URLs."""

    def glue(authority: Column, path: Column, query: Column) -> Column:
        return F.concat(
            base["scheme"], F.lit("://"), authority, path,
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
            F.when(ref["fragment"] != "", F.concat(F.lit("#"), ref["fragment"]))
            .otherwise(F.lit("")),
        )

    own_path = F.when(
        (base["path"] != "") & ~F.startswith(base["path"], F.lit("/")),
        F.concat(F.lit("/"), base["path"]),
    ).otherwise(base["path"])
    rooted = F.startswith(ref["path"], F.lit("/"))
    merged = (
        F.when(rooted, ref["path"])
        .when(base["path"] == "", F.concat(F.lit("/"), ref["path"]))
        .otherwise(F.concat(F.regexp_replace(base["path"], "[^/]*$", ""), ref["path"]))
    )
    return (
        F.when((ref["scheme"] != "") & (ref["scheme"] != base["scheme"]), href)
        .when(ref["authority"] != "", glue(ref["authority"], ref["path"], ref["query"]))
        .when(
            ref["path"] == "",
            glue(
                base["authority"], own_path,
                F.when(ref["query"] != "", ref["query"]).otherwise(base["query"]),
            ),
        )
        .otherwise(glue(base["authority"], let(merged, lambda p: _without_dots(p, rooted)), ref["query"]))
    )


def resolve(href: Column, page_url: Column) -> Column:
    """Join a link target with the URL of its page (RFC 3986 reference resolution).

    Empty stays empty, and a target with another scheme stays as written. The common case, a
    root-relative path with nothing to resolve, is decided by one pattern.
    """
    return (
        F.when(href == "", href)
        .when(
            href.rlike(_PLAIN_ROOT_PATH) & ~F.contains(href, F.lit("/.")),
            F.concat(origin(page_url), href),
        )
        .otherwise(
            let(_parts(href), lambda ref: let(_parts(page_url), lambda base: _join(href, ref, base)))
        )
    )


def resolve_in_frame(href: Column, frame_url: Column) -> Column:
    """Frame variant: text concatenation only, the query string of the frame is not removed."""
    return (
        F.when(F.startswith(href, F.lit("http")), href)
        .when(F.startswith(href, F.lit("/")), F.concat(origin(frame_url), href))
        .otherwise(F.concat(F.regexp_replace(frame_url, "(?s)/[^/]*$", ""), F.lit("/"), href))
    )
