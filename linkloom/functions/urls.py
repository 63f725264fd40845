"""URL expressions, evaluated in the JVM.

Special schemes (http, https) follow the browser rules that matter for
comparing links: lower-cased scheme and host, default port dropped, dot
segments resolved, path characters percent-encoded. Internationalised host
names are lower-cased, not converted to punycode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.let import let

# --- fixed values -----------------------------------------------------------
LANGUAGE_PREFIX = "^/[a-z]{2}(?=/)"
# ----------------------------------------------------------------------------

_ANY_SCHEME = r"(?i)\A[a-z][a-z0-9+.\-]*:"
_WEB = r"(?i)\Ahttps?:"
_ROOT = r"(?i)\A(https?):[/\\]*([^/\\?#]*)"
_UNSAFE = r"[^!-~]|[\"<>`{}]"
_DOTS = r"(?i)/(\.|%2e){1,2}(/|$)"
_LAST_DOTS = r"(?i)/(\.|%2e){1,2}$"
# Paths that stay as they are: nothing to encode, no dot segments, no empty ones.
_PLAIN_SEGMENT = r"[A-Za-z0-9_~\-][A-Za-z0-9_~.\-]*"
_PLAIN_FOLDER = rf"\A/({_PLAIN_SEGMENT}/)*\z"
_PLAIN_LINK = rf"(?s)\A(\.\./|/)?({_PLAIN_SEGMENT}/)*({_PLAIN_SEGMENT}/?)([?#].*)?\z"


def _clean(raw: Column) -> Column:
    """Outer control characters and spaces, and inner tabs and line ends, go."""
    trimmed = F.trim(raw, F.lit("".join(map(chr, range(33)))))
    return F.translate(trimmed, "\t\r\n", "")


def _authority(url: Column) -> Column:
    """host[:port] of a clean http(s) URL, lower-cased, user info dropped."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, _ROOT, 2), "^.*@", ""))


def _host(authority: Column) -> Column:
    return F.regexp_replace(authority, ":[0-9]*$", "")


def _valid_authority(authority: Column) -> Column:
    return authority.rlike(r"\A(\[[0-9a-f:.]+\]|[^\x00-\x20#/:<>?@\[\\\]^|%]+)(:[0-9]{0,5})?\z")


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), r"(?i)\A([a-z][a-z0-9+.\-]*):", 1))


def host_of(url: Column) -> Column:
    """Lower-cased host of an http(s) URL, else empty."""
    return _host(_authority(_clean(url)))


def is_url(raw: Column) -> Column:
    """Whether the text parses as an absolute URL."""
    return F.coalesce(
        let(
            _clean(raw),
            lambda u: F.when(u.rlike(_WEB), _valid_authority(_authority(u))).otherwise(
                u.rlike(_ANY_SCHEME)
            ),
        ),
        F.lit(False),
    )


def _origin(url: Column) -> Column:
    """scheme://host[:port] of a clean URL, the default port dropped."""
    return let(
        F.struct(
            F.lower(F.regexp_extract(url, _ROOT, 1)).alias("scheme"), _authority(url).alias("at")
        ),
        lambda p: F.concat(
            p["scheme"],
            F.lit("://"),
            F.when(
                p["scheme"] == "http", F.regexp_replace(p["at"], r":(0*80)?$", "")
            ).otherwise(F.regexp_replace(p["at"], r":(0*443)?$", "")),
        ),
    )


def _encode(path: Column) -> Column:
    """Percent-encode what a browser would; most paths need nothing."""

    def char(c: Column) -> Column:
        coded = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
        return F.when(c.rlike(_UNSAFE), coded).otherwise(c)

    chars = F.regexp_extract_all(path, F.lit("(?s)."), F.lit(0))
    return F.when(path.rlike(_UNSAFE), F.array_join(F.transform(chars, char), "")).otherwise(path)


def _resolve_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments from an absolute path."""

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(
                F.lower(segment).isin("..", "%2e%2e", ".%2e", "%2e."),
                F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))),
            )
            .when(F.lower(segment).isin(".", "%2e"), kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    resolved = let(
        F.aggregate(
            let(F.split(path, "/"), lambda parts: F.slice(parts, F.lit(2), F.size(parts))),
            F.array().cast("array<string>"),
            step,
        ),
        lambda kept: F.concat(
            F.lit("/"),
            F.array_join(kept, "/"),
            F.when(path.rlike(_LAST_DOTS) & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")),
        ),
    )
    return F.when(path.rlike(_DOTS), resolved).otherwise(path)


def _raw_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, _ROOT, ""), r"(?s)[?#].*$", "")


def _path(url: Column) -> Column:
    """Path of a clean http(s) URL: rooted, encoded, dots resolved."""
    return let(
        F.translate(_raw_path(url), "\\", "/"),
        lambda raw: let(
            _encode(F.when(raw == "", F.lit("/")).otherwise(raw)), _resolve_dots
        ),
    )


def path_of(url: Column) -> Column:
    return _path(_clean(url))


def base_parts(base: Column) -> Column:
    """What resolving a link needs to know about the page: computed once."""

    def parts(u: Column, origin: Column, path: Column, folder: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(u, r"(?i)\A(https?:)", 1)).alias("scheme"),
            origin.alias("origin"),
            path.alias("path"),
            folder.alias("folder"),
            F.when(folder == "/", folder)
            .otherwise(F.regexp_replace(folder, "[^/]*/$", ""))
            .alias("parent"),
            (
                u.rlike(_WEB) & _valid_authority(_authority(u)) & folder.rlike(_PLAIN_FOLDER)
            ).alias("plain"),
        )

    def with_folder(u: Column, path: Column) -> Column:
        last = F.regexp_replace(F.regexp_replace(path, "^/", ""), "[^/]*$", "")
        return let(
            F.struct(_origin(u).alias("origin"), F.concat(F.lit("/"), last).alias("folder")),
            lambda p: parts(u, p["origin"], path, p["folder"]),
        )

    return let(_clean(base), lambda u: let(_raw_path(u), lambda path: with_folder(u, path)))


def _absolute(link: Column, base: Column) -> Column:
    """A clean link that is no foreign URL, as an absolute http(s) URL string."""
    return (
        F.when(link.rlike(r"(?i)\Ahttps?:[/\\]"), link)
        .when(link.rlike(r"\A[/\\]{2}"), F.concat(base["scheme"], link))
        .when(link.rlike(r"\A[/\\]"), F.concat(base["origin"], link))
        .when((link == "") | link.rlike(r"\A[?#]"), F.concat(base["origin"], base["path"], link))
        .otherwise(F.concat(base["origin"], base["folder"], link))
    )


def _is_foreign(link: Column) -> Column:
    return link.rlike(_ANY_SCHEME) & ~link.rlike(_WEB)


def _trim_slash(path: Column) -> Column:
    return F.regexp_replace(path, "(?<=.)/$", "")


def _plain_key(href: Column, base: Column) -> Column:
    """``link_key`` of a relative link of plain segments: no need to resolve it step by step."""
    path = F.substring_index(F.substring_index(href, "?", 1), "#", 1)
    rooted = (
        F.when(href.startswith("../"), F.concat(base["parent"], F.substring(path, 4, 1 << 30)))
        .when(href.startswith("/"), path)
        .otherwise(F.concat(base["folder"], path))
    )
    return F.concat(
        base["origin"], F.regexp_replace(_trim_slash(rooted), LANGUAGE_PREFIX, "")
    )


def link_key(href: Column, base: Column) -> Column:
    """``normalize_link_url`` for a page whose ``base_parts`` are known."""

    def opaque(link: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(link, _ANY_SCHEME, ""), r"(?s)[?#].*$", "")
        return F.concat(F.lit("null"), rest)

    def web(url: Column) -> Column:
        path = F.regexp_replace(_trim_slash(_path(url)), LANGUAGE_PREFIX, "")
        return F.when(_valid_authority(_authority(url)), F.concat(_origin(url), path)).otherwise(
            href
        )

    stepwise = let(
        _clean(href),
        lambda link: F.when(_is_foreign(link), opaque(link)).otherwise(
            let(_absolute(link, base), web)
        ),
    )
    plain = base["plain"] & href.rlike(_PLAIN_LINK)
    return F.when(plain, _plain_key(href, base)).otherwise(stepwise)


def normalize_link_url(href: Column, base: Column) -> Column:
    """Key under which two links to the same article compare equal.

    Resolved against the page, query and fragment dropped, one trailing slash
    and a two-letter language prefix removed. Unparseable links stay as they
    are.
    """
    return let(base_parts(base), lambda b: link_key(href, b))


def normalize_link_urls(hrefs: Column, base: Column) -> Column:
    """The same for an array of links of one page."""
    return let(base_parts(base), lambda b: F.transform(hrefs, lambda h: link_key(h, b)))


def own_host(hrefs: Column, base: Column) -> Column:
    """For an array of links of an http(s) page: does each stay on its host?"""

    def stays(link: Column, b: Column) -> Column:
        resolved = let(_absolute(link, b), lambda u: _host(_authority(u)))
        return (
            F.when(link.rlike(r"\A/[^/\\]") | (link == "/"), F.lit(True))
            .when(_is_foreign(link), F.lit(False))
            .otherwise(resolved == _host(_authority(b["origin"])))
        )

    return let(
        base_parts(base), lambda b: F.transform(hrefs, lambda h: let(_clean(h), lambda x: stays(x, b)))
    )


def normalize_crawl_url(url: Column) -> Column:
    """Key for de-duplicating URLs to fetch: query and fragment are kept."""

    def web(u: Column) -> Column:
        tail = F.regexp_extract(F.regexp_replace(u, _ROOT, ""), r"(?s)([?#].*)$", 1)
        return F.when(
            u.rlike(_WEB) & _valid_authority(_authority(u)),
            F.concat(_origin(u), _trim_slash(_path(u)), tail),
        ).otherwise(url)

    return let(_clean(url), web)
