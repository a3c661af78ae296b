"""Canonical forms of identifiers, checksums, hashes, addresses and split names.

All are Column expressions. NULL, blank and placeholder values become NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The SHA-256 digest of empty input, and the spellings of the three splits.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
TRIM = r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$"
SPLIT_SPELLINGS = {
    "train": "train",
    "training": "train",
    "val": "val",
    "valid": "val",
    "validation": "val",
    "dev": "val",
    "test": "test",
    "testing": "test",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    """Trimmed text; blank is NULL (both mean "missing" in the curation tables)."""
    return let(F.regexp_replace(c, TRIM, ""), lambda t: F.when(t != "", t))


def ident(c: Column) -> Column:
    """Identifier, trimmed and lower case; blank is NULL."""
    return let(F.lower(F.regexp_replace(c, TRIM, "")), lambda t: F.when(t != "", t))


def hex64(c: Column) -> Column:
    """64 hex digits in lower case, or NULL; one digit repeated is a placeholder."""
    return let(
        F.lower(F.regexp_replace(c, r"[\s\u00a0]+", "")),
        lambda t: F.when((F.length(t) == 64) & t.rlike(r"^[0-9a-f]{64}$") & ~t.rlike(r"^(.)\1{63}$"), t),
    )


def sha256_digest(c: Column) -> Column:
    """A SHA-256 digest however written (prefix, case, blanks), or NULL."""
    return let(
        hex64(F.regexp_replace(c, r"(?i)^\s*sha-?_?256\s*[:=_-]?|^\s*0x", "")),
        lambda t: F.when(t != EMPTY_SHA256, t),
    )


def split_name(c: Column) -> Column:
    """train, val or test for any known spelling; otherwise NULL (unassigned)."""
    names = F.create_map(*[F.lit(x) for pair in SPLIT_SPELLINGS.items() for x in pair])
    return F.try_element_at(names, F.regexp_replace(F.lower(c), r"[^a-z]", ""))


def _unescape(c: Column) -> Column:
    """Percent-escapes undone (a plus stays a plus); malformed escapes leave the text as it is."""
    return F.when(
        c.contains("%"), F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)
    ).otherwise(c)


def doi(c: Column) -> Column:
    """A DOI from its `10.` on: lower case, unescaped, no closing full stop; else NULL."""
    raw = let(F.regexp_replace(c, TRIM, ""), _unescape)
    found = F.regexp_extract(F.lower(raw), r"(10\.[0-9.]+/\S+)", 1)
    return let(F.regexp_replace(found, r"[.\s]+$", ""), lambda t: F.when(t != "", t))


def _host(address: Column) -> Column:
    """Host of an address without its scheme, in lower case; blank if there is none."""
    t = F.regexp_extract(address, r"^(?:[^@/?#]*@)?(?:www\.)?([^/?#:]*)", 1)
    port = F.regexp_extract(address, r"^[^/?#]*(:\d+)(?:[/?#]|$)", 1)
    return F.concat(t, F.when(port.isin(":80", ":443"), "").otherwise(port))


def _bare(c: Column) -> Column:
    """Trimmed address without scheme and fragment."""
    return F.regexp_replace(c, r"^[\s\u00a0]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//|#.*$|^[\s\u00a0]+|[\s\u00a0]+$", "")


def url_host(c: Column) -> Column:
    """Host of an address: lower case, no user, `www.` or default port; NULL if there is none."""
    return let(_host(F.lower(_bare(c))), lambda h: F.when(h != "", h))


def url_resource(c: Column) -> Column:
    """Canonical form of an address that names the same resource, NULL for blanks.

    Scheme, `www.`, host case, default port, escapes, closing slash, fragment,
    order of the query and the parameters `utm_*` and `sessionid` do not count.
    """

    def parts(t: Column) -> Column:
        path = F.regexp_extract(t, r"^[^/?]*([^?]*)", 1)
        query = F.filter(
            F.split(F.regexp_extract(t, r"\?(.*)$", 1), "&"),
            lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[^=]*|sessionid)(=|$)"),
        )
        return F.concat(
            _host(F.lower(F.regexp_extract(t, r"^([^/?]*)", 1))),
            F.regexp_replace(let(path, _unescape), r"/+$", ""),
            F.lit("?"),
            F.array_join(F.array_sort(F.transform(query, _unescape)), "&"),
        )

    return let(_bare(c), lambda t: F.when(t != "", parts(t)))
