"""URL functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood import config

#: URLs that columns canonicalise: an ASCII host, perhaps with a user and a port, any path and query whose escapes are whole. IPv6 hosts, other hosts,
#: control characters and broken escapes go through urllib.
_PLAIN = r"^[ \t\r\n]*(?:[Hh][Tt][Tt][Pp][Ss]?:)?//(?:[!-~&&[^/?#@\[\]\\%]]*@)?[A-Za-z0-9._-]+(?::[0-9]{0,5})?(?:[/?#](?:[^%\x00-\x1f\x7f]|%[0-9A-Fa-f]{2})*)?[ \t\r\n]*$"


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.lit(""))


def _quoted(c: Column, safe: str, space: str) -> Column:
    """Percent escapes of all but letters, digits, _ . - ~ and `safe`."""
    out = F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit(space)), F.lit("*"), F.lit("%2A"))
    for char in "~" + safe:
        out = F.replace(out, F.lit(f"%{ord(char):02X}"), F.lit(char))
    return out


def _plain(url: Column) -> Column:
    u = F.regexp_replace(url, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    u = F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).otherwise(u)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z]+):", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z]+://(?:[^/?#]*@)?([^/?#:]*)", 1)), r"\.+$", "")
    host = F.regexp_replace(host, r"^m\.", "www.")
    port = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1).try_cast("int")
    shown = port.isNotNull() & (port > 0) & (port != F.when(scheme == "http", 80).otherwise(443))
    path = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(_quoted(_decoded(F.replace(path, F.lit("+"), F.lit("%2B"))), "/:@!$&'()*+,;=", "%20"), "/+$", "")
    pairs = F.transform(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).alias("v")))
    kept = F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).rlike("^utm_|^(" + "|".join(config.TRACKING_KEYS) + ")$"))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_quoted(p["k"], "", "+"), F.lit("="), _quoted(p["v"], "", "+"))), "&")
    known = (host != "") & (F.coalesce(port, F.lit(0)) <= 65535)
    return F.when(~known, F.lit("")).otherwise(F.concat(scheme, F.lit("://"), host, F.when(shown, F.concat(F.lit(":"), port.cast("string"))).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def canonical(raw: str | None) -> str:
    """The canonical form of any URL, or "" where it has none."""
    from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit

    text = (raw or "").strip()
    try:
        u = urlsplit("https:" + text if text.startswith("//") else text)
        host, port = (u.hostname or "").lower().rstrip("."), u.port
    except ValueError:
        return ""
    scheme = u.scheme.lower()
    if scheme not in ("http", "https") or not u.hostname:
        return ""
    if host[:2] == "m.":
        host = "www." + host[2:]
    if port and port != {"http": 80, "https": 443}[scheme]:
        host += f":{port}"
    pairs = [(k, v) for k, v in parse_qsl(u.query) if k.lower() not in config.TRACKING_KEYS and not k.lower().startswith("utm_")]
    query = urlencode(sorted(pairs), doseq=True)
    path = quote(unquote(u.path), safe="/:@-._~!$&'()*+,;=").rstrip("/")
    return f"{scheme}://{host}{path}" + (f"?{query}" if query else "")


@F.pandas_udf(T.StringType())
def _canonical_udf(urls: pd.Series) -> pd.Series:
    return urls.map(lambda x: None if x is None else canonical(x))


def canonical_url(url: Column) -> Column:
    """Canonical URLs of any form, "" where there is none. Columns do it but for odd hosts and broken escapes, which go through urllib in Arrow batches."""
    u = F.coalesce(url, F.lit(""))
    plain = u.rlike(_PLAIN)
    return F.coalesce(F.when(plain, _plain(u)), _canonical_udf(F.when(~plain & (u != ""), u)), F.lit(""))


def domain_key(canonical_col: Column) -> Column:
    """The host (with a port) of a canonical URL, without a leading www. and m."""
    host = F.lower(F.regexp_extract(canonical_col, r"^[A-Za-z]+://([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^m\.", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]{1,8})$", 1))


def valid_image_url(url: Column) -> Column:
    u = F.trim(F.coalesce(url, F.lit("")))
    path = F.lower(F.coalesce(F.try_url_decode(F.replace(F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), F.lit("+"), F.lit("%2B"))), F.lit("")))
    query = F.lower(F.regexp_extract(u, r"\?([^#]*)", 1))
    noisy = F.exists(F.array(*[F.lit(t) for t in config.IGNORED_IMAGE_TOKENS]), lambda t: F.contains(path, t) | F.contains(query, t))
    ext = extension(path)
    return u.rlike("^https?://") & ~noisy & ((ext == "") | ext.isin(config.IMAGE_EXTENSIONS))


def merge_images(first: Column, second: Column, limit: int) -> Column:
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(first, none), F.coalesce(second, none))
    return F.slice(F.array_distinct(F.filter(F.transform(both, F.trim), valid_image_url)), 1, limit)
