"""URL identity, hosts and scopes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that do not identify a page: fixed values.
TRACKING_PREFIX, TRACKING = "utm_", ("fbclid", "gclid", "msclkid")


def _prefixed(url: Column) -> Column:
    u = F.trim(url)
    return F.when(F.instr(u, "://") > 0, u).otherwise(F.concat(F.lit("https://"), u))


def _authority(u: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(u, r"^[^:]+://([^/?#]*)", 1), r"^.*@", "")


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, default port, user, fragment and tracking keys gone, parameters sorted.

    Blank parameter values stay; an empty path is ``/``; without a host the result is empty, as it is for null.
    """
    u = F.regexp_replace(_prefixed(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = _authority(u)
    host = F.regexp_replace(F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1)), r"\.+$", "")
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    port = F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_extract(u, r"^[^:]+://[^/?]*([^?]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    decode = lambda x: F.try_url_decode(F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25"))
    encode = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: p != "")
    pairs = F.transform(pairs, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(F.when(F.instr(p, "=") > 0, F.regexp_replace(p, r"^[^=]*=", "")).otherwise("")).alias("v")))
    kept = F.filter(pairs, lambda p: ~(F.startswith(F.lower(p["k"]), F.lit(TRACKING_PREFIX)) | F.lower(p["k"]).isin(*TRACKING)))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.isNull() | (scheme == "") | (host == ""), "").otherwise(whole)


def normalize_host(value: Column) -> Column:
    """Bare host without scheme, user, port, ``www.`` and dots at the end; null if there is none."""
    host = F.lower(F.regexp_extract(_authority(_prefixed(value)), r"^(\[[^\]]*\]|[^:]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    return F.nullif(host, F.lit(""))


def domain_chain(host: Column) -> Column:
    """The host and its parent domains of two labels or more; empty for single labels and null."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    chain = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), "."))
    return F.when(host.isNull() | (n < 2), F.array().cast("array<string>")).otherwise(chain)


def without_fragment(capture_url: Column, seed_url: Column) -> Column:
    """Capture url, else seed url, without its fragment."""
    return F.substring_index(F.coalesce(F.nullif(F.trim(capture_url), F.lit("")), F.nullif(F.trim(seed_url), F.lit(""))), "#", 1)


def wayback_url(collection: Column, timestamp: Column, url: Column, base: str = "https://wayback.archive-it.org") -> Column:
    return F.concat(F.lit(base + "/"), collection.cast("string"), F.lit("/"), timestamp, F.lit("/"), url)


def source_scope(collection: Column, host: Column, month: Column, language: Column, fallback: Column) -> Column:
    """The scope in which documents are compared; an unknown host is a scope of its own page."""
    return F.struct(collection.alias("collection_id"), F.coalesce(host, F.concat(F.lit("unknown:"), fallback)).alias("host"), month.alias("month"), F.coalesce(F.lower(language), F.lit("")).alias("language"))


def digest(value: Column) -> Column:
    """SHA-256 of a value's canonical JSON: a map's or struct's keys in order."""
    return F.sha2(F.to_json(value), 256)


def article_id(collection: Column, url: Column, captured: Column, published: Column, text: Column) -> Column:
    """The identity of one article: collection, canonical url, dates and text."""
    text_hash = F.sha2(F.coalesce(text, F.lit("")), 256)
    parts = (collection.cast("string"), canonical_url(url), captured.cast("string"), published.cast("string"), text_hash)
    return F.sha2(F.to_json(F.array(*[F.coalesce(p, F.lit("")) for p in parts])), 256)


def chunk_id(namespace: Column, collection: Column, url: Column, month: Column, language: Column, content: Column, version: int = 2) -> Column:
    """A name-based UUID (version 5, in the URL namespace) of a chunk; ``content`` is the hash of its text."""
    parts = (F.lit(str(version)), namespace, collection.cast("string"), canonical_url(url), month, F.lower(language), content)
    name = F.to_json(F.array(*[F.coalesce(p, F.lit("")) for p in parts]))
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "utf-8")))
    variant = F.substr(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
