"""URL predicates of monitored sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """(origin, path, host): lower-case origin without a default port, path without slashes at its end."""
    form = r"^\s*([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d*))?([^?#]*)"
    scheme, host = F.lower(F.regexp_extract(url, form, 1)), F.lower(F.regexp_extract(url, form, 2))
    port = F.regexp_extract(url, form, 3)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    origin = F.concat(scheme, F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)))
    path = F.regexp_replace(F.regexp_extract(url, form, 4), "/+$", "")
    return F.when(host != "", origin), F.when(path == "", "/").otherwise(path), host


def is_allowed(url: Column, allowed: tuple[str, ...] | list[str], default_host: str | None = None) -> Column:
    """Same origin and path equal to, or under, that of an allowed URL; without a list, any URL of the default host, if there is one."""
    origin, path, host = _parts(url)
    blocked = url.isNull() | (url == "") | F.startswith(url, F.lit("chrome://")) | F.startswith(url, F.lit("about:")) | origin.isNull()
    if not allowed:
        return F.when(blocked, False).otherwise(host == default_host if default_host else F.lit(False))

    def matches(one: str) -> Column:
        other, under, _ = _parts(F.lit(one))
        return (origin == other) & ((under == "/") | (path == under) | F.startswith(path, F.concat(under, F.lit("/"))))

    hit = matches(allowed[0])
    for one in allowed[1:]:
        hit = hit | matches(one)
    return F.when(blocked, False).otherwise(F.coalesce(hit, F.lit(False)))


def is_capturable(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://"), F.lit(False))
