"""File names, globs, category paths and addresses."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urlparse

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A star, a question mark, a class with its content, or any other character.
_PIECE = re.compile(r"(\*+)|(\?)|\[(!?)(\]?[^\]]*)\]|(.)", re.S)


def _class(inside: str, negated: bool) -> str:
    """A character class by code points, so nothing in it has a meaning of its own to Java."""
    items, i = [], 0
    while i < len(inside):
        last = inside[i + 2] if inside[i + 1 : i + 2] == "-" and i + 2 < len(inside) else inside[i]
        if inside[i] <= last:
            items.append(f"\\x{{{ord(inside[i]):x}}}-\\x{{{ord(last):x}}}")
        i += 3 if i + 2 < len(inside) and inside[i + 1] == "-" else 1
    if not items:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(items)}]"


def _translated(glob: str) -> str:
    out = []
    for star, one, no, inside, char in _PIECE.findall(glob):
        if star:
            out.append(".*")
        elif one:
            out.append(".")
        elif char:
            out.append(char if char.isalnum() else f"\\x{{{ord(char):x}}}")
        else:
            out.append(_class(inside, bool(no)) if inside else re.escape(f"[{no}]"))
    return "".join(out)


def glob_regex(patterns: list[str]) -> str:
    """One anchored expression for case-insensitive globs; it is matched against lower-cased names."""
    return r"(?s)\A(?:" + "|".join(_translated(p.lower()) for p in patterns) + r")\z" if patterns else r"\A(?!)"


def matches(name: Column, patterns: list[str]) -> Column:
    return F.lower(name).rlike(glob_regex(patterns))


def suffix(name: Column) -> Column:
    """The extension with its dot, lower-cased; none for names that only begin with a dot or end with one."""
    return F.lower(F.regexp_extract(name, r"^.*[^./](\.[^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def extension_key(name: Column) -> Column:
    return F.coalesce(F.nullif(suffix(name), F.lit("")), F.lit("(none)"))


def clean_path(path: Column) -> Column:
    """At most two levels of words, each with its first letter raised; other signs are dropped."""
    parts = F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: F.regexp_replace(F.regexp_replace(p, r"(?U)[^\w &+-]", ""), r"^\s+|\s+$", ""))
    raised = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.array_join(F.transform(F.split(p, r"\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " "))
    return F.array_join(F.slice(raised, 1, 2), "/")


def valid_path(path: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), "^/+|/+$", "")
    return plain.rlike(r"^[^/\\\x00]+(/[^/\\\x00]+)*$") & ~F.array_contains(F.split(plain, "/"), "..")


def locality(url: str) -> str:
    """device, network or remote."""
    host = (urlparse(url).hostname or "").lower()
    if host in ("", "localhost") or host.endswith(".localhost"):
        return "device"
    if host.endswith((".local", ".lan", ".home.arpa")):
        return "network"
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return "remote"
    return "device" if address.is_loopback else "network" if address.is_private or address.is_link_local else "remote"


def locality_of(url: Column) -> Column:
    """The same for names and IPv4 and loopback IPv6 addresses, without Python."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    return (
        F.when(host.isin("", "localhost", "[::1]") | host.endswith(".localhost") | host.rlike(r"^127\.\d+\.\d+\.\d+$"), "device")
        .when(host.endswith(".local") | host.endswith(".lan") | host.endswith(".home.arpa"), "network")
        .when(host.rlike(r"^(10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|169\.254\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+)$|^\[f[cd]|^\[fe[89ab]"), "network")
        .otherwise("remote")
    )
