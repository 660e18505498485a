"""Checks of addresses, as column expressions."""

from __future__ import annotations

from functools import reduce
from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Networks of version 4 that aren't of the public internet, by the registries of special and multicast addresses.
INNER = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()
#: Names that never leave a host or its network.
LOCAL_NAMES, LOCAL_ENDS = ("localhost",), (".localhost", ".local", ".internal")

_QUAD = r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _inner_v4(number: Column) -> Column:
    return _any([number.between(int(n.network_address), int(n.broadcast_address)) for n in map(ip_network, INNER)])


def _quad(host: Column, pattern: str = _QUAD) -> Column:
    """The number of an address of four parts; null where it isn't one."""
    parts = [F.regexp_extract(host, f"^{pattern}$", i).try_cast("long") for i in (1, 2, 3, 4)]
    number = reduce(lambda n, p: n * 256 + p, parts)
    return F.when(reduce(lambda a, b: a & b, [p <= 255 for p in parts]), number)


def host_of(url: Column) -> Column:
    """Lower-case host, without user, port, brackets and dots at the end; empty where there is none."""
    authority = F.regexp_replace(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1), "^.*@", "")
    host = F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)\](?::\d*)?$", 1)).otherwise(F.regexp_replace(authority, r":\d*$", ""))
    return F.lower(F.regexp_replace(host, r"\.+$", ""))


def is_public(url: Column) -> Column:
    """Whether an address is http(s) and doesn't name a private, reserved or local host; null is not.

    Of version 6 only global unicast passes, and what wraps an address of version 4
    (mapped, translated or 6to4) passes as that does. Numbers that aren't four
    parts of up to 255 are no names: they don't pass.
    """
    scheme, host = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1)), host_of(url)
    six = host.contains(":")
    hextet = lambda i: F.conv(F.nullif(F.regexp_extract(host, r"^([0-9a-f]{0,4}):([0-9a-f]{0,4}):?([0-9a-f]{0,4})", i), F.lit("")), 16, 10).cast("long")
    first, second, third = hextet(1), F.coalesce(hextet(2), F.lit(0)), F.coalesce(hextet(3), F.lit(0))
    wrapped = F.coalesce(_quad(host, "(?:::ffff:|64:ff9b::)" + _QUAD), F.when(first == 0x2002, second * 65536 + third))
    global_v6 = first.between(0x2000, 0x3FFF) & ~((first == 0x2001) & ((second < 0x200) | (second == 0xDB8)))
    v6 = F.when(wrapped.isNotNull(), ~_inner_v4(wrapped)).otherwise(global_v6)
    four = _quad(host)
    numeric = host.rlike(r"^(?:0x[0-9a-f]*|\d+)(?:\.(?:0x[0-9a-f]*|\d+))*$")
    name = (host != "") & ~host.isin(*LOCAL_NAMES) & ~_any([host.endswith(e) for e in LOCAL_ENDS])
    ok = F.when(six, v6).when(four.isNotNull(), ~_inner_v4(four)).otherwise(name & ~numeric)
    return F.coalesce(scheme.isin("http", "https") & ok, F.lit(False))
