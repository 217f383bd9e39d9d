"""Addresses in URLs: hosts in every literal form as one 128-bit number, and whether that number is public.

An address is text of 32 hex digits, so numbers compare as texts. IPv4 lies at ::ffff:0:0, as it does inside IPv6. IPv4 hosts may be of
one to four parts, decimal, octal (0...) or hexadecimal (0x...), the last part filling what is left, since name resolution reads them so.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges that are not public (private, loopback, link-local, reserved, multicast, unspecified), and public ones inside them.
BLOCKED = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16",
    "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
]
PUBLIC = ["192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]
LOCAL_NAME = r"^localhost$|\.(local|internal)$"
MAPPED = 0xFFFF << 32


def edges() -> list[str]:
    """Addresses, rising, at which public and other ranges take turns; below the first one all are public."""
    whole = []
    for cidr in [*BLOCKED, *PUBLIC]:
        net = ipaddress.ip_network(cidr)
        shift = MAPPED if net.version == 4 else 0
        whole.append((int(net[0]) + shift, int(net[-1]) + shift + 1, cidr in BLOCKED))
    cuts = sorted({x for a, b, _ in whole for x in (a, b)} | {MAPPED, MAPPED + (1 << 32)})
    out, before = [], False
    for x in cuts:
        around = [(b - a, blocked) for a, b, blocked in whole if a <= x < b and not (a == 0 and MAPPED <= x < MAPPED + (1 << 32))]
        blocked = bool(around) and min(around)[1]  # the smallest range around decides
        if blocked != before and x < 1 << 128:
            out.append(f"{x:032x}")
        before = blocked
    return out


def host(url: Column) -> Column:
    """The host of an http or https URL, lower-cased, an IPv6 one in brackets; null where there is none."""
    plain = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    rest = F.regexp_extract(F.regexp_extract(plain, r"^(?i:https?)://([^/?#]*)", 1), r"([^@]*)$", 1)
    found = F.lower(F.regexp_extract(rest, r"^(\[[^\]]*\]|[^:\[\]]*)(:[^:\[\]]*)?$", 1))
    return F.nullif(found, F.lit(""))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _number(part: Column) -> Column:
    """A part of an IPv4 address; null where it is no number, or one of over 34 bits."""

    def digits(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(part, pattern, 1), F.lit(""))

    octal = F.conv(digits(r"^0+([0-7]{1,11})$"), 8, 10)
    return F.coalesce(F.conv(digits(r"^0x0*([0-9a-f]{1,8})$"), 16, 10), octal, digits(r"^(0+)$"), digits(r"^([1-9][0-9]{0,9})$")).cast("long")


def _ipv4(text: Column) -> Column:
    def value(n: Column) -> Column:
        found = F.lit(None).cast("long")
        for k in range(4):
            fits, total = F.get(n, F.lit(k)) < 1 << 8 * (4 - k), F.get(n, F.lit(k))
            for i in range(k):
                fits, total = fits & (F.get(n, F.lit(i)) < 256), total + F.get(n, F.lit(i)) * (1 << 8 * (3 - i))
            found = F.when((F.size(n) == k + 1) & fits, total).otherwise(found)
        return found

    return _once(F.transform(F.split(text, r"\.", -1), _number), value)


def _groups(side: Column) -> Column:
    """Groups of an IPv6 address, four digits each, joined; null where one is no group."""
    filled = F.regexp_replace(F.regexp_replace(side, r"([0-9a-f]+)", "000$1"), r"[0-9a-f]*([0-9a-f]{4})(?=:|$)", "$1")
    return F.when(side.rlike(r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$"), F.replace(filled, F.lit(":"), F.lit("")))


def _ipv6(text: Column) -> Column:
    quad = r"^(.*:)(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})$"

    def tail(b: Column) -> Column:
        pairs = [F.lower(F.hex(b[i] * 256 + b[i + 1])) for i in (0, 2)]
        return F.when(F.array_max(b) < 256, F.concat(F.regexp_extract(text, quad, 1), pairs[0], F.lit(":"), pairs[1]))

    def value(sides: Column) -> Column:
        missing = 32 - F.length(F.array_join(sides, "", "x"))
        whole = F.when((F.size(sides) == 1) & (missing == 0), sides[0]).when((F.size(sides) == 2) & (missing > 0), F.concat(sides[0], F.repeat(F.lit("0"), missing), F.get(sides, F.lit(1))))
        return F.when(~F.exists(sides, F.isnull), whole)

    last = F.array(*(F.nullif(F.regexp_extract(text, quad, i), F.lit("")).cast("long") for i in range(2, 6)))
    plain = F.when(text.contains("."), _once(last, tail)).otherwise(text)
    return _once(F.transform(F.split(plain, "::", -1), _groups), value)


def address(host: Column) -> Column:
    """The address a host states; null for names. A scope (``%...``) does not count, nor one dot at the end."""
    inside = F.regexp_extract(host, r"^\[?([^\]%]*?)(?:%[^\]]*)?\]?$", 1)
    v4 = F.concat(F.lit(f"{MAPPED >> 32:024x}"), F.lpad(F.lower(F.hex(_ipv4(F.regexp_replace(host, r"\.$", "")))), 8, "0"))
    return F.when(inside.contains(":"), _ipv6(inside)).otherwise(v4)


def is_public(address: Column) -> Column:
    """Whether an address lies in no range of BLOCKED; a binary search over the ranges' edges, as nested conditions."""
    cuts = edges()

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low % 2 == 0)
        mid = (low + high) // 2
        return F.when(address < cuts[mid], search(low, mid)).otherwise(search(mid + 1, high))

    return F.when(address.isNotNull(), search(0, len(cuts)))
