"""URLs that may not be fetched, against the standard library's reading of addresses."""

from __future__ import annotations

import ipaddress
import random
import socket
from bisect import bisect_right

import pytest

from rallyframe.functions import addresses
from rallyframe.operators.guards import guarded


def number(ip):
    return f"{int(ip) + (addresses.MAPPED if ip.version == 4 else 0):032x}"


def blocked(ip):
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified


def test_ranges_against_the_standard_library():
    rng, cuts = random.Random(3), addresses.edges()
    ips = [ipaddress.IPv4Address(rng.getrandbits(32)) for _ in range(5000)] + [ipaddress.IPv6Address(rng.getrandbits(128)) for _ in range(5000)]
    for cidr in [*addresses.BLOCKED, *addresses.PUBLIC]:
        net = ipaddress.ip_network(cidr)
        for at in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
            if 0 <= at < 1 << net.max_prefixlen:
                ips.append(type(net[0])(at))
    assert cuts == sorted(set(cuts))
    assert [ip for ip in ips if bisect_right(cuts, number(ip)) % 2 != blocked(ip)] == []


def test_hosts_are_read_in_all_forms(spark):
    rng = random.Random(4)
    v4 = [rng.getrandbits(32) for _ in range(40)] + [0, 2**32 - 1, 0x7F000001]
    texts = []
    for n in v4:
        a, b, c, d = n.to_bytes(4)
        texts += [f"{a}.{b}.{c}.{d}", str(n), hex(n), f"0{n:o}", f"{a}.{n & 0xFFFFFF}", f"0x{a:x}.0{b:o}.{n & 0xFFFF}", f"00{a:o}.{b}.0x00{c:x}.{d}"]
    texts += ["256.1.1.1", "1.2.3.256", "1.2.3.4.5", "08.1.1.1", "1..2", "4294967296", "0x100000000", "0x", "1.16777216", "a.b", "", "1.2.65536", "99999999999999999999", "0x123456789abcdef0123"]
    v6 = [ipaddress.IPv6Address(rng.getrandbits(128)) for _ in range(40)] + [ipaddress.IPv6Address((0xFE80 << 112) + rng.getrandbits(20)) for _ in range(9)]
    six = [f"[{x}]" for ip in v6 for x in (ip.compressed, ip.exploded)] + ["[::]", "[::1]", "[1::]", "[::ffff:10.0.0.1]", "[64:ff9b::1.2.3.4]", "[fe80::1%25eth0]"]
    bad = ["[:::]", "[1:2]", "[1::2::3]", "[12345::]", "[:1::2]", "[1:2:3:4:5:6:7:8:9]", "[1:2:3:4:5:6:7::8]", "[::1.2.3.256]", "[::1.2.3]", "[g::]", "[1:2:3:4:5:6:7:8::]", "[]", "[1:]"]
    df = spark.createDataFrame([(t,) for t in [*texts, *six, *bad]], "h string")
    got = {r.h: r.a for r in df.select("h", addresses.address(df.h).alias("a")).collect()}
    for t in texts:
        try:
            want = number(ipaddress.IPv4Address(socket.inet_aton(t))) if t else None
        except OSError:
            want = None
        assert got[t] == want, t
    for t in six:
        inside = t[1:-1].split("%")[0]
        assert got[t] == number(ipaddress.ip_address(inside)), t
    for t in bad:
        with pytest.raises(ValueError):
            ipaddress.ip_address(t[1:-1])
        assert got[t] is None, t


def test_urls_by_reason(spark):
    cases = {
        "http://example.org/a": None, "HTTPS://User:pw@Example.ORG:8080?x": None, "http://a@127.0.0.1@example.org/": None, "http://93.184.216.34/": None, "http://[2606:2800::1]:80/": None, " \thttp://exa\nmple.org": None,
        "ftp://example.org": "host", "example.org": "host", "http://": "host", "http:///x": "host", "http://[::1": "host", "http://[127.0.0.1]/": "host", None: "host", "": "host",
        "http://localhost": "name", "http://LOCALHOST.:80/": "name", "http://a.internal": "name", "http://printer.local/x": "name",
        "http://127.0.0.1/": "address", "http://127.1/": "address", "http://2130706433/": "address", "http://0x7f000001/": "address", "http://0177.0.0.1/": "address", "http://[::1]/": "address", "http://[::ffff:10.0.0.1]:8/": "address",
        "http://example.org@10.1.2.3/": "address", "http://10.1.2.3./": "address", "http://169.254.169.254/latest": "address",
    }
    df = spark.createDataFrame([(u, 1) for u in cases], "url string, _public int")
    assert {r.url: r.refused for r in guarded(df).collect()} == cases
    assert guarded(df).columns == ["url", "_public", "host", "address", "refused"]
    listed = {r.url: r.refused for r in guarded(df, hosts=("example.org",)).collect()}
    assert listed["http://93.184.216.34/"] == "list" and listed["http://example.org/a"] is None and listed["http://localhost"] == "name"
    with pytest.raises(ValueError, match="host"):
        guarded(df.withColumnRenamed("_public", "host"))
    assert guarded(df.limit(0)).count() == 0


def test_names_by_what_they_resolve_to(spark):
    df = spark.createDataFrame([("http://a.org/",), ("http://B.org./",), ("http://c.org",), ("http://d.org",), ("http://8.8.8.8/",), ("http://10.0.0.1/",), ("http://e.local/",), (None,)], "url string")
    table = spark.createDataFrame([("a.org", "93.184.216.34"), ("b.org", "93.184.216.34"), ("b.org", "10.0.0.1"), ("c.org", "2606:2800::1"), ("c.org", "what"), ("f.org", None), (None, "1.1.1.1")], "host string, address string")
    got = {r.url: r.refused for r in guarded(df, resolved=table).collect()}
    assert got == {"http://a.org/": None, "http://B.org./": "address", "http://c.org": "address", "http://d.org": "unresolved", "http://8.8.8.8/": None, "http://10.0.0.1/": "address", "http://e.local/": "name", None: "host"}
