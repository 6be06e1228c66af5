"""Addresses in any spelling against the standard library, and hosts that are refused."""

import ipaddress
import random

from pyspark.sql import functions as F

from tallyloom.functions import urls


def ask(spark, f, hosts):
    return [r[0] for r in spark.createDataFrame(list(enumerate(hosts)), "i int, h string").select("i", f(F.col("h")).alias("x")).orderBy("i").select("x").collect()]


def test_spellings_of_addresses(spark):
    rng = random.Random(1)
    six = [ipaddress.IPv6Address(rng.getrandbits(128) & mask) for mask in ((1 << 128) - 1, (1 << 128) - (1 << 64), 0xFFFF << 64 | 0xFFFF, (0xFFFF << 112) | 1) for _ in range(40)]
    hosts = [x for a in six for x in (str(a), a.exploded, f"{a}%eth0")]
    assert ask(spark, urls.canonical_address, hosts) == [f"{int(a):032x}" for a in six for _ in range(3)]
    odd = ["1.2.3.4", "0177.0.0.1", "0x7f.1", "127.1", "1.2.3", "4294967295", "4294967296", "1.2.3.256", "256.1", "1.2.3.4.5", "09.1", "", "a.b", "1..2", "1:2", ":::", "1:2:3:4:5:6:7:8:9", "::g", "12345::", "::1.2.3.4", "1::2::3", "1:2:3:4:5:6:7::"]
    v4 = lambda n: "0" * 20 + f"ffff{n:08x}"
    assert ask(spark, urls.canonical_address, odd) == [
        v4(0x01020304), v4(0x7F000001), v4(0x7F000001), v4(0x7F000001), v4(0x01020003), v4(0xFFFFFFFF), None, None, None, None, None, None, None, None, None, None, None, None, None, f"{0x01020304:032x}", None, "00010002000300040005000600070000",
    ]


def test_refused_hosts(spark):
    refused = ["http://2130706433/", "http://0x7f.1/", "http://127.1/", "http://localhost./", "http://[::ffff:7f00:1]/", "http://a.localhost/", "http://[fd00::1]/", "http://[64:ff9b::1]/", "http://[::]/", "http://0/", "http://017700000001/", "http://[2002:7f00:1::]/", "http://[::127.0.0.1]/"]
    public = ["http://134744072/", "http://[2606:4700::1111]/", "http://8.8/", "http://example.org/", "http://[2001:20::1]/", "http://10.example.org/", "http://[::ffff:808:808]/"]
    assert ask(spark, urls.guard, refused) == ["internal"] * len(refused)
    assert ask(spark, urls.guard, public) == [None] * len(public)


def test_public_as_the_standard_library_says(spark):
    rng = random.Random(2)
    made = [ipaddress.IPv6Address((lead << 112) | rng.getrandbits(96)) for lead in (0x2001, 0x2002, 0x3FFF, 0xFE80, 0xFC00, 0xFF02, 0x2606, 0x100, 0x2001, 0x5F00) for _ in range(20)]
    made += [ipaddress.IPv6Address(x) for x in ("2001:1::1", "2001:1::3", "2001:3::9", "2001:4:112::1", "2001:30::1", "2001:db8::1", "3fff:fff::1", "2001:1ff::")]
    made += [ipaddress.IPv4Address(rng.getrandbits(32)) for _ in range(200)]
    shared = ipaddress.ip_network("100.64.0.0/10")
    want = [a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified or (a.version == 4 and a in shared) for a in made]
    got = ask(spark, urls.internal_host, [str(a) for a in made])
    assert [str(a) for a, w, g in zip(made, want, got, strict=True) if w != g] == []
