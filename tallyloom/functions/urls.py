"""URL rules as Column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: kinds and the patterns (one group: the id) that tell them, in order
SOURCE_PATTERNS = (
    ("youtube", (r"(?:youtube\.com/watch\?.*?v=|youtu\.be/|youtube\.com/embed/|youtube\.com/v/|youtube\.com/shorts/)([\w-]{11})",)),
    ("vimeo", (r"vimeo\.com/(?:video/)?(\d+)",)),
    ("twitch", (r"twitch\.tv/videos/(\d+)", r"clips\.twitch\.tv/([\w-]+)", r"twitch\.tv/\w+/clip/([\w-]+)")),
    ("twitter", (r"(?:twitter|x)\.com/\w+/status/(\d+)",)),
    ("tiktok", (r"tiktok\.com/@[\w.]+/video/(\d+)", r"vm\.tiktok\.com/([\w]+)")),
    ("reddit", (r"reddit\.com/r/\w+/comments/([\w]+)", r"redd\.it/([\w]+)")),
    ("rumble", (r"rumble\.com/(?:embed/)?(v\w+)",)),
)
#: fixed value: endings of media files
FILE_PATTERN = r"(?i)\.(mp4|webm|mov|mkv|avi|m3u8|m4v|ogv)(\?|$)"
#: fixed values: private, loopback, link-local, shared, reserved, documentation and multicast ranges
NOT_PUBLIC = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
#: fixed values: of IPv6, the global unicast range, what in it is not public, and what in the latter is public again
GLOBAL_6 = ("2000::", 3)
NOT_PUBLIC_6 = (("2001::", 23), ("2001:db8::", 32), ("2002::", 16))
PUBLIC_AGAIN_6 = (("2001:1::1", 128), ("2001:1::2", 128), ("2001:3::", 32), ("2001:4:112::", 48), ("2001:20::", 28), ("2001:30::", 28))
_MAPPED = "0" * 20 + "ffff"


def url_hash(url: Column) -> Column:
    """First 16 hex digits of the MD5."""
    return F.left(F.md5(url), F.lit(16))


def classify(url: Column, patterns=SOURCE_PATTERNS, file_pattern: str = FILE_PATTERN) -> Column:
    """kind and native id: the first pattern that matches, else a media file or an unknown source by its hash."""
    out = None
    for kind, each in patterns:
        for p in each:
            found = F.struct(F.lit(kind).alias("kind"), F.regexp_extract(url, p, 1).alias("native_id"))
            out = F.when(url.rlike(p), found) if out is None else out.when(url.rlike(p), found)
    by_hash = lambda kind: F.struct(F.lit(kind).alias("kind"), url_hash(url).alias("native_id"))
    return out.when(url.rlike(file_pattern), by_hash("direct")).otherwise(by_hash("unknown"))


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and the brackets of an IPv6 address; '' if there is none."""
    authority = F.regexp_replace(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@", "")
    return F.lower(F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(authority, r"^([^:]*)", 1)))


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _number_4(h: Column) -> Column:
    """Number of an IPv4 address in any spelling that a resolver takes: one to four parts, each decimal, octal (0...) or hexadecimal
    (0x...), the last of which fills the bytes that are left; else null."""
    part = lambda p: F.when(p.rlike("^0x[0-9a-f]{1,16}$"), F.conv(F.substring(p, 3, 16), 16, 10)).when(p.rlike("^0[0-7]{1,20}$"), F.conv(p, 8, 10)).when(p.rlike("^(0|[1-9][0-9]{0,17})$"), p).try_cast("long")
    weight = lambda i: F.element_at(F.array(*[F.lit(1 << k) for k in (24, 16, 8)]), i + 1)

    def number(parts: Column) -> Column:
        n = F.size(parts)
        room = F.element_at(F.array(*[F.lit(1 << k).cast("long") for k in (32, 24, 16, 8)]), n)
        fits = F.forall(F.transform(parts, lambda x, i: F.when(i < n - 1, x <= 255).otherwise(x < room)), lambda x: F.coalesce(x, F.lit(False)))
        total = F.aggregate(F.transform(parts, lambda x, i: F.when(i < n - 1, x * weight(F.least(i, F.lit(2)))).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
        return F.when(n.between(1, 4), F.when(fits, total))

    return _let(F.transform(F.slice(F.split(h, r"\."), 1, 5), part), number)


def _hex_6(h: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, with or without a zone, `::` or an IPv4 tail; else null."""
    tail = _number_4(F.regexp_extract(h, r"^.*:(\d+\.\d+\.\d+\.\d+)$", 1))
    spelled = lambda d: F.concat(F.regexp_extract(h, "^(.*:)", 1), F.left(d, F.lit(4)), F.lit(":"), F.right(d, F.lit(4)))
    plain = F.when(h.contains("."), _let(F.lpad(F.lower(F.hex(tail)), 8, "0"), spelled)).otherwise(h)
    groups = lambda x: F.filter(F.split(x, ":", -1), lambda g: x != "")

    def filled(sides: Column) -> Column:
        """sides: the groups before and, if there is a `::`, after it."""
        missing = F.lit(8) - F.size(F.flatten(sides))
        whole = F.concat(sides[0], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), F.flatten(F.slice(sides, 2, 1)))
        fits = F.when(F.size(sides) == 2, missing >= 1).otherwise((F.size(sides) == 1) & (missing == 0))
        joined = F.array_join(F.transform(whole, lambda g: F.when(g.rlike("^[0-9a-f]{1,4}$"), F.lpad(g, 4, "0")).otherwise("-")), "")
        return F.when(fits, _let(joined, lambda x: F.when(F.length(x) == 32, F.when(~x.contains("-"), x))))

    return _let(F.transform(F.split(plain, "::", -1), groups), filled)


def canonical_address(h: Column) -> Column:
    """One form for all spellings of an address: 32 hexadecimal digits, those of IPv4 as mapped ones; null for what is a name."""
    four = lambda n: F.concat(F.lit(_MAPPED), F.lpad(F.lower(F.hex(n)), 8, "0"))
    return _let(F.regexp_replace(F.lower(h), r"%.*$|\.$", ""), lambda name: F.when(name.contains(":"), _hex_6(name)).otherwise(four(_number_4(name))))


def _within(form: Column, ranges: tuple[tuple[str, int], ...]) -> Column:
    """Whether a canonical address lies in one of the ranges: forms are as wide as each other, so they compare as texts."""
    inside = F.lit(False)
    for address, bits in ranges:
        net = ipaddress.ip_network(f"{address}/{bits}")
        low, high = (_MAPPED + f"{int(x):08x}" if net.version == 4 else f"{int(x):032x}" for x in (net[0], net[-1]))
        inside = inside | form.between(low, high)
    return inside


def internal_host(h: Column) -> Column:
    """The host is localhost or an address, however it is spelled, that is not public. No name is looked up."""

    def told(form: Column) -> Column:
        six = ~_within(form, (GLOBAL_6,)) | (_within(form, NOT_PUBLIC_6) & ~_within(form, PUBLIC_AGAIN_6))
        return F.when(form.startswith(_MAPPED), _within(form, NOT_PUBLIC)).otherwise(six)

    local = lambda name: (name == "localhost") | name.endswith(".localhost")
    return _let(h, lambda x: local(F.regexp_replace(x, r"\.$", "")) | F.coalesce(_let(canonical_address(x), told), F.lit(False)))


def guard(url: Column, allowed: list[str] | None = None) -> Column:
    """Why a URL is refused: `scheme`, `host`, `internal` or `not allowed`; null if it is not. No name is looked up."""

    def told(h: Column) -> Column:
        out = F.when(~url.rlike(r"(?i)^\s*https?://"), "scheme").when(h == "", "host").when(internal_host(h), "internal")
        return out.when(~h.isin(*allowed), "not allowed") if allowed is not None else out

    return _let(host(url), told)


def public_path(path: Column, base: str, prefix: str) -> Column:
    """Public URL of a file under the base folder, else null."""
    return F.when(path.startswith(base), F.concat(F.lit(prefix), F.substring(path, F.lit(len(base) + 1), F.length(path))))
