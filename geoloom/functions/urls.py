"""Rules for links."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Private and link-local IPv4 networks, by first address and number of leading bits.
PRIVATE_NETWORKS = [("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16)]
LOCAL_NAMES = ["localhost", "::1", "[::1]"]
#: Characters that no address may hold, and the form of one number of an IPv4 host (hexadecimal, octal, decimal).
STRANGE = r"[\s<>\"{}|\\\\^`]"
NUMBER = r"\A(0x[0-9a-f]*|[0-9]+)\z"


def _scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def _host(url: Column) -> Column:
    """The host in lower case, without credentials, port and a closing dot."""
    host = F.regexp_replace(F.regexp_replace(_authority(url), r"\A.*@", ""), r":\d*\z", "")
    return F.lower(F.regexp_replace(host, r"\.\z", ""))


def _sound(url: Column) -> Column:
    return (_host(url) != "") & ~_authority(url).contains("@") & ~url.rlike(STRANGE)


def ipv4_number(host: Column) -> Column:
    """The address that a host of one to four numbers stands for (the last one fills what is left), else null."""
    parts = F.split(host, r"\.")

    def number(part: Column) -> Column:
        hexadecimal, octal = part.startswith("0x"), part.rlike(r"\A0[0-7]+\z")
        read = F.when(hexadecimal, F.conv(F.concat(F.lit("0"), F.substring(part, 3, 20)), 16, 10)).when(
            octal, F.conv(part, 8, 10)).otherwise(F.conv(part, 10, 10))
        return read.cast("decimal(20,0)").cast("double")

    values = F.transform(F.filter(parts, lambda p: p.rlike(NUMBER)), number)
    n = F.size(parts)
    numeric = (F.size(values) == n) & (n <= 4)
    last = F.pow(F.lit(256.0), 5 - n)
    firsts = F.aggregate(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda total, v: total * 256 + v)
    total = firsts * last + F.element_at(values, -1)
    return F.when(numeric & (total < float(1 << 32)), total.cast("bigint"))


def _private(host: Column) -> Column:
    address, found = ipv4_number(host), F.lit(False)
    for first, bits in PRIVATE_NETWORKS:
        low = int.from_bytes(bytes(map(int, first.split("."))), "big")
        found = found | F.coalesce(address.between(low, low + (1 << 32 - bits) - 1), F.lit(False))
    return found


def is_public_https(url: Column) -> Column:
    """True for an https address without credentials whose host is not local or private, in whatever form its numbers
    are written."""
    host = _host(url)
    public = ~host.isin(LOCAL_NAMES) & ~host.endswith(".local") & ~_private(host)
    return F.coalesce((_scheme(url) == "https") & _sound(url) & public, F.lit(False))


def clean_link(url: Column) -> Column:
    """The link when it is http or https with a host and without credentials, else null."""
    return F.when(_scheme(url).isin("http", "https") & _sound(url), url)


def clean_link_text(url: str | None) -> str | None:
    """Driver-side form of :func:`clean_link` for the few links in a specification."""
    found = re.match(r"https?://([^/?#]*)", url or "", re.IGNORECASE)
    host = re.sub(r"\.\Z", "", re.sub(r":[0-9]*\Z", "", found[1])) if found else ""
    return url if host and "@" not in found[1] and not re.search(STRANGE, url) else None
