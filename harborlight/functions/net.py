"""IPv4 and IPv6 addresses and networks as fixed-width keys, so that containment is a comparison of text.

A key is the family (``4`` or ``6``) and 32 hexadecimal digits; keys of one family sort like the addresses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ipv4

WIDTH = 32


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``x`` evaluated once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _hex(n: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(n)), digits, "0")


def _v4_hex(quad: Column) -> Column:
    """Eight digits of a valid dotted quad."""
    return F.array_join(F.transform(F.split(quad, r"\."), lambda p: _hex(p.cast("long"), 2)), "")


def _groups(text: Column) -> Column:
    return F.filter(F.split(text, ":"), lambda g: g != "")


def _v6_hex(address: Column) -> Column:
    """32 digits of an IPv6 address in any of its forms; null if it is none."""

    def plain(t: Column) -> Column:
        # a dotted tail becomes two groups
        tail = ipv4(F.substring_index(t, ":", -1))
        digits = _v4_hex(tail)
        return F.when(tail.isNotNull(), F.concat(F.left(t, F.length(t) - F.length(tail)), F.left(digits, F.lit(4)), F.lit(":"), F.right(digits, F.lit(4)))).otherwise(t)

    def parts(t: Column) -> Column:
        head, rest = _groups(F.substring_index(t, "::", 1)), _groups(F.substring_index(t, "::", -1))
        return F.when(F.contains(t, F.lit("::")), F.struct(head.alias("a"), rest.alias("b"), F.lit(True).alias("gap"))).otherwise(F.struct(_groups(t).alias("a"), F.array().cast("array<string>").alias("b"), F.lit(False).alias("gap")))

    def whole(p: Column) -> Column:
        n = F.size(p["a"]) + F.size(p["b"])
        zeros = F.array_repeat(F.lit("0"), F.lit(8) - n)
        every = F.transform(F.concat(p["a"], zeros, p["b"]), lambda g: F.lpad(g, 4, "0"))
        return F.when(F.when(p["gap"], n <= 7).otherwise(n == 8), F.array_join(every, ""))

    ok = r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$"
    return _let(plain(F.lower(F.btrim(address))), lambda t: F.when(F.contains(t, F.lit(":")) & t.rlike(ok), _let(parts(t), whole)))


def address_key(address: Column) -> Column:
    """The key of an address, null if it is none."""
    v4 = ipv4(address)
    return F.when(v4.isNotNull(), F.concat(F.lit("4"), F.lpad(_v4_hex(v4), WIDTH, "0"))).when(F.contains(address, F.lit(":")), _let(_v6_hex(address), lambda h: F.concat(F.lit("6"), h)))


def address_text(address: Column) -> Column:
    """The usual form: a dotted quad as it is, IPv6 lower-cased with its longest run of zeros left out. Null if it is none."""
    groups = lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(h, i * 4 + 1, F.lit(4)), "^0{1,3}", "")), ":")

    def shortened(t: Column) -> Column:
        out = t
        for k in range(2, 9):  # the longest is tried first
            run = rf"^(.*?)(?:(?<=^)|(?<=:))0(?::0){{{k - 1}}}(?=:|$)(.*)$"
            out = F.when(t.rlike(run), F.concat(F.rtrim(F.regexp_extract(t, run, 1), F.lit(":")), F.lit("::"), F.ltrim(F.regexp_extract(t, run, 2), F.lit(":")))).otherwise(out)
        return out

    return F.coalesce(ipv4(address), F.when(F.contains(address, F.lit(":")), _let(_v6_hex(address), lambda h: F.when(h.isNotNull(), _let(groups(h), shortened)))))


def prefix_length(cidr: Column) -> Column:
    return F.split_part(cidr, F.lit("/"), F.lit(2)).try_cast("int")


def _digit(key: Column, bits: Column, change: Callable[[Column, Column], Column], fill: str) -> Column:
    """``key`` with everything after its first ``bits`` bits replaced."""

    def replaced(x: Column) -> Column:
        k = F.floor(x["b"] / 4).cast("int")
        digit = F.conv(F.substring(x["k"], k + 2, F.lit(1)), 16, 10).cast("int")
        span = F.call_function("shiftright", F.lit(15), (x["b"] % 4).cast("int"))
        one = F.when(k < WIDTH, _hex(change(digit, span), 1)).otherwise(F.lit(""))
        return F.concat(F.left(x["k"], k + 1), one, F.repeat(F.lit(fill), F.greatest(F.lit(WIDTH - 1) - k, F.lit(0))))

    return _let(F.struct(key.alias("k"), bits.alias("b")), replaced)


def masked(key: Column, bits: Column) -> Column:
    """The first address of the network of ``bits`` bits (of 128) that holds ``key``."""
    return _digit(key, bits, lambda d, span: d.bitwiseAND(F.lit(15) - span), "0")


def network(cidr: Column) -> Column:
    """(low, high, bits): first and last address and fixed bits of 128; null if the text is no network or has host bits set."""

    def sized(key: Column) -> Column:
        n = prefix_length(cidr)
        bits = F.when(F.left(key, F.lit(1)) == "4", F.when(n.between(0, 32), n + 96)).otherwise(F.when(n.between(0, 128), n))
        return F.struct(key.alias("low"), bits.alias("bits"))

    def bounded(x: Column) -> Column:
        last = _digit(x["low"], x["bits"], lambda d, span: d.bitwiseOR(span), "f")
        return F.when(masked(x["low"], x["bits"]) == x["low"], F.struct(x["low"].alias("low"), last.alias("high"), x["bits"].alias("bits")))

    return _let(_let(address_key(F.split_part(cidr, F.lit("/"), F.lit(1))), sized), bounded)
