"""Keyed hashes and pseudo-random draws as plain Column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The DNS namespace of RFC 4122.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it; expressions would grow otherwise."""
    return F.transform(F.array(value), body)[0]


def canon(c: Column, kind: T.DataType) -> Column:
    """The text of a value that enters hashes: one spelling for each type."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.format_string("%.6f", c.cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def _pads(key: bytes) -> tuple[str, str]:
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_of_hex(message: Column, key: bytes) -> Column:
    """HMAC-SHA256, in hex, of a message given in hex."""
    inner, outer = _pads(key)
    digest = F.sha2(F.unhex(F.concat(F.lit(inner), message)), 256)
    return F.sha2(F.unhex(F.concat(F.lit(outer), digest)), 256)


def hmac_sha256(text: Column, key: str) -> Column:
    """HMAC-SHA256 of a text, in hex."""
    return hmac_of_hex(F.hex(text.cast("binary")), key.encode())


def u64_mod(digest: Column, m: int) -> Column:
    """The first 64 bits of a hex digest, modulo m, as a long."""
    if m <= 1 << 31:  # stays in longs, and in generated code
        high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
        return ((high % m) * ((1 << 32) % m) + low) % m
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(str(m)).cast("decimal(20,0)")).cast("long")


def draw(prefix: str, value: Column, nonce: Column | str = "") -> Column:
    """60 pseudo-random bits, as a long, from a secret prefix, a value's text and a nonce."""
    nonce = F.lit(nonce) if isinstance(nonce, str) else nonce.cast("string")
    return F.conv(F.substring(F.sha2(F.concat(F.lit(prefix), value, nonce), 256), 1, 15), 16, 10).cast("long")


def draw_int(bits: Column, low: int, high: int) -> Column:
    """A whole number from low to high."""
    return bits % (high - low + 1) + low


def draw_unit(bits: Column) -> Column:
    """A double strictly between 0 and 1."""
    return (F.shiftright(bits, 8).cast("double") + 0.5) / float(1 << 52)


def draw_normal(prefix: str, value: Column, nonce: str | Column = "") -> Column:
    """A standard normal double, by Box and Muller's transform of two draws."""
    tag = lambda s: F.concat(F.lit(nonce) if isinstance(nonce, str) else nonce.cast("string"), F.lit(s))
    u, v = draw_unit(draw(prefix, value, tag("#1"))), draw_unit(draw(prefix, value, tag("#2")))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * 3.141592653589793 * v)


def pick(bits: Column, items: list) -> Column:
    """One of the items."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (bits % len(items) + 1).cast("int"))


def uuid5(text: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """A version 5 UUID."""
    h = F.sha1(F.unhex(F.concat(F.lit(namespace), F.hex(text.cast("binary")))))
    variant = F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lower(F.hex(variant)), F.substring(h, 19, 2)), F.substring(h, 21, 12))
