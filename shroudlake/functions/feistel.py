"""Format-preserving encryption: a Feistel network over decimal digits in expressions, over any alphabet in Arrow batches.

The layout of what a round hashes (round and tweak length in two bytes each, tweak, half) and the shift of a single
character are fixed: encrypted values depend on them.
"""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .crypto import hmac_of_hex, let

DIGITS = "0123456789"
ALPHABETS = {10: DIGITS, 16: "0123456789abcdef", 36: DIGITS + "abcdefghijklmnopqrstuvwxyz", 62: DIGITS + "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Halves of so many digits fit into a long.
PIECE = 36


def subkey(purpose: str, salt: str, scope: str) -> bytes:
    """The key of one purpose and column, so that no plan holds the salt itself."""
    return hashlib.sha256(f"{purpose}:{salt}:{scope}".encode()).digest()


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(19)]), (n + 1).cast("int"))


def _mod128(digest: Column, m: Column) -> Column:
    """The first 128 bits of a hex digest modulo a long."""
    part = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")
    m = m.cast("decimal(19,0)")
    high, low = (part(1) % m).cast("decimal(19,0)"), (part(17) % m).cast("decimal(19,0)")
    shift = (F.lit(str(1 << 64)).cast("decimal(20,0)") % m).cast("decimal(19,0)")
    return ((((high * shift).cast("decimal(38,0)") % m).cast("decimal(19,0)") + low) % m).cast("long")


def _network(digits: Column, key: bytes, tweak: Column, rounds: int) -> Column:
    """The network over two digits or more; digits and tweak are plain names or lambda variables."""
    n = F.length(digits)
    left, right = F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int")
    tweak_hex = F.hex(tweak.cast("binary"))
    size = F.lpad(F.hex((F.length(tweak_hex) / 2).cast("long")), 4, "0")

    def step(s: Column, r: Column) -> Column:
        b = F.hex(s["b"])
        b = F.concat(F.repeat(F.lit("0"), F.length(b) % 2), b)
        digest = hmac_of_hex(F.concat(F.lpad(F.hex(r.cast("long")), 4, "0"), size, tweak_hex, b), key)
        m = _power(F.when(r % 2 == 0, left).otherwise(right))
        new = let(F.struct(digest.alias("d"), m.alias("m")), lambda x: (s["a"] + _mod128(x["d"], x["m"])) % x["m"])
        return F.struct(s["b"].alias("a"), new.alias("b"))

    start = F.struct(F.coalesce(F.substr(digits, F.lit(1), left).try_cast("long"), F.lit(0).cast("long")).alias("a"), F.coalesce(F.substr(digits, left + 1, right).try_cast("long"), F.lit(0).cast("long")).alias("b"))

    def text(end: Column) -> Column:
        # after an odd number of rounds the halves have changed places
        first, last = (end["a"], end["b"]) if rounds % 2 == 0 else (end["b"], end["a"])
        return F.concat(F.lpad(first.cast("string"), left, "0"), F.lpad(last.cast("string"), right, "0"))

    return let(F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step), text)


def encrypt_digits(digits: Column, key: bytes, tweak: Column | str, rounds: int = 10) -> Column:
    """A text of digits encrypted to one of the same length, in expressions.

    Texts of more than 36 digits are encrypted in pieces of 36; a single digit is shifted by a keyed amount.
    """
    rounds = max(4, rounds)
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def all_of(x: Column) -> Column:
        d, t = x["d"], x["t"]
        shift = F.conv(F.substring(hmac_of_hex(F.concat(F.hex(t.cast("binary")), F.hex(d.cast("binary"))), key), 1, 8), 16, 10).cast("long")
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(d) - 1) / PIECE).cast("int")), lambda i: F.substr(d, i * PIECE + 1, F.lit(PIECE)))
        one = lambda p: F.when(F.length(p) == 1, ((p.try_cast("long") + shift) % 10).cast("string")).otherwise(_network(p, key, t, rounds))
        return F.when(F.length(d) == 0, d).otherwise(F.array_join(F.transform(pieces, one), ""))

    return let(F.struct(digits.alias("d"), tweak.alias("t")), all_of)


def put_digits(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order."""
    return let(digits, lambda d: _put(shape, d))


def _put(shape: Column, digits: Column) -> Column:
    step = lambda s, c: F.struct(
        F.concat(s["out"], F.when(c.between("0", "9"), F.substr(digits, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["i"] + F.when(c.between("0", "9"), 1).otherwise(0)).alias("i")
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))
    return F.aggregate(F.filter(F.split(shape, ""), lambda x: x != ""), start, step)["out"]


def encrypt_text(plain: str, key: bytes, tweak: bytes, alphabet: str, rounds: int) -> str:
    """The same network over any alphabet, in Python; all characters are of the alphabet."""
    radix, n, rounds = len(alphabet), len(plain), max(4, rounds)
    place = {c: i for i, c in enumerate(alphabet)}
    if n == 0:
        return plain
    if n == 1:
        shift = int.from_bytes(hmac.digest(key, tweak + plain.encode(), "sha256")[:4], "big")
        return alphabet[(place[plain] + shift) % radix]
    cut = n // 2

    def number(text: str) -> int:
        value = 0
        for c in text:
            value = value * radix + place[c]
        return value

    def text(value: int, size: int) -> str:
        out = []
        for _ in range(size):
            value, rest = divmod(value, radix)
            out.append(alphabet[rest])
        return "".join(reversed(out))

    halves, sizes = [number(plain[:cut]), number(plain[cut:])], (cut, n - cut)
    for r in range(rounds):
        b = halves[1].to_bytes(max(1, (halves[1].bit_length() + 7) // 8), "big")
        digest = hmac.digest(key, r.to_bytes(2, "big") + len(tweak).to_bytes(2, "big") + tweak + b, "sha256")
        halves = [halves[1], (halves[0] + int.from_bytes(digest[:16], "big")) % radix ** sizes[r % 2]]
    a, b = halves if rounds % 2 == 0 else halves[::-1]  # after an odd number of rounds the halves have changed places
    return text(a, sizes[0]) + text(b, sizes[1])


def encrypt_in_place(key: bytes, alphabet: str, rounds: int, lower: bool = False) -> object:
    """A function of (text, tweak) columns: the characters of the alphabet are encrypted, all others stay."""
    members = set(alphabet)

    @F.pandas_udf("string")
    def run(texts: pd.Series, tweaks: pd.Series) -> pd.Series:
        def one(value: str | None, tweak: str) -> str | None:
            if not value:
                return value
            out = iter(encrypt_text("".join(c for c in value if c in members), key, tweak.encode(), alphabet, rounds))
            mixed = "".join(next(out) if c in members else c for c in value)
            return mixed.lower() if lower else mixed

        return pd.Series([one(v, t) for v, t in zip(texts, tweaks, strict=True)], dtype="object")

    return run
