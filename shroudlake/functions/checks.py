"""Checksums of card, identity and account numbers, entropy, and dates in text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def luhn_sum(digits: Column, check_digit_missing: bool = False) -> Column:
    """The Luhn sum of a text of digits, from the right; with a missing check digit, as if it were 0."""
    odd = 0 if check_digit_missing else 1

    def part(x: Column, i: Column) -> Column:
        d = x.cast("int")
        return F.when(i % 2 == odd, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return _total(F.transform(_chars(F.reverse(digits)), part))


def luhn_valid(c: Column) -> Column:
    """8 to 19 digits, other characters aside, with a Luhn sum that ends in 0."""
    d = digits_of(c)
    return F.length(d).between(8, 19) & (luhn_sum(d) % 10 == 0)


def luhn_check_digit(digits: Column) -> Column:
    """The digit to put behind the digits."""
    return ((10 - luhn_sum(digits, check_digit_missing=True) % 10) % 10).cast("string")


def _digit(d: Column, i: int) -> Column:
    return F.substring(d, i, 1).cast("int")


def tckn_check_digits(nine: Column) -> Column:
    """The tenth and eleventh digits of a Turkish identity number."""
    odd = sum((_digit(nine, i) for i in (3, 5, 7, 9)), _digit(nine, 1))
    even = sum((_digit(nine, i) for i in (4, 6, 8)), _digit(nine, 2))
    tenth = F.pmod(odd * 7 - even, F.lit(10))
    return F.concat(tenth.cast("string"), ((odd + even + tenth) % 10).cast("string"))


def tckn_valid(c: Column) -> Column:
    """11 digits, other characters aside, not starting with 0, with both check digits right."""
    d = digits_of(c)
    shape = (F.length(d) == 11) & (F.substring(d, 1, 1) != "0")
    return F.when(shape, F.substring(d, 10, 2) == tckn_check_digits(F.substring(d, 1, 9))).otherwise(F.lit(False) & c.isNotNull())


def mod97(c: Column) -> Column:
    """A text of digits and capital letters (A is 10) modulo 97."""

    def step(acc: Column, x: Column) -> Column:
        letter = F.ascii(x) - 55
        return F.when(x.between("0", "9"), (acc * 10 + x.cast("int")) % 97).otherwise((acc * 100 + letter) % 97)

    return F.aggregate(_chars(c), F.lit(0), step)


def iban_valid(c: Column) -> Column:
    """15 to 34 characters without spaces and dashes, two letters first, equal to 1 modulo 97."""
    clean = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    shape = F.length(clean).between(15, 34) & clean.rlike("^[A-Z]{2}[A-Z0-9]*$")
    moved = F.concat(F.substr(clean, F.lit(5)), F.substring(clean, 1, 4))
    return F.when(shape, mod97(moved) == 1).otherwise(F.lit(False) & c.isNotNull())


#: Counters of characters that are held at a time.
_COUNTERS = 1 << 21


def _entropies(texts: list[str]) -> np.ndarray:
    """The entropy of each text: counts by text and character, added up in the order of the characters."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = np.array([len(t) for t in texts])
    seen = np.zeros(int(points.max(initial=0)) + 1, dtype=bool)
    seen[points] = True
    width = int(seen.sum())
    if len(texts) > 1 and len(texts) * width > _COUNTERS:
        half = len(texts) // 2
        return np.concatenate([_entropies(texts[:half]), _entropies(texts[half:])])
    place = np.cumsum(seen) - 1
    counts = np.bincount(np.repeat(np.arange(len(texts)) * width, n) + place[points], minlength=len(texts) * width).reshape(len(texts), width)
    p = counts / np.maximum(n, 1)[:, None]
    terms = -p * np.log2(p, out=np.zeros_like(p), where=p > 0)
    # one by one, so that other texts of a batch, which add zeros, change no bit
    return np.add.accumulate(terms, axis=1)[:, -1] + 0.0 if width else np.zeros(len(texts))


def _entropy_batch(texts: pa.Array) -> pa.Array:
    out = np.zeros(len(texts))
    held, size, rows = [], 0, []
    for i, t in enumerate(texts):
        held.append(t.as_py() or "")
        rows.append(i)
        size += len(held[-1])
        if size > _COUNTERS // 2 or len(held) == 4096 or i == len(texts) - 1:
            out[rows] = _entropies(held)
            held, size, rows = [], 0, []
    return pa.array(out, mask=texts.is_null().to_numpy(zero_copy_only=False))


def entropy(c: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text, null for none. Counted in Arrow batches."""
    return F.arrow_udf(_entropy_batch, "double")(c)


#: Formats of dates in text that are understood, in order.
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd"]


def parse_date(text: Column) -> Column:
    """A timestamp without zone, or null."""
    text = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS])


def replace_each(text: Column, pattern: str, put: object) -> Column:
    """Every match of a Java pattern replaced by put(match): a function from Column to Column."""
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(parts, found, lambda p, m: F.concat(p, F.coalesce(put(m), F.lit("")))), "")  # type: ignore[operator]


def redact_url(c: Column) -> Column:
    """A connection address without its password."""
    return F.regexp_replace(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/@:]*):[^/]*@", "$1:***@")
