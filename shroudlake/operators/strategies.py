"""The 25 masking strategies as Column expressions. Null gives null unless a strategy says otherwise."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checks, crypto, feistel, synthetic
from .registry import MaskContext, register, text_of

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBER = (*_WHOLE, T.FloatType, T.DoubleType, T.DecimalType)


def _bits(c: Column, kind: T.DataType, ctx: MaskContext, deterministic: bool, nonce: str = "") -> Column:
    """60 bits from the value, or fresh ones."""
    if deterministic:
        return crypto.draw(ctx.prefix, text_of(c, kind), nonce)
    return (F.rand() * float(1 << 53)).cast("long") * 128 + (F.rand() * 128).cast("long")


@register("deterministic_hash", "hash", "hmac", "pseudonymize")
def deterministic_hash(c: Column, kind: T.DataType, ctx: MaskContext, *, output_format: str = "hex", length: int = 16, as_integer: bool = False, min_int: int = 100000, max_int: int = 999999999, salt: str = "", prefix: str = "", suffix: str = "") -> Column:
    """A keyed hash: text, or a whole number in a range for whole numbers; equal values match in all tables."""
    digest = crypto.hmac_sha256(text_of(c, kind), salt or ctx.salt)
    if as_integer or isinstance(kind, (*_WHOLE, T.BooleanType)):
        if min_int > max_int:
            raise ValueError(f"min_int {min_int} is above max_int {max_int}")
        return crypto.u64_mod(digest, max_int - min_int + 1) + F.lit(min_int).cast("long")
    text = F.base64(F.unhex(digest)) if output_format == "base64" else digest
    return F.when(c.isNotNull(), F.concat(F.lit(prefix), F.substring(text, 1, length), F.lit(suffix)))


@register("uuid_hash", "uuid")
def uuid_hash(c: Column, kind: T.DataType, ctx: MaskContext, *, salt: str = "") -> Column:
    """A version 5 UUID of salt and value."""
    return F.when(c.isNotNull(), crypto.uuid5(F.concat(F.lit(f"{salt or ctx.salt}:"), text_of(c, kind))))


@register("faker", "fake", "synthetic")
def faker(c: Column, kind: T.DataType, ctx: MaskContext, *, provider: str = "name", locale: str | None = None, deterministic: bool = True, preserve_domain: bool = False) -> Column:
    """A synthetic value from short vocabularies, the same for the same value."""
    value = text_of(c, kind) if deterministic else F.concat(F.lit("r"), F.rand().cast("string"))
    locale = locale or ctx.locale
    out = synthetic.synthetic(ctx.prefix, value, provider, locale)
    if preserve_domain and provider.lower().strip() in ("email", "safe_email", "company_email") and isinstance(kind, T.StringType):
        kept = F.concat(synthetic.synthetic(ctx.prefix, value, "user_name", locale), F.lit("@"), F.substring_index(c, "@", -1))
        out = F.when(c.contains("@"), kept).otherwise(out)
    return F.when(c.isNotNull(), out)


def _mask_middle(text: Column, keep_first: int, keep_last: int, mask_char: str, mask_length: int = 0) -> Column:
    n, keep = F.length(text), keep_first + keep_last
    middle = F.lit(mask_char * mask_length) if mask_length > 0 else F.repeat(F.lit(mask_char), n - keep)
    tail = F.right(text, F.lit(keep_last)) if keep_last > 0 else F.lit("")
    return F.when(n <= keep, F.repeat(F.lit(mask_char), n)).otherwise(F.concat(F.substring(text, 1, keep_first) if keep_first > 0 else F.lit(""), middle, tail))


@register("pattern_mask", "mask", "redact")
def pattern_mask(c: Column, kind: T.DataType, ctx: MaskContext, *, mask_char: str = "*", keep_first: int = 0, keep_last: int = 0, mask_length: int = 0) -> Column:
    """Keeps the first and last characters; a text no longer than those is masked whole."""
    return F.when(c.isNotNull(), _mask_middle(text_of(c, kind), keep_first, keep_last, mask_char, mask_length))


@register("email_mask")
def email_mask(c: Column, kind: T.DataType, ctx: MaskContext, *, mask_char: str = "*", keep_first: int = 1, keep_last: int = 1, preserve_domain: bool = True) -> Column:
    """Masks the part before the last @; without @, everything."""
    text = F.trim(text_of(c, kind))
    domain = F.substring_index(text, "@", -1)
    local = F.substr(text, F.lit(1), F.length(text) - F.length(domain) - 1)
    masked = F.concat(_mask_middle(local, keep_first, keep_last, mask_char), F.lit("@"), domain if preserve_domain else F.lit("example.com"))
    return F.when(c.isNotNull(), F.when(text.contains("@"), masked).otherwise(F.repeat(F.lit(mask_char), F.length(text))))


@register("credit_card_mask")
def credit_card_mask(c: Column, kind: T.DataType, ctx: MaskContext, *, mask_char: str = "*") -> Column:
    """Three masked groups and the last four digits."""
    text = text_of(c, kind)
    digits = checks.digits_of(text)
    group = mask_char * 4
    return F.when(F.length(digits) < 4, F.repeat(F.lit(mask_char), F.length(text))).otherwise(F.concat(F.lit(f"{group}-{group}-{group}-"), F.right(digits, F.lit(4))))


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's dialect, with Python's Unicode classes."""
    return "(?U)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<", "(?<", pattern)).replace(r"\Z", r"\z")


def java_replacement(text: str) -> str:
    """A Python replacement in Java's dialect."""
    out = re.sub(r"\\g<(\w+)>", lambda m: f"\x00{m[1]}\x01", re.sub(r"\\(\d{1,2})", lambda m: f"\x00{int(m[1])}\x01", text))
    out = out.replace("\\n", "\n").replace("\\t", "\t").replace("\\\\", "\\").replace("\\", "\\\\").replace("$", "\\$")
    return re.sub("\x00(\\w+)\x01", lambda m: f"${m[1]}" if m[1].isdigit() else f"${{{m[1]}}}", out)


@register("regex_replace", "regex")
def regex_replace(c: Column, kind: T.DataType, ctx: MaskContext, *, pattern: str = ".", replacement: str = "*") -> Column:
    """Every match of a pattern replaced."""
    return F.regexp_replace(text_of(c, kind), F.lit(java_pattern(pattern)), F.lit(java_replacement(replacement)))


def _number(c: Column, kind: T.DataType) -> Column:
    return c.cast("double") if isinstance(kind, _NUMBER) else F.trim(text_of(c, kind)).try_cast("double")


def _clamp(x: Column, low: float | None, high: float | None) -> Column:
    x = F.greatest(x, F.lit(float(low))) if low is not None else x
    return F.least(x, F.lit(float(high))) if high is not None else x


def _shape(x: Column, kind: T.DataType, decimals: int | None, as_integer: bool = False) -> Column:
    """Whole numbers stay whole; decimals round to the nearest, half to even."""
    if as_integer or (isinstance(kind, _WHOLE) and decimals is None):
        return F.rint(x).cast("long")
    return F.bround(x, decimals) if decimals is not None else x


def _or_value(c: Column, kind: T.DataType, number: Column, out: Column) -> Column:
    """out where the value is a number; else the value, as text if it is one."""
    if isinstance(kind, _NUMBER):
        return F.when(c.isNotNull(), out)
    return F.when(number.isNull(), text_of(c, kind)).otherwise(out.cast("string"))


@register("jitter", "numeric_noise", "noise")
def jitter(c: Column, kind: T.DataType, ctx: MaskContext, *, percentage: float = 10.0, distribution: str = "uniform", decimals: int | None = None, min_val: float | None = None, max_val: float | None = None, deterministic: bool = True) -> Column:
    """Multiplies numbers by a factor near 1, uniform or Gaussian."""
    share, number = percentage / 100.0, _number(c, kind)
    if distribution == "gaussian":
        normal = crypto.draw_normal(ctx.prefix, text_of(c, kind)) if deterministic else F.randn()
        factor = F.lit(1.0) + normal * (share / 2.0)
    else:
        factor = F.lit(1.0 - share) + crypto.draw_unit(_bits(c, kind, ctx, deterministic)) * (2.0 * share)
    return _or_value(c, kind, number, _shape(_clamp(number * factor, min_val, max_val), kind, decimals))


@register("range_random", "random_int", "random_float", presets={"random_float": {"as_integer": False}})
def range_random(c: Column, kind: T.DataType, ctx: MaskContext, *, min_val: float = 0, max_val: float = 100, as_integer: bool = True, deterministic: bool = True) -> Column:
    """A number of a range that depends on the value alone."""
    bits = _bits(c, kind, ctx, deterministic)
    if as_integer:
        return F.when(c.isNotNull(), crypto.draw_int(bits, int(min_val), int(max_val)))
    return F.when(c.isNotNull(), F.lit(float(min_val)) + crypto.draw_unit(bits) * (float(max_val) - float(min_val)))


@register("round_to", "round", "bucket")
def round_to(c: Column, kind: T.DataType, ctx: MaskContext, *, step: float = 10) -> Column:
    """The nearest multiple of a step, half to even."""
    number = _number(c, kind)
    out = F.rint(number / float(step)) * float(step)
    return _or_value(c, kind, number, out.cast("long") if isinstance(kind, _WHOLE) else out)


def _date(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    return checks.parse_date(text_of(c, kind))


@register("date_shift", "shift_date", "date_offset")
def date_shift(c: Column, kind: T.DataType, ctx: MaskContext, *, max_days_forward: int = 30, max_days_backward: int = 30, preserve_day_of_week: bool = False, deterministic: bool = True) -> Column:
    """Moves dates by whole days, the same for the same value; text keeps its form, and other text passes."""
    days = crypto.draw_int(_bits(c, kind, ctx, deterministic), -max_days_backward, max_days_forward)
    if preserve_day_of_week:
        days = F.floor(days / 7) * 7
    days = days.cast("int")
    if isinstance(kind, T.DateType):
        return F.date_add(c, days)
    moved = _date(c, kind) + F.make_dt_interval(days)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return moved.cast(kind)
    text = F.trim(text_of(c, kind))
    micros = F.date_format(moved, "SSSSSS")
    iso = F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)))
    out = F.when(text.contains(" "), F.date_format(moved, "yyyy-MM-dd HH:mm:ss")).when(text.contains("T"), iso).otherwise(F.date_format(moved, "yyyy-MM-dd"))
    return F.coalesce(out, text_of(c, kind))


@register("date_truncate", "truncate_date", "generalize_date")
def date_truncate(c: Column, kind: T.DataType, ctx: MaskContext, *, level: str = "year") -> Column:
    """The first day of the year or month; timestamps keep their time of day."""
    if level not in ("year", "month"):
        return c
    if isinstance(kind, T.DateType):
        return F.trunc(c, level)
    moment = _date(c, kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        start = F.date_trunc("day", moment).cast("timestamp_ntz")
        return (F.date_trunc(level, moment).cast("timestamp_ntz") + (moment - start)).cast(kind)
    return F.coalesce(F.date_format(F.date_trunc(level, moment), "yyyy-MM-dd"), text_of(c, kind))


@register("nullify", "null", "set_null")
def nullify(c: Column, kind: T.DataType, ctx: MaskContext) -> Column:
    """Null."""
    return F.lit(None).cast(kind)


@register("constant", "fixed", "static")
def constant(c: Column, kind: T.DataType, ctx: MaskContext, *, value_to_set: Any = "REDACTED", keep_null: bool | None = None) -> Column:
    """A fixed value; null stays null unless the rule says otherwise."""
    keep = ctx.keep_null if keep_null is None else keep_null
    return F.when(c.isNotNull(), F.lit(value_to_set)) if keep else F.lit(value_to_set)


@register("choice", "random_choice", "pick")
def choice(c: Column, kind: T.DataType, ctx: MaskContext, *, choices: list | None = None, deterministic: bool = True) -> Column:
    """One of a list; without a list, the value."""
    if not choices:
        return c
    return F.when(c.isNotNull(), crypto.pick(_bits(c, kind, ctx, deterministic), choices))


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


@register("scramble", "shuffle_chars")
def scramble(c: Column, kind: T.DataType, ctx: MaskContext, *, deterministic: bool = True) -> Column:
    """Letters and digits replaced by others of their class; all else stays."""
    text = text_of(c, kind)
    seed = F.sha2(F.concat(F.lit(ctx.prefix), text if deterministic else F.rand().cast("string")), 256)

    def one(x: Column, i: Column) -> Column:
        bits = F.conv(F.substring(F.sha2(F.concat(seed, i.cast("string")), 256), 1, 7), 16, 10).cast("long")
        at = lambda letters: F.substr(F.lit(letters), (bits % len(letters) + 1).cast("int"), F.lit(1))
        return F.when(x.rlike(r"\p{Lu}"), at(_UPPER)).when(x.rlike(r"\p{Ll}"), at(_LOWER)).when(x.rlike(r"\p{Nd}"), at(_DIGITS)).otherwise(x)

    return F.when(c.isNotNull(), F.array_join(F.transform(F.filter(F.split(text, ""), lambda x: x != ""), one), ""))


@register("tckn", "turkish_id")
def tckn(c: Column, kind: T.DataType, ctx: MaskContext, *, deterministic: bool = True) -> Column:
    """A valid Turkish identity number."""
    bits = _bits(c, kind, ctx, deterministic)
    nine = (F.lit(100_000_000) + bits % 900_000_000).cast("string")
    return F.when(c.isNotNull(), F.concat(nine, checks.tckn_check_digits(nine)))


@register("differential_privacy", "dp", "laplace_noise", "gaussian_noise", "dp_noise", presets={"laplace_noise": {"mechanism": "laplace"}, "gaussian_noise": {"mechanism": "gaussian"}})
def differential_privacy(
    c: Column, kind: T.DataType, ctx: MaskContext, *, epsilon: float = 1.0, sensitivity: float = 1.0, mechanism: str = "laplace", delta: float = 1e-5, clip_min: float | None = None, clip_max: float | None = None,
    min_val: float | None = None, max_val: float | None = None, decimals: int | None = None, as_integer: bool = False, deterministic: bool = True, track_budget: bool = True,
) -> Column:
    """Calibrated Laplace or Gaussian noise between bounds. Seeded noise repeats for the same value and row key."""
    if epsilon <= 0 or sensitivity <= 0:
        raise ValueError("epsilon and sensitivity must be above 0")
    number, gaussian = _number(c, kind), mechanism.lower() in ("gaussian", "normal")
    if gaussian and not 0 < delta < 1:
        raise ValueError("delta must be between 0 and 1")
    nonce = ctx.nonce.cast("string") if ctx.nonce is not None else F.lit("")
    prefix = f"dp\x1f{ctx.prefix}"
    if gaussian:
        sigma = math.sqrt(2.0 * math.log(1.25 / delta)) * sensitivity / epsilon
        noise = (crypto.draw_normal(prefix, text_of(c, kind), F.concat(F.lit("\x1f"), nonce)) if deterministic else F.randn()) * sigma
    else:
        bits = crypto.draw(prefix, text_of(c, kind), F.concat(F.lit("\x1f"), nonce)) if deterministic else _bits(c, kind, ctx, False)
        u = crypto.draw_unit(bits) - 0.5
        noise = F.signum(u) * F.log(1.0 - 2.0 * F.abs(u)) * (-sensitivity / epsilon)
    low, high = clip_min if clip_min is not None else min_val, clip_max if clip_max is not None else max_val
    out = _clamp(_clamp(number, clip_min, clip_max) + noise, low, high)
    return _or_value(c, kind, number, _shape(out, kind, decimals, as_integer))


#: What each entity looks like, in the order of redaction. Results depend on them.
ENTITIES: dict[str, tuple[str, str]] = {
    "email": ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    "iban": ("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]?){0,16}\b"),
    "credit_card": ("CARD", r"\b(?:\d[ -]*?){13,19}\b"),
    "tckn": ("TCKN", r"\b[1-9]\d{10}\b"),
    "ssn": ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    "ipv4": ("IP", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
    "phone": ("PHONE", r"(?:\+?\d{1,3}[ -.]?)?\(?\d{3}\)?[ -.]?\d{3}[ -.]?\d{4}\b"),
}
_VALID = {"iban": checks.iban_valid, "credit_card": lambda m: checks.luhn_valid(m) & F.length(checks.digits_of(m)).between(13, 19), "tckn": checks.tckn_valid}


@register("text_redact", "free_text_redact", "unstructured_redact")
def text_redact(c: Column, kind: T.DataType, ctx: MaskContext, *, entities: list[str] | None = None, placeholder_style: str = "token", mask_char: str = "*", validate_checksums: bool = True) -> Column:
    """Personal data in free text replaced by tokens or masks."""
    wanted = {"ipv4" if e == "ip" else e for e in entities} if entities else set(ENTITIES)
    if unknown := wanted - set(ENTITIES):
        raise ValueError(f"unknown entities: {', '.join(sorted(unknown))}")
    text = text_of(c, kind)
    for name, (label, pattern) in ENTITIES.items():
        if name not in wanted:
            continue
        valid = _VALID.get(name) if validate_checksums else None
        if valid is None and placeholder_style == "token":
            text = F.regexp_replace(text, F.lit(pattern), F.lit(f"[REDACTED_{label}]"))
            continue

        def put(m: Column, label: str = label, valid: Any = valid) -> Column:
            new = F.lit(f"[REDACTED_{label}]") if placeholder_style == "token" else F.repeat(F.lit(mask_char), F.length(m))
            return F.when(valid(m), new).otherwise(m) if valid is not None else new

        # texts without a match skip the lists
        text = F.when(text.rlike(pattern), checks.replace_each(text, pattern, put)).otherwise(text)
    return text


def _with_digits(text: Column, body: Any) -> Column:
    """body(text, its digits), each computed once."""
    return crypto.let(F.struct(text.alias("t"), checks.digits_of(text).alias("d")), lambda x: body(x["t"], x["d"]))


def _encrypt_all_digits(text: Column, ctx: MaskContext, rounds: int = 10, tweak: str | None = None) -> Column:
    key = feistel.subkey("fpe", ctx.salt, ctx.scope)
    return _with_digits(text, lambda t, d: F.when(F.length(d) == 0, t).otherwise(feistel.put_digits(t, feistel.encrypt_digits(d, key, tweak or ctx.scope, rounds))))


@register("fpe", "format_preserving_encryption", "ff1", "ff3_1")
def fpe(c: Column, kind: T.DataType, ctx: MaskContext, *, alphabet: str = feistel.DIGITS, radix: int | None = None, tweak: str | None = None, preserve_format: bool = True, rounds: int = 10) -> Column:
    """A keyed Feistel permutation of the characters of an alphabet; all others stay in place."""
    letters = feistel.ALPHABETS[radix] if radix in feistel.ALPHABETS else alphabet or feistel.DIGITS
    if len(letters) < 2 or len(set(letters)) < len(letters):
        raise ValueError("an alphabet needs two characters or more, each once")
    text = text_of(c, kind)
    if letters == feistel.DIGITS:
        return F.when(c.isNotNull(), _encrypt_all_digits(text, ctx, rounds, tweak))
    key = feistel.subkey("fpe", ctx.salt, ctx.scope)
    return feistel.encrypt_in_place(key, letters, rounds)(text, F.lit(tweak or ctx.scope))


@register("fpe_credit_card", "fpe_cc", "format_preserving_cc")
def fpe_credit_card(c: Column, kind: T.DataType, ctx: MaskContext, *, preserve_prefix_len: int = 1, preserve_suffix_len: int = 0, preserve_prefix: int | None = None, preserve_suffix: int | None = None, luhn_checksum: bool = True, preserve_delimiters: bool = True) -> Column:
    """Encrypts the middle of card numbers and sets a valid check digit; the issuer's prefix stays."""
    preserve_prefix_len = preserve_prefix if preserve_prefix is not None else preserve_prefix_len
    preserve_suffix_len = preserve_suffix if preserve_suffix is not None else preserve_suffix_len
    return _with_digits(text_of(c, kind), lambda text, digits: _card(text, digits, ctx, preserve_prefix_len, preserve_suffix_len, luhn_checksum, preserve_delimiters))


def _card(text: Column, digits: Column, ctx: MaskContext, preserve_prefix_len: int, preserve_suffix_len: int, luhn_checksum: bool, preserve_delimiters: bool) -> Column:
    n = F.length(digits)
    first = F.greatest(F.lit(1), F.least(F.lit(preserve_prefix_len), n - 6))
    last = F.lit(1) if luhn_checksum else F.greatest(F.lit(0), F.least(F.lit(preserve_suffix_len), n - first - 2))
    key = feistel.subkey("fpe_cc", ctx.salt, ctx.scope)
    middle = feistel.encrypt_digits(F.substr(digits, first + 1, n - first - last), key, F.concat(F.lit("cc:"), first.cast("string")), 8)
    body = F.concat(F.substr(digits, F.lit(1), first), middle)
    new = crypto.let(body, lambda b: F.concat(b, checks.luhn_check_digit(b) if luhn_checksum else F.substr(digits, n - last + 1, last)))
    return F.when(n < 12, _encrypt_all_digits(text, ctx)).otherwise(feistel.put_digits(text, new) if preserve_delimiters else new)


@register("fpe_phone", "fpe_phone_number", "format_preserving_phone")
def fpe_phone(c: Column, kind: T.DataType, ctx: MaskContext, *, preserve_country_code: bool = True, preserve_prefix_digits: int = 0) -> Column:
    """Encrypts phone numbers behind the country code; fewer than four digits stay."""
    return _with_digits(text_of(c, kind), lambda text, digits: _phone(text, digits, ctx, preserve_country_code, preserve_prefix_digits))


def _phone(text: Column, digits: Column, ctx: MaskContext, preserve_country_code: bool, preserve_prefix_digits: int) -> Column:
    n = F.length(digits)
    plain = F.least(F.lit(preserve_prefix_digits), n - 2) if preserve_prefix_digits > 0 else F.lit(0)
    first = F.when(F.trim(text).startswith("+"), F.when(n >= 11, n - 10).otherwise(1)).otherwise(plain) if preserve_country_code else plain
    key = feistel.subkey("fpe_phone", ctx.salt, ctx.scope)
    new = F.concat(F.substr(digits, F.lit(1), first), feistel.encrypt_digits(F.substr(digits, first + 1, n - first), key, F.concat(F.lit("phone:"), first.cast("string")), 8))
    return F.when(n < 4, text).otherwise(feistel.put_digits(text, new))


@register("fpe_national_id", "fpe_ssn", "fpe_tckn", "format_preserving_id", presets={"fpe_ssn": {"id_type": "ssn"}, "fpe_tckn": {"id_type": "tckn"}})
def fpe_national_id(c: Column, kind: T.DataType, ctx: MaskContext, *, id_type: str = "auto", validate_checksum: bool = True) -> Column:
    """Encrypts identity numbers: Turkish ones stay valid, social security numbers keep their dashes."""
    return _with_digits(F.trim(text_of(c, kind)), lambda text, digits: _identity(text, digits, ctx, id_type.lower(), validate_checksum))


def _identity(text: Column, digits: Column, ctx: MaskContext, which: str, validate_checksum: bool) -> Column:
    key = feistel.subkey("fpe_id", ctx.salt, ctx.scope)
    nine = feistel.encrypt_digits(F.substring(digits, 1, 9), key, F.concat(F.lit("id:"), F.length(digits).cast("string")), 8)
    return crypto.let(nine, lambda x: _identity_of(text, digits, x, ctx, which, validate_checksum))


def _identity_of(text: Column, digits: Column, nine: Column, ctx: MaskContext, which: str, validate_checksum: bool) -> Column:
    n = F.length(digits)
    other_first = (F.conv(F.substring(F.sha2(nine, 256), 1, 4), 16, 10).cast("long") % 9 + 1).cast("string")
    turkish = F.when(F.substring(nine, 1, 1) == "0", F.concat(other_first, F.substring(nine, 2, 8))).otherwise(nine)
    turkish = crypto.let(turkish, lambda x: F.concat(x, checks.tckn_check_digits(x) if validate_checksum else F.substring(digits, 10, 2)))
    dashed = F.concat_ws("-", F.substring(nine, 1, 3), F.substring(nine, 4, 2), F.substring(nine, 6, 4))
    is_turkish = F.lit(True) if which == "tckn" else ~text.rlike("[-/.]") if which == "auto" else F.lit(False)
    is_social = F.lit(which in ("ssn", "auto"))
    return F.when(is_turkish & (n == 11), turkish).when(is_social & (n == 9), F.when(text.contains("-") & (F.length(text) == 11), dashed).otherwise(nine)).otherwise(_encrypt_all_digits(text, ctx))


@register("fpe_email", "format_preserving_email")
def fpe_email(c: Column, kind: T.DataType, ctx: MaskContext, *, preserve_domain: bool = True, legacy_alphabet: bool = False) -> Column:
    """Encrypts the letters and digits before the first @ over lower-case letters and digits, which can be reversed.

    legacy_alphabet encrypts over both cases and lower-cases the result, so different addresses may meet.
    """
    text = F.trim(text_of(c, kind))
    local = F.substring_index(text, "@", 1)
    domain = F.substr(text, F.length(local) + 2)
    key = feistel.subkey("fpe_email", ctx.salt, ctx.scope)
    run = feistel.encrypt_in_place(key, feistel.ALPHABETS[62 if legacy_alphabet else 36], 8, lower=legacy_alphabet)
    new = run(local if legacy_alphabet else F.lower(local), F.concat(F.lit("email:"), F.coalesce(domain, F.lit(""))))
    out = F.when(text.contains("@"), F.when(F.length(local) == 0, text).otherwise(F.concat(new, F.lit("@"), domain if preserve_domain else F.lit("example.com")))).otherwise(new)
    return F.when(c.isNotNull(), out)
