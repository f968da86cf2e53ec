from __future__ import annotations

import hashlib
import hmac
import math
import re
import statistics
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroudlake.functions import checks, feistel
from shroudlake.operators import masking  # noqa: F401  (registers the strategies)
from shroudlake.operators.registry import MaskContext, build, lookup, register_function, strategies

CTX = MaskContext("t", "c", "fixture-salt-v1")
NAMES = [s.name for s in strategies()]


def run(spark, strategy, values, kind="string", ctx=CTX, **params):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    out = df.select("i", build(strategy, F.col("c"), df.schema["c"].dataType, ctx, params).alias("m"))
    return [r.m for r in out.orderBy("i").collect()]


@pytest.mark.parametrize(
    ("strategy", "value", "params", "expected"),
    [
        ("pattern_mask", "+1-555-0100", {"keep_first": 3, "keep_last": 4}, "+1-****0100"),
        ("pattern_mask", "111-22-3333", {"keep_last": 4}, "*******3333"),
        ("pattern_mask", "123456789", {"keep_first": 2, "keep_last": 2}, "12*****89"),
        ("pattern_mask", "123456789", {"keep_first": 1, "keep_last": 1, "mask_length": 3}, "1***9"),
        ("pattern_mask", "abc", {"keep_first": 2, "keep_last": 2}, "***"),
        ("credit_card_mask", "4532-0150-1234-5678", {}, "****-****-****-5678"),
        ("credit_card_mask", "12", {}, "**"),
        ("date_truncate", "2024-07-25", {}, "2024-01-01"),
        ("date_truncate", "2024-07-25", {"level": "month"}, "2024-07-01"),
        ("date_truncate", "soon", {}, "soon"),
        ("regex_replace", "Order #12345", {"pattern": r"\d+", "replacement": "XXXXX"}, "Order #XXXXX"),
        ("regex_replace", "a$b", {"pattern": r"\$", "replacement": r"\\$1"}, r"a\$1b"),
        ("text_redact", "Reach me at contact@test.org", {"placeholder_style": "mask"}, "Reach me at ****************"),
        ("text_redact", "card 4111 1111 1111 1111, not 4111 1111 1111 1112", {"entities": ["credit_card"]}, "card [REDACTED_CARD], not 4111 1111 1111 1112"),
        ("email_mask", " john.doe@acme.com ", {}, "j******e@acme.com"),
        ("email_mask", "a@b@c.org", {}, "a*b@c.org"),
        ("email_mask", "nobody", {}, "******"),
        ("round_to", "1234", {"step": 100}, "1200.0"),
        ("constant", "x", {}, "REDACTED"),
    ],
)
def test_known_answers(spark, strategy, value, params, expected):
    assert run(spark, strategy, [value], **params) == [expected]


def test_hash_known_answers(spark):
    assert run(spark, "hash", [101, 102, 103], "long", min_int=20000, max_int=29999) == [27629, 22720, 20022]
    key, value = b"fixture-salt-v1", "çığ ☃"
    digest = hmac.new(key, value.encode(), hashlib.sha256).hexdigest()
    assert run(spark, "hash", [value], length=64) == [digest]
    assert run(spark, "uuid", [value]) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, f"fixture-salt-v1:{value}"))]
    big = run(spark, "hash", ["a"], as_integer=True, min_int=0, max_int=10**12)[0]
    assert big == int(hmac.new(key, b"a", hashlib.sha256).hexdigest()[:16], 16) % (10**12 + 1)


@pytest.mark.parametrize("name", NAMES)
def test_nulls_and_blanks(spark, name):
    """Null gives null in every strategy; empty and blank texts don't fail."""
    params = {"json_mask": {"rules": {"a": "nullify"}}, "choice": {"choices": ["x"]}}.get(name, {})
    out = run(spark, name, [None, "", "   ", "x"], **params)
    assert out[0] is None and len(out) == 4


@pytest.mark.parametrize("name", sorted(set(NAMES) - {"nullify", "constant"}))
def test_same_value_same_result(spark, name):
    params = {"json_mask": {"rules": {"a": "hash"}}, "choice": {"choices": ["x", "y", "z"]}}.get(name, {})
    values = ["5425233430109823", "a.b@c.org", "2024-02-03", '{"a": 1}'] * 2
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    masked = build(name, F.col("c"), T.StringType(), CTX, params).alias("m")
    one = [r.m for r in df.repartition(1).select("i", masked).orderBy("i").collect()]
    many = [r.m for r in df.repartition(7).select("i", masked).orderBy("i").collect()]
    assert one == many and one[:4] == one[4:]


def test_unknown_names_and_parameters():
    with pytest.raises(KeyError, match="unknown strategy"):
        lookup("nothing")
    with pytest.raises(ValueError, match="no parameter"):
        build("hash", None, T.StringType(), CTX, {"lenght": 3})


def test_python_functions_as_strategies(spark):
    register_function("shout", lambda v: v.upper() + "!")
    assert run(spark, "shout", ["a", None]) == ["A!", None]


def test_numbers(spark):
    assert run(spark, "round_to", [15, 25, None], "long", step=10) == [20, 20, None]
    values = [float(v) for v in range(100, 400)]
    out = run(spark, "jitter", values, "double", percentage=10)
    assert all(0.9 * a <= b <= 1.1 * a for a, b in zip(values, out, strict=True)) and len(set(out)) == 300
    assert all(isinstance(v, int) for v in run(spark, "jitter", [1000, 2000], "long"))
    assert run(spark, "jitter", ["many"]) == ["many"]
    drawn = run(spark, "range_random", [str(i) for i in range(2000)], min_val=1, max_val=6)
    assert set(drawn) == {1, 2, 3, 4, 5, 6}


def test_noise_distributions(spark):
    values = [0.0] * 4000
    ctx = MaskContext("t", "c", "salt", nonce=F.col("i"))
    laplace = run(spark, "dp", values, "double", ctx, epsilon=0.5, sensitivity=2.0)
    assert abs(statistics.fmean(laplace)) < 0.4 and abs(statistics.fmean(map(abs, laplace)) - 4) < 0.4
    normal = run(spark, "gaussian_noise", values, "double", ctx, epsilon=1.0, sensitivity=1.0)
    sigma = math.sqrt(2 * math.log(1.25 / 1e-5))
    assert abs(statistics.stdev(normal) - sigma) < 0.3
    for bad in ({"epsilon": 0}, {"sensitivity": -1}, {"mechanism": "gaussian", "delta": 1.0}):
        with pytest.raises(ValueError, match="must be"):
            run(spark, "dp", [1.0], "double", **bad)


def test_dates(spark):
    out = run(spark, "date_shift", ["2024-03-01", "2024-03-01 10:20:30", "2024-03-01T10:20:30", "no"], max_days_forward=5, max_days_backward=5)
    assert re.fullmatch(r"2024-0[23]-\d\d", out[0]) and out[1].endswith(" 10:20:30") and out[2].endswith("T10:20:30") and out[3] == "no"


def test_scramble_keeps_classes(spark):
    text = "Ab9-é É.z"
    out = run(spark, "scramble", [text])[0]
    shape = lambda s: ["U" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else c for c in s]
    assert shape(out) == shape(text)


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_encryption_keeps_shapes(spark):
    cards = ["4111-1111-1111-1111", "378282246310005", "5555 5555 5555 4444"]
    out = run(spark, "fpe_cc", cards)
    assert all(luhn(x) and re.sub(r"\d", "9", x) == re.sub(r"\d", "9", c) and x[0] == c[0] for x, c in zip(out, cards, strict=True))
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", run(spark, "fpe_ssn", ["123-45-6789"])[0])
    df = spark.createDataFrame([("10000000146",)], "c string")
    assert df.select(checks.tckn_valid(build("fpe_tckn", F.col("c"), T.StringType(), CTX))).first()[0]
    phone = run(spark, "fpe_phone", ["+90 (532) 123-45-67", "12"])
    assert phone[0].startswith("+90 (") and phone[0] != "+90 (532) 123-45-67" and phone[1] == "12"
    mails = [f"user{i}@x.org" for i in range(200)]
    hidden = run(spark, "fpe_email", mails)
    assert len(set(hidden)) == 200 and all(m.endswith("@x.org") for m in hidden)
    assert len(set(run(spark, "fpe", [f"{i:04d}" for i in range(10000)]))) == 10000
    assert run(spark, "fpe", ["zz"], alphabet="abcz") != ["zz"]


def test_feistel_in_expressions_is_that_in_python(spark):
    key = b"k" * 32
    values = [("7" * n)[: n - 1] + str(n % 10) for n in range(1, 37)] + ["9" * n for n in range(2, 37)]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    for rounds in (8, 9):
        rows = df.select("c", feistel.encrypt_digits(F.col("c"), key, "tweak", rounds).alias("m")).collect()
        assert all(r.m == feistel.encrypt_text(r.c, key, b"tweak", feistel.DIGITS, rounds) for r in rows)
    long = df.limit(1).select(feistel.encrypt_digits(F.lit("1" * 80), key, "t")).first()[0]
    assert len(long) == 80 and long.isdigit() and long != "1" * 80


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_masks_keep_length(spark, texts):
    texts = [t for t in texts if "\x00" not in t and not any(0xD800 <= ord(c) < 0xE000 for c in t)] or ["a"]
    out = run(spark, "pattern_mask", texts, keep_first=2, keep_last=1)
    assert [len(x) for x in out] == [len(t) for t in texts]
    assert out == [t[:2] + "*" * (len(t) - 3) + t[-1:] if len(t) > 3 else "*" * len(t) for t in texts]


def test_redaction_is_that_of_plain_patterns(spark):
    """All entities with checksums, against Python over crafted texts."""
    from shroudlake.operators.strategies import ENTITIES

    def tckn(s):
        d = [int(c) for c in s]
        return (sum(d[0:9:2]) * 7 - sum(d[1:8:2])) % 10 == d[9] and sum(d[:10]) % 10 == d[10]

    def iban(s):
        moved = s[4:] + s[:4]
        return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1

    valid = {"iban": iban, "credit_card": lambda s: 13 <= sum(map(str.isdigit, s)) <= 19 and luhn(s), "tckn": tckn}
    texts = [
        "mail a.b@c.org and x@y.co.uk", "TR330006100519786457841326 or TR330006100519786457841327", "4111 1111 1111 1111 / 4111-1111-1111-1112", "id 10000000146 no 10000000147",
        "ssn 123-45-6789", "ip 192.168.1.10 and 300.1.1.1", "call +1 555-123-4567 or (555) 123 4567", "", "nothing here", "4111111111111111 a@b.co 10.0.0.1 123-45-6789",
    ]

    def plain(t):
        for name, (label, pattern) in ENTITIES.items():
            check = valid.get(name, lambda s: True)
            t = re.sub(pattern, lambda m, check=check, label=label: f"[REDACTED_{label}]" if check(m[0]) else m[0], t)
        return t

    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, "text_redact", texts) == [plain(t) for t in texts]
