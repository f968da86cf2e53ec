"""Quality rules as a bitmask ledger."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is measured once for each text; the ledger keeps all of it.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_dup_words", "n_digits", "n_plain_words", "n_distinct", "longest", "n_bullets", "n_open_ends", "n_control"]

#: name -> the condition (SQL over MEASURES) under which a text fails; the position is the bit. Append only.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "shouting": "2 * n_upper > n_letters",
    # five lines at least that hold half of the words: a short text whose few lines repeat isn't junk yet
    "repeated_lines": "n_dup_lines >= 5 AND 2 * n_dup_words > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 16 * n_words",
    "mostly_digits": "10 * n_digits > 3 * word_chars",
    "words_without_letters": "10 * (n_words - n_plain_words) > 4 * n_words",
    "poor_vocabulary": "n_words >= 100 AND 20 * n_distinct < n_words AND n_distinct < 50",
    "endless_word": "longest > 1000",
    "bullet_list": "n_lines >= 5 AND 10 * n_bullets > 9 * n_lines",
    "broken_off_lines": "n_lines >= 5 AND 10 * n_open_ends > 3 * n_lines",
    "control_characters": "100 * n_control > word_chars",
}

#: version -> the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "many_symbols"),
    "v2": ("too_few_words", "repeated_windows", "many_symbols", "shouting", "word_length"),
    "v3": tuple(RULES),
}
#: The policy in force.
CURRENT = "v3"

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
#: ASCII control characters but white space, and what stands for bytes that couldn't be decoded.
_CONTROL = bytes([*range(9), *range(14, 32), 127])
_UNKNOWN = "\ufffd"
_BULLETS = (b"-", b"*", b"\xe2\x80\xa2")
_OPEN_ENDS = (b"...", b"\xe2\x80\xa6")
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a text; null counts as empty.

    Words are split at ASCII white space; lines at \\n, and only lines with a word count. n_dup_lines counts lines that
    equal an earlier line, n_dup_words their words, n_bullets those that begin with a bullet, n_open_ends those that end
    with an ellipsis. n_repeat_words counts the words in any three-word window that occurs twice or more in the text.
    n_plain_words counts words with a letter or anything beyond ASCII; longest is the longest word in bytes.
    """
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    seen, dup, dup_words, lines, bullets, open_ends = set(), 0, 0, 0, 0, 0
    for line in raw.split(b"\n"):
        bare = line.strip()
        if bare:
            lines += 1
            bullets += bare.startswith(_BULLETS)
            open_ends += bare.endswith(_OPEN_ENDS)
            if line in seen:
                dup += 1
                dup_words += len(line.split())
            seen.add(line)
    repeat = 0
    if len(words) >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            covered = -1  # the last word that is counted
            for i, window in enumerate(windows):
                if counts[window] > 1:
                    repeat += i + 2 - max(covered, i - 1)
                    covered = i + 2
    size = len(raw)
    upper, lower, digits, control = (size - len(raw.translate(None, x)) for x in (_UPPER, _LOWER, _DIGITS, _CONTROL))
    kinds = set(words)
    odd = {w for w in kinds if not _LETTER.search(w)}
    plain = len(words) - sum(map(odd.__contains__, words)) if odd else len(words)
    chars, symbols = len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS))
    return (len(words), chars, symbols, dup, repeat, lines, upper, upper + lower, dup_words, digits, plain, len(kinds), max(map(len, kinds), default=0), bullets, open_ends, control + text.count(_UNKNOWN))


def mask_of(rules: tuple[str, ...] | list[str]) -> int:
    """The bits of the named rules."""
    names = list(RULES)
    return sum(1 << names.index(x) for x in set(rules))


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every rule evaluated once for each row: the key, MEASURES and failed_bits (bit k: the k-th of RULES fails).

    The columns in `carry` come along unchanged, before the measures. Rows stay rows: repeated ones give repeated
    ones. A null or empty text has 0 in all measures, so it fails too_few_words; a null key stays null. An empty
    table gives an empty ledger. Other columns are left out.
    """
    first = list(dict.fromkeys([key, *carry]))
    kept = df.select(*first, *([text] if text not in first else []))
    fields = [f for f in kept.schema.fields if f.name in first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(measure(x) for x in batch.column(text).to_pylist()), strict=True)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in first), *(pa.array(x, pa.int64()) for x in found)], names=[*first, *MEASURES])

    schema = type(kept.schema)(fields)
    for m in MEASURES:
        schema = schema.add(m, "long")
    out = kept.mapInArrow(run, schema)
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())), F.lit(0))
    return out.withColumn("failed_bits", bits.cast("long"))


def apply_policy(ledger_df: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds base_failed and kept under a version of the policy; measures nothing again."""
    return ledger_df.withColumn("base_failed", F.col("failed_bits").bitwiseAND(F.lit(mask_of(POLICIES["base"]))) != 0).withColumn(
        "kept", F.col("failed_bits").bitwiseAND(F.lit(mask_of(POLICIES[version]) | mask_of(POLICIES["base"]))) == 0
    )


def ablation(ledger_df: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rows that fail it, that fail it alone, and that would stay without it.

    Rows are first counted by their bits (at most 2 ** rules groups, whatever the input), then combined bitwise.
    """
    mask = mask_of(POLICIES[version])
    counts = ledger_df.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask_of([name])).cast("long").alias("bit")) for name in POLICIES[version]]))
    rows = counts.select("bits", "n", each.alias("_r")).select("bits", "n", "_r.*")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    hit, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    return rows.groupBy("rule").agg(total(hit)("failed"), total(alone)("failed_alone"), total((F.col("bits") == 0) | alone)("kept_without"))
