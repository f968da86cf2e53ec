"""Sharding, quality, rules, mixing and token ids."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shroudlake.llm import common, quality, tokens
from shroudlake.llm.mixing import fair_queue, mix, targets
from shroudlake.llm.quality import FEATURES, score_quality, statistics
from shroudlake.llm.queries import tokenizer_path
from shroudlake.llm.rules import CURRENT, MEASURES, POLICIES, RULES, ablation, apply_policy, ledger, mask_of, measure
from shroudlake.llm.sharding import jump, shard

from .conftest import ROWS


def jump_one(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_one():
    keys = np.array([0, 1, 2, 10863919174838991, 2**60 - 1, 12345678901234567], np.int64)
    for n in (1, 2, 24, 25, 1000):
        assert jump(keys, n).tolist() == [jump_one(int(k), n) for k in keys]


def test_shards(spark, docs, empty):
    out = shard(docs, shards=5, appended=2).collect()
    assert len(out) == len(ROWS)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard == r.shard or r.grown_shard >= 5
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _ in ROWS)
    assert len({r.shard for r in out if r.doc_id == 7}) == 1
    again = shard(docs.repartition(7), shards=5, appended=2).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert shard(empty).collect() == []
    even = shard(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    counts = [r["count"] for r in even.groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) < 1.4 * min(counts)


def test_statistics_are_finite():
    for _, t, _ in ROWS:
        assert len(statistics(t)) == len(FEATURES) and np.isfinite(statistics(t)).all()


def test_quality_is_learned(spark, tables):
    labels = tables("labels")
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = score_quality(documents, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.9
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    flipped = score_quality(documents, labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))))
    same = out.join(flipped.select("doc_id", F.col("score").alias("other")), "doc_id").where(F.abs(F.col("score") - F.col("other")) > 1e-9)
    assert same.isEmpty()


def test_quality_is_that_of_plain_numpy(tables):
    """Moments by sums in Python, covariances and log-densities by numpy without factors."""
    documents, labels = tables("documents").collect(), {r.doc_id: r.quality for r in tables("labels").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    x = {r.doc_id: np.array(statistics(r.text)) for r in documents}
    learn = [(labels[i], np.rint(v * quality.UNIT) / quality.UNIT) for i, v in x.items() if i in labels and not held(i)]
    every = np.array([v for _, v in learn])
    center, scale = every.mean(axis=0), np.sqrt(np.maximum(every.var(axis=0), 1e-4))
    classes, d = {}, len(FEATURES)
    for label in (0, 1):
        z = (np.array([v for y, v in learn if y == label]) - center) / scale
        classes[label] = (len(z), z.mean(axis=0), (z - z.mean(axis=0)).T @ (z - z.mean(axis=0)))
    n = sum(c[0] for c in classes.values())
    pooled = sum(c[2] for c in classes.values()) / (n - 2)

    def density(label, v):
        m, mean, scatter = classes[label]
        pool = max(quality.POOL, min(1.0, 2 * d / m))
        cov = (1 - pool) * scatter / (m - 1) + pool * pooled
        cov = (1 - quality.RIDGE) * cov + quality.RIDGE * np.eye(d) * max(np.trace(cov) / d, 1e-3)
        diff = (v - center) / scale - mean
        return -0.5 * np.linalg.slogdet(cov)[1] - 0.5 * diff @ np.linalg.solve(cov, diff) + np.log((m + 1) / (n + 2))

    got = score_quality(tables("documents"), tables("labels")).collect()
    for r in got:
        want = 1 / (1 + np.exp(-np.clip(density(1, x[r.doc_id]) - density(0, x[r.doc_id]), -500, 500)))
        assert abs(r.score - want) < 1e-9 and r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.7)
    again = {r.doc_id: r.score for r in score_quality(tables("documents").repartition(7), tables("labels").repartition(3)).collect()}
    assert again == {r.doc_id: r.score for r in got}  # to the bit


def test_quality_of_edge_rows(spark, docs, empty, tables):
    labels = spark.createDataFrame([(7, 1), (7, 0), (3, 1), (5, 0), (None, 1), (6, None), (8, 5)], "doc_id long, quality int")
    out = score_quality(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert score_quality(empty, labels).collect() == []
    assert all(0 <= r.score <= 1 for r in score_quality(docs, labels.limit(0)).collect())


def measure_slowly(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    in_line = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    bullets = sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in lines)
    open_ends = sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines)
    control = len(re.findall("[\x00-\x08\x0e-\x1f\x7f\ufffd]", text))
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines), upper, upper + lower,
        sum(map(in_line, lines)) - sum(map(in_line, set(lines))), sum("0" <= c <= "9" for c in text), sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", w)) for w in words),
        len(set(words)), max((len(w.encode()) for w in words), default=0), bullets, open_ends, control,
    )


def fails(text):
    """The names of the rules that a text fails."""
    names = dict(zip(MEASURES, measure_slowly(text), strict=True))
    return [rule for rule, condition in RULES.items() if eval(condition.replace(" AND ", " and ").replace(" OR ", " or "), {}, names)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 1\n\t#|É\x1c\x00-*•.…\ufffd", max_size=60))
def test_measures(text):
    assert measure(text) == measure_slowly(text)


def test_ledger(spark, docs, empty):
    rows = ledger(docs).collect()
    assert sorted(tuple(r[1:-1]) for r in rows) == sorted(measure_slowly(t) for _, t, _ in ROWS)
    kept = apply_policy(ledger(docs), "base").collect()
    for r in kept:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)
    assert ledger(empty).collect() == [] and ledger(docs, carry=("size",)).columns[:2] == ["doc_id", "size"]


LIST = "\n".join(f"- point number {i} of the list" for i in range(20))
JUNK = {
    "too_few_words": "a few words", "repeated_windows": "one two three four " * 30, "many_symbols": "word### " * 60, "shouting": "THIS IS LOUD " * 30, "repeated_lines": "\n".join(f"a line with words {i % 3}" for i in range(40)),
    "word_length": "x " * 80, "mostly_digits": " ".join(f"a{i}{i}{i}" for i in range(1000, 1100)), "words_without_letters": " ".join(f"{i} word{i}" for i in range(60)), "poor_vocabulary": "alpha beta gamma " * 100,
    "endless_word": "word " * 60 + "x" * 2000, "bullet_list": LIST, "broken_off_lines": "\n".join(f"a line number {i} that goes on..." for i in range(20)), "control_characters": "plain text\x00\x01 here " * 30,
}


@pytest.mark.parametrize("rule", RULES)
def test_each_rule_has_a_text_that_fails_it(rule):
    prose = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} of" for i in range(120)) + "."
    assert rule in fails(JUNK[rule]) and fails(prose) == []


def test_a_short_text_of_repeated_lines_stays():
    verse = "\n".join(["row row row your boat gently down the stream today my dear old friend", "merrily we go along"] * 2 + [f"and then we sing verse number {'abcdefgh'[i]} of the long song again" for i in range(8)])
    assert "repeated_lines" not in fails(verse)


def test_ablation(tables):
    book = ledger(tables("documents")).cache()
    for version in POLICIES:
        got = {r.rule: (r.failed, r.failed_alone, r.kept_without) for r in ablation(book, version).collect()}
        bits = [r.failed_bits & mask_of(POLICIES[version]) for r in book.collect()]
        names = list(RULES)
        for rule in POLICIES[version]:
            bit = 1 << names.index(rule)
            assert got[rule] == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits), sum(b in (0, bit) for b in bits))
    assert CURRENT == "v3" and set(POLICIES["v3"]) == set(RULES)


def fill(sizes, weights=(5, 2, 1), epochs=3):
    """Targets by sharing again what is above the limits, until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > epochs * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = float(epochs * sizes[s])
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 5}, {"a": 1, "b": 0, "c": 900}, {"x": 10}, {"a": 0, "b": 0}, {f"s{i:02d}": (i * 37) % 91 for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    want = fill(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark, tables, docs, empty):
    rows = mix(tables("documents")).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source_rank].append(r)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    assert sum(r.taken for r in rows) <= sum(r.size for r in rows)
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= 2 * max(r.size for r in group)
    edges = mix(docs)
    out = edges.collect()
    assert len(out) == len(ROWS) and sum(r.taken for r in out) <= sum(r.size for r in out) and sorted(map(str, out)) == sorted(map(str, mix(docs.repartition(5)).collect()))
    assert sorted(r.size for r in out) == sorted(measure_slowly(t)[0] for _, t, _ in ROWS)
    assert mix(empty).collect() == [] and "Python" not in edges._jdf.queryExecution().executedPlan().toString()


def mix_slowly(rows, seed="mix-1", weights=(5, 2, 1), epochs=3):
    """[(finish, rank, key, size)] of the copies that are taken, in order; rows: (key, text, source), keys different."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target, copies = fill(sizes, weights, epochs), []
    for rank, name in enumerate(names, 1):
        before = 0
        for key, t, _ in sorted((r for r in rows if r[2] == name), key=lambda r: hashlib.sha256(f"{seed}|{r[0]}".encode()).hexdigest()[:15]):
            n = size(t)
            copies += [((e * sizes[name] + before + n) / target[name], rank, key, n) for e in range(epochs) if n and target[name]]
            before += n
    total, out = 0, []
    for c in sorted(copies):
        if total + c[3] > sum(sizes.values()):
            break
        out.append((*c, total))
        total += c[3]
    return out


@pytest.mark.parametrize("most", [100_000, 0])
def test_the_queue_is_that_of_plain_python(tables, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows = [(r.doc_id, r.text, r.source) for r in tables("documents").collect()]
    documents, queue = fair_queue(tables("documents"))
    want = mix_slowly(rows)
    got = sorted(queue.collect(), key=lambda r: r.position)
    assert [(r.doc_id, r["size"], r.position) for r in got] == [(k, n, at) for _, _, k, n, at in want]
    assert {r.doc_id: r.copies for r in documents.collect() if r.copies} == dict(Counter(k for _, _, k, _, _ in want))


def test_many_rows_of_one_key(spark):
    """A hot null key, with equal and with different texts, is numbered by ranges: no task has it all."""
    df = spark.range(20_000, numPartitions=5).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 8 > 1, "same").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), F.when(F.col("id") % 3 == 0, "hot").alias("source"))
    out = shard(df, shards=3)
    rows = out.collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == 20_000 and all(sorted(s) == list(range(len(s))) for s in slots.values()) and len({r.shard for r in rows if r.doc_id is None}) == 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = common.in_ranges(common.numbered(df.select("doc_id", "text")), "doc_id", "text", "_row").groupBy("_part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 8_000
    mixed = mix(df).collect()
    assert len(mixed) == 20_000 and 0 <= sum(r["size"] for r in mixed) - sum(r.taken for r in mixed) < 10


def test_many_sources(spark):
    rows = [(i, "w " * (i % 7 + 1), f"host{i % 900:03d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter()
    for _, _, key, n, _ in mix_slowly(rows):
        want[key] += n
    assert {r.doc_id: r.taken for r in mix(df).collect() if r.taken} == dict(want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=200), st.sampled_from([6, 70_000]))
def test_grammars_keep_ids(ids, base):
    ids = np.array(ids * 3, np.uint32)
    ends = np.array(sorted({0, len(ids) // 3, len(ids)}))
    block = tokens.Shard(tokens.pack(ids, ends, base))
    assert block.all().tolist() == ids.tolist() and block.size.sum() == sum(len(tokens.expand(np.array([base + k]), block.table)) for k in range(len(block.rules)))
    for k, end in enumerate(ends):
        assert block.doc(k).tolist() == ids[ends[k - 1] if k else 0 : end].tolist()


def test_grammars_compress():
    ids = np.array([1, 2, 3, 4, 5, 6, 7] * 5000, np.uint32)
    seq, rules, size = tokens.compress(ids, 50_000)
    assert len(seq) < len(ids) / 20 and len(rules) == len(size) and (rules < 50_000 + np.arange(len(rules))[:, None]).all()


ODD = ["Straße, naïve!!", "É́, don't IT'S", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "İstanbul ΣΑΣ.", "x1,2 ½,² ﬁ", "ábc, 日本,語", " x , a b \x1c", "'s, x's*** 'LL", "Å Å, ǅ!", "été*** 9$$$ ſ ŉ Ÿ", "\x00\x01 \x7f a\x1cb\x1c", "J\u030c I\u0307 K\u212a", ""]


def test_pieces_are_those_of_the_tokenizer():
    memo = tokens.Memo(tokenizer_path())
    for text in ODD + [t or "" for _, t, _ in ROWS]:
        assert np.frombuffer(memo.encode(text), "<u4").tolist() == memo.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark, docs, empty, tables, monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    both = tables("documents").select("doc_id", "text")
    for df, path in ((both, tmp_path / "a"), (docs, tmp_path / "b")):
        rows = sorted((((r.doc_id is not None, r.doc_id or 0), r.text or "", r.text is not None, r.doc_id) for r in df.collect()), key=lambda x: (x[0], x[2], x[1]))
        got = sorted(tokens.token_ids(df, tokenizer_path(), path=str(path)).collect(), key=lambda r: r.start)
        start = 0
        for (_, text, _, key), r in zip(rows, got, strict=True):
            ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 1], "<u4")
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    assert tokens.token_ids(empty, tokenizer_path()).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library_for_every_tokenizer(tables, name):
    memo = tokens.Memo(tokenizer_path(name))
    texts = [r.text for r in tables("documents").collect()] + ["Hello world, how are  you", "a\n\n b <|endoftext|>x ", *ODD]
    for text in texts:
        assert np.frombuffer(memo.encode(text), "<u4").tolist() == memo.tokenizer.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("kind", ["smallint", "string", "date", "decimal(9,2)", "double", "binary"])
def test_token_files_with_other_keys(spark, kind):
    rows = [(k, t) for k, t in ((3, "three"), (1, "one"), (2, None), (None, "none"), (1, "again"))]
    number = F.col("k").cast("int")
    key = F.date_add(F.lit("2024-01-01").cast("date"), number) if kind == "date" else F.col("k").cast("string").cast("binary") if kind == "binary" else F.col("k").cast(kind)
    df = spark.createDataFrame(rows, "k long, text string").select(key.alias("doc_id"), "text", F.lit(1).alias("shard"))
    out = tokens.token_ids(df, tokenizer_path())
    assert dict(out.dtypes)["doc_id"] == kind
    got = [r.doc_id for r in sorted(out.collect(), key=lambda r: r.start)]
    assert got == [r.doc_id for r in df.orderBy(F.col("doc_id").asc_nulls_first(), "text").collect()]


def test_token_files_in_another_order(spark):
    df = spark.createDataFrame([(i, f"text {i}", (i * 37) % 101) for i in range(100)], "doc_id long, text string, place long")
    out = tokens.token_ids(df, tokenizer_path(), order=["place"])
    assert [r.doc_id for r in sorted(out.collect(), key=lambda r: r.start)] == [r.doc_id for r in df.orderBy("place").collect()]


def test_grammars_replace_every_frequent_pair():
    rng = np.random.default_rng(7)
    once = rng.integers(0, 50_000, 400, dtype=np.uint32)
    for ids in (np.tile(once, 4), np.tile(once[:5], 20_000), rng.integers(0, 300, 60_000, dtype=np.uint32)):
        seq, rules, size = tokens.compress(ids, 50_000)
        assert (tokens.expand(seq, tokens.unfold(rules, size, 50_000)) == ids).all()
        apart = seq[:-1] != seq[1:]  # pairs of one symbol overlap in a run
        pairs = (seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:])[apart]
        assert not len(pairs) or np.unique(pairs, return_counts=True)[1].max() < 4
    assert size.max() >= 2 and tokens.compress(np.tile(once[:5], 20_000), 50_000)[2].max() > 1000
