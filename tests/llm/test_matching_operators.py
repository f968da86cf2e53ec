"""Near-duplicates, decontamination, revisits, quotations, toxicity."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroudlake.llm import common, neardup, quotes, toxicity, warc
from shroudlake.llm import components as joined_links
from shroudlake.llm.components import components
from shroudlake.llm.decontam import contamination
from shroudlake.llm.neardup import near_duplicates
from shroudlake.llm.quality import FEATURES, statistics
from shroudlake.llm.quotes import as_mail, link_quotes, parse
from shroudlake.llm.toxicity import score_toxicity, train_linear

from .conftest import ROWS

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower(text):
    return (text or "").translate(str.maketrans(UPPER, UPPER.lower()))


def shingles(text, q):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + q]) for i in range(len(words) - q + 1)} or ({tuple(words)} if words else set())


def near_slowly(rows, q, percent=80):
    """{row number: component} by comparing all pairs; rows: (key, text), keys not null."""
    sets = [shingles(t, q) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = rows[i][0] == rows[j][0] and rows[i][0] is not None
            common = len(sets[i] & sets[j])
            if both or common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    return [min(least[find(i)]) for i in range(len(rows))]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7)], [(i, i + 1) for i in range(40)] + [(100, 3), (None, 5)], [(0, i) for i in range(1, 50)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root.setdefault(a, {a}), root.setdefault(b, {b})
            if x is not y:
                x |= y
                for n in y:
                    root[n] = x
    assert got == {n: min(s) for n, s in root.items()}


@pytest.mark.parametrize(("chunk", "most"), [(1 << 18, 100_000), (2, 100_000), (2, 0)])
def test_components_in_chunks_of_any_size(spark, monkeypatch, chunk, most):
    monkeypatch.setattr(joined_links, "CHUNK", chunk)
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(-60, 60)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(140)] + [(5000, i) for i in range(4000, 4050)]
    names = {n: {n} for e in edges for n in e}
    for a, b in edges:
        if names[a] is not names[b]:
            names[a] |= names[b]
            for n in names[b]:
                names[n] = names[a]
    want = {n: min(s) for n, s in names.items() if len(s) > 1}
    links = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r.node: r.component for r in components(links).collect()} == want
    texts = links.select(*[F.format_string("%05d", F.col(c) + 100).alias(c) for c in ("a", "b")])  # of another kind than whole numbers
    assert {int(r.node) - 100: int(r.component) - 100 for r in components(texts).collect()} == want


def jobs(spark, run):
    """How many jobs run() takes."""
    sc, group = spark.sparkContext, f"counted-{random.random()}"
    sc.setJobGroup(group, "counted")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_small_inputs_take_few_jobs(spark):
    """Each job takes the driver's memory: for threads, broadcasts, generated code."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long")
    assert jobs(spark, lambda: components(chain).collect()) <= 20
    rows = spark.createDataFrame(family(), "doc_id long, text string")
    assert jobs(spark, lambda: near_duplicates(rows, words=4).collect()) <= 110


def test_differing_symbols_are_counted_by_a_short_expression(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 16, (300, neardup.SYMBOLS)).astype("<u2")
    y = np.where(rng.random(x.shape) < 0.5, x, x ^ (1 << rng.integers(0, 16, x.shape)).astype("<u2"))
    x[0], y[0], x[1], y[1] = 0, 0xFFFF, 0xFFFF, 0x7FFF
    rows = spark.createDataFrame([(a.view("<i8").tolist(), b.view("<i8").tolist(), int((a != b).sum())) for a, b in zip(x, y, strict=True)], "a array<long>, b array<long>, n int")
    lanes = neardup._lanes("a", "b")
    assert rows.where(lanes != F.col("n")).isEmpty()
    assert len(str(lanes)) < 5_000


@pytest.mark.parametrize("q", [4, 5])
def test_near_duplicates(tables, q):
    rows = [(r.doc_id, r.text) for r in tables("documents").collect()]
    want = dict(zip((k for k, _ in rows), near_slowly(rows, q), strict=True))
    out = near_duplicates(tables("documents"), words=q).collect()
    assert {r.doc_id: r.component_id for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingles(dict(rows)[r.doc_id], q)) for r in out)


def family(seed=5, copies=140, words=70):
    """Copies of one text with one to many words changed, so that links and near misses mix."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    texts = [" ".join(base)]
    for _ in range(copies - 1):
        new = list(rng.choice(texts[:20]).split())
        for _ in range(rng.choice((1, 1, 2, 2, 3, 4, 6))):
            new[rng.randrange(len(new))] = f"n{rng.randrange(3)}"
        texts.append(" ".join(new))
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("stars", [0, 3])
@pytest.mark.parametrize(("block", "split", "most"), [(16, 1000, 100_000), (2048, 64, 100_000), (8, 1, 100_000), (16, 0, 0)])
def test_no_link_of_a_large_family_is_lost(spark, monkeypatch, block, split, most, stars):
    monkeypatch.setattr(neardup, "STARS", stars)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SPLIT", split)
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows = family()
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    want = dict(zip((k for k, _ in rows), near_slowly(rows, 4), strict=True))
    assert len(set(want.values())) > 3 and {r.doc_id: r.component_id for r in out} == want


def test_signatures_keep_close_pairs_within_the_radius():
    rng = np.random.default_rng(1)
    a, b = neardup._seeds(neardup.SYMBOLS, 1)
    worst = 0
    for n in (5, 40, 1000):
        for _ in range(150):
            x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            cut = n // 9  # similarity 0.8
            p, q = x[:n], np.concatenate((x[cut:n], x[n : n + cut]))
            m = [(neardup.Shingler.minima(np.sort(s), a, b) >> np.uint64(48)) for s in (p, q)]
            worst = max(worst, int((m[0] != m[1]).sum()))
    assert worst <= neardup.RADIUS


def test_short_forms_never_refuse_a_close_pair():
    rng = np.random.default_rng(2)
    for n in (10, 900, 1100, 5000, 20000):
        x = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        y = np.sort(np.concatenate((x[: n * 9 // 10], rng.integers(0, 2**63, n // 10, dtype=np.uint64) * np.uint64(2))))
        assert neardup._maybe(neardup._short(x), neardup._short(y), len(x), len(y), 80)
        z = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        assert not neardup._maybe(neardup._short(x), neardup._short(z), n, n, 80)


def test_second_keys_lose_no_pair_within_the_radius():
    """Of any two signatures within the radius that first meet in a chunk before the last two, a later chunk has two symbols in common."""
    rng = np.random.default_rng(4)
    for _ in range(3000):
        differ = np.zeros(neardup.SYMBOLS, bool)
        for c in range(rng.integers(0, neardup.CHUNKS - 2)):  # chunks before the first one that they share
            differ[c * neardup.LANES + rng.permutation(neardup.LANES)[:2]] = True
        left = neardup.RADIUS - differ.sum()
        free = rng.permutation(np.flatnonzero(~differ))[:left]
        differ[free] = True
        per_chunk = differ.reshape(neardup.CHUNKS, neardup.LANES).sum(axis=1)
        first = int(np.argmax(per_chunk <= 1))
        assert per_chunk[first] <= 1
        if first < neardup.CHUNKS - 2:
            assert (per_chunk[first + 1 :] <= 2).any()


@pytest.mark.parametrize(("n", "given"), [(1000, False), (1200, True)])
def test_samples_of_large_sets_drop_no_pair(spark, n, given):
    """Two sets whose samples have nothing in common, though as many shingles outside of them may be the same."""
    rows = [(1, 0, 0, 0, 0, 0, i, i, n, [7] * neardup.CHUNKS, np.arange(i * 600, i * 600 + 600, dtype=np.uint32).tobytes()) for i in (1, 2)]
    df = spark.createDataFrame(rows, "bucket long, which byte, i int, j int, mine int, own int, node long, component long, n_shingles long, signature array<long>, short binary")
    assert [tuple(x) for x in neardup._compare(df, 80).collect()] == ([(1, 2)] if given else [])


def test_near_duplicates_of_edge_rows(docs, empty):
    out = near_duplicates(docs, words=4).collect()
    assert len(out) == len(ROWS)
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[7] == {(3, False), (7, True)} and by[3] == {(3, True)} and by[10] == {(9, False)} and by[12] == {(11, False)}
    assert by[None] == {(None, True)} and all(by[k] == {(k, True)} for k in (2, 5, 6, 8, 9, 11))
    assert near_duplicates(empty).collect() == []


def test_texts_of_one_key_have_links_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (2, a + " more"), (9, b + " more"), (5, b.upper()), (1, c), (9, c + " more"), (None, a)]
    for kind, name in (("long", int), ("string", str)):
        df = spark.createDataFrame([(None if k is None else name(k), t, i) for i, (k, t) in enumerate(rows)], f"doc_id {kind}, text string, place int")
        out = {r.place: (r.component_id, r.kept) for r in near_duplicates(df.repartition(3), carry=("place",)).collect()}
        want = [(2, False), (5, True), (2, True), (5, False), (5, True), (1, True), (1, False)]
        assert out == {i: (name(k), kept) for i, (k, kept) in enumerate(want)} | {7: (None, True)}


def leaks_slowly(rows, items, window=8):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        if item is not None and w:
            for i in range(len(w) - size + 1):
                wins[tuple(w[i : i + size])].add(str(item))
    out = []
    for key, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if (these := wins.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= these
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


@pytest.mark.parametrize(("most", "size"), [(100_000, 32 << 20), (60, 32 << 20), (100_000, 20_000)])
def test_contamination(tables, monkeypatch, most, size):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    monkeypatch.setattr(common, "BROADCAST_BYTES", size)
    rows = [(r.doc_id, r.text) for r in tables("documents").collect()]
    items = [(r.item_id, r.text) for r in tables("benchmark").collect()]
    out = contamination(tables("documents"), tables("benchmark"))
    want = leaks_slowly(rows, items)
    assert sorted(map(tuple, out.collect())) == sorted(want) and any(w[3] for w in want)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_contamination_of_edge_rows(spark, docs, empty):
    items = [(1, "the QUICK brown; fox jumps over the lazy dog"), (10, "lazy dog again and again"), (2, "two"), (3, "one two"), (4, ""), (5, None), (None, "a row without a key"), (6, "a long text so long a text so long a text"), (7, "one two"), (8, "a b c d e f g h i")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    rows = [(i, t) for i, t, _ in ROWS]
    assert sorted(map(tuple, contamination(docs, bench).collect()), key=str) == sorted(leaks_slowly(rows, items), key=str)
    assert contamination(empty, bench).collect() == []
    assert all(r.n_items == 0 and not r.contaminated for r in contamination(docs, bench.limit(0)).collect())
    shared = spark.createDataFrame([(1, "x y z"), (2, "y x y z"), (3, "x y")], "doc_id long, text string")
    near = [(1, "x y z"), (2, "z x")]
    assert sorted(map(tuple, contamination(shared, spark.createDataFrame(near, "item_id int, text string")).collect())) == sorted(leaks_slowly([(1, "x y z"), (2, "y x y z"), (3, "x y")], near))


def record(i, url, ts, kind, tag=None, day=None, **headers):
    return (i, url, ts, kind, tag, day, {k.replace("_", "-"): v for k, v in headers.items()}, "more")


RECORDS = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, status string"


def test_revisits(spark):
    rows = [
        record(1, "http://Example.com/a/?utm_source=x&#f", 10, "response", '"v1"', "mon", content_type="text/html", etag='"v1"', date="d1"),
        record(2, "https://www.example.com/a", 20, "revisit", 'W/"v1"', None, date="d2", etag='W/"v1"', content_length="0"),
        record(3, "https://example.com:443/a", 5, "revisit", '"v1"', None),
        record(4, "http://example.com/a", 30, "response", '"v2"', "tue", etag='"v2"'),
        record(5, "http://example.com/a", 40, "revisit", '"v1"', "tue"),
        record(6, "http://example.com/a", 40, "revisit", None, "tue", expires="e"),
        record(7, "http://example.com/a", 40, "revisit"),
        record(8, None, 50, "revisit", '"v1"'),
        record(9, "http://example.com/b", None, "response", '"b"'),
        record(10, "http://example.com/b", 1, "revisit", '"b"'),
        record(11, "http://example.com/a", 60, None),
    ]
    df = spark.createDataFrame(rows + [rows[1]], RECORDS)
    out = defaultdict(list)
    for r in warc.resolve_revisits(df.repartition(4)).collect():
        out[r.record_id].append(r)
    assert len(out[2]) == 2 and {(r.refers_to, r.status) for r in out[2]} == {(1, "resolved")}
    assert out[2][0].headers == {"content-type": "text/html", "etag": 'W/"v1"', "date": "d2"}
    assert [(out[i][0].refers_to, out[i][0].status) for i in (1, 3, 5, 6, 7, 8, 10, 11)] == [(None, "response"), (None, "missing"), (None, "mismatch"), (4, "resolved"), (None, "unchecked"), (None, "missing"), (9, "resolved"), (None, None)]
    assert out[6][0].headers == {"etag": '"v2"', "expires": "e"} and out[8][0].canonical_url is None and out[1][0].canonical_url == "example.com/a"
    assert warc.resolve_revisits(df.limit(0)).collect() == []


def test_addresses(spark):
    same = [("http://a.org/p?b=2&a=1", "https://www.A.org:443/p?a=1&b=2#x"), ("http://a.org/p?q=%2fx", "http://a.org/p?q=%2Fx"), ("a.org", "http://user:pw@a.org/"), ("http://a.org/p/?utm_source=f&fbclid=1", "http://a.org/p")]
    other = [("http://a.org/p?ref=main", "http://a.org/p?ref=dev"), ("http://a.org/P", "http://a.org/p"), ("http://a.org/p?a=1", "http://a.org/p?a=2"), ("http://a.org/p?utm", "http://a.org/p")]
    df = spark.createDataFrame([(a, b) for a, b in same + other], "a string, b string").select(warc.canonical_url(F.col("a")).alias("a"), warc.canonical_url(F.col("b")).alias("b"))
    assert [r.a == r.b for r in df.collect()] == [True] * len(same) + [False] * len(other)
    mine = spark.createDataFrame([("http://a.org/p?sid=1&x=2",)], "a string").select(warc.canonical_url(F.col("a"), ("sid",)).alias("a"))
    assert mine.first().a == "a.org/p?x=2"


def test_a_response_of_the_same_moment_and_name_is_not_earlier(spark):
    df = spark.createDataFrame([record(1, "http://x.org/", 5, "response", '"a"'), record(1, "http://x.org/", 5, "revisit", '"a"')] * 2, RECORDS)
    assert [r.status for r in warc.resolve_revisits(df).collect() if r.kind == "revisit"] == ["missing"] * 2


def test_long_headers_and_addresses(spark):
    long = "x" * 200_000
    rows = [record(1, f"http://x.org/{long}", 1, "response", '"a"', vary=long), record(2, f"http://x.org/{long}", 2, "revisit", '"a"')]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got[2].refers_to == 1 and got[2].headers == {"vary": long}


def test_one_address_may_hold_most_rows(spark):
    rows = [record(i, "http://hot.org/", i, "response" if i % 10 == 0 else "revisit", f'"{i // 10}"') for i in range(3000)] + [record(5000 + i, f"http://cold.org/{i}", i, "revisit", '"x"') for i in range(200)]
    out = warc.resolve_revisits(spark.createDataFrame(rows, RECORDS).repartition(5)).collect()
    assert all(r.refers_to == r.record_id // 10 * 10 for r in out if r.record_id < 3000 and r.record_id % 10) and sum(r.status == "missing" for r in out) == 200


def test_warc_files(spark, tmp_path):
    body = b"<html>\r\n\r\nWARC/1.1 inside</html>"
    http = b'HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nETag: "a"\r\n\r\n' + body
    data = warc.write_record("response", "http://x.org/", "2024-01-02T03:04:05Z", "<urn:1>", http)
    data += warc.write_record("revisit", "http://x.org/", "2024-01-03T03:04:05Z", "<urn:2>", b'HTTP/1.1 304 Not Modified\r\nETag: "a"\r\n\r\n', {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/server-not-modified"})
    (tmp_path / "a.warc.gz").write_bytes(data + data[: len(data) // 3])
    records = warc.read_warc(spark, str(tmp_path / "a.warc.gz"))
    rows = records.collect()
    assert [(r.kind, r.etag) for r in rows][:2] == [("response", '"a"'), ("revisit", '"a"')] and bytes(rows[0].body) == body
    assert {(r.record_id, r.refers_to) for r in warc.resolve_revisits(records.limit(2)).collect()} == {("<urn:1>", None), ("<urn:2>", "<urn:1>")}


def six():
    return [warc.write_record("response", f"http://x.org/{i}", "2024-01-02T03:04:05Z", f"<urn:{i}>", b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\n\r\n" + bytes(random.Random(i).randbytes(400))) for i in range(6)]


def test_damaged_members_are_told_and_passed():
    members = six()
    whole = [r["record_id"] for r in warc.read_records(b"".join(members))]
    assert whole == [f"<urn:{i}>" for i in range(6)]
    bad = bytearray(members[1])
    bad[60:68] = bytes(b ^ 0xFF for b in bad[60:68])
    got = list(warc.read_records(b"".join([members[0], bytes(bad), *members[2:]])))
    assert [r["record_id"] for r in got if r["kind"] == "response"] == ["<urn:0>", "<urn:2>", "<urn:3>", "<urn:4>", "<urn:5>"]
    told = [r for r in got if r["kind"] == "damaged"]
    assert told and told[0]["headers"]["offset"] == str(len(members[0]))
    kinds = lambda data: [r["kind"] for r in warc.read_records(data)]
    assert kinds(b"".join(members) + b"\0" * 100) == ["response"] * 6 and kinds(b"".join(members) + b"junk") == ["response"] * 6 + ["damaged"]
    assert kinds(members[0] + b"garbage" * 200 + members[1]) == ["response", "damaged", "response"] and kinds(members[0][:-9]) == ["response", "damaged"]
    assert kinds(b"") == [] and kinds(b"\x1f\x8b") == ["damaged"]


def test_damaged_records_of_plain_files():
    plain = [gzip.decompress(m) for m in six()]
    kinds = lambda data: [r["kind"] for r in warc.read_records(data)]
    assert kinds(b"".join(plain)) == ["response"] * 6 and kinds(gzip.compress(b"".join(plain))) == ["response"] * 6
    wrong = plain[1].replace(b"Content-Length: ", b"Content-Length: x")
    assert kinds(plain[0] + wrong + plain[2]) == ["response", "damaged", "response"]
    assert kinds(b"".join(plain)[:-300]) == ["response"] * 5 + ["damaged"]


def test_headers_and_dates_of_files(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nVary: a\r\nSet-Cookie: x=1, 2\r\nvary: b\r\nset-cookie: y\r\n\r\nbody"
    data = warc.write_record("response", "http://x.org/", "yesterday", "<urn:1>", http) + warc.write_record("response", "http://x.org/", "2024-01-02T03:04:05Z", "<urn:2>", http)
    (tmp_path / "a.warc.gz").write_bytes(data + b"rest")
    rows = warc.read_warc(spark, str(tmp_path / "a.warc.gz")).collect()
    assert [(r.ts, r.kind) for r in rows] == [(None, "response"), (1704164645, "response"), (None, "damaged")]
    assert rows[0].headers == {"vary": "a, b", "set-cookie": "x=1, 2\ny"}
    assert Counter(r.status for r in warc.resolve_revisits(warc.read_warc(spark, str(tmp_path))).collect()) == {"response": 2, None: 1}


def test_pages_through_files(spark, tables, tmp_path):
    """Every page written as a record, read back and compared."""
    pages = tables("pages").collect()
    for part in range(3):
        (tmp_path / f"{part}.warc.gz").write_bytes(b"".join(warc.write_record("response", p.url, "2024-01-02T03:04:05Z", f"<urn:{p.page_id}>", b"HTTP/1.1 200 OK\r\n\r\n" + p.html.encode()) for p in pages if p.page_id % 3 == part))
    got = {r.record_id: (r.url, bytes(r.body).decode()) for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert got == {f"<urn:{p.page_id}>": (p.url, p.html) for p in pages}


def test_parse_quotes():
    own, quotes = parse("Hi\n\nAnn wrote:\n> one\n> two\n>> deep\n> > deep too\n> three\n\nBye")
    assert own == "Hi\n\n\nBye" and quotes == [(1, "one\ntwo"), (2, "deep\ndeep too"), (1, "three")]
    assert parse(None) == ("", []) and parse(">\n> ") == ("", []) and parse("a > b") == ("a > b", [])


def test_links(spark):
    rows = [
        (1, 0, "user", "Hello there"), (1, 1, "bot", "Answer one\n\n> hello   THERE"), (1, 2, "user", "Again\n> Answer one\n>> Hello there"), (1, 3, "user", "> never said"), (1, 4, "bot", None), (1, 5, "bot", ""),
        (2, 0, "user", "> Hello there"), (2, 1, "user", "First part\n\nsecond part"), (2, 2, "bot", "ok\n> second part"), (2, 2, "bot", "ok\n> second part"), (None, 3, "user", "> x"), (3, None, "user", "x"), (1, 6, "user", "Hello there"), (1, 7, "x", "> hello there"),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, parent int")
    out = {(r.conv_id, r.turn): r for r in link_quotes(df).collect()}
    got = {k: (r.parent, r.root, r.depth, r.n_quotes, r.n_linked, r.n_levels) for k, r in out.items()}
    assert got[(1, 1)] == (0, 0, 1, 1, 1, 1) and got[(1, 2)] == (1, 0, 2, 2, 2, 2) and got[(1, 3)] == (None, 3, 0, 1, 0, 1) and got[(2, 0)] == (None, 0, 0, 1, 0, 1)
    assert got[(2, 2)] == (1, 1, 1, 1, 1, 1) and got[(1, 7)] == (6, 6, 1, 1, 1, 1) and got[(None, 3)][:3] == (None, 3, 0) and got[(3, None)][:3] == (None, None, 0)
    assert out[(1, 2)].text == "Again" and link_quotes(df).count() == len(rows) and link_quotes(df.limit(0)).collect() == []


def test_parts_of_messages_are_linked(spark):
    texts = ["Hi\n\nfirst point here\n\nsecond point here\n\nthird point", "Hi\n\nother matter", "no\n> Hi\n>\n> first point here\nyes\n> third point", "so\n\nand so\n> other matter\nfine", "x\n> so\n> \n> and so", "y\n> none\n> \n> at all"]
    df = spark.createDataFrame([(1, i, "u", t) for i, t in enumerate(texts)] + [(1, 2, "u", texts[2])], "conv_id long, turn long, role string, text string")
    got = sorted({(r.turn, r.parent, r.n_quotes, r.n_linked) for r in link_quotes(df).collect()})
    assert got == [(0, None, 0, 0), (1, None, 0, 0), (2, 0, 2, 2), (3, 1, 1, 1), (4, 3, 1, 1), (5, None, 1, 0)]


def order_slowly(parents):
    """{turn: place in its thread}, from {turn: parent or None}."""
    replies, out = defaultdict(list), {}
    for turn, parent in sorted(parents.items()):
        replies[parent].append(turn)
    for root in replies[None]:
        stack, n = [root], 0
        while stack:
            turn = stack.pop()
            out[turn] = n
            n += 1
            stack += reversed(replies[turn])
    return out


def test_reply_order(spark):
    rng, rows, want = random.Random(9), [], {}
    for conv in range(12):
        parents = {}
        for turn in range(rng.choice((1, 3, 30, 60))):
            parents[turn] = rng.choice([None, *range(turn)]) if turn else None
            quote = "" if parents[turn] is None else f"\n> message {conv} {parents[turn]}"
            rows.append((conv, turn, "u", f"message {conv} {turn}{quote}"))
        want |= {(conv, turn): place for turn, place in order_slowly(parents).items()}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r.conv_id, r.turn): r.place for r in link_quotes(df).collect()}
    assert got == want
    two = [(1, 0, "u", "ask"), (1, 1, "u", "a\n> ask"), (1, 2, "u", "b\n> ask"), (1, 3, "u", "to b\n> b"), (1, 4, "u", "to a\n> a")]
    out = link_quotes(spark.createDataFrame(two, "conv_id long, turn long, role string, text string")).orderBy("root", "place").collect()
    assert [r.turn for r in out] == [0, 1, 4, 2, 3]


def test_long_threads(spark):
    df = spark.range(70).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.concat(F.lit("message "), F.col("id").cast("string")).alias("text"))
    assert all(r.depth == r.turn == r.place and r.root == 0 for r in link_quotes(as_mail(df)).collect())


def test_long_conversations_alone_take_more_rounds(spark, monkeypatch):
    """Three doublings, one after another, took more than a driver's memory; now there is one, and short conversations leave it."""
    rng, rows, want = random.Random(10), [], {}
    for conv, n in [(c, 4) for c in range(20)] + [(-1, 50)]:
        turns, parents = sorted(rng.randint(-(2**62), 2**62) for _ in range(n)), {}
        for i, turn in enumerate(turns):
            parents[turn] = rng.choice(turns[max(0, i - 3) : i]) if i else None
            rows.append((conv, turn, parents[turn]))
        for turn, place in order_slowly(parents).items():
            above = [turn]
            while parents[above[-1]] is not None:
                above.append(parents[above[-1]])
            want[(conv, turn)] = (above[-1], len(above) - 1, place)
    kept, cut = [], quotes.cut
    monkeypatch.setattr(quotes, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    got = quotes._threads(spark.createDataFrame(rows, "conv long, turn long, parent long").repartition(3))
    assert {(r.conv, r.turn): (r.root, r.depth, r.place) for r in got.collect()} == want
    # 8 steps are settled by 3 rounds, 100 steps by 7
    assert [df.count() for df in kept] == [260] * 4 + [100] * 4
    kept.clear()
    df = spark.createDataFrame([(1, i, "u", f"message {i}") for i in range(8)], "conv_id long, turn long, role string, text string")
    assert all(r.depth == r.turn == r.place and r.root == 0 for r in link_quotes(as_mail(df)).collect()) and len(kept) <= 7


def test_very_long_messages(spark):
    long = "\n\n".join(f"paragraph {i} " + "word " * 200 for i in range(400))
    rows = [(1, 0, "u", long), (1, 1, "u", "yes\n" + "\n".join("> " + x for x in long.split("\n"))), (1, 2, "u", "> " + "paragraph 7 " + "word " * 200 + "\nthis one")]
    got = {r.turn: (r.parent, r.n_linked, len(r.text)) for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0, len(long.strip())), 1: (0, 1, 3), 2: (0, 1, 8)}


def test_linear_models():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    y = (x[:, 0] - 2 * x[:, 1] > 0).astype(float)
    beta = train_linear(x, y, np.ones(500))
    assert np.mean((x @ beta[1:] + beta[0] > 0) == y) > 0.97


def test_toxicity_is_learned(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = score_toxicity(documents, labels).join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").where("held_out").collect()
    hit = sum(r.toxic and r.y == 1 for r in out)
    assert hit / sum(r.y == 1 for r in out) > 0.75 and hit / max(1, sum(r.toxic for r in out)) > 0.9


def chain_slowly(documents, labels, categories):
    """{doc_id: probabilities}: the sample, tokens, folds and features in plain Python; categories: functions of a label row."""
    code = defaultdict(int)
    for r in labels:
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            code[r.doc_id] |= sum(1 << k for k, c in enumerate(categories) if c(r))
    name = lambda i: hashlib.sha256(f"chain|{i}".encode()).hexdigest()[:15]
    texts = {r.doc_id: r.text for r in documents}
    rows = sorted((i for i in code if i in texts), key=name)
    fold = np.array([zlib.crc32((texts[i] or "").encode()) % toxicity.FOLDS for i in rows])
    y = np.array([[code[i] >> k & 1 for k in range(len(categories))] for i in rows], float)
    words = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    tokens = lambda w: [w, *(w[:k] + "-" for k in range(4, min(8, len(w))))]
    held = [{t for w in words(texts[i]) for t in tokens(w)} for i in rows]

    def best(k, train):
        d, p = Counter(), Counter()
        for at in np.flatnonzero(train).tolist():
            d.update(held[at])
            p.update(held[at] if y[at, k] else ())
        pos, neg = int(y[train, k].sum()), int((1 - y[train, k]).sum())
        z = {}
        for t, n in d.items():
            if n >= toxicity.LEAST:
                share = n / (pos + neg)
                z[t] = abs((p[t] / pos - (n - p[t]) / neg) / np.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + 1e-9))
        return sorted(z, key=lambda t: (-z[t], t))[: toxicity.TOKENS]

    def features(i, names):
        c = words(texts[i])
        n = Counter()
        for w, m in c.items():
            for t in tokens(w):
                n[t] += m
        return np.array([*statistics(texts[i]), *(np.sqrt(n[t] / max(1, sum(c.values()))) for t in names)])

    def train(k, names, on, earlier):
        x = np.array([np.float32(features(rows[at], names)) for at in np.flatnonzero(on)]).astype(float)
        center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        beta = train_linear(np.hstack(((x - center) / scale, earlier[on])), y[on, k], np.ones(int(on.sum())))
        return lambda v, e: 1 / (1 + np.exp(-np.clip(np.hstack(((v - center) / scale, e)) @ beta[1:] + beta[0], -40, 40)))

    earlier, out, every = np.zeros((len(rows), 0)), {i: [] for i in texts}, np.ones(len(rows), bool)
    for k in range(len(categories)):
        names = best(k, every)
        link = train(k, names, every, earlier)
        for i in texts:
            out[i].append(float(link(features(i, names), np.array(out[i]))))
        probability = np.zeros(len(rows))
        for f in range(toxicity.FOLDS):
            names = best(k, fold != f)
            link = train(k, names, fold != f, earlier)
            for at in np.flatnonzero(fold == f).tolist():
                probability[at] = link(np.float32(features(rows[at], names)).astype(float), earlier[at])
        earlier = np.hstack((earlier, probability[:, None]))
    return out


def test_toxicity_is_that_of_plain_python(tables):
    documents, labels = tables("documents"), tables("labels")
    want = chain_slowly(documents.collect(), labels.collect(), [lambda r: r.quality == 0, lambda r: r.toxic == 1])
    for r in score_toxicity(documents, labels).collect():
        assert abs(r.p_low_quality - want[r.doc_id][0]) < 1e-9 and abs(r.p_toxic - want[r.doc_id][1]) < 1e-9


def test_a_chain_of_several_categories(spark):
    """The labels here have one category of toxicity; with insult, threat and their union the chain is as long as the table."""
    rng, rows, labels = random.Random(6), [], []
    for i in range(900):
        insult, threat = rng.random() < 0.3, rng.random() < 0.3
        words = [f"plain{rng.randrange(60)}" for _ in range(40)] + ["idiotish"] * insult + ["clobberyou"] * threat
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult), int(threat)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, insult int, threat int")
    out = score_toxicity(df, known, {"insult": "insult = 1", "threat": "threat = 1", "any": "insult = 1 OR threat = 1"}).collect()
    assert out[0].asDict().keys() == {"doc_id", "held_out", "p_insult", "p_threat", "p_any", "toxic"}
    truth = {i: (a, b, a or b) for i, a, b in labels}
    for r in out:
        if r.held_out:
            assert ((r.p_insult > 0.5), (r.p_threat > 0.5), r.toxic) == tuple(map(bool, truth[r.doc_id]))


def test_one_key_with_many_rows_is_learned_from_once(spark):
    rows = [(0, f"hot text number {i} of very many") for i in range(3000)] + [(i, f"cold text number {i}") for i in range(1, 101)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, i % 2) for i in range(101)], "doc_id long, quality int, toxic int")
    texts, totals = toxicity.sample(df.repartition(3), labels, {"toxic": "toxic = 1"}, "doc_id", "text")
    held = {i for i in range(101) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert texts.count() == 101 - len(held) == sum(totals.values())
    first = [r["_t"] for r in texts.orderBy("_t").collect()]
    assert first == [r["_t"] for r in toxicity.sample(df.repartition(5), labels, {"toxic": "toxic = 1"}, "doc_id", "text")[0].orderBy("_t").collect()]
    same = spark.createDataFrame([(i, "a copy of one text") for i in range(40)], "doc_id long, text string")
    assert toxicity.sample(same, labels, {"toxic": "toxic = 1"}, "doc_id", "text")[0].select("_fold").distinct().count() == 1


def test_toxicity_of_edge_rows(spark, docs, empty):
    labels = spark.createDataFrame([(7, 1, 1), (3, 0, None), (5, None, 0), (None, 1, 1), (9, 0, 1), (9, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    out = score_toxicity(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r.p_toxic <= 1 and r.toxic == (r.p_toxic > 0.5) for r in out)
    assert score_toxicity(empty, labels).collect() == []
    assert {(r.p_low_quality, r.p_toxic, r.toxic) for r in score_toxicity(docs, labels.limit(0)).collect()} == {(0.5, 0.5, False)}
