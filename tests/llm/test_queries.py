"""The registered queries against DuckDB, and the pipeline stage by stage against brute force."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from shroudlake.llm import common
from shroudlake.llm.queries import QUERIES, oracle_sql, tokenizer_path

from ..against import SF, assert_same, database
from .conftest import ROWS
from .test_matching_operators import leaks_slowly, near_slowly
from .test_simple_operators import fails, mix_slowly


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    out = QUERIES[name](spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name in oracle_sql():
        assert_same(out, oracle_sql()[name], con)
    elif name != "rule_ablation":
        assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def step(name, df):
        path = str(tmp_path / re.sub(r"\W", "-", name))
        stages[name](spark, df, SF).write.parquet(path)
        return spark.read.parquet(path)

    clean = step("quality rules", docs)
    assert clean.schema == docs.schema and rows_of(clean) == sorted((tuple(r) for r in docs.collect() if not fails(r.text)), key=str)

    single = step("near duplicates", clean)
    rows = clean.collect()
    roots = near_slowly([(r.doc_id, r.text) for r in rows], 5)
    assert rows_of(single) == sorted((tuple(r) for r, root in zip(rows, roots, strict=True) if r.doc_id == root), key=str)

    fair = step("decontamination", single)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {x[0] for x in leaks_slowly([(r.doc_id, r.text) for r in single.collect()], items) if x[3]}
    assert rows_of(fair) == sorted((tuple(r) for r in single.collect() if r.doc_id not in leaked), key=str)

    mixed = step("mixing", fair)
    name = lambda r: hashlib.sha256(json.dumps({f"c{i}": v for i, v in enumerate((str(r.doc_id), r.source, r.text))}, ensure_ascii=False, separators=(",", ":")).replace("/", "/").encode()).hexdigest()[:32]
    known = {name(r): r for r in fair.collect()}
    queue = mix_slowly([(k, r.text, r.source) for k, r in known.items()])
    in_files = [r.doc_id for r in mixed.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    assert mixed.schema == docs.schema and in_files == [known[k].doc_id for _, _, k, _, _ in queue] and len({r.source for r in known.values()}) > 15
    assert rows_of(mixed) == sorted((tuple(known[k]) for _, _, k, _, _ in queue), key=str)

    ids = sorted(step("token ids", mixed).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in ids] == in_files and ids[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(ids, ids[1:], strict=False))
    plain, texts = Tokenizer.from_file(tokenizer_path()), {r.doc_id: r.text for r in known.values()}
    for r in ids[:: max(1, len(ids) // 50)]:
        want = np.array([*plain.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(want), zlib.crc32(want.tobytes()))


def test_stages_without_broadcasts(spark, tmp_path, monkeypatch):
    """Beyond the bound on broadcasts every stage gives the same rows by shuffles."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 4000")
    with_, without = [], []
    for rows, most in ((with_, common.BROADCAST_ROWS), (without, 40)):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        rows += [rows_of(stage(spark, docs, SF)) for _, stage in pipeline.STAGES[1:4]]
    assert with_ == without


def test_runs_agree_and_keep_their_files(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    first = rows_of(pipeline.run(spark, SF, tokens=str(tmp_path / "ids")))
    assert first == rows_of(pipeline.run(spark, SF)) and first
    stored = spark.read.parquet(str(tmp_path / "ids"))
    assert stored.agg({"n_ids": "sum"}).first()[0] == sum(r[4] for r in first)


def test_one_row_stays_whatever_the_order(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "a text", "en", "s", 6), (1, "a text", "de", "s", 6), (1, "a text", "fr", "t", 6), (2, "b text", "en", "s", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (pipeline.near_dedup, pipeline.mixing):
        got = {str(rows_of(stage(spark, df.orderBy(c).repartition(n), SF))) for c in ("lang", "source") for n in (1, 3)}
        assert len(got) == 1


def test_pipeline_of_edge_rows(spark, docs, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, empty, SF).collect() == []
    assert pipeline.near_dedup(spark, docs, SF).where("doc_id = 3").count() == 1
    tokens = pipeline.token_output(spark, docs, SF)
    assert tokens.count() == docs.count()


def test_near_dedup_drops_rows_not_ids(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    got = Counter((r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, SF).collect())
    assert got[(7, "another text under the same key")] == 1 and got[(7, ROWS[0][1])] == 0 and got[(3, ROWS[0][1])] == 1
    assert set(got) == {(i, t) for i, t, _ in ROWS} - {(7, ROWS[0][1]), (10, ROWS[9][1]), (12, ROWS[12][1])} and set(got.values()) == {1}


def test_decontamination_needs_an_item_not_a_chance_window(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    long, other = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    items = [(1, long), (2, "the"), (3, "two words"), (4, other), (4, "one two three four five six seven eight")]
    spark.createDataFrame(items, "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "x " + long + " y"), (2, "the clean one"), (3, " ".join(long.split()[:8])), (4, "the two words"), (5, other), (6, "one two three four five six seven eight"), (7, " ".join(long.split()[:14])), (8, None), (None, long)]
    kept = pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 8]
