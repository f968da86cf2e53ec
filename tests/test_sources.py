from __future__ import annotations

import hashlib
import hmac
import json

import pytest

from shroudlake import audit
from shroudlake.cli import main
from shroudlake.operators.masking import mask
from shroudlake.plans.policy import Policy
from shroudlake.sources.database import changed_rows, is_production, redact
from shroudlake.sources.files import format_of, read_table, write_table
from shroudlake.sources.sqldump import dump_tables, format_literal, literal_value, mask_dump, read_dump, split_dump
from shroudlake.operators.integrity import unique_mapping
from shroudlake.streaming import mask_stream, unique_sink, write_masked

SALT = "fixture-salt-v1"

DUMP = """-- a shop
SET client_encoding = 'UTF8';

CREATE TABLE public.customers (
    id integer NOT NULL PRIMARY KEY,
    full_name varchar(100) NOT NULL,
    phone varchar(30),
    salary numeric(10,2)
);

COPY public.customers (id, full_name, phone, salary) FROM stdin;
101\tBruce\\tWayne\t+1-555-0100\t250000.00
102\tClark Kent\t\\N\t65000.00
\\.

CREATE TABLE public.orders (order_id integer, customer_id integer REFERENCES public.customers(id), city varchar(50));

INSERT INTO public.orders (order_id, customer_id, city) VALUES
(5001, 101, 'Got;ham (it''s)'),
(5002, 102, NULL);
INSERT IGNORE INTO `orders`
  VALUES (5003, 101, N'x') ON DUPLICATE KEY UPDATE city = 'a;b';
CREATE TABLE secret_tokens (id integer, token_val varchar(64));
INSERT INTO secret_tokens (id, token_val) VALUES (1, 'xyz');
COPY secret_tokens FROM stdin;
2\tabc
\\.
"""


def policy(**tables):
    return Policy.model_validate({"global": {"salt": SALT}, "tables": tables, "consistency_groups": [{"name": "g", "columns": ["customers.id", "orders.customer_id"], "params": {"as_integer": True, "min_int": 20000, "max_int": 29999}}]})


def cols(**rules):
    return {"columns": {c: r if isinstance(r, dict) else {"strategy": r} for c, r in rules.items()}}


def token(v):
    return 20000 + int(hmac.new(SALT.encode(), str(v).encode(), hashlib.sha256).hexdigest()[:16], 16) % 10000


def test_pieces_add_up():
    kinds = [(p.kind, p.table, p.values) for p in split_dump(DUMP) if p.kind == "row"]
    assert kinds == [
        ("row", "customers", ["101", "Bruce\tWayne", "+1-555-0100", "250000.00"]), ("row", "customers", ["102", "Clark Kent", None, "65000.00"]), ("row", "orders", ["5001", "101", "Got;ham (it's)"]), ("row", "orders", ["5002", "102", None]),
        ("row", "orders", ["5003", "101", "x"]), ("row", "secret_tokens", ["1", "xyz"]), ("row", "secret_tokens", ["2", "abc"]),
    ]
    assert [p.columns for p in split_dump(DUMP) if p.kind == "row"][4] == ["order_id", "customer_id", "city"]


@pytest.mark.parametrize(("literal", "value"), [("NULL", None), ("'it''s'", "it's"), ("'a\\'b\\\\n'", "a'b\\n"), ("N'ü'", "ü"), ("$q$a;'b$q$", "a;'b"), ("12.50", "12.50"), ("E'x\\ty'", "x\ty")])
def test_literals(literal, value):
    assert literal_value(literal) == value
    if value is not None and "." not in value:
        assert literal_value(format_literal(value, literal, False)) == value


def test_masked_dump(spark, tmp_path):
    source, target = tmp_path / "in.sql", tmp_path / "out"
    source.write_text(DUMP)
    rules = policy(customers=cols(id="hash", full_name="mask", phone={"strategy": "mask", "params": {"keep_first": 3, "keep_last": 4}}), orders=cols(customer_id="hash", city={"strategy": "constant", "params": {"value_to_set": "O'X"}}), secret_tokens={"truncate": True})
    mask_dump(spark, str(source), str(target), rules)
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted(target.glob("part-*")))
    assert f"{token(101)}\t***********\t+1-****0100\t250000.00\n{token(102)}\t**********\t\\N\t65000.00\n\\." in text
    assert f"(5001, {token(101)}, 'O''X')," in text and f"(5002, {token(102)}, NULL);" in text and f"(5003, {token(101)}, N'O''X') ON DUPLICATE KEY UPDATE city = 'a;b';" in text
    assert "xyz" not in text and "abc" not in text and "COPY secret_tokens" not in text and "SET client_encoding" in text
    again = dump_tables(read_dump(spark, str(target)))
    assert again["orders"].count() == 3 and again["customers"].schema["id"].dataType.typeName() == "long"


def test_unreadable_data_is_an_error():
    with pytest.raises(ValueError, match="can't be read"):
        list(split_dump("INSERT INTO t SELECT * FROM u;\n", {"t"}))
    assert [p.kind for p in split_dump("INSERT INTO t SELECT * FROM u;\n", {"x"})] == ["other"]


@pytest.mark.parametrize("kind", ["csv", "tsv", "json", "jsonl", "parquet"])
def test_files(spark, tmp_path, kind):
    df = spark.createDataFrame([("1", 'a "b", c\nd', ""), ("2", "é", "x")], "id string, v string, w string")
    path = str(tmp_path / f"t.{kind}")
    write_table(df, path)
    back = read_table(spark, path, kind="jsonl" if kind == "json" else kind)
    assert sorted(map(tuple, back.select("id", "v", "w").collect())) == sorted(map(tuple, df.collect()))
    assert format_of(path) == kind
    write_table(df.limit(0), str(tmp_path / f"empty.{kind}"))


def test_bad_lines_are_errors(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_table(spark, str(tmp_path / "x.jsonl"), schema="a int").collect()
    (tmp_path / "d.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert read_table(spark, str(tmp_path / "d.json")).count() == 2
    (tmp_path / "n.txt").write_text("one\ntwo\n")
    assert read_table(spark, str(tmp_path / "n.txt")).columns == ["line"]


def test_databases(spark):
    assert redact("postgresql://u:secret@h:5432/d") == "postgresql://u:***@h:5432/d" and redact("jdbc:postgresql://u:s@h/d") == "jdbc:postgresql://u:***@h/d" and redact("/a/b.sql") == "/a/b.sql"
    assert is_production("postgresql://db.prod.x.com/app") and is_production("mysql://h/live") and not is_production("mysql://h/product") and not is_production("file.sql")
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "id int, v string")
    assert sorted(r.id for r in changed_rows(a, b, ["id"]).collect()) == [2, 3]
    with pytest.raises(ValueError):
        changed_rows(a, b, [])


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, f"name {i}") for i in range(20)], "id long, v string")
    df.write.parquet(str(tmp_path / "in"))
    rules = Policy.model_validate({"global": {"salt": SALT}, "tables": {"t": cols(id="hash", v="mask")}})
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    write_masked(stream, "t", rules, str(tmp_path / "out"), str(tmp_path / "saved")).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(mask(df, "t", rules).collect())
    with pytest.raises(ValueError):
        mask_stream(df, "t", rules)


def test_unique_numbers_over_batches(spark, tmp_path):
    got = []
    sink = unique_sink(spark, "id", SALT, str(tmp_path / "map"), lambda df, n: got.append({r.v: r.id for r in df.collect()}), 1, 60)
    for n, ids in enumerate([range(30), range(20, 50), range(20, 50)]):
        sink(spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string"), n)
    both = got[0] | got[1]
    assert len(set(both.values())) == 50 and all(got[0][k] == got[1][k] for k in got[0].keys() & got[1].keys()) and got[1] == got[2]


def test_audit_and_salts():
    p = Policy.model_validate({"global": {"salt": "x" * 40}})
    record = audit.audit_record(p, "postgresql://u:pw@h/d", None, {"rows": 1}, key="k")
    assert audit.verify_record(record, "k") and not audit.verify_record(record, "other") and "pw@" not in json.dumps(record)
    record["run"]["counters"]["rows"] = 2
    assert not audit.verify_record(record, "k") and not audit.verify_record({}, "k")
    assert audit.salt_weakness("changeme") and audit.salt_weakness("short") and audit.salt_weakness(None) and not audit.salt_weakness("x" * 32)
    with pytest.raises(PermissionError):
        audit.check_policy(Policy.model_validate({"global": {"salt": "x" * 40, "salt_fingerprint": "0" * 16}}))
    # RFC 5869, test case 1
    okm = audit.expand_key(bytes([0x0B] * 22), bytes.fromhex("f0f1f2f3f4f5f6f7f8f9"), 42, bytes.fromhex("000102030405060708090a0b0c"))
    assert okm.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "users.csv").write_text("id,email,age\n1,a.b@c.org,30\n2,d@e.com,30\n")
    (tmp_path / "p.yaml").write_text("global: {salt: 0123456789abcdef0123456789abcdef}\ntables: {users: {columns: {email: {strategy: email_mask}}}}")
    run = lambda *a: main([str(x) for x in a], spark)
    assert run("verify", "-i", tmp_path / "users.csv") == 1
    assert run("mask", "-c", tmp_path / "p.yaml", "-i", tmp_path / "users.csv", "-o", tmp_path / "out.csv", "--table", "users", "--audit", tmp_path / "a.json") == 0
    assert '"rows": 2' in capsys.readouterr().out and run("verify", "-i", tmp_path / "out.csv") == 0
    monkeypatch.setenv("AUDIT_KEY", "0123456789abcdef0123456789abcdef")
    assert run("audit-verify", tmp_path / "a.json") == 0
    assert run("lint", "-c", tmp_path / "p.yaml", "-i", tmp_path / "users.csv") == 0
    assert run("evaluate", "-i", tmp_path / "users.csv", "-q", "age", "-k", 2) == 0 and run("evaluate", "-i", tmp_path / "users.csv", "-q", "age", "-k", 3) == 1
    assert run("scan", "-i", tmp_path / "users.csv", "-o", tmp_path / "made.yaml") == 0 and "email" in (tmp_path / "made.yaml").read_text()
    assert run("preview", "-c", tmp_path / "p.yaml", "-i", tmp_path / "users.csv") == 0 and run("diff", "-c", tmp_path / "p.yaml", "--other", tmp_path / "made.yaml", "-i", tmp_path / "users.csv") == 0
    assert run("strategies") == 0 and run("version") == 0 and run("init", "-o", tmp_path / "new.yaml") == 0
    (tmp_path / "shop.sql").write_text(DUMP)
    assert run("subset", "-i", tmp_path / "shop.sql", "-o", tmp_path / "sub", "--root", "customers", "--limit", 1) == 0
    assert spark.read.parquet(str(tmp_path / "sub" / "orders.parquet")).count() == 2


def test_copy_csv_keeps_empty_texts_and_literals(spark, tmp_path):
    (tmp_path / "d.sql").write_text('CREATE TABLE t (id int, note text, secret text);\nCOPY t (id, note, secret) FROM stdin WITH (FORMAT csv);\n1,"",x\n2,,yy\n3,"plain",zz\n4,"a, ""b""\nc","q"\n\\.\nSELECT 1;\n')
    rows = Policy.model_validate({"global": {"salt": "s" * 40}, "tables": {"t": {"columns": {"secret": {"strategy": "mask"}}}}})
    mask_dump(spark, str(tmp_path / "d.sql"), str(tmp_path / "out"), rows)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert '\n1,"",*\n2,,**\n3,"plain",**\n4,"a, ""b""\nc",*\n\\.\n' in text
    got = {r.id: r.note for r in dump_tables(read_dump(spark, str(tmp_path / "out")))["t"].collect()}
    assert got == {1: "", 2: None, 3: "plain", 4: 'a, "b"\nc'}


def test_numbers_are_written_once(spark, tmp_path, monkeypatch):
    """Rounds and batches write what is new, not what was given before."""
    written = []
    import shroudlake.operators.integrity as integrity

    keep = integrity.durable
    monkeypatch.setattr(integrity, "durable", lambda df: (lambda out: (written.append((out.columns, out.count())), out)[1])(keep(df)))
    known = unique_mapping(spark.range(300).withColumnRenamed("id", "k"), "k", "s" * 32, 1, 400)
    first = sum(n for c, n in written if c == ["value", "token"])
    assert first == 300 and len({r.token for r in known.collect()}) == 300
    written.clear()
    unique_mapping(spark.range(290, 310).withColumnRenamed("id", "k"), "k", "s" * 32, 1, 400, known)
    assert sum(n for c, n in written if c == ["value", "token"]) == 10


def test_masked_dumps_of_many_files_read_back_whole(spark, tmp_path):
    """A dump stays one file, with its definition and all rows of a statement; files that share a folder don't mix."""
    (tmp_path / "in").mkdir()
    ddl, head = "CREATE TABLE t (id int, note text);\n", "COPY t FROM stdin WITH (FORMAT csv);\n"
    for k in range(3):  # the first two end in the middle of their data, as a file may
        (tmp_path / "in" / f"{k}.sql").write_text(ddl + head + "".join(f'{i},"a ""{i}"""\n' for i in range(400 * k, 400 * k + 400)) + "\\.\n" * (k == 2))
    rules = Policy.model_validate({"global": {"salt": SALT}, "tables": {"t": {"columns": {"note": {"strategy": "mask"}}}}})
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for n, coalesce in ((7, "false"), (1, "true")):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            mask_dump(spark, str(tmp_path / "in"), str(tmp_path / f"out{n}"), rules)
            got = {r.id: r.note for r in dump_tables(read_dump(spark, str(tmp_path / f"out{n}")))["t"].collect()}
            assert got == {i: "*" * len(f'a "{i}"') for i in range(1200)}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_copy_text_over_many_tasks(spark, tmp_path):
    """The query's rows and nulls in COPY text don't depend on how large a partition may be."""
    from shroudlake import registered

    from .against import SF

    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = registered.QUERIES["copy_text_part"](spark, SF).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    want = {r.p_partkey: None if r.p_partkey % 3 == 0 else f"{r.p_brand}\t{r.p_type}" for r in registered.read(spark, SF, "part").collect()}
    assert len(got) == len(want) and {r.p_partkey: r.note for r in got} == want
