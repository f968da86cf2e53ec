from __future__ import annotations

import json
import logging

import pytest

from shroudlake.integrations import JsonLines, annotations, mask_task, step_summary
from shroudlake.operators.discovery import Detection
from shroudlake.operators.integrity import ForeignKey
from shroudlake.plans.policy import Policy
from shroudlake.sources.database import _connection, changed_rows, imported_keys, mask_in_place, primary_key, read_jdbc, tables_of
from shroudlake.sources.duckdb_file import duckdb_tables, mask_duckdb

URL = "jdbc:derby:memory:shop;create=true"


@pytest.fixture(scope="module")
def shop(spark):
    with _connection(spark, URL) as c:
        for sql in (
            "CREATE TABLE USERS (ID INT PRIMARY KEY, EMAIL VARCHAR(80), SALARY DOUBLE)",
            "CREATE TABLE ORDERS (A INT, B INT, USER_ID INT, PRIMARY KEY (A, B), CONSTRAINT F FOREIGN KEY (USER_ID) REFERENCES USERS (ID))",
            "CREATE TABLE LOGS (MESSAGE VARCHAR(20))",
            "INSERT INTO USERS VALUES (1, 'ann@x.org', 10.0), (2, 'bob@y.org', 20.0), (3, NULL, 30.0)",
            "INSERT INTO ORDERS VALUES (1, 1, 1), (1, 2, 2)",
        ):
            c.createStatement().executeUpdate(sql)
    return URL


def rules(**columns):
    return Policy.model_validate({"global": {"salt": "s" * 32}, "tables": {"users": {"where_clause": "ID < 3", "columns": columns}, "logs": {"columns": {"message": {"strategy": "mask"}}}}})


def test_catalog(spark, shop):
    assert {"USERS", "ORDERS", "LOGS"} <= set(tables_of(spark, shop)) and primary_key(spark, shop, "ORDERS") == ["A", "B"] and primary_key(spark, shop, "LOGS") == []
    assert imported_keys(spark, shop, "ORDERS") == [ForeignKey("orders", ("user_id",), "users", ("id",))]


def test_partitioned_read(spark, shop):
    df = read_jdbc(spark, shop, "USERS", where="SALARY > 15", key="ID", partitions=2)
    assert sorted(r.ID for r in df.collect()) == [2, 3] and "PushedFilters: [*IsNotNull(SALARY), *GreaterThan(SALARY,15.0)]" in df._jdf.queryExecution().executedPlan().toString()


def test_mask_in_place(spark, shop):
    assert mask_in_place(spark, shop, "USERS", rules(email={"strategy": "email_mask"}, salary={"strategy": "constant", "params": {"value_to_set": 0.0}, "condition": "id == 2"})) == 2
    got = {r.ID: (r.EMAIL, r.SALARY) for r in read_jdbc(spark, shop, "USERS").collect()}
    assert got == {1: ("a*n@x.org", 10.0), 2: ("b*b@y.org", 0.0), 3: (None, 30.0)} and "USERS_MASKED" not in tables_of(spark, shop)
    with pytest.raises(ValueError, match="primary key"):
        mask_in_place(spark, shop, "LOGS", rules())
    with pytest.raises(PermissionError):
        mask_in_place(spark, "jdbc:postgresql://prod.x.org/app", "USERS", rules())
    same = read_jdbc(spark, shop, "USERS")
    assert changed_rows(same, same, ["ID"]).isEmpty()


def test_duckdb_file(spark, tmp_path):
    import duckdb

    path = str(tmp_path / "a.duckdb")
    with duckdb.connect(path) as con:
        con.execute("CREATE TABLE users AS SELECT i AS id, 'user' || i AS name FROM range(50) r(i)")
    mask_duckdb(spark, path, "users", Policy.model_validate({"global": {"salt": "s" * 32}, "tables": {"users": {"columns": {"name": {"strategy": "mask", "params": {"keep_first": 1}}}}}}), str(tmp_path))
    with duckdb.connect(path) as con:
        assert con.execute("SELECT count(*), count(DISTINCT id), min(name), max(name) FROM users").fetchall() == [(50, 50, "u****", "u*****")]
    assert duckdb_tables(path) == ["users"]


def test_integrations(spark, tmp_path, monkeypatch):
    assert annotations([Detection("t", "c", "email", 0.9, "hash", {}, "50%\nmatch")]) == ["::error title=Personal data in t.c::email (50%25%0Amatch)"]
    monkeypatch.setenv("GITHUB_STEP_SUMMARY", str(tmp_path / "s.md"))
    assert "| rows | 3 |" in step_summary("Run", {"rows": 3}) and "### Run" in (tmp_path / "s.md").read_text()
    line = JsonLines().format(logging.LogRecord("x", logging.INFO, "f", 1, "a %s", ("b",), None))
    assert json.loads(line)["message"] == "a b"
    (tmp_path / "users.csv").write_text("id,email\n1,a.b@c.org\n")
    (tmp_path / "p.yaml").write_text("global: {salt: 0123456789abcdef0123456789abcdef}\ntables: {users: {columns: {email: {strategy: email_mask}}}}")
    assert mask_task(["-c", str(tmp_path / "p.yaml"), "-i", str(tmp_path / "users.csv"), "-o", str(tmp_path / "out.csv")]) == 0
