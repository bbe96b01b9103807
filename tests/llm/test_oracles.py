"""Registered corpus queries against their SQL: on a test table, and on a table with rejections and edge cases."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from colloquy.llm import queries

SF = "/root/testdata/sf0.001"


def compared(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    cur = con.execute(f"select {', '.join(names)} from ({queries.ORACLE_SQL[name]})")
    got = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, cur.fetchall()))
    return [dict(zip(names, r)) for r in got]


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """1,200 good documents, poor ones of symbols, near copies, nulls, empty and blank texts, repeated rows, a null language."""
    folder, rng = tmp_path_factory.mktemp("planted"), np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(4000)])
    rows = [(i, " ".join(rng.choice(words, 60, replace=False)), "en") for i in range(1200)]
    rows += [(2000 + i, " ".join(rng.choice(words, 60, replace=False)) + " ###" * 60, "en") for i in range(40)]
    rows += [(3000 + i, " ".join([f"x{i}", *(f"y{k}" for k in range(100))]), "de") for i in range(30)]
    rows += [(4000, None, "en"), (4001, "", None), (4002, " \n\t ", "en"), (4003, "A b\x0bC", "en"), (4004, "a b c", "en"), (4004, "a b c", "en"), (4005, "w " * 20_000, "en"), (4006, "l\n" * 60, None), (4007, "ü 漢字 😀 \xa0 x", "fr")]
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "lang"]).assign(source="s", n_chars=0)
    docs.to_parquet(folder / "documents.parquet", index=False)
    ids = docs.doc_id[docs.doc_id < 2040].to_numpy()
    pd.DataFrame({"doc_id": ids, "quality": (ids < 2000).astype("int64"), "toxic": 0}).to_parquet(folder / "labels.parquet", index=False)
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compared(spark, SF, name)


def test_quality_query_rejects_as_its_sql(spark, planted):
    rows = {r["doc_id"]: r for r in compared(spark, planted, "op6_quality_rules")}
    assert all(rows[i]["kept"] for i in range(1200)) and not any(rows[i]["kept"] or rows[i]["base_failed"] for i in range(2000, 2040))


def test_jaccard_query_equals_its_sql_on_edges(spark, planted):
    rows = compared(spark, planted, "op10_ngram_jaccard")
    assert {r["component_id"] for r in rows if 3000 <= r["doc_id"] < 3030} == {3000}
    assert {r["component_id"] for r in rows if r["doc_id"] in (4003, 4004)} == {4003}  # a vertical tab parts words, A-Z are lower-cased: the same three words
