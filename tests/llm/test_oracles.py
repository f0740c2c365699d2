"""The SQL of this subpackage against its queries, on small tables with nulls, empty texts, copies and repeated rows."""

import random

import duckdb
import pytest

from foresail.llm import queries as Q

WORDS = ["ant", "bee", "Cow", "döner", "#", "<x>", "eel\tfox", "gnu\n"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = random.Random(5)
    folder = str(tmp_path_factory.mktemp("sf"))
    texts = [None, "", " \n", "one", "one two\none two", "a b c " * 40, "line\nline\n\n\nline"] + [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 150))) for _ in range(30)]
    base = " ".join(str(r.random()) for _ in range(120))
    texts += [base, base, base.replace("0.", "0.1", 3), base + " more of it", base[:300]]
    docs = [(i, t, "en", ["a", "b", "c", None][i % 4], 0) for i, t in enumerate(texts)] + [(900 + i, "short", "en", "bad", 0) for i in range(20)] + [(950, base[:900], "en", "bad", 0), (950, base[:900], "en", "bad", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    turns = [(1, 0, "user", "hi <b> \\l"), (1, 1, "assistant", "a\\\\>b"), (2, 0, None, None), (2, 0, None, None), (3, 1, "assistant", "</turn>\n"), (3, None, "user", "ü"), (3, 2, "assistant", "")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet/*.parquet'")
    got = Q.queries()[name](spark, sf)
    want = con.sql(Q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(str, (tuple(x) for x in got.select(*cols).collect()))) == sorted(map(str, want.select(*[f'"{c}"' for c in cols]).fetchall()))
