import hashlib
import re

import duckdb

from tessera.llm import exact_dedup as X
from tessera.llm import stages


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_messy_rows(messy):
    rows = messy.collect()
    out = X.exact_dedup(messy).collect()
    assert len(out) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(squeeze(r.text), []).append(r)
    by_sha = {}
    for r in out:
        by_sha.setdefault(r.text_sha256, []).append(r)
    assert len(by_sha) == len(groups)
    for t, members in groups.items():
        got = by_sha[hashlib.sha256(t.encode()).hexdigest()]
        best = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        assert {r.keep_id for r in got} == {best.doc_id}
        assert {r.group_size for r in got} == {len(members)} and len(got) == len(members)
        assert sum(r.kept for r in got) == 1 and next(r for r in got if r.kept).doc_id == best.doc_id


def test_colliding_fingerprints_are_verified(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert X.collided(X.C.id_text(docs), 1)
    key = lambda df: sorted(df.drop("_row").collect())
    assert key(X.exact_dedup(docs, 1)) == key(X.exact_dedup(docs))


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({X.ORACLE})").fetchall())
    got = X.op2_exact_dedup(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == want


def test_empty_and_stage(spark, messy, nothing):
    assert X.exact_dedup(nothing).collect() == []
    kept = stages.exact(spark, messy, "")
    assert kept.columns == messy.columns
    assert kept.count() == len({squeeze(r.text) for r in messy.collect()})
    assert stages.exact(spark, nothing, "").collect() == []
