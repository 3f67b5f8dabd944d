import duckdb
import pytest

from tessera.llm import common as C
from tessera.llm import mixing as X
from tessera.llm import stages


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cols = "doc_id, source, lang, topic, n_tokens, weight, probability, sampled"
    want = con.execute(f"SELECT {cols} FROM ({X.ORACLE}) ORDER BY doc_id").fetchall()
    got = sorted(map(tuple, X.op5_mixing(spark, sf).selectExpr(*cols.split(", ")).collect()))
    assert [x[:5] + x[7:] for x in got] == [x[:5] + x[7:] for x in want]
    for x, y in zip(got, want):
        assert x[5:7] == pytest.approx(y[5:7], abs=2e-6)


def test_margins_meet_their_targets(spark):
    out = X.mix(C.table(spark, "/root/testdata/sf0.1", "documents")).collect()
    total = sum(r.n_tokens for r in out)
    for level in X.CELL:
        real, weighted = {}, {}
        for r in out:
            real[r[level]] = real.get(r[level], 0) + r.n_tokens
            weighted[r[level]] = weighted.get(r[level], 0) + r.n_tokens * r.weight / total
        norm = sum(v ** X.TEMPER for v in real.values())
        for k, v in real.items():
            assert weighted[k] == pytest.approx(v ** X.TEMPER / norm, rel=1e-4)
    assert sum(r.n_tokens * r.probability for r in out) == pytest.approx(X.KEEP * total, rel=1e-6)
    assert sum(r.n_tokens for r in out if r.sampled) == pytest.approx(X.KEEP * total, rel=0.05)


def test_sampled_margins(spark, messy, nothing):
    """Whole repeats and a draw meet every target; without repeats the levels that
    stay away from theirs are listed."""
    docs = C.table(spark, "/root/testdata/sf0.1", "documents")
    full = X.reach(docs, repeats=True).collect()
    assert all(r.reached and r.drawn == pytest.approx(r.target, rel=1e-3) for r in full)
    once = {(r.level, r.value): r for r in X.reach(docs).collect()}
    assert len(once) == len(full)
    print([tuple(r) for r in once.values() if r.level == "topic"], sum(not r.reached for r in once.values()), len(once))
    assert not any(once["topic", x].reached for x in ("contact", "credentials", "licence", "table"))
    out = X.mix(docs, repeats=True).collect()
    total = sum(r.n_tokens for r in out)
    assert sum(r.n_tokens * r.copies for r in out) == pytest.approx(X.KEEP * total, rel=0.05)
    for r in full:
        if r.level == "topic":
            got = sum(x.n_tokens * x.copies for x in out if x.topic == r.value) / (X.KEEP * total)
            assert got == pytest.approx(r.target, rel=0.1)
    rows = X.sample(messy, repeats=True)
    assert rows.columns == messy.columns and rows.count() == sum(r.copies for r in X.mix(messy, repeats=True).collect())
    assert X.reach(nothing).collect() == [] and X.sample(nothing, repeats=True).collect() == []


def test_messy(spark, messy, nothing):
    out = X.mix(messy).collect()
    assert len(out) == messy.count() and all(0 <= r.probability <= 1 for r in out)
    assert X.mix(nothing).collect() == []
    kept = stages.mixing(spark, messy, "")
    assert kept.columns == messy.columns and kept.count() == sum(r.sampled for r in out)
    assert stages.mixing(spark, nothing, "").collect() == []
    blank = C.store(messy.where("text IS NULL"), "blank")
    assert len(X.mix(blank).collect()) == blank.count()


def test_no_python_in_the_plan(spark, sf):
    plan = X.op5_mixing(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
