"""The pipeline, stage by stage, against plain versions of the decisions."""

import duckdb
import pytest

import corpus_pipeline as P
from tessera.llm import common as C
from tessera.llm import factorization as FM
from tessera.llm import mixing as MX
from tessera.llm import pieces as PC

from .test_dart_minhash import brute as near_classes
from .test_exact_dedup import squeeze


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """The documents and what each stage makes of them, written and read again."""
    docs, out = C.table(spark, sf, "documents"), []
    out.append(docs)
    for i, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(steps):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mixing", "pieces"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality(spark, sf, steps):
    want = {r.doc_id for r in FM.op3_factorization(spark, sf).collect() if r.predicted}
    assert set(rows(steps[1])) == want


def test_exact(steps):
    best = {}
    for d, t in rows(steps[1]).items():
        k = squeeze(t)
        best[k] = min(best.get(k, (0, 1 << 62)), (-len(t or ""), d))
    assert set(rows(steps[2])) == {d for _, d in best.values()}


def test_near(steps):
    before = sorted(rows(steps[2]).items())
    classes = near_classes(before)
    first = {}
    for (d, _), c in zip(before, classes):
        first[c] = min(first.get(c, d), d)
    assert set(rows(steps[3])) == set(first.values())


def test_mixing(steps, tmp_path):
    path = str(tmp_path / "near")
    steps[3].write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = {r[0] for r in con.execute(f"SELECT doc_id FROM ({MX.ORACLE}) WHERE sampled").fetchall()}
    assert set(rows(steps[4])) == want


def test_pieces(steps):
    back = PC.decode(steps[5], PC.load()).collect()
    assert {r.doc_id: r.decoded for r in back} == rows(steps[4])
    assert all(len(r.piece_ids) == r.n_pieces for r in back)


def test_run(spark, sf, steps):
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, steps[5].collect()))
