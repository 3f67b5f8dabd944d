import random

import duckdb
import pyarrow as pa
import pytest

from tessera.llm import common as C
from tessera.llm import url_filter as X


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    cols = "page_id, host, path, rule, verdict"
    got = sorted(map(str, map(tuple, X.op10_url_filter(spark, sf).selectExpr(*cols.split(", ")).collect())))
    assert got == sorted(map(str, con.execute(f"SELECT {cols} FROM ({X.ORACLE})").fetchall()))


def test_rules_and_edges(spark, nothing):
    urls = {None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
            "http://A.Net/x?y": ("a.net", "/x", "net/", "block"), "https://example.net/en/1#t": ("example.net", "/en/1", "example.net/en/", "allow"),
            "https://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"), "http://x.net": ("x.net", "", None, "allow"),
            "http://m.example.com/de/a": ("m.example.com", "/de/a", "example.com/de/", "block"), "http://spam-x.org/fr/a": ("spam-x.org", "/fr/a", "org/fr/", "allow"),
            "http://spam-x.org/en?://b/": ("spam-x.org", "/en", None, "block"), "x://É.org?q/fr/": ("É.org", "", None, "allow")}
    rows = [(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, "http://porn.com", "x", "y"), (0, None, "x", "y")]
    pages = C.store(spark.createDataFrame(rows, "page_id long, url string, listed string, host string"), "pages")
    for max_keys in (X.MAX_KEYS, 0):  # cascade, join
        out = X.url_filter(pages, max_keys=max_keys).collect()
        assert len(out) == len(rows)
        for r in out:
            want = ("porn.com", "", None, "block") if r.page_id is None else list(urls.values())[r.page_id]
            assert (r.host, r.path, r.rule, r.verdict) == want
    assert X.url_filter(nothing.selectExpr("doc_id AS page_id", "text AS url")).collect() == []


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_membership_is_exact(spark, monkeypatch, share):
    """With filters far too small, several levels are needed and all keys come out right."""
    monkeypatch.setattr("tessera.llm.bits.MIN_BITS", 1 << 12)
    monkeypatch.setattr("tessera.llm.bits.MAX_BITS", 1 << 13)
    rng = random.Random(4)
    keys = [(f"h{i}.example", rng.random() < share) for i in range(5000)]
    universe = C.store(spark.createDataFrame(keys, "host string, listed boolean"), "universe")
    levels = X.build(universe)
    assert X.member(levels, pa.array([k for k, _ in keys])).tolist() == [v for _, v in keys]
    assert share not in (0.02, 0.5) or len(levels) > 1


def test_given_list(spark):
    pages = C.store(spark.createDataFrame([(i, f"http://h{i % 7}.com/") for i in range(50)], "page_id long, url string"), "given")
    listed = spark.createDataFrame([("h3.com",), ("h5.com",), ("other.com",), (None,)], "host string")
    out = X.url_filter(pages, listed).collect()
    assert {r.page_id for r in out if r.verdict == "block"} == {i for i in range(50) if i % 7 in (3, 5)}
