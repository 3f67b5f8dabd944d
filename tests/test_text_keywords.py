from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import keywords as K
from tessera.plans.corpus import Corpus


def tokens_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id LONG, text STRING")
    return [r["t"] for r in df.select(T.clean_tokens(F.col("text")).alias("t")).orderBy("doc_id").collect()]


def test_clean_reference_case(spark):
    (toks,) = tokens_of(spark, ["Hello <p>World</p>! 123"])
    assert "hello" in toks and "world" in toks
    assert toks == ["hello", "world"]


def test_clean_edge_cases(spark):
    out = tokens_of(spark, [None, "   ", "<b>Café</b> naïve", "a bb x2y _under", "abcdefghijklmnop abcdefghijklmno"])
    assert out[0] == [] and out[1] == []
    assert out[2] == ["cafe", "naive"]
    assert out[3] == ["bb", "under"] or out[3] == ["bb"]  # digits split; leading '_' token dropped
    assert out[4] == ["abcdefghijklmno"]  # 16 letters dropped, 15 kept


def test_stop_words_bridge(spark):
    df = spark.createDataFrame([(0, "river and bank")], "doc_id LONG, text STRING")
    c = Corpus(df)
    grams = c.prepared.select(F.array_sort(F.array_distinct(T.ngrams(F.col("content"))))).first()[0]
    assert "river bank" in grams and "and" not in " ".join(grams).split()


def _kept(spark, rows):
    """Rows that the threshold of the product path keeps."""
    scored = spark.createDataFrame(rows, "doc_id LONG, keyword STRING, score DOUBLE")
    lists = scored.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("keyword", "score"))).alias("kws"))
    return K.explode_keywords(K.threshold_array(lists)).collect()


def test_threshold_reference_case(spark):
    kept = _kept(spark, [(0, "topic1", 0.9), (0, "topic2", 0.1)])
    assert [r["keyword"] for r in kept] == ["topic1"]


def test_threshold_edges(spark):
    rows = [(1, "a", 0.9), (1, "b", 0.3),            # exactly max/3 is dropped
            (2, "c", -0.2), (2, "d", -0.5),          # negative maximum keeps nothing
            (3, "e", 0.5), (3, "f", 0.5)]            # ties both kept
    kept = sorted((r["doc_id"], r["keyword"]) for r in _kept(spark, rows))
    assert kept == [(1, "a"), (3, "e"), (3, "f")]


def test_empty_document_has_no_keywords(spark):
    df = spark.createDataFrame([(0, ""), (1, "alpha beta gamma alpha")], "doc_id LONG, text STRING")
    kw = Corpus(df).keywords().collect()
    assert {r["doc_id"] for r in kw} == {1}


def test_mmr_with_zero_diversity_is_plain_top_n(spark):
    df = spark.createDataFrame(
        [(i, " ".join(f"w{(i * 7 + j * 3) % 23}x" for j in range(40))) for i in range(6)], "doc_id LONG, text STRING")
    c = Corpus(df)
    plain = {(r["doc_id"], r["keyword"]) for r in c.keywords(use_mmr=False, thresholded=False).collect()}
    mmr0 = {(r["doc_id"], r["keyword"]) for r in c.keywords(use_mmr=True, thresholded=False, diversity=0.0).collect()}
    assert plain == mmr0


def test_mmr_matches_sequential_definition(spark):
    import numpy as np
    df = spark.createDataFrame([(0, "solar panel solar energy panel grid wind energy storage grid battery")],
                               "doc_id LONG, text STRING")
    c = Corpus(df)
    cands = c.scored.first()["cands"]
    rel = np.array([x["rel"] for x in cands])

    def bag(x):
        out = {}
        for e in x["m"]:
            out[e["token"]] = out.get(e["token"], 0.0) + e["idf"]
        return out

    bags = [bag(x) for x in cands]

    def sim(a, b):
        num = sum(v * bags[b].get(t, 0.0) for t, v in bags[a].items())
        return num / (np.sqrt(sum(v * v for v in bags[a].values())) * np.sqrt(sum(v * v for v in bags[b].values())))

    picks = [int(np.argmax(rel))]
    while len(picks) < min(10, len(cands)):
        best, arg = None, None
        for i in range(len(cands)):
            if i in picks:
                continue
            s = 0.6 * rel[i] - 0.4 * max(sim(i, p) for p in picks)
            if best is None or s > best + 1e-12:
                best, arg = s, i
        picks.append(arg)
    expect = {cands[p]["keyword"] for p in picks}
    got = {r["keyword"] for r in c.keywords(thresholded=False).collect()}
    assert got == expect


def test_picks_equal_candidate_rows_without_making_them(spark):
    from tessera.operators import keywords as K
    texts = [(0, "solar panel solar energy panel grid"), (1, "same same same same"), (2, "single"), (3, ""), (None, "née straße été née"),
             (4, "zz aa zz aa zz bb aa aab aa_b"), (5, None)]
    c = Corpus(spark.createDataFrame(texts, "doc_id LONG, text STRING"))
    rows = {}
    for r in c.candidates.collect():
        rows.setdefault(r["doc_id"], []).append((-r["rel"], r["keyword"].encode(), r["keyword"]))
    want = {d: [(k, -rel) for rel, _, k in sorted(x)[:10]] for d, x in rows.items()}
    got = {r["doc_id"]: [(p["keyword"], p["rel"]) for p in r["picks"]] for r in K.picked(c.sequences).collect()}
    assert got == want and None in got and 3 not in got
    for use_mmr in (True, False):
        plan = c.keywords(use_mmr=use_mmr)._jdf.queryExecution().optimizedPlan().toString()
        assert "cnorm" not in plan  # before, every candidate was a row with its norm
