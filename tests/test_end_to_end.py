import os
import uuid

from pyspark.sql import functions as F

from tessera.plans import build as B
from tessera.plans import predict as PR
from tessera.plans.corpus import Corpus
from tessera.session import ensure_checkpoint_dir, table
from tessera.sources import corpus as S
from tessera.sources import store as ST
from tessera.streaming import predict_stream as PS

SF = "/root/testdata/sf0.001"


def rows(df, cols):
    return sorted(tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in cols) for r in df.collect())


def test_build_reload_predict_stream(spark):
    root = os.path.join(ensure_checkpoint_dir(spark), f"e2e-{uuid.uuid4().hex}")
    out, b = B.build_topics(Corpus(S.read_corpus(spark, SF)), "e2e", B.Params(method="KMeans", k=4), root=root)
    cols = ["topic", "n_documents", "documents", "topic_keywords"]
    built = rows(out.listed(), cols)
    assert built, "flagship produced no topics"
    # reload from the saved tables gives the same table
    assert rows(B.reload_topics(spark, root, "e2e").listed(), cols) == built
    # threshold >= 1 is the identity collapse
    same = B.recollapse(spark, root, "e2e", 1.0)
    assert sorted(r["topic"] for r in same.counts.collect()) == sorted(r["topic"] for r in b["topics"].collect())
    # the same parameters and documents reuse the scenario, others do not
    last = ST.manifest(spark, root, "e2e")
    again, parts = B.build_topics(Corpus(S.read_corpus(spark, SF)), "e2e", B.Params(method="KMeans", k=4), root=root)
    assert rows(again.listed(), cols) == built and parts.topics.counts.count() == b["topics"].count()
    entry = ST.manifest(spark, root, "e2e")
    assert entry[0] == last[0] + 1 and {k for k in entry[2] if entry[2][k] != last[2][k]} == {"mapping", "params"}  # collapsed anew only
    marks = {B.fingerprint(Corpus(docs), p) for docs, p in (
        (S.read_corpus(spark, SF), B.Params(method="KMeans", k=4)), (S.read_corpus(spark, SF), B.Params(method="KMeans", k=5)),
        (S.read_corpus(spark, SF).where("doc_id <> 7"), B.Params(method="KMeans", k=4)))}
    assert len(marks) == 3 and entry[1] in marks
    # streaming prediction equals batch prediction (X1 = C3)
    new = table(spark, SF, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    batch = rows(PR.predict_topics(spark, new, root, "e2e"), ["doc_id", "topic"])
    src = os.path.join(SF, "benchmark*.parquet")
    stream = PS.run_available(spark, src, table(spark, SF, "benchmark").schema, root, "e2e",
                              os.path.join(root, "sink"), os.path.join(root, "ckpt"), id_col="item_id")
    assert rows(stream, ["doc_id", "topic"]) == batch
