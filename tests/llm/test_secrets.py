import hashlib
import re
import zlib

from tessera.llm import common as C
from tessera.llm import secrets as X


def brute(rows):
    """Places and hashes of all candidates."""
    out = []
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            for j, w in enumerate(re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").split(" ")):
                for k, m in enumerate(re.findall(X.CANDIDATE, w)):
                    out.append((str(d), i, j, k, hashlib.sha256(m.encode()).hexdigest()))
    return sorted(out)


def test_candidates_are_complete(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((str(r.doc_id), r.line_no, r.word_no, r.part_no, r.secret_sha256) for r in X.op7_secrets(spark, sf).collect())
    assert got == brute(rows) and got


def test_held_out_accuracy(spark):
    """On the fold that training left out, secrets are found and the rest removed."""
    out = X.scan(C.table(spark, "/root/testdata/sf0.1", "documents")).collect()
    held = [r for r in out if r.label is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    secret, none = [r for r in held if r.label == 1], [r for r in held if r.label == 0]
    assert len(secret) > 10 and len(none) > 100
    assert sum(r.is_secret for r in secret) >= 0.95 * len(secret)
    assert sum(r.is_secret for r in none) <= 0.01 * len(none)
    # strings that no rule of thumb labels, but that are of a secret's shape
    token = [r for r in out if re.fullmatch("[0-9a-fA-F]{40}", r.candidate)]
    assert sum(r.is_secret for r in token) >= 0.95 * len(token)


def test_messy(spark, messy, nothing):
    assert X.scan(nothing).collect() == []
    rows = [(1, 'x token = "9a8b99b6f89edc9746a2ef7e89e21f68bcb4543d" y', "a"), (1, 'x token = "9a8b99b6f89edc9746a2ef7e89e21f68bcb4543d" y', "a"),
            (None, "ABCDEFGHIJKLMNOPQRSTU,abcdefghijklmnopqrst\n\n 1234567890123456", "b"), (3, None, "c"), (4, "", "d"),
            (5, "https://example.com/a/deep/path/to/some/page " * 3, "e")]
    docs = C.store(spark.createDataFrame(rows, "doc_id long, text string, candidate string"), "secrets")
    out = X.scan(docs).collect()
    assert len(out) == len(brute([r[:2] for r in rows]))
    assert all(0 <= r.probability <= 1 for r in out)
    open_labels = spark.createDataFrame([], "candidate string, label double")
    assert {r.probability for r in X.scan(docs, open_labels).collect()} == {0.5}
    assert X.scan(messy).count() == len(brute([(r.doc_id, r.text) for r in messy.collect()]))


def test_short_punctuated_and_embedded(spark):
    """Values of credential names and of URLs, which no long run holds."""
    want = {'password = "P@ssw0rd!2024#x" end': "P@ssw0rd!2024#x", "PASSWORD=abc.12 next": "abc.12", "db_passwd: s3cr3t!, then": "s3cr3t!",
            "api_key='k$9-zz.1'": "k$9-zz.1", 'passphrase = "correct horse battery staple" end': "correct horse battery staple",
            "{'token': 'hunter2.x'}": "hunter2.x", "Authorization: Bearer ab.cd.ef": "ab.cd.ef", "secret :=pa55.wd": "pa55.wd",
            "see postgres://u:K3Y.x!@host/db now": "K3Y.x!", "clone https://gh.T0ken@host/x now": "gh.T0ken", "passphrase: correcthorsebatterystaple": "correcthorsebatterystaple",
            "at postgres://u:ABCDEFGHIJKLMNOPQRST@host": "ABCDEFGHIJKLMNOPQRST"}
    plain = ["the key to it all", "https://example.com/a?b=c", "a token of it: none", 'monkey "business" here', "mail me@example.com"]
    docs = C.store(spark.createDataFrame(list(enumerate([*want, *plain])), "doc_id long, text string"), "short")
    out = X.scan(docs).collect()
    assert {(r.doc_id, r.candidate) for r in out} == set(enumerate(want.values()))
    assert not any(r.label == 0 for r in out)
    # what a forest that has long tokens and short passwords to learn from makes of them
    rows = [f'password = "p{i}.x!{i * 7}"' if i % 2 else f"plain {'abcdefghij' * 2}{'klmnop'[:i % 6]} text" for i in range(200)]
    rows += [f"see postgres://u:q.{i + 10}!z@host/db" for i in range(20)]
    out = X.scan(C.store(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "learnt")).collect()
    assert len(out) == 220 and all(r.is_secret == (r.doc_id % 2 == 1) for r in out if r.doc_id < 200)
    assert all(r.label is None for r in out if r.doc_id >= 200)  # open, so not trained away


def test_no_python_in_the_plan(spark, sf):
    plan = X.op7_secrets(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
