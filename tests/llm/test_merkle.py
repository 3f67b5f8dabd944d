import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def brute(leaves):
    """leaves: (group, doc_id, digest, given)."""
    none_first = lambda x: (x is not None, x)
    groups = {}
    for g, i, d, given in leaves:
        groups.setdefault(g, []).append((none_first(i), d, none_first(given)))
    names = sorted(groups, key=lambda g: b"" if g is None else b"+" + g.encode())
    trees = {g: levels([x[1] for x in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for g in names:
        for i, (doc_id, d, given) in enumerate(sorted(groups[g])):
            proof, digest = "", given[1] or d
            for tree, at in ((trees[g], i), (top, names.index(g))):
                for level in tree[:-1]:
                    a = at // 3 * 3
                    left, right = "".join(level[a:at]), "".join(level[at + 1:a + 3])
                    proof, digest, at = proof + left + right, sha(left + digest + right), at // 3
            root = top[-1][0]
            out.append((doc_id[1], d, trees[g][-1][0], root, sha(proof), digest, digest == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 27, 28, 100])
def test_sweeps(n):
    """The queue delivers what a plain reduction makes, and every proof folds to the top."""
    leaves = [sha(str(i)) for i in range(n)]
    tree = M.Tree(n)
    digests = tree.forward(leaves)
    assert digests == [d for level in levels(leaves) for d in level]
    proofs = tree.backward(digests, ("x", "y", None))
    assert all(M.folded(d, p) == sha("x" + digests[-1] + "y") for d, p in zip(leaves, proofs))
    assert M.folded(sha("other"), proofs[0]) != sha("x" + digests[-1] + "y")


@pytest.mark.parametrize("block", [9, 3 ** 8])
def test_equal_to_plain_trees(spark, block):
    """Several tiers of small blocks; a hot group, small groups, the null group, null
    and repeated ids, repeated rows, given leaves."""
    rows = [("hot", i, sha(f"h{i}"), None if i % 4 else sha("changed")) for i in range(800)]
    rows += [(f"g{i % 30}", i, sha(f"g{i}"), None) for i in range(100)]
    rows += [(None, 1, sha("n"), None), ("é", None, sha("a"), None), ("é", None, sha("b"), sha("c")), ("é", 3, sha("d"), None), ("é", 3, sha("d"), None), ("", 5, sha("e"), None)]
    df = spark.createDataFrame(rows, "grp string, doc_id long, digest string, given string").repartition(5)
    got = sorted((tuple(r) for r in M.manifest(df, block).collect()), key=str)
    assert got == brute(rows)


def test_documents(spark, messy, nothing, sf):
    columns = [F.col(c) for c in M.COLUMNS]
    plain = [(plain_leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text), r.doc_id) for r in messy.select(*M.COLUMNS).collect()]
    got = messy.select(M.leaf(*columns).alias("leaf"), "doc_id", M.tampered(F.col("doc_id")).alias("bad")).collect()
    assert sorted(plain, key=str) == sorted(((r.leaf, r.doc_id) for r in got), key=str)
    assert all(r.bad == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0) for r in got)
    out = M.manifest(messy.select(F.col("source").alias("grp"), "doc_id", M.leaf(*columns).alias("digest"), F.lit(None).cast("string").alias("given"))).collect()
    assert len(out) == messy.count() and all(r.verified and r.folded_root == r.root for r in out) and len({r.root for r in out}) == 1
    assert M.manifest(nothing.select(F.col("source").alias("grp"), "doc_id", F.col("text").alias("digest"), F.col("text").alias("given"))).collect() == []


def test_query_finds_tampering(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = M.op11_merkle(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 2 == 1 or "\n" not in (docs[r.doc_id] or ""))
