"""Independent DuckDB SQL for every query that SQL can express.

These strings are the correctness oracle: the same definitions as the Spark
operators, written relationally (joins, group-bys, windows, unrolled rounds)
instead of with the in-row array code the Spark side uses. Views named like the
test tables (``documents``, ``pages``, ``embeddings`` …) are assumed.
"""

from __future__ import annotations

import glob
import os
import zipfile

import pyspark

from .functions.stopwords import LISTS, cleaned_stop_words

TOP_N = 10
DIVERSITY = 0.4


def stop_list() -> str:
    return "[" + ", ".join(f"'{w}'" for w in cleaned_stop_words()) + "]"


def public_words(language: str) -> list[str]:
    """MLlib's list of a language, read from the resources of the PySpark package, so that
    the SQL does not need a session."""
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    (jar,) = glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar"))
    with zipfile.ZipFile(jar) as z:
        return z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode().split()


def content_by_language_sql(codes) -> str:
    """The expression that takes the stop words of the row's language from ``tokens``."""
    case = " ".join(f"WHEN lang = '{c}' THEN [" + ", ".join(f"'{w}'" for w in cleaned_stop_words(public_words(LISTS[c]))) + "]" for c in codes)
    return f"list_filter(tokens, lambda t: NOT list_contains(stop, t)) AS content FROM (SELECT *, CASE {case} ELSE {stop_list()} END AS stop FROM tok)"


def language_ctes(codes, source: str = "documents") -> str:
    """``corpus_ctes`` with the stop words of each row's language."""
    plain = corpus_ctes(source)
    one = f"list_filter(tokens, lambda t: NOT list_contains({stop_list()}, t)) AS content FROM tok"
    return plain.replace("SELECT doc_id AS doc_id,", "SELECT doc_id AS doc_id, lang,", 1).replace(one, content_by_language_sql(codes), 1)


def phrase_ctes(source: str, id_col: str, text_col: str, name: str = "ph") -> str:
    """CTE ``name`` (doc_id, keyword): the distinct 1..3-grams of the content tokens."""
    gram = lambda n: " || ' ' || ".join(["c[i]", "c[i + 1]", "c[i + 2]"][:n])
    parts = " UNION ".join(f"SELECT doc_id, {gram(n)} AS keyword FROM {name}_at WHERE i + {n - 1} <= len(c)" for n in (1, 2, 3))
    return f""",
{name}_c AS (SELECT {id_col} AS doc_id, list_filter({tokens_sql(text_col)}, lambda t: NOT list_contains({stop_list()}, t)) AS c FROM {source}),
{name}_at AS (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM {name}_c),
{name} AS ({parts})"""


def tokens_sql(col: str) -> str:
    return ("list_filter(regexp_extract_all(strip_accents(lower(regexp_replace(coalesce(" + col +
            ", ''), '<([^>]+)>', '', 'g'))), '[\\p{L}\\p{Nl}\\p{No}_]+'), "
            "lambda t: length(t) BETWEEN 2 AND 15 AND NOT starts_with(t, '_'))")


def corpus_ctes(source: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """CTEs: tok, content, posr, dt, nd, ts, wt, dn, seq."""
    return f"""
tok AS (SELECT {id_col} AS doc_id, {tokens_sql(text_col)} AS tokens FROM {source}),
content AS (SELECT doc_id, tokens, list_filter(tokens, lambda t: NOT list_contains({stop_list()}, t)) AS content FROM tok),
posr AS (SELECT doc_id, unnest(content) AS token, generate_subscripts(content, 1) - 1 AS pos FROM content),
dt AS (SELECT doc_id, token, count(*) AS tf FROM posr GROUP BY doc_id, token),
nd AS (SELECT count(*)::DOUBLE AS n FROM {source}),
ts AS (SELECT token, count(*) AS df, sum(tf) AS cf,
              ln((any_value(nd.n) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf
       FROM dt, nd GROUP BY token),
wt AS (SELECT dt.doc_id, dt.token, dt.tf, ts.idf, dt.tf * ts.idf AS wd FROM dt JOIN ts USING (token)),
dn AS (SELECT doc_id, sqrt(list_reduce(list(wd * wd ORDER BY token), lambda a, b: a + b)) AS dnorm
       FROM wt GROUP BY doc_id),
seq AS (SELECT p.doc_id, p.pos, p.token, w.idf, w.wd FROM posr p JOIN wt w USING (doc_id, token))"""


def _pairsum(a: str, b: str) -> str:
    terms = [f"CASE WHEN {a}[{j}].token = {b}[{k}].token THEN {a}[{j}].idf * {b}[{k}].idf ELSE 0.0::DOUBLE END"
             for j in (1, 2, 3) for k in (1, 2, 3)]
    return "(" + " + ".join(terms) + ")"


def _dot(m: str) -> str:
    return "(" + " + ".join(f"coalesce({m}[{j}].idf * {m}[{j}].wd, 0.0::DOUBLE)" for j in (1, 2, 3)) + ")"


def _ent(x: str) -> str:
    return f"{{'token': {x}.token, 'idf': {x}.idf, 'wd': {x}.wd}}"


def candidate_ctes() -> str:
    """CTEs (after corpus_ctes): g, cand (doc_id, keyword, m, cnorm, rel)."""
    return f""",
grams AS (
  SELECT a.doc_id, a.token AS keyword, [{_ent('a')}] AS m FROM seq a
  UNION ALL
  SELECT a.doc_id, a.token || ' ' || b.token, list_sort([{_ent('a')}, {_ent('b')}])
  FROM seq a JOIN seq b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
  UNION ALL
  SELECT a.doc_id, a.token || ' ' || b.token || ' ' || c.token, list_sort([{_ent('a')}, {_ent('b')}, {_ent('c')}])
  FROM seq a JOIN seq b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
             JOIN seq c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2),
cm AS (SELECT doc_id, keyword, any_value(m) AS m FROM grams GROUP BY doc_id, keyword),
cand AS (SELECT cm.doc_id, cm.keyword, cm.m, sqrt({_pairsum('cm.m', 'cm.m')}) AS cnorm,
                CASE WHEN dn.dnorm > 0 THEN {_dot('cm.m')} / (sqrt({_pairsum('cm.m', 'cm.m')}) * dn.dnorm)
                     ELSE 0.0::DOUBLE END AS rel
         FROM cm JOIN dn USING (doc_id))"""


def top_ctes(top_n: int = TOP_N) -> str:
    """CTE topk (doc_id, keyword, score, rank): plain top-N by relevance."""
    return f""",
topk AS (SELECT doc_id, keyword, round(rel, 4) AS score, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rel DESC, keyword) AS rank FROM cand)
  WHERE rank <= {int(top_n)})"""


def mmr_ctes(top_n: int = TOP_N, diversity: float = DIVERSITY) -> str:
    """CTE mmr (doc_id, keyword, score, rank), unrolled rounds."""
    lam = float(diversity)
    keep = 1.0 - lam
    parts = [""",
s0 AS (SELECT doc_id, keyword, m, cnorm, rel, 0.0::DOUBLE AS maxsim, NULL::INTEGER AS po FROM cand)"""]
    for r in range(1, int(top_n) + 1):
        score = "rel" if r == 1 else f"{keep!r}::DOUBLE * rel - {lam!r}::DOUBLE * maxsim"
        parts.append(f""",
p{r} AS (SELECT doc_id, keyword AS pk, m AS pm, cnorm AS pc FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {score} DESC, keyword) AS rn
  FROM s{r - 1} WHERE po IS NULL) WHERE rn = 1),
s{r} AS (SELECT s.doc_id, s.keyword, s.m, s.cnorm, s.rel,
  CASE WHEN p.doc_id IS NULL THEN s.maxsim
       ELSE greatest(s.maxsim, {_pairsum('s.m', 'p.pm')} / (s.cnorm * p.pc)) END AS maxsim,
  CASE WHEN s.keyword = p.pk THEN {r} ELSE s.po END AS po
  FROM s{r - 1} s LEFT JOIN p{r} p USING (doc_id))""")
    parts.append(f""",
mmr AS (SELECT doc_id, keyword, score, rank::INTEGER AS rank FROM (
  SELECT doc_id, keyword, round(rel, 4) AS score,
         row_number() OVER (PARTITION BY doc_id ORDER BY round(rel, 4) DESC, po) AS rank
  FROM s{int(top_n)} WHERE po IS NOT NULL))""")
    return "".join(parts)


def threshold_cte(src: str, name: str) -> str:
    return f""",
{name} AS (SELECT doc_id, keyword, score, rank FROM (
  SELECT *, max(score) OVER (PARTITION BY doc_id) AS mx FROM {src}) WHERE score > mx / 3.0::DOUBLE)"""


def with_(*ctes: str) -> str:
    body = "".join(ctes)
    head = "WITH RECURSIVE " if "_g(rk, leaders)" in body else "WITH "
    return head + body.lstrip().lstrip(",")


def keywords_sql(use_mmr: bool = True, thresholded: bool = True, source: str = "documents",
                 id_col: str = "doc_id", text_col: str = "text") -> str:
    """CTE chain ending in ``kw`` (doc_id, keyword, score, rank)."""
    base = corpus_ctes(source, id_col, text_col) + candidate_ctes()
    if use_mmr:
        chain = base + mmr_ctes()
        src = "mmr"
    else:
        chain = base + top_ctes()
        src = "topk"
    if thresholded:
        chain += threshold_cte(src, "kw")
    else:
        chain += f""",
kw AS (SELECT * FROM {src})"""
    return chain


# ---------------------------------------------------------------- vectors

DIM = 64


def sign_sql(key: str, j: int) -> str:
    return (f"((((instr('0123456789abcdef', substr(md5(CAST({key} AS VARCHAR)), {j // 4 + 1}, 1)) - 1) "
            f">> {j % 4}) & 1) * 2 - 1)")


def token_vector_cte(src: str = "dt", name: str = "tvec", only: str | None = None) -> str:
    where = f" WHERE token IN (SELECT token FROM {only})" if only else ""
    sums = ", ".join(f"sum(tf * {sign_sql('doc_id', j)})::BIGINT" for j in range(DIM))
    return f""",
{name} AS (SELECT token, [{sums}] AS tv FROM {src}{where} GROUP BY token)"""


def _normalized(raw_cte: str, key: str, name: str) -> str:
    return f""",
{name} AS (SELECT {key}, CASE WHEN nrm > 0 THEN list_transform(raw, lambda x: x / nrm)
                       ELSE list_transform(raw, lambda x: x * 0.0::DOUBLE) END AS v
  FROM (SELECT {key}, raw, sqrt(list_reduce(list_transform(raw, lambda x: x * x), lambda a, b: a + b)) AS nrm
        FROM {raw_cte}))"""


def phrase_vector_ctes(phrases: str, key: str, text: str, name: str, tvec: str = "tvec") -> str:
    sums = ", ".join(f"sum(w * tv[{j + 1}])" for j in range(DIM))
    return f""",
{name}_tok AS (SELECT {key}, t AS token, count(*) AS n FROM (
    SELECT {key}, unnest(string_split({text}, ' ')) AS t FROM {phrases}) WHERE t <> '' GROUP BY {key}, t),
{name}_raw AS (SELECT p.{key}, [{sums}] AS raw FROM (
    SELECT {name}_tok.{key}, {name}_tok.n * ts.idf AS w, {tvec}.tv FROM {name}_tok
    JOIN ts USING (token) JOIN {tvec} USING (token)) p GROUP BY p.{key})""" + _normalized(f"{name}_raw", key, name)


def doc_vector_ctes(name: str = "dvec", tvec: str = "tvec") -> str:
    sums = ", ".join(f"sum(wd * tv[{j + 1}])" for j in range(DIM))
    return f""",
{name}_raw AS (SELECT doc_id, [{sums}] AS raw FROM wt JOIN {tvec} USING (token) GROUP BY doc_id)""" + \
        _normalized(f"{name}_raw", "doc_id", name)


def vec_text(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda x: CAST(round(x * 1000000) AS BIGINT)), ',')"


def cosine_sql(a: str, b: str) -> str:
    dot = f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]), lambda x, y: x + y)"
    na = f"sqrt(list_reduce(list_transform({a}, lambda x: x * x), lambda x, y: x + y))"
    nb = f"sqrt(list_reduce(list_transform({b}, lambda x: x * x), lambda x, y: x + y))"
    return f"(CASE WHEN {na} > 0 AND {nb} > 0 THEN {dot} / ({na} * {nb}) ELSE 0.0::DOUBLE END)"


# ---------------------------------------------------------------- topics on a fixed upstream

def fixed_topic_ctes() -> str:
    """After keywords_sql(): vocab, kc (keyword → md5 bucket of its first token,
    bucket 15 = noise), class tf-idf labels clab, keyword → topic kt, doc
    topics dtp, topic keywords tkw, topic table tt."""
    return """,
vocab AS (SELECT keyword, count(DISTINCT doc_id) AS n_documents FROM kw GROUP BY keyword),
kc AS (SELECT keyword, CASE WHEN b = 15 THEN -1 ELSE b END::INTEGER AS cluster FROM (
    SELECT keyword, instr('0123456789abcdef', substr(md5(split_part(keyword, ' ', 1)), 1, 1)) - 1 AS b FROM vocab)),
ctok AS (SELECT cluster, t AS token FROM (SELECT cluster, unnest(string_split(keyword, ' ')) AS t FROM kc
         WHERE cluster <> -1) WHERE t <> ''),
ctf AS (SELECT cluster, token, count(*) AS tf FROM ctok GROUP BY cluster, token),
ccf AS (SELECT token, sum(tf) AS cf FROM ctf GROUP BY token),
cavg AS (SELECT sum(tf)::DOUBLE / count(DISTINCT cluster) AS a FROM ctf),
cw AS (SELECT ctf.cluster, ctf.token, ctf.tf * ln(1.0::DOUBLE + cavg.a / ccf.cf) AS w FROM ctf JOIN ccf USING (token), cavg),
clab AS (SELECT cluster::INTEGER AS cluster, string_agg(token, ' ' ORDER BY rk) AS topic FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY w DESC, token) AS rk FROM cw) WHERE rk <= 5 GROUP BY cluster),
kt AS (SELECT kc.keyword, clab.topic FROM kc JOIN clab USING (cluster)),
dtp AS (SELECT DISTINCT kw.doc_id, kt.topic FROM kw JOIN kt USING (keyword)),
tkw AS (SELECT DISTINCT kt.topic, vocab.keyword FROM vocab JOIN kt USING (keyword)),
tt AS (SELECT d.topic, d.n_documents, d.documents, coalesce(k.kws, []::VARCHAR[]) AS topic_keywords FROM (
    SELECT topic, count(DISTINCT doc_id) AS n_documents, list_sort(list(DISTINCT doc_id)) AS documents FROM dtp GROUP BY topic) d
    LEFT JOIN (SELECT topic, list_sort(list(DISTINCT keyword)) AS kws FROM tkw GROUP BY topic) k USING (topic))"""


def topic_vector_ctes() -> str:
    """After fixed_topic_ctes(): token vectors of label tokens and topic vectors tvv."""
    return (""",
ltok AS (SELECT DISTINCT t AS token FROM (SELECT unnest(string_split(topic, ' ')) AS t FROM clab))"""
            + token_vector_cte(only="ltok") + phrase_vector_ctes("clab", "topic", "topic", "tvv"))


def greedy_ctes(nodes: str, pairs: str, name: str = "grp") -> str:
    """Sequential greedy grouping in SQL: ``nodes`` (id, rk 1..n) and ``pairs``
    (a, b) undirected. Output CTE ``name`` (id, leader)."""
    return f""",
{name}_e AS (SELECT CASE WHEN na.rk < nb.rk THEN p.a ELSE p.b END AS early,
                    CASE WHEN na.rk < nb.rk THEN p.b ELSE p.a END AS late,
                    least(na.rk, nb.rk) AS erk
             FROM {pairs} p JOIN {nodes} na ON na.id = p.a JOIN {nodes} nb ON nb.id = p.b),
{name}_nb AS (SELECT n.rk, n.id, list(e.early) FILTER (WHERE e.early IS NOT NULL) AS earlier
              FROM {nodes} n LEFT JOIN {name}_e e ON e.late = n.id GROUP BY n.rk, n.id),
{name}_g(rk, leaders) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL
   SELECT g.rk + 1, CASE WHEN len(list_filter(coalesce(nb.earlier, []::VARCHAR[]), lambda x: list_contains(g.leaders, x))) > 0
                    THEN g.leaders ELSE list_append(g.leaders, nb.id) END
   FROM {name}_g g JOIN {name}_nb nb ON nb.rk = g.rk + 1),
{name}_l AS (SELECT unnest(leaders) AS id FROM (SELECT leaders FROM {name}_g ORDER BY rk DESC LIMIT 1)),
{name} AS (SELECT id, id AS leader FROM {name}_l UNION ALL
   SELECT late AS id, arg_min(early, erk) AS leader FROM {name}_e
   WHERE early IN (SELECT id FROM {name}_l) AND late NOT IN (SELECT id FROM {name}_l) GROUP BY late)"""


def topic_mapping_ctes(threshold: float) -> str:
    """After topic_vector_ctes(): tnodes, tpairs, grouping tmap (topic, parent)."""
    t = float(threshold)
    return f""",
tnodes AS (SELECT tt.topic AS id, row_number() OVER (ORDER BY tt.n_documents DESC, tt.topic) AS rk
           FROM tt JOIN tvv ON tvv.topic = tt.topic),
tpairs AS (SELECT a.topic AS a, b.topic AS b FROM tvv a JOIN tvv b ON a.topic < b.topic
           JOIN tt ta ON ta.topic = a.topic JOIN tt tb ON tb.topic = b.topic
           WHERE {cosine_sql('a.v', 'b.v')} >= {t!r})""" + greedy_ctes("tnodes", "tpairs", "tgrp") + """,
tmap AS (SELECT id AS topic, leader AS parent FROM tgrp)"""


def merged_ctes(mapping: str = "tmap") -> str:
    return f""",
mdtp AS (SELECT DISTINCT coalesce(m.parent, d.topic) AS topic, d.doc_id FROM dtp d LEFT JOIN {mapping} m ON m.topic = d.topic),
mtkw AS (SELECT DISTINCT coalesce(m.parent, k.topic) AS topic, k.keyword FROM tkw k LEFT JOIN {mapping} m ON m.topic = k.topic),
mtt AS (SELECT d.topic, d.n_documents, d.documents, coalesce(k.kws, []::VARCHAR[]) AS topic_keywords FROM (
    SELECT topic, count(DISTINCT doc_id) AS n_documents, list_sort(list(DISTINCT doc_id)) AS documents FROM mdtp GROUP BY topic) d
    LEFT JOIN (SELECT topic, list_sort(list(DISTINCT keyword)) AS kws FROM mtkw GROUP BY topic) k USING (topic))"""


def table_select(t: str) -> str:
    return (f"SELECT topic, n_documents::BIGINT AS n_documents, array_to_string(documents, '|') AS documents, "
            f"array_to_string(topic_keywords, '|') AS topic_keywords FROM {t}")


# ---------------------------------------------------------------- new documents scored with corpus stats

import re as _re  # noqa: E402

_NAMES = r"\b(tok|content|posr|dt|nd|ts|wt|dn|seq|grams|cm|cand|s\d+|p\d+|mmr|kw|topk)\b"


def new_doc_keywords_sql(source: str, id_col: str, text_col: str, prefix: str = "b_") -> str:
    """CTE chain (to append after keywords_sql() of the corpus) giving
    ``{prefix}kw``: keywords of ``source`` rows scored with the corpus idf;
    tokens the corpus never saw get the df = 0 idf."""
    base = corpus_ctes(source, id_col, text_col)
    base = _re.sub(r"nd AS \(SELECT count\(\*\)::DOUBLE AS n FROM [a-z_]+\),\n", "", base)
    base = _re.sub(r"ts AS \(SELECT token.*?GROUP BY token\),\n", "", base, flags=_re.S)
    base = _re.sub(r"wt AS \(.*?USING \(token\)\),\n",
                   "wt AS (SELECT dt.doc_id, dt.token, dt.tf, coalesce(cts.idf, ln(cnd.n + 1.0::DOUBLE) + 1.0::DOUBLE) AS idf, "
                   "dt.tf * coalesce(cts.idf, ln(cnd.n + 1.0::DOUBLE) + 1.0::DOUBLE) AS wd "
                   "FROM dt LEFT JOIN CORPUS_TS cts USING (token), CORPUS_ND cnd),\n", base, flags=_re.S)
    chain = base + candidate_ctes() + mmr_ctes() + threshold_cte("mmr", "kw")
    chain = _re.sub(_NAMES, lambda m: prefix + m.group(1), chain)
    return "," + chain.replace("CORPUS_TS", "ts").replace("CORPUS_ND", "nd")
