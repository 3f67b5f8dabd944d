"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells of source, language and topic. A cell's tokens are
weighted by ``a(source) · b(language) · c(topic)``, and the three factors are
fitted in turn until the weighted tokens meet the target share of every source,
language and topic. A document is then drawn with probability
``min(1, s · weight of its cell)``, where s makes the expected tokens ``keep`` of
all tokens; cells that would need more than they hold are taken whole, so the
levels made of such cells stay below their targets (``reach`` lists them). With
``repeats`` a document comes ``keep · weight`` times instead, whole repeats and a
draw for the rest, and the expected sample meets every target.

DataFrame functions only. Tokens are summed by cell before any shuffle, so a
source with a third of all rows is a few cells; sources stay in a distributed
table, and per round the driver sees one number for each language and topic pair
(at most MAX_PAIRS, else the job ends with an error). Documents meet their cell's
probability in a join on three columns, which Spark broadcasts when the cell
table is small and may split when it isn't.

Default targets temper the corpus: share(x) ∝ tokens(x) ^ 0.7. A document's draw
is a hash of its id, so a sample is reproducible.

Rows: null text has no tokens; null source or language is a level of its own,
written as the empty text; a null doc_id draws like the text 'null'; rows that
repeat a doc_id draw alike; a level without tokens has factor 1; an empty table
gives an empty result; further columns pass through the stage and are not read
by the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KEEP, TEMPER, ROUNDS, SOLVES, SEED = 0.7, 0.7, 10, 8, 7
MAX_PAIRS = 100_000
# Topics by the first row with a needle in the text (fixed values).
TOPICS = (("credentials", ('oken = "', 'TOKEN = "', "assword")), ("licence", ("icensed under", "MIT License")),
          ("contact", ("@",)), ("table", (" | ",)))
OTHER_TOPIC = "prose"
CELL = ["source", "lang", "topic"]


def topic_of(text):
    out = F.lit(OTHER_TOPIC)
    for topic, needles in reversed(TOPICS):
        hit = F.lit(False)
        for x in needles:
            hit = hit | F.contains(text, F.lit(x))
        out = F.when(hit, topic).otherwise(out)
    return out


def draw(doc_id, seed: int):
    """Uniform number of a document, from the first 52 bits of a hash."""
    h = F.md5(F.concat(F.lit(f"mix-{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def measured(docs: DataFrame, *more) -> DataFrame:
    """Cell, tokens and draw of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), topic_of(text).alias("topic"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"), *more)


def _shares(cells: DataFrame, level: str, temper: float) -> DataFrame:
    mass = cells.groupBy(level).agg(F.pow(F.sum("n").cast("double"), F.lit(temper)).alias("m"))
    return mass.crossJoin(F.broadcast(mass.agg(F.sum("m").alias("all")))).select(level, F.when(F.col("all") > 0, F.col("m") / F.col("all")).otherwise(0.0).alias("share"))


def _lookup(values: dict, column: str):
    """Factor of a level, from at most MAX_PAIRS literals."""
    pairs = [F.lit(x) for k, v in values.items() for x in (k, float(v))]
    return F.element_at(F.create_map(*pairs), F.col(column)) if pairs else F.lit(1.0)


def rake(cells: DataFrame, sources: DataFrame, langs: dict, topics: dict, rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, n) with ``weight``: weighted tokens ``weight · n``
    sum to 1 and meet the shares of sources (source, share), langs and topics."""
    b, c = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)
    base = C.store(cells.join(sources, "source"), "cells")

    def fitted():
        w = F.col("n") * _lookup(b, "lang") * _lookup(c, "topic")
        total = base.groupBy("source").agg(F.sum(w).alias("total"))
        return base.join(total, "source").withColumn("a", F.when(F.col("total") > 0, F.col("share") / F.col("total")).otherwise(1.0))

    for _ in range(rounds):
        rows = fitted().groupBy("lang", "topic").agg(F.sum(F.col("a") * F.col("n")).alias("g")).limit(MAX_PAIRS + 1).collect()
        if len(rows) > MAX_PAIRS:
            raise ValueError("too many pairs of language and topic")
        grid = sorted((r.lang, r.topic, r.g) for r in rows)
        total = dict.fromkeys(langs, 0.0)
        for x, y, g in grid:
            total[x] += g * c[y]
        b = {x: langs[x] / t if t > 0 else 1.0 for x, t in total.items()}
        total = dict.fromkeys(topics, 0.0)
        for x, y, g in grid:
            total[y] += g * b[x]
        c = {y: topics[y] / t if t > 0 else 1.0 for y, t in total.items()}
    return C.store(fitted().select(*CELL, "n", (F.col("a") * _lookup(b, "lang") * _lookup(c, "topic")).alias("weight")), "raked")


def rates(cells: DataFrame, keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """Cells with weight, relative to the corpus, and probability."""
    level = lambda x: {r[0]: r[1] for r in _shares(cells, x, temper).limit(MAX_PAIRS + 1).collect()}
    raked = rake(cells, _shares(cells, "source", temper), level("lang"), level("topic"), rounds)
    total = raked.agg(F.sum("n")).first()[0] or 0
    scale = float(keep) * total
    for _ in range(SOLVES):
        over = F.col("weight") * F.lit(scale) >= 1.0
        full, rest = raked.agg(F.sum(F.when(over, F.col("n")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("n") * F.col("weight")))).first()
        if not rest:
            break
        scale = max(0.0, keep * total - full) / rest
    return C.store(raked.select(*CELL, (F.col("weight") * F.lit(float(total))).alias("weight"),
                                F.least(F.lit(1.0), F.col("weight") * F.lit(scale)).alias("probability")), "rates")


def _copies(keep: float, seed: int):
    """How often a document comes in a sample with repeats."""
    times = F.col("weight") * F.lit(float(keep))
    return (F.floor(times) + (draw(F.col("doc_id"), seed) < times - F.floor(times)).cast("int")).cast("int")


def mix(docs: DataFrame, keep: float = KEEP, temper: float = TEMPER, seed: int = SEED, repeats: bool = False) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled of every
    document, and with ``repeats`` copies."""
    seen = C.store(measured(docs), "measured")
    cells = C.store(seen.groupBy(*CELL).agg(F.sum("n_tokens").alias("n")), "tokens")
    out = seen.join(rates(cells, keep, temper), CELL).withColumn("sampled", draw(F.col("doc_id"), seed) < F.col("probability"))
    return out.withColumn("copies", _copies(keep, seed)) if repeats else out


def reach(docs: DataFrame, keep: float = KEEP, temper: float = TEMPER, repeats: bool = False, slack: float = 0.01) -> DataFrame:
    """level, value, corpus, target, drawn, reached: the shares of tokens of every
    source, language and topic, and whether the expected sample is within ``slack``
    of the target, relative to it."""
    cells = C.store(measured(docs).groupBy(*CELL).agg(F.sum("n_tokens").alias("n")), "tokens")
    times = F.col("weight") * F.lit(float(keep)) if repeats else F.col("probability")
    rated = C.store(cells.join(rates(cells, keep, temper), CELL).select(*CELL, "n", (F.col("n") * F.col("weight")).alias("t"), (F.col("n") * times).alias("d")), "rated")
    out = None
    for level in CELL:
        part = rated.groupBy(F.lit(level).alias("level"), F.col(level).alias("value")).agg(*[F.sum(x).alias(x) for x in "ntd"])
        out = part if out is None else out.unionByName(part)
    sums = rated.agg(*[F.sum(x).alias("all_" + x) for x in "ntd"])
    share = lambda x: F.coalesce(F.try_divide(F.col(x), F.col("all_" + x)), F.lit(0.0))
    return (out.crossJoin(F.broadcast(sums)).select("level", "value", share("n").alias("corpus"), share("t").alias("target"), share("d").alias("drawn"))
            .withColumn("reached", F.abs(F.col("drawn") - F.col("target")) <= F.lit(slack) * F.col("target")))


def sample(docs: DataFrame, keep: float = KEEP, temper: float = TEMPER, seed: int = SEED, repeats: bool = False) -> DataFrame:
    """The sampled rows of docs, with all their columns."""
    cells = C.store(measured(docs).groupBy(*CELL).agg(F.sum("n_tokens").alias("n")), "tokens")
    packed = measured(docs, F.struct("*").alias("whole")).drop("n_tokens")
    rated = packed.join(rates(cells, keep, temper), CELL)
    if repeats:
        return rated.select("whole", F.explode(F.array_repeat(F.lit(0), _copies(keep, seed)))).select("whole.*")
    drawn = rated.where(draw(F.col("doc_id"), seed) < F.col("probability"))
    return drawn.select("whole.*")


def oracle() -> str:
    topic = " ".join("WHEN " + " OR ".join(f"contains(t, '{x}')" for x in needles) + f" THEN '{name}'" for name, needles in TOPICS)
    ctes = [rf"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {topic} ELSE '{OTHER_TOPIC}' END AS topic,
      len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
            "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM d GROUP BY ALL)"]
    for x in CELL:
        ctes.append(f"t_{x} AS MATERIALIZED (SELECT {x}, m / sum(m) OVER () AS share FROM (SELECT {x}, pow(sum(n), {TEMPER}) AS m FROM cells GROUP BY 1))")
    ctes += ["b0 AS (SELECT lang, 1.0::DOUBLE AS b FROM t_lang)", "c0 AS (SELECT topic, 1.0::DOUBLE AS c FROM t_topic)"]
    factor = lambda x: f"CASE WHEN sum({x}) > 0 THEN any_value(share) / sum({x}) ELSE 1.0 END"
    for k in range(ROUNDS):
        ctes += [f"a{k} AS MATERIALIZED (SELECT source, {factor('n * b * c')} AS a FROM cells JOIN b{k} USING (lang) JOIN c{k} USING (topic) JOIN t_source USING (source) GROUP BY 1)",
                 f"g{k} AS MATERIALIZED (SELECT lang, topic, sum(a * n) AS g FROM cells JOIN a{k} USING (source) GROUP BY ALL)",
                 f"b{k + 1} AS MATERIALIZED (SELECT lang, {factor('g * c')} AS b FROM g{k} JOIN c{k} USING (topic) JOIN t_lang USING (lang) GROUP BY 1)",
                 f"c{k + 1} AS MATERIALIZED (SELECT topic, {factor('g * b')} AS c FROM g{k} JOIN b{k + 1} USING (lang) JOIN t_topic USING (topic) GROUP BY 1)"]
    k = ROUNDS
    ctes += [f"a{k} AS MATERIALIZED (SELECT source, {factor('n * b * c')} AS a FROM cells JOIN b{k} USING (lang) JOIN c{k} USING (topic) JOIN t_source USING (source) GROUP BY 1)",
             f"w AS MATERIALIZED (SELECT source, lang, topic, n, a * b * c AS w, sum(n) OVER () AS total FROM cells JOIN a{k} USING (source) JOIN b{k} USING (lang) JOIN c{k} USING (topic))",
             f"s0 AS (SELECT {KEEP} * any_value(total) AS s FROM w)"]
    for i in range(SOLVES):
        ctes.append(f"s{i + 1} AS MATERIALIZED (SELECT greatest(0.0, {KEEP} * any_value(total) - coalesce(sum(n) FILTER (w * s >= 1), 0)) / sum(n * w) FILTER (w * s < 1) AS s FROM w, s{i})")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(w * total, 6) AS weight, round(least(1.0, w * s), 6) AS probability,
       ('0x' || substr(md5('mix-{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::UBIGINT::DOUBLE / {float(1 << 52)} < least(1.0, w * s) AS sampled
FROM d JOIN w USING (source, lang, topic), s{SOLVES}"""


ORACLE = oracle()


def op5_mixing(spark, sf_dir):
    return (mix(C.table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 6))
            .withColumn("probability", F.round("probability", 6)))
