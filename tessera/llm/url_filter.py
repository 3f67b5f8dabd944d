"""URL filter: rules first, then a Bloom filter cascade over hosts.

The cascade answers exactly whether a host is on a list, for every host of the
corpus (its key universe), without a join. Level 1 encodes the listed hosts,
level 2 the unlisted hosts that level 1 lets through, level 3 the listed hosts
that level 2 lets through, and so on until a level lets nothing through by
mistake. A host is listed if the first level that misses it has an even number,
or if no level misses it and the number of levels is odd. Each level hashes with
its own seed and has 8 MB at most; a level of over MAX_KEYS hosts is not built,
and membership is then decided by a join with the listed hosts.

Rules (host, path) fit their host and all its subdomains where the url's path
starts with theirs; the longest fitting rule decides.

Rows: a null url, or one without ``://``, has an empty host and path, which no
rule fits and no list holds, so it is allowed; a null page_id stays null;
repeated rows give repeated rows; an empty table gives none; further columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .bits import Filter, bit_filter

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Words that put a host on the default list (fixed values).
LISTED_WORDS = ("adult", "casino", "malware", "phish", "porn", "spam", "torrent", "warez")
MAX_KEYS = 4_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url) -> tuple:
    """(host, path) expressions of a url."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return (F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_for(host, path, rules=RULES):
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _hash(hosts: pa.Array, level: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(h, seed=level) for h in hosts.to_pylist()], dtype=np.uint64)


def _passed(levels: list[Filter], hosts: pa.Array) -> np.ndarray:
    """How many levels let each host through before one misses it."""
    out = np.zeros(len(hosts), dtype=np.int64)
    live = np.arange(len(hosts))
    for i, level in enumerate(levels):
        live = live[level.has(_hash(hosts.take(pa.array(live)), i))]
        out[live] = i + 1
    return out


def member(levels: list[Filter], hosts: pa.Array) -> np.ndarray:
    """Whether each host of the universe is listed: the last level that lets it
    through is one that encodes listed hosts."""
    return _passed(levels, hosts) % 2 == 1


def build(universe: DataFrame, max_keys: int = MAX_KEYS) -> list[Filter] | None:
    """Levels for a stored table (host, listed) of distinct hosts; None if a level is too large."""
    levels: list[Filter] = []
    while True:
        number, done = len(levels), list(levels)

        def run(batches):
            for b in batches:
                hosts = b.column(0)
                hosts = hosts.filter(pa.array(_passed(done, hosts) == number))
                yield pa.RecordBatch.from_arrays([pa.array(_hash(hosts, number).astype(np.int64))], ["h"])
        keys = C.store(universe.where(F.col("listed") == (number % 2 == 0)).select("host").mapInArrow(run, "h long"), "level")
        n = keys.count()
        if n > max_keys:
            return None
        if n == 0:
            return levels
        levels.append(bit_filter(keys, "h", n))


def url_filter(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, max_keys: int = MAX_KEYS) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. ``listed`` (host) is the
    block list; by default, hosts of the corpus with one of LISTED_WORDS."""
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = urls.select("host").distinct()
    if listed is None:
        universe = hosts.withColumn("listed", F.col("host").rlike("|".join(LISTED_WORDS)))
    else:
        on_list = listed.select(F.col("host").cast("string").alias("host")).where("host IS NOT NULL").distinct().withColumn("listed", F.lit(True))
        universe = hosts.join(on_list, "host", "left").select("host", F.coalesce("listed", F.lit(False)).alias("listed"))
    universe = C.store(universe, "hosts")
    levels = build(universe, max_keys)
    ruled = urls.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    if levels is None:
        judged = ruled.join(universe.where("listed"), "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        def run(batches):
            for b in batches:
                coded = b.column("host").dictionary_encode()
                on = pa.array(member(levels, coded.dictionary))
                yield b.append_column("listed", pc.take(on, coded.indices))
        judged = ruled.mapInArrow(run, "page_id long, host string, path string, rule string, listed boolean")
    verdict = F.when(F.col("listed"), "block").otherwise("allow")
    for rule, what in rules:
        verdict = F.when(F.col("rule") == rule, what).otherwise(verdict)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


ORACLE = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                     WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                     WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM b)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host, 'adult|casino|malware|phish|porn|spam|torrent|warez') THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""


def op10_url_filter(spark, sf_dir):
    return url_filter(C.table(spark, sf_dir, "pages"))
