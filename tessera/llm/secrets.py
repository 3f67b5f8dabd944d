"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 or more characters of ``[A-Za-z0-9+/_-]``; or a value of
SHORT or more characters, punctuation included, that is assigned to a credential's
name (in quotes also with blanks) or stands in the userinfo of a URL. Its features
are its length, its character transitions (changes between letters, digits and
case, and the mix of characters), dictionary coverage (the share of its letters
inside words that are frequent in the corpus), signs of a path or address around
it, and the neighbouring words. The forest is trained on labelled findings outside
the held-out fold; its probability decides.

The tables hold no labelled findings, so ``labelled`` makes them from two rules of
thumb that leave many findings open: a quoted run with a digit that is assigned to
a credential's name is a secret; a run of letters alone, of decimal digits alone,
or inside an address is none, unless it is such a value or a part of one. A table of reviewed findings can be given instead.

DataFrame functions and MLlib only. Texts without a candidate stop at the scan;
dictionary words are counted before the shuffle; features of the text of a
candidate are computed once for each distinct candidate and joined back, so a
string repeated in a third of all rows is one row there, and the join back is one
that Spark may split. Training takes at most ``max_rows`` labelled findings, those
with the smallest hash.

Rows: null text has no findings; a null doc_id stays null; repeated rows repeat
their findings; without labelled findings every probability is 0.5, and with one
class only it is that class; an empty table gives none; further columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}"
SPACE = r"[\x20\x09-\x0D]+"
NAMES = r"(?i)(token|secret|passw|passphrase|api|key|auth|credential|bearer)"
SHORT, REST = 6, 64  # characters of a value; words that a quoted value may have
# A name that a value is assigned to, as the end of the text before the value.
NAMED = NAMES[:-1].replace("(token", "(?:token") + r"|pwd)[A-Za-z0-9_.\-]*[\"'`)\]]*"
ASSIGN = r"(?::=|=>|=|:)"
VALUE = ("([\"'`])(.{%d,}?)\\1" % SHORT, r"([^\s\"'`]{%d,})" % SHORT)  # in quotes, and without
USERINFO = (r"://[^/\s:@]*:([^/\s]{%d,})@" % SHORT, "://([^/\\s:@]{%d,})@" % SHORT)  # a password, and a token alone
HINT = f"{CANDIDATE}|{NAMED}\\s*{ASSIGN}|(?i:bearer\\s)|://[^/\\s]*@"
MIN_DOCS, WORD_MIN, WORD_MAX = 20, 3, 10
MAX_ROWS, TREES, DEPTH, SEED, FOLDS, CUT = 20_000, 20, 6, 7, 5, 0.5
SHAPE = ["length", "digits", "upper", "lower", "marks", "hex_only", "distinct", "class_changes", "case_changes", "vowel_changes", "dictionary"]
AROUND = ["quoted", "assigned", "named", "slashes", "address", "dotted", "prev_length", "prev_alpha", "next_length", "next_alpha", "first_word"]
FEATURES = SHAPE + AROUND
KEY = ["doc_id", "line_no", "word_no", "part_no"]


def _values():
    """Values that begin in a word and are assigned to a credential's name, or are in a
    URL's userinfo, without those that are no more than one of its runs."""
    word, before, before2, rest = (F.col(x) for x in ("word", "before", "before2", "rest"))
    first = lambda text, pattern, k: F.regexp_extract(text, pattern, k)
    pick = lambda text, start: F.when(text.rlike(f"{start}[\"'`]"), first(text, start + VALUE[0], 2)).otherwise(
        F.regexp_replace(first(text, start + VALUE[1], 1), r"[,;.)\]}>]+$", ""))
    begins = (before.rlike(f"{NAMED}{ASSIGN}$") | (before.rlike(f"^{ASSIGN}$") & before2.rlike(f"{NAMED}$"))
              | (before.rlike("^[\"'`]?(?i:bearer)$") & before2.rlike("[=:][\"'`]?$")))
    begins = begins & ~word.rlike("^[\"'`]?(?i:bearer|basic)[\"'`]?$")  # the scheme, not the value
    alone = word.rlike(f"^{ASSIGN}[^=]") & before.rlike(f"{NAMED}$")  # name =value
    own = F.when(word.rlike(f"{NAMED}{ASSIGN}[^=/]"), pick(rest, f"^[^\\s=:]*?{NAMED}{ASSIGN}")).when(alone, pick(rest, f"^{ASSIGN}"))
    found = F.array(F.when(begins, pick(rest, "^")), own, *[first(word, x, 1) for x in USERINFO])
    return F.array_distinct(F.filter(found, lambda x: F.length(x) >= SHORT))  # nulls go too


def findings(docs: DataFrame) -> DataFrame:
    """Every candidate with its place (line, word, part, from 0) and the words around it.
    The runs of a word come first, then the values that begin in it. ``credential``:
    the candidate is such a value or a part of one."""
    lines = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(HINT))
             .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(HINT)))
    words = lines.withColumn("w", F.split(F.trim(F.regexp_replace("line", SPACE, " ")), " "))
    near = lambda k: F.coalesce(F.try_element_at("w", F.when(F.col("word_no") + k + 1 > 0, F.col("word_no") + k + 1).otherwise(F.size("w") + 1)), F.lit(""))
    placed = words.select("doc_id", "line_no", "w", F.posexplode("w").alias("word_no", "word"))
    placed = placed.select("doc_id", "line_no", "word_no", "word", near(-2).alias("before2"), near(-1).alias("before"), near(1).alias("after"),
                           F.concat_ws(" ", F.slice("w", F.col("word_no") + 1, REST)).alias("rest"))
    context = F.concat_ws(" ", "before2", "before", "word")
    values = F.when(context.rlike(f"{NAMED}\\s*{ASSIGN}|(?i:bearer\\s)|://[^/\\s]*@"), _values()).otherwise(F.array().cast("array<string>"))
    placed = (placed.where(F.col("word").rlike(CANDIDATE) | context.rlike(HINT))
              .withColumn("values", values).withColumn("runs", F.regexp_extract_all("word", F.lit(f"({CANDIDATE})"), 1)))
    parts = F.concat("runs", F.filter("values", lambda v: ~F.array_contains("runs", v)))
    return (placed.select("*", F.posexplode(parts).alias("part_no", "candidate"))
            .withColumn("credential", F.exists("values", lambda v: F.contains(v, F.col("candidate"))))
            .drop("rest", "runs", "values"))


def dictionary(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Lower-case words of a few letters that occur often in the corpus."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("entry"))
    size = F.length("entry")
    return words.where((size >= WORD_MIN) & (size <= WORD_MAX)).groupBy("entry").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("entry")


def _share(pattern: str):
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def shapes(distinct: DataFrame, words: DataFrame) -> DataFrame:
    """SHAPE features of distinct candidates."""
    letters = F.lower("candidate")
    spans = (distinct.select("candidate", F.explode(F.sequence(F.lit(1), F.length("candidate"))).alias("at"))
             .select("candidate", "at", F.explode(F.sequence(F.lit(WORD_MIN), F.lit(WORD_MAX))).alias("n"))
             .where(F.col("at") + F.col("n") - 1 <= F.length("candidate"))
             .select("candidate", "at", "n", F.substr(letters, F.col("at"), F.col("n")).alias("entry"))
             .where(F.col("entry").rlike("^[a-z]+$")))
    covered = (spans.join(words, "entry", "left_semi").select("candidate", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("p"))
               .distinct().groupBy("candidate").agg(F.count("*").alias("covered")))
    size = F.length("candidate")
    return distinct.join(covered, "candidate", "left").select(
        "candidate", size.cast("double").alias("length"), _share("[0-9]").alias("digits"), _share("[A-Z]").alias("upper"), _share("[a-z]").alias("lower"),
        _share(r"[+/_\-]").alias("marks"), F.col("candidate").rlike("^[0-9a-fA-F]+$").cast("double").alias("hex_only"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / size).alias("distinct"),
        _share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])").alias("class_changes"), _share("[a-z](?=[A-Z])|[A-Z](?=[a-z])").alias("case_changes"),
        _share("(?i)[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])").alias("vowel_changes"),
        (F.coalesce("covered", F.lit(0)) / size).alias("dictionary"))


def _around(found: DataFrame) -> DataFrame:
    """AROUND features of every finding."""
    flag = lambda c: c.cast("double")
    word, before, before2, after = (F.col(x) for x in ("word", "before", "before2", "after"))
    context = F.concat_ws(" ", before2, before, word)
    return found.select(
        "*", flag(word.rlike("[\"'`]")).alias("quoted"), flag(before.rlike("[=:]$") | word.rlike("[=:]")).alias("assigned"),
        flag(context.rlike(NAMES)).alias("named"), F.regexp_count(word, F.lit(r"[/\\]")).cast("double").alias("slashes"),
        flag(word.rlike("://|@|www[.]") & ~F.col("credential")).alias("address"), flag(word.rlike("[A-Za-z0-9][.][A-Za-z0-9]")).alias("dotted"),
        F.length(before).cast("double").alias("prev_length"), flag(before.rlike(r"^\p{L}+$")).alias("prev_alpha"),
        F.length(after).cast("double").alias("next_length"), flag(after.rlike(r"^\p{L}+[.,;:!?]*$")).alias("next_alpha"), flag(F.col("word_no") == 0).alias("first_word"))


def labelled(found: DataFrame) -> DataFrame:
    """Findings with ``label`` 1 or 0 where a rule of thumb decides, null elsewhere."""
    candidate = F.col("candidate")
    secret = (F.col("quoted") == 1) & (F.col("assigned") == 1) & (F.col("named") == 1) & candidate.rlike("[0-9]")
    none = (candidate.rlike(r"^[A-Za-z]+$|^[0-9]+$") | (F.col("address") == 1)) & ~F.col("credential")
    return found.withColumn("label", F.when(none, 0.0).when(secret, 1.0))


def _probability(found: DataFrame, max_rows: int) -> DataFrame:
    """found (features and label) with the forest's probability of a secret."""
    order = F.xxhash64(*[F.col(c) for c in KEY], F.col("candidate"))
    train = (found.where(F.col("label").isNotNull() & (C.crc_mod("doc_id", FOLDS) != 0)).select("label", *FEATURES, order.alias("h"))
             .orderBy("h", *FEATURES).limit(max_rows))
    train = C.store(train.select("label", *FEATURES), "labelled")  # max_rows at most, so one ordered partition
    classes = sorted(r[0] for r in train.select("label").distinct().collect())
    if len(classes) < 2:
        return found.withColumn("probability", F.lit(classes[0] if classes else 0.5))
    pack = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
                                    featureSubsetStrategy="sqrt").fit(pack.transform(train.coalesce(1)))
    out = forest.transform(pack.transform(found))
    return out.withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


def scan(docs: DataFrame, reviewed: DataFrame | None = None, max_rows: int = MAX_ROWS, cut: float = CUT) -> DataFrame:
    """Every candidate: KEY, candidate, label, probability, is_secret. ``reviewed``
    (candidate, label) replaces the rules of thumb."""
    found = C.store(_around(findings(docs)), "findings")
    distinct = found.select("candidate").distinct()
    shaped = C.store(shapes(distinct, dictionary(docs)), "shapes")
    whole = found.join(shaped, "candidate")
    if reviewed is None:
        whole = labelled(whole)
    else:
        whole = whole.join(reviewed.groupBy("candidate").agg(F.max("label").cast("double").alias("label")), "candidate", "left")
    whole = C.store(whole, "features")
    return _probability(whole, max_rows).withColumn("is_secret", F.col("probability") >= cut).select(*KEY, "candidate", "label", "probability", "is_secret")


def op7_secrets(spark, sf_dir):
    """Findings by place, with a hash in the place of the string itself."""
    return scan(C.table(spark, sf_dir, "documents")).select(
        *KEY, F.length("candidate").alias("n_chars"), F.sha2("candidate", 256).alias("secret_sha256"),
        F.round("probability", 6).alias("probability"), "is_secret")
