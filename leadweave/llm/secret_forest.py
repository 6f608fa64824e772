"""Secret scans with a random forest that removes false positives.

Candidates are runs of at least ``LEAST`` characters of key alphabets in the words of a text
(with a digit or a symbol in them, or ``LONG`` characters or more). Each is described by its
length, changes between character classes and between vowels and consonants, shares of digits,
capitals and distinct characters, the share of it covered by words of the corpus dictionary
(words of letters in at least ``least_docs`` documents, counted over all documents), its path,
the words before and after it, and the parts of its own word before and after it (names, = or :).
In name=value the value is a candidate of its own if it is long enough. A random forest, fitted on a bounded number of labelled
findings (``limit`` of each class, a parameter), gives the probability that it is a secret.

DataFrame functions and the DataFrame-based forest of Spark only: no Python on the executors.
Words are looked at in place; only those long enough become rows. The dictionary is met by
equality of words, never broadcast unless it is small.

Defined results: NULL and empty texts have no candidates. A candidate at several places is
judged at each, and every run of a word by itself. Labelled findings of one class only, or none, leave a constant probability.
NULL paths are ordinary ones. Other columns are not read."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import written

LEAST = 16
LONG = 24
LIMIT = 10_000
_CANDIDATE = rf"[A-Za-z0-9+/=_\-]{{{LEAST},}}"
#: name=value is split before a value that is long enough to be a candidate of its own.
_VALUE = rf"(?<==)(?=[A-Za-z0-9+/_\-][A-Za-z0-9+/=_\-]{{{LEAST - 1}}})"
_ASSIGNS = r"[=:]>?\s*[\\\"'`(\[{]*$"
#: Words beside secrets, words beside other identifiers, paths of samples.
CREDENTIAL = r"(?i)token|secret|passw|pwd|api[_-]?key|access[_-]?key|private|credential|auth|bearer"
IDENTIFIER = r"(?i)sha-?\d*|md5|commit|digest|checksum|uuid|guid|hash|revision|build"
SAMPLE_PATH = r"(?i)test|example|sample|mock|fixture|doc"

FEATURES = (
    "length", "class_changes", "vowel_changes", "digits", "capitals", "distinct", "symbols", "hex_only", "dictionary",
    "sample_path", "credential_near", "identifier_near", "assigned", "quoted")


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.length(text)


def candidates(docs: DataFrame, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, path, position (of the word), run (its number in the word), candidate, quoted,
    before2, before, after (words beside it, as far as no other run stands between), own_before,
    own_after, own_name (parts of its own word), assigned."""
    given = docs.select("doc_id", F.col(path_col).cast("string").alias("path"), F.split(text_col, r"\s+").alias("w"))
    near = F.transform("w", lambda x, i: F.when(
        (F.octet_length(x) >= LEAST) & x.rlike(_CANDIDATE),
        F.struct(
            i.alias("position"), x.alias("word"), F.get("w", i - 2).alias("before2"),
            F.get("w", i - 1).alias("before"), F.get("w", i + 1).alias("after"))))
    met = given.select("doc_id", "path", F.inline(F.filter(near, lambda x: x.isNotNull())))
    word = F.regexp_replace("word", _VALUE, " ")  # words hold no blanks of their own
    cut = met.select(
        "doc_id", "path", "position", "before2", "before", "after",
        F.regexp_extract_all(word, F.lit(_CANDIDATE), F.lit(0)).alias("runs"), F.split(word, _CANDIDATE, -1).alias("gaps"))
    left = lambda i: F.concat(F.coalesce(F.get("runs", i - 1), F.lit("")), F.get("gaps", i))
    each = F.transform("runs", lambda x, i: F.struct(
        i.alias("run"), x.alias("candidate"),
        F.concat(F.get("gaps", i), F.get("gaps", i + 1)).rlike("[\"'`]").cast("int").alias("quoted"),
        F.when(i == 0, F.col("before2")).alias("before2"), F.when(i <= 1, F.col("before")).alias("before"),
        F.when(i == F.size("runs") - 1, F.col("after")).alias("after"),
        # the last two names before it in its word, and what follows in its own entry
        F.array_join(F.slice(F.concat(F.array(F.lit(""), F.lit("")), F.regexp_extract_all(left(i), F.lit(r"[^\s,;:=&\"'`(){}\[\]]+"), F.lit(0))), -2, 2), " ").alias("own_before"),
        F.regexp_extract(F.get("gaps", i + 1), r"^[^,;&{}\[\]]*", 0).alias("own_after"),
        ((~x.startswith("//") & left(i).rlike(_ASSIGNS)) | x.rlike("^[^=]+=+[^=]")
         | ((i == 0) & F.coalesce(F.col("before").rlike("[=:]$"), F.lit(False)))).cast("int").alias("assigned"),
        F.regexp_extract(x, "^([^=]+)=+[^=]", 1).alias("own_name")))
    runs = cut.select("doc_id", "path", "position", F.inline(each))
    return runs.filter(F.col("candidate").rlike(r"[0-9+/=_\-]") | (F.length("candidate") >= LONG))


def dictionary(docs: DataFrame, text_col: str = "text", least_docs: int = 5) -> DataFrame:
    """word: lower-cased words of three letters or more in at least ``least_docs`` documents."""
    words = F.array_distinct(F.split(F.lower(text_col), r"[^\p{L}]+"))
    return (
        docs.select(F.explode(words).alias("word")).filter(F.length("word") >= 3)
        .groupBy("word").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_docs).select("word"))


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with FEATURES. Dictionary coverage is taken once per distinct candidate."""
    text = F.col("candidate")
    runs = found.select("candidate").distinct().select("candidate", F.explode(
        F.regexp_extract_all(F.lower("candidate"), F.lit(r"[a-z]{3,}"), F.lit(0))).alias("word"))
    covered = written(runs.join(words, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("_covered")), "covered")
    around = F.concat_ws(" ", "before2", "before", "own_before", "own_name", "own_after", "after")
    return found.join(covered, "candidate", "left").select(
        "doc_id", "path", "position", "run", "candidate",
        F.length(text).cast("double").alias("length"),
        (F.regexp_count(text, F.lit(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")) / F.length(text)).alias("class_changes"),
        (F.regexp_count(text, F.lit(r"(?i)[aeiou]+|[^aeiou]+")) / F.length(text)).alias("vowel_changes"),
        _share(text, "[0-9]").alias("digits"), _share(text, "[A-Z]").alias("capitals"),
        (F.size(F.array_distinct(F.split(text, ""))) / F.length(text)).alias("distinct"),
        _share(text, r"[+/=_\-]").alias("symbols"), text.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex_only"),
        (F.coalesce("_covered", F.lit(0)) / F.length(text)).alias("dictionary"),
        F.coalesce(F.col("path").rlike(SAMPLE_PATH), F.lit(False)).cast("double").alias("sample_path"),
        around.rlike(CREDENTIAL).cast("double").alias("credential_near"),
        around.rlike(IDENTIFIER).cast("double").alias("identifier_near"),
        F.col("assigned").cast("double").alias("assigned"),
        F.col("quoted").cast("double").alias("quoted"))


#: Beginnings and shapes that issuers of keys give them.
ISSUED = (
    r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_\w{22,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{16,})$")
SURE_BITS, FEW_BITS = 96.0, 64.0


def information(text: Column) -> Column:
    """Bits that a text holds by the frequencies of its own characters."""
    size = F.length(text)
    return F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0),
        lambda bits, c: bits - F.when(c == "", 0.0).otherwise((size - F.length(F.replace(text, c, F.lit("")))) * F.log2(
            (size - F.length(F.replace(text, c, F.lit("")))) / size)))


def has_check_digit(text: Column) -> Column:
    """Digits only, 12 to 19 of them, the last a Luhn check digit of the others."""
    digits = F.transform(F.split(F.reverse(text), ""), lambda c: c.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return text.rlike("^[0-9]{12,19}$") & (F.aggregate(doubled, F.lit(0), lambda n, d: n + F.coalesce(d, F.lit(0))) % 10 == 0)


def second_opinion(candidate: Column) -> Column:
    """What detectors say that look at nothing the forest sees, to hold its verdicts against: 1 for
    what an issuer's format names, or what holds more information than numbers and words do; 0
    for numbers with a check digit, single words and what holds little; NULL between. A digest
    holds as much as a key: it takes the words beside it to tell them apart."""
    bits = information(candidate)
    return (
        F.when(candidate.rlike(ISSUED), 1).when(has_check_digit(candidate) | candidate.rlike("^[A-Z]?[a-z]+$"), 0)
        .when(bits >= SURE_BITS, 1).when(bits < FEW_BITS, 0))


def scored(features: DataFrame, findings: DataFrame, limit: int = LIMIT, trees: int = 20, depth: int = 6, seed: int = 5) -> DataFrame:
    """``features`` with probability and is_secret. ``findings``: FEATURES and label (0 or 1);
    at most ``limit`` of each class are used, the first in order of a hash of their features."""
    usable = findings.select(*FEATURES, "label").filter("label in (0, 1)")
    order = F.xxhash64(*FEATURES)
    sample = written(
        usable.filter("label = 1").orderBy(order).limit(limit).unionByName(usable.filter("label = 0").orderBy(order).limit(limit)), "findings")
    positive, n = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    if positive in (0, n):
        p = F.lit((positive + 0.5) / (n + 1.0))
        return features.withColumns({"probability": p, "is_secret": p >= 0.5})
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="_probability",
        rawPredictionCol="_raw", predictionCol="_prediction").fit(vectors.transform(sample.withColumn("label", F.col("label").cast("double"))))
    forest = forest.copy()  # without the training summary, which would take the session along to the tasks
    out = forest.transform(vectors.transform(features)).withColumn("probability", vector_to_array("_probability")[1])
    return out.drop("_features", "_raw", "_probability", "_prediction").withColumn("is_secret", F.col("probability") >= 0.5)


def scan(docs: DataFrame, findings_of, text_col: str = "text", path_col: str = "source", **options) -> DataFrame:
    """doc_id, position, run, candidate, FEATURES, probability, is_secret of every candidate.
    ``findings_of`` gets the described candidates and returns the labelled findings."""
    features = written(described(candidates(docs, text_col, path_col), dictionary(docs, text_col)), "candidates")
    return scored(features, findings_of(features), **options)
