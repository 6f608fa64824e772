"""The operators of this package as queries over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm import (
    chat_repair, decontamination, filter_audit, host_reputation, line_dedup, mixing, paragraph_sketch,
    pivot_codes, quality_attention, quality_rules, secret_forest, simhash, toxicity_segments)
from leadweave.llm.labelled import held_out

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    judged = decontamination.overlaps(
        table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    overlap = F.col("overlap")
    return judged.select(
        "doc_id", overlap["n_words"].alias("n_words"), overlap["n_hit"].alias("n_hit"),
        F.size(overlap["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(overlap["items"], ","), 256).alias("items_sha256"),
        decontamination.is_contaminated(overlap).alias("contaminated"))


ORACLES["op1_decontamination"] = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item, len(w[i:i + 12]) AS n, array_to_string(w[i:i + 12], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
gram AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc, (SELECT DISTINCT n FROM phrase) WHERE len(w) >= n)),
hit AS (SELECT r, n, i, item FROM gram JOIN phrase USING (n, gram)),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN ids USING (r)"""


@query
def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.components(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity_segments.learn(docs, table(spark, sf, "labels"))
    return toxicity_segments.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality_attention.learn(docs, table(spark, sf, "labels"))
    return quality_attention.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Shares of the words that the mix aims at, by language.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The domain (language) of the documents that somebody has labelled; of all others it is
    taken as unknown."""
    ids = labels.select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(ids, "doc_id")


@query
def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rates = mixing.mix(docs, domain_labels(docs, table(spark, sf, "labels")), TARGETS, keep=("doc_id", "source"))
    return rates.drop("mark")


@query
def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return line_dedup.judged_lines(docs).select("doc_id", "text", "n_lines", "n_dropped")


_LINES = """
doc AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
line AS (SELECT r, source, l, p, trim(l, ' ' || chr(9) || chr(13)) AS t FROM (
  SELECT r, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM doc))"""

ORACLES["op7_line_dedup"] = f"""
WITH {_LINES},
page AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
common AS (
  SELECT source, t FROM (SELECT DISTINCT r, source, t FROM line WHERE t <> '') d
  GROUP BY source, t HAVING count(*) >= 5
    AND count(*) > 0.1 * (SELECT pages FROM page WHERE page.source IS NOT DISTINCT FROM d.source)),
judged AS (SELECT line.*, common.t IS NOT NULL AS out FROM line LEFT JOIN common
  ON line.t = common.t AND line.source IS NOT DISTINCT FROM common.source),
kept AS (SELECT r, count(*) AS n_lines, count_if(out) AS n_dropped,
  coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (WHERE NOT out), '') AS text FROM judged GROUP BY r)
SELECT doc_id, CASE WHEN doc.text IS NULL THEN NULL ELSE kept.text END AS text,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped FROM doc LEFT JOIN kept USING (r)"""


@query
def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf, "documents").select("doc_id", "source", "text"))


ORACLES["op8_quality_rules"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
fivegram AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM doc WHERE len(w) >= 5)),
again AS (SELECT r, count(DISTINCT p) AS n FROM (
  SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM fivegram) WHERE c > 1) GROUP BY r),
line AS (SELECT r, source, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw FROM (
  SELECT r, source, unnest(string_split(text, chr(10))) AS l FROM doc)),
filled AS (SELECT r, source, l, len(lw) AS words,
  translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM line WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM filled GROUP BY r),
host AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
frequent AS (SELECT source, norm FROM (SELECT DISTINCT r, source, norm FROM filled) d GROUP BY source, norm
  HAVING count(*) > 20 AND count(*) > 0.1 * (SELECT docs FROM host WHERE host.source IS NOT DISTINCT FROM d.source)),
lost AS (SELECT r, sum(words) AS n FROM filled f WHERE EXISTS (
  SELECT 1 FROM frequent q WHERE q.norm = f.norm AND q.source IS NOT DISTINCT FROM f.source) GROUP BY r),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS lost_words
  FROM doc LEFT JOIN dup USING (r) LEFT JOIN again USING (r) LEFT JOIN lost USING (r)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_words - lost_words >= 0.5 * n_words AND n_words - lost_words >= 10 AS kept FROM failed"""


URL_RULES = [
    host_reputation.Rule("com/", "allow"), host_reputation.Rule("example.com/en/", "block"),
    host_reputation.Rule("www.example.com/en/", "allow"), host_reputation.Rule("net/es/", "block"), host_reputation.Rule("net/fr/", "block")]


@query
def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes: a page is bad where the label of its number has quality 0."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), (F.lit(1) - F.col("quality")).alias("bad"))
    judged = host_reputation.filter_urls(table(spark, sf, "pages").select("page_id", "url"), URL_RULES, labels)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _weight_sql(children: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(freedom, 0) = 0 OR pages <= freedom OR spread <= freedom THEN 10000.0
  ELSE least(greatest((pages - freedom) / (spread - freedom) - 1, 1.0), 10000.0) END FROM (
  SELECT sum(n * (bad * 1.0 / n - m) ** 2 / (m * (1 - m))) AS spread, sum(1 - n * 1.0 / n_of) AS freedom,
    sum(n * (1 - n * 1.0 / n_of)) AS pages FROM (SELECT *, bad_of * 1.0 / n_of AS m FROM {children}) WHERE m BETWEEN 1e-9 AND 1 - 1e-9))"""


def _rule_sql(then: str) -> str:
    cases = []
    for r in sorted(URL_RULES, key=lambda r: -len(r.text)):
        of, slash, rest = r.text.partition("/")
        cases.append(f"WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{slash}{rest}') THEN '{getattr(r, then)}'")
    return "CASE " + " ".join(cases) + " END"


ORACLES["op10_url_filter"] = f"""
WITH page AS (SELECT page_id, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)),
outcome AS (SELECT host, l.bad FROM page JOIN (
  SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) l USING (page_id) WHERE host <> ''),
named AS (SELECT host, string_split(host, '.') AS p FROM (SELECT DISTINCT host FROM page)),
tail AS (SELECT host, p, CASE WHEN array_to_string(p[-2:], '.') IN ({", ".join(repr(x) for x in host_reputation.TWO_LABEL_SUFFIXES)}) THEN 2 ELSE 1 END AS k FROM named),
place AS (SELECT host, array_to_string(p[-k:], '.') AS suffix, array_to_string(p[-(k + 1):], '.') AS domain FROM tail),
h AS (SELECT host, domain, suffix, count(*) AS n, sum(bad) AS bad FROM outcome JOIN place USING (host) GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
g AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM s),
cs AS (SELECT s.*, g.n AS n_of, g.bad AS bad_of FROM s, g),
cd AS (SELECT d.*, s.n AS n_of, s.bad AS bad_of FROM d JOIN s USING (suffix)),
ch AS (SELECT h.*, d.n AS n_of, d.bad AS bad_of FROM h JOIN d USING (domain)),
w AS (SELECT {_weight_sql("cs")} AS ws, {_weight_sql("cd")} AS wd, {_weight_sql("ch")} AS wh, (g.bad + 0.5) / (g.n + 1.0) AS top FROM g),
r AS (SELECT place.host, wh, coalesce(h.n, 0) AS n, (coalesce(h.bad, 0) + wh * (coalesce(d.bad, 0) + wd * (coalesce(s.bad, 0) + ws * top) / (coalesce(s.n, 0) + ws)) / (coalesce(d.n, 0) + wd)) / (coalesce(h.n, 0) + wh) AS rate
  FROM place CROSS JOIN w LEFT JOIN s USING (suffix) LEFT JOIN d USING (domain) LEFT JOIN h USING (host))
SELECT page_id, host, path, {_rule_sql("text")} AS rule, coalesce({_rule_sql("verdict")},
  CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (n + wh + 1)) > 0.5 AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict
FROM page JOIN r USING (host)"""


@query
def op6_chat_repair(spark: SparkSession, sf: str) -> DataFrame:
    return chat_repair.repair_roles(table(spark, sf, "conversations"))


def findings(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled findings. The tables hold none, so the candidates of labelled documents are
    reviewed by rule: a quoted or assigned value beside a credential word is a finding, any
    other candidate a false positive."""
    reviewed = features.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    beside = (F.col("credential_near") > 0) & ((F.col("quoted") > 0) | (F.col("assigned") > 0)) & (F.col("digits") > 0)
    return reviewed.withColumn("label", beside.cast("int"))


@query
def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates are named by hash and first characters, not given away."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    judged = secret_forest.scan(docs, lambda found: findings(found, table(spark, sf, "labels")))
    return judged.select(
        "doc_id", "position", "run", F.sha2("candidate", 256).alias("candidate_sha256"), F.left("candidate", F.lit(4)).alias("prefix"),
        F.length("candidate").cast("long").alias("n_chars"), "probability", "is_secret")


@query
def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    found = pivot_codes.compress(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"))
    return pivot_codes.with_error_by(found, "label").select(
        F.col("given.vec_id").alias("vec_id"), pivot_codes.code_of(F.col("codes")).alias("code"), "error", "label_error",
        F.lit(found.sha256).alias("codebooks_sha256"))


def _vector_rounds() -> str:
    """The rounds of op11 as common table expressions: codebook b0, assignments a0, b1, ..."""
    parts = []
    for k in range(5):
        parts.append(f"""
d{k} AS (SELECT v.r, v.p, b.e, sum((v.x - b.x) * (v.x - b.x)) AS d FROM v JOIN b{k} b ON v.p = b.p AND v.i = b.i GROUP BY ALL),
a{k} AS (SELECT r, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM d{k} GROUP BY r, p)""")
        if k < 4:
            parts.append(f"""
n{k} AS (SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{k} USING (r, p) GROUP BY ALL),
b{k + 1} AS (SELECT b.p, b.e, b.i, coalesce((s - ((s % n) + n) % n) // n, b.x) AS x FROM b{k} b LEFT JOIN n{k} USING (p, e, i))""")
    return ",".join(parts)


ORACLES["op11_vector_codes"] = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
v AS MATERIALIZED (SELECT r, (j - 1) // w AS p, (j - 1) % w AS i, CAST(floor(1024 * CAST(embedding[j] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, embedding, len(embedding) // 4 AS w, unnest(range(1, len(embedding) + 1)) AS j FROM kept)),
b0 AS (SELECT p, r - 1 AS e, i, x FROM v WHERE r <= 256),{_vector_rounds()},
book AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM b4),
coded AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (r), book"""


@query
def op12_paragraph_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Against its edited text and the next document's, by what the sketches give up."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    versions = paragraph_sketch.with_next(docs).select("given.doc_id", "text", F.col("following").alias("next")).select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text",
        paragraph_sketch.edited(F.col("text"), F.col("next")).alias("edited"), "next")
    hashed = versions.withColumn("edited_sha256", F.sha2("edited", 256))
    found = paragraph_sketch.compare(hashed, "text", ["edited", "next"])
    return found.select(
        "given.*", F.col("print0").alias("fingerprint"), F.col("print1").alias("edited_fingerprint"),
        F.col("against1.likeness").alias("near_edited"), F.col("against2.likeness").alias("near_next"))


@query
def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, table(spark, sf, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
word AS (SELECT *, coalesce(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), []) AS w FROM doc),
mark AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) ||
    (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END) ||
    (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END) ||
    (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) ||
    (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS f
  FROM word LEFT JOIN mark USING (doc_id)),
tab AS (SELECT part, f, good, toxic, count(*) AS n FROM fails GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
step AS (SELECT o, k AS step, substr(o, k, 1) AS x, substr(o, 1, k - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS k)),
judged AS (
  SELECT part, o, step, x, n, good, toxic, contains(f, x) AS hits, f = x AS alone,
    before <> '' AND regexp_matches(f, '[' || before || 'x]') AS gone FROM tab, step),
counted AS (
  SELECT part, o AS filter_order, step, x, sum(n) FILTER (WHERE NOT gone AND NOT hits) AS kept, sum(n) FILTER (WHERE hits AND NOT gone) AS removed,
    sum(n) FILTER (WHERE hits AND gone) AS redundant, sum(n) FILTER (WHERE alone) AS unique_fails,
    sum(n) FILTER (WHERE hits AND NOT gone AND good) AS good_lost, sum(n) FILTER (WHERE hits AND NOT gone AND toxic) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted"""
