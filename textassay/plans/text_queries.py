"""Text scorers, personal data and conversation pairs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pii, text as T
from ..operators.ranks import quantiles
from ..staging import staged
from .registry import Registry, table

query = Registry()

_W = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"
_WORDS, _LOW = _W.format("text"), _W.format("lower(text)")
_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_BRACED = r"regexp_extract_all(lower({0}), '[\p{{{{L}}}}\p{{{{N}}}}]+')"  # for texts that are formatted once more
_OCC = "((length({0}) - length(replace({0}, '{1}', ''))) / {2})"
_HEDGES = " + ".join(_OCC.format("lower(text)", h, f"{len(h)}.0") for h in T.HEDGES)

#: One row of scorers per document; scores are rounded so that they compare equally everywhere.
SCORES_SQL = rf"""
SELECT doc_id, source, lang, text, n AS n_words,
  CASE WHEN n = 0 THEN 0.0 ELSE round(len(list_distinct(lw))::DOUBLE / n, 9) END AS diversity,
  CASE WHEN n = 0 THEN 0.0 ELSE round(least(1.0, greatest(0.0,
    (len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]'))) + len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z].'))) - ({_HEDGES})) / n)), 9) END AS specificity,
  CASE WHEN n = 0 THEN 0.0 ELSE round(1.0 / (1.0 + ln(n / ({_OCC.format('text', '.', '1.0')} + 1) + 1) / 5.0), 9) END AS density,
  CASE WHEN n < 2 OR len(ll) = 0 THEN 0.0 ELSE round((len(ll) - len(list_distinct(ll)))::DOUBLE / len(ll), 9) END AS repetition,
  round(least(1.0, greatest(0.0, 0.5::DOUBLE + {" + ".join(f"CASE WHEN contains(lower(text), '{m}') THEN {s} ELSE 0.0 END" for ms, s in ((T.FACT_MARKERS, '0.1'), (T.DOUBT_MARKERS, '-0.1')) for m in ms)})), 9) AS judged
FROM (SELECT *, len(w) AS n, list_filter(lw, lambda x: strlen(x) > 2) AS ll
      FROM (SELECT doc_id, source, lang, text, {_WORDS} AS w, {_LOW} AS lw FROM documents))
"""


def scores(docs: DataFrame) -> DataFrame:
    """The scorers of SCORES_SQL as columns; the words are split once and shared."""
    w, low = F.col("w"), F.col("lw")
    n = F.size(w)
    long = F.filter(low, lambda x: F.octet_length(x) > 2)
    hedges = sum((T.occurrences(F.lower("text"), h) for h in T.HEDGES), F.lit(0.0))
    marks = F.size(F.filter(w, lambda x: x.rlike("^[0-9]"))) + F.size(F.filter(w, lambda x: x.rlike("^[A-Z].")))
    zero = lambda value: F.when(n == 0, 0.0).otherwise(F.round(value, 9))
    split = docs.select("doc_id", "source", "lang", "text", T.words(F.col("text")).alias("w"), T.words(F.lower("text")).alias("lw"))
    return split.select(
        "doc_id", "source", "lang", "text", n.cast("bigint").alias("n_words"),
        zero(F.size(F.array_distinct(low)) / n).alias("diversity"),
        zero(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (marks - hedges) / n))).alias("specificity"),
        zero(1.0 / (1.0 + F.log(n / (T.occurrences(F.col("text"), ".") + 1) + 1) / 5.0)).alias("density"),
        F.when((n < 2) | (F.size(long) == 0), 0.0).otherwise(F.round((F.size(long) - F.size(F.array_distinct(long))) / F.size(long), 9)).alias("repetition"),
        F.round(T.judged_factuality(F.col("text")), 9).alias("judged"),
    )


CONSISTENCY = "round(least(1.0, greatest(0.0, specificity * 0.5 + density * 0.3 + (1.0 - repetition) * 0.2)), 10)"


@query(f"SELECT doc_id, n_words, diversity, specificity, density, repetition, judged, {CONSISTENCY} AS consistency FROM ({SCORES_SQL})")
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scorer of every document."""
    found = scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "diversity", "specificity", "density", "repetition", "judged", F.expr(CONSISTENCY).alias("consistency"))


_COUNTS = """SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1, 2"""
_ENTROPY = f"""SELECT doc_id, -sum(n::DOUBLE / t * log2(n::DOUBLE / t)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM ({_COUNTS})) GROUP BY 1"""


def char_entropy(docs: DataFrame) -> DataFrame:
    """(doc_id, entropy) of characters, in bits; texts without characters are left out."""
    counts = docs.select("doc_id", F.explode(F.split("text", "")).alias("c")).filter("c <> ''").groupBy("doc_id", "c").count()
    per = counts.groupBy("doc_id").agg(F.sum("count").alias("t"), F.sum(F.col("count") * F.log2(F.col("count"))).alias("s"))
    return per.select("doc_id", (F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


@query(f"""SELECT d.doc_id, round(coalesce(entropy, 0.0), 6) AS entropy,
  round(CASE WHEN entropy IS NULL THEN 100.0 ELSE pow(2, entropy) * greatest(1.0, 1.0 + ln(strlen(text) / 100.0)) END, 4) AS perplexity
  FROM documents d LEFT JOIN ({_ENTROPY}) e ON d.doc_id = e.doc_id""")
def char_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of characters with the length factor; 100 for empty texts."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", T.length_factor(F.col("text")).alias("f")).join(char_entropy(docs), "doc_id", "left")
    perplexity = F.when(F.col("entropy").isNull(), 100.0).otherwise(F.pow(F.lit(2.0), F.col("entropy")) * F.col("f"))
    return found.select("doc_id", F.round(F.coalesce("entropy", F.lit(0.0)), 6).alias("entropy"), F.round(perplexity, 4).alias("perplexity"))


_STEM = "CASE WHEN strlen({0}) < 4 THEN {0} " + " ".join(f"WHEN {{0}} LIKE '%{s}' AND strlen({{0}}) - {len(s)} >= 2 THEN {{0}}[:-{len(s) + 1}]" for s in T.SUFFIXES) + " ELSE {0} END"


@query(f"""SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, {_STEM.format('t')} AS token FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS t FROM documents))
  WHERE token NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)}) GROUP BY 1""")
def token_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed tokens without stop words, their occurrences and documents."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("t")).groupBy("t", "doc_id").count()
    stemmed = each.select("doc_id", "count", T.stem(F.col("t")).alias("token")).filter(~F.col("token").isin(*T.STOP_WORDS))
    per = stemmed.groupBy("token", "doc_id").agg(F.sum("count").alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(r"""SELECT doc_id, CASE WHEN len(s) = 0 THEN 0.0 ELSE round((len(s) - len(list_distinct(s)))::DOUBLE / len(s), 9) END AS sentence_repetition
  FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: lower(trim(x, ' '))), lambda x: x <> '') AS s FROM documents)""")
def sentence_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.sentence_repetition(F.col("text")), 9).alias("sentence_repetition"))


@query(rf"""SELECT doc_id, CASE WHEN len(w) < 3 THEN 0.0 ELSE round(1.0 - len(list_distinct(g))::DOUBLE / len(g), 9) END AS phrase_repetition
  FROM (SELECT doc_id, w, list_transform(list_zip(w[1:len(w) - 2], w[2:len(w) - 1], w[3:]), lambda p: p[1] || ' ' || p[2] || ' ' || p[3]) AS g FROM (SELECT doc_id, {_LOW} AS w FROM documents))""")
def phrase_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.phrase_repetition(F.col("text"), 3), 9).alias("phrase_repetition"))


#: Phrases that contradict one another.
CONTRADICTIONS = ("(?i)however.*but", "(?i)although.*nevertheless", "(?i)not.*is", "(?i)never.*always")


@query("SELECT doc_id, " + " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN 1 ELSE 0 END" for p in CONTRADICTIONS) + " AS contradictions FROM documents")
def contradiction_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradiction patterns that a text matches, within one line."""
    return table(spark, sf_dir, "documents").select("doc_id", sum((F.col("text").rlike(p).cast("int") for p in CONTRADICTIONS[1:]), F.col("text").rlike(CONTRADICTIONS[0]).cast("int")).alias("contradictions"))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, response): each user turn with the assistant turn that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    following = conversations.withColumn("next_role", F.lead("role").over(w)).withColumn("response", F.lead("text").over(w))
    return following.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "response")


_PAIRS = """SELECT conv_id, turn, text AS prompt, response FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS response FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'"""
_JAC = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"


@query(rf"""SELECT conv_id, turn, round(CASE WHEN prompt = '' OR response = '' THEN 0.0 ELSE least(1.0,
    {_JAC.format('lp', 'lr')} * CASE WHEN ratio > 1.5 THEN 1.0 / ratio ELSE 1.0 END + CASE WHEN contains(lower(prompt), lower(response)) THEN 0.2 ELSE 0.0 END) END, 9) AS entailment,
  round({_JAC.format('p', 'r')}, 9) AS faithfulness, round({_JAC.format('cp', 'cr')}, 9) AS char_overlap
  FROM (SELECT *, {_W.format('lower(prompt)')} AS lp, {_W.format('lower(response)')} AS lr, {_W.format('prompt')} AS p, {_W.format('response')} AS r,
    string_split(prompt, '') AS cp, string_split(response, '') AS cr, strlen(response)::DOUBLE / strlen(prompt) AS ratio FROM ({_PAIRS}))""")
def turn_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entailment, faithfulness and character overlap of prompts and responses."""
    p, r = F.col("prompt"), F.col("response")
    return turn_pairs(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", F.round(T.entailment(p, r), 9).alias("entailment"), F.round(T.faithfulness(p, r), 9).alias("faithfulness"), F.round(T.char_jaccard(p, r), 9).alias("char_overlap")
    )


@query(rf"""SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 9) AS overlap
  FROM (SELECT conv_id, turn, {{0}} AS a, {{1}} AS b FROM (SELECT *, {_BRACED.format('prompt')} AS x, {_BRACED.format('response')} AS y FROM ({_PAIRS})))""".format(
    *(f"CASE WHEN len({v}) >= 2 THEN list_transform(list_zip({v}[1:len({v}) - 1], {v}[2:]), lambda p: p[1] || ' ' || p[2]) WHEN len({v}) = 1 THEN {v} ELSE [] END" for v in "xy")))
def turn_shingle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of the word pairs of prompts and responses."""
    return turn_pairs(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.round(T.overlap(F.col("prompt"), F.col("response")), 9).alias("overlap"))


def _re2(kind: str) -> str:
    return pii.PATTERNS[kind]


_FALSE = {
    "email": "contains(lower(v), 'example.com') OR contains(lower(v), 'test.com') OR contains(lower(v), 'localhost')",
    "ip_address": "starts_with(v, '127.') OR starts_with(v, '0.') OR v = '255.255.255.255'",
    "credit_card": "starts_with(v, '0000') OR starts_with(v, '1111') OR starts_with(v, '9999')",
    "ssn": "false",
    "phone": "false",
}


@query("SELECT doc_id, " + ", ".join(f"len(list_filter(regexp_extract_all(text, '{_re2(k)}'), lambda v: NOT ({_FALSE[k]}))) AS n_{k}" for k in pii.PATTERNS) + " FROM documents")
def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by type, without false positives."""
    return table(spark, sf_dir, "documents").select("doc_id", *(F.size(pii.found(F.col("text"), k)).cast("bigint").alias(f"n_{k}") for k in pii.PATTERNS))


_REDACT = "text"
for _k in pii.PiiPolicy().types:
    _REDACT = f"regexp_replace({_REDACT}, '{_re2(_k)}', '[REDACTED_{_k.upper()}]', 'g')"


@query(f"SELECT doc_id, sha256({_REDACT}) AS redacted_sha256, ({_REDACT}) <> text AS changed FROM documents")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every text after redaction by the default policy."""
    red = pii.redact(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(red, 256).alias("redacted_sha256"), (red != F.col("text")).alias("changed"))


@query(f"""WITH s AS (SELECT doc_id, source, round(0.5 * (1.0 - {CONSISTENCY}) + 0.3 * repetition + 0.2 * (1.0 - diversity), 9) AS risk,
    len(list_filter(regexp_extract_all(text, '{_re2("email")}'), lambda v: NOT ({_FALSE["email"]}))) > 0 AS pii FROM ({SCORES_SQL})),
  q AS (SELECT round(quantile_cont(risk, 0.9), 9) AS t FROM s JOIN labels l ON s.doc_id = l.doc_id WHERE quality = 1)
  SELECT source, count(*) AS n, count(*) FILTER (WHERE risk <= t) AS accepted, count(*) FILTER (WHERE risk > t AND risk <= t + 0.05) AS escalated, count(*) FILTER (WHERE risk > t + 0.05) AS rejected,
    count(*) FILTER (WHERE pii) AS with_pii, round(avg(risk), 6) AS mean_risk FROM s, q GROUP BY source""")
def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: documents accepted, escalated and rejected by calibrated text risk, and those with e-mail addresses."""
    docs = scores(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", F.expr(f"round(0.5 * (1.0 - {CONSISTENCY}) + 0.3 * repetition + 0.2 * (1.0 - diversity), 9)").alias("risk"), (F.size(pii.found(F.col("text"), "email")) > 0).alias("pii")
    )
    docs = staged(docs, "risks")  # scored once, for the threshold and the decisions
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    t = quantiles(docs.join(good, "doc_id"), "risk", {"t": 0.9}).select(F.round("t", 9).alias("t"))
    risk, limit = F.col("risk"), F.col("t")
    return docs.crossJoin(F.broadcast(t)).groupBy("source").agg(  # t is one row
        F.count(F.lit(1)).alias("n"), F.count_if(risk <= limit).alias("accepted"), F.count_if((risk > limit) & (risk <= limit + 0.05)).alias("escalated"),
        F.count_if(risk > limit + 0.05).alias("rejected"), F.count_if("pii").alias("with_pii"), F.round(F.avg("risk"), 6).alias("mean_risk"),
    )


@query(rf"""WITH a AS (SELECT DISTINCT doc_id AS id, unnest({{0}}) AS s FROM (SELECT doc_id, {_BRACED.format('text')} AS t FROM documents)),
  b AS (SELECT DISTINCT item_id, unnest({{0}}) AS s FROM (SELECT item_id, {_BRACED.format('text')} AS t FROM benchmark)),
  na AS (SELECT id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
  SELECT c.id AS doc_id, c.item_id, common, round(common::DOUBLE / (na.n + nb.n - common), 9) AS jaccard
  FROM (SELECT id, item_id, count(*) AS common FROM a JOIN b USING (s) GROUP BY 1, 2) c JOIN na ON na.id = c.id JOIN nb ON nb.item_id = c.item_id""".format(
    "CASE WHEN len(t) >= 3 THEN list_transform(list_zip(t[1:len(t) - 2], t[2:len(t) - 1], t[3:]), lambda p: p[1] || ' ' || p[2] || ' ' || p[3]) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END"))
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared word triples of documents and benchmark items through an inverted index, with their Jaccard similarity."""
    from ..operators.joins import shingle_overlap

    return shingle_overlap(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id", 3)
