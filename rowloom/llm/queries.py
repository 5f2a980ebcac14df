"""Queries over the training-data operators: query(name) -> callable, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import alignment, decontam, fingerprints, langid, mixing, packing, pitmanyor, quality, secrets, simhash, urlfilter, vptree, whitening
from rowloom.llm.common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those not held out.

    Null text, or no letter: und with score 0. Null ids and repeated rows have a row each. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    out = langid.identify(docs, ~held_out, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


@query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document by a mix of all sources.

    Null text: size 0, nothing taken. Null sources are one source, the last. Null ids share one hash; repeated rows have a
    row each. An empty table gives no rows.
    """
    return mixing.Mix(table(spark, sf_dir, "documents")).digest()


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages: rules, else the reputation learned from the pages that rules decide.

    Null or malformed urls have an empty host and path. Null ids and repeated rows have a row each. An empty table gives no rows.
    """
    out = urlfilter.filter_urls(table(spark, sf_dir, "pages"))
    return out.withColumns({"rate": F.round("rate", 6), "bound": F.round("bound", 6)})


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how like they are.

    Null text is empty. Null ids come last in the order; rows of equal ids are ordered by length and hash. One row is its own
    next. An empty table gives no rows.
    """
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels of those not held out.

    Null and empty texts score the labels' share of 1; without labels of both kinds all score 0.5. Null ids and repeated rows
    have a row each. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = quality.train_model(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = quality.score(docs, model, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in bins of 2,048 words.

    Null and empty texts are a piece of no words. Null sources conflict with nothing. Repeated rows are packed as often as they
    come. An empty table gives no rows.
    """
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of all documents.

    Null and empty texts have fingerprint 0, linked like any other. Null ids are the smallest of nothing: a component of them
    alone has a null one. Repeated rows have a row each. An empty table gives no rows.
    """
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of all documents, whole texts.

    Null text is empty: no span, the hash of an empty text. Null ids and repeated rows have a row each. An empty table gives no rows.
    """
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS[:3]))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"),
    )


@query
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of every 50th embedding.

    Null ids and vectors that are null, zero or not finite take no part. Rows of one id count once. An empty table gives no rows.
    """
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a model of those not held out.

    Null text is empty: the end token only. Null ids and repeated rows have a row each. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    out = pitmanyor.scores(docs, ~held_out, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents.

    Null or wordless texts are clean, null or wordless items match nothing. Null item ids have no name; repeated ones count
    once. Null doc ids and repeated rows have a row each. An empty documents table gives no rows, an empty benchmark clean ones.
    """
    out = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Public vocabulary files; every executor has them there.
TOKENIZERS = "/opt/tokenizers"


@query
def op12_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Groups and links of the tokens that two vocabularies give all documents, and how common the linked ids are.

    Texts that are null, empty or not spelled back by both have zeros and an empty hash. Null ids and repeated rows have a row
    each. An empty table gives no rows.
    """
    out = alignment.align_documents(table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model", ["doc_id"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_products")


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of all embeddings.

    Vectors that are null or hold null or non-finite entries (or are empty, or of another length than the commonest) take no part.
    Null ids and repeated rows have rows of their own. An empty table gives no rows.
    """
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id")


_STRENGTH = """SELECT least(greatest(coalesce(CASE WHEN rho <= 0 THEN 1000.0 ELSE 1 / least(rho, 1.0) - 1 END, 1.0), 0.5), 1000.0)::DOUBLE AS strength FROM (
    SELECT (sum(n * (bad / n - prior) * (bad / n - prior)) - sum(prior * (1 - prior))) / greatest(sum(n * prior * (1 - prior)) - sum(prior * (1 - prior)), 1e-9) AS rho FROM {0} WHERE n > 0)"""
_ADDRESS, _SHARED = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$", r"(^|\.)(ac|co|com|edu|go|gob|gov|ne|net|or|org)\.[a-z]{2}$"
_LAST = "array_to_string(list_slice(string_split(bare, '.'), -{0}, -1), '.')"
_RATE = "(bad + strength * prior) / (n + strength)"
SQL["op3_url_filter"] = f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
fit AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts),
tree AS (
  SELECT host, CASE WHEN regexp_matches(bare, '{_ADDRESS}') THEN bare WHEN regexp_matches(bare, '{_SHARED}') THEN {_LAST.format(3)} ELSE {_LAST.format(2)} END AS domain,
         CASE WHEN regexp_matches(bare, '{_ADDRESS}') THEN 'address' WHEN regexp_matches(bare, '{_SHARED}') THEN {_LAST.format(2)} ELSE {_LAST.format(1)} END AS suffix,
         count(rule)::DOUBLE AS n, count(*) FILTER (WHERE rule IN ('example.com/en/', 'net/es/', 'net/fr/'))::DOUBLE AS bad
  FROM (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$|\\.$', '', 'g') AS bare FROM fit) GROUP BY ALL),
total AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS prior FROM tree),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(total.prior) AS prior FROM tree, total GROUP BY suffix),
s1 AS (SELECT suffix, {_RATE} AS prior FROM s0, ({_STRENGTH.format("s0")})),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(s1.prior) AS prior FROM tree JOIN s1 USING (suffix) GROUP BY domain, suffix),
d1 AS (SELECT domain, {_RATE} AS prior FROM d0, ({_STRENGTH.format("d0")})),
h0 AS (SELECT tree.*, d1.prior FROM tree JOIN d1 USING (domain)),
h1 AS (SELECT host, {_RATE} AS rate, n + strength AS size FROM h0, ({_STRENGTH.format("h0")})),
ab AS (SELECT host, rate, rate * size AS a, (1 - rate) * size AS b FROM h1),
g AS (SELECT *, ln(a / b) AS mid, sqrt(1 / a + 1 / b + 1 / (a * a) + 1 / (b * b)) AS dev, a * ln(a / (a + b)) + b * ln(b / (a + b)) AS top FROM ab),
z AS (SELECT host, rate, a, b, top, i, mid + dev * ((i - 90) * 0.1::DOUBLE) AS z FROM g, range(181) r(i)),
w AS (SELECT host, rate, i, z, exp(a * (-greatest(-z, 0) - ln(1 + exp(-abs(z)))) + b * (-greatest(z, 0) - ln(1 + exp(-abs(z)))) - top) AS w FROM z),
c AS (SELECT *, lag(z) OVER (PARTITION BY host ORDER BY i) AS z0, (w + lag(w) OVER (PARTITION BY host ORDER BY i)) / 2 AS part FROM w),
f AS (SELECT *, sum(part) OVER (PARTITION BY host ORDER BY i) AS through, 0.05::DOUBLE * sum(part) OVER (PARTITION BY host) AS target FROM c),
h2 AS (SELECT host, rate, 1 / (1 + exp(-(z0 + (z - z0) * (target - (through - part)) / part))) AS bound FROM f WHERE part IS NOT NULL AND through >= target QUALIFY row_number() OVER (PARTITION BY host ORDER BY i) = 1)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       round(rate, 6) AS rate, round(bound, 6) AS bound FROM fit JOIN h2 USING (host)
"""
_PLAIN_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[])"
SQL["op11_decontamination"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_PLAIN_WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS id, w, least(10, len(w)) AS l FROM (SELECT item_id, {_PLAIN_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT id, l, array_to_string(w[s:s + l - 1], ' ') AS t FROM i, unnest(range(1, len(w) - l + 2)) u(s)),
placed AS (SELECT r, p, l, array_to_string(w[p:p + l - 1], ' ') AS t FROM d, (SELECT DISTINCT l FROM win), unnest(range(1, len(w) - l + 2)) u(p)),
found AS (SELECT r, p, placed.l, id FROM placed JOIN win USING (l, t)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + l)) u(q) GROUP BY r),
named AS (SELECT r, count(DISTINCT id) AS n_items, sha256(coalesce(string_agg(DISTINCT id, ',' ORDER BY id), '')) AS h FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
