"""Registered queries of the text operators, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import bpe, decontaminate, divergence, html_extract, importance, license_scan, line_quality, pii, quality_rules, secret_scan, simhash, toxicity, url_filter
from flowlens.llm.textio import LOWER, UPPER, held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of encoded and decoded texts."""
    out = bpe.round_trip(F.col("text"), bpe.default_path())
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("r")).select("doc_id", "r.*")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts with limits by language and source."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


_flags = " AND ".join(
    f"{v} <= {n}_most" + ("" if quality_rules.MARGINS[n][1] is None else f" AND {v} >= {n}_least")
    for n, v in (("symbols", "symbols"), ("dup_lines", "dup_lines"), ("repeats", "repeats"), ("length", "length"))
)
_margins = ", ".join(f"('{n}', {a}, {-1 if b is None else b})" for n, (a, b) in quality_rules.MARGINS.items())
_limits = ", ".join(f"max(CASE WHEN share = '{n}' THEN hi END) AS {n}_most, max(CASE WHEN share = '{n}' THEN lo END) AS {n}_least" for n in quality_rules.MARGINS)
ORACLES["op2_quality_rules"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
s AS (SELECT d.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM d JOIN w USING (rid) LEFT JOIN l USING (rid) LEFT JOIN r USING (rid)),
v AS (SELECT *, n_symbols * 1000 // greatest(word_chars, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
  n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, word_chars * 1000 // greatest(n_words, 1) AS length FROM s),
x AS (SELECT rid, lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'length']) AS share, unnest([symbols, dup_lines, repeats, length]) AS value FROM v),
y AS (SELECT *, CASE WHEN value < 16 THEN value ELSE (value >> (length(bin(value)) - 5)::INT) << (length(bin(value)) - 5)::INT END AS cell FROM x),
z AS (SELECT 0 AS level, lang, source, share, cell FROM y UNION ALL SELECT 1, lang, NULL, share, cell FROM y UNION ALL SELECT 3, NULL, NULL, share, cell FROM y),
k AS (SELECT level, lang, source, share, cell, count(*) AS n FROM z GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, share) AS total, sum(n) OVER (PARTITION BY level, lang, source, share ORDER BY cell) AS upto FROM k),
q AS (SELECT level, lang, source, share, max(total) AS rows_, min(CASE WHEN upto * 4 >= total THEN cell END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN cell END) AS q3
  FROM u GROUP BY ALL),
b AS (SELECT level, lang, source, max(rows_) AS rows_, {_limits} FROM (SELECT q.*, q3 + (q3 - q1) * 3 + above AS hi, q1 - (q3 - q1) * 3 - below AS lo
  FROM q JOIN (VALUES {_margins}) m(share, above, below) USING (share)) GROUP BY ALL),
j AS (SELECT v.*, CASE WHEN b0.rows_ >= 30 THEN 0 WHEN b1.rows_ >= 30 THEN 1 ELSE 3 END AS level FROM v
  LEFT JOIN b b0 ON b0.level = 0 AND b0.lang IS NOT DISTINCT FROM v.lang AND b0.source IS NOT DISTINCT FROM v.source
  LEFT JOIN b b1 ON b1.level = 1 AND b1.lang IS NOT DISTINCT FROM v.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fits AS kept, level FROM (
  SELECT j.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_flags} AS fits FROM j
  JOIN b ON b.level = j.level AND (j.level = 3 OR b.lang IS NOT DISTINCT FROM j.lang) AND (j.level > 0 OR b.source IS NOT DISTINCT FROM j.source))
"""


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices by diagonal voting."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_extract.extract("html").alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Trained on documents whose id isn't held out."""
    return toxicity.fit(docs.filter(~held_out(F.col("doc_id"), 3, 1)), table(spark, sf_dir, "labels"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), toxicity.score("text", toxicity_model(spark, docs, sf_dir)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from its lines."""
    docs = table(spark, sf_dir, "documents")
    model = line_quality.fit(docs.filter(~held_out(F.col("doc_id"), 5, 0)), table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), line_quality.score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of near-copies."""
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and how much of it."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


#: Fixed rules, and a list of unwanted sites for URLs that no rule fits.
URL_RULES = [
    ("com", "/", "allow", 1),
    ("example.com", "/en/", "block", 1),
    ("www.example.com", "/en/", "allow", 1),
    ("net", "/es/", "block", 1),
    ("net", "/fr/", "block", 1),
]
URL_LIST = [(f"{site}.example.{top}", "/", "block", 0) for site in ("casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    listed = spark.createDataFrame(URL_RULES + URL_LIST, "host string, path string, verdict string, rank int")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


_listed = ", ".join(f"('{h}', '{p}', '{v}', {r})" for h, p, v, r in URL_RULES + URL_LIST)
_at = "instr(url, '://')"
_rest = f"CASE WHEN coalesce({_at}, 0) > 0 THEN substr(url, {_at} + 3) ELSE '' END"
ORACLES["op9_url_filter"] = f"""
WITH listed(lhost, lpath, lverdict, rank) AS (VALUES {_listed}),
p AS (SELECT page_id, row_number() OVER () AS rid, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, {_rest} AS rest FROM pages)),
h AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY rank DESC, length(lhost || lpath) DESC, length(lhost) DESC) AS rn
  FROM p LEFT JOIN listed ON (host = lhost OR ends_with(host, '.' || lhost)) AND starts_with(path, lpath))
SELECT page_id, host, path, CASE WHEN rank = 1 THEN lhost || lpath END AS rule, coalesce(lverdict, 'allow') AS verdict FROM h WHERE rn = 1
"""


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pii.find("text", pii.fit(docs)).alias("r")).select("doc_id", "r.*")


@query
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights towards the benchmark, and the drawn tenth of the documents."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_in_words = f"regexp_extract_all({_lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES["op11_importance"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_in_words} AS ws FROM documents),
f AS (SELECT rid, unnest(ws) AS w FROM d), b AS (SELECT unnest({_in_words}) AS w FROM benchmark),
tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM f UNION SELECT w FROM b)),
y AS (SELECT w, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT) AS bytes FROM v),
k AS (SELECT w, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM y, tab),
s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE
  / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM k) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
m AS (SELECT rid, sum(gain)::BIGINT AS total FROM f JOIN k USING (w) JOIN g USING (bucket) GROUP BY rid),
x AS (SELECT doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE (total - ((total % len(ws) + len(ws)) % len(ws))) // len(ws) END AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (rid)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296.0::DOUBLE)))::BIGINT AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM z)
SELECT doc_id, n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM r
"""


@query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far sources of a language differ, and in which terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op12_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_lower}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT rid, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
o AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL), l AS (SELECT lang, term, sum(n) AS n FROM o GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM l GROUP BY lang),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM o GROUP BY ALL) USING (lang, source)
  LEFT JOIN (SELECT lang, v FROM v) USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v) AS p FROM g JOIN k USING (lang) LEFT JOIN o USING (lang, source, term)),
q AS (SELECT l.lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (total + v) AS q FROM l JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "C") AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by the trigram index, verified."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


_rules = ", ".join(f"({n}, '{r.kind}', {r.base})" for n, r in enumerate(secret_scan.RULES))


def _places(n: int, r: secret_scan.Rule) -> str:
    pattern = "'" + r.pattern.replace("'", "''") + "'"
    cols = f"unnest(regexp_extract_all(t, {pattern}, 0)) AS hit, unnest(regexp_extract_all(t, {pattern}, {r.group})) AS part, unnest(string_split_regex(t, {pattern})[:-2]) AS gap"
    before = "sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i) - length(hit)"
    return f"""SELECT rid, {n} AS kind, {before} AS a, length(hit) AS size, length(part) AS part FROM (SELECT rid, unnest(range(len(regexp_extract_all(t, {pattern}, 0)))) AS i, {cols} FROM d)"""


ORACLES["op13_secret_scan"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
rules(kind, name, base) AS (VALUES {_rules}),
m AS ({" UNION ALL ".join(f"SELECT * FROM ({_places(n, r)}) WHERE part >= {r.least}" for n, r in enumerate(secret_scan.RULES))}),
s AS (SELECT rid, kind, base, a, name || ':' || a::BIGINT || ':' || (a + size)::BIGINT AS span FROM m JOIN rules USING (kind)),
u AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = {n}) AS n_{r.kind}" for n, r in enumerate(secret_scan.RULES) if r.base)},
  coalesce(string_agg(span, ',' ORDER BY a, kind) FILTER (base), '') AS own, string_agg(span, ',' ORDER BY a, kind) AS spans FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.RULES if r.base)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN u USING (rid)
"""
