"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huespan.llm import bpe, decontaminate, hnsw, html_text, licenses, lloyd, near_dedup, shards, token_counts, toxicity, url_filter, warc, whiten
from huespan.llm.common import shared_path, table


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the quality labels, whose ids are taken as page ids: the tables have no others."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), outcomes)
    return judged.withColumns({c: F.round(c, 6) for c in ("reputation", "upper")})


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(warc.plan_captures(table(spark, sf_dir, "pages")), path)
    return warc.capture_digest(warc.assemble(warc.read_archives(spark, path, payloads=False)))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that contaminates it; documents without a row are clean."""
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, lexicon)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.with_inertia(lloyd.cluster(table(spark, sf_dir, "embeddings")))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_hnsw, op2_url_filter, op3_near_dedup, op4_warc, op5_decontamination, op6_html_extraction, op7_license_scan, op8_toxicity, op9_token_counts, op10_bpe, op11_lloyd, op12_shards, op13_whitening)}

def _base32(h: str) -> str:
    """SQL for the base32 text of a 40-digit hexadecimal text."""
    digits = [f"substr('{warc._BASE32}', ((('0x' || substr({h}, {10 * k + 1}, 10))::BIGINT >> {35 - 5 * j}) & 31)::INT + 1, 1)" for k in range(4) for j in range(8)]
    return " || ".join(digits)


OP4_SQL = f"""
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {_base32("h")} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> first_id THEN first_id END AS refers_to, coalesce(url, '') AS url FROM f
"""


def _op2_sql() -> str:
    two = ", ".join(f"'{x}'" for x in url_filter.TWO_PART_SUFFIXES)
    low, high = url_filter.STRENGTH
    last = lambda k: f"array_to_string(string_split(bare, '.')[-{k}:], '.')"
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0]) - len(r[1]))
    fits = lambda h, p: f"(host = '{h}' OR suffix_of(host, '.{h}')) AND starts_with(path, '{p}')".replace("suffix_of", "ends_with")
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in rules) + " END"

    def strength(level: str) -> str:
        return f"""(SELECT CASE WHEN rho IS NULL THEN {low} WHEN rho <= 1 / ({high} + 1) THEN {high} ELSE least({high}, greatest({low}, 1 / rho - 1)) END FROM (
            SELECT CASE WHEN sum(m * (1 - m) * (n - 1)) > 0 THEN (sum(n * (s / n - m) * (s / n - m)) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)) END::DOUBLE AS rho FROM {level}))::DOUBLE"""

    def shrunk(level: str, name: str) -> str:
        return f"SELECT {name}, s, n, m, k, s + m * k AS a, n - s + (1 - m) * k AS b FROM {level}, (SELECT {strength(level)} AS k)"

    def others(level: str, up: str, key: str, mean: str) -> str:
        return f"SELECT x.*, (u.s - x.s + {mean} * u.k) / (u.n - x.n + u.k) AS m FROM {level} x JOIN {up} u USING ({key})"

    return f"""
WITH c AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM c),
hosts AS (SELECT host, CASE WHEN address THEN bare WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN address THEN bare WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix
    FROM (SELECT *, regexp_matches(bare, '{url_filter.ADDRESS}') AS address FROM (SELECT DISTINCT host, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS bare FROM u))),
o AS (SELECT host, sum(quality)::DOUBLE AS s, count(*)::DOUBLE AS n FROM u JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL GROUP BY host),
oh AS (SELECT * FROM o JOIN hosts USING (host)),
od AS (SELECT domain, suffix, sum(s) AS s, sum(n) AS n FROM oh GROUP BY ALL),
os AS (SELECT suffix, sum(s) AS s, sum(n) AS n FROM od GROUP BY ALL),
t AS (SELECT coalesce((sum(s) + 1) / (sum(n) + 2), 0.5)::DOUBLE AS rate FROM os),
ms AS (SELECT os.*, rate AS m FROM os, t), s3 AS ({shrunk("ms", "suffix")}),
md AS ({others("od", "s3", "suffix", "(SELECT rate FROM t)")}), s2 AS ({shrunk("md", "domain")}),
mh AS ({others("oh", "s2", "domain", "u.m")}), s1 AS ({shrunk("mh", "host")}),
j AS (SELECT hosts.host, coalesce(s1.a, s2.a, s3.a, rate * {low}) AS a, coalesce(s1.b, s2.b, s3.b, (1 - rate) * {low}) AS b
    FROM hosts CROSS JOIN t LEFT JOIN s1 ON s1.host = hosts.host LEFT JOIN s2 ON s2.domain = hosts.domain LEFT JOIN s3 ON s3.suffix = hosts.suffix),
r AS (SELECT host, a / (a + b) AS reputation, least(1.0, a / (a + b) + {url_filter.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS upper FROM j)
SELECT page_id, host, path, {rule} AS rule, coalesce({said}, CASE WHEN upper < {url_filter.BOUND} THEN 'block' ELSE 'allow' END) AS verdict, round(reputation, 6)::DOUBLE AS reputation, round(upper, 6)::DOUBLE AS upper
FROM u JOIN r USING (host)
"""


def _op11_sql() -> str:
    """Rounds as a chain of tables: a is an assignment, c are centroids, m the moved ones."""
    gap = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.x, c.x)])::BIGINT"
    steps = []
    for k in range(lloyd.ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT v.r, min({{'d': {gap}, 'k': c.k}}) AS best FROM v, c{k} c GROUP BY v.r)")
        if k < lloyd.ROUNDS:
            steps.append(f"m{k} AS (SELECT k, list(s // n - (s % n < 0)::BIGINT ORDER BY j) AS x FROM (SELECT a.best.k AS k, j, sum(v.x[j])::BIGINT AS s, count(*) AS n FROM a{k} a JOIN v USING (r), (SELECT range AS j FROM range(1, {lloyd.DIM + 1})) GROUP BY ALL) GROUP BY k)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (k))")
    last = lloyd.ROUNDS
    return f"""
WITH e AS (SELECT vec_id, [floor(c::DOUBLE * {lloyd.SCALE})::BIGINT for c in embedding] AS x FROM embeddings
    WHERE len(embedding) = {lloyd.DIM} AND len([c for c in embedding if c IS NOT NULL AND isfinite(c)]) = {lloyd.DIM}),
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, x FROM e),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{lloyd.SEED}' || vec_id), x) - 1 AS k, x FROM v WHERE vec_id IS NOT NULL ORDER BY k LIMIT {lloyd.CENTROIDS}),
{", ".join(steps)}
SELECT v.vec_id, a.best.k::INT AS cluster, a.best.d AS distance, sum(a.best.d) OVER (PARTITION BY a.best.k)::BIGINT AS cluster_inertia, sum(a.best.d) OVER ()::BIGINT AS inertia,
sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{last} a JOIN v USING (r) JOIN c{last} c ON c.k = a.best.k
"""


#: What SQL can express: the others are learned, iterative, or need a tokenizer, and tests hold them against brute force.
ORACLES: dict[str, str] = {"op2_url_filter": _op2_sql(), "op4_warc": OP4_SQL, "op11_lloyd": _op11_sql()}
