"""The registered query of each operator, over its whole table, and DuckDB SQL where SQL can express the result."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evipack.llm import bpe, exact_dedup, filter_audit, html, licenses, line_dedup, middle, mixing, pii, quality, sharding, simhash, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark, sf_dir):
    return simhash.simhash_near_dedup(_documents(spark, sf_dir))


def op2_licenses(spark, sf_dir):
    return licenses.license_scan(_documents(spark, sf_dir))


def op3_token_counts(spark, sf_dir):
    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quality(spark, sf_dir):
    return quality.quality_rules(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op6_bpe(spark, sf_dir):
    coded = bpe.bpe_round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_html(spark, sf_dir):
    found = html.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_pii(spark, sf_dir):
    found = pii.pii_spans(_documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x.kind.isin(*pii.BASE))
    counts = [F.expr(f"size(filter(spans, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_line_dedup(spark, sf_dir):
    found = line_dedup.line_dedup(_documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op11_sharding(spark, sf_dir):
    found = sharding.kd_shards(_documents(spark, sf_dir), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_middle(spark, sf_dir):
    found = middle.fill_in_middle(_documents(spark, sf_dir))
    again = middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_licenses, op3_token_counts, op4_quality, op5_exact_dedup, op6_bpe, op7_html, op8_pii, op9_line_dedup, op10_mixing, op11_sharding, op12_filter_audit, op13_middle)}

_LICENSE_ROWS = ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(licenses.TEMPLATES))
_WORDS = "string_split(trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ')"
_BIGRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

ORACLES = {
    "op2_licenses": f"""
WITH templates AS (SELECT k, license, len(w) AS n, {_BIGRAMS} AS b FROM (SELECT k, license, {_WORDS.format("t")} AS w FROM (VALUES {_LICENSE_ROWS}) AS x(k, license, t))),
texts AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] AS g FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM texts)),
places AS (SELECT r, k, i, g FROM grams JOIN (SELECT k, unnest(b) AS g FROM templates) USING (g)),
likely AS (SELECT r, k FROM places JOIN templates USING (k) GROUP BY r, k, b HAVING count(DISTINCT g) >= len(b) * 0.8 / 1.2 - 1e-9),
runs AS (SELECT r, doc_id, k, license, n, b, i, list_distinct(list_transform(range(i, least(i + n - 1, len(w))), lambda j: w[j] || ' ' || w[j + 1])) AS own
  FROM likely JOIN places USING (r, k) JOIN templates USING (k) JOIN texts USING (r)),
scored AS (SELECT r, doc_id, license, n, i, 2.0::DOUBLE * len(list_intersect(own, b)) / (len(own) + len(b)) AS d FROM runs),
hits AS (SELECT DISTINCT * FROM scored WHERE d >= 0.8 - 1e-12),
best AS (SELECT DISTINCT r, doc_id, license, i, d FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.r = h.r AND o.i < h.i + h.n AND o.i + o.n > h.i
  AND (o.d > h.d OR (o.d = h.d AND (o.n > h.n OR (o.n = h.n AND o.i < h.i))))))
SELECT doc_id, license, round(max(d), 6)::DOUBLE AS dice, count(*)::BIGINT AS n_units FROM best GROUP BY r, doc_id, license
""",
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id NULLS LAST) AS keep_id FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
""",
    "op9_line_dedup": """
WITH lines AS (SELECT doc_id, i, s[i] AS line, translate(trim(s[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
common AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM lines l LEFT JOIN common c USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
""",
    # every order applied step by step to every set of failures
    "op12_filter_audit": """
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, doc_id > min(doc_id) OVER (PARTITION BY t) AS again FROM texts),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, (len(w) < 100) AS a, (100 * len(list_distinct(w)) < 80 * len(w)) AS b, (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t)) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(again, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM words LEFT JOIN marks USING (doc_id)),
sets AS (SELECT part, list_filter([CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END], lambda x: x IS NOT NULL) AS f,
  count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
walk AS (SELECT '' AS o UNION ALL SELECT o || x FROM walk, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(o, x)),
steps AS (SELECT o AS filter_order, k::INT AS step, o[k] AS x, string_split(o[1:k - 1], '') AS earlier FROM walk, range(1, 6) r(k) WHERE length(o) = 5),
told AS (SELECT part, filter_order, step, x,
  coalesce(sum(n) FILTER (NOT list_has_any(f, earlier) AND NOT list_contains(f, x)), 0) AS kept,
  coalesce(sum(n) FILTER (NOT list_has_any(f, earlier) AND list_contains(f, x)), 0) AS removed,
  coalesce(sum(n) FILTER (list_has_any(f, earlier) AND list_contains(f, x)), 0) AS redundant,
  coalesce(sum(n) FILTER (f = [x]), 0) AS unique_fails,
  coalesce(sum(good) FILTER (NOT list_has_any(f, earlier) AND list_contains(f, x)), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (NOT list_has_any(f, earlier) AND list_contains(f, x)), 0) AS toxic_lost
  FROM sets, steps GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM told
""",
    "op13_middle": """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
draws AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS l, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM texts),
cuts AS (SELECT doc_id, t, l, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM draws),
parts AS (SELECT doc_id, t, n, form, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts
""",
}
