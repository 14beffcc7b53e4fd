"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satspan.llm import (
    context_mixing,
    fill_in_middle,
    filter_audit,
    hilbert_sharding,
    html_differencing,
    latent_decontamination,
    license_index,
    link_graph,
    quality_rules,
    secret_crf,
    setsketch_dedup,
    source_mixing,
    warc_bundles,
)
from satspan.llm.common import table


def op1_linear_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_crf.scan(table(spark, sf_dir, "documents"))


def op2_logistic_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"))


def op3_seekable_zstandard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc_bundles.read(warc_bundles.write(pages), dict(pages.dtypes)["page_id"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "frame_offset"
    )


def op4_latent_semantic_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = source_mixing.plan(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_nearest_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_differencing.extract(table(spark, sf_dir, "pages"))


def op7_threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_setsketch_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup.score(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op9_hilbert_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_sharding.plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.scan(table(spark, sf_dir, "documents"))


def op11_link_graph_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judge(table(spark, sf_dir, "pages"))


def op12_lookaround_splitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.transform(table(spark, sf_dir, "documents"), "characters")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return cut.select(
        "doc_id", "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"),
        digest(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op13_incidence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_linear_chain_crf,
        op2_logistic_context_mixing,
        op3_seekable_zstandard,
        op4_latent_semantic_retrieval,
        op5_capped_water_filling,
        op6_nearest_url_differencing,
        op7_threshold_table,
        op8_setsketch_registers,
        op9_hilbert_curve,
        op10_rare_token_index,
        op11_link_graph_propagation,
        op12_lookaround_splitting,
        op13_incidence_matrix,
    )
}


def _link_graph_sql() -> str:
    """The rounds of the propagation written out, each from the one before."""
    rules = sorted(link_graph.RULES, key=lambda r: -len(r.host + r.path))
    fits = [f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')" for r in rules]
    pick = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values)) + " END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    url = lambda k: f"coalesce(regexp_extract(url, '{link_graph._URL}', {k}), '')"
    link = link_graph.LINK.replace("'", "''")
    units, follow, share = link_graph.UNITS, link_graph.FOLLOW, link_graph.SEED_SHARE
    seed = lambda v: f"CASE WHEN count(*) FILTER (verdict = '{v}') / count(*) > {share} THEN count(*) FILTER (verdict = '{v}') / count(*) ELSE 0 END"
    rounds = "".join(
        f""",
c{k} AS MATERIALIZED (SELECT kind, dst AS host, sum(floor(mass * share)) AS came FROM flow JOIN m{k - 1} USING (kind, host) GROUP BY 1, 2),
a{k} AS MATERIALIZED (SELECT kinds.kind, {units} - coalesce(sum(came), 0) AS rest FROM kinds LEFT JOIN c{k} USING (kind) GROUP BY 1),
m{k} AS MATERIALIZED (SELECT kind, host, sum(mass) AS mass FROM (SELECT kind, host, floor(rest * home) AS mass FROM home JOIN a{k} USING (kind)
  UNION ALL SELECT kind, host, came FROM c{k}) GROUP BY 1, 2)"""
        for k in range(1, link_graph.ROUNDS + 1)
    )
    return f"""
WITH kinds AS (SELECT unnest(['trust', 'distrust']) AS kind),
u AS MATERIALIZED (SELECT page_id, {lower.format(url(1))} AS host, {url(2)} AS path, html FROM pages),
p AS MATERIALIZED (SELECT page_id, host, path, html, {pick([r.host + r.path for r in rules])} AS rule, {pick([r.verdict for r in rules])} AS verdict FROM u),
x AS (SELECT host AS src, unnest(list_transform(regexp_extract_all(html, '{link}', 1), lambda h: {lower.format("h")})) AS dst FROM p WHERE html LIKE '%//%'),
e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM x WHERE src <> '' AND src <> dst GROUP BY 1, 2),
b AS (SELECT 'trust' AS kind, src AS host, dst, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
flow AS MATERIALIZED (SELECT kind, host, dst, {follow} * (n::DOUBLE / sum(n) OVER (PARTITION BY kind, host)::DOUBLE) AS share FROM b),
s AS (SELECT host, {seed("allow")} AS trusted, {seed("block")} AS blocked FROM p WHERE host <> '' GROUP BY 1),
w AS MATERIALIZED (SELECT host, kind, floor(weight * 1e6) AS weight FROM (SELECT host, 'trust' AS kind, trusted AS weight FROM s UNION ALL SELECT host, 'distrust', blocked FROM s) WHERE weight > 0),
t AS MATERIALIZED (SELECT kind, sum(weight) AS total FROM w GROUP BY 1),
home AS MATERIALIZED (SELECT kind, host, weight / total AS home FROM w JOIN t USING (kind)),
m0 AS MATERIALIZED (SELECT kind, host, floor(home * {units}) AS mass FROM home){rounds},
r AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN mass * (total / 1e6) / {units} ELSE 0 END) AS trust,
  sum(CASE WHEN kind = 'distrust' THEN mass * (total / 1e6) / {units} ELSE 0 END) AS distrust FROM m{link_graph.ROUNDS} JOIN t USING (kind) GROUP BY 1)
SELECT page_id, p.host, path, rule, coalesce(verdict, CASE WHEN round(coalesce(distrust, 0), 6) - round(coalesce(trust, 0), 6) >= {link_graph.MARGIN} THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust FROM p LEFT JOIN r USING (host)"""


_BLANK = r"[^\x20\x09-\x0D]"
_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_RULES = {r.name: r for r in quality_rules.RULES}

#: Twins of the queries that SQL can express in full.
SQL: dict[str, str] = {
    "op7_threshold_table": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{_BLANK}+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_BLANK}')) AS ls,
  length(regexp_replace(t, '{_BLANK.replace("^", "")}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM x),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE len(g) = 8) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(ls) AS n_lines, len(list_filter(ws, lambda v: lower(v) IN ({_STOP}))) AS n_stop FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= {_RULES["length"].low} AND n_repeat_words / n_words <= {_RULES["repeated windows"].high}
  AND word_chars / n_words BETWEEN {_RULES["word length"].low} AND {_RULES["word length"].high} AND n_symbols / n_words <= {_RULES["symbols"].high}
  AND (n_stop / n_words >= {_RULES["stop words"].low} OR n_words < {_RULES["stop words"].least_words}) AND n_dup_lines / n_lines <= {_RULES["repeated lines"].high} AS kept
FROM f""",
    "op8_setsketch_registers": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}+') AS ws FROM documents),
x AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g FROM x),
s AS (SELECT DISTINCT doc_id, g FROM g WHERE i <= greatest(n - 4, 1)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
q AS (SELECT doc_id AS x, doc_id AS root FROM w UNION SELECT e.y, q.root FROM q JOIN e ON e.x = q.x),
k AS (SELECT x AS doc_id, min(root) AS component_id FROM q GROUP BY 1)
SELECT doc_id, coalesce(z.n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM k LEFT JOIN z USING (doc_id)""",
    "op11_link_graph_propagation": _link_graph_sql(),
    "op12_lookaround_splitting": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT doc_id, t, length(t) AS n, {", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))} FROM d),
y AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
z AS (SELECT *, substr(t, 1, low) AS a, substr(t, low + 1, high - low) AS m, substr(t, high + 1, n - high) AS s FROM y)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE a || m || s END) AS restored_sha256 FROM z""",
    "op13_incidence_matrix": f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_BLANK}+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS MATERIALIZED (SELECT part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
k AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM k p, k q, k r, k s, k t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
x AS (SELECT part, o, step, fails[o[step]] AS own, list_bool_or([fails[o[j]] FOR j IN range(1, step)]) IS TRUE AS gone, len(list_filter(fails, lambda v: v)) AS n_fails, n, good, toxic
  FROM g, o, (SELECT unnest(range(1, 6)) AS step)),
z AS (SELECT part, array_to_string([substr('ABCDE', v, 1) FOR v IN o], '') AS filter_order, o[step] AS filter, step, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN own AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM z""",
}
