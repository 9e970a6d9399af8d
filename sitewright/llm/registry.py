"""The thin queries op1 to op13 and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, divergence, filter_audit, language, neardup, packing, pii, quality, quality_rules, sharding, token_binary, toxicity
from .common import Scratch, documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir))


def op3_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = token_binary.write(documents(spark, sf_dir), tokenizer_path(), Scratch(spark, "token-ids", keep=True))
    return token_binary.checksums(token_binary.read(spark, root))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, labels(spark, sf_dir)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.learn(docs))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), labels(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def _quality_rules_sql() -> str:
    """op8 in DuckDB's SQL, with the thresholds of the table."""
    space = r"[\x20\x09-\x0D]"
    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    ratios = {
        "mean_word_chars": "word_chars / n_words", "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
        "stop_ratio": "n_stop / n_words", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    }
    bounds = [f"{ratios[n]} {op} {v}" for n, low, high in quality_rules.THRESHOLDS for op, v in ((">=", low), ("<=", high)) if v is not None]
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT r, i, list_slice(w, i, i + 7) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM h, range(0, 8) AS x(k) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop
  FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND CASE WHEN base_failed THEN false ELSE {" AND ".join(bounds)} END AS kept FROM b"""


def _filter_audit_sql() -> str:
    """op11: masks counted by part, all orders as text, each step's sums by a join with the masks of its part."""
    names = filter_audit.FILTERS
    letters = ", ".join(f"'{c}'" for c in names)
    orders = " CROSS JOIN ".join(f"l AS l{i}(c)" for i in range(len(names)))
    order = " || ".join(f"l{i}.c" for i in range(len(names)))
    once = " AND ".join(f"l{i}.c <> l{j}.c" for j in range(len(names)) for i in range(j))
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
y AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first < w.doc_id THEN 'E' ELSE '' END AS fails,
  count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM w LEFT JOIN y ON w.doc_id = y.doc_id GROUP BY ALL),
l AS (SELECT unnest([{letters}]) AS c),
o AS (SELECT {order} AS filter_order FROM {orders} WHERE {once}),
s AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM o, range(1, {len(names) + 1}) AS r(step)),
x AS (SELECT part, filter_order, step, f, contains(fails, f) AS failing, fails = f AS alone,
  len(list_filter(string_split(earlier, ''), lambda c: c <> '' AND contains(fails, c))) = 0 AS here, n, good, toxic FROM s, m),
g AS (SELECT part, filter_order, step, f, sum(CASE WHEN failing AND here THEN n ELSE 0 END) AS removed, sum(CASE WHEN failing AND NOT here THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN failing AND here THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN failing AND here THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g"""


def _divergence_sql() -> str:
    """op12: every pair of groups meets at every kept term."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    price = lambda n, total: f"1 + {divergence.SCALE}::HUGEINT * ({n} + 1) // ({total} + v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
l AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS total FROM (SELECT DISTINCT lang FROM d) AS g LEFT JOIN k ON g.lang = k.lang GROUP BY g.lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) AS x LEFT JOIN c ON x.lang = c.lang AND x.source = c.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {price("coalesce(c.n, 0)", "g.total")} AS p, {price("k.n", "l.total")} AS q
  FROM g JOIN l ON g.lang = l.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM e QUALIFY part = 'pair' OR rank <= {divergence.TOP}"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same; the other operators are tested against brute force, round trips or held-out rows."""
    return {"op8_quality_rules": _quality_rules_sql(), "op11_filter_audit": _filter_audit_sql(), "op12_source_divergence": _divergence_sql()}
