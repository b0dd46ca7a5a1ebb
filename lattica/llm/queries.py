"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    return archived(_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    out = judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(_table(spark, sf_dir, "documents")).drop("spans")


def op2_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeated

    out = remove_repeated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored

    return scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_suffix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import passages, spans

    return spans(passages(_table(spark, sf_dir, "documents")))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged

    return judged(_table(spark, sf_dir, "pages"))


def op7_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import linked

    return linked(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_repeated_windows": op2_repeated_windows,
    "op3_benchmark_leaks": op3_benchmark_leaks,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_passages": op5_suffix_passages,
    "op6_url_filter": op6_url_filter,
    "op7_bin_slack_packing": op7_bin_slack_packing,
    "op8_warc_archives": op8_warc_archives,
    "op9_quality_rules": op9_quality_rules,
    "op10_jaccard_join": op10_jaccard_join,
}

WINDOW_SQL = """
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM t WHERE len(ws) >= 35),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM k) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
f AS (SELECT t.doc_id, len(ws) AS n, list_filter(range(1, len(ws) + 1), lambda p: gone IS NULL OR NOT list_contains(gone, p)) AS kept, ws FROM t LEFT JOIN g ON t.doc_id = g.doc_id)
SELECT doc_id, n::BIGINT AS n_words, (n - len(kept))::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_transform(kept, lambda p: ws[p]), ' '), '')) AS kept_sha256
FROM f
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(s, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""

PASSAGE_SQL = """
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM t WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, hash(array_to_string(ws[i:i + 49], ' ')) AS g, md5(array_to_string(ws[i:i + 49], ' ')) AS m FROM w),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY g, m) AS n, row_number() OVER (PARTITION BY g, m ORDER BY doc_id, i) AS place FROM k),
c AS (SELECT doc_id, p, max(later) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p, (place > 1)::BIGINT AS later FROM r WHERE n > 1) GROUP BY doc_id, p),
s AS (SELECT doc_id, p, gone, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS span FROM c)
SELECT doc_id, (min(p) - 1)::BIGINT AS first_word, count(*)::BIGINT AS n_words, sum(gone)::BIGINT AS n_removed FROM s GROUP BY doc_id, span
"""

JACCARD_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
e AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM t
),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM e),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS m, b.n AS n, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (m + n - c) UNION ALL SELECT b, a FROM p WHERE 100 * c >= 80 * (m + n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.doc_id, len(s)::BIGINT AS n_shingles, least(e.doc_id, coalesce(q.first, e.doc_id)) AS component_id
FROM e LEFT JOIN (SELECT a, min(b) AS first FROM r GROUP BY a) q ON q.a = e.doc_id
"""

QUALITY_SQL = r"""
WITH c AS (SELECT [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05]::DOUBLE[] AS cuts),
t AS (SELECT doc_id, lang, coalesce(text, '') AS x, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i:i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t WHERE len(ws) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1) GROUP BY doc_id),
ln AS (SELECT *, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
m AS (SELECT ln.doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(x, '[^!?|=_~^]', '', 'g')) AS n_marks FROM ln LEFT JOIN r ON r.doc_id = ln.doc_id),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  [CASE WHEN n_words > 0 THEN least(1, n_symbols / n_words::DOUBLE) ELSE 0 END, CASE WHEN word_chars > 0 THEN least(1, n_upper / word_chars::DOUBLE) ELSE 0 END, CASE WHEN n_lines > 0 THEN least(1, n_dup_lines / n_lines::DOUBLE) ELSE 0 END,
   CASE WHEN n_words > 0 THEN least(1, n_repeat_words / n_words::DOUBLE) ELSE 0 END, CASE WHEN n_words > 0 THEN least(1, n_marks / n_words::DOUBLE) ELSE 0 END]::DOUBLE[] AS score FROM m),
l AS (SELECT s.doc_id, lang, good, list_transform(score, lambda v: len(list_filter(cuts, lambda k: v < k))) AS first FROM s, c, (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1) q WHERE q.doc_id = s.doc_id AND NOT base_failed),
st AS (SELECT DISTINCT lang, list_min(list_transform(list_filter([0, 1, 2, 3, 4], lambda i: first[i + 1] < 11), lambda i: first[i + 1] * 5 + i)) AS step FROM l WHERE NOT good AND list_min(first) < 11),
tk AS (SELECT l.doc_id, l.lang, good, min(step) AS taken FROM l LEFT JOIN st ON st.lang IS NOT DISTINCT FROM l.lang AND first[step % 5 + 1] <= step // 5 GROUP BY 1, 2, 3),
tr AS (SELECT st.lang, step, count(*) FILTER (good) AS n, count(*) FILTER (good AND taken <= step) AS k, count(*) FILTER (NOT good AND taken <= step) AS j FROM st JOIN tk ON tk.lang IS NOT DISTINCT FROM st.lang GROUP BY 1, 2),
sf AS (SELECT *, j - 5 * k AS gain, k < 0.02::DOUBLE * n AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02::DOUBLE) + (n - i) * ln(0.98::DOUBLE)))) <= 0.05::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT lang FROM st)) AS safe FROM tr),
fl AS (SELECT lang, min(step) FILTER (NOT safe) AS failed FROM sf GROUP BY 1),
pr AS (SELECT sf.lang, step, gain FROM sf JOIN fl ON fl.lang IS NOT DISTINCT FROM sf.lang WHERE gain > 0 AND (failed IS NULL OR step < failed)),
b AS (SELECT lang, min(step) AS step FROM (SELECT *, max(gain) OVER (PARTITION BY lang) AS top FROM pr) WHERE gain = top GROUP BY 1),
cu AS (SELECT st.lang, st.step % 5 AS rule, min(cuts[st.step // 5 + 1]) AS cutoff FROM st JOIN b ON b.lang IS NOT DISTINCT FROM st.lang AND st.step <= b.step, c GROUP BY 1, 2),
hit AS (SELECT DISTINCT s.doc_id FROM s JOIN cu ON cu.lang IS NOT DISTINCT FROM s.lang AND score[rule + 1] >= cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept FROM s
"""

ORACLES: dict[str, str] = {
    "op8_warc_archives": WARC_SQL,
    "op2_repeated_windows": WINDOW_SQL,
    "op5_suffix_passages": PASSAGE_SQL,
    "op9_quality_rules": QUALITY_SQL,
    "op10_jaccard_join": JACCARD_SQL,
}
