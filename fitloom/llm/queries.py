"""The queries opN_<name> over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.llm import centroids, chat, decontaminate, infill, jaccard, language, mixing, quality, secretscan, substrings, tokencount, urlfilter, warc
from fitloom.plans.scratch import Scratch

QUERIES: dict = {}
ORACLES: dict = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query
def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    path = f"{Scratch(spark, 'warc').path}/pages"
    warc.page_records(_read(spark, sf_dir, "pages").select("page_id", "url", "html")).write.format("warc").mode("append").save(path)
    records = warc.read(spark, path, "warc_type string, record_id string, refers_to string, payload_digest string, payload_length bigint, payload binary")
    records = records.filter(F.col("warc_type").isin("response", "revisit"))
    page = lambda urn: F.regexp_extract(urn, "(-?[0-9]+)>$", 1).try_cast("bigint")
    # A response is measured by its payload; a revisit has only its headers.
    own = F.col("warc_type") == "response"
    return records.select(
        page(F.col("record_id")).alias("page_id"),
        F.when(own, F.length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page(F.col("refers_to")).alias("refers_to"),
    )


#: The rules that the query is asked to apply: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@_query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the canonical URLs of pages whose path names a document that is labelled toxic."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    toxic = _read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    named = F.regexp_extract(urlfilter.path_of(F.col("url")), "/([0-9]+)", 1).try_cast("bigint")
    urls = pages.select(urlfilter.canonical(F.col("url")).alias("canonical"), named.alias("doc_id")).join(toxic, "doc_id", "left_semi").select("canonical")
    return urlfilter.judge(pages, urls, RULES).select("page_id", "host", "path", "rule", "verdict")


@_query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of 100 words or more has twice the chance of a shorter one."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, weight=lambda size: F.when(size >= 100, 2.0).otherwise(1.0)).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out))
    found = language.identify(docs.select("doc_id", "text"), model, spans=False)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


@_query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op6_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    found = tokencount.token_counts(docs, vocabulary())
    return found.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@_query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    control = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.windows(turns.unionByName(control), vocabulary()))


@_query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_read(spark, sf_dir, "documents").select("doc_id", "text"), k=3, num=90, den=100)


@_query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    r = F.col("repetition")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.repetition(docs).select("doc_id", *[r[n].alias(n) for n in names])


ORACLES["op1_warc_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""

ORACLES["op3_url_filter"] = r"""
WITH u0 AS (SELECT page_id, url, coalesce(strpos(url, '://'), 0) AS sep FROM pages),
u1 AS (SELECT page_id, url, CASE WHEN sep > 0 THEN substr(url, sep + 3) ELSE '' END AS rest FROM u0),
u AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|ref)='))), '&') AS q FROM u1),
k AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') ||
  CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM u),
l AS (SELECT DISTINCT canonical FROM k JOIN labels t ON t.toxic = 1 AND t.doc_id = try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT) WHERE canonical IS NOT NULL),
r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b AS (SELECT k.page_id, k.host AS h, k.path AS p, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS said
  FROM (SELECT DISTINCT page_id, host, path FROM k) k JOIN r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path) GROUP BY ALL)
SELECT k.page_id, k.host, k.path, b.rule, coalesce(b.said, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN b ON b.page_id = k.page_id AND b.h = k.host AND b.p = k.path LEFT JOIN l ON l.canonical = k.canonical
"""

@_query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2("dedup.kept", 256).alias("kept_sha256"))


ORACLES["op8_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct([array_to_string(list_slice(ws, i, i + 2), ' ') FOR i IN range(1, len(ws) - 1)]) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS x FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * x >= 90 * (n + m - x)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY ALL
"""

ORACLES["op10_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM w),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE first < doc_id),
k AS (SELECT d.doc_id, string_agg(x.w, ' ' ORDER BY x.p) AS kept, count(*) AS n
  FROM d, (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d) x LEFT JOIN r ON r.doc_id = x.doc_id AND r.p = x.p
  WHERE x.doc_id = d.doc_id AND r.p IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

ORACLES["op2_mix_sources"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
s1 AS (SELECT *, 3 * source_size AS lim,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM s0 WINDOW b AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, lim / w < level AS isfull FROM s1),
s AS (SELECT source, source_size,
    CASE WHEN isfull THEN lim::DOUBLE ELSE least(lim::DOUBLE, w * (SELECT arg_min(level, lim / w) FROM s2 WHERE NOT isfull)) END AS target FROM s2),
v0 AS (SELECT d.source, w, sum(d.size) AS words, max(target) AS target FROM (SELECT *, CASE WHEN size >= 100 THEN 2 ELSE 1 END AS w FROM d WHERE size > 0) d JOIN s ON d.source IS NOT DISTINCT FROM s.source GROUP BY d.source, w),
v1 AS (SELECT *, (target - 3 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w * words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS scale FROM v0),
v AS (SELECT source, coalesce(arg_max(scale, w) FILTER (WHERE scale * w <= 3), 1e300) AS scale FROM v1 GROUP BY source),
e AS (SELECT d.*, source_size, target, CASE WHEN size > 0 THEN least(scale * (CASE WHEN size >= 100 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END), 3.0::DOUBLE) ELSE 0 END AS x
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN v ON d.source IS NOT DISTINCT FROM v.source),
f AS (SELECT *, floor(x)::BIGINT AS certain, x - floor(x) AS p FROM e),
g AS (SELECT *, CASE WHEN size > 0 AND certain < 3 THEN CASE WHEN p > 0 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) ELSE 1 + u END END AS q FROM f),
h AS (SELECT *, target - sum(certain * size) OVER (PARTITION BY source) AS need,
    CASE WHEN q IS NOT NULL THEN sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, u, doc_id, size ROWS UNBOUNDED PRECEDING) END AS run FROM g),
i AS (SELECT *, q IS NOT NULL AND need > 0 AND run <= need AS drawn FROM h),
i1 AS (SELECT *, need - coalesce(sum(CASE WHEN drawn THEN size END) OVER (PARTITION BY source), 0) AS gap FROM i),
i2 AS (SELECT *, q IS NOT NULL AND NOT drawn AND gap > 0 AND size <= gap AS able FROM i1),
i3 AS (SELECT *, CASE WHEN able THEN sum(size) OVER (PARTITION BY source, able ORDER BY q, u, doc_id, size ROWS UNBOUNDED PRECEDING) <= gap ELSE false END AS drawn2 FROM i2),
j AS (SELECT *, gap - coalesce(sum(CASE WHEN drawn2 THEN size END) OVER (PARTITION BY source), 0) AS gap2 FROM i3),
k AS (SELECT *, floor(log2(size))::INTEGER AS class FROM j WHERE q IS NOT NULL AND NOT drawn AND NOT drawn2 AND gap2 > 0 AND size < 2 * gap2 QUALIFY row_number() OVER (PARTITION BY source, class ORDER BY q, u, doc_id, size) <= 16),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class DESC, q, u, doc_id, size) AS n FROM k),
fold(source, n, gap, took) AS (
  SELECT DISTINCT source, 0::BIGINT, gap2, false FROM c UNION ALL
  SELECT c.source, c.n, fold.gap - CASE WHEN c.size <= fold.gap THEN c.size ELSE 0 END, c.size <= fold.gap FROM fold JOIN c ON c.source IS NOT DISTINCT FROM fold.source AND c.n = fold.n + 1),
z AS (SELECT c.*, fold.took, min(fold.gap) OVER (PARTITION BY c.source) AS last FROM c JOIN fold ON c.source IS NOT DISTINCT FROM fold.source AND c.n = fold.n),
y AS (SELECT doc_id, size, took OR row_number() OVER (PARTITION BY source, took OR abs(size - last) >= last ORDER BY abs(size - last), q, u, doc_id, size) = 1 AND abs(size - last) < last AS fills FROM z)
SELECT j.doc_id, j.size, source_size, target, ((certain + CASE WHEN drawn OR drawn2 OR coalesce(y.fills, false) THEN 1 ELSE 0 END) * j.size)::BIGINT AS taken FROM j LEFT JOIN y ON y.doc_id = j.doc_id
"""

ORACLES["op5_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
k AS (SELECT item_id, ws, least(len(ws), 10) AS w FROM t WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, w, array_to_string(list_slice(ws, i, i + w - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - w + 2)) AS i FROM k)),
dw AS (SELECT doc_id, i, w, array_to_string(list_slice(ws, i, i + w - 1), ' ') AS g
  FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT w FROM k) WHERE len(ws) >= w)),
m AS (SELECT dw.doc_id, dw.i, dw.w, win.item_id FROM dw JOIN win ON win.g = dw.g AND win.w = dw.w),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + w)) AS p FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items,
  sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""

_GRAMS = "\n".join(
    f"""g{n} AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM (
    SELECT doc_id, unnest(range(1, len(ws) - {n - 2})) AS i, list_slice(ws, unnest(range(1, len(ws) - {n - 2})), unnest(range(1, len(ws) - {n - 2})) + {n - 1}) AS g FROM d WHERE len(ws) >= {n})),
c{n} AS (
  SELECT w.doc_id, sum(length(w.w)) AS size, count(*) AS words FROM w
  JOIN (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM g{n} WHERE again) x ON x.doc_id = w.doc_id AND x.i = w.i GROUP BY w.doc_id),"""
    for n in sorted(quality.MAX_COVERAGE)
)
ORACLES["op9_quality_rules"] = (
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
b AS (SELECT doc_id, sum(length(w)) AS chars FROM w GROUP BY doc_id),
l0 AS (SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS size
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l1 AS (SELECT doc_id, count(*) - 1 AS n, (count(*) - 1) * min(size) AS size FROM l0 GROUP BY doc_id, line),
l AS (SELECT doc_id, sum(n) AS n, sum(size) AS size FROM l1 GROUP BY doc_id),
"""
    + _GRAMS
    + r"""
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(b.chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c8.words, 0)::BIGINT AS n_repeat_words,
    coalesce(l.size, 0) / greatest(coalesce(b.chars, 0), 1) AS lines"""
    + "".join(f", coalesce(c{n}.size, 0) / greatest(coalesce(b.chars, 0), 1) AS s{n}" for n in sorted(quality.MAX_COVERAGE))
    + " FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id "
    + " ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = d.doc_id" for n in sorted(quality.MAX_COVERAGE))
    + f""")
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (lines > {quality.MAX_LINE_COVERAGE} OR n_symbols > {quality.MAX_SYMBOLS}::DOUBLE * word_chars"""
    + "".join(f" OR s{n} > {x}" for n, x in sorted(quality.MAX_COVERAGE.items()))
    + f""") AS kept
FROM (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
"""
)


@_query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random spans come from the vocabulary's token counts, so no SQL is given; tests hold the query to a plain version."""
    import public_tokenizers

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secretscan.scan(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(count, secretscan.KINDS), F.sha2(secretscan.joined(base), 256).alias("base_sha256"), secretscan.joined(F.col("secrets")).alias("spans"))


@_query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    f = F.col("fim")
    restored = infill.restored(f["output"], f["form"])
    return infill.transform(docs, seed=7, percent=100, spm_percent=50).select(
        "doc_id", *[f[n].alias(n) for n in ("n", "form", "prefix_chars", "middle_chars")], F.sha2(f["output"], 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")
    )


@_query
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clusters(_read(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed=2)
    return found.withColumn("centroid_sha256", centroids.digest(F.col("centroid"))).drop("centroid")


ORACLES["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(x, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(x, 9, 8))::BIGINT % (len(u) + 1) AS b,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || substr(x, 17, 8))::BIGINT % 100 >= 100 THEN 'plain' WHEN ('0x' || substr(x, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1:n], '') AS suf FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

_ROUND = """
a{r} AS MATERIALIZED (SELECT vec_id, v, min((vv - 2 * list_inner_product(v, c) + cc)::BIGINT * 64 + k) AS m FROM v, c{r} GROUP BY vec_id, v),
s{r} AS MATERIALIZED (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT m % 64 AS k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY k, i),
c{n} AS MATERIALIZED (SELECT c.k, coalesce(u.c, c.c) AS c, list_inner_product(coalesce(u.c, c.c), coalesce(u.c, c.c)) AS cc FROM c{r} c
  LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM s{r} GROUP BY k) u ON u.k = c.k),"""
ORACLES["op13_centroid_clusters"] = (
    """
WITH v AS MATERIALIZED (SELECT vec_id, v, list_inner_product(v, v) AS vv FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, v AS c, vv AS cc FROM v QUALIFY k < 40),"""
    + "".join(_ROUND.format(r=r, n=r + 1) for r in range(5))
    + """
f AS (SELECT vec_id, (m % 64)::INTEGER AS cluster, m // 64 AS distance FROM (SELECT vec_id, min((vv - 2 * list_inner_product(v, c) + cc)::BIGINT * 64 + k) AS m FROM v, c5 GROUP BY vec_id))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM f JOIN c5 ON c5.k = f.cluster
"""
)
