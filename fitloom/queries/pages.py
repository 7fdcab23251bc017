"""Page operators over the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.operators import pages as P
from fitloom.sources.views import table

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return add


#: Faults put into some URLs.
_FAULTS = "CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user@') WHEN 2 THEN 'ftp' || substr(url, 5) WHEN 3 THEN '  ' WHEN 4 THEN regexp_replace(url, '(https?://[^/]*)/', '{0}:8080/') WHEN 5 THEN regexp_replace(url, '(https?://[^/]*)/', '{0}:443/') WHEN 6 THEN replace(url, 'example', 'exa mple') WHEN 7 THEN '/only/a/path' ELSE url END"


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_FAULTS.format("$1")).alias("url"))


@_query(
    rf"""SELECT page_id, lower(regexp_extract(regexp_extract(regexp_replace(u, '^\s+|\s+$', '', 'g'), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^(?:.*@)?([^:]*)', 1)) AS host,
  CASE page_id % 9 WHEN 1 THEN 'URL_INVALID' WHEN 2 THEN 'URL_SCHEME_NOT_ALLOWED' WHEN 3 THEN 'URL_INVALID' WHEN 4 THEN 'URL_BLOCKED' WHEN 6 THEN 'URL_INVALID' WHEN 7 THEN 'URL_INVALID' END AS reason
FROM (SELECT page_id, {_FAULTS.format(chr(92) + "1")} AS u FROM pages)"""
)
def wp01_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.admit(_urls(spark, sf_dir)).select("page_id", "host", "reason")


_IP = "(page_id * 7919) % 256 || '.' || (page_id * 31) % 256 || '.' || (page_id % 4) || '.' || (page_id % 250)"
_KNOWN = "CASE WHEN page_id % 5 = 0 THEN '10.' WHEN page_id % 5 = 1 THEN '198.18.' WHEN page_id % 5 = 2 THEN '172.20.' END || (page_id % 200) || '.1' || CASE WHEN page_id % 5 = 0 THEN '.9' ELSE '' END"


#: IPv6 addresses, and whether they must not be reached.
_V6 = [
    ("2606:4700:4700::1111", False), ("2001:4860:4860:0:0:0:0:8888", False), ("::1", True), ("::", True), ("fe80::1", True), ("FC00::2", True), ("fd12:3456::9", True), ("ff02::1", True), ("fec0::5", True),
    ("::ffff:10.1.2.3", True), ("::ffff:8.8.8.8", False), ("2002:0a00:0001::1", True), ("2002:0808:0808::1", False), ("64:ff9b::192.168.1.1", True), ("64:ff9b::8.8.4.4", False), ("not:an:address", True), ("1::2::3", True),
]


def _in_ranges(number: str) -> str:
    out = []
    for cidr in P.BLOCKED_V4:
        address, bits = cidr.split("/")
        a, b, c, d = map(int, address.split("."))
        low = (a << 24) + (b << 16) + (c << 8) + d
        out.append(f"{number} BETWEEN {low} AND {low + (1 << (32 - int(bits))) - 1}")
    return "(" + " OR ".join(out) + ")"


@_query(
    f"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) || '/' || page_id // 3 AS host FROM pages),
a AS (SELECT page_id, host, CASE WHEN page_id % 10 < 5 AND page_id % 5 < 3 THEN {_KNOWN} ELSE {_IP} END AS ip FROM p),
v6(k, ip, blocked) AS (VALUES {", ".join(f"({i}, '{ip}', {str(b).lower()})" for i, (ip, b) in enumerate(_V6))}),
n AS (SELECT *, split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT AS x FROM a)
SELECT host, bool_or(b) AS blocked FROM (SELECT host, {_in_ranges("x")} AS b FROM n UNION ALL SELECT p.host, v6.blocked FROM p JOIN v6 ON v6.k = p.page_id // 3 % {len(_V6)}) GROUP BY host"""
)
def wp03_host_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WP2, WP3: hosts of three pages, each page with an IPv4 address from its id and one of the known IPv6 addresses."""
    ip = F.expr(f"CASE WHEN page_id % 10 < 5 AND page_id % 5 < 3 THEN {_KNOWN} ELSE {_IP} END")
    k = F.floor(F.col("page_id") / 3)
    v6 = F.element_at(F.array(*[F.lit(a) for a, _ in _V6]), (k % len(_V6) + 1).cast("int"))
    host = F.concat(F.regexp_extract("url", "://([^/]*)", 1), F.lit("/"), k)
    return P.host_verdicts(table(spark, sf_dir, "pages").select(host.alias("host"), F.explode(F.array(ip, v6)).alias("ip")))


@_query(
    """WITH RECURSIVE e AS (SELECT page_id AS f, CASE WHEN page_id % 6 < 4 THEN page_id + 1 END AS t, page_id % 11 <> 0 AS ok FROM pages WHERE page_id + 1 IN (SELECT page_id FROM pages)),
w(page_id, place, hops, reason) AS (SELECT page_id, page_id, 0, NULL::VARCHAR FROM pages
  UNION ALL SELECT w.page_id, CASE WHEN hops < 3 THEN e.t ELSE w.place END, CASE WHEN hops < 3 THEN hops + 1 ELSE 99 END, CASE WHEN hops >= 3 THEN 'URL_TOO_MANY_REDIRECTS' WHEN NOT ok THEN 'URL_BLOCKED' END
  FROM w JOIN e ON e.f = w.place AND e.t IS NOT NULL WHERE w.reason IS NULL AND hops < 99)
SELECT page_id, arg_max(place, hops) AS final_id, arg_max(CASE WHEN hops = 99 THEN 3 ELSE hops END, hops)::INTEGER AS hops, arg_max(coalesce(reason, ''), hops) AS reason FROM w GROUP BY page_id"""
)
def wp04_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains between pages of neighbouring ids."""
    p = table(spark, sf_dir, "pages").select("page_id")
    edges = p.filter("page_id % 6 < 4").join(p.select((F.col("page_id") - 1).alias("page_id")), "page_id", "left_semi")
    edges = edges.select(F.col("page_id").alias("from_url"), (F.col("page_id") + 1).alias("to_url"), (F.col("page_id") % 11 != 0).alias("allowed"))
    found = P.follow_redirects(p.select(F.col("page_id").alias("url")), edges)
    return found.select(F.col("url").alias("page_id"), F.col("final_url").alias("final_id"), "hops", F.coalesce("reason", F.lit("")).alias("reason"))


_LOG = "CASE page_id % 8 WHEN 0 THEN 401 WHEN 1 THEN 429 WHEN 2 THEN 404 WHEN 3 THEN 500 ELSE 200 END AS status, CASE WHEN page_id % 8 = 4 THEN 'application/pdf' ELSE 'Text/HTML; charset=utf-8' END AS content_type, CASE WHEN page_id % 8 = 5 THEN 3000000 ELSE length(html) END AS bytes, CASE WHEN page_id % 8 = 6 THEN 10001 ELSE 50 END AS ms"


@_query(
    """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'URL_LOGIN_REQUIRED' WHEN 1 THEN 'URL_BLOCKED_BY_SITE' WHEN 2 THEN 'URL_FETCH_FAILED' WHEN 3 THEN 'URL_FETCH_FAILED' WHEN 4 THEN 'URL_CONTENT_TYPE_UNSUPPORTED'
  WHEN 5 THEN 'URL_RESPONSE_TOO_LARGE' WHEN 6 THEN 'URL_TIMEOUT' END AS reason FROM pages"""
)
def wp05_fetch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fetch_outcome(table(spark, sf_dir, "pages").selectExpr("page_id", *[x.strip() for x in _LOG.replace(" AS status, ", " AS status|").replace(" AS content_type, ", " AS content_type|").replace(" AS bytes, ", " AS bytes|").split("|")])).select("page_id", "reason")


_BOARD_URL = "CASE page_id % 6 WHEN 0 THEN 'https://boards.greenhouse.io/acme-labs/' || page_id WHEN 1 THEN 'https://jobs.lever.co/' || replace(split_part(split_part(url, '://', 2), '.', 1), 'the', 'The_') || '/1' WHEN 2 THEN 'https://big-co.wd1.myworkdayjobs.com/en/jobs' WHEN 3 THEN 'https://jobs.ashbyhq.com/jobs' WHEN 4 THEN 'https://eu.greenhouse.io/x' ELSE url END"


@_query(
    rf"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'GREENHOUSE' WHEN 1 THEN 'LEVER' WHEN 2 THEN 'WORKDAY' WHEN 3 THEN 'ASHBY' WHEN 4 THEN 'GREENHOUSE' END AS board,
  CASE page_id % 6 WHEN 0 THEN 'Acme Labs' WHEN 1 THEN array_to_string(list_transform(regexp_split_to_array(trim(translate(regexp_extract(u, '//[^/]*/([^/?#]+)', 1), '-_', '  ')), '\s+'), lambda w: upper(w[1]) || w[2:]), ' ')
    WHEN 2 THEN 'Big Co' WHEN 4 THEN 'X' END AS company FROM (SELECT page_id, {_BOARD_URL} AS u FROM pages)"""
)
def wp06_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WP6, WP7: some pages are given the URL of a board."""
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_BOARD_URL} AS url")
    host = P.url_parts(F.col("url"))["host"]
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    board = P.board_of(host)
    return rows.select("page_id", board.alias("board"), P.company_of(host, path, board).alias("company"))


def _clean_sql(html: str) -> str:
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for tag in P.NOISE:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    return out


def _plain_sql(html: str) -> str:
    out = f"regexp_replace({html}, '\\s+', ' ', 'g')"
    for pattern, to in (("(?i)<br\\b[^>]*>", "chr(10)"), ("(?i)<li\\b[^>]*>", "chr(10) || '- '"), (f"(?i)</?({P.BLOCKS}|li)\\b[^>]*>", "chr(10)"), ("<[^>]*>", "''")):
        out = f"regexp_replace({out}, '{pattern}', {to}, 'g')"
    for entity, value in P.ENTITIES:
        value = value.replace("'", "''")
        out = f"replace({out}, '{entity}', '{value}')"
    out = f"regexp_replace(regexp_replace({out}, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


_TEXT = f"""WITH cl AS (SELECT page_id, html, {_clean_sql("html")} AS h FROM pages),
ar AS (SELECT *, regexp_extract(h, '(?is)<article\\b[^>]*>(.*)</article\\s*>', 1) AS a, regexp_extract(h, '(?is)<body\\b[^>]*>(.*)</body\\s*>', 1) AS b FROM cl),
tx AS (SELECT page_id, html, CASE WHEN length({_plain_sql("a")}) > 200 THEN {_plain_sql("a")} WHEN b <> '' THEN {_plain_sql("b")} ELSE {_plain_sql("h")} END AS text FROM ar) """


@_query(_TEXT + "SELECT page_id, text, 'GENERIC_HTML' AS strategy FROM tx")
def wp10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WP8-WP10, WP13, IO2."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", "html").withColumn("board_text", F.lit(None).cast("string"))
    return P.extract(rows).select("page_id", "text", "strategy")


@_query(
    """SELECT page_id, 'Role ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'Town, R (Remote)' ELSE 'Town, R' END AS location, 'Full time, Contract' AS employment_type,
  CASE WHEN page_id % 3 = 0 THEN 'CAD 10 - 20 per hour' ELSE 'CAD 15 per hour' END AS compensation FROM pages WHERE page_id % 4 <> 3"""
)
def wp11_structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WP11, WP12: pages with a posting put into their markup as an object, a graph or an array's second element; one in four is malformed."""
    pay = F.when(F.col("page_id") % 3 == 0, '"minValue":10,"maxValue":20').otherwise('"value":15')
    item = F.concat(
        F.lit('{"@type":["Thing","JobPosting"],"title":" Role '), F.col("page_id"), F.lit('","employmentType":["FULL_TIME","CONTRACT"],"jobLocation":[{"address":{"addressLocality":"Town","addressRegion":"R"}}],'),
        F.when(F.col("page_id") % 2 == 0, '"jobLocationType":"TELECOMMUTE",').otherwise(""), F.lit('"baseSalary":{"currency":"CAD","value":{'), pay, F.lit(',"unitText":"HOUR"}}}'),
    )
    k = F.col("page_id") % 4
    block = F.when(k == 0, item).when(k == 1, F.concat(F.lit('{"@graph":['), item, F.lit("]}"))).when(k == 2, F.concat(F.lit('[{"@type":"Organization"},'), item, F.lit("]"))).otherwise(F.concat(F.lit("{"), item))
    html = F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script>"), "html")
    json = P.posting_fields(P.structured_posting(html))
    rows = table(spark, sf_dir, "pages").select("page_id", *[json[c].alias(c) for c in ("title", "location", "employment_type", "compensation")])
    return rows.filter("title is not null")


@_query(
    _TEXT
    + """, z AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'BOT_CHECK' WHEN 1 THEN 'LOGIN_WALL' WHEN 2 THEN 'JAVASCRIPT_REQUIRED' WHEN 3 THEN 'LOGIN_WALL' ELSE 'READABLE' END AS access, CASE WHEN page_id % 6 < 5 THEN 0 ELSE length(text) END AS n FROM tx)
SELECT page_id, access, CASE access WHEN 'BOT_CHECK' THEN 'URL_BLOCKED_BY_SITE' WHEN 'LOGIN_WALL' THEN 'URL_LOGIN_REQUIRED' WHEN 'JAVASCRIPT_REQUIRED' THEN 'URL_JAVASCRIPT_REQUIRED' ELSE CASE WHEN n < 200 THEN 'POSTING_TEXT_TOO_SHORT' WHEN n > 40000 THEN 'POSTING_TEXT_TOO_LONG' END END AS reason FROM z"""
)
def wp14_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WP14, WP15: five of six pages are replaced by walls and shells."""
    k = F.col("page_id") % 6
    html = (
        F.when(k == 0, F.concat(F.lit("<title>Just a moment "), "page_id", F.lit("</title>"), "html")).when(k == 1, '<title>Site</title><body><input type="password"></body>')
        .when(k == 2, '<body><div id="root"> </div></body>').when(k == 3, "<body>Please sign in</body>").when(k == 4, "<body>Nothing here</body>").otherwise(F.col("html"))
    )
    rows = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    rows = rows.withColumn("text", F.when(F.col("page_id") % 6 < 5, "").otherwise(P.plain_text(P.content(P.without_noise(F.col("html"))))))
    return P.readability_gate(rows.withColumn("access", P.access(F.col("html"), F.col("text")))).select("page_id", "access", "reason")
