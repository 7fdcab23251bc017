"""Fetched pages: URL admission, address classes, redirects, fetch outcomes, boards, content, structured data, access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions import text as T

# Blocked IPv4 ranges.
BLOCKED_V4 = [
    "0.0.0.0/32", "127.0.0.0/8", "169.254.0.0/16", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "100.64.0.0/10", "192.0.0.0/24",
    "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "169.254.169.254/32", "169.254.170.2/32", "100.100.100.200/32",
]
# Blocked IPv6 prefixes, as hexadecimal digits: unspecified, loopback, link-local, site-local, multicast, unique local.
BLOCKED_V6 = ["0" * 32, "0" * 31 + "1", "fe8", "fe9", "fea", "feb", "fec", "fed", "fee", "fef", "ff", "fc", "fd"]
# What stands before an IPv4 address in an IPv6 one, and after: mapped, 6to4, NAT64.
EMBEDDED_V4 = [("0" * 20 + "ffff", ""), ("2002", "." * 20), ("0064ff9b", "")]
# Board, hosts (with a dot: and all below it).
BOARDS = [
    ("GREENHOUSE", ["boards.greenhouse.io", "job-boards.greenhouse.io", ".greenhouse.io"]),
    ("LEVER", ["jobs.lever.co", "jobs.eu.lever.co"]),
    ("ASHBY", ["jobs.ashbyhq.com"]),
    ("WORKDAY", [".myworkdayjobs.com", ".myworkdaysite.com"]),
]
# Content types that are read, elements that are left out, and elements that break lines.
CONTENT_TYPES = ["text/html", "application/xhtml+xml", "text/plain"]
NOISE = ["script", "style", "noscript", "iframe", "svg", "template", "nav", "header", "footer", "aside", "form"]
BLOCKS = "p|div|h[1-6]|ul|ol|section|article|main|body|html|table|tr|blockquote|pre|dl|dt|dd|hr|address|figure|figcaption|header|footer|fieldset|form|nav|aside|head|title"
# Entities and what they stand for; the ampersand comes last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]
# Titles and phrases of pages that ask for a human.
BOT_TITLES = [
    "just a moment", "attention required", "access denied", "access to this page has been denied", "are you a robot", "are you a human", "verify you are human",
    "security check", "checking your browser", "captcha", "unusual traffic", "request blocked", "bot verification", "pardon our interruption", "human verification",
]
BOT_PHRASES = [
    "enable javascript and cookies to continue", "verify you are a human", "verifying you are human", "complete the security check",
    "unusual traffic from your", "your request has been blocked", "detected unusual activity", "please enable cookies", "ray id",
]
# Titles and phrases of pages that ask for a login.
LOGIN_TITLES = ["sign in", "log in", "login", "signin", "authentication required"]
LOGIN_PHRASES = ["sign in to continue", "log in to continue", "sign in to view", "log in to view", "please sign in", "please log in", "you must be signed in", "create an account to view"]
USABLE, MAX_BYTES, MAX_MS, MAX_HOPS = 200, 2 << 20, 10_000, 3


def any_of(c: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | c.contains(needle)
    return found


def url_parts(url: Column) -> dict[str, Column]:
    """Scheme, authority, host and port of an absolute URL; empty where there is none."""
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return {
        "scheme": F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)),
        "authority": authority,
        "host": F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1),
        "port": F.regexp_extract(authority, r":(\d+)$", 1),
    }


def admit(urls: DataFrame, ports: tuple[str, ...] = ("80", "443")) -> DataFrame:
    """``urls`` (url) with host and reason, the first rule that fails."""
    url = T.strip(F.coalesce("url", F.lit("")))
    p = url_parts(url)
    reason = (
        F.when((url == "") | url.rlike(r"[\s<>\"{}|\\^`]") | url.rlike("%(?![0-9A-Fa-f]{2})") | (p["scheme"] == ""), "URL_INVALID")
        .when(~p["scheme"].isin("http", "https"), "URL_SCHEME_NOT_ALLOWED")
        .when((p["authority"] == "") | p["authority"].contains("@"), "URL_INVALID")
        .when((p["host"] == "") | ~p["host"].rlike(r"^(\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9]([A-Za-z0-9.-]*[A-Za-z0-9])?\.?)$"), "URL_INVALID")
        .when((p["port"] != "") & ~p["port"].isin(*ports), "URL_BLOCKED")
    )
    return urls.withColumn("host", F.lower(p["host"])).withColumn("reason", reason)


def ip_number(ip: Column) -> Column:
    """The number of a dotted IPv4 address; null for anything else."""
    parts = F.split(ip, r"\.")
    number = sum((F.get(parts, i).try_cast("bigint") * (1 << 8 * (3 - i)) for i in range(1, 4)), F.get(parts, 0).try_cast("bigint") * (1 << 24))
    return F.when(ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), number)


def _v4_blocked(number: Column) -> Column:
    found = F.lit(False)
    for cidr in BLOCKED_V4:
        address, bits = cidr.split("/")
        a, b, c, d = map(int, address.split("."))
        low = (a << 24) + (b << 16) + (c << 8) + d
        found = found | number.between(low, low + (1 << (32 - int(bits))) - 1)
    return found


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that stands in the plan once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def ipv6_digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, also one with :: or with an IPv4 address as its end; null for anything else."""
    groups = lambda c: F.filter(F.split(c, ":"), lambda g: g != "")
    hex4 = lambda n: F.lower(F.lpad(F.hex(n), 4, "0"))
    none = F.array().cast("array<string>")

    def digits(text: Column, head: Column, rest: Column, short: Column) -> Column:
        n = F.size(head) + F.size(rest)
        whole = text.rlike(r"^(?!.*::.*::)(?:[0-9a-f]{1,4}(?::|$)|:){1,9}$") & text.contains(":") & F.when(short, n < 8).otherwise(n == 8)
        every = F.concat(head, F.array_repeat(F.lit("0"), F.lit(8) - n), rest)
        return F.when(whole, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    def parted(text: Column) -> Column:
        before, behind = F.substring_index(text, "::", 1), F.substr(text, F.instr(text, "::") + 2)
        short = text.contains("::")
        return _let(groups(before), lambda head: _let(F.when(short, groups(behind)).otherwise(none), lambda rest: digits(text, head, rest, short)))

    def spelled(tail: Column) -> Column:
        words = _let(ip_number(tail), lambda n: F.concat(F.substr(ip, F.lit(1), F.length(ip) - F.length(tail)), hex4(F.shiftright(n, 16)), F.lit(":"), hex4(n.bitwiseAND(F.lit(0xFFFF)))))
        return _let(F.lower(F.when(tail == "", ip).otherwise(words)), parted)

    return F.when(ip.contains(":"), _let(F.regexp_extract(ip, r":([0-9]+(?:\.[0-9]+){3})$", 1), spelled))


def blocked_address(ip: Column) -> Column:
    """Whether an address (as text) must not be reached; an IPv4 address inside an IPv6 one is judged as such."""

    def of_v6(digits: Column) -> Column:
        listed, inner = F.lit(False), F.lit(None).cast("string")
        for prefix in BLOCKED_V6:
            listed = listed | digits.startswith(prefix)
        for prefix, rest in EMBEDDED_V4:
            inner = F.when(digits.startswith(prefix), F.regexp_extract(digits, f"^{prefix}{'.*' if not rest else ''}([0-9a-f]{{8}}){rest}$", 1)).otherwise(inner)
        return _let(inner, lambda v4: F.when(v4.isNull(), listed).otherwise(_let(F.conv(v4, 16, 10).try_cast("bigint"), _v4_blocked)))

    return F.when(ip.contains(":"), F.coalesce(_let(ipv6_digits(ip), of_v6), F.lit(True))).otherwise(F.coalesce(_let(ip_number(ip), _v4_blocked), F.lit(True)))


def host_verdicts(host_ip: DataFrame) -> DataFrame:
    """host, blocked: any of its addresses is, or it has none. host_ip: host, ip (as text)."""
    ip = F.col("ip")
    return host_ip.groupBy("host").agg(F.coalesce(F.bool_or(F.when(ip.isNotNull(), blocked_address(ip))), F.lit(True)).alias("blocked"))


def follow_redirects(starts: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """url, final_url, hops, reason. edges: from_url, to_url, allowed; one per from_url."""
    one = edges.dropDuplicates(["from_url"])
    rows = starts.select("url", F.col("url").alias("at"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("reason"))
    for hop in range(1, max_hops + 2):
        e = one.select(F.col("from_url").alias("at"), "to_url", "allowed")
        rows = rows.join(e, "at", "left")
        go = F.col("to_url").isNotNull() & F.col("reason").isNull()
        stop = F.when(F.lit(hop > max_hops), "URL_TOO_MANY_REDIRECTS").when(~F.col("allowed"), "URL_BLOCKED")
        rows = rows.select("url", F.when(go & F.lit(hop <= max_hops), F.col("to_url")).otherwise(F.col("at")).alias("at"), (F.col("hops") + (go & F.lit(hop <= max_hops)).cast("int")).alias("hops"), F.when(go, stop).otherwise(F.col("reason")).alias("reason"))
    return rows.withColumnRenamed("at", "final_url")


def fetch_outcome(log: DataFrame) -> DataFrame:
    """``log`` (status, content_type, bytes, ms) with reason, null if the page can be used."""
    s = F.col("status")
    mime = F.lower(T.strip(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    reason = (
        F.when(F.col("ms") > MAX_MS, "URL_TIMEOUT").when(s.isin(401, 407), "URL_LOGIN_REQUIRED").when(s.isin(403, 429), "URL_BLOCKED_BY_SITE").when(~s.between(200, 299), "URL_FETCH_FAILED")
        .when(~mime.isin(CONTENT_TYPES), "URL_CONTENT_TYPE_UNSUPPORTED").when(F.col("bytes") > MAX_BYTES, "URL_RESPONSE_TOO_LARGE")
    )
    return log.withColumn("reason", reason)


def board_of(host: Column) -> Column:
    found = None
    for name, hosts in BOARDS:
        fits = F.lit(False)
        for h in hosts:
            fits = fits | (host.endswith(h) if h.startswith(".") else host == h)
        found = F.when(fits, name) if found is None else found.when(fits, name)
    return found


def company_of(host: Column, path: Column, board: Column) -> Column:
    """The employer that a board's URL names, in words with capitals."""
    words = lambda slug: F.array_join(F.transform(F.split(T.strip(F.translate(slug, "-_", "  ")), r"\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))), " ")
    slug = F.regexp_extract(path, "^/([^/?#]+)", 1)
    sub = F.when(host.contains("."), F.substring_index(host, ".", 1))
    return F.when(board == "WORKDAY", F.when(sub != "", words(sub))).when(board.isNotNull() & (slug != "") & (slug != "jobs"), words(slug))


def without_noise(html: Column) -> Column:
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in NOISE:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    return html


def plain_text(html: Column) -> Column:
    """Text with items as ``- `` lines and a line for each block; markup and entities resolved, blanks collapsed."""
    text = F.regexp_replace(html, r"\s+", " ")
    text = F.regexp_replace(text, r"(?i)<br\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?i)<li\b[^>]*>", "\n- ")
    text = F.regexp_replace(text, rf"(?i)</?({BLOCKS}|li)\b[^>]*>", "\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    for entity, value in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(value))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" *\n *", "\n")
    return T.strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def content(html: Column) -> Column:
    """The most specific container with more than 200 characters of text, else the body, else all of it."""
    inner = lambda tag: F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1)
    enough = lambda tag: F.when(F.length(plain_text(inner(tag))) > 200, inner(tag))
    body = inner("body")
    return F.coalesce(enough("article"), enough("main"), F.when(body != "", body), html)


def structured_posting(html: Column) -> Column:
    """The first job posting among the ld+json blocks (an object, an array's element or a graph's), as JSON text."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"), F.lit(1))
    items = F.flatten(F.transform(F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull()), _items))
    return F.get(F.filter(items, _is_posting), 0)


def _items(block: Column) -> Column:
    listed = lambda json: F.from_json(json, "array<string>")
    graph = F.get_json_object(block, "$.@graph")
    block = F.trim(block)
    return (
        F.when(block.startswith("["), F.coalesce(listed(block), F.array().cast("array<string>")))
        .when(graph.startswith("["), F.coalesce(listed(graph), F.array().cast("array<string>")))
        .when(graph.isNotNull(), F.array(graph))
        .otherwise(F.array(block))
    )


def _is_posting(item: Column) -> Column:
    kind = F.lower(F.coalesce(F.get_json_object(item, "$.@type"), F.lit("")))
    return kind.rlike(r'jobposting$|jobposting"')


def posting_fields(json: Column) -> dict[str, Column]:
    """Title, company, location, employment type, compensation and description of a structured posting."""
    at = lambda path: F.nullif(T.strip(F.get_json_object(json, f"$.{path}")), F.lit(""))
    place = lambda f: F.coalesce(at(f"jobLocation.address.{f}"), at(f"jobLocation[0].address.{f}"))
    joined = F.array_join(F.array_compact(F.array(*map(place, ("addressLocality", "addressRegion", "addressCountry")))), ", ")
    remote = F.lower(F.coalesce(at("jobLocationType"), F.lit(""))).contains("telecommute")
    readable = lambda v: F.concat(F.upper(F.substring(v, 1, 1)), F.lower(F.substring(F.translate(v, "_", " "), 2, 1000)))
    kind = at("employmentType")
    kinds = F.when(kind.startswith("["), F.array_join(F.transform(F.from_json(kind, "array<string>"), readable), ", ")).otherwise(readable(kind))
    low, high, single, unit = (at(f"baseSalary.value.{f}") for f in ("minValue", "maxValue", "value", "unitText"))
    amount = F.coalesce(F.concat(low, F.lit(" - "), high), single)
    pay = F.when(at("baseSalary.value").isNull(), at("baseSalary.name")).otherwise(T.strip(F.concat(F.coalesce(F.concat(at("baseSalary.currency"), F.lit(" ")), F.lit("")), amount, F.coalesce(F.concat(F.lit(" per "), F.lower(unit)), F.lit("")))))
    return {
        "title": at("title"),
        "company": at("hiringOrganization.name"),
        "location": F.when(remote, F.when(joined == "", "Remote").otherwise(F.concat(joined, F.lit(" (Remote)")))).otherwise(F.nullif(joined, F.lit(""))),
        "employment_type": kinds,
        "compensation": pay,
        "description": F.when(at("description").isNotNull(), plain_text(at("description"))),
    }


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html, board_text) with text and strategy: a board's own text, structured data, or the generic reading."""
    board = board_of(url_parts(F.col("url"))["host"])
    own = F.when(board.isNotNull() & (F.length(T.strip(F.coalesce("board_text", F.lit("")))) >= USABLE), F.col("board_text"))
    data = F.nullif(posting_fields(structured_posting(F.col("html")))["description"], F.lit(""))
    generic = plain_text(content(without_noise(F.col("html"))))
    return pages.withColumn("text", F.coalesce(own, data, generic)).withColumn("strategy", F.when(own.isNotNull(), F.concat(F.lit("ATS_"), board)).when(data.isNotNull(), "JSON_LD").otherwise("GENERIC_HTML"))


def access(html: Column, text: Column) -> Column:
    title = F.lower(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1))
    body = F.lower(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", ""), "<[^>]*>", " "))
    shell = html.rlike(r"(?is)<[a-z]+[^>]*(id=[\"']?(root|app|__next)[\"' >]|data-reactroot|ng-app)[^>]*>\s*</")
    scripts = (F.regexp_count(html, F.lit("(?i)<script")) >= 3) & (F.length(T.strip(F.regexp_replace(body, r"\s+", " "))) < 200)
    return (
        F.when(any_of(title, BOT_TITLES), "BOT_CHECK")
        .when(F.length(text) >= USABLE, "READABLE")
        .when(any_of(body, BOT_PHRASES), "BOT_CHECK")
        .when(any_of(title, LOGIN_TITLES) | any_of(body, LOGIN_PHRASES) | html.rlike(r"(?i)<input[^>]*type=[\"']?password"), "LOGIN_WALL")
        .when(shell | scripts, "JAVASCRIPT_REQUIRED")
        .otherwise("READABLE")
    )


def readability_gate(rows: DataFrame) -> DataFrame:
    """``rows`` (access, text) with reason: why a page can't be used, else the length gate of postings."""
    n = F.length(T.strip(F.coalesce("text", F.lit(""))))
    said = F.when(F.col("access") == "BOT_CHECK", "URL_BLOCKED_BY_SITE").when(F.col("access") == "LOGIN_WALL", "URL_LOGIN_REQUIRED").when(F.col("access") == "JAVASCRIPT_REQUIRED", "URL_JAVASCRIPT_REQUIRED")
    return rows.withColumn("reason", F.coalesce(said, F.when(n < 200, "POSTING_TEXT_TOO_SHORT").when(n > 40_000, "POSTING_TEXT_TOO_LONG")))
