"""Metadata and plain-text conversion records derived from WARC responses (operator 2), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns that Java and RE2 read alike. Blocks without text, tags that end a line, other tags.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAKS = (
    r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|article|section|header|footer|nav|br|hr|title|head|body|html"
    r"|main|aside|blockquote|pre|form|option)\b[^>]*>"
)
TAGS = r"<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
BLANKS = r"[ \t\r\f]+"
LINES = r" ?\n[ \n]*"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LINK = r'<a href="([^"]*)"'  # the SQL's, which knows this form only
# An anchor's href in any case, after any attributes, in double, single or no quotes; or a block without text, then group 1 is empty.
VALUE = r"""(?:"[^"]*"|'[^']*'|[^ \t\r\n\f"'>][^ \t\r\n\f>]*)"""
ATTRIBUTE = r"[ \t\r\n\f/]*(?!href[ \t\r\n\f=>/])[^ \t\r\n\f>/][^ \t\r\n\f=>/]*(?:[ \t\r\n\f]*=[ \t\r\n\f]*" + VALUE + ")?"
ANCHOR = r"(?=<)(?:" + HIDDEN + r"|<a(?=[ \t\r\n\f/])(?:" + ATTRIBUTE + r")*+[ \t\r\n\f/]*href[ \t\r\n\f]*=[ \t\r\n\f]*(" + VALUE + "))"


def record_id(kind: str, *parts: Column) -> Column:
    """A urn:uuid made from the kind and the parts, equal in every run."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame) -> DataFrame:
    """Response records (page_id, record_id, target_uri, headers, payload) of crawled ``pages`` (page_id, url, html).

    Null urls and bodies are empty. Pages equal in id and url get equal record ids.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    headers = F.concat(
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string")
    )
    identity = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return pages.select(
        "page_id",
        record_id("response", identity, url).alias("record_id"),
        url.alias("target_uri"),
        headers.alias("headers"),
        html.alias("payload"),
    )


def plain_text(html: Column) -> Column:
    """The visible text: a line per block element, blanks collapsed, five named and one numbered entity decoded."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BREAKS, "\n"), TAGS, "")
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    text = F.regexp_replace(F.regexp_replace(text, BLANKS, " "), LINES, "\n")
    return F.trim(text, F.lit(" \n"))


def outlinks(html: Column) -> Column:
    """The targets of all anchors in order of appearance, without those in scripts, styles and comments."""
    found = F.filter(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)), lambda x: x != "")
    return F.transform(found, lambda x: F.when(F.left(x, F.lit(1)).isin('"', "'"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))


def derivatives(records: DataFrame) -> DataFrame:
    """Two records per response (page_id, record_id, target_uri, headers, payload): metadata, and conversion to text.

    Columns: page_id, warc_type, record_id, refers_to, target_uri, source_digest, block_digest, content_type,
    content_length, content. ``refers_to`` is the response's record id, ``source_digest`` that of its payload; the
    metadata hold the response's headers, title and links in order of appearance. Empty payloads give records with empty
    text; repeated responses repeat their records; no partition exchanges any row; other columns are ignored.
    """
    rows = records.select(
        "page_id",
        F.col("record_id").alias("refers_to"),
        "target_uri",
        digest(F.col("payload")).alias("source_digest"),
        F.regexp_replace(F.trim(F.regexp_extract("payload", TITLE, 1), F.lit(" \n")), r"[ \t\r\n\f]+", " ").alias("title"),
        outlinks(F.col("payload")).alias("links"),
        "headers",
        plain_text(F.col("payload")).alias("text"),
    )
    fields = F.concat(
        F.lit("source-header: "),
        F.replace("headers", F.lit("\r\n"), F.lit("\r\nsource-header: ")),
        F.lit("\r\ntitle: "),
        "title",
        F.array_join(F.transform("links", lambda x: F.concat(F.lit("\r\noutlink: "), x)), ""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("k"), F.lit("application/warc-fields").alias("c"), fields.alias("t")),
        F.struct(F.lit("conversion").alias("k"), F.lit("text/plain").alias("c"), F.col("text").alias("t")),
    )
    rows = rows.select("page_id", "refers_to", "target_uri", "source_digest", F.explode(kinds).alias("r"))
    return rows.select(
        "page_id",
        F.col("r.k").alias("warc_type"),
        record_id("derived", F.col("r.k"), F.col("refers_to")).alias("record_id"),
        "refers_to",
        "target_uri",
        "source_digest",
        digest(F.col("r.t")).alias("block_digest"),
        F.col("r.c").alias("content_type"),
        F.octet_length("r.t").cast("long").alias("content_length"),
        F.col("r.t").alias("content"),
    )


def write_warc(records: DataFrame, path: str, date: str, per_file: int = 50_000) -> None:
    """Write derived records as WARC files of at most ``per_file`` records; ``date`` is their WARC-Date.

    Spark's committed text writer ends each row with the two line ends that close a WARC record.
    """
    names = (
        ("WARC-Type", "warc_type"),
        ("WARC-Record-ID", "record_id"),
        ("WARC-Refers-To", "refers_to"),
        ("WARC-Target-URI", "target_uri"),
        ("WARC-Source-Payload-Digest", "source_digest"),
        ("WARC-Block-Digest", "block_digest"),
        ("Content-Type", "content_type"),
        ("Content-Length", "content_length"),
    )
    lines = [F.concat(F.lit(f"{name}: "), F.col(column).cast("string")) for name, column in names]
    record = F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, F.lit(f"WARC-Date: {date}"), F.lit(""), F.col("content"))
    records.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


def oracle() -> str:
    """DuckDB SQL with the same result."""
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    plain = f"regexp_replace(regexp_replace(regexp_replace(html, {text(HIDDEN)}, '', 'g'), {text(BREAKS)}, chr(10), 'g'), {text(TAGS)}, '', 'g')"
    for name, value in ENTITIES:
        plain = f"replace({plain}, {text(name)}, {text(value)})"
    plain = f"trim(regexp_replace(regexp_replace({plain}, {text(BLANKS)}, ' ', 'g'), {text(LINES)}, chr(10), 'g'), ' ' || chr(10))"

    def uuid(x: str) -> str:
        return (
            f"'<urn:uuid:' || regexp_replace(md5({x}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', "
            "'\\1-\\2-\\3-\\4-\\5') || '>'"
        )

    title = f"regexp_replace(trim(regexp_extract(html, {text(TITLE)}, 1), ' ' || chr(10)), '[ \\t\\r\\n\\f]+', ' ', 'g')"
    end = "chr(13) || chr(10)"
    return f"""
with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
r as (select page_id, url as target_uri, html,
  {uuid("'response' || chr(10) || coalesce(page_id::varchar, '') || chr(10) || url")} as refers_to from p),
d as (select page_id, refers_to, target_uri, 'sha256:' || sha256(html) as source_digest, unnest([
  {{'k': 'metadata', 'c': 'application/warc-fields', 't':
    'source-header: Content-Type: text/html; charset=utf-8' || {end} || 'source-header: Content-Length: '
    || strlen(html)::varchar || {end} || 'title: ' || {title} || array_to_string(list_transform(
       regexp_extract_all(html, {text(LINK)}, 1), lambda x: {end} || 'outlink: ' || x), '')}},
  {{'k': 'conversion', 'c': 'text/plain', 't': {plain}}}]) as x from r)
select page_id, x.k as warc_type, {uuid("'derived' || chr(10) || x.k || chr(10) || refers_to")} as record_id,
  refers_to, target_uri, source_digest, 'sha256:' || sha256(x.t) as block_digest, x.c as content_type,
  strlen(x.t)::bigint as content_length, x.t as content from d"""
