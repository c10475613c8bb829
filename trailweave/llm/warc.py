"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Each response gives a conversion record (its text) and a metadata record (title,
links, lengths, the response's own headers); both name the response in
WARC-Refers-To and carry its digest, and the metadata record names the
conversion too. All of it is Column expressions, one pass and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text.
HIDDEN = ("script", "style", "noscript", "template", "svg", "head", "nav")
_BLOCK = "p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|main|aside|header|footer|form|blockquote|pre|body|html"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Replacements in order, in the syntax that Java and RE2 share; the fewer passes over a page the better.
RULES = (
    (r"(?s)<!--.*?-->", ""),
    (rf"(?is)<(?:{'|'.join(rf'{tag}\b.*?</{tag}' for tag in HIDDEN)})\s*>", " "),
    (rf"(?i)</?(?:{_BLOCK})\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    *_ENTITIES,
    (r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"),
)
_TITLE = r"(?is)<title[^>]*>(.*?)</title"
_LINK = r'(?i)<a\b[^>]*?\bhref="([^"]*)"'  # of the SQL, whose pages quote all links so
#: A link's value in double, single or no quotes.
_HREF = r"""(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""


def text_of(html: Column) -> Column:
    """Readable text of HTML; null gives the empty text."""
    out = F.coalesce(html, F.lit(""))
    for pattern, by in RULES:
        out = F.replace(out, F.lit(pattern), F.lit(by)) if (pattern, by) in _ENTITIES else F.regexp_replace(out, pattern, by)
    return F.btrim(out, F.lit(" \n"))


def record_id(*parts: Column) -> Column:
    """A stable urn:uuid of the parts; nulls count as empty."""
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def derive(responses: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", record_id_col: str | None = None, headers_col: str | None = None) -> DataFrame:
    """Two rows per response: id, warc_type, record_id, refers_to, target_uri, content_type, source_digest, block_digest, content_length, content.

    record_id_col: the responses' own record identifiers, kept as they are; else
    one is derived from id and URL. headers_col: the HTTP headers as one string,
    kept in the metadata. Digests are sha256 in hex, of the source's payload and
    of the content, lengths those of UTF-8 bytes. A null payload counts as
    empty, a null URL stays null and out of the JSON, a null id too. Repeated
    rows give repeated records with equal identifiers; an empty table gives none.

    Limits, which the SQL has too: of entities the text has only &nbsp; &lt;
    &gt; &quot; &#39; and &amp; decoded (other named and numeric ones, such as
    &copy;, stay as markup), the title and the links none.
    """
    html = F.coalesce(F.col(payload_col), F.lit(""))
    source = F.col(record_id_col) if record_id_col else record_id(F.lit("response"), F.col(id_col), F.col(url_col))
    base = responses.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), source.alias("refers_to"),
        F.concat(F.lit("sha256:"), F.sha2(html.cast("binary"), 256)).alias("source_digest"),
        text_of(html).alias("text"),
        F.nullif(F.trim(F.regexp_extract(html, _TITLE, 1)), F.lit("")).alias("title"),
        F.transform(F.regexp_extract_all(html, F.lit(_HREF), F.lit(1)), lambda x: F.regexp_replace(x, r"""(?s)^(["'])(.*)\1$""", "$2")).alias("links"),
        F.octet_length(html).alias("source_length"),
        (F.col(headers_col) if headers_col else F.lit(None).cast("string")).alias("headers"),
    )
    conversion = record_id(F.lit("conversion"), F.col("refers_to"))
    about = F.to_json(F.struct(conversion.alias("conversion"), F.col("headers"), "links", "source_length", F.octet_length("text").alias("text_length"), "title"))
    kind = "struct<warc_type:string,record_id:string,content_type:string,content:string>"
    rows = F.array(
        F.struct(F.lit("conversion"), conversion, F.lit("text/plain"), F.col("text")).cast(kind),
        F.struct(F.lit("metadata"), record_id(F.lit("metadata"), F.col("refers_to")), F.lit("application/json"), about).cast(kind),
    )
    r = base.select("id", "target_uri", "refers_to", "source_digest", F.explode(rows).alias("r")).select("id", "r.warc_type", "r.record_id", "refers_to", "target_uri", "r.content_type", "source_digest", "r.content")
    return r.select("*", F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256)).alias("block_digest"), F.octet_length("content").cast("long").alias("content_length"))


def write_warc(records: DataFrame, path: str, date: str) -> None:
    """Writes the records of derive() as WARC/1.1 files, gzipped. date: of the run, in ISO 8601."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))
    whole = F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.lit(date)),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Source-Payload-Digest", F.col("source_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
        F.lit("\r\n\r\n"), F.col("content"),
    )
    records.select(whole.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def oracle_sql() -> str:
    """DuckDB SQL for derive() over pages."""
    text = "coalesce(html, '')"
    for pattern, by in RULES:
        quoted = ["E'" + x.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\t", "\\t") + "'" for x in (pattern, by)]
        text = f"regexp_replace({text}, {quoted[0]}, {quoted[1]}, 'g')"
    uuid = lambda x: f"'<urn:uuid:' || regexp_replace(md5({x}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '>'"
    return f"""
        WITH base AS (
            SELECT page_id, url, {uuid("'response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')")} AS refers_to,
                   'sha256:' || sha256(coalesce(html, '')) AS source_digest, trim({text}, E' \\n') AS text,
                   nullif(trim(regexp_extract(coalesce(html, ''), '{_TITLE}', 1), ' '), '') AS title,
                   regexp_extract_all(coalesce(html, ''), '{_LINK}', 1) AS links, strlen(coalesce(html, '')) AS source_length
            FROM pages
        ), records AS (
            SELECT *, 'conversion' AS warc_type, {uuid("'conversion|' || refers_to")} AS record_id, 'text/plain' AS content_type, text AS content FROM base
            UNION ALL
            SELECT *, 'metadata', {uuid("'metadata|' || refers_to")}, 'application/json',
                   CASE WHEN title IS NULL THEN to_json({{'conversion': {uuid("'conversion|' || refers_to")}, 'links': links, 'source_length': source_length, 'text_length': strlen(text)}})
                        ELSE to_json({{'conversion': {uuid("'conversion|' || refers_to")}, 'links': links, 'source_length': source_length, 'text_length': strlen(text), 'title': title}}) END::VARCHAR
            FROM base
        )
        SELECT page_id, warc_type, record_id, refers_to, url AS target_uri, content_type, source_digest, content,
               'sha256:' || sha256(content) AS block_digest, strlen(content) AS content_length
        FROM records
    """
