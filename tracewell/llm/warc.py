"""WARC derivatives: metadata and plain-text conversion records of response records.

A response becomes two records that name it in WARC-Refers-To: a ``metadata`` record (warc-fields with every HTTP header
line of the source, the payload digest of the source, title and number of links, and the id of the conversion) and a ``conversion`` record
with the text of the page. Target and date are those of the source; blocks have their own digest. Record ids are digests
of the id of the source, so a repeated run gives equal ids.

Everything is column expressions, one row in and two out, without an exchange. No pattern looks past the next ``<`` or
past a place that it has looked at before, so the work grows with the page, whatever is left unclosed in it.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
HTTP_HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
DATE = "1970-01-01T00:00:00Z"

# Named character references of HTML, as the standard library lists them.
# A map is searched from its first entry on, so frequent names come first.
FREQUENT = ["amp", "nbsp", "lt", "gt", "quot", "apos", "copy", "middot", "mdash", "ndash"]
ENTITIES = {name: html.entities.html5[f"{name};"] for name in FREQUENT}
ENTITIES |= {name: chr(code) for name, code in html.entities.name2codepoint.items()}
ENTITIES |= {name[:-1]: sign for name, sign in html.entities.html5.items() if name.endswith(";")}
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

# Fixed value: the tags that end a line.
LINE_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|"
    "section|table|td|th|title|tr|ul"
)

HIDDEN = [r"(?s)<!--.*?(?:-->|\z)"] + [rf"(?is)<{tag}\b.*?(?:</{tag}[^<>]*>|\z)" for tag in ("script", "style", "noscript")]
LINE_TAG = rf"(?i)</?(?:{LINE_TAGS})\b[^<>]*>"
TAG = "</?[A-Za-z!?][^<>]*>"
TITLE = r"(?is)<title\b[^<>]*>(.*?)(</title|\z)"
LINK = r"(?i)<a\s[^<>]*href\s*="


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _decoded(text: Column) -> Column:
    """Character references by name and number decoded, once; those that name no character stay."""
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")

    def sign(x: Column) -> Column:
        body = F.substring(x, F.lit(2), F.length(x) - 2)
        hexadecimal = F.conv(F.substring(body, F.lit(3), F.length(body) - 2), 16, 10)
        number = F.when(body.rlike("^#[xX]"), hexadecimal).when(body.startswith("#"), F.substring(body, F.lit(2), F.length(body) - 1))
        code = number.cast("int")
        fine = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(F.when(fine, character), F.when(code.isNull(), names[body]), x)

    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), sign)
    parts = F.zip_with(F.split(text, REFERENCE, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def plain_text(html: Column) -> Column:
    """The visible text of a page: a line for each block, blanks collapsed, character references decoded."""
    text = html
    for pattern in HIDDEN:
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(text, LINE_TAG, "\n")
    text = F.regexp_replace(text, TAG, "")
    text = _let(text, _decoded)
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    text = F.regexp_replace(text, " ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+\z", "")


def _title(html: Column) -> Column:
    """The text of the first title that is closed."""
    closed = F.regexp_extract(html, TITLE, 2) != ""
    return plain_text(F.when(closed, F.regexp_extract(html, TITLE, 1)).otherwise(""))


def _record_id(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))
    cut = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(
    pages: DataFrame, url: str = "url", html: str = "html", date: str | Column = DATE, http_headers: str | Column = HTTP_HEADERS
) -> DataFrame:
    """Response records of fetched pages: ``pages`` with record_id, target_uri, warc_date, http_headers, payload and
    payload_digest. A null page has an empty payload. Pages with times or headers of their own give them as columns;
    a timestamp is written in UTC, and null is left out of the derivatives."""
    payload = F.coalesce(F.col(html), F.lit(""))
    if isinstance(date, Column):
        date = F.date_format(date.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return pages.withColumns(
        {
            "record_id": _record_id(F.lit("response"), F.col(url), F.sha2(payload, 256)),
            "target_uri": F.col(url),
            "warc_date": date if isinstance(date, Column) else F.lit(date),
            "http_headers": http_headers if isinstance(http_headers, Column) else F.lit(http_headers),
            "payload": payload,
            "payload_digest": _digest(payload),
        }
    )


def _fields(*pairs: tuple[str, Column]) -> Column:
    """Lines "name: value"; those without a value are left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit("")) for name, value in pairs])


def _header_lines(headers: Column) -> Column:
    """Each header line of the source as a field "source-header: name: value", in order; folded lines are joined."""
    lines = F.split(F.regexp_replace(headers, r"\r?\n[ \t]+", " "), r"\r?\n")
    wanted = F.filter(lines, lambda x, i: (i > 0) & F.contains(x, F.lit(":")))
    return F.array_join(F.transform(wanted, lambda x: F.concat(F.lit("source-header: "), x, F.lit(CRLF))), "")


def derive(records: DataFrame, *keep: str) -> DataFrame:
    """The metadata and conversion record of each response record, with the columns ``keep`` of the source.

    Columns: record_type, record_id, refers_to, target_uri, warc_date, content_type, content_length, block_digest,
    source_digest, block and headers, the whole WARC header. A source without a target has none in its derivatives; an
    empty payload gives an empty text. Repeated sources give repeated records; an empty table gives an empty result.
    """
    # Columns to keep travel as one struct, so they may have any name.
    kept = [F.struct(*[F.col(f"`{name}`") for name in keep]).alias("kept")] if keep else []
    source = records.select(
        *kept, "record_id", "target_uri", "warc_date", "payload_digest",
        plain_text(F.col("payload")).alias("text"),
        _title(F.col("payload")).alias("title"),
        F.regexp_count("payload", F.lit(LINK)).alias("links"),
        _record_id(F.lit("conversion"), F.col("record_id")).alias("conversion"),
        F.regexp_extract("http_headers", r"^HTTP/[0-9.]+ ([0-9]{3})", 1).alias("status"),
        F.regexp_extract("http_headers", r"(?im)^content-type:[ \t]*([^\r\n]*)", 1).alias("source_type"),
        _header_lines(F.col("http_headers")).alias("header_lines"),
    )
    metadata = _fields(
        ("source-uri", F.col("target_uri")),
        ("source-status", F.col("status")),
        ("source-content-type", F.col("source_type")),
        ("source-payload-digest", F.col("payload_digest")),
        ("title", F.regexp_replace("title", "\n", " ")),
        ("links", F.col("links")),
        ("conversion", F.col("conversion")),
    )
    metadata = F.concat(metadata, F.coalesce(F.col("header_lines"), F.lit("")))
    kinds = F.array(
        F.struct(
            F.lit("metadata").alias("record_type"),
            _record_id(F.lit("metadata"), F.col("record_id")).alias("record_id"),
            F.lit("application/warc-fields").alias("content_type"),
            metadata.alias("block"),
        ),
        F.struct(
            F.lit("conversion").alias("record_type"),
            F.col("conversion").alias("record_id"),
            F.lit("text/plain; charset=utf-8").alias("content_type"),
            F.col("text").alias("block"),
        ),
    )
    made = source.select(
        *(["kept"] if keep else []),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("payload_digest").alias("source_digest"),
        F.explode(kinds).alias("r"),
    )
    made = made.select(*(["kept.*"] if keep else []), "r.*", "refers_to", "target_uri", "warc_date", "source_digest").withColumns(
        {"content_length": F.octet_length("block").cast("long"), "block_digest": _digest(F.col("block"))}
    )
    headers = _fields(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.col("warc_date")),
        ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")),
        ("Content-Length", F.col("content_length")),
    )
    return made.withColumn("headers", F.concat(F.lit(f"WARC/1.1{CRLF}"), headers))


def write(records: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """Write derived records as WARC files, one for each partition."""
    # A record ends with two CRLF, the last character of which is the line separator.
    lines = records.select(F.concat("headers", F.lit(CRLF), "block", F.lit(CRLF + "\r")).alias("value"))
    options = {"compression": compression} if compression else {}
    lines.write.options(lineSep="\n", **options).text(path)
