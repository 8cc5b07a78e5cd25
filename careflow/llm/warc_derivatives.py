"""WARC derivatives: linked metadata and plain-text conversion records of HTTP responses (operator 5).

Each response gives two records. The conversion holds the page's text; the metadata record holds facts about the
response as `application/warc-fields` (status line and headers of the source, title, its payload digest, the id and
digest of the conversion). Both carry `WARC-Refers-To` with the response's record id, its target URI and its date,
and digests of their own block; record ids are made from the response's id, so a retried task makes the same ones.
All of it is column expressions over one pass: no shuffle, one input row to two output rows.

Defined results: a null payload is an empty one (its conversion is empty); a null target URI, date or header leaves
its line out; a response without record id gives no records, since nothing could refer to it; repeated rows give
repeated records with equal ids; an empty table gives no rows; other columns are neither read nor changed.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm.common import table

CRLF = "\r\n"
#: Elements whose content is no text, and elements that end a line.
HIDDEN = ("script", "style", "noscript", "template")
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
#: All named character references of HTML that end in a semicolon, from the standard library's table.
ENTITIES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Numbers 0x80 to 0x9F stand for the letters of windows-1252, those without one for themselves.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def _steps() -> list[tuple[str, str]]:
    hidden = "|".join([r"<!--.*?(?:-->|\z)", *(rf"<{t}\b.*?(?:</{t}\s*>|\z)" for t in HIDDEN)])
    return [(f"(?is){hidden}", " "), (rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n"), (r"<[a-zA-Z/!?][^>]*>", "")]


_SPACES = [(r"[\x20\t\r\f\x0b\x{a0}]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", "")]


def _literal(text: str) -> str:
    """A string literal of Spark's SQL, all but letters and digits escaped."""
    return "'" + "".join(c if c.isascii() and c.isalnum() else f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}" for c in text) + "'"


def _map(entries: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{key}', {value}" for key, value in entries.items()) + ")"


def _nested(entries: dict[str, str], at: int) -> str:
    """Entries by their letter at place ``at``."""
    return _map({c: _map({name: by for name, by in entries.items() if name[at : at + 1] == c}) for c in sorted({name[at : at + 1] for name in entries})})


#: A map is searched entry by entry: the names most pages hold come first, the whole table goes by first and second letter.
COMMON = ("amp", "nbsp", "lt", "gt", "quot", "copy", "middot", "apos", "mdash", "ndash", "rsquo", "lsquo", "rdquo", "ldquo", "hellip", "eacute")
_LITERALS = {name: _literal(text) for name, text in ENTITIES.items()}
_COMMON = _map({name: _LITERALS[name] for name in COMMON})
_TABLE = _map({c: _nested({name: by for name, by in _LITERALS.items() if name[0] == c}, 1) for c in sorted({name[0] for name in ENTITIES})})


def resolved(text: Column) -> Column:
    """Named and numeric character references replaced, each once (what they give is not read again). Numbers that are
    no character give U+FFFD; unknown names and references without a semicolon stay."""
    common, table = F.expr(_COMMON), F.expr(_TABLE)
    def one(x: Column) -> Column:
        name, part = x["name"], x["part"]
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("long")
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.translate(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), _C1, _CP1252)
        rarer = F.try_element_at(F.try_element_at(F.try_element_at(table, F.substring(name, 1, 1)), F.substring(name, 2, 1)), name)
        named = F.coalesce(F.try_element_at(common, name), rarer)
        by = F.when(name == "", None).when(name.startswith("#"), F.when(known, char).otherwise("\ufffd")).otherwise(named)
        return F.when(name.isNull(), part).otherwise(F.coalesce(F.concat(by, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part)))

    # the text is named once, and the name is a field of its own: what is repeated here is computed each time
    cut = lambda p, i: F.struct(F.when(i > 0, F.regexp_extract(p, REFERENCE, 1)).alias("name"), p.alias("part"))
    return F.array_join(F.transform(F.transform(F.split(text, "&"), cut), one), "")


def plain_text(html: Column) -> Column:
    """Text of a page: no hidden elements, comments or tags; a line for each block; character references resolved."""
    text = F.coalesce(html, F.lit(""))
    for pattern, by in _steps():
        text = F.regexp_replace(text, pattern, by)
    text = resolved(text)
    for pattern, by in _SPACES:
        text = F.regexp_replace(text, pattern, by)
    return text


def title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1)
    return F.nullif(F.trim(F.regexp_replace(plain_text(found), r"\n", " ")), F.lit(""))


def uuid_urn(*cols: Column) -> Column:
    """`<urn:uuid:...>` from the md5 of the columns."""
    h = F.md5(F.concat_ws("|", *cols))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _lines(*pairs: tuple[str, Column]) -> Column:
    """`Name: value` lines; a null value leaves its line out."""
    return F.concat_ws(CRLF, *(F.concat(F.lit(f"{name}: "), value) for name, value in pairs))


def derivatives(responses: DataFrame) -> DataFrame:
    """responses: record_id, target_uri, warc_date (ISO text), http (status line and headers as text), payload (text).

    Per record: record_id, warc_type, refers_to, target_uri, warc_date, content_type, block, block_digest,
    content_length, header (the WARC header as text)."""
    base = responses.filter(F.col("record_id").isNotNull()).select(
        F.col("record_id").alias("src"), "target_uri", "warc_date", F.rtrim(F.regexp_replace("http", r"[\r\n]+\z", "")).alias("http"), F.coalesce("payload", F.lit("")).alias("payload")
    )
    # an explode of one element keeps the extracted text a column, so that its regexes run once for all that read it
    base = base.withColumn("text", F.explode(F.array(plain_text(F.col("payload")))))
    ids = base.withColumns({"conv_id": uuid_urn(F.lit("conversion"), F.col("src")), "meta_id": uuid_urn(F.lit("metadata"), F.col("src")), "conv_digest": digest(F.col("text"))})
    status = F.regexp_extract("http", r"^([^\r\n]*)", 1)
    source = F.regexp_replace(F.regexp_replace(F.regexp_replace("http", r"^[^\r\n]*(?:\r?\n)?", ""), r"(?m)^(.)", "source-http-$1"), r"\r?\n", CRLF)
    fields = F.concat_ws(
        CRLF,
        _lines(
            ("source-record-id", F.col("src")), ("source-payload-digest", digest(F.col("payload"))), ("source-payload-length", F.octet_length("payload").cast("string")),
            ("conversion-record-id", F.col("conv_id")), ("conversion-block-digest", F.col("conv_digest")), ("title", title(F.col("payload"))), ("source-http-status", F.nullif(status, F.lit(""))),
        ),
        F.nullif(source, F.lit("")),
    )
    made = ids.withColumn("fields", F.concat(fields, F.lit(CRLF)))
    record = lambda kind, rid, ctype, block: F.struct(F.lit(kind).alias("warc_type"), rid.alias("record_id"), F.lit(ctype).alias("content_type"), block.alias("block"))
    two = F.array(record("metadata", F.col("meta_id"), "application/warc-fields", F.col("fields")), record("conversion", F.col("conv_id"), "text/plain; charset=utf-8", F.col("text")))
    each = made.select("src", "target_uri", "warc_date", F.explode(two).alias("r")).select(
        "r.record_id", "r.warc_type", F.col("src").alias("refers_to"), "target_uri", "warc_date", "r.content_type", "r.block", digest(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length")
    )
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _lines(
            ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Refers-To-Target-URI", F.col("target_uri")),
            ("WARC-Refers-To-Date", F.col("warc_date")), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("warc_date")), ("WARC-Block-Digest", F.col("block_digest")),
            ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string")),
        ),
    )
    return each.withColumn("header", header)


def write_warc(records: DataFrame, path: str) -> None:
    """Records as gzipped WARC files, one for each partition."""
    records.select(F.concat("header", F.lit(CRLF * 2), "block", F.lit(CRLF)).alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").text(path)


def page_responses(pages: DataFrame) -> DataFrame:
    """The pages table as fetched responses: id from page id and url, a second for each page id as its date."""
    length = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length, F.lit(CRLF))
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return pages.select("page_id", uuid_urn(F.lit("response"), F.col("page_id").cast("string"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), date.alias("warc_date"), http.alias("http"), F.col("html").alias("payload"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(page_responses(table(spark, sf_dir, "pages", "page_id", "url", "html")))


def _sql_resolved(text: str) -> str:
    """References replaced, in DuckDB; the names' table is the column ``names``."""
    name = f"regexp_extract(p, '{REFERENCE}', 1)"
    code = f"CASE WHEN n ILIKE '#x%' THEN list_reduce([0::BIGINT] || list_transform(string_split(lower(substr(n, 3)), ''), lambda d: instr('0123456789abcdef', d)::BIGINT - 1), lambda x, d: x * 16 + d) ELSE substr(n, 2)::BIGINT END"
    char = f"CASE WHEN c BETWEEN 1 AND 55295 OR c BETWEEN 57344 AND 1114111 THEN translate(chr(c::INT), {_sql_string(_C1)}, {_sql_string(_CP1252)}) ELSE chr(65533) END"
    by = f"CASE WHEN n LIKE '#%' THEN list_transform([{code}], lambda c: {char})[1] WHEN n <> '' THEN names[n] END"
    one = f"list_transform([{name}], lambda n: coalesce({by} || substr(p, length(n) + 2), '&' || p))[1]"
    return f"list_transform([string_split({text}, '&')], lambda ps: ps[1] || coalesce(array_to_string(list_transform(ps[2:], lambda p: {one}), ''), ''))[1]"


def _sql_string(text: str) -> str:
    return "(" + " || ".join(f"chr({ord(c)})" for c in text) + ")"


_NAMES = f"MAP([{', '.join(repr(n) for n in ENTITIES)}], [{', '.join(_sql_string(t) for t in ENTITIES.values())}])"


def _sql_text(source: str) -> str:
    out = f"coalesce({source}, '')"
    for pattern, by in _steps():
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')".replace("\n", "\\n") if by != "\n" else f"regexp_replace({out}, '{pattern}', chr(10), 'g')"
    out = _sql_resolved(out)
    for pattern, by in _SPACES:
        out = f"regexp_replace({out}, '{pattern}', {'chr(10)' if by == chr(10) else repr(by)}, 'g')"
    return out


def _sql_urn(expr: str) -> str:
    return "('<urn:uuid:' || " + " || '-' || ".join(f"substr(md5({expr}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>')"


_TITLE = _sql_text("regexp_extract(payload, '(?is)<title\\b[^>]*>(.*?)</title', 1)")
ORACLE_SQL = f"""
WITH names AS (SELECT {_NAMES} AS names), r AS (SELECT names, {_sql_urn("concat_ws('|', 'response', page_id::VARCHAR, url)")} AS src, url AS target_uri, coalesce(html, '') AS payload,
  strftime(to_timestamp(1704067200 + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS warc_date FROM pages, names),
t AS (SELECT *, {_sql_text("payload")} AS text, nullif(trim(replace({_TITLE}, chr(10), ' ')), '') AS title,
  {_sql_urn("'conversion|' || src")} AS conv_id, {_sql_urn("'metadata|' || src")} AS meta_id, chr(13) || chr(10) AS nl FROM r),
f AS (SELECT *, concat_ws(nl, 'source-record-id: ' || src, 'source-payload-digest: sha256:' || sha256(payload), 'source-payload-length: ' || strlen(payload),
  'conversion-record-id: ' || conv_id, 'conversion-block-digest: sha256:' || sha256(text), 'title: ' || title, 'source-http-status: HTTP/1.1 200 OK',
  'source-http-Content-Type: text/html; charset=utf-8', 'source-http-Content-Length: ' || strlen(payload)) || nl AS fields FROM t),
e AS (SELECT meta_id AS record_id, 'metadata' AS warc_type, src AS refers_to, target_uri, warc_date, 'application/warc-fields' AS content_type, fields AS block, nl FROM f
  UNION ALL SELECT conv_id, 'conversion', src, target_uri, warc_date, 'text/plain; charset=utf-8', text, nl FROM f)
SELECT record_id, warc_type, refers_to, target_uri, warc_date, content_type, block, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length,
  'WARC/1.1' || nl || concat_ws(nl, 'WARC-Type: ' || warc_type, 'WARC-Record-ID: ' || record_id, 'WARC-Refers-To: ' || refers_to, 'WARC-Refers-To-Target-URI: ' || target_uri,
  'WARC-Refers-To-Date: ' || warc_date, 'WARC-Target-URI: ' || target_uri, 'WARC-Date: ' || warc_date, 'WARC-Block-Digest: sha256:' || sha256(block),
  'Content-Type: ' || content_type, 'Content-Length: ' || strlen(block)) AS header FROM e
"""
