"""Emergency-room status pages -> bronze / silver / gold rows.

Plan:
* ``html_blocks`` (A6) is the one Python step: an Arrow-batched
  ``mapInPandas`` that walks each page with the standard-library HTML parser
  on the executors and emits one row per ``div.hospital_element`` block
  (title text, address lines, metric item texts, source fragment). Pages are
  independent, so this is a narrow stage that scales with the page count.
* Everything after it is JVM-side: metric label/value split and lookup (A7),
  value parsing (H4-H6), deduplication (A9), and the bronze/silver/gold
  projections (A10-A12).
* A9 keeps, per (name, address), the block of the first page in URL order
  and the first block in document order: ``row_number() = 1``, for which
  Catalyst limits every map task to one row per site before the shuffle, so a
  site repeated on a large share of all pages does not pile up in one task.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.functions import lexicon as L
from careflow.functions.text import (
    literal_normalize_main,
    make_id,
    normalize_main,
    parse_duration_to_minutes,
    parse_metric_int,
    parse_metric_pct,
)
from careflow.operators.transcripts import py_strip

BLOCK_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("block_pos", T.IntegerType()),
        T.StructField("facility_name_raw", T.StringType()),
        T.StructField("address_lines", T.ArrayType(T.StringType())),
        T.StructField("metric_items", T.ArrayType(T.StringType())),
        T.StructField("raw_html_fragment", T.StringType()),
    ]
)
BLOCK_CLASS, TITLE_LI, TITLE_TEXT, ADDRESS_DIV, METRIC_LI = "hospital_element", "title", "font-weight-bold", "adresse", "hopital-item"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
METRIC_COLUMNS = {  # output column -> parser
    "wait_time_non_priority_minutes": parse_duration_to_minutes,
    "people_waiting": parse_metric_int,
    "total_people_er": parse_metric_int,
    "stretcher_occupancy_pct": parse_metric_pct,
    "avg_wait_room_minutes_prev_day": parse_duration_to_minutes,
    "avg_stretcher_wait_minutes_prev_day": parse_duration_to_minutes,
}
GOLD_COLUMNS = ["scrape_id", "facility_name_raw", "address_raw", "region", *METRIC_COLUMNS, "source_url", "scraped_at"]


class _BlockWalker(HTMLParser):
    """Collects hospital blocks. A block may lie in another (both count, and the outer one holds the inner one's
    items); a block that is still open when the page ends is closed there."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html = html
        self.line_starts = [0]
        for i, ch in enumerate(html):
            if ch == "\n":
                self.line_starts.append(i + 1)
        self.blocks: list[dict] = []
        self.open: list[dict] = []  # open blocks, outermost first
        self.stack: list[tuple[str, set]] = []  # open elements from the outermost open block on

    def _offset(self) -> int:
        line, col = self.getpos()
        return self.line_starts[line - 1] + col

    def handle_starttag(self, tag, attrs):
        classes = set()
        for k, v in attrs:
            if k == "class" and v:
                classes = set(v.split())
        starts = tag == "div" and BLOCK_CLASS in classes
        if not self.open and not starts:
            return
        if tag in VOID:
            return
        self.stack.append((tag, classes))
        depth = len(self.stack)
        for c in self.open:
            if c["title"] is None and TITLE_TEXT in classes and any(t == "li" and TITLE_LI in k for t, k in self.stack[c["depth"]:]):
                c["title"], c["t_depth"] = [], depth
            if c["address"] is None and tag == "div" and ADDRESS_DIV in classes:
                c["address"], c["a_depth"] = [], depth
            if tag == "li" and METRIC_LI in classes:
                c["items"].append([])
                c["i_depths"].append((depth, c["items"][-1]))
        if starts:
            self.open.append({"start": self._offset(), "depth": depth, "title": None, "address": None, "items": [],
                              "t_depth": 0, "a_depth": 0, "i_depths": []})

    def handle_endtag(self, tag):
        if not self.open or tag in VOID:
            return
        # close the innermost open element with this name (and anything left open inside it)
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._cut(i, self.html.find(">", self._offset()) + 1)
                return

    def _cut(self, depth: int, end: int) -> None:
        """Elements beyond ``depth`` are closed; blocks among them end at ``end`` of the source."""
        del self.stack[depth:]
        while self.open and self.open[-1]["depth"] > depth:
            c = self.open.pop()
            c["fragment"] = self.html[c["start"]:end]
            self.blocks.append(c)
        for c in self.open:
            c["t_depth"] = c["t_depth"] if c["t_depth"] <= depth else 0
            c["a_depth"] = c["a_depth"] if c["a_depth"] <= depth else 0
            c["i_depths"] = [x for x in c["i_depths"] if x[0] <= depth]

    def handle_data(self, data):
        s = data.strip()
        if not s:
            return
        for c in self.open:
            if c["t_depth"]:
                c["title"].append(s)
            if c["a_depth"]:
                c["address"].append(s)
            for _, item in c["i_depths"]:
                item.append(s)

    def close(self):
        super().close()
        self._cut(0, len(self.html))
        self.blocks.sort(key=lambda c: c["start"])


def _walk_pages(batches):
    for pdf in batches:
        rows = []
        for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
            w = _BlockWalker(html or "")
            w.feed(html or "")
            w.close()
            for pos, b in enumerate(w.blocks):
                if b["title"] is None or b["address"] is None:
                    continue
                rows.append((page_id, url, pos, "".join(b["title"]), b["address"], [" ".join(x) for x in b["items"]], b["fragment"]))
        yield pd.DataFrame(rows, columns=BLOCK_SCHEMA.fieldNames())


def html_blocks(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> one row per hospital block that has a title and an address."""
    return pages.select("page_id", "url", "html").mapInPandas(_walk_pages, BLOCK_SCHEMA)


def _metric_pairs(items: Column) -> Column:
    """Items with a ':' split on the first one into (normalized label, stripped value)."""
    with_colon = F.filter(items, lambda s: s.contains(":"))
    return F.transform(
        with_colon,
        lambda s: F.struct(
            normalize_main(F.substring_index(s, ":", 1)).alias("label"),
            py_strip(F.substr(s, F.instr(s, ":") + 1)).alias("value"),
        ),
    )


def metric_value(pairs: Column, label: str) -> Column:
    """Value of the last item with this label (later duplicates win); NULL when absent."""
    hits = F.filter(pairs, lambda p: p["label"] == F.lit(literal_normalize_main(label)))
    return F.try_element_at(hits, F.lit(-1))["value"]


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """A7 + H4-H6: address/region from the address lines, six typed metrics."""
    pairs = _metric_pairs(F.col("metric_items"))
    lines = F.col("address_lines")
    out = blocks.withColumn("_pairs", pairs)
    metrics = {name: parse(metric_value(F.col("_pairs"), L.METRIC_LABELS[name])) for name, parse in METRIC_COLUMNS.items()}
    return out.select(
        "page_id", "source_url", "block_pos", "facility_name_raw",
        F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")).alias("address_raw"),
        F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("region"),
        *[c.alias(n) for n, c in metrics.items()],
        "raw_html_fragment",
    )


def first_per_site(records: DataFrame) -> DataFrame:
    """Per (name, address) the record of the first page in URL order (then page id), first block within the page."""
    w = Window.partitionBy("facility_name_raw", "address_raw").orderBy(
        *[F.col(c).asc_nulls_last() for c in ("source_url", "page_id", "block_pos")])
    return records.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def with_scrape(records: DataFrame, scraped_at: str | Column) -> DataFrame:
    """The refresh time parameter, and a deterministic scrape id (H44 over url, page, block position and that time:
    a later crawl of a page makes ids of its own)."""
    ts = scraped_at if isinstance(scraped_at, Column) else F.to_timestamp_ntz(F.lit(scraped_at))
    out = records.withColumn("scraped_at", ts)
    crawl = F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss")
    return out.withColumn("scrape_id", make_id("scrape", "source_url", "page_id", "block_pos", crawl))


def gold_rows(records: DataFrame) -> DataFrame:
    """The 12 live-status columns."""
    return records.select(*GOLD_COLUMNS)


def silver_rows(records: DataFrame) -> DataFrame:
    """Gold plus normalized name and address."""
    return gold_rows(records).withColumns(
        {"normalized_facility_name": normalize_main(F.col("facility_name_raw")),
         "normalized_address": normalize_main(F.col("address_raw"))}
    )


def metric_payload(records: DataFrame) -> Column:
    """A10: the six metrics as JSON text in the reference's layout (', ' and ': ' separators, null kept)."""
    parts = [
        F.concat(F.lit(f'"{name}": '), F.coalesce(F.col(name).cast("string"), F.lit("null")))
        for name in METRIC_COLUMNS
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def bronze_rows(records: DataFrame) -> DataFrame:
    """A10: raw fragment and packed metrics."""
    return records.select(
        "scrape_id", "source_url", "raw_html_fragment", "facility_name_raw", "address_raw",
        F.col("region").alias("region_raw"), metric_payload(records).alias("metric_payload"), "scraped_at",
    )


def page_links(pages: DataFrame, site_prefix: str = L.SITE_PREFIX) -> DataFrame:
    """A8 + G2: per page, sorted set of its own URL and every non-empty ``a[data-page]`` href (made absolute)."""
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(<a\s[^>]*\bdata-page\b[^>]*>)"), 1)
    hrefs = F.transform(tags, lambda t: F.regexp_extract(t, r"\bhref\s*=\s*\"([^\"]*)\"", 1))
    hrefs = F.filter(hrefs, lambda h: h != "")
    absolute = F.transform(hrefs, lambda h: F.when(h.startswith("http"), h).otherwise(F.concat(F.lit(site_prefix), h)))
    return pages.select("page_id", "url", F.array_sort(F.array_distinct(F.array_union(F.array(F.col("url")), absolute))).alias("page_urls"))
