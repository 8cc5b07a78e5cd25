"""Registered queries: emergency-room page ingest (A6-A12, A8, A9), overrides (C6) and match upsert."""

from __future__ import annotations

from careflow.functions import lexicon as L
from careflow.operators.transcripts import PY_WS
from careflow.plans import domain as D
from careflow.plans import oracle_text as OT
from careflow.plans.registry import register
from careflow.plans.oracle_domain import _site_address, _site_name
from careflow.sources import er_pages as ER


# --------------------------------------------------------------------------- SQL twin of domain.er_pages
def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def _li(x: str) -> str:
    return f"""('<li class="hopital-item">' || {x} || '</li>')"""


def _hhmm(m: str, pad: bool) -> str:
    h = _s(f"(({m}) // 60)")
    return f"({f'lpad({h}, 2, {OT.q(chr(48))})' if pad else h} || ':' || lpad({_s(f'(({m}) % 60)')}, 2, '0'))"


def _block_sql(p: str, j: str) -> str:
    site = f"(({p} // 2) * 3 + {j})"
    lab = L.METRIC_LABELS
    name = f"(CASE WHEN {site} % 6 = 0 THEN 'CHU Sainte-Justine &amp; ' ELSE {OT.q('Hôpital ')} END || {_site_name(site)})"
    wait = _hhmm(f"({p} * 7 + {j} * 13) % 600", True)
    waiting = f"(CASE WHEN ({p} + {j}) % 9 = 0 THEN 'n/a' ELSE {_s(f'({p} + {j}) % 40')} END)"
    total = f"(CASE WHEN {j} = 2 THEN '1,' || lpad({_s(f'({p} * 3 + {j}) % 90')}, 3, '0') ELSE {_s(f'({p} * 3 + {j}) % 90')} END)"
    occ = f"({_s(f'({p} * 11 + {j}) % 150')} || CASE WHEN {j} = 3 THEN ',5 %' ELSE ' %' END)"
    room = _hhmm(f"({p} + 5 * {j}) % 500", False)
    stretcher = _s(f"({p} * 17 + {j}) % 2000")
    total_label = f"(CASE WHEN {j} = 1 THEN {OT.q('<strong>' + lab['total_people_er'] + '</strong>')} ELSE {OT.q(lab['total_people_er'])} END)"
    items = " || ".join([
        _li(f"{OT.q(lab['wait_time_non_priority_minutes'] + ' : ')} || {wait}"),
        _li(f"{OT.q(lab['people_waiting'] + ' : ')} || {waiting}"),
        _li(f"{total_label} || ' : ' || {total}"),
        _li(f"{OT.q(lab['stretcher_occupancy_pct'] + ' : ')} || {occ}"),
        f"(CASE WHEN {site} % 5 = 0 THEN {_li(OT.q(lab['stretcher_occupancy_pct'] + ' : 12 %'))} ELSE '' END)",
        f"(CASE WHEN {site} % 7 = 0 THEN {_li(OT.q('Data unavailable'))} ELSE '' END)",
        _li(f"{OT.q(lab['avg_wait_room_minutes_prev_day'] + ' : ')} || {room}"),
        _li(f"{OT.q(lab['avg_stretcher_wait_minutes_prev_day'] + ' : ')} || {stretcher}"),
    ])
    address = (f"(CASE WHEN {site} % 11 = 0 THEN '' ELSE '<div class=\"adresse\">' || {_site_address(site)} || "
               f"{OT.q('<br>Région ')} || {_s(f'{site} % 5')} || '</div>' END)")
    return (f"""('<div class="hospital_element"><ul><li class="title"><span class="font-weight-bold">' || {name} || """
            f"""'</span></li>' || {items} || '</ul>' || {address} || '</div>')""")


def _anchors_sql(p: str) -> str:
    pages = "array_to_string(list_transform(range(1, 4), lambda k: CASE WHEN k <= " + p + " % 3 + 1 THEN " \
            "'<a data-page=\"' || CAST(k AS VARCHAR) || '\" href=\"/en/er?page=' || CAST(k AS VARCHAR) || '\">' || CAST(k AS VARCHAR) || '</a>' " \
            "ELSE '' END), '')"
    extra = (f"(CASE WHEN {p} % 4 = 0 THEN {OT.q(f'<a href=\"{L.SITE_PREFIX}/en/er?page=9\" data-page=\"9\">9</a>')} ELSE '' END) || "
             f"(CASE WHEN {p} % 5 = 0 THEN {OT.q('<a data-page=\"0\" href=\"\">0</a>')} ELSE '' END)")
    return f"('<nav>' || {pages} || {extra} || '</nav>')"


SQL_ER_PAGES = f"""
  SELECT page_id, url, CASE WHEN contains(html, '</body>') THEN left(html, length(html) - length(split_part(html, '</body>', -1)) - 7) ELSE html END
    || array_to_string(list_transform(range(1, {D.ER_MAX_BLOCKS + 1}), lambda j: CASE WHEN j <= page_id % 4 THEN {_block_sql('page_id', 'j')} ELSE '' END), '')
    || {_anchors_sql('page_id')} || '</body>' || CASE WHEN contains(html, '</body>') THEN split_part(html, '</body>', -1) ELSE '</html>' END AS html
  FROM pages"""


# --------------------------------------------------------------------------- SQL twin of the parse
def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_WS}+|{PY_WS}+$', '', 'g')"


def _num(v: str) -> str:
    return f"CAST(trunc(TRY_CAST(nullif(regexp_extract(replace({v}, ',', '.'), '(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE)) AS INTEGER)"


_HHMM = r"^\s*(\d{1,2}):(\d{2})\s*$"


def _minutes(v: str) -> str:
    return (f"(CASE WHEN regexp_matches({v}, '{_HHMM}') THEN CAST(regexp_extract({v}, '{_HHMM}', 1) AS INTEGER) * 60 "
            f"+ CAST(regexp_extract({v}, '{_HHMM}', 2) AS INTEGER) ELSE {_num(v)} END)")


_PARSE_SQL = {
    "wait_time_non_priority_minutes": _minutes,
    "people_waiting": _num,
    "total_people_er": _num,
    "stretcher_occupancy_pct": lambda v: f"CAST({_num(v)} AS DOUBLE)",
    "avg_wait_room_minutes_prev_day": _minutes,
    "avg_stretcher_wait_minutes_prev_day": _minutes,
}


def _metric(name: str) -> str:
    from careflow.functions.text import literal_normalize_main

    v = f"list_filter(pairs, lambda p: p.label = {OT.q(literal_normalize_main(L.METRIC_LABELS[name]))})[-1].value"
    return f"{_PARSE_SQL[name](v)} AS {name}"


_ITEM = "trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
SQL_BLOCKS = f"""
  SELECT page_id, source_url, block_pos, facility_name_raw, coalesce(lines[1], '') AS address_raw, coalesce(lines[2], '') AS region,
    {", ".join(_metric(n) for n in ER.METRIC_COLUMNS)}, raw_html_fragment
  FROM (
    SELECT *, list_transform(list_filter(items, lambda x: contains(x, ':')), lambda x: struct_pack(
        label := {OT.norm_main("split_part(x, ':', 1)")}, value := {_strip("substr(x, strpos(x, ':') + 1)")})) AS pairs
    FROM (
      SELECT page_id, url AS source_url, CAST(i - 1 AS INTEGER) AS block_pos,
        replace(regexp_extract(body, '<span class="font-weight-bold">(.*?)</span>', 1), '&amp;', '&') AS facility_name_raw,
        list_filter(list_transform(string_split(regexp_extract(body, '<div class="adresse">(.*?)</div>', 1), '<br>'), lambda x: trim(x)), lambda x: x <> '') AS lines,
        list_transform(regexp_extract_all(body, '<li class="hopital-item">(.*?)</li>', 1), lambda x: {_ITEM}) AS items,
        '<div class="hospital_element">' || body AS raw_html_fragment
      FROM (
        SELECT page_id, url, i, regexp_extract(part, '(?s)^(<ul>.*?</ul>(?:<div class="adresse">.*?</div>)?</div>)', 1) AS body
        FROM (SELECT page_id, url, unnest(parts) AS part, unnest(range(0, len(parts))) AS i
              FROM (SELECT page_id, url, string_split(html, '<div class="hospital_element">') AS parts FROM erp) _s0) _s1
        WHERE i >= 1) _s2
      WHERE contains(body, '<div class="adresse">')) _s3) _s4"""
SQL_FIRST = f"""
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY facility_name_raw, address_raw ORDER BY source_url, page_id, block_pos) AS rn
    FROM ({SQL_BLOCKS}) _b) _f WHERE rn = 1"""
SQL_RECORDS = f"""
  SELECT *, 'scrape_' || substr(sha256(concat_ws(chr(1), source_url, CAST(page_id AS VARCHAR), CAST(block_pos AS VARCHAR), '{D.ER_SCRAPED_AT}')), 1, 16) AS scrape_id,
    TIMESTAMP '{D.ER_SCRAPED_AT}' AS scraped_at
  FROM ({SQL_FIRST}) _r"""
_GOLD = ", ".join(ER.GOLD_COLUMNS)


def _er_sql(body: str) -> str:
    return f"WITH erp AS ({SQL_ER_PAGES}),\nrec AS ({SQL_RECORDS})\n{body}"


def _records(spark, sf):
    blocks = ER.parse_blocks(ER.html_blocks(D.er_pages(spark, sf)))
    return ER.with_scrape(ER.first_per_site(blocks), D.ER_SCRAPED_AT)


@register("er_blocks", f"WITH erp AS ({SQL_ER_PAGES})\nSELECT * FROM ({SQL_BLOCKS}) _q")
def q_er_blocks(spark, sf):
    """A6 + A7 + H4-H6: every hospital block (with title and address) of every page, metrics typed."""
    return ER.parse_blocks(ER.html_blocks(D.er_pages(spark, sf)))


@register("er_pages_gold", _er_sql(f"SELECT {_GOLD} FROM rec"))
def q_er_pages_gold(spark, sf):
    """A9 + A11: first record per site, 12 gold columns."""
    return ER.gold_rows(_records(spark, sf))


@register(
    "er_pages_silver",
    _er_sql(f"SELECT {_GOLD}, {OT.norm_main('facility_name_raw')} AS normalized_facility_name, "
            f"{OT.norm_main('address_raw')} AS normalized_address FROM rec"),
)
def q_er_pages_silver(spark, sf):
    """Gold plus normalized name and address."""
    return ER.silver_rows(_records(spark, sf))


_PAYLOAD = "'{' || " + " || ', ' || ".join(
    f"""'"{n}": ' || coalesce(CAST({n} AS VARCHAR), 'null')""" for n in ER.METRIC_COLUMNS) + " || '}'"


@register(
    "er_pages_bronze",
    _er_sql(f"""SELECT scrape_id, source_url, raw_html_fragment, facility_name_raw, address_raw, region AS region_raw,
      {_PAYLOAD} AS metric_payload, scraped_at FROM rec"""),
)
def q_er_pages_bronze(spark, sf):
    """A10: raw fragment and JSON metric payload per kept record."""
    return ER.bronze_rows(_records(spark, sf))


@register(
    "er_page_links",
    f"""WITH erp AS ({SQL_ER_PAGES})
  SELECT page_id, url, list_sort(list_distinct(list_concat([url], list_transform(list_filter(list_transform(
      regexp_extract_all(html, '(<a\\s[^>]*\\bdata-page\\b[^>]*>)', 1),
      lambda t: regexp_extract(t, '\\bhref\\s*=\\s*"([^"]*)"', 1)), lambda h: h <> ''),
      lambda h: CASE WHEN starts_with(h, 'http') THEN h ELSE {OT.q(L.SITE_PREFIX)} || h END)))) AS page_urls
  FROM erp""",
)
def q_er_page_links(spark, sf):
    """A8 + G2: the page URL set (own URL plus pagination links) of every page."""
    return ER.page_links(D.er_pages(spark, sf))


# --------------------------------------------------------------------------- matching, overrides, upsert
from pyspark.sql import functions as F  # noqa: E402

from careflow.operators import match as MT  # noqa: E402
from careflow.plans.oracle_domain import with_ctes  # noqa: E402


def _register_candidates(spark, sf):
    return D.facility_master(spark, sf).withColumn("register_order", F.col("index").cast("long"))


def _tokens_sql(norm: str) -> str:
    return f"list_distinct(list_filter(string_split({norm}, ' '), lambda t: t <> ''))"


def _lcs_sql(a: str, b: str) -> str:
    """Bit-parallel longest common subsequence over 128-bit masks (leftovers of names and addresses are shorter)."""
    masks = f"list_transform(range(1, length({b}) + 1), lambda j: coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = substr({b}, j, 1) THEN 1::HUGEINT << (i - 1)::INTEGER ELSE 0::HUGEINT END)), 0)::HUGEINT)"
    full = f"((1::HUGEINT << length({a})::INTEGER) - 1)"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count(list_reduce({masks}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})) END)"


def _ratio_sql(p: str) -> str:
    s, la, lb, sep = f"{p}_s", f"{p}_la", f"{p}_lb", f"(CASE WHEN {p}_s > 0 THEN 1.0 ELSE 0.0 END)"
    both = f"(2 * ({s} + {sep}) + {la} + {lb})"
    base = f"(CASE WHEN {both} > 0 THEN 100.0 - 100.0 * ({la} + {lb} - 2 * {p}_lcs) / {both} ELSE 100.0 END)"
    one = lambda x: f"(100.0 - 100.0 * ({sep} + {x}) / (2 * {s} + {sep} + {x}))"
    return f"""(CASE WHEN len({p}_l) = 0 OR len({p}_r) = 0 THEN 0.0 WHEN {p}_n > 0 AND ({la} = 0 OR {lb} = 0) THEN 100.0
      WHEN {s} = 0 THEN {base} ELSE greatest({base}, {one(la)}, {one(lb)}) END)"""


def _fuzzy_ctes(sites: str) -> str:
    """CTEs that score every site (relation with the key and matched_at) against every register row."""
    left = lambda p, x, y: f"array_to_string(list_sort(list_filter({p}_{x}, lambda t: NOT list_contains({p}_{y}, t))), ' ') AS {p}_d{x}"
    return f"""
  fsite AS (SELECT *, {_tokens_sql(OT.norm_main('facility_name_raw'))} AS n_l, {OT.norm_main('address_raw')} AS la FROM {sites}),
  freg AS (SELECT facility_id_normalized AS rid, facility_name AS rname, CAST("index" AS BIGINT) AS ord, {_tokens_sql(OT.norm_main('facility_name'))} AS n_r,
    {_tokens_sql(OT.norm_main('full_address'))} AS a_r, CASE WHEN coalesce(city, '') <> '' THEN {OT.norm_main('city')} END AS rc FROM fm),
  fp0 AS (SELECT *, {_tokens_sql('la')} AS a_l FROM fsite CROSS JOIN freg),
  fp1 AS (SELECT *, {", ".join(f"len(list_intersect({p}_l, {p}_r)) AS {p}_n, length(array_to_string(list_intersect({p}_l, {p}_r), ' '))::DOUBLE AS {p}_s, {left(p, 'l', 'r')}, {left(p, 'r', 'l')}" for p in "na")} FROM fp0),
  fp2 AS (SELECT *, {", ".join(f"length({p}_dl)::DOUBLE AS {p}_la, length({p}_dr)::DOUBLE AS {p}_lb, {_lcs_sql(f'{p}_dl', f'{p}_dr')}::DOUBLE AS {p}_lcs" for p in "na")} FROM fp1),
  fp3 AS (SELECT *, {L.MATCH_WEIGHTS[0]}::DOUBLE * {_ratio_sql('n')} + {L.MATCH_WEIGHTS[1]}::DOUBLE * {_ratio_sql('a')} + {L.MATCH_WEIGHTS[2]}::DOUBLE * (CASE WHEN rc IS NOT NULL AND contains(la, rc) THEN 100.0 ELSE 0.0 END) AS sc FROM fp2),
  fuzzy AS (SELECT facility_name_raw, address_raw, rid AS matched_facility_id, rname AS matched_facility_name, round_even(sc / 100.0, 4) AS match_confidence,
    CASE WHEN sc >= {L.MATCH_EXACTISH_THRESHOLD} THEN 'exactish' ELSE 'fuzzy' END AS match_method, false AS manually_validated, matched_at
    FROM (SELECT *, row_number() OVER (PARTITION BY facility_name_raw, address_raw ORDER BY sc DESC, ord) AS rn FROM fp3) _q WHERE rn = 1)"""


def _with_fuzzy(body: str, sites: str, pages: bool) -> str:
    head = with_ctes("SELECT 1").removeprefix("WITH ").rsplit("\nSELECT 1", 1)[0]
    er = f"erp AS ({SQL_ER_PAGES}),\nrec AS ({SQL_RECORDS}),\n" if pages else ""
    return f"WITH {er}{head},\n{_fuzzy_ctes(sites).strip()}\n{body}"


_LIVE_SITES = "(SELECT facility_name_raw, address_raw, max(scraped_at) AS matched_at FROM live GROUP BY facility_name_raw, address_raw)"
_PAGE_SITES = "(SELECT facility_name_raw, address_raw, max(scraped_at) AS matched_at FROM rec GROUP BY facility_name_raw, address_raw)"


@register("fuzzy_match", _with_fuzzy("SELECT * FROM fuzzy", _LIVE_SITES, False))
def q_fuzzy_match(spark, sf):
    """C5 + E3: best register row for every live site (token-set ratios; LCS in a pandas UDF)."""
    return MT.fuzzy_match(D.live_status(spark, sf), _register_candidates(spark, sf))


SQL_OVERRIDDEN = """
  SELECT m.facility_name_raw, m.address_raw,
    CASE WHEN o.hit THEN o.oid ELSE m.matched_facility_id END AS matched_facility_id,
    CASE WHEN o.hit THEN o.oname ELSE m.matched_facility_name END AS matched_facility_name,
    CASE WHEN o.hit THEN 1.0 ELSE m.match_confidence END AS match_confidence,
    CASE WHEN o.hit THEN 'manual_override' ELSE m.match_method END AS match_method,
    CASE WHEN o.hit THEN true ELSE m.manually_validated END AS manually_validated, m.matched_at
  FROM fmatch m LEFT JOIN (
    SELECT facility_name_raw, address_raw, matched_facility_id AS oid, matched_facility_name AS oname, true AS hit FROM (
      SELECT *, row_number() OVER (PARTITION BY facility_name_raw, address_raw ORDER BY updated_at DESC, matched_facility_id DESC) AS rn
      FROM overrides) _o WHERE rn = 1) o
  ON m.facility_name_raw = o.facility_name_raw AND m.address_raw = o.address_raw"""


@register("match_overrides", with_ctes(SQL_OVERRIDDEN))
def q_match_overrides(spark, sf):
    """Manual overrides (latest version per key) applied to every match row."""
    return MT.apply_overrides(D.facility_match(spark, sf), D.manual_overrides(spark, sf))


def _pending_sites(gold):
    """New live sites from the page scrape, inserted unmatched until reviewed."""
    return gold.select(*MT.MATCH_KEY, "scraped_at").groupBy(*MT.MATCH_KEY).agg(F.max("scraped_at").alias("matched_at")).select(
        *MT.MATCH_KEY, F.lit(None).cast("string").alias("matched_facility_id"), F.lit(None).cast("string").alias("matched_facility_name"),
        F.lit(0.0).alias("match_confidence"), F.lit("pending").alias("match_method"), F.lit(False).alias("manually_validated"), "matched_at")


def _match_upsert_sql() -> str:
    ctes = with_ctes("SELECT 1").removeprefix("WITH ").rsplit("\nSELECT 1", 1)[0]
    return (
        f"WITH erp AS ({SQL_ER_PAGES}),\nrec AS ({SQL_RECORDS}),\n{ctes},\novr AS ({SQL_OVERRIDDEN}),\n"
        """src AS (
  SELECT * FROM ovr WHERE match_method = 'manual_override'
  UNION ALL
  SELECT facility_name_raw, address_raw, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0.0, 'pending', false, max(scraped_at)
  FROM rec GROUP BY facility_name_raw, address_raw)
SELECT t.* FROM fmatch t WHERE NOT EXISTS (
  SELECT 1 FROM src s WHERE s.facility_name_raw = t.facility_name_raw AND s.address_raw = t.address_raw)
UNION ALL SELECT * FROM src""")


@register("match_upsert", _match_upsert_sql())
def q_match_upsert(spark, sf):
    """Overridden matches update, newly scraped sites insert; every other stored match is kept."""
    ovr = MT.apply_overrides(D.facility_match(spark, sf), D.manual_overrides(spark, sf))
    src = ovr.filter(F.col("match_method") == "manual_override").unionByName(_pending_sites(_records(spark, sf)))
    return MT.upsert(D.facility_match(spark, sf), src)


def match_refresh_sql() -> str:
    overridden = SQL_OVERRIDDEN.replace("FROM fmatch m", "FROM fuzzy m")
    return _with_fuzzy(f""", src AS ({overridden})
SELECT t.* FROM fmatch t WHERE NOT EXISTS (
  SELECT 1 FROM src s WHERE s.facility_name_raw = t.facility_name_raw AND s.address_raw = t.address_raw)
UNION ALL SELECT * FROM src""", _PAGE_SITES, True)


@register("match_refresh", match_refresh_sql())
def q_match_refresh(spark, sf):
    """L1 refresh: scraped sites fuzzy-matched to the register, overrides applied, upserted into the stored matches."""
    gold = ER.gold_rows(_records(spark, sf))
    new = MT.apply_overrides(MT.fuzzy_match(gold, _register_candidates(spark, sf)), D.manual_overrides(spark, sf))
    return MT.upsert(D.facility_match(spark, sf), new)
