"""URL resolution, page, document and mailbox queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import duck as d
from bindings import oracles as o
from bindings import relations as rel
from bindings.queries import AS_OF, alerts, big, query
from bindings.state_queries import stored
from leadsift import rules as r
from leadsift.functions import html as h
from leadsift.functions import text as t
from leadsift.functions.urls import is_blocked_url, is_rejected_url, squash, title_tokens, url_host, url_path
from leadsift.operators import pages as pg
from leadsift.operators import resolve as rs
from leadsift.operators import segments as sg
from leadsift.operators.state import set_canonical_urls, set_descriptions
from leadsift.plans.sql_functions import register_functions
from leadsift.sources import landing, mailbox, message_files

# --- URL resolution --------------------------------------------------------------
_STATE = ("state", rel.STATE)
_HITS = ("hits", rel.SEARCH_HITS)


def search_hits(spark, sf):
    return rel.relation(spark, sf, rel.SEARCH_HITS)


@query(
    "search_queries",
    o._with(
        _STATE, ("bases", """SELECT id, '"' || company || '" "' || title || '"' || CASE WHEN location IS NOT NULL THEN ' "' || location || '"' ELSE '' END AS base FROM state"""),
        final=" UNION ALL ".join(
            [f"SELECT id AS opportunity_key, CAST({i} AS BIGINT) AS query_idx, 'site:{s} ' || base AS query FROM bases" for i, s in enumerate(r.SEARCH_SITES)]
            + [f"SELECT id, {5 + i}, base || ' {w}' FROM bases" for i, w in enumerate(r.SEARCH_WORDS)]
        ),
    ),
)
def search_queries(spark, sf):
    return rs.query_rows(stored(spark, sf)).select("opportunity_key", big("query_idx"), "query")


_HOST = d.host("url")
_REJ = "(" + " OR ".join(f"{_HOST} = '{x}' OR suffix({_HOST}, '.{x}')" for x in r.REJECTED_HOSTS) + ")"


@query(
    "url_parts",
    o._with(
        ("urls", "SELECT page_id, url FROM pages"),
        final=f"SELECT page_id, {_HOST} AS host, {d.path('url')} AS path, {d.squash('url')} AS squashed, {_REJ} AS rejected, array_to_string(list_filter(regexp_extract_all(lower(url), '[a-z0-9]{{3,}}'), lambda w: w NOT IN ({', '.join(map(d.s, r.TITLE_STOP_WORDS))})), ' ') AS tokens FROM urls",
    ),
)
def url_parts(spark, sf):
    u = F.col("url")
    return rel.table(spark, sf, "pages").select(
        "page_id", url_host(u).alias("host"), url_path(u).alias("path"), squash(u).alias("squashed"),
        is_rejected_url(u).alias("rejected"), F.array_join(title_tokens(u), " ").alias("tokens"),
    )


_SCORED_HITS = f"""
  SELECT *, CASE WHEN {_REJ} OR (len(tok) > 0 AND matched = 0) OR (NOT ats AND NOT (in_text AND in_host AND in_url AND NOT generic)) THEN 0
    ELSE greatest(0, CASE WHEN ats THEN 80 WHEN in_host THEN 60 WHEN career THEN 30 ELSE 0 END + CASE WHEN in_text THEN 15 ELSE 0 END
      + CASE WHEN len(tok) > 0 THEN CAST(round_even(25.0 * matched / len(tok), 0) AS INT) ELSE 0 END - CASE WHEN NOT career AND NOT ats THEN 20 ELSE 0 END) END AS candidate_score
  FROM (SELECT *, len(list_filter(tok, lambda w: contains(stext, w))) AS matched, len(list_filter(tok, lambda w: contains(host || ' ' || path, w))) > 0 AS in_url,
      ckey <> '' AND contains({d.squash('stext')}, ckey) AS in_text, ckey <> '' AND contains({d.squash('host')}, ckey) AS in_host,
      {d.any_in('host', r.ATS_MARKERS)} AS ats, {d.any_in('path', r.CAREER_PATH_WORDS)} AS career, trim(path, '/') IN ({', '.join(map(d.s, r.GENERIC_PATHS))}) AS generic
    FROM (SELECT *, lower(hit_title || ' ' || snippet || ' ' || url) AS stext, {_HOST} AS host, {d.path('url')} AS path, {d.squash('company')} AS ckey,
        list_filter(regexp_extract_all(lower(title), '[a-z0-9]{{3,}}'), lambda w: w NOT IN ({', '.join(map(d.s, r.TITLE_STOP_WORDS))})) AS tok FROM joined) a) b
"""
_FIRST = """SELECT x.* FROM hits x JOIN (SELECT opportunity_key, query_idx, min(provider_rank) AS provider_rank FROM hits GROUP BY ALL) m USING (opportunity_key, query_idx, provider_rank)"""
_JOINED = "SELECT f.opportunity_key, f.query_idx, f.result_idx, f.url, f.title AS hit_title, f.snippet, s.company, s.title FROM first_hits f JOIN state s ON CAST(s.id AS STRING) = f.opportunity_key"
_BEST = """SELECT opportunity_key, url AS canonical_url, candidate_score FROM (
  SELECT *, row_number() OVER (PARTITION BY opportunity_key ORDER BY candidate_score DESC, query_idx, result_idx) AS rn FROM (
    SELECT *, row_number() OVER (PARTITION BY opportunity_key, url ORDER BY query_idx, result_idx) AS rn1 FROM scored_hits) a
  WHERE rn1 = 1 AND candidate_score > 0) b WHERE rn = 1"""
_RESOLVE = (_STATE, _HITS, ("first_hits", _FIRST), ("joined", _JOINED), ("scored_hits", _SCORED_HITS), ("best", _BEST))


def keyed_state(spark, sf):
    return stored(spark, sf).withColumn("key", F.col("id").cast("string"))


@query("first_provider_hits", o._with(_HITS, ("first_hits", _FIRST), final="SELECT opportunity_key, CAST(query_idx AS BIGINT) AS query_idx, CAST(provider_rank AS BIGINT) AS provider_rank, result_idx, url FROM first_hits"))
def first_provider_hits(spark, sf):
    return rs.first_provider(search_hits(spark, sf)).select(
        "opportunity_key", big("query_idx"), big("provider_rank"), "result_idx", "url"
    )


@query("candidate_scores", o._with(*_RESOLVE[:5], final="SELECT opportunity_key, result_idx, url, CAST(candidate_score AS BIGINT) AS candidate_score FROM scored_hits"))
def candidate_scores(spark, sf):
    hits = rs.first_provider(search_hits(spark, sf)).withColumnRenamed("title", "hit_title")
    wanted = keyed_state(spark, sf).select(F.col("key").alias("opportunity_key"), "company", "title")
    return rs.score_hits(hits.join(wanted, "opportunity_key")).select(
        "opportunity_key", "result_idx", "url", big("candidate_score")
    )


@query("canonical_urls", o._with(*_RESOLVE, final="SELECT opportunity_key, canonical_url, CAST(candidate_score AS BIGINT) AS candidate_score FROM best"))
def canonical_urls(spark, sf):
    found = rs.resolve(keyed_state(spark, sf), search_hits(spark, sf), "key")
    return found.select("opportunity_key", "canonical_url", big("candidate_score"))


@query("state_with_canonical_urls", o._with(*_RESOLVE, final="SELECT s.id, coalesce(b.canonical_url, s.canonical_url) AS canonical_url FROM state s LEFT JOIN best b ON CAST(s.id AS STRING) = b.opportunity_key"))
def state_with_canonical_urls(spark, sf):
    found = rs.resolve(keyed_state(spark, sf), search_hits(spark, sf), "key")
    updates = found.select(F.col("opportunity_key").cast("bigint").alias("id"), "canonical_url")
    return set_canonical_urls(stored(spark, sf), updates, AS_OF).select("id", "canonical_url")


_PAYLOADS = f"""
  SELECT CAST(page_id AS STRING) AS opportunity_key, CAST(page_id % 3 AS INT) AS query_idx, CAST(page_id % 4 AS INT) AS provider_rank,
    {rel.pick('page_id % 4', *rel.q('serper', 'serpapi', 'brave', 'google'))} AS provider,
    {rel.pick('page_id % 4',
      "'{\"organic\": [{\"link\": \"' || url || '\", \"title\": \"T\", \"snippet\": \"S\"}, {\"title\": \"no link\"}]}'",
      "'{\"organic_results\": [{\"link\": \"' || url || '\"}, {\"link\": \"' || url || '/b\", \"title\": \"B\"}]}'",
      "'{\"web\": {\"results\": [{\"url\": \"' || url || '\", \"title\": \"W\", \"description\": \"D\"}]}}'",
      "(CASE WHEN page_id % 8 = 3 THEN 'not json' ELSE '{\"items\": [{\"link\": \"' || url || '\", \"snippet\": \"G\"}]}' END)")} AS payload
  FROM {{pages}}
"""


@query(
    "parsed_hits",
    o._with(
        ("p", "SELECT *, CAST(page_id AS VARCHAR) AS k, CAST(page_id % 3 AS BIGINT) AS qi, CAST(page_id % 4 AS BIGINT) AS pr FROM pages"),
        final="""SELECT k AS opportunity_key, qi AS query_idx, pr AS provider_rank, CAST(0 AS BIGINT) AS result_idx, url,
            CASE pr WHEN 0 THEN 'T' WHEN 2 THEN 'W' ELSE '' END AS title, CASE pr WHEN 0 THEN 'S' WHEN 2 THEN 'D' WHEN 3 THEN 'G' ELSE '' END AS snippet FROM p WHERE page_id % 8 <> 3
          UNION ALL SELECT k, qi, pr, 1, url || '/b', 'B', '' FROM p WHERE pr = 1""",
    ),
)
def parsed_hits(spark, sf):
    hits = landing.parse_hits(rel.relation(spark, sf, _PAYLOADS))
    return hits.select(
        "opportunity_key", big("query_idx"), big("provider_rank"), big("result_idx"), "url", "title", "snippet"
    )


# --- pages -------------------------------------------------------------------------
def _markup(e: str) -> str:
    hidden = "|".join(rf"<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in r.HIDDEN_TAGS)
    return d.replace(e, rf"(?is)<!--.*?-->|{hidden}|<[!/?a-z][^>]*>", "\n")


def _unescape(e: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        e = f"replace({e}, {d.s(name)}, {d.s(char)})"
    return e


def _visible(e: str) -> str:
    return d.paragraphs(_unescape(_markup(e)))


_MARKED = f"(length(x) >= 120 AND {d.count_in('lower(x)', r.DESCRIPTION_MARKERS)} >= 2)"
_ARTICLE = d.extract("html", r"(?is)<article\b[^>]*>.*?</article\s*>", 0)
_CHROME = r"(?is)<nav\b[^>]*>.*?</nav\s*>|<header\b[^>]*>.*?</header\s*>|<footer\b[^>]*>.*?</footer\s*>|<aside\b[^>]*>.*?</aside\s*>|<form\b[^>]*>.*?</form\s*>"
_PAGE_TEXT = (
    f"CASE WHEN {d.let(_visible(_ARTICLE), 'x', _MARKED)} THEN {_visible(_ARTICLE)} "
    f"ELSE coalesce(nullif({_visible(d.replace(f'coalesce(nullif({_ARTICLE}, chr(0)), html)', _CHROME, chr(10)))}, ''), {_visible('html')}) END"
).replace("chr(0)", "''")


@query("visible_texts", f"SELECT page_id, {_visible('html')} AS text FROM pages")
def visible_texts(spark, sf):
    return rel.table(spark, sf, "pages").select("page_id", h.visible_text(F.col("html")).alias("text"))


@query("page_texts", f"SELECT page_id, {_PAGE_TEXT} AS text FROM pages")
def page_texts(spark, sf):
    return rel.table(spark, sf, "pages").select("page_id", h.page_text(F.col("html")).alias("text"))


_TITLE_TAG = r"(?is)<title>(.*?)</title>"


@query(
    "page_texts_own_extractor",
    f"""SELECT page_id, CASE WHEN {d.let(_visible(_ARTICLE), 'x', _MARKED)} THEN {_visible(_ARTICLE)}
      ELSE coalesce(nullif({d.paragraphs(d.extract('html', _TITLE_TAG, 1))}, ''), {_visible('html')}) END AS text FROM pages""",
)
def page_texts_own_extractor(spark, sf):
    """The main-content step replaced by the user's own, here the page's title."""
    text = h.page_text(F.col("html"), lambda html: F.regexp_extract(html, _TITLE_TAG, 1))
    return rel.table(spark, sf, "pages").select("page_id", text.alias("text"))


_SNAPSHOTS = f"""
  SELECT url, CASE WHEN page_id % 17 = 0 THEN 'https://www.linkedin.com/ssr-login/' ELSE url || '?final' END AS final_url,
    CASE WHEN page_id % 3 = 0 THEN 'text/html; charset=utf-8' END AS content_type,
    CASE WHEN page_id % 13 = 0 THEN 'We''re signing you in' || {rel.NL} || 'Discover people, jobs, and more' || {rel.NL} || html WHEN page_id % 19 = 0 THEN '' WHEN page_id % 23 = 0 THEN 'LinkedIn login' ELSE html END AS html,
    CASE WHEN page_id % 11 = 0 THEN 'HTTP 404' END AS fetch_error, page_id AS fetched_at
  FROM {{pages}}
"""
_FLAT = d.squeeze("lower(text)")
_DESCRIBED = f"""
  SELECT url, final_url, fetch_error, text,
    CASE WHEN fetch_error IS NOT NULL THEN fetch_error WHEN text = '' THEN 'no readable text found'
      WHEN {d.any_in('lower(text)', r.AUTHWALL_PHRASES)} THEN 'authwall detected'
      WHEN contains(lower(final_url), 'linkedin.com/ssr-login') OR (contains({_FLAT}, 'we''re signing you in') AND contains({_FLAT}, 'discover people, jobs, and more'))
        OR (contains({_FLAT}, 'linkedin') AND {d.count_in(_FLAT, r.LOGIN_WALL_PHRASES)} >= 3) THEN 'login wall detected'
      WHEN length(text) < 500 THEN 'description text below 500 characters' END AS error
  FROM (SELECT *, CASE WHEN contains(coalesce(content_type, ''), 'html') OR contains(lower(left(html, 1000)), '<html') OR contains(lower(left(html, 1000)), '<body')
      OR contains(lower(left(html, 1000)), '<!doctype html') THEN {_PAGE_TEXT} ELSE {d.paragraphs('html')} END AS text FROM snaps) s
"""
_DESC = (("snaps", _SNAPSHOTS), ("described", _DESCRIBED))


@query("whole_page_descriptions", o._with(*_DESC, final="SELECT url, final_url, CASE WHEN error IS NULL THEN text END AS description, error FROM described"))
def whole_page_descriptions(spark, sf):
    return pg.describe_pages(rel.relation(spark, sf, _SNAPSHOTS)).select("url", "final_url", "description", "error")


@query("described_pages", o._with(*_DESC, final="SELECT url, final_url, CASE WHEN error IS NULL THEN left(text, 20000) END AS description, error FROM described"))
def described_pages(spark, sf):
    return pg.describe_pages(rel.relation(spark, sf, _SNAPSHOTS), max_chars=20_000).select("url", "final_url", "description", "error")


# Stored rows that point at real pages: every part row takes a page by number.
_LINKED = """
  SELECT s.* EXCLUDE (job_link, canonical_url), CASE WHEN s.id % 5 = 0 THEN 'https://www.linkedin.com/jobs/view/1' WHEN s.id % 7 = 0 THEN 'https://nowhere.example/' ELSE p.url END AS job_link,
    CASE WHEN s.id % 10 = 0 THEN p.url END AS canonical_url
  FROM state s LEFT JOIN pages p ON p.page_id = s.id % (SELECT count(*) FROM pages)
"""
_RESULTS = """
  SELECT l.id, CASE WHEN n.error IS NULL THEN n.text END AS description,
    CASE WHEN l.canonical_url IS NULL AND l.id % 5 = 0 THEN 'linkedin_blocked' WHEN n.url IS NOT NULL AND n.error IS NULL THEN 'fetched' ELSE 'fetch_failed' END AS status,
    CASE WHEN l.canonical_url IS NOT NULL THEN 'canonical_url' WHEN l.id % 5 = 0 THEN 'linkedin_alert_only' ELSE 'source_url' END AS source,
    CASE WHEN l.canonical_url IS NULL AND l.id % 5 = 0 THEN 'LinkedIn alert URL has no canonical posting URL.' WHEN n.url IS NULL THEN 'page snapshot missing' ELSE n.error END AS error,
    CASE WHEN l.canonical_url IS NULL AND l.id % 5 = 0 THEN l.job_link WHEN n.url IS NULL THEN coalesce(l.canonical_url, l.job_link) ELSE n.final_url END AS final_url
  FROM linked l LEFT JOIN newest n ON n.url = CASE WHEN l.canonical_url IS NOT NULL THEN l.canonical_url WHEN l.id % 5 = 0 THEN NULL ELSE l.job_link END
"""
_FETCH = (_STATE, ("snaps", f"SELECT * FROM ({_SNAPSHOTS}) q QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC) = 1"), ("newest", _DESCRIBED), ("linked", _LINKED), ("results", _RESULTS))


def linked_state(spark, sf):
    pages = rel.table(spark, sf, "pages").select(F.col("page_id").alias("_p"), F.col("url").alias("_url"))
    n = pages.agg(F.count(F.lit(1)).alias("_n"))
    rows = stored(spark, sf).crossJoin(F.broadcast(n)).withColumn("_p", F.col("id") % F.col("_n"))
    rows = rows.join(pages, "_p", "left")
    link = (
        F.when(F.col("id") % 5 == 0, "https://www.linkedin.com/jobs/view/1")
        .when(F.col("id") % 7 == 0, "https://nowhere.example/")
        .otherwise(F.col("_url"))
    )
    return rows.withColumns(
        {"job_link": link, "source_url": link, "canonical_url": F.when(F.col("id") % 10 == 0, F.col("_url"))}
    ).select(*stored(spark, sf).columns)


@query("page_fetch_results", o._with(*_FETCH, final="SELECT id, description, status, source, error, final_url FROM results"))
def page_fetch_results(spark, sf):
    found = pg.fetch_results(linked_state(spark, sf), rel.relation(spark, sf, _SNAPSHOTS))
    return found.select(
        "id", F.col("job_description").alias("description"), F.col("description_status").alias("status"),
        F.col("description_source").alias("source"), F.col("job_description_error").alias("error"),
        F.col("job_description_url").alias("final_url"),
    )


@query("state_with_descriptions", o._with(*_FETCH, final="SELECT id, description AS job_description, status AS description_status FROM results"))
def state_with_descriptions(spark, sf):
    state = linked_state(spark, sf)
    out = set_descriptions(state, pg.fetch_results(state, rel.relation(spark, sf, _SNAPSHOTS)), AS_OF)
    return out.select("id", "job_description", "description_status")


_LD = f"""
  SELECT p_partkey, '<html><head><SCRIPT id="a" type="application/ld+json">' || {rel.pick('p_partkey % 5',
    "'{\"@type\": \"JobPosting\", \"title\": \"' || p_name || '\", \"description\": \"Makes  ' || p_type || ' things\", \"skills\": [\"' || p_brand || '\", \"SQL\"]}'",
    "'{\"@context\": \"x\", \"@graph\": [{\"@type\": \"Organization\", \"title\": \"no\"}, {\"@type\": [\"Thing\", \"jobposting\"], \"title\": \"' || p_name || '\", \"qualifications\": \"degree\"}]}'",
    "'[{\"@type\": \"JobPosting\", \"title\": \"one ' || p_name || '\"}, {\"@type\": \"JobPosting\", \"responsibilities\": \"two ' || p_brand || '\"}]'",
    "'{broken'",
    "'{\"@type\": \"Product\", \"title\": \"' || p_name || '\"}'")} || '</SCRIPT></head></html>' AS html, p_name, p_type, p_brand
  FROM {{part}}
"""


@query(
    "json_ld_texts",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || chr(10) || 'Makes ' || p_type || ' things' || chr(10) || '[''' || p_brand || ''', ''SQL'']'
         WHEN 1 THEN p_name || chr(10) || 'degree' WHEN 2 THEN 'one ' || p_name || chr(10) || 'two ' || p_brand ELSE '' END AS text FROM part""",
)
def json_ld_texts(spark, sf):
    return rel.relation(spark, sf, _LD).select("p_partkey", h.json_ld_text(F.col("html")).alias("text"))


@query("html_sniff", "SELECT page_id, contains(lower(left(html, 1000)), '<html') OR contains(lower(left(html, 1000)), '<body') OR contains(lower(left(html, 1000)), '<!doctype html') AS is_html FROM pages")
def html_sniff(spark, sf):
    return rel.table(spark, sf, "pages").select("page_id", h.looks_like_html(F.col("html")).alias("is_html"))


@query("decoded_payloads", "SELECT page_id, html AS text FROM pages")
def decoded_payloads(spark, sf):
    pages = rel.table(spark, sf, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "text/html; charset=UTF-8").when(F.col("page_id") % 3 == 1, "text/html; charset=nope")
    return pages.select("page_id", pg.decode_payload(F.encode("html", "UTF-8"), kind).alias("text"))


# --- documents -----------------------------------------------------------------------
# Greedy packing as a recursion over lines; one open segment per document.
_SEGMENTS = """
WITH RECURSIVE lines AS (
  SELECT doc_id, text, i, CASE WHEN i < n THEN ls[i] || chr(10) ELSE ls[i] END AS line, n FROM (
    SELECT doc_id, text, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) AS n, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE length(text) > 4096) u
  WHERE i < n OR ls[i] <> ''),
cuts AS (
  SELECT doc_id, i, 0 AS part, line AS piece, FALSE AS hard FROM lines WHERE length(line) <= 3800
  UNION ALL SELECT doc_id, i, p, substr(line, p * 3800 + 1, 3800), TRUE FROM (SELECT doc_id, i, line, unnest(range(0, CAST(ceil(length(line) / 3800.0) AS BIGINT))) AS p FROM lines WHERE length(line) > 3800) h),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, part) AS k FROM cuts),
walk AS (
  SELECT doc_id, k, CAST(0 AS BIGINT) AS seg, length(piece) AS size, hard FROM ranked WHERE k = 1
  UNION ALL
  SELECT r.doc_id, r.k, CASE WHEN r.hard OR w.hard OR w.size + length(r.piece) > 3800 THEN w.seg + 1 ELSE w.seg END,
    CASE WHEN r.hard OR w.hard OR w.size + length(r.piece) > 3800 THEN length(r.piece) ELSE w.size + length(r.piece) END, r.hard
  FROM walk w JOIN ranked r ON r.doc_id = w.doc_id AND r.k = w.k + 1)
SELECT doc_id, seg AS segment_no, regexp_replace(string_agg(piece, '' ORDER BY k), '\\s+$', '') AS segment FROM walk JOIN ranked USING (doc_id, k) GROUP BY doc_id, seg
UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 4096
"""


@query("document_segments", _SEGMENTS)
def document_segments(spark, sf):
    rows = sg.segment_rows(rel.table(spark, sf, "documents"), "text", "doc_id")
    return rows.select("doc_id", big("segment_no"), "segment")


@query(
    "document_skills",
    f"SELECT doc_id, {d.join(d.hits('low', r.DEFAULT_RULES.skill_labels()))} AS skills, CAST({d.count_in('low', r.TEXT_MARKERS)} AS BIGINT) AS markers FROM (SELECT doc_id, lower(text) AS low FROM documents) l",
)
def document_skills(spark, sf):
    low = rel.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    return low.select(
        "doc_id", F.array_join(t.hits("low", r.DEFAULT_RULES.skill_labels()), "|").alias("skills"),
        big(t.count_hits(F.col("low"), r.TEXT_MARKERS), "markers"),
    )


@query(
    "document_previews",
    f"SELECT doc_id, {d.truncate(d.squeeze('text'), 60)} AS preview, {d.let('text', 'x', _MARKED)} AS described FROM documents",
)
def document_previews(spark, sf):
    text = F.col("text")
    return rel.table(spark, sf, "documents").select(
        "doc_id", t.preview(text, 60).alias("preview"), h.looks_like_description(text).alias("described")
    )


@query("document_paragraphs", f"SELECT doc_id, sha256({d.paragraphs('text')}) AS digest FROM documents")
def document_paragraphs(spark, sf):
    return rel.table(spark, sf, "documents").select("doc_id", F.sha2(t.paragraphs(F.col("text")), 256).alias("digest"))


# --- message sources --------------------------------------------------------------------
_FILES = f"""
  SELECT source_id || '.txt' AS name, CASE WHEN msg_seq % 5 = 0 THEN '' ELSE 'From:  ' || sender || {rel.NL} END ||
    CASE WHEN msg_seq % 7 = 0 THEN 'subject: x' ELSE 'Subject: ' || subject END || {rel.NL} ||
    CASE WHEN msg_seq % 3 = 0 THEN '' ELSE ' ' || {rel.NL} || body || {rel.NL} END AS text FROM ({rel.ALERTS}) a
"""


@query(
    "message_texts",
    o._with(
        ("alerts", rel.ALERTS), ("files", _FILES),
        final=f"""SELECT source_id, CASE WHEN msg_seq % 7 = 0 OR trim(subject) = '' THEN source_id ELSE trim(subject) END AS subject,
          CASE WHEN msg_seq % 5 = 0 THEN 'Unknown' ELSE trim(sender) END AS sender,
          CASE WHEN msg_seq % 3 = 0 THEN {d.strip("CASE WHEN msg_seq % 5 = 0 THEN '' ELSE 'From:  ' || sender || chr(10) END || CASE WHEN msg_seq % 7 = 0 THEN 'subject: x' ELSE 'Subject: ' || subject END")}
               ELSE {d.strip('body')} END AS body FROM alerts""",
    ),
)
def message_texts(spark, sf):
    out = message_files.parse_message_text(rel.relation(spark, sf, _FILES))
    return out.select("source_id", "subject", "sender", "body")


_DUMP = f"""
  SELECT {rel.pick('msg_seq % 4', *rel.q('INBOX', 'Jobs', 'Archive', 'Alerts'))} AS mailbox, msg_seq AS uid,
    CASE WHEN msg_seq % 6 = 0 THEN '' ELSE '<' || {rel._int('msg_seq % 40')} || '@mail.example>' END AS message_id, subject, sender, body
  FROM ({rel.ALERTS}) a
"""
_NEWEST_MAIL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY uid DESC) AS rn FROM dump) w WHERE rn <= 60"
_SCANNED = """SELECT *, CASE mailbox WHEN 'Jobs' THEN 0 WHEN 'Alerts' THEN 1 ELSE 2 END AS rk,
    CASE WHEN message_id <> '' THEN 'mail:' || message_id ELSE 'mail:' || mailbox || ':' || uid END AS source_id FROM newest WHERE mailbox <> 'Archive'"""


def mail_dump(spark, sf):
    """Raw RFC 822 bytes: even uids plain, odd ones multipart with HTML first."""
    m = rel.relation(spark, sf, _DUMP)
    head = F.concat(
        F.lit("From: "), "sender", F.lit("\r\nSubject: "), "subject", F.lit("\r\nDate: Thu, 02 Aug 2001 10:00:00 +0200\r\n"),
        F.when(F.col("message_id") != "", F.concat(F.lit("Message-ID: "), "message_id", F.lit("\r\n"))).otherwise(F.lit("")),
        F.lit("MIME-Version: 1.0\r\n"),
    )
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\n\r\n"), "body")
    mixed = F.concat(
        F.lit('Content-Type: multipart/alternative; boundary="=b="\r\n\r\n--=b=\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>x</p>\r\n--=b=\r\n'),
        plain, F.lit("\r\n--=b=--\r\n"),
    )
    raw = F.concat(head, F.when(F.col("uid") % 2 == 0, plain).otherwise(mixed))
    return m.select("mailbox", "uid", F.encode(raw, "UTF-8").alias("raw"))


@query("newest_mail", o._with(("dump", _DUMP), ("newest", _NEWEST_MAIL), final="SELECT mailbox, uid FROM newest"))
def newest_mail(spark, sf):
    return mailbox.newest_per_mailbox(rel.relation(spark, sf, _DUMP), 60).select("mailbox", "uid")


@query(
    "decoded_mail",
    o._with(
        ("dump", _DUMP),
        final="SELECT mailbox, uid, message_id, subject, sender, CAST(996739200 AS BIGINT) AS received, regexp_replace(body, '\\s+$', '') AS body FROM dump",
    ),
)
def decoded_mail(spark, sf):
    mail = mailbox.decode_messages(mail_dump(spark, sf))
    body = t.rstrip(F.regexp_replace(mailbox.choose_body(), "\r\n", "\n"))
    return mail.select(
        "mailbox", "uid", "message_id", "subject", "sender",
        F.unix_timestamp("received_at").alias("received"), body.alias("body"),
    )


@query(
    "loaded_mail",
    o._with(
        ("dump", _DUMP), ("newest", _NEWEST_MAIL), ("scanned", _SCANNED),
        ("likely", f"SELECT * FROM scanned WHERE {o.relevant(body=chr(39) * 2)}"),
        final="SELECT source_id, subject, sender FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY rk, uid DESC) AS c FROM likely) z WHERE c = 1",
    ),
)
def loaded_mail(spark, sf):
    out = mailbox.load_mailboxes(mail_dump(spark, sf), ["Jobs", "", "Alerts"], "INBOX", 60)
    return out.select("source_id", "subject", "sender")


@query("blocked_links", o._with(_HITS, final=f"SELECT result_idx, url, {_HOST} IN ('linkedin.com', 'www.linkedin.com', 'ca.linkedin.com') AS blocked, {_REJ} AS rejected FROM hits"))
def blocked_links(spark, sf):
    u = F.col("url")
    return search_hits(spark, sf).select("result_idx", "url", is_blocked_url(u).alias("blocked"), is_rejected_url(u).alias("rejected"))


@query("united_mail", "SELECT CAST(o_orderkey AS VARCHAR) AS source_id, 'alert' AS kind FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'card' FROM orders")
def united_mail(spark, sf):
    """Messages of two sources under one schema."""
    one = alerts(spark, sf).withColumn("kind", F.lit("alert"))
    two = rel.relation(spark, sf, rel.CARD_MAIL).withColumn("kind", F.lit("card"))
    return one.unionByName(two, allowMissingColumns=True).select("source_id", "kind")


@query(
    "cards_in_sql",
    o._with(*o.CARDS, final="SELECT source_id, CAST(card_idx AS BIGINT) AS card_idx, company, title, location, job_link FROM card_rows"),
)
def cards_in_sql(spark, sf):
    """The card explode as a SQL user calls it."""
    register_functions(spark, "ls_")
    return spark.sql(
        """SELECT m.source_id, CAST(c.card_idx AS BIGINT) AS card_idx, c.company, c.title, c.location, c.url AS job_link
           FROM {mail} m, LATERAL ls_posting_cards(m.body) c
           WHERE ls_is_posting_digest(m.subject, m.sender, m.body)""",
        mail=rel.relation(spark, sf, rel.CARD_MAIL),
    )


@query(
    "names_in_sql",
    o._with(
        ("alerts", rel.ALERTS),
        final=f"SELECT {d.company('subject')} AS company, min({d.core_title('subject')}) AS first_role, count(*) AS n FROM alerts GROUP BY 1",
    ),
)
def names_in_sql(spark, sf):
    """Scalar functions in grouping and aggregation."""
    register_functions(spark, "ls_")
    return spark.sql(
        """SELECT ls_normalize_company(subject) AS company, min(ls_clean_title(subject)) AS first_role, count(*) AS n
           FROM {mail} GROUP BY 1""",
        mail=alerts(spark, sf),
    )
