"""State, digest, maintenance and command queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import duck as d
from bindings import oracles as o
from bindings import relations as rel
from bindings.queries import AS_OF, big, piped, query
from leadsift import rules as r
from leadsift.functions import dates, labels
from leadsift.functions.labels import normalize_status
from leadsift.operators import commands as cmd
from leadsift.operators import digest, maintenance
from leadsift.operators import state as st
from leadsift.operators.eligibility import fetch_target, source_link
from leadsift.functions.urls import is_blocked_url

NOW = o.AS_OF


def sightings(spark, sf):
    return rel.relation(spark, sf, rel.SIGHTINGS)


def stored(spark, sf):
    """The derived state in full schema."""
    return st.evolve_state(rel.relation(spark, sf, rel.STATE), AS_OF)


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def d_stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


# --- sightings and upsert ------------------------------------------------------
_FOLD = f"""
  SELECT fingerprint, count(*) AS seen_count, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at,
    arg_max({{score: score, category: category, explanation: explanation, company: company, title: title, salary_range: salary_range, work_mode: work_mode, posted_date: posted_date}},
            {{a: seen_at, b: msg_seq, c: card_idx}}) AS latest
  FROM (SELECT *, {d.fingerprint()} AS fingerprint FROM sightings) f GROUP BY fingerprint
"""
_UPSERT_FINAL = f"""
  SELECT fingerprint AS job_fingerprint, CAST(seen_count AS BIGINT) AS seen_count, {d_stamp('first_seen_at')}, {d_stamp('last_seen_at')},
    CAST(latest.score AS BIGINT) AS score, latest.category AS category, latest.explanation AS explanation,
    {d.company('latest.company')} AS company, {d.title('latest.title')} AS title, {d.estimate('latest.salary_range')} AS salary_estimate,
    latest.work_mode AS work_mode, latest.posted_date AS posted_date, 'New' AS status FROM fold
"""
_UPSERT = o._with(("sightings", rel.SIGHTINGS), ("fold", _FOLD), final=_UPSERT_FINAL)


def upsert_view(df):
    return df.select(
        "job_fingerprint", big("seen_count"), stamp("first_seen_at"), stamp("last_seen_at"), big("score"),
        "category", "explanation", "company", "title", "salary_estimate", "work_mode", "posted_date", "status",
    )


@query("sighting_fold", o._with(("sightings", rel.SIGHTINGS), ("fold", _FOLD), final=f"SELECT fingerprint, CAST(seen_count AS BIGINT) AS occurrences, {d_stamp('first_seen_at')}, {d_stamp('last_seen_at')} FROM fold"))
def sighting_fold(spark, sf):
    fold = st.fold_sightings(sightings(spark, sf), seen_at="seen_at")
    return fold.select(
        F.col("job_fingerprint").alias("fingerprint"), big("occurrences"),
        F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen_at"),
        F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_seen_at"),
    )


@query("upsert_into_empty", _UPSERT)
def upsert_into_empty(spark, sf):
    return upsert_view(st.upsert(st.empty_state(spark), sightings(spark, sf), seen_at="seen_at"))


@query("upsert_two_batches", _UPSERT)
def upsert_two_batches(spark, sf):
    seen = sightings(spark, sf)
    early, late = seen.filter("seen_at < '1998-06-01'"), seen.filter("seen_at >= '1998-06-01'")
    first = st.upsert(st.empty_state(spark), early, seen_at="seen_at")
    return upsert_view(st.upsert(first, late, seen_at="seen_at"))


@query("upsert_small_batch", _UPSERT)
def upsert_small_batch(spark, sf):
    seen = sightings(spark, sf)
    early, late = seen.filter("seen_at < '1998-06-01'"), seen.filter("seen_at >= '1998-06-01'")
    first = st.upsert(st.empty_state(spark), early, seen_at="seen_at")
    return upsert_view(st.merge_fold(first, st.fold_sightings(late, seen_at="seen_at")))


@query("upsert_late_first", _UPSERT)
def upsert_late_first(spark, sf):
    seen = sightings(spark, sf)
    early, late = seen.filter("seen_at < '1998-06-01'"), seen.filter("seen_at >= '1998-06-01'")
    first = st.upsert(st.empty_state(spark), late, seen_at="seen_at")
    return upsert_view(st.upsert(first, early, seen_at="seen_at"))


# --- digests and lists -----------------------------------------------------------
_STATE = ("state", rel.STATE)
_ORDER = "CASE category WHEN 'Apply now' THEN 0 WHEN 'Investigate' THEN 1 WHEN 'Skip' THEN 2 ELSE 3 END, first_seen_at DESC, score DESC, id"


def _list(where: str, limit: int | None = None) -> tuple[str, str]:
    cut = f" LIMIT {limit}" if limit else ""
    return ("picked", f"SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM state WHERE {where} ORDER BY {_ORDER}{cut}")


_DIGEST = f"category IN ('Apply now', 'Investigate') AND NOT is_expired AND first_seen_at >= {NOW} - INTERVAL 36 HOUR"
_ALERT = f"category IN ('Apply now') AND status = 'New' AND NOT is_expired AND score >= 75 AND seen_count < 3 AND first_seen_at >= {NOW} - INTERVAL 48 HOUR"
_OPEN = "category IN ('Apply now', 'Investigate') AND status = 'New' AND NOT is_expired"
_ROW = "CAST(rank AS BIGINT) AS rank, id, company, title, CAST(score AS BIGINT) AS score, category"


def row_view(df):
    return df.select(big("rank"), "id", "company", "title", big("score"), "category")


@query(
    "review_order",
    o._with(
        _STATE,
        final=f"SELECT CAST(CASE category WHEN 'Apply now' THEN 0 WHEN 'Investigate' THEN 1 WHEN 'Skip' THEN 2 ELSE 3 END AS BIGINT) AS category_rank, {d_stamp('first_seen_at')}, CAST(score AS BIGINT) AS score, id FROM state",
    ),
)
def review_order(spark, sf):
    rank = big(digest.review_order()[0], "category_rank")
    return digest.review_list(stored(spark, sf)).select(rank, stamp("first_seen_at"), big("score"), "id")


@query("review_top", o._with(_STATE, _list("TRUE", 25), final=f"SELECT {_ROW} FROM picked"))
def review_top(spark, sf):
    top = digest.top_review(stored(spark, sf), F.lit(True), 25)
    return row_view(digest._numbered(top, digest.review_order()))


@query("stored_digest", o._with(_STATE, _list(_DIGEST, 10), final=f"SELECT {_ROW} FROM picked"))
def stored_digest(spark, sf):
    return row_view(digest.stored_digest(stored(spark, sf), AS_OF, 36, 10, True))


@query("stored_digest_rows", o._with(_STATE, final=f"SELECT id FROM state WHERE {_DIGEST}"))
def stored_digest_rows(spark, sf):
    return stored(spark, sf).filter(digest.digest_rows(AS_OF, 36, True)).select("id")


@query(
    "stored_digest_text",
    o._with(
        _STATE, _list(_DIGEST, 10),
        final="""SELECT 'Apply now and Investigate digest - last 36 hour(s)' || chr(10) || chr(10) || string_agg(rank || '. [' || score || '] #' || id || ' ' || company || ' - ' || title
          || chr(10) || '   First seen: ' || strftime(first_seen_at, '%m-%d %H:%M') || chr(10) || '   Link: ' || coalesce(job_link, 'No job URL found') || chr(10) || '   Why: ' || explanation, chr(10) ORDER BY rank) AS text FROM picked""",
    ),
)
def stored_digest_text(spark, sf):
    return digest.render_stored(digest.stored_digest(stored(spark, sf), AS_OF, 36, 10, True), 36, True)


@query("alert_rows", o._with(_STATE, final=f"SELECT id, company FROM state WHERE {_ALERT}"))
def alert_rows(spark, sf):
    return stored(spark, sf).filter(digest.alert_rows(AS_OF, 48, False, 75, 3)).select("id", "company")


_TYPE_TEXT = (
    "lower(title || ' ' || coalesce(seniority, '') || ' ' || coalesce(work_mode, '') || ' ' || coalesce(salary_range, '') || ' [\"' || array_to_string(required_skills, '\", \"') "
    "|| '\"] [\"' || array_to_string(preferred_skills, '\", \"') || '\"] ' || explanation)"
)


def _compact_age(c: str) -> str:
    p = r"([0-9]+)\s*(minute|hour|day|week|month)"
    n, u = d.extract(f"lower({c})", p), d.extract(f"lower({c})", p, 2)
    return f"CASE WHEN coalesce({c}, '') = '' THEN '-' WHEN {n} <> '' THEN {n} || CASE {u} WHEN 'month' THEN 'mo' ELSE left({u}, 1) END ELSE {d.truncate(c, 6)} END"


@query(
    "alert_digest_text",
    o._with(
        _STATE, ("typed", f"SELECT *, {d.employment(_TYPE_TEXT)} AS kind, {d.estimate('salary_range')} AS est FROM state"),
        ("picked", f"SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM typed WHERE {_ALERT} ORDER BY {_ORDER} LIMIT 5"),
        final=f"""SELECT 'Digest: ' || count(*) || ' Apply now job(s)' || chr(10) || 'Window: last 48 hour(s) with score >= 75 and seen < 3' || chr(10) || chr(10)
          || string_agg(rank || '. [' || score || '] #' || id || ' ' || company || ' - ' || title || chr(10) || '   Posted: ' || {_compact_age('posted_date')}
          || ' | Salary: ' || {d.salary_label('est', '-')} || ' | Type: ' || CASE kind WHEN 'Unknown' THEN '-' ELSE kind END || chr(10)
          || '   Link: ' || coalesce(job_link, 'No job URL found') || chr(10) || '   Why: ' || {d.truncate('explanation', 260)}, chr(10) || chr(10) ORDER BY rank) AS text FROM picked""",
    ),
)
def alert_digest_text(spark, sf):
    return digest.render_alert(digest.alert_digest(stored(spark, sf), AS_OF, 48, 5, False, 75, 3), 48, False, 75, 3)


_LINK = "coalesce(canonical_url, job_link, '') <> ''"
_BLOCKED = f"{d.host('job_link')} IN ('linkedin.com', 'www.linkedin.com', 'ca.linkedin.com')"


@query("description_worklist", o._with(_STATE, final=f"SELECT id FROM state WHERE {_OPEN} AND {_LINK} AND coalesce(job_description, '') = ''"))
def description_worklist(spark, sf):
    return digest.description_worklist(stored(spark, sf), None, True).select("id")


@query("description_worklist_top", o._with(_STATE, _list(f"category IN ('Apply now') AND status = 'New' AND NOT is_expired AND {_LINK}", 5), final="SELECT id FROM picked"))
def description_worklist_top(spark, sf):
    return digest.description_worklist(stored(spark, sf), 5, False, force=True).select("id")


@query("resolution_worklist", o._with(_STATE, final=f"SELECT id FROM state WHERE {_OPEN} AND canonical_url IS NULL AND job_link IS NOT NULL AND {_BLOCKED}"))
def resolution_worklist(spark, sf):
    return digest.resolution_worklist(stored(spark, sf), None, True).select("id")


@query(
    "fetch_targets",
    o._with(
        _STATE,
        final=f"""SELECT id, coalesce({_BLOCKED}, FALSE) AS blocked, CASE WHEN canonical_url IS NOT NULL THEN canonical_url WHEN {_BLOCKED} THEN NULL ELSE job_link END AS url,
          CASE WHEN canonical_url IS NOT NULL THEN 'canonical_url' WHEN {_BLOCKED} THEN 'linkedin_alert_only' ELSE 'source_url' END AS source FROM state""",
    ),
)
def fetch_targets(spark, sf):
    t = stored(spark, sf).select("id", is_blocked_url(source_link()).alias("blocked"), fetch_target().alias("t"))
    return t.select("id", "blocked", "t.url", "t.source")


_TABLE = f"""id, CAST(score AS BIGINT) AS score, CASE category WHEN 'Apply now' THEN 'Apply' WHEN 'Investigate' THEN 'Inv' ELSE 'Skip' END AS action,
  CASE status WHEN 'Reviewed' THEN 'Review' WHEN 'Applied' THEN 'Appl' ELSE status END AS status,
  CASE WHEN job_description IS NOT NULL THEN 'Y' WHEN description_status = 'linkedin_blocked' THEN 'Blk' WHEN job_description_error IS NOT NULL THEN 'Err' ELSE 'N' END AS "desc",
  strftime(first_seen_at, '%m-%d %H:%M') AS added, {d.truncate('company', 13)} AS company"""


@query("review_table", o._with(_STATE, final=f"SELECT {_TABLE}, {d.truncate('title', 92)} AS title FROM state"))
def review_table(spark, sf):
    return digest.review_table(stored(spark, sf)).withColumn("score", big("score"))


@query(
    "review_table_debug",
    o._with(
        _STATE, ("typed", f"SELECT *, {d.employment(_TYPE_TEXT)} AS kind, {d.estimate('salary_range')} AS est FROM state"),
        final=f"""SELECT {_TABLE}, {d.truncate('title', 76)} AS title, {d.salary_label('est', '-')} AS salary, CASE kind WHEN 'Unknown' THEN '-' ELSE kind END AS type,
          CAST(seen_count AS BIGINT) AS seen, CASE WHEN is_expired THEN 'Y' ELSE 'N' END AS expired, {_compact_age('posted_date')} AS posted FROM typed""",
    ),
)
def review_table_debug(spark, sf):
    table = digest.review_table(stored(spark, sf), debug=True)
    return table.withColumns({"score": F.col("score").cast("bigint"), "seen": F.col("seen").cast("bigint")})


@query(
    "row_details",
    o._with(
        _STATE,
        final=f"""SELECT id, coalesce(location, 'Unknown location') AS location, coalesce(nullif(work_mode, ''), 'Unknown') AS work_mode,
          {d.employment(_TYPE_TEXT)} AS employment_type, {d.salary_label(d.estimate('salary_range'), 'Unknown')} AS salary_estimation,
          CASE WHEN is_expired THEN 'Yes' ELSE 'No' END AS expired, coalesce(job_link, 'No job URL found') AS job_link, coalesce(job_link, 'No source URL found') AS source_url,
          CASE WHEN job_description IS NOT NULL THEN 'Yes' ELSE 'No' END AS description_fetched FROM state""",
    ),
)
def row_details(spark, sf):
    return digest.row_details(stored(spark, sf)).select(
        "id", "location", "work_mode", "employment_type", "salary_estimation", "expired", "job_link",
        "source_url", "description_fetched",
    )


@query("one_row", o._with(_STATE, final="SELECT id, company, title, status FROM state WHERE id = 42"))
def one_row(spark, sf):
    return st.find_row(stored(spark, sf), 42).select("id", "company", "title", "status")


@query(
    "description_review",
    o._with(
        _STATE, _list("trim(coalesce(job_description, '')) <> ''", 10),
        final=f"""SELECT CAST(rank AS BIGINT) AS rank, id, 'Unknown' AS source, coalesce(canonical_url, job_link, 'Unknown') AS url, length(job_description) AS chars,
          {d.truncate(d.squeeze('job_description'), 25)} AS preview FROM picked""",
    ),
)
def description_review(spark, sf):
    rows = digest.review_descriptions(stored(spark, sf), 10, 25)
    return rows.select(big("rank"), "id", "source", "url", big("chars"), "preview")


@query(
    "evolved_state",
    o._with(
        _STATE,
        final=f"""SELECT id, {d_stamp('first_seen_at')}, strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(last_seen_at, '%Y-%m-%d %H:%M:%S') AS updated_at,
          job_link AS source_url, {d.estimate('salary_range')} AS salary_estimate, CAST(NULL AS VARCHAR) AS description_source FROM state""",
    ),
)
def evolved_state(spark, sf):
    return stored(spark, sf).select(
        "id", stamp("first_seen_at"), stamp("created_at"), stamp("updated_at"), "source_url",
        "salary_estimate", "description_source",
    )


# --- maintenance ---------------------------------------------------------------
_NOISE = f"category = 'Skip' AND {d.any_in("lower(company || ' ' || title)", r.NOISE_MARKERS)}"
_DIFF = "(s.score <> n.score OR s.category <> n.category OR s.is_expired <> n.is_expired OR s.company <> n.company OR s.title <> n.title OR s.explanation <> n.explanation)"
_NEW = "CAST(n.score AS BIGINT) AS new_score, n.category AS new_category, n.is_expired AS new_is_expired, n.company AS new_company, n.title AS new_title, n.explanation AS new_explanation"


def preview_view(df):
    return df.select(
        "id", big("old_score"), big("new_score"), "new_category", "new_is_expired", "new_company", "new_title", "new_explanation"
    )


def _rescoring(source: str) -> tuple[tuple[str, str], ...]:
    """The scoring CTEs over ``source`` without its stored score columns."""
    bare = f"SELECT * EXCLUDE (score, category, explanation) FROM {source}"
    return (("bare", bare), *o.scoring("bare"))


@query(
    "rescore_preview",
    o._with(_STATE, *_rescoring("state"), final=f"SELECT s.id, CAST(s.score AS BIGINT) AS old_score, {_NEW} FROM state s JOIN scored n USING (id) WHERE {_DIFF}"),
)
def rescore_preview(spark, sf):
    return preview_view(maintenance.rescore(stored(spark, sf), AS_OF).preview)


_MERGED = f"""
  SELECT fp, arg_max(id, id) AS id, CAST(sum(seen_count) AS BIGINT) AS seen_count, min(first_seen_at) AS first_seen_at,
    coalesce(arg_max(status, id) FILTER (WHERE status <> 'New'), 'New') AS status, arg_max(new_score, id) AS score
  FROM (SELECT s.id, s.seen_count, s.first_seen_at, s.status, n.score AS new_score, {d.fingerprint('n.')} AS fp FROM state s JOIN scored n USING (id)) m GROUP BY fp
"""


@query(
    "rescore_apply",
    o._with(
        _STATE, *_rescoring("state"), ("merged", _MERGED),
        final=f"SELECT fp AS job_fingerprint, id, seen_count, {d_stamp('first_seen_at')}, status, CAST(score AS BIGINT) AS score FROM merged",
    ),
)
def rescore_apply(spark, sf):
    # Every derived row gets a real fingerprint here because its score changes.
    out = maintenance.rescore(stored(spark, sf), AS_OF).apply()
    return out.select("job_fingerprint", "id", big("seen_count"), stamp("first_seen_at"), "status", big("score"))


@query(
    "normalize_preview",
    o._with(
        _STATE, *_rescoring("state"),
        final=f"SELECT s.id, CAST(s.score AS BIGINT) AS old_score, {_NEW} FROM state s JOIN scored n USING (id) WHERE s.company <> n.company OR s.title <> n.title",
    ),
)
def normalize_preview(spark, sf):
    return preview_view(maintenance.normalize_rows(stored(spark, sf), AS_OF).preview)


@query(
    "repair_preview",
    o._with(
        _STATE,
        ("broken", f"SELECT * REPLACE ({d.extract('title', o.IS_HIRING, 1)} AS company, {d.extract('title', o.IS_HIRING, 2)} AS title) FROM state WHERE {d.extract('title', o.IS_HIRING, 1)} <> ''"),
        *_rescoring("broken"),
        final=f"SELECT s.id, CAST(s.score AS BIGINT) AS old_score, {_NEW} FROM state s JOIN scored n USING (id)",
    ),
)
def repair_preview(spark, sf):
    return preview_view(maintenance.repair_hiring(stored(spark, sf), AS_OF).preview)


@query("clean_noise_preview", o._with(_STATE, final=f"SELECT id, company, title FROM state WHERE {_NOISE}"))
def clean_noise_preview(spark, sf):
    return maintenance.clean_noise(stored(spark, sf)).preview.select("id", "company", "title")


@query("clean_noise_apply", o._with(_STATE, final=f"SELECT id, category FROM state WHERE NOT ({_NOISE})"))
def clean_noise_apply(spark, sf):
    return maintenance.clean_noise(stored(spark, sf)).apply().select("id", "category")


@query("clean_skipped_apply", o._with(_STATE, final="SELECT id, category FROM state WHERE category <> 'Skip'"))
def clean_skipped_apply(spark, sf):
    return maintenance.clean_skipped(stored(spark, sf)).apply().select("id", "category")


@query("delete_by_ids", o._with(_STATE, final="SELECT id FROM state WHERE id NOT IN (SELECT user_id FROM events)"))
def delete_by_ids(spark, sf):
    ids = rel.table(spark, sf, "events").select(F.col("user_id").alias("id"))
    return maintenance.delete_ids(stored(spark, sf), ids).apply().select("id")


# --- commands -------------------------------------------------------------------
_PARSED = rf"""
  SELECT update_id, chat_id, text, regexp_extract(trim(text), '^/(\w+)(?:@\w+)?\s+([0-9]+)\s*$', 2) AS target,
    CASE lower(regexp_extract(trim(text), '^/(\w+)(?:@\w+)?\s+([0-9]+)\s*$', 1)) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in r.COMMAND_STATUSES.items())} END AS status
  FROM commands WHERE chat_id = 'me' AND trim(text) LIKE '/%'
"""
_CMD = (("commands", rel.COMMANDS), ("parsed", _PARSED))


def commands(spark, sf):
    return cmd.parse_commands(rel.relation(spark, sf, rel.COMMANDS), "me")


@query("parsed_commands", o._with(*_CMD, final="SELECT update_id, status, CASE WHEN status IS NOT NULL THEN CAST(target AS BIGINT) END AS id FROM parsed"))
def parsed_commands(spark, sf):
    return commands(spark, sf).select("update_id", "status", "id")


@query(
    "command_replies",
    o._with(
        _STATE, *_CMD,
        final=f"""SELECT update_id, CASE WHEN p.status IS NULL THEN {d.s(cmd.HELP)} WHEN s.id IS NULL THEN 'No job found with id ' || target || '.'
          ELSE 'Updated #' || CAST(s.id AS VARCHAR) || ' to ' || p.status || ': ' || s.company || ' - ' || s.title END AS reply
          FROM parsed p LEFT JOIN state s ON p.status IS NOT NULL AND s.id = try_cast(p.target AS BIGINT)""",
    ),
)
def command_replies(spark, sf):
    return cmd.command_replies(stored(spark, sf), commands(spark, sf)).select("update_id", "reply")


@query(
    "state_after_commands",
    o._with(
        _STATE, *_CMD, ("last", "SELECT CAST(target AS BIGINT) AS id, arg_max(status, update_id) AS status FROM parsed WHERE status IS NOT NULL GROUP BY 1"),
        final=f"SELECT s.id, coalesce(l.status, s.status) AS status, strftime(CASE WHEN l.id IS NOT NULL THEN {NOW} ELSE last_seen_at END, '%Y-%m-%d %H:%M:%S') AS updated_at FROM state s LEFT JOIN last l ON s.id = l.id",
    ),
)
def state_after_commands(spark, sf):
    out = cmd.apply_commands(stored(spark, sf), commands(spark, sf), AS_OF)
    return out.select("id", "status", stamp("updated_at"))


@query("next_offset", o._with(_CMD[0], final="SELECT max(update_id) + 1 AS next_offset FROM commands"))
def next_offset(spark, sf):
    return cmd.next_offset(rel.relation(spark, sf, rel.COMMANDS))


_WORDS = f"SELECT event_id, {rel.pick('event_id % 8', *rel.q(' NEW ', 'skip', 'Follow-Up', 'followup needed', 'done', 'Applied', 'Reviewed ', ''))} AS word, {rel.pick('user_id % 4', *rel.q('2001-03-04 05:06:07', 'soon', '', '2001-08-02T01:00:00+00:00'))} AS seen FROM {{events}}"


@query(
    "status_words",
    o._with(
        ("words", _WORDS),
        final=f"SELECT event_id, CASE lower(trim(word)) {' '.join(f'WHEN {d.s(k)} THEN {d.s(v)}' for k, v in r.STATUS_ALIASES.items())} END AS status, epoch(coalesce(try_cast(try_cast(seen AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP), {NOW})) AS seen FROM words",
    ),
)
def status_words(spark, sf):
    words = rel.relation(spark, sf, _WORDS)
    return words.select(
        "event_id", normalize_status(F.col("word")).alias("status"),
        F.unix_timestamp(dates.parse_timestamp(F.col("seen"), dates.timestamp(AS_OF))).cast("double").alias("seen"),
    )
