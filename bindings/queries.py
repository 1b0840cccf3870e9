"""Registry: query name -> Spark callable, and its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import duck as d
from bindings import oracles as o
from bindings import relations as rel
from leadsift import rules as r
from leadsift.functions import dates, labels, money
from leadsift.functions.names import clean_title, normalize_company, normalize_title
from leadsift.functions.text import blank_to_null, rx
from leadsift.operators import extract as x
from leadsift.operators import relevance
from leadsift.operators.dedupe import dedupe, fingerprint, identity_key
from leadsift.operators.digest import ranked_digest, render_ranked
from leadsift.operators.score import normalize_postings, score, score_details, searchable_text
from leadsift.plans.intake import find_postings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = rel.AS_OF


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = rel.for_duck(sql)
        return function

    return register


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return rel.relation(spark, sf, rel.ALERTS)


def relevant(spark: SparkSession, sf: str) -> DataFrame:
    return relevance.relevant_messages(alerts(spark, sf))


def piped(column: str):
    return F.array_join(column, "|").alias(column)


def big(column, name: str | None = None):
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("bigint").alias(name or column)


def postings_view(df: DataFrame) -> DataFrame:
    return df.select(
        "source_id", big("card_idx"), "company", "title", "location", "work_mode", "salary_range",
        "seniority", piped("required_skills"), piped("preferred_skills"), "job_link",
        "source_email", "posted_date", "is_expired",
    )


def scored_view(df: DataFrame) -> DataFrame:
    return df.select("source_id", "company", "title", big("score"), "category", "explanation", "is_expired")


# --- filters -----------------------------------------------------------------
@query("relevant_messages", o._with(("alerts", rel.ALERTS), final=f"SELECT source_id, subject FROM alerts WHERE {o.relevant()}"))
def relevant_messages(spark, sf):
    return relevant(spark, sf).select("source_id", "subject")


_SCAN = r.RulePack(scan_chars=5000)


@query("relevant_in_5000_chars", o._with(("alerts", rel.ALERTS), final=f"SELECT source_id, subject FROM alerts WHERE {o.relevant(_SCAN)}"))
def relevant_in_5000_chars(spark, sf):
    return relevance.relevant_messages(alerts(spark, sf), _SCAN).select("source_id", "subject")


_ALLOW = r.RulePack(allowed_senders=(" Friend@ ", "", "ana <"))


@query(
    "allowed_senders",
    o._with(
        ("alerts", rel.ALERTS),
        final=f"SELECT source_id FROM alerts WHERE {o.relevant(_ALLOW)} AND NOT ({o.relevant()})",
    ),
)
def allowed_senders(spark, sf):
    newly = relevance.is_relevant(_ALLOW) & ~relevance.is_relevant()
    return alerts(spark, sf).filter(newly).select("source_id")


_TOKENS = f"SELECT {rel.pick('n_nationkey % 5', *rel.q('Friend@', 'acme', ' ana ', 'zzz', ''))} AS token FROM {{nation}}"


@query(
    "allowlist_join",
    o._with(
        ("alerts", rel.ALERTS), ("tokens", f"SELECT DISTINCT lower(trim(token)) AS token FROM ({_TOKENS}) t WHERE trim(token) <> ''"),
        final="SELECT source_id, sender FROM alerts WHERE EXISTS (SELECT 1 FROM tokens WHERE contains(lower(sender), token))",
    ),
)
def allowlist_join(spark, sf):
    found = relevance.allowed_by_list(alerts(spark, sf), rel.relation(spark, sf, _TOKENS))
    return found.select("source_id", "sender")


@query(
    "headers_first",
    o._with(
        ("alerts", rel.ALERTS),
        final=f"SELECT source_id FROM alerts WHERE {o.relevant(body=chr(39) * 2)} AND {o.relevant()}",
    ),
)
def headers_first(spark, sf):
    mail = alerts(spark, sf)
    return relevance.headers_first(mail.drop("body"), mail.select("source_id", "body")).select("source_id")


# --- field rules ---------------------------------------------------------------
@query("subject_cores", o._with(("alerts", rel.ALERTS), final=f"SELECT source_id, {o.subject_core()} AS core FROM alerts"))
def subject_cores(spark, sf):
    return alerts(spark, sf).select("source_id", x.subject_core(F.col("subject")).alias("core"))


@query(
    "labelled_fields",
    o._with(
        ("alerts", rel.ALERTS), ("facts", o.FACTS),
        final="SELECT source_id, l_role AS role, l_company AS company, l_location AS location, l_salary AS salary FROM facts",
    ),
)
def labelled_fields(spark, sf):
    low = alerts(spark, sf).withColumn("low", F.lower("body"))
    return low.select(
        "source_id",
        *[
            x.labelled(F.col("body"), F.col("low"), name).alias(name.lower())
            for name in ("Role", "Company", "Location", "Salary")
        ],
    )


@query("posting_names", o._with(*o.MAIL[:3], final="SELECT source_id, title, company FROM named"))
def posting_names(spark, sf):
    low = alerts(spark, sf).select("*", F.lower("body").alias("low"), x.subject_core(F.col("subject")).alias("core"))
    return low.select(
        "source_id",
        x.posting_title(F.col("core"), F.col("body"), F.col("low")).alias("title"),
        x.posting_company(F.col("core"), F.col("sender"), F.col("body"), F.col("low")).alias("company"),
    )


@query(
    "hiring_phrases",
    o._with(
        ("alerts", rel.ALERTS),
        final=f"""SELECT source_id, nullif({d.extract('subject', o.IS_HIRING, 1)}, '') AS company, nullif({d.extract('subject', o.IS_HIRING, 2)}, '') AS role,
          nullif({d.extract('subject', o.CONTRACT_MAIL, 1)}, '') AS contract_company, nullif({d.extract('subject', o.CONTRACT_MAIL, 2)}, '') AS contract_role FROM alerts""",
    ),
)
def hiring_phrases(spark, sf):
    s = F.col("subject")
    return alerts(spark, sf).select(
        "source_id",
        rx(s, x.COMPANY_HIRING).alias("company"), rx(s, x.COMPANY_HIRING, 2).alias("role"),
        rx(s, x.CONTRACT_SUBJECT).alias("contract_company"), rx(s, x.CONTRACT_SUBJECT, 2).alias("contract_role"),
    )


@query(
    "mode_and_level",
    o._with(*o.MAIL, final="SELECT source_id, work_mode, seniority FROM postings"),
)
def mode_and_level(spark, sf):
    return x.extract(alerts(spark, sf), AS_OF).select("source_id", "work_mode", "seniority")


@query(
    "skill_sections",
    o._with(
        *o.MAIL,
        final="SELECT source_id, array_to_string(required_skills, '|') AS required_skills, array_to_string(preferred_skills, '|') AS preferred_skills FROM postings",
    ),
)
def skill_sections(spark, sf):
    return x.extract(alerts(spark, sf), AS_OF).select("source_id", piped("required_skills"), piped("preferred_skills"))


@query(
    "first_urls",
    f"""SELECT conv_id, turn, role, nullif(rtrim({d.extract('text', r'https?://[^ ' + chr(92) + 's]+', 0)}, ').,'), '') AS url FROM conversations
        UNION ALL SELECT page_id, 0, 'page', nullif(rtrim({d.extract("'see (' || url || ').'", r'https?://[^ ' + chr(92) + 's]+', 0)}, ').,'), '') FROM pages""",
)
def first_urls(spark, sf):
    turns = rel.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    pages = rel.table(spark, sf, "pages").select(
        F.col("page_id").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("page").alias("role"),
        F.concat(F.lit("see ("), "url", F.lit(").")).alias("text"),
    )
    both = turns.unionByName(pages)
    return both.select("conv_id", "turn", "role", x.first_url(F.col("text")).alias("url"))


@query("posted_ages", o._with(*o.MAIL, final="SELECT source_id, posted_date FROM postings"))
def posted_ages(spark, sf):
    now = dates.timestamp(AS_OF)
    return alerts(spark, sf).select(
        "source_id", dates.posting_age(F.col("body"), F.col("received_at"), now).alias("posted_date")
    )


@query("expired_messages", o._with(*o.MAIL, final="SELECT source_id, is_expired FROM postings"))
def expired_messages(spark, sf):
    now = dates.timestamp(AS_OF)
    return alerts(spark, sf).select(
        "source_id", dates.is_expired(F.col("subject"), F.col("body"), now).alias("is_expired")
    )


# --- extraction, identity, scoring -----------------------------------------------
@query("extract_postings", o._with(*o.RELEVANT_MAIL, final=f"SELECT {o.POSTING_COLUMNS} FROM postings"))
def extract_postings(spark, sf):
    return postings_view(x.extract(relevant(spark, sf), AS_OF))


@query("card_postings", o._with(*o.CARDS, final=f"SELECT {o.POSTING_COLUMNS} FROM card_rows"))
def card_postings(spark, sf):
    return postings_view(x.extract(rel.relation(spark, sf, rel.CARD_MAIL), AS_OF))


@query(
    "normalised_names",
    o._with(
        ("alerts", rel.ALERTS),
        final=f"SELECT source_id, {d.company('subject')} AS company, {d.title('subject')} AS title, {d.core_title('subject')} AS role FROM alerts",
    ),
)
def normalised_names(spark, sf):
    s = F.col("subject")
    return alerts(spark, sf).select(
        "source_id", normalize_company(s).alias("company"), normalize_title(s).alias("title"), clean_title(s).alias("role")
    )


@query("identity_keys", o._with(*o.RELEVANT_MAIL, final=f"SELECT source_id, concat_ws('/', {o.KEYS}) AS identity, {d.fingerprint()} AS fingerprint FROM postings"))
def identity_keys(spark, sf):
    return x.extract(relevant(spark, sf), AS_OF).select(
        "source_id", F.concat_ws("/", *identity_key()).alias("identity"), fingerprint().alias("fingerprint")
    )


@query("first_copies", o._with(*o.RELEVANT_MAIL, ("deduped", o.DEDUPED), final="SELECT source_id, company, title, location, job_link FROM deduped"))
def first_copies(spark, sf):
    return dedupe(x.extract(relevant(spark, sf), AS_OF)).select("source_id", "company", "title", "location", "job_link")


@query("searchable_texts", o._with(*o.FLOW, final="SELECT source_id, whole AS searchable FROM scored"))
def searchable_texts(spark, sf):
    return normalize_postings(dedupe(x.extract(relevant(spark, sf), AS_OF))).select(
        "source_id", searchable_text().alias("searchable")
    )


_PARTS = ("role", "skills", "domain", "always", "tier", "strategic", "seniority", "salary", "penalty")


@query(
    "score_components",
    o._with(
        *o.FLOW,
        final="SELECT source_id, "
        + ", ".join(f"CAST(p_{p} AS BIGINT) AS p_{p}, w_{p}" for p in _PARTS)
        + ", w_fresh, w_expired FROM scored",
    ),
)
def score_components(spark, sf):
    parts = score_details(dedupe(x.extract(relevant(spark, sf), AS_OF)))
    columns = [c for p in _PARTS for c in (big(f"c_{p}.points", f"p_{p}"), F.col(f"c_{p}.why").alias(f"w_{p}"))]
    return parts.select("source_id", *columns, F.col("c_fresh.why").alias("w_fresh"), F.col("c_expired.why").alias("w_expired"))


@query("scored_postings", o._with(*o.FLOW, final=f"SELECT {o.SCORED_COLUMNS} FROM scored"))
def scored_postings(spark, sf):
    return scored_view(find_postings(alerts(spark, sf), AS_OF))


_PACK = r.RulePack(always=("acme widgets", "td"), never=("loblaw", "customer#000000010"), apply_at=90, investigate_at=50)


@query(
    "scored_with_own_rules",
    o._with(*o.RELEVANT_MAIL, ("deduped", o.DEDUPED), *o.scoring("deduped", _PACK), final=f"SELECT {o.SCORED_COLUMNS} FROM scored"),
)
def scored_with_own_rules(spark, sf):
    return scored_view(find_postings(alerts(spark, sf), AS_OF, _PACK))


_TOP = "SELECT *, row_number() OVER (ORDER BY score DESC, msg_seq, card_idx) AS rank FROM scored WHERE category <> 'Skip' ORDER BY score DESC, msg_seq, card_idx LIMIT 10"


@query("ranked_digest", o._with(*o.FLOW, ("top", _TOP), final=f"SELECT CAST(rank AS BIGINT) AS rank, {o.SCORED_COLUMNS} FROM top"))
def ranked(spark, sf):
    top = ranked_digest(find_postings(alerts(spark, sf), AS_OF))
    return top.select(big("rank"), *scored_view(top).columns[:3], big("score"), "category", "explanation", "is_expired")


@query(
    "ranked_digest_text",
    o._with(
        *o.FLOW, ("top", _TOP),
        final="""SELECT 'Ranked action digest' || chr(10) || chr(10) || string_agg(rank || '. ' || category || ' [' || score || ']' || chr(10)
          || '   ' || company || ' - ' || title || chr(10) || '   Location: ' || coalesce(location, 'Unknown location') || chr(10)
          || '   Link: ' || coalesce(job_link, 'No job URL found') || chr(10) || '   Why: ' || explanation, chr(10) ORDER BY rank) AS text FROM top""",
    ),
)
def ranked_text(spark, sf):
    return render_ranked(ranked_digest(find_postings(alerts(spark, sf), AS_OF)))


@query(
    "salary_figures",
    o._with(
        ("alerts", rel.ALERTS), ("facts", o.FACTS),
        ("paid", f"SELECT source_id, l_salary, {d.max_salary('l_salary')} AS top, {d.estimate('l_salary')} AS middle FROM facts"),
        final=f"SELECT source_id, top, middle, {d.salary_label('middle', 'Unknown')} AS label, {d.salary_label('middle', '-')} AS short FROM paid",
    ),
)
def salary_figures(spark, sf):
    text = x.labelled(F.col("body"), F.lower("body"), "Salary")
    paid = alerts(spark, sf).select("source_id", text.alias("s")).select(
        "source_id", money.max_salary(F.col("s")).alias("top"), money.estimate_salary(F.col("s")).alias("middle")
    )
    return paid.select(
        "source_id", "top", "middle", money.salary_label(F.col("middle")).alias("label"),
        money.salary_label(F.col("middle"), "-").alias("short"),
    )
