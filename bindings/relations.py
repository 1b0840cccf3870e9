"""Derived relations, written once in SQL that Spark and DuckDB both run.

``{orders}`` and friends stand for a base table: a parquet path in Spark, a view
in DuckDB. Every relation covers its whole base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-02 12:00:00"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

NL = "chr(10)"


def pick(expr: str, *values: str) -> str:
    """One of ``values`` (SQL expressions) by a 0-based integer expression."""
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"(CASE {expr} {cases} ELSE '' END)"


def q(*texts: str) -> list[str]:
    return ["'" + t.replace("'", "''") + "'" for t in texts]


_TITLES = q(
    "senior data scientist", "Staff Data Scientist", "Machine Learning Engineer (Remote)",
    "Applied AI Engineer", "Data Analyst", "ML Engineer - 1234", "Junior Data Scientist",
    "AI Platform Engineer", "Marketing Analyst", "Retail Manager",
    "Exciting senior ml engineer role", "Machine Learning Scientist",
)
_COMPANIES = q(
    "Cohere", "shopify", "td", "Workday", "mongodb", "Loblaw", "acme widgets", "Empire Life",
    "RBC jobs", "stackadapt",
) + ["c_name"] + q("Thomson Reuters", "Clio and more", "intact")
_PLACES = ["n_name || ', ON'"] + q("Remote Canada", "Toronto Hybrid", "On-site Vancouver", "Must relocate")
_SKILLS = q(
    "Python, SQL and Spark for recommendation systems", "LLM evaluation and AI agents",
    "Excel dashboards and Tableau reporting", "Databricks, MLflow, Kubernetes, MLOps",
    "Forecasting and experimentation for customer growth", "Regulatory compliance work, AML",
    "Retrieval-Augmented Generation, RAG, LangGraph", "Nothing special",
)

# Message parts that depend on the order key alone are spelled as CASE lists.
_BASE = f"""
  SELECT {{spread}} o_orderkey AS k, o_custkey, floor(o_totalprice) AS price, o_orderdate, c_name, n_name,
         {pick('(o_orderkey * 7 + o_custkey) % 12', *_TITLES)} AS t,
         {pick('o_custkey % 14', *_COMPANIES)} AS co,
         {pick('o_orderkey % 5', *_PLACES)} AS place
  FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
"""
_SUBJECT = pick(
    "k % 9",
    "'New job: ' || t || ' at ' || co",
    "t || ' - ' || co",
    "co || ' is hiring a ' || t",
    "'Fwd: re: ' || t || ' at ' || co",
    "co || ' Contract Opportunity: 6 month ' || t",
    "'Sam, apply to ' || t || ' at ' || co",
    "'Applied AI opportunity'",
    "'Sam, your job''s expiring on Friday: ' || t || ' - ' || co",
    "(CASE WHEN k % 2 = 0 THEN 'Your weekly receipt' ELSE 'Weekly note' END)",
)
_SENDER = pick(
    "k % 7",
    *q(
        "Job Alerts <alerts@linkedin.com>", "no-reply@greenhouse.io", "talent@dayforce.example",
        "Careers <careers@acme.example>", "friend@mail.example", "recruiter@agency.example",
        "Ana <ana@cohere.example>",
    ),
)


def _int(expr: str) -> str:
    return f"CAST(CAST({expr} AS BIGINT) AS STRING)"


_BODY = " || ".join(
    [
        pick(
            "k % 5",
            f"'Hello,' || {NL}",
            f"'We''re hiring a ' || t || ' on our platform team.' || {NL}",
            f"'  ' || {NL}",
            f"co || ' is hiring an Applied AI Engineer (remote) now' || {NL}",
            f"'A 6-month Big Bank contract via Agency Inc' || {NL}",
        ),
        f"(CASE WHEN k % 4 < 2 THEN 'Company: ' || co || {NL} ELSE '' END)",
        f"(CASE WHEN k % 4 = 0 THEN 'Role:  ' || t || ' ' || {NL} ELSE '' END)",
        pick("k % 3", f"'Location: ' || place || {NL}", f"' location ' || {NL} || {NL} || '  ' || place || {NL}", "''"),
        pick(
            "k % 6",
            f"'Salary: CA$' || {_int('price')} || '-' || {_int('price + 25001')} || {NL}",
            f"'Salary: CA$' || {_int('floor(price / 1000)')} || 'k-' || {_int('floor(price / 1000) + 31')} || 'k' || {NL}",
            f"'Salary: competitive' || {NL}",
            f"'Salary' || {NL} || 'CA$' || {_int('price')} || '.5' || {NL}",
            "''",
            "''",
        ),
        f"'Requirements' || {NL}",
        pick("k % 8", *[f"{s} || {NL}" for s in _SKILLS]),
        f"(CASE WHEN k % 2 = 0 THEN 'Preferred' || {NL} || {pick('k % 7', *_SKILLS[:7])} || {NL} || 'Apply' || {NL} ELSE '' END)",
        f"(CASE WHEN k % 11 = 0 THEN ' nice to have ' || {NL} || 'Airflow' || {NL} ELSE '' END)",
        f"(CASE WHEN k % 3 <> 2 THEN 'See (https://jobs.example.com/' || {_int('k % 997')} || ').' || {NL} ELSE '' END)",
        pick(
            "k % 8",
            f"'Posted ' || {_int('k % 50')} || ' minutes ago.' || {NL}",
            f"'posted ' || {_int('k % 30')} || ' hours ago' || {NL}",
            f"'Posted ' || {_int('k % 20')} || ' days ago. Act fast' || {NL}",
            f"'Posted 3 weeks ago' || {NL}",
            f"'Posted today.' || {NL}",
            f"'Posted 1 month ago' || {NL}",
            "''",
            "''",
        ),
        pick(
            "k % 10",
            f"'This job has expired' || {NL}",
            f"'expiring on Jul 2' || {NL}",
            f"'expires Feb 30' || {NL}",
            f"'Application deadline Sep. 9' || {NL}",
            f"'The posting EXPIRES on january 15' || {NL}",
            "''", "''", "''", "''", "''",
        ),
        f"(CASE WHEN k % 13 = 0 THEN 'Thanks' || {NL} || ' Wealthsimple ' || {NL} ELSE '' END)",
        f"(CASE WHEN k % 17 = 0 THEN '5+ years, must start soon' ELSE '' END)",
    ]
)
ALERTS = f"""
  SELECT CAST(k AS STRING) AS source_id, k AS msg_seq, {_SUBJECT} AS subject, {_SENDER} AS sender,
         CASE WHEN k % 4 = 1 THEN CAST(o_orderdate AS TIMESTAMP) END AS received_at,
         {_BODY} AS body
  FROM ({_BASE}) base
"""

# Multi-posting messages: three cards per order, varied by arithmetic on the row.
def _card(i: int) -> str:
    n = f"(o_orderkey + {i} * (o_custkey % 4))"
    return " || ".join(
        [
            pick(
                f"{n} % 6",
                f"'Senior Data Scientist posted on 7/6/26' || {NL}",
                f"'- Applied AI Engineer -' || {NL}",
                f"'Staff ML Engineer 40 applicants' || {NL}",
                f"'Office Manager' || {NL}",
                f"'promoted' || {NL} || 'Data Platform Architect' || {NL}",
                f"'machine learning engineer (remote)' || {NL}",
            ),
            f"(CASE WHEN {n} % 5 = 0 THEN '' ELSE 'Firm number ' || {_int(f'{n} % 9')} || ' hiring' || {NL} END)",
            pick(f"{n} % 4", f"'Toronto, ON' || {NL}", f"'Remote' || {NL}", f"'Springfield, TX (Hybrid)' || {NL}", "''"),
            f"(CASE WHEN {n} % 3 = 0 THEN '12 applicants' || {NL} ELSE '' END)",
            f"'View: https://www.linkedin.com/jobs/view/' || {_int(f'{n} % 7')} || '),' || {NL}",
            f"(CASE WHEN {n} % 2 = 0 THEN 'Python and LLM' || {NL} ELSE '' END)",
        ]
    )


CARD_MAIL = f"""
  SELECT CAST(o_orderkey AS STRING) AS source_id, o_orderkey AS msg_seq,
         'Jobs for you' AS subject, 'LinkedIn <alerts@linkedin.com>' AS sender,
         CAST('2001-08-01 00:30:00' AS TIMESTAMP) AS received_at,
         {_card(0)} || '   ' || {NL} || {_card(1)} || {_card(2)} AS body
  FROM (SELECT {{spread}} o_orderkey, o_custkey FROM {{orders}}) o
"""

# One already scored sighting per lineitem.
SIGHTINGS = f"""
  SELECT {{spread}} l_orderkey * 8 + l_linenumber AS msg_seq, l_partkey * 1000 + l_suppkey AS card_idx,
         CAST(l_shipdate AS TIMESTAMP) AS seen_at,
         s_name AS company, p_brand || ' engineer' AS title,
         CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE '  Toronto   ON ' END AS location,
         {pick('l_linenumber % 4', *q('Remote', 'Hybrid', 'On-site', ''))} AS work_mode,
         'CA$' || {_int('floor(p_retailprice) + l_quantity')} || 'k' AS salary_range,
         CASE WHEN l_linenumber % 2 = 0 THEN 'Senior' END AS seniority,
         split({pick('l_linenumber % 3', *q('Python,SQL', 'LLM', 'Excel,temp'))}, ',') AS required_skills,
         split({pick('l_linenumber % 2', *q('RAG', 'Spark,MCP'))}, ',') AS preferred_skills,
         CASE WHEN l_suppkey % 3 = 0 THEN 'https://www.linkedin.com/jobs/view/' || {_int('l_suppkey')}
              ELSE 'https://jobs.example.com/' || {_int('l_suppkey')} END AS job_link,
         'alerts@example.com' AS source_email,
         {_int('l_quantity')} || ' days ago' AS posted_date,
         l_returnflag = 'R' AS is_expired,
         CAST((l_partkey * 7 + l_orderkey) % 101 AS INT) AS score,
         CASE WHEN (l_partkey * 7 + l_orderkey) % 101 >= 80 THEN 'Apply now'
              WHEN (l_partkey * 7 + l_orderkey) % 101 >= 60 THEN 'Investigate' ELSE 'Skip' END AS category,
         'why ' || l_linestatus || ' ' || p_type AS explanation
  FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey
"""

# A state table keyed by part, one row per part, ids as commands use them.
STATE = f"""
  SELECT CAST(p_partkey AS BIGINT) AS id, 'fp' || {_int('p_partkey')} AS job_fingerprint,
         CAST('2001-07-31 00:00:00' AS TIMESTAMP) + {{hours}} AS first_seen_at,
         CAST('2001-08-01 00:00:00' AS TIMESTAMP) AS last_seen_at,
         CAST(1 + p_partkey % 4 AS INT) AS seen_count,
         {pick('p_partkey % 6', *q('mongodb', 'Acme', 'TD', 'Cohere', 'Unknown', 'The Receipt payment co'))} AS company,
         {pick('p_partkey % 7', *q('senior ai engineer (remote)', 'Data Scientist', 'StackAdapt is hiring a Senior ML Scientist (x)', 'Applied AI Engineer', 'Meetup host', 'Staff Data Scientist', 'Contract Architect'))} AS title,
         CASE WHEN p_size % 3 = 0 THEN 'Toronto, ON' END AS location,
         {pick('p_size % 3', *q('Remote', '', 'On-site'))} AS work_mode,
         CASE WHEN p_size % 4 <> 0 THEN 'CA$' || {_int('floor(p_retailprice / 9)')} || 'k-' || {_int('floor(p_retailprice / 9) + p_size')} || 'k' END AS salary_range,
         CASE WHEN p_size % 5 = 0 THEN 'Senior' END AS seniority,
         split({pick('p_size % 3', *q('Python,SQL', 'LLM,RAG,Evaluation', 'Excel'))}, ',') AS required_skills,
         split({pick('p_size % 2', *q('Spark', 'Agentic,full,time'))}, ',') AS preferred_skills,
         CASE WHEN p_partkey % 5 = 0 THEN 'https://www.linkedin.com/jobs/view/' || {_int('p_partkey')}
              WHEN p_partkey % 5 = 4 THEN NULL ELSE 'https://jobs.example.com/' || {_int('p_partkey')} END AS job_link,
         CASE WHEN p_partkey % 10 = 0 THEN 'https://boards.greenhouse.io/x/' || {_int('p_partkey')} END AS canonical_url,
         CASE WHEN p_partkey % 3 = 0 THEN {_int('p_size')} || {pick('p_size % 4', *q(' minutes ago', ' hours ago', ' days ago', ' weeks ago'))}
              WHEN p_partkey % 3 = 1 THEN 'posted on 7/6/26' END AS posted_date,
         CASE WHEN p_partkey % 8 = 0 THEN 'Long  text about' || {NL} || ' ' || p_name || ' and ' || p_type || ' roles' END AS job_description,
         CASE WHEN p_partkey % 9 = 0 THEN 'linkedin_blocked' END AS description_status,
         CASE WHEN p_partkey % 11 = 0 THEN 'HTTP 404' END AS job_description_error,
         p_partkey % 12 = 0 AS is_expired,
         CAST((p_partkey * 17) % 101 AS INT) AS score,
         CASE WHEN (p_partkey * 17) % 101 >= 70 THEN 'Apply now' WHEN (p_partkey * 17) % 101 >= 40 THEN 'Investigate' ELSE 'Skip' END AS category,
         'because ' || p_type || repeat(' more', CAST(p_size AS INT)) AS explanation,
         {pick('p_partkey % 5', *q('New', 'New', 'Reviewed', 'New', 'Applied'))} AS status
  FROM {{part}}
"""
_STATE_HOURS = {
    "spark": "make_dt_interval(0, CAST(p_partkey % 60 AS INT))",
    "duck": "to_hours(CAST(p_partkey % 60 AS INT))",
}

COMMANDS = f"""
  SELECT event_id AS update_id, CASE WHEN user_id % 9 = 0 THEN 'other' ELSE 'me' END AS chat_id,
         CASE event_type WHEN 'click' THEN ' /applied ' || {_int('user_id')} || ' '
              WHEN 'purchase' THEN '/Review@bot ' || {_int('user_id')}
              WHEN 'view' THEN '/skip ' || {_int('event_id')}
              WHEN 'signup' THEN '/follow-up ' || {_int('user_id')}
              ELSE 'hello ' || event_type END AS text
  FROM {{events}}
"""

_WORDS = q("boards.greenhouse.io", "www.cohere.ai", "jobs.lever.co", "ca.indeed.com", "acme.example", "careers.shopify.com")
SEARCH_HITS = f"""
  SELECT {{spread}} CAST(l_partkey AS STRING) AS opportunity_key, CAST(l_linenumber % 4 AS INT) AS query_idx,
         CAST((l_suppkey + l_partkey) % 3 AS INT) AS provider_rank,
         l_orderkey * 8 + l_linenumber AS result_idx,
         'https://' || {pick('(l_orderkey + l_linenumber) % 6', *_WORDS)} || {pick('l_suppkey % 5', *q('/careers/', '/jobs/applied-ai-engineer/', '/careers', '/blog/data-scientist;v=1/', '/Position/senior-ai/'))}
           || (CASE WHEN l_suppkey % 5 = 2 THEN '' ELSE {_int('l_suppkey % 20')} END) || (CASE WHEN l_linenumber = 1 THEN '?ref=a#b' ELSE '' END) AS url,
         {pick('l_orderkey % 4', *q('Applied AI Engineer at Cohere', 'Data Scientist', 'Shopify careers', 'Acme: Senior AI Engineer'))} AS title,
         {pick('l_partkey % 3', *q('Join TD and Cohere', '', 'MongoDB hiring'))} AS snippet
  FROM {{lineitem}}
"""


def _fill(sql: str, names: dict[str, str]) -> str:
    for key, value in names.items():
        sql = sql.replace("{" + key + "}", value)
    return sql


def _too_few_splits(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Cores to spread a table over when its files give fewer splits; 0 when they suffice."""
    cores = spark.sparkContext.defaultParallelism
    splits = spark.read.parquet(f"{sf_dir}/{name}.parquet").rdd.getNumPartitions()
    return cores if splits < cores else 0


#: Rows of a message or state table in a task: its text rules cost up to a millisecond a row.
ROWS_A_TASK = 50_000


def _tasks(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks to spread a table over, by its rows; 0 when its own splits do.

    Splits are cut by bytes and Parquet reads whole row groups, so that splits may be empty and
    one may hold most rows: their number says little about a task's share.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    wanted = -(-rows // ROWS_A_TASK)
    return wanted if wanted > spark.sparkContext.defaultParallelism else _too_few_splits(spark, sf_dir, name)


def for_spark(spark: SparkSession, sql: str, sf_dir: str) -> str:
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    tasks = 0
    if "{spread}" in sql:
        tasks = _too_few_splits(spark, sf_dir, "lineitem") if "{lineitem}" in sql else _tasks(spark, sf_dir, "orders")
    hint = f"/*+ REPARTITION({tasks}) */" if tasks else ""
    return _fill(sql, names | {"hours": _STATE_HOURS["spark"], "spread": hint})


def for_duck(sql: str) -> str:
    return _fill(sql, {t: t for t in TABLES} | {"hours": _STATE_HOURS["duck"], "spread": ""})


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived relation; built messages are fixed once per row.

    Unpacking them from an array keeps a later filter from being pushed into the
    long text expressions and evaluating them a second time.
    """
    df = spark.sql(for_spark(spark, sql, sf_dir))
    if sql in (ALERTS, CARD_MAIL):
        df = df.select(F.inline(F.array(F.struct(*df.columns))))
    tasks = _tasks(spark, sf_dir, "part") if sql == STATE else 0
    return df.repartition(tasks) if tasks else df


def streamed(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """The same relation with base table ``name`` read as a stream of its files.

    The path is a pattern, since a file stream takes a folder or a pattern but no single file.
    """
    view = f"streamed_{name}"
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]").createOrReplaceTempView(view)
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES} | {name: view}
    df = spark.sql(_fill(sql, names | {"hours": _STATE_HOURS["spark"], "spread": ""}))
    return df.select(F.inline(F.array(F.struct(*df.columns)))) if sql in (ALERTS, CARD_MAIL) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; one too small to split is spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = _too_few_splits(spark, sf_dir, name) if name in ("documents", "pages") else 0
    return df.repartition(cores) if cores else df
