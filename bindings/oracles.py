"""Oracle SQL: every query restated for DuckDB over the same base tables."""

from __future__ import annotations

from bindings import duck as d
from bindings import relations as rel
from leadsift import rules as r
from leadsift.rules import DEFAULT_RULES, RulePack

AS_OF = f"TIMESTAMP '{rel.AS_OF}'"


def _with(*ctes: tuple[str, str], final: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes) + "\n" + final


def relevant(rules: RulePack = DEFAULT_RULES, body: str = "body") -> str:
    scanned = body if rules.scan_chars is None else f"left({body}, {rules.scan_chars})"
    text = f"lower(subject) || chr(10) || lower({scanned})"
    known = f"({d.any_in('lower(sender)', rules.sender_tokens())} OR {d.any_in('lower(sender)', r.SENDER_MARKERS)})"
    return d.let(text, "t", f"NOT {d.any_in('t', r.NOISE_MARKERS)} AND ({known} OR {d.any_in('t', r.TEXT_MARKERS)})")


_ROLE = (
    r"(?:Data Scientist|Machine Learning Scientist|Machine Learning Engineer|ML Scientist|ML Engineer|"
    r"AI Engineer|Applied AI Engineer)"
)
IS_HIRING = (
    r"(?i)([A-Z][A-Za-z0-9&.' -]+?)\s+is hiring\s+(?:a |an )?"
    rf"((?:Senior/Staff\s+|Senior\s+|Staff\s+)?(?:Applied\s+)?{_ROLE})"
)
CONTRACT_MAIL = (
    r"(?i)^(.+?)\s+Contract Opportunity\b.*?\b((?:Senior\s+|Staff\s+)?(?:Data Scientist|"
    r"Machine Learning Engineer|ML Engineer|AI Engineer|Applied AI Engineer))\b"
)


def labelled(label: str, text: str = "body") -> str:
    inline = d.extract(text, rf"(?im-s)^{label}\s*:\s*(.+)$")
    below = d.extract(text, rf"(?im-s)^[ \t]*{label}[ \t]*\n\s*(\S.*)$")
    return f"CASE WHEN {inline} <> '' THEN nullif({d.strip(inline)}, '') ELSE nullif({d.strip(below)}, '') END"


def subject_core(e: str = "subject") -> str:
    c = d.strip(e)
    for p in (
        r"(?i)^.+?,\s+your job'?s expiring on .*?:\s*", r"(?i)^.+?,\s+apply to\s+",
        r"(?i)^new jobs similar to\s+", r"(?i)^(\s*(new job|message replied|re|fw|fwd)\s*:\s*)+",
    ):
        c = d.replace(c, p)
    return c


# Message facts, one row per alert message.
FACTS = f"""
  SELECT *, lower(body) AS low, {subject_core()} AS core,
    {labelled('Role')} AS l_role, {labelled('Company')} AS l_company,
    {labelled('Location')} AS l_location, {labelled('Salary')} AS l_salary,
    {d.extract('body', r"(?i-s)we(?:'re| are) hiring (?:a |an )?(.+?)(?: on| for|\.|\n)")} AS hiring,
    {d.extract('body', IS_HIRING, 1)} AS body_co, {d.extract('body', IS_HIRING, 2)} AS body_role,
    {d.extract('body', r"(?:\b[0-9]+\s*-\s*month\s+)?([A-Z][A-Za-z&. ]+?)\s+contract\s+via\s+")} AS prose_co
  FROM alerts
"""
_MONTHS = "CASE lower(mon) " + " ".join(
    f"WHEN '{k}' THEN {i}" for i, m in enumerate(r.MONTHS, 1) for k in dict.fromkeys((m, m[:3], "sept" if m == "september" else m))
) + " END"
EXPIRY = rf"(?i)\b(?:expiring|expires|deadline)\s+(?:on\s+)?([A-Za-z]{{3,9}})\.?\s+([0-9]{{1,2}})\b"
NAMED = f"""
  SELECT *,
    CASE WHEN l_role IS NULL AND hiring = '' AND {d.extract('core', IS_HIRING, 2)} = '' AND body_role = ''
              AND {d.extract('core', CONTRACT_MAIL, 2)} = '' AND NOT contains(lower(core), ' at ') AND NOT contains(core, ' - ')
              AND contains(lower(core), 'opportunity') AND contains(lower(core), 'applied ai') THEN 'Applied AI role'
         ELSE {d.core_title("CASE WHEN l_role IS NOT NULL THEN l_role WHEN hiring <> '' THEN hiring WHEN " + d.extract('core', IS_HIRING, 2) + " <> '' THEN " + d.extract('core', IS_HIRING, 2) + " WHEN body_role <> '' THEN body_role WHEN " + d.extract('core', CONTRACT_MAIL, 2) + " <> '' THEN " + d.extract('core', CONTRACT_MAIL, 2) + " WHEN contains(lower(core), ' at ') THEN " + d.extract('core', '(?i)^(.*?)' + chr(92) + 's+at' + chr(92) + 's+') + " WHEN contains(core, ' - ') THEN split_part(core, ' - ', 1) ELSE core END")} END AS title,
    coalesce(
      l_company,
      {d.let("CASE WHEN prose_co <> '' THEN prose_co WHEN " + d.extract('core', IS_HIRING, 1) + " <> '' THEN " + d.extract('core', IS_HIRING, 1) + " WHEN body_co <> '' THEN body_co WHEN " + d.extract('core', CONTRACT_MAIL, 1) + " <> '' THEN " + d.extract('core', CONTRACT_MAIL, 1) + " WHEN " + d.extract('core', '(?i)' + chr(92) + 's+at' + chr(92) + 's+(.+)$') + " <> '' THEN " + d.extract('core', '(?i)' + chr(92) + 's+at' + chr(92) + 's+(.+)$') + " WHEN contains(core, ' - ') AND substr(core, strpos(core, ' - ') + 3) <> '' AND NOT contains(lower(substr(core, strpos(core, ' - ') + 3)), 'marketing') THEN substr(core, strpos(core, ' - ') + 3) END", 'rc', "CASE WHEN rc IS NOT NULL THEN " + d.company('rc') + " END")},
      {", ".join(f"CASE WHEN contains(lower(sender), {d.s(k)}) THEN {d.s(c)} END" for k, c in r.SENDER_COMPANIES)},
      list_last(regexp_extract_all(body, '(?m)^[ \\t]*({'|'.join(r.SIGNATURE_COMPANIES)})\\s*$', 1)),
      'Unknown') AS company,
    {d.hits('low', DEFAULT_RULES.skill_labels())} AS all_skills,
    array_to_string(list_transform(regexp_extract_all(
      regexp_replace(regexp_replace(body, '(?im)^[ \\t]*(preferred|nice to have)[ \\t]*$', chr(1), 'g'),
                     '(?im)^[ \\t]*({'|'.join(r.SECTION_STOPS)})[ \\t]*$', chr(2), 'g') || chr(10) || chr(2),
      chr(1) || '([^' || chr(1) || chr(2) || ']*)', 1), lambda g: g), '') AS liked_text,
    {d.extract("subject || chr(10) || body", EXPIRY, 1)} AS mon, {d.extract("subject || chr(10) || body", EXPIRY, 2)} AS dom,
    nullif({d.strip(d.extract('body', r'(?i-s)Posted\s+(.+?)(?:\.|\n|$)'))}, '') AS said
  FROM facts
"""
_UNIT = r"([0-9]+)\s+(day|week)"
_BEFORE = (
    rf"CASE WHEN contains(lower(said), 'minute') THEN coalesce(try_cast({d.extract('lower(said)', '([0-9]+)' + chr(92) + 's+minute')} AS BIGINT), 0) "
    rf"WHEN contains(lower(said), 'hour') THEN 60 * coalesce(try_cast({d.extract('lower(said)', '([0-9]+)' + chr(92) + 's+hour')} AS BIGINT), 0) "
    rf"ELSE try_cast({d.extract('lower(said)', _UNIT)} AS BIGINT) * CASE {d.extract('lower(said)', _UNIT, 2)} WHEN 'day' THEN 1440 WHEN 'week' THEN 10080 END END"
)
_LOWTEXT = "lower(subject || chr(10) || body)"
_THREE = r"(-\s*|level\s*)3\b"
POSTINGS = f"""
  SELECT source_id, msg_seq, 0 AS card_idx, company, CASE WHEN title = '' THEN 'Unknown role' ELSE title END AS title,
    l_location AS location,
    CASE WHEN contains(low, 'hybrid') THEN 'Hybrid' WHEN contains(low, 'remote') THEN 'Remote'
         WHEN contains(low, 'on-site') OR contains(low, 'onsite') THEN 'On-site' END AS work_mode,
    l_salary AS salary_range,
    {d.let("lower(CASE WHEN title = '' THEN 'Unknown role' ELSE title END) || chr(10) || low", "tl",
           f"CASE WHEN contains(tl, 'staff') THEN 'Staff' WHEN contains(tl, 'senior') THEN 'Senior' WHEN contains(tl, 'junior') OR contains(tl, '1-2 years') THEN 'Junior' WHEN regexp_matches(tl, {d.s(_THREE)}) OR contains(tl, '8+ years') OR contains(tl, '5+ years') THEN 'Senior' END")} AS seniority,
    list_filter(all_skills, lambda k: NOT list_contains({d.hits('lower(liked_text)', DEFAULT_RULES.skill_labels())}, k)) AS required_skills,
    {d.hits('lower(liked_text)', DEFAULT_RULES.skill_labels())} AS preferred_skills,
    nullif(rtrim({d.extract('body', r'https?://[^ \s]+', 0)}, ').,'), '') AS job_link,
    sender AS source_email,
    CASE WHEN said IS NOT NULL AND received_at IS NOT NULL AND {_BEFORE} IS NOT NULL
           THEN {d.age_text(f"(received_at - to_minutes({_BEFORE}))", AS_OF)}
         WHEN said IS NOT NULL THEN said ELSE {d.age_text('received_at', AS_OF)} END AS posted_date,
    ({d.any_in(_LOWTEXT, r.EXPIRED_PHRASES)} OR
      coalesce(CASE WHEN try_cast('2001-' || lpad(CAST({_MONTHS} AS VARCHAR), 2, '0') || '-' || lpad(dom, 2, '0') AS DATE) IS NOT NULL
        THEN try_cast((CASE WHEN {_MONTHS} < 8 - 6 THEN '2002-' ELSE '2001-' END) || lpad(CAST({_MONTHS} AS VARCHAR), 2, '0') || '-' || lpad(dom, 2, '0') AS DATE) END < DATE '2001-08-02', FALSE)) AS is_expired
  FROM named
"""
MAIL = (("alerts", rel.ALERTS), ("facts", FACTS), ("named", NAMED), ("postings", POSTINGS))
RELEVANT_MAIL = (
    ("raw_alerts", rel.ALERTS), ("alerts", f"SELECT * FROM raw_alerts WHERE {relevant()}"),
    ("facts", FACTS), ("named", NAMED), ("postings", POSTINGS),
)
KEYS = ", ".join(d.squeeze(f"lower(coalesce({c}, ''))") for c in ("company", "title", "location", "job_link"))
DEDUPED = f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY msg_seq, card_idx) AS rn FROM postings) x WHERE rn = 1"


def scoring(source: str, rules: RulePack = DEFAULT_RULES, extra: str = "") -> tuple[tuple[str, str], ...]:
    """CTEs texts -> matched -> parts -> scored over a postings relation."""
    tierish = {*rules.tier_a, *rules.tier_b, *rules.tier_c, *rules.always, *rules.never, *rules.ai_native}
    skills = "array_to_string(required_skills, ' ')", "array_to_string(preferred_skills, ' ')"
    texts = f"""
      SELECT * REPLACE ({d.company('company')} AS company, {d.title('title')} AS title) FROM {source}
    """
    lowered = f"""
      SELECT *, lower(title) AS tt, lower(company || ' ' || title) AS nm,
        lower(company || ' ' || title || ' ' || coalesce(location, '') || ' ' || coalesce(seniority, '') || ' ' || coalesce(work_mode, '') || ' ' || {skills[0]} || ' ' || {skills[1]}) AS whole,
        lower(array_to_string(list_concat(required_skills, preferred_skills), ' ')) AS sk,
        lower(title || ' ' || company || ' ' || {skills[0]} || ' ' || {skills[1]}) AS dm,
        {d.age_days('posted_date')} AS days, {d.age_minutes('posted_date')} AS mins, {d.max_salary("nullif(salary_range, '')")} AS sal
      FROM texts
    """
    matched = f"""
      SELECT *, {d.first_name('whole', rules.never)} AS never_, {d.first_name('whole', rules.always)} AS always_,
        {d.hits('tt', rules.role_terms)} AS roles, {d.hits('sk', rules.skill_terms)} AS sh, {d.hits('dm', rules.domain_terms)} AS dh,
        {d.first_name('nm', rules.tier_a)} AS a_, {d.first_name('nm', rules.tier_b)} AS b_, {d.first_name('nm', rules.tier_c)} AS c_,
        {d.first_name('whole', rules.ai_native)} AS native_, {d.first_name('whole', rules.tier_c)} AS cany_,
        {d.any_in('tt', r.TARGET_ROLE_TERMS)} AS target_, {d.any_in('whole', r.AI_FOCUS_TERMS)} AS focus_,
        {d.any_in('whole', r.HIGH_INTENT_TERMS)} AS intent_, {d.any_in('whole', rules.strategic_terms)} AS strategic_,
        {d.any_in('whole', rules.limited_terms)} AS limited_,
        coalesce(is_expired, FALSE) OR coalesce(days >= 14, FALSE) AS expired_
      FROM lowered
    """
    lvl = "lower(coalesce(seniority, ''))"
    show = lambda c: d.shown(c, tierish)
    pen = [
        ("lower(coalesce(work_mode, '')) = 'on-site'", -12, "'on-site role is a preference mismatch'"),
        (f"regexp_matches(whole, {d.s(d.CONTRACT)})", -8, "'contract role is less preferred'"),
        (r"regexp_matches(whole, '\brelocat(e|ion|ing)\b')", -15, "'relocation requirement is a preference mismatch'"),
        ("coalesce(days >= 14, FALSE)", 0, "'posting is more than 2 weeks old: ' || days || ' days'"),
        ("contains(tt, 'analyst')", -10, "'analyst title is below target scope'"),
        ("company = 'Unknown'", -8, "'company missing'"),
        ("coalesce(job_link, '') = ''", -4, "'apply link missing'"),
    ]
    parts = f"""
      SELECT *,
        CASE WHEN len(roles) > 0 THEN 30 WHEN {d.any_in('tt', r.CORE_ROLE_TERMS)} THEN 28 WHEN contains(tt, 'machine learning') OR contains(tt, 'ai') THEN 22
             WHEN contains(tt, 'analyst') OR contains(tt, 'marketing') THEN 0 ELSE 8 END AS p_role,
        CASE WHEN len(roles) > 0 THEN 'strong role-title match: ' || array_to_string(roles, ', ') WHEN {d.any_in('tt', r.CORE_ROLE_TERMS)} THEN 'core role-family match'
             WHEN contains(tt, 'machine learning') OR contains(tt, 'ai') THEN 'partial role-title match'
             WHEN contains(tt, 'analyst') OR contains(tt, 'marketing') THEN 'role title is outside target roles' ELSE 'role title has limited target alignment' END AS w_role,
        least(25, 5 * len(sh)) AS p_skills,
        CASE WHEN len(sh) = 0 THEN 'no target skill match found' ELSE 'target skills matched: ' || array_to_string(sh[1:5], ', ') END AS w_skills,
        CASE WHEN target_ AND len(dh) > 0 THEN 8 ELSE 0 END AS p_domain,
        CASE WHEN target_ AND len(dh) > 0 THEN 'relevant DS domain signal: ' || array_to_string(dh[1:4], ', ') END AS w_domain,
        CASE WHEN always_ IS NOT NULL THEN 15 ELSE 0 END AS p_always,
        CASE WHEN always_ IS NOT NULL THEN 'personal company whitelist: ' || {show('always_')} END AS w_always,
        CASE WHEN a_ IN ('workday', 'thomson reuters') AND NOT focus_ THEN 0 WHEN a_ IS NOT NULL THEN 10 WHEN b_ IS NOT NULL THEN 6 WHEN c_ IS NOT NULL AND focus_ THEN 3 ELSE 0 END AS p_tier,
        CASE WHEN a_ IN ('workday', 'thomson reuters') AND NOT focus_ THEN {show('a_')} || ' needs AI/platform focus for tier A boost'
             WHEN a_ IS NOT NULL THEN 'tier A company preference: ' || {show('a_')} WHEN b_ IS NOT NULL THEN 'tier B company preference: ' || {show('b_')}
             WHEN c_ IS NOT NULL AND focus_ THEN 'traditional enterprise with AI/platform focus: ' || {show('c_')} END AS w_tier,
        CASE WHEN native_ IS NOT NULL AND target_ AND strategic_ THEN 14 WHEN coalesce(job_link, '') <> '' AND target_ AND intent_ THEN 6
             WHEN cany_ IS NOT NULL AND limited_ THEN -8 WHEN limited_ THEN -4 ELSE 0 END AS p_strategic,
        CASE WHEN native_ IS NOT NULL AND target_ AND strategic_ THEN 'strategic next step: ' || {show('native_')} || ' moves toward AI engineering'
             WHEN coalesce(job_link, '') <> '' AND target_ AND intent_ THEN 'strategic next step: role builds Applied AI/AI systems direction'
             WHEN cany_ IS NOT NULL AND limited_ THEN 'limited strategic movement: ' || {show('cany_')} || ' role appears enterprise/compliance-focused'
             WHEN limited_ THEN 'limited strategic movement toward long-term AI direction' END AS w_strategic,
        CASE WHEN contains({lvl}, 'staff') OR contains(tt, 'staff') THEN 15 WHEN contains({lvl}, 'senior') OR contains(tt, 'senior') THEN 14
             WHEN contains({lvl}, 'junior') OR contains(tt, 'junior') THEN -12 WHEN {lvl} = '' THEN 4 ELSE 6 END AS p_seniority,
        CASE WHEN contains({lvl}, 'staff') OR contains(tt, 'staff') THEN 'staff-level growth signal' WHEN contains({lvl}, 'senior') OR contains(tt, 'senior') THEN 'senior-level match'
             WHEN contains({lvl}, 'junior') OR contains(tt, 'junior') THEN 'junior role is below target seniority' WHEN {lvl} = '' THEN 'seniority unclear' ELSE 'seniority has limited target alignment' END AS w_seniority,
        CASE WHEN coalesce(salary_range, '') = '' THEN 3 WHEN sal IS NULL THEN 4 WHEN sal >= 200000 THEN 10 WHEN sal >= 160000 THEN 7 WHEN sal >= 120000 THEN 4 ELSE 0 END AS p_salary,
        CASE WHEN coalesce(salary_range, '') = '' THEN 'salary missing' WHEN sal IS NULL THEN 'salary listed but could not be parsed' WHEN sal >= 200000 THEN 'salary signal is strong'
             WHEN sal >= 160000 THEN 'salary signal is reasonable' WHEN sal >= 120000 THEN 'salary signal is moderate' ELSE 'salary appears below target trajectory' END AS w_salary,
        CASE WHEN mins <= 120 THEN 'fresh posting: posted within the last 2 hours' END AS w_fresh,
        {' + '.join(f'CASE WHEN {t} THEN {p} ELSE 0 END' for t, p, _ in pen)} AS p_penalty,
        nullif(concat_ws(', ', {', '.join(f'CASE WHEN {t} THEN {w} END' for t, _, w in pen)}), '') AS w_penalty,
        CASE WHEN expired_ THEN 'job appears expired or no longer accepting applications' END AS w_expired
      FROM matched
    """
    total = "20 + p_role + p_skills + p_domain + p_always + p_tier + p_strategic + p_seniority + p_salary + p_penalty"
    whys = "w_role, 'location not scored yet', w_skills, w_domain, w_always, w_tier, w_strategic, w_seniority, w_salary, w_fresh, w_penalty, w_expired"
    scored = f"""
      SELECT *, CASE WHEN score >= {rules.apply_at} THEN 'Apply now' WHEN score >= {rules.investigate_at} THEN 'Investigate' ELSE 'Skip' END AS category FROM (
        SELECT * REPLACE (expired_ AS is_expired),
          CASE WHEN never_ IS NOT NULL OR expired_ THEN 0 ELSE greatest(0, least(100, {total})) END AS score,
          CASE WHEN never_ IS NOT NULL THEN 'company is on personal blacklist: ' || {show('never_')} ELSE concat_ws('; ', {whys}) END AS explanation
        FROM parts) y
    """
    return (("texts", texts), ("lowered", lowered), ("matched", matched), ("parts", parts), ("scored", scored))


FLOW = (*RELEVANT_MAIL, ("deduped", DEDUPED), *scoring("deduped"))
POSTING_COLUMNS = (
    "source_id, CAST(card_idx AS BIGINT) AS card_idx, company, title, location, work_mode, salary_range, seniority, "
    "array_to_string(required_skills, '|') AS required_skills, array_to_string(preferred_skills, '|') AS preferred_skills, "
    "job_link, source_email, posted_date, is_expired"
)
SCORED_COLUMNS = "source_id, company, title, CAST(score AS BIGINT) AS score, category, explanation, is_expired"

# --- cards of multi-posting messages ---------------------------------------------
_POSTED_ON = r"(?i)\bposted\s+on\s+([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})\b"
_URL = r"(?i)https?://[^ \s]*linkedin\.com/[^ \s]*jobs/view/[^ \s]*"
_PLACE = (
    r"\b(remote|hybrid|on-site|onsite|canada|united states|toronto|vancouver|montreal|ontario)\b"
)
_CODES = r"(,\s*|\b)(ON|BC|QC|AB|NY|CA|WA|MA|TX|IL)\b"


def _noise(v: str) -> str:
    return f"(lower({v}) IN ({', '.join(d.s(n) for n in r.CARD_NOISE_LINES)}) OR {d.any_in(f'lower({v})', r.CARD_NOISE_PARTS)})"


def _unsuffixed(v: str) -> str:
    e = d.replace(v, r"(?i)\s+posted\s+on\s+[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b.*$")
    return d.strip(d.replace(e, r"(?i)\s+[0-9]+\s+applicants?.*$"))


def _is_title(v: str) -> str:
    return d.let(_unsuffixed(v), "ut", f"ut <> '' AND NOT {_noise('ut')} AND {d.any_in('lower(ut)', r.CARD_ROLE_TERMS)}")


def _is_place(v: str) -> str:
    return f"(regexp_matches(lower({v}), {d.s(_PLACE)}) OR regexp_matches({v}, {d.s(_CODES)}))"


def _is_company(v: str) -> str:
    return (
        f"({v} <> '' AND NOT {_noise(v)} AND NOT regexp_matches({v}, {d.s(_POSTED_ON)}) AND NOT {_is_place(v)} "
        f"AND NOT ({_is_title(v)}) AND len(string_split({v}, ' ')) <= 5)"
    )


_CLEAN = "trim(" + d.squeeze(r"regexp_replace(cl, 'https?://[^ \s]+', '', 'g')") + ", ' -*|')"
CARDS = (
    ("mail", rel.CARD_MAIL),
    ("split_lines", "SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda sl: trim(sl)), lambda sl: sl <> '') AS ls FROM mail"),
    (
        "digests",
        f"""SELECT * FROM split_lines WHERE len(regexp_extract_all(body, {d.s(_URL)})) >= 2
             OR (len(regexp_extract_all(body, {d.s(_URL)})) = 1 AND regexp_matches(body, {d.s(_POSTED_ON)}))""",
    ),
    ("numbered", "SELECT source_id, i, ls[i] AS line FROM (SELECT source_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM digests) n"),
    (
        "marks",
        f"""SELECT source_id, i, lag(i, 1, 0) OVER (PARTITION BY source_id ORDER BY i) AS prev,
              rtrim({d.extract('line', _URL, 0)}, ').,') AS url FROM numbered WHERE regexp_matches(line, {d.s(_URL)})""",
    ),
    (
        "windows",
        f"""SELECT m.source_id, m.i, m.url, g.msg_seq, g.subject, g.sender, g.received_at, g.body,
              list_filter(list_transform(g.ls[greatest(m.prev + 1, m.i - 8):m.i + 4], lambda cl: {_CLEAN}), lambda cl: cl <> '' AND NOT {_noise('cl')}) AS cl
            FROM marks m JOIN digests g USING (source_id)""",
    ),
    ("titled", f"SELECT *, list_position(list_transform(cl, lambda tl: {_is_title('tl')}), TRUE) AS ti FROM windows"),
    (
        "companied",
        f"""SELECT *, list_filter(list_concat(cl[ti + 1:ti + 4], list_reverse(cl[greatest(ti - 3, 1):ti - 1])), lambda cc: {_is_company('cc')})[1] AS cline
            FROM titled WHERE ti > 0""",
    ),
    (
        "card_named",
        f"""SELECT *, {d.core_title(_unsuffixed('cl[ti]'))} AS title, {d.company('cline')} AS company, array_to_string(cl, chr(10)) AS text
            FROM companied WHERE cline IS NOT NULL""",
    ),
    (
        "card_first",
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, lower(company), lower(title), url ORDER BY i) AS rn FROM card_named) z WHERE rn = 1""",
    ),
    (
        "card_rows",
        f"""SELECT source_id, msg_seq, i - 1 AS card_idx, company, title,
              list_filter(cl, lambda pl: {_is_place('pl')} AND NOT ({_is_title('pl')}))[1] AS location,
              CASE WHEN contains(lower(text), 'hybrid') THEN 'Hybrid' WHEN contains(lower(text), 'remote') THEN 'Remote'
                   WHEN contains(lower(text), 'on-site') OR contains(lower(text), 'onsite') THEN 'On-site' END AS work_mode,
              CAST(NULL AS VARCHAR) AS salary_range,
              {d.let("lower(title || chr(10) || text)", "tl", f"CASE WHEN contains(tl, 'staff') THEN 'Staff' WHEN contains(tl, 'senior') THEN 'Senior' WHEN contains(tl, 'junior') OR contains(tl, '1-2 years') THEN 'Junior' WHEN regexp_matches(tl, {d.s(_THREE)}) OR contains(tl, '8+ years') OR contains(tl, '5+ years') THEN 'Senior' END")} AS seniority,
              {d.hits('lower(text)', DEFAULT_RULES.skill_labels())} AS required_skills, CAST([] AS VARCHAR[]) AS preferred_skills,
              url AS job_link, sender AS source_email,
              coalesce('posted on ' || nullif({d.extract('text', _POSTED_ON)}, ''), {d.age_text('received_at', AS_OF)}) AS posted_date,
              FALSE AS is_expired
            FROM card_first""",
    ),
)
