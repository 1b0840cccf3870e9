"""DuckDB expression writers: the same rules stated again in plain SQL text."""

from __future__ import annotations

from leadsift import rules as r

TITLE_CASE = "[A-Za-z]+|[^A-Za-z]+"


def s(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def let(expr: str, var: str, body: str) -> str:
    return f"list_transform([{expr}], lambda {var}: {body})[1]"


def any_in(col: str, words) -> str:
    words = list(words)
    return "(" + " OR ".join(f"contains({col}, {s(w)})" for w in words) + ")" if words else "FALSE"


def count_in(col: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {s(w)}) AS INT)" for w in words) + ")"


def hits(col: str, labels) -> str:
    pairs = labels.items() if isinstance(labels, dict) else [(w, w) for w in labels]
    cases = ", ".join(f"CASE WHEN contains({col}, {s(w)}) THEN {s(v)} END" for w, v in pairs)
    return f"list_filter([{cases}], lambda h: h IS NOT NULL)"


def join(items: str, sep: str = "|") -> str:
    return f"array_to_string({items}, {s(sep)})"


def first_name(col: str, names) -> str:
    names = list(names)
    if not names:
        return "CAST(NULL AS VARCHAR)"
    return "coalesce(" + ", ".join(
        f"CASE WHEN regexp_matches({col}, {s('(^|[^a-z0-9])' + n + '([^a-z0-9]|$)')}) THEN {s(n)} END" for n in names
    ) + ", NULL)"


def shown(col: str, names) -> str:
    return f"(CASE {col} " + " ".join(f"WHEN {s(n)} THEN {s(r.display_name(n))}" for n in sorted(set(names))) + " END)"


def squeeze(e: str) -> str:
    return rf"trim(regexp_replace({e}, '\s+', ' ', 'g'))"


def strip(e: str) -> str:
    return rf"regexp_replace(regexp_replace({e}, '^\s+', ''), '\s+$', '')"


def replace(e: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({e}, {s(pattern)}, {s(to)}, 'g')"


def extract(e: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({e}, {s(pattern)}, {group})"


def title_case(e: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({e}, {s(TITLE_CASE)}), "
        "lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')"
    )


def acronyms(e: str) -> str:
    for word, fixed in r.ACRONYMS:
        e = replace(e, rf"\b{word}\b", fixed)
    return e


def company(e: str, v: str = "nc") -> str:
    c = f"trim({squeeze(e)}, ' -*|')"
    c = replace(c, r"(?i)\s+(?:is hiring|jobs?|careers?|hiring)$")
    c = replace(c, r"(?i)\s*:\s*(?:up to|update|new jobs?|jobs?|hiring).*$")
    c = replace(c, r"(?i)\s+-\s*(?:up to|jobs?|hiring).*$")
    c = f"rtrim({replace(c, '(?i)' + chr(92) + 's+and more$')}, '.')"
    names = " ".join(f"WHEN {s(k)} THEN {s(n)}" for k, n in r.COMPANY_NAMES.items())
    body = (
        f"CASE trim(replace(lower({v}), '.', '')) {names} ELSE "
        f"CASE WHEN {v} <> '' AND len(string_split({v}, ' ')) <= 3 "
        rf"AND NOT regexp_matches({v}, '(?i)\b(you|your|we|can|help|get|noticed|project|ring)\b') "
        f"AND NOT regexp_matches(substr({v}, 2), '[A-Z]') THEN {acronyms(title_case(v))} ELSE {v} END END"
    )
    return f"CASE WHEN coalesce({e}, '') = '' THEN 'Unknown' ELSE {let(c, v, body)} END"


def title(e: str, v: str = "nt") -> str:
    c = f"trim({squeeze(e)}, ' -*|')"
    for pattern in (
        r"(?i)^message replied:\s*", r"(?i)^re:\s*", r"(?i)^fwd?:\s*", r"(?i)^.+?,\s+apply to\s+",
        r"(?i)^new jobs similar to\s+", r"(?i)^.+?,\s+your job'?s expiring on .*?:\s*",
        r"\s+-\s+[0-9]+\s*$", r"(?i)\s*\|\s*remote\s*$", r"(?i)\s*\((remote|hybrid|on-site|onsite)\)\s*$",
    ):
        c = replace(c, pattern)
    cased = let(f"rtrim({c}, '.')", v, f"CASE WHEN lower({v}) = {v} AND upper({v}) <> {v} THEN {title_case(v)} ELSE {v} END")
    return f"CASE WHEN coalesce({e}, '') = '' THEN 'Unknown role' ELSE {acronyms(cased)} END"


def core_title(e: str, v: str = "ct") -> str:
    pattern = (
        r"(?i)(?:exciting\s+)?((?:senior\s+|staff\s+)?(?:machine learning engineer|ml engineer|"
        r"data scientist|ai engineer|applied ai engineer))\b"
    )
    core = extract(v, pattern)
    return let(title(e), v, f"CASE WHEN {core} = '' THEN {v} ELSE {title(title_case(core), 'nt2')} END")


def age_days(e: str) -> str:
    p = r"([0-9]+)\s*(minute|hour|day|week|month)"
    n, u = extract(f"lower({e})", p), extract(f"lower({e})", p, 2)
    return f"(CAST(nullif({n}, '') AS BIGINT) * CASE {u} WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 ELSE 0 END)"


def age_minutes(e: str) -> str:
    p = r"([0-9]+)\s*(minute|hour)"
    n, u = extract(f"lower({e})", p), extract(f"lower({e})", p, 2)
    return f"(CAST(nullif({n}, '') AS BIGINT) * CASE {u} WHEN 'hour' THEN 60 ELSE 1 END)"


def age_text(moment: str, as_of: str) -> str:
    d = f"(epoch_us({as_of}) - epoch_us({moment})) // 1000000"
    return (
        f"CASE WHEN {moment} IS NULL THEN NULL WHEN {d} < 120 THEN '1 minute ago' "
        f"WHEN {d} < 3600 THEN ({d}) // 60 || ' minutes ago' WHEN {d} < 7200 THEN '1 hour ago' "
        f"WHEN {d} < 86400 THEN ({d}) // 3600 || ' hours ago' WHEN {d} < 172800 THEN '1 day ago' "
        f"ELSE ({d}) // 86400 || ' days ago' END"
    )


def max_salary(e: str) -> str:
    n = "CAST(replace(m, ',', '') AS BIGINT)"
    return f"list_max(list_transform(regexp_extract_all({e}, '[0-9][0-9,]*'), lambda m: CASE WHEN {n} < 1000 THEN {n} * 1000 ELSE {n} END))"


def estimate(e: str) -> str:
    n = "CAST(regexp_replace(m, '[^0-9.]', '', 'g') AS DOUBLE)"
    each = f"CAST(round_even(CASE WHEN {n} < 1000 OR lower(right(m, 1)) = 'k' THEN {n} * 1000 ELSE {n} END, 0) AS BIGINT)"
    found = rf"list_transform(regexp_extract_all({e}, '[0-9][0-9,]*(?:\.[0-9]+)?\s*[kK]?'), lambda m: {each})"
    return let(found, "f", "CASE WHEN len(f) > 0 THEN CAST(round_even((list_min(f) + list_max(f)) / 2.0, 0) AS BIGINT) END")


def salary_label(e: str, missing: str) -> str:
    return f"coalesce('CA$' || CAST(round_even({e} / 1000.0, 0) AS BIGINT) || 'k', {s(missing)})"


CONTRACT = r"\b(contract|contractor|temporary|temp|[0-9]+\s*[- ]?\s*month)\b"


def employment(text: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({text}, {s(CONTRACT)}) THEN 'Contract' "
        rf"WHEN regexp_matches({text}, '\b(full[ -]?time|permanent|fte)\b') THEN 'Full-time' ELSE 'Unknown' END"
    )


def fingerprint(prefix: str = "") -> str:
    parts = [company(prefix + "company"), title(prefix + "title"), f"coalesce({prefix}location, '')", f"coalesce({prefix}job_link, '')"]
    keys = " || '|' || ".join(squeeze(f"lower({p})") for p in parts)
    return f"sha256({keys})"


def truncate(e: str, n: int) -> str:
    return f"CASE WHEN length({e}) > {n} THEN left({e}, {n - 1}) || '.' ELSE {e} END"


def host(e: str) -> str:
    return extract(f"lower({e})", r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/:?#]*)")


def path(e: str) -> str:
    return replace(extract(f"lower({e})", r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"), ";[^/]*$")


def squash(e: str) -> str:
    return f"regexp_replace(lower({e}), '[^a-z0-9]+', '', 'g')"


def paragraphs(e: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform(string_split({e}, chr(10)), lambda pl: {squeeze('pl')}), "
        "lambda pl: pl <> ''), chr(10))"
    )
