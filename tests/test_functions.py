"""Scalar rules on single values."""

import random

import pytest
from pyspark.sql import functions as F

from leadsift.functions import dates, html, labels, money, names, text
from leadsift.operators.commands import command_status
from leadsift.operators.extract import COMPANY_HIRING
from leadsift.operators.pages import decode_payload, quality_error
from leadsift.operators.segments import split_segments


@pytest.fixture(scope="module")
def value(spark):
    base = spark.range(1)
    return lambda column: base.select(column.alias("v")).first()["v"]


def test_scalars(value):
    lit = F.lit
    cases = [
        (names.normalize_company(lit(" mongodb ")), "MongoDB"),
        (names.normalize_title(lit("senior ai engineer (remote)")), "Senior AI Engineer"),
        (names.clean_title(lit("Exciting senior ml engineer role")), "Senior ML Engineer"),
        (money.estimate_salary(lit("CA$180k-250k")), 215000),
        (money.estimate_salary(lit("CA$145,000-210,000")), 177500),
        (money.estimate_salary(lit("words")), None),
        (money.salary_label(lit(212500)), "CA$212k"),
        (money.salary_label(lit(None).cast("bigint")), "Unknown"),
        (dates.age_days(lit("3 weeks ago")), 21),
        (dates.age_days(lit("posted on 7/6/26")), None),
        (labels.employment_type(lit("permanent"), lit("6-month")), "Contract"),
        (labels.compact_age(lit("2 months ago")), "2mo"),
        (labels.normalize_status(lit(" Follow-Up ")), "Follow-up needed"),
        (labels.normalize_status(lit("done")), None),
        (command_status(lit("/Review@bot 7")), "Reviewed"),
        (command_status(lit("/follow-up 7")), None),
        (text.preview(lit("a  b\nc"), 4), "a b."),
        (text.sections(lit("x\nPreferred\na\n\nApply\nb\nNice to have\nc"), ("preferred", "nice to have"), ("apply",)), "a\n\nc"),
    ]
    for column, expected in cases:
        assert value(column) == expected


def test_posting_age_and_expiry(value):
    now = dates.timestamp("2026-07-03T12:00:00")
    received = dates.timestamp("2026-06-30T19:00:00")
    assert value(dates.posting_age(F.lit("Posted 37 minutes ago."), received, now)) == "2 days ago"
    assert value(dates.is_expired(F.lit(""), F.lit("expiring on Jul 2"), now))
    assert not value(dates.is_expired(F.lit(""), F.lit("expiring on Jul 3"), now))
    assert not value(dates.is_expired(F.lit(""), F.lit("deadline Feb 30"), now))


def test_segments(value):
    short = value(split_segments(F.repeat(F.lit("abcdefgh\n"), 700)))
    assert len(short) == 2 and all(len(s) <= 3800 for s in short)
    long = value(split_segments(F.concat(F.repeat(F.lit("x"), 4295), F.lit("\n"))))
    assert [len(s) for s in long] == [3800, 495]
    assert value(split_segments(F.lit("short\n"))) == ["short\n"]


def test_pages(value):
    inner = "<div>Responsibilities &amp; more</div><p>Qualifications: " + "word " * 40 + "</p>"
    page = f'<body><nav>menu</nav><div class="x job-description">{inner}</div>after</body>'
    got = value(html.page_text(F.lit(page)))
    assert got.startswith("Responsibilities & more\nQualifications:") and "after" not in got
    url = F.lit("https://x.example")
    assert value(quality_error(F.lit("please Login now"), url)) == "authwall detected"
    assert value(quality_error(F.lit("fine"), F.lit("https://linkedin.com/ssr-login"))) == "login wall detected"
    assert value(quality_error(F.lit("short"), url)) == "description text below 500 characters"
    assert value(quality_error(F.lit("word " * 120), url)) is None


def test_valid_utf8_payloads_are_cast(spark):
    rows = [(1, b"caf\xc3\xa9", "text/html; charset=UTF-8"), (2, b"\xffa", None), (3, b"caf\xe9", "text/html; charset=latin-1"), (4, None, ""), (5, b"x", "text/html; charset=nope")]
    found = spark.createDataFrame(rows, "id INT, payload BINARY, kind STRING").select("id", decode_payload(F.col("payload"), F.col("kind")).alias("text"))
    assert [r.text for r in found.orderBy("id").collect()] == ["café", "�a", "café", None, "x"]
    # What is cast reaches Python as null.
    assert "is_valid_utf8" in found._jdf.queryExecution().analyzed().toString().lower()


def test_words_that_hold_another_word_are_not_searched():
    assert text.shortest(("data scientist", "senior data scientist", "ai", "ai", "rag")) == ["data scientist", "ai", "rag"]
    assert text.any_sql("x", ("hiring a", "hiring an")) == "contains(x, 'hiring a')"
    assert text.shortest(("td", "")) == [""] and text.any_sql("x", ()) == "false"


def test_hiring_companies_are_found_as_from_every_start(spark):
    spared = r"(?<![A-Z][0-9&.' -]{0,1})"
    assert spared in COMPANY_HIRING
    pieces = ["Acme", "a", "ı", " ", "  ", "\n", "4", "-", "&", "K", "ſ", "é", ":", "is hiring", " is hiring a ML Engineer", "\tis hiring Senior AI Engineer"]
    draw = random.Random(7)
    texts = ["".join(draw.choices(pieces, k=draw.randint(1, 9))) for _ in range(4000)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(
        *[text.rx(F.col("t"), p, g).alias(f"{n}{g}") for n, p in (("new", COMPANY_HIRING), ("old", COMPANY_HIRING.replace(spared, ""))) for g in (1, 2)]
    )
    assert found.where("NOT (new1 <=> old1 AND new2 <=> old2)").count() == 0 and found.where("new1 IS NOT NULL").count() > 300
