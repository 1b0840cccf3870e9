"""Message files to ranked postings, on own sample messages."""

import re

import pytest
from pyspark.sql import functions as F

from leadsift.functions.text import squeezed_lines
from leadsift.operators.digest import ranked_digest
from leadsift.operators.extract import extract
from leadsift.plans.intake import find_postings, find_postings_counted
from leadsift.sources.message_files import read_message_files

AS_OF = "2026-07-10T12:00:00"
MESSAGES = {
    "a.txt": "From: no-reply@greenhouse.io\nSubject: New job: Staff Data Scientist at Clutch\n\nRole: Staff Data Scientist\nCompany: Clutch\nLocation\n\nToronto\nSalary: CA$180k-240k\nForecasting and experimentation\nPosted today.\nApply: https://boards.greenhouse.io/clutch/jobs/1.\n",
    "b.txt": "From: LinkedIn <jobs@linkedin.com>\nSubject: Jobs for you\n\nApplied AI Engineer\nCohere\nToronto, ON\nhttps://www.linkedin.com/jobs/view/1\nData Analyst\nhttps://www.linkedin.com/jobs/view/2\nML Engineer\nWaabi\nRemote\nhttps://www.linkedin.com/jobs/view/3\nML Engineer\nWaabi\nHybrid\nhttps://www.linkedin.com/jobs/view/3\n",
    "c.txt": "From: shop@example.com\nSubject: Your receipt\n\nSenior Data Scientist wanted\n",
    "d.txt": "From: copy@greenhouse.io\nSubject: x\n\nRole: staff  data scientist\nCompany: CLUTCH\nLocation: toronto\nhttps://boards.greenhouse.io/CLUTCH/jobs/1\n",
}


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("mail")
    for name, text in MESSAGES.items():
        (folder / name).write_text(text, encoding="utf-8")
    return read_message_files(spark, str(folder))


def test_missing_folder_is_an_empty_inbox(spark, tmp_path):
    assert read_message_files(spark, str(tmp_path / "none")).count() == 0


def test_filter_extract_dedupe_and_counts(messages):
    df, counts = find_postings_counted(messages, AS_OF)
    rows = sorted(df.collect(), key=lambda r: (r.msg_seq, r.card_idx))
    got = [(r.source_id, r.company, r.title, r.location, r.job_link) for r in rows]
    assert got == [
        ("a", "Clutch", "Staff Data Scientist", "Toronto", "https://boards.greenhouse.io/clutch/jobs/1"),
        ("b", "Cohere", "Applied AI Engineer", "Toronto, ON", "https://www.linkedin.com/jobs/view/1"),
        # A card reaches four lines past its URL, so the analyst URL borrows the next posting.
        ("b", "Waabi", "ML Engineer", "Remote", "https://www.linkedin.com/jobs/view/2"),
        ("b", "Waabi", "ML Engineer", "Remote", "https://www.linkedin.com/jobs/view/3"),
    ]
    assert counts.summary() == {"loaded": 4, "filtered_out": 1, "parsed": 5, "duplicates": 1, "stored": 4}
    first = rows[0]
    # role 30, location 20, two skills 10, domain 8, staff 15, salary 10
    assert first.score == 93 and first.category == "Apply now"
    assert first.explanation.startswith("strong role-title match: staff data scientist; location not scored yet")


def test_row_order_does_not_matter(messages):
    def result(df):
        return sorted(map(str, find_postings(df, AS_OF).collect()))

    assert result(messages) == result(messages.orderBy("body").repartition(5))


def test_ranking_is_stable(messages):
    ranked = ranked_digest(find_postings(messages, AS_OF)).collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4]
    assert ranked[0].source_id == "a"


def test_one_shuffle_cut_before_it(messages):
    plan = find_postings(messages, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("WindowGroupLimit") == 2
    assert "EvalPython" not in plan


def test_message_facts_are_found_once_a_message(messages):
    """Expiry and core subject lie below the explode, so that they are not found again for each posting."""
    plan = extract(messages, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("no longer available") and plan.index("Generate explode") < plan.index("new job|message replied")


def test_lines_are_trimmed_and_squeezed(spark):
    texts = ["", "\n", " a  b \n\n c", "a\r\nb\rc\x0bd", "x\x85 y\u2028z\u3000\u3000w", "\ta\xa0 \tb\x1f\x1cc", "\u00e9  \u65e5\n\u2003k ", "one \n   \n two"]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", squeezed_lines(F.col("t")).alias("lines")).collect()
    ends = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    assert {r.t: r.lines for r in rows} == {t: [" ".join(x.split()) for x in re.split(ends, t) if x.strip()] for t in texts}
