"""List index, as-of join and global ranking against plain versions, and their plans."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from bindings import relations
from leadsift.operators.digest import ranked_rows
from leadsift.operators.pages import snapshot_at
from leadsift.operators.relevance import allowed_by_list, contained_tokens

START = dt.datetime(2026, 7, 1)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_tokens_in_texts_equal_a_scan(spark):
    rng = random.Random(4)

    def word(low, high):
        return "".join(rng.choice("abcdeé ") for _ in range(rng.randint(low, high)))

    texts = sorted({word(0, 30) for _ in range(300)} | {"", "aaaaaaaaaaaa", "éé"})
    tokens = sorted({word(1, 9) for _ in range(800)} | {"a", "aaaa", "zzzzzz", "é"})
    found = contained_tokens(spark.createDataFrame([(x,) for x in texts], "text STRING"), spark.createDataFrame([(x,) for x in tokens], "token STRING"))
    assert sorted(map(tuple, found.collect())) == sorted((x, k) for x in texts for k in tokens if k in x)


def test_long_lists_are_joined_by_pieces(spark):
    mail = spark.createDataFrame([(1, "Ana <ANA@Acme.example>"), (2, "bo@x.example"), (3, None), (4, "")], "id INT, sender STRING")
    listed = spark.createDataFrame([("@acme.",), (" B",), ("",), (None,), ("nobody@",)], "token STRING")
    for max_bytes in (0, 1 << 20):
        assert sorted(r.id for r in allowed_by_list(mail, listed, max_bytes).collect()) == [1, 2]
    assert "NestedLoop" not in plan(allowed_by_list(mail, listed, 0)) and "Cartesian" not in plan(allowed_by_list(mail, listed, 0))
    assert allowed_by_list(mail, listed.limit(0), 0).count() == 0


def test_pieces_of_long_tokens_stay_in_their_row(spark):
    texts = spark.createDataFrame([("user 1 <0123456789ab@mail.example>",), ("user 2 <ffff@mail.example>",)], "text STRING")
    tokens = spark.createDataFrame([("0123456789ab",), ("@mail.",), ("fffff",), ("nobody at all",)], "token STRING")
    found = contained_tokens(texts, tokens)
    assert sorted(r.token for r in found.collect()) == ["0123456789ab", "@mail.", "@mail."]
    # Pieces of texts of two widths; none of tokens, and no texts are cut for tokens that are not there.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2


def test_messages_are_spread_by_rows(spark, tmp_path):
    rows = 9 * relations.ROWS_A_TASK + 1
    spark.range(rows).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert "REPARTITION(10)" in relations.for_spark(spark, relations.CARD_MAIL, str(tmp_path))


def test_snapshots_as_of_equal_a_scan(spark):
    rng = random.Random(9)
    shots = [(f"u{rng.randint(0, 5)}", START + dt.timedelta(hours=rng.randint(0, 200)), f"f{i}") for i in range(120)]
    shots += [("u0", None, "no time"), (None, START, "no url"), ("u1", shots[0][1], "zz")]
    asked = sorted({(f"u{rng.randint(0, 7)}", START + dt.timedelta(hours=rng.randint(-20, 240))) for _ in range(80)})
    wanted = spark.createDataFrame(asked * 2, "url STRING, at TIMESTAMP")
    found = snapshot_at(wanted, spark.createDataFrame(shots, "url STRING, fetched_at TIMESTAMP, final_url STRING"), ("final_url",))
    plain = []
    for url, when in asked:
        before = [s for s in shots if s[0] == url and s[1] is not None and s[1] <= when]
        if before:
            last = max(s[1] for s in before)
            plain.append((url, when, last, min(s[2] for s in before if s[1] == last)))
    assert sorted(map(tuple, found.collect())) == sorted(plain)


def test_all_rows_are_ranked_without_one_task(spark):
    rows = spark.range(5_000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("score"), F.lit("x").alias("rank"))
    ranked = ranked_rows(rows.repartition(6), [F.desc("score"), F.col("id")], "place")
    got = [(r.place, r.id) for r in ranked.orderBy("place").collect()]
    plain = sorted(range(5_000), key=lambda i: (-(i * 7919 % 101), i))
    assert got == list(enumerate(plain, 1))
    # The one window without a partition runs over one row for each range.
    windows = re.findall(r"Window \[.*?\], \[(.*?)\]", plan(ranked))
    assert all("_range" in w or "sum(_n" in w or not w for w in windows)
    assert ranked_rows(rows.limit(0), [F.col("id")]).count() == 0
