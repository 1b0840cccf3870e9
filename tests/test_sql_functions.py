from pyspark.sql import functions as F

from leadsift.operators.extract import message_cards
from leadsift.plans.sql_functions import SCALARS, register_functions, sql_text

TEXTS = [
    None, "", "It's \\ a \"test\"\n  line", "RE: Senior ML Engineer (Remote) - 12", "new\tpassed\x85",
    "Company: Acme's Labs\nSalary: $120k - $150k\nhttps://www.linkedin.com/jobs/view/1).", "<p>a &amp; b</p><script>x</script>",
    "https://Jobs.Example.com/a?b=c", "Bob is hiring a Data Scientist `x`", "ümläut 日本 \U0001f600 hybrid senior",
]


def test_scalar_functions_give_what_the_column_functions_give(spark):
    made = register_functions(spark, "t_")
    assert len(made) == len(SCALARS) + 1
    texts = spark.createDataFrame([(i, t, TEXTS[-i]) for i, t in enumerate(TEXTS)], "id INT, a STRING, b STRING")
    for name, (arguments, function) in SCALARS.items():
        given = ["a", "b", "a"][: len(arguments.split(", "))]
        plain = texts.select("id", function(*[F.col(c) for c in given]).alias("v"))
        called = spark.sql(f"SELECT id, t_{name}({', '.join(given)}) AS v FROM {{texts}}", texts=texts)
        assert sorted(called.collect()) == sorted(plain.collect()), name


def test_cards_of_no_text_and_of_one_posting(spark):
    register_functions(spark)
    body = "Acme\nML Engineer\nAcme\nToronto, ON\nhttps://www.linkedin.com/jobs/view/7"
    mail = spark.createDataFrame([(1, None), (2, ""), (3, body), (4, body)], "id INT, body STRING")
    rows = spark.sql("SELECT m.id, c.* FROM {mail} m, LATERAL posting_cards(m.body) c", mail=mail).collect()
    assert sorted((r.id, r.title, r.company, r.location, r.url) for r in rows) == [
        (i, "ML Engineer", "Acme", "Toronto, ON", "https://www.linkedin.com/jobs/view/7") for i in (3, 4)
    ]
    assert not spark.sql("SELECT c.* FROM {mail} m, LATERAL posting_cards(m.body) c", mail=mail.limit(0)).collect()


def test_sql_text_is_parsed_back_to_the_same_rows(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "body STRING")
    column = message_cards(F.coalesce(F.col("body"), F.lit("")))
    assert texts.select(F.expr(sql_text(column)).alias("v")).collect() == texts.select(column.alias("v")).collect()


def test_a_line_is_searched_for_a_title_once(spark):
    assert sql_text(message_cards(F.col("body"))).count("platform engineer") == 1
