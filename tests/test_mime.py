"""Messages decoded by column functions against the standard library's parser."""

import datetime as dt
from email import policy
from email.headerregistry import HeaderRegistry
from email.message import EmailMessage
from email.parser import BytesParser
from email.utils import parsedate_to_datetime

from pyspark.sql import functions as F

from leadsift.functions import mime
from leadsift.sources.mailbox import choose_body, decode_messages


def built(subject="Hello", sender="Ana <ana@x.example>", date="Thu, 02 Aug 2001 10:00:00 +0200", **headers):
    m = EmailMessage()
    m["From"], m["Subject"], m["Date"] = sender, subject, date
    for name, value in headers.items():
        m[name.replace("_", "-")] = value
    return m


def samples():
    plain = built()
    plain.set_content("first line\nsecond line = 100%\n")
    accents = built("Größe und Höhe – 日本語 " + "lang " * 30, "Zoë Müller <zoe@x.example>", Message_ID=" <a@b> ")
    accents.set_content("é" * 200 + "\nhé = 5\n", cte="quoted-printable")
    coded = built(date="Fri, 3 Aug 01 9:05 EST")
    coded.set_content("naïve café\n" * 20, charset="iso-8859-1", cte="base64")
    windows = built(date="nonsense")
    windows.set_content("“quoted” – €5\n", charset="windows-1252", cte="quoted-printable")
    cyrillic = built("Привет, мир")
    cyrillic.set_content("Привет\n", charset="koi8-r", cte="base64")
    both = built()
    both.set_content("plain body\n")
    both.add_alternative("<p>html é</p>\n", subtype="html")
    both.add_attachment(b"\x00\xff\n--x\n" * 50, maintype="application", subtype="octet-stream", filename="a.bin")
    inner = built("inner subject")
    inner.set_content("inner text\n")
    carrier = built()
    carrier.add_attachment(inner)
    carrier.add_attachment("note é\n", filename="n.txt")
    texts = [m.as_bytes() for m in (plain, accents, coded, windows, cyrillic, both, carrier)]
    texts += [t.replace(b"\n", b"\r\n") for t in texts]
    nested = (
        b"Subject: n\nContent-Type: multipart/mixed;\n\tboundary=\"o.(1)\"\n\npreamble\n--o.(1)\n"
        b"Content-Type: multipart/alternative; boundary=in\n\nx\n--in\nContent-Type: text/html\n\n<b>1</b>\n--in\n\nplain 2\n"
        b"--in--\nepilogue\n--o.(1)\nContent-Type: text/plain; charset=us-ascii\n\nbad \xe9 byte\n-- \nsignature\n--o.(1)--\nend\n"
    )
    quoting = (
        b"Content-Type: multipart/mixed; boundary=real\n\n--real\nContent-Type: text/plain\n\n> see\n"
        b"Content-Type: multipart/mixed; boundary=fake\n\n--fake\nquoted\n--fake--\ntail\n--real--\n"
    )
    torn = b"Content-Type: multipart/mixed; boundary=q\n\n--q\n\nonly part\n--q\nContent-Type: text/html\n\n<i>never closed</i>"
    unknown = b"Subject: u\nContent-Type: text/plain; charset=no-such\n\nbody\n"
    folded = b"From: a@b\nSUBJECT: one\n two\n\tthree\nSubject: later\nDate: 2 Aug 2001 10:00:00 GMT\n\n\nbody after a blank\n"
    words = b"Subject: =?utf-8?q?a=C3=A9_b?= =?ISO-8859-1?B?6Q==?= plain =?utf-8?B?4pyT?=\nDate: Tue, 31 Feb 2001 10:00:00 +0000\n\nx"
    encoded = b"Content-Type: text/plain; charset=UTF-8\nContent-Transfer-Encoding: base64\n\naGVsbG8gd29y\nbGQ=\n"
    return texts + [nested, quoting, torn, unknown, folded, words, encoded, b"", b"no headers at all\n\nbody\n", b"Subject: only a head"]


def expected(raw):
    parser = BytesParser(policy=policy.default.clone(header_factory=HeaderRegistry(use_default_map=False)))
    message = parser.parsebytes(raw)
    try:
        date = parsedate_to_datetime(str(message["Date"])) if message["Date"] else None
    except ValueError:
        date = None
    if date is not None and date.tzinfo is None:
        date = date.replace(tzinfo=dt.timezone.utc)

    def content(part):
        try:
            return str(part.get_content()) if part.get_content_maintype() == "text" else ""
        except LookupError:
            return ""

    leaves = [(p.get_content_type(), content(p).rstrip()) for p in message.walk() if not p.is_multipart()]
    kinds = [k for k, _ in leaves]
    wanted = next((k for k in ("text/plain", "text/html") if k in kinds), None) if message.is_multipart() else kinds[0]
    body = leaves[kinds.index(wanted)][1] if wanted else ""
    return (
        str(message["Message-ID"] or "").strip(), str(message["Subject"] or ""), str(message["From"] or ""),
        int(date.timestamp()) if date else None, message.is_multipart(), leaves, body,
    )


def test_messages_equal_the_standard_parser(spark):
    raws = samples()
    rows = spark.createDataFrame([("m", i, bytearray(r)) for i, r in enumerate(raws)], "mailbox STRING, uid BIGINT, raw BINARY")
    got = {r.uid: r for r in decode_messages(rows).withColumn("body", choose_body()).selectExpr(
        "*", "unix_timestamp(received_at) AS at").collect()}
    assert len(got) == len(raws)
    for i, raw in enumerate(raws):
        r = got[i]
        leaves = [(p.type, p.content.rstrip()) for p in r.parts]
        assert (r.message_id, r.subject, r.sender, r.at, r.multipart, leaves, r.body.rstrip()) == expected(raw), (i, raw[:300])


def test_null_raw_and_very_long_bodies(spark):
    long = b"Subject: l\nContent-Type: text/plain; charset=utf-8\n\n" + "wörd = ".encode() * 300_000
    many = b"Content-Type: multipart/mixed; boundary=b\n\n" + b"--b\n\npart\n" * 500 + b"--b--\n"
    rows = spark.createDataFrame(
        [("m", 1, None), ("m", 2, bytearray(long)), ("m", 3, bytearray(many)), ("m", 3, bytearray(many))], "mailbox STRING, uid BIGINT, raw BINARY")
    got = sorted(decode_messages(rows).collect(), key=lambda r: r.uid)
    assert (got[0].subject, got[0].sender, got[0].received_at, [p.content for p in got[0].parts]) == ("", "", None, [""])
    assert got[1].parts[0].content == "wörd = " * 300_000
    assert [len(r.parts) for r in got[2:]] == [500, 500] and {p.content for p in got[2].parts} == {"part"}
    assert decode_messages(rows.limit(0)).count() == 0


def test_only_other_charsets_reach_python_and_headers_come_first(spark):
    rows = spark.createDataFrame([("m", 1, bytearray(b"Subject: a\n\nb"))], "mailbox STRING, uid BIGINT, raw BINARY")
    plan = decode_messages(rows).filter("received_at IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    # The head's date is tested below both Arrow steps.
    assert plan.rindex("ArrowEvalPython") < plan.rindex("Filter")


def test_a_date_is_searched_twice_and_a_single_part_is_its_own_leaf(spark):
    dates = ["Thu, 02 Aug 2001 10:00:00 +0200", "2 Aug 2001 10:00", "Fri, 3-Aug-01 9:05 EST, extra", "31 Feb 2001 10:00:00 Z", "1 Jan 70 0:0:0", "", None]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i int, d string")
    at = rows.select("i", F.unix_timestamp(mime.message_date(F.col("d"))).alias("at"))
    assert [r.at for r in at.orderBy("i").collect()] == [996739200, 996746400, 996847500, None, None, None, None]
    assert at._jdf.queryExecution().optimizedPlan().toString().count("[A-Za-z]{3,9}") <= 2
    texts = ["Subject: a?=b\n\nbody", "Content-Type: MultiPart/mixed; boundary=q\n\n--q\n\nx\n--q--\n", "", None]
    leaves = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mime.leaf_texts(F.col("t")).alias("l"))
    assert [r.l for r in leaves.orderBy("i").collect()][:3] == [[texts[0]], ["\nx\n"], [""]]
