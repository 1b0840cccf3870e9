"""The message folder as a data source: batch, stream, restart."""

from leadsift.sources.message_files import parse_message_text, read_message_files
from leadsift.sources.message_source import message_folder
from leadsift.streaming.runs import emitted, run_available


def put(folder, *names):
    for n in names:
        (folder / n).write_bytes(f"From: {n}@mail.example\nSubject: subject of {n}\n\nbody é {n}\n".encode() + b"\xff" * (n == "bad.txt"))


def rows(df):
    return sorted((r.source_id, r.subject, r.sender, r.body) for r in df.collect())


def test_batch_rows_equal_those_of_the_text_reader(spark, tmp_path):
    folder = tmp_path / "mail"
    assert message_folder(spark, str(folder)).count() == 0
    folder.mkdir()
    put(folder, "a.txt", "b.txt", "c.eml", ".hidden.txt")
    (folder / "empty.txt").write_bytes(b"")
    one_each = message_folder(spark, str(folder), splitBytes=1)
    assert one_each.rdd.getNumPartitions() >= 2
    # The text reader has no row for an empty file; here it is a message without a body.
    both = rows(parse_message_text(one_each)), rows(read_message_files(spark, str(folder)))
    assert both[0] == sorted([*both[1], ("empty", "empty", "Unknown", "")])
    put(folder, "bad.txt")
    got = rows(parse_message_text(message_folder(spark, f"file://{folder}")))
    assert [r[0] for r in got] == ["a", "b", "bad", "empty"] and got[2][3].endswith("�")


def test_a_stream_takes_each_file_once_across_restarts(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "mail", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    for names in (("a.txt", "b.txt"), ("c.txt",), ()):
        put(folder, *names)
        stream = parse_message_text(message_folder(spark, str(folder), stream=True, settleSeconds=0))
        run_available(stream, out, checkpoint, "append")
    assert rows(emitted(stream, out)) == rows(read_message_files(spark, str(folder)))
