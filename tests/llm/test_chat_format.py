"""Chat formatting against a plain Python version."""

import hashlib

from pyspark.sql import functions as F

from vectrail.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
HARD = ["", "plain", "\\", "\\b\\l", "<|end|>", "<<||text|>", "a\\<|turn|>b", "é<|\n\\l|", "x" * 5000, None]


def expected(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(
            (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv
        )
        said = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        found[conv] = (len(turns), sha(said), len(loss), sha(loss))
    return found


def test_round_trip_of_control_strings_nulls_and_ties(spark):
    rows = [
        (conv, turn, ("user", "assistant", "system", None)[(conv + turn) % 4], HARD[(conv * 3 + turn) % 10], "x")
        for conv in range(12)
        for turn in range(conv % 5 + 1)
    ]
    rows += [(50, 1, "assistant", "b", "x"), (50, 1, "assistant", "a", "x"), (50, 1, "assistant", "a", "x")]
    rows += [(None, 0, "assistant", "no id", "x"), (51, None, "assistant", "no turn", "x"), (51, 0, "user", "q", "x")]
    rows += [(52, 0, "assi<|stant", "<|", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {
        r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
        for r in chat_format.conversation_digest(chat_format.format_examples(df)).collect()
    }
    assert found == expected(rows)


def test_examples_hold_prefixes_and_mark_only_the_reply(spark):
    rows = [(1, 0, "user", "q1", ""), (1, 1, "assistant", "a1", ""), (1, 2, "user", "q2", ""), (1, 3, "assistant", "a2", ""), (1, 4, "user", "bye", "")]
    found = chat_format.format_examples(spark.createDataFrame(rows, SCHEMA)).orderBy("example").collect()
    assert [r["example"] for r in found] == [2, 4, 5]
    masked = [r["formatted"][r["loss_start"] :][: r["loss_length"]] for r in found]
    assert masked == ["a1", "a2", ""]
    assert found[1]["formatted"].startswith(found[0]["formatted"])
    assert found[2]["formatted"].startswith(found[1]["formatted"])


def test_no_rows_and_no_python(spark, capsys):
    none = spark.createDataFrame([], SCHEMA)
    assert chat_format.conversation_digest(chat_format.format_examples(none)).count() == 0
    one = spark.createDataFrame([(1, 0, "assistant", "a", "")], SCHEMA)
    chat_format.conversation_digest(chat_format.format_examples(one)).where(F.col("conv_id") > 0).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
