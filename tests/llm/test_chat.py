"""Chat formatting against plain Python, SQL and its own reverse."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from crossbook.llm import chat, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, template=chat.ChatTemplate()):
    """The digests from the turns themselves; the string built turn by turn."""
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for conv, group in itertools.groupby(sorted(rows, key=key), key):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for _, t, r, x in group))
        told = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r in template.trained)
        size = 0
        for role, block in itertools.groupby(turns, lambda t: t[2]):
            texts = [x for *_, x in block]
            for a, b in template.codes(role=True):
                role = role.replace(a, b)
            for a, b in template.codes():
                texts = [x.replace(a, b) for x in texts]
            size += len(template.header + role + template.after_role + template.joint.join(texts) + template.close)
        out[conv[1] if conv[0] else None] = (
            len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest(), size)
    return out


ODD = [
    (1, 2, "assistant", "two"), (1, 1, "user", "é one ### <turn/>"), (1, 3, "assistant", None),
    (1, 4, "assistant", "\\e\\h </turn></tur"), (1, 5, "user", "\\"), (1, 5, "user", "\\"),
    (2, None, None, None), (2, 1, "assistant: x", "#### ok"), (2, 1, "### a\\r", "</turn</turn>n>"),
    (3, 1, "assistant", ""), (None, 1, "user", "no id"), (None, 1, "assistant", "𝒳 astral 𝒴" * 5000),
    (None, 2, "assistant", "next"), (4, 1, "", "x" * 20000), (4, 2, "", ":"), (4, 3, "assistant", "y" * 8192),
    (4, 4, "tool\nname", "line\nline"), (4, 5, "assistant", "z"),
]


@pytest.fixture(scope="module")
def odd_turns(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("turns", "blocks", "formatted", "pieces", "id", "n_turns"):
        df = df.withColumn(name, F.lit(name))
    return df


def test_digests_match_brute_force(odd_turns):
    got = {r[0]: tuple(r)[1:] for r in chat.digest_conversations(odd_turns).collect()}
    assert got == brute(ODD)
    assert chat.digest_conversations(odd_turns.where("false")).count() == 0


def test_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", chat.TRICKY), (-7, 1, "assistant", chat.TRICKY)]
    got = {r[0]: tuple(r)[1:] for r in queries.op11_chat_format(spark, sf).collect()}
    assert got == brute(rows) and got[-7][2] == len(chat.TRICKY)


def test_blocks_and_mask(odd_turns):
    out = {r.conv_id: r for r in chat.format_conversations(odd_turns).collect()}
    assert out[1].n_blocks == 3 and out[1].formatted.count("</turn>") == 3
    assert out[1].formatted.startswith("### user:é one \\h\\j</turn>### assistant:two<turn/><turn/>\\ee")
    masked = [out[1].formatted[s.start:s.start + s.length] for s in out[1].loss_spans]
    assert masked == ["two", "", "\\ee\\eh \\c</tur"]
    assert [s.length for s in out[4].loss_spans] == [8192, 1] and out[None].n_blocks == 3


def test_long_conversations_stay_linear_and_whole(spark):
    n = 3000
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], f"turn {i} ### " + "w" * (i % 50)) for i in range(n)]
    got = chat.digest_conversations(spark.createDataFrame(rows, SCHEMA).repartition(7)).first()
    assert tuple(got)[1:] == brute(rows)[1]


def test_another_template_and_no_python(spark, odd_turns):
    template = chat.ChatTemplate("<|start|>", "|", "<|and|>", "<|stop|>", ("user", "assistant"))
    got = {r[0]: tuple(r)[1:] for r in chat.digest_conversations(odd_turns, template).collect()}
    assert got == brute(ODD, template)
    plan = chat.digest_conversations(odd_turns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
