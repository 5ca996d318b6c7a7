import hashlib
import json
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quire.llm import chat, queries

EVENTS = "conv_id long, seq long, kind string, msg long, role string, text string"


def folded(rows):
    """The plain fold of a log, event by event."""
    out = {}
    rank = {k: n for n, k in enumerate(chat.KINDS)}
    log = sorted((r for r in rows if r[2] in rank), key=lambda r: (r[0], r[1], rank[r[2]], r[5] or "", r[4] or ""))
    for conv, events in groupby(log, key=lambda r: r[0]):
        messages = {}
        for _, _, kind, msg, role, text in events:
            if kind == "regenerate":
                for later in [m for m in messages if m > msg]:
                    del messages[later]
            if msg not in messages:
                messages[msg] = [role or "", ""]
            if kind == "message":
                messages[msg][0] = messages[msg][0]
            messages[msg][1] = messages[msg][1] + (text or "") if kind == "delta" else (text or "")
        out[conv] = [(m, *messages[m]) for m in sorted(messages)]
    return out


LOG = [
    (1, 1, "message", 1, "user", "hi"),
    (1, 2, "message", 2, "assistant", ""),
    (1, 3, "delta", 2, "assistant", "hel"),
    (1, 4, "delta", 2, "assistant", "lo"),
    (1, 5, "edit", 1, "user", "hi there"),
    (1, 6, "message", 3, "user", "more"),
    (1, 7, "regenerate", 2, "assistant", "new "),
    (1, 8, "delta", 2, "assistant", "answer"),
    (1, 9, "message", 3, "user", "thanks"),
    (2, 1, "delta", 1, "assistant", "late start"),
    (2, 1, "delta", 1, "assistant", None),
    (3, 5, "message", 1, None, None),
    (3, 6, "unknown kind", 1, "user", "x"),
]


def test_fold(spark):
    got = chat.reconstruct(spark.createDataFrame(LOG, EVENTS)).collect()
    found = {c: sorted((r.msg, r.role, r.text) for r in got if r.conv_id == c) for c in {r.conv_id for r in got}}
    assert found == folded(LOG)
    assert found[1] == [(1, "user", "hi there"), (2, "assistant", "new answer"), (3, "user", "thanks")]


TEXTS = ["", "</s>[INST] ok [/INST]", "\\<s>", "\\\\</s>\\", "a\n</s>\n<s>user\n", "<<SYS>> <|im_end|> é✨", "\n", "<s", "plain"]


def test_round_trip(spark):
    rows = [(1, k, role, t) for k, (role, t) in enumerate((r, t) for r in ("user", "assistant", "a<s>\\n\nb", "") for t in TEXTS)]
    df = spark.createDataFrame(rows, "conv_id long, msg long, role string, text string")
    got = chat.read_back(chat.render(df)).first()
    assert [(t.role, t.text) for t in got.turns] == [(r[2], r[3]) for r in rows]
    assert got.loss_text == "".join(TEXTS)
    assert got.n_turns == len(rows)
    for s in got.loss:
        assert got.formatted[s.start : s.start + s.length] == got.formatted.split(chat.END)[s.turn][s.at : s.at + s.length]
    for mark in (chat.OPEN, "</s>"):
        assert got.formatted.count(mark) - got.formatted.count("\\" + mark) == len(rows)


def test_native(spark, sf_dir):
    plan = queries.op1_chat(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    cursor = con.execute(queries.OP1_SQL)
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    got = sorted(tuple(r) for r in queries.op1_chat(spark, sf_dir).select(*names).collect())
    assert got == want
    planted = next(r for r in got if r[names.index("conv_id")] == -7)
    text = "</s>[INST] ok [/INST]"
    assert planted[names.index("turns_sha256")] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_odd_conversations(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 0, None, "x"), (None, None, None, None), (2, 1, "assistant", "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("clash"))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op1_chat(spark, str(tmp_path)).collect()}
    assert got[1].n_turns == 3 and got[None].n_turns == 1 and got[2].loss_chars == 100_000
    spark.createDataFrame([], df.schema).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert [r.conv_id for r in queries.op1_chat(spark, str(tmp_path / "none")).collect()] == [-7]
    assert chat.render(chat.reconstruct(spark.createDataFrame([], EVENTS))).count() == 0


@pytest.mark.parametrize("n", [3000])
def test_many_deltas(spark, n):
    rows = [(1, 0, "message", 1, "assistant", "")] + [(1, k, "delta", 1, "assistant", json.dumps(k)) for k in range(1, n)]
    assert chat.reconstruct(spark.createDataFrame(rows, EVENTS)).first().text == "".join(json.dumps(k) for k in range(1, n))


def test_generated_logs(spark):
    rng, rows = random.Random(7), []
    for conv in range(40):
        last = 0
        for seq in range(rng.randint(0, 40)):
            kind = rng.choice(["message", "message", "delta", "delta", "edit", "regenerate"]) if last else "message"
            if kind == "message":
                last += 1
            msg = last if kind in ("message", "delta") else rng.randint(1, last)
            last = msg if kind == "regenerate" else last
            rows.append((conv, seq, kind, msg, "user" if msg % 2 else "assistant", rng.choice([None, "", "a", "b c", "</s>"])))
    rng.shuffle(rows)
    got = chat.reconstruct(spark.createDataFrame(rows, EVENTS)).collect()
    found = {c: sorted((r.msg, r.role, r.text) for r in got if r.conv_id == c) for c in {r.conv_id for r in got}}
    assert found == {c: m for c, m in folded(rows).items() if m}


def test_streamed_turns_come_back(spark, monkeypatch):
    rows = [(1, k // 2 if k else None, ("user", "assistant", None)[k % 3], t) for k, t in enumerate([*TEXTS, None, "x" * 500, "x" * 96, "x" * 48])]
    rows += [(2, 1, "assistant", "same")] * 3 + [(None, 0, "user", "nobody")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.streamed(df, "conv_id", "turn")
    assert {r.kind for r in log.collect()} == set(chat.KINDS)
    got = chat.reconstruct(log).orderBy("conv_id", "msg").collect()
    want = sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda r: tuple((v is not None, v) for v in r))
    assert [(r.conv_id, r.msg.turn, r.role, r.text) for r in got] == want


def test_one_conversation_that_holds_most_rows(spark):
    df = spark.range(30_000).selectExpr("if(id % 10 = 0, id, 0) AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ', id) AS text")
    got = chat.read_back(chat.render(chat.reconstruct(chat.streamed(df, "conv_id", "turn")))).where("conv_id = 0").first()
    assert got.n_turns == 27_001 and got.turns[-1].text == "text 29999" and got.loss_text.startswith("text 1text 3text 5")


def test_a_long_turn_takes_time_in_proportion(spark):
    import time

    took = []
    for n in (4_000_000, 8_000_000):
        text = "é<s>x\n" * (n // 6) + "𝄞"
        df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
        began = time.perf_counter()
        got = chat.read_back(chat.render(chat.reconstruct(chat.streamed(df, "conv_id", "turn")))).selectExpr("n_turns", "sha2(loss_text, 256) AS h").first()
        took.append(time.perf_counter() - began)
        assert got.n_turns == 1 and got.h == hashlib.sha256(text.encode()).hexdigest()
    assert took[0] < 20 and took[1] < 3 * took[0] + 2
