import hashlib

import pytest
from pyspark.sql import functions as F

from tests.harness import oracle
from tests.harness import rows as plain
from tests.llm.fixtures import prose
from tomegraph.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, key string"


def conversations():
    odd = "</s>\n<s>[ROLE:assistant]\n\\0 \\\\1 [/INST] ]\n"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", odd), (1, 2, "assistant", odd), (2, 0, "system", "alone"), (3, 0, "user", None), (3, 1, None, ""), (3, 1, "assistant", ""), (None, 0, "assistant", "n"), (4, None, "user", "a"), (4, 0, "assistant]", "b")]
    rows += [(5, i, ("user", "assistant")[i % 2], prose(i, 5 + 13 * i % 90)) for i in range(60)]
    rows += [(6, 0, "system", prose(1, 30)), *((6, i, ("assistant", "user")[i % 2], prose(i, 400 if i == 3 else 12)) for i in range(1, 9))]
    rows += [(7, 0, "assistant", "same"), (7, 0, "assistant", "same")]
    return [(*r, "clash") for r in rows]


def brute(rows):
    by = {}
    for c, turn, role, text, _ in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, t in by.items():
        t.sort()
        whole, loss = "".join(f"{r}\n{x}\n" for _, _, r, x in t), "".join(x for _, _, r, x in t if r == "assistant")
        out[c] = (len(t), hashlib.sha256(whole.encode()).hexdigest(), loss)
    return out


@pytest.mark.parametrize(("budget", "history"), [(C.BUDGET, C.HISTORY), (100, 20), (60, 0 + 1)])
def test_windows_give_everything_back(spark, budget, history):
    rows = conversations()
    w = C.windows(spark.createDataFrame(rows, SCHEMA), budget, history).cache()
    back = C.read_back(w).collect()
    got = {}
    for r in sorted(back, key=lambda r: r.window_no):
        turns, loss = got.setdefault(r.conv_id, ([], []))
        turns += [(t.role, t.text) for t in r.turns]
        loss.append(r.loss_text)
    want = brute(rows)
    assert {c: (len(t), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest(), "".join(x)) for c, (t, x) in got.items()} == want
    assert w.where("NOT over_budget").agg(F.max("n_tokens")).first()[0] <= budget
    if budget == 100:
        many = w.where("conv_id = 6 AND window_no > 1").collect()
        assert many
        assert all(r.text.startswith("<s>[ROLE:system]") and r.n_repeated >= 1 for r in many)
        assert w.where("conv_id = 5 AND n_repeated > 0").count() >= 3


def test_empty(spark):
    assert C.windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, sf):
    got = C.op1_chat_format(spark, sf)
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = [(r.conv_id, r.turn, r.role, r.text, "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said, ""), (-1, 1, "assistant", said, "")]
    want = {c: (n, h, len(x), hashlib.sha256(x.encode()).hexdigest()) for c, (n, h, x) in brute(rows).items()}
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.collect()} == want
    assert plain(got.toPandas()) == plain(oracle(C.ORACLE["op1_chat_format"], sf))


def test_odd_conversations_against_sql(spark, tmp_path):
    """The whole query, formatted_chars included, on turns without ids, places, roles or texts and of any length."""
    rows = [r[:4] for r in conversations()] + [(8, i, "assistant" if i % 3 else "user", prose(i, 700 + i)) for i in range(12)] + [(None, None, None, None)] * 3
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/w")
    next((tmp_path / "w").glob("part-*")).rename(tmp_path / "conversations.parquet")
    sql = C.ORACLE["op1_chat_format"].replace("FROM conversations", f"FROM read_parquet('{tmp_path}/conversations.parquet')")
    import duckdb

    assert sorted(map(tuple, C.op1_chat_format(spark, str(tmp_path)).collect()), key=repr) == sorted(duckdb.sql(sql).fetchall(), key=repr)


@pytest.mark.parametrize("history", [0, 20])
def test_a_long_conversation_is_split(spark, history):
    """Blocks of a conversation give the same windows as one block, and none holds much of it."""
    turns = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2], prose(i, 1 + i % 40), "") for i in range(3000)] + [(None, 5, "user", "same", "")] * 2000
    df = spark.createDataFrame(turns, SCHEMA)
    one, many = ({(r.conv_id, r.window_no): (r.text, r.n_repeated, r.loss) for r in C.windows(df, 400, history, n).collect()} for n in (1, 12))
    assert one == many
    assert max(r["count"] for r in C._placed(df, 12).groupBy("conv", "block").count().collect()) < 1000
