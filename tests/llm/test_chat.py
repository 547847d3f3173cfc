import duckdb

from marginscope.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def slow(rows):
    out = {}
    clean = sorted({(c, -1 if t is None else t // chat.TURNS_PER_CHUNK, t if t is not None else 0, r or "unknown", x or "") for c, t, r, x in rows if c is not None})
    for c in {r[0] for r in clean}:
        mine = [r for r in clean if r[0] == c]
        for me in {r[3] for r in mine} - {"system"}:
            for chunk in {r[1] for r in mine}:
                text, mask = "", []
                turns = [r for r in mine if r[1] == chunk]
                for _, _, _, role, x in turns:
                    who = "system" if role == "system" else "assistant" if role == me else f"user name={role}"
                    text += f"<|turn|>{who}\n"
                    if role == me:
                        mask.append([len(text), len(text) + len(x)])
                    text += x + "<|end|>\n"
                out[c, me, chunk] = (text, mask, len(turns), len(mask))
    return out


def result(df):
    return {(r["conv_id"], r["speaker"], r["chunk"]): (r["text"], [list(m) for m in r["mask"]], r["n_turns"], r["n_trained"]) for r in df.collect()}


def test_query_equals_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    path = f"{sf}/conversations.parquet"
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    assert result(chat.perspectives(spark.read.parquet(path))) == slow(rows)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}'")
    want = con.execute(queries.ORACLE["op1_chat_perspectives"]).fetchall()
    got = [tuple(r) for r in queries.op1_chat_perspectives(spark, sf).select("conv_id", "speaker", "chunk", "n_turns", "n_trained", "text", "mask").collect()]
    assert sorted(got) == sorted(want)


def test_odd_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi é漢😀"), (1, 2, "bob", None), (1, 2, "ann", "tie"), (1, 3, None, "who"), (1, 3, None, "who"),
        (2, 0, "system", "alone"), (3, None, "ann", "lost"), (3, None, "ann", "also"), (3, 300, "bob", "late"), (None, 1, "ann", "x"), (4, 1, "a", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("speaker", F.lit("mine")).withColumn("chunk", F.lit(9)).withColumn("parts", F.lit(1))
    got = result(chat.perspectives(df))
    assert got == slow(rows)
    for text, mask, *_ in got.values():
        assert all(text[: a].endswith("<|turn|>assistant\n") and text[b:].startswith("<|end|>\n") for a, b in mask)
    assert (2, "system", 0) not in got and (3, "ann", 1) in got
    assert chat.perspectives(df.where("false")).count() == 0


def test_no_python_in_the_plan(spark):
    df = queries.op1_chat_perspectives(spark, "/root/testdata/sf0.001")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_long_conversations_come_in_chunks(spark):
    rows = [(1, k, "ann" if k % 2 else "bob", f"turn {k}") for k in range(1000)]
    got = result(chat.perspectives(spark.createDataFrame(rows, SCHEMA)))
    assert got == slow(rows) and max(v[2] for v in got.values()) == chat.TURNS_PER_CHUNK
