import duckdb

from pulsequilt.llm import chat


def brute(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))] for c, v in by.items()}
    key = lambda c: (c is not None, c or 0)
    keep = {}
    for c, v in turns.items():
        if not any((len(w) > len(v) and w[: len(v)] == v) or (w == v and key(d) < key(c)) for d, w in turns.items()):
            keep[c] = (len(v), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v))
    return keep


SCHEMA = "conv_id long, turn long, role string, text string, x string, position int"


def test_snapshots_collapse(spark):
    rows = []
    say = lambda c, *ts: rows.extend((c, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(ts))
    say(1, "a")
    say(2, "a", "b")
    say(3, "a", "b", "c")
    say(4, "a", "c")
    say(5, "a", "b", "c")
    say(6, "x")
    say(7, None, "y")
    say(8, "", "y", "z")
    say(None, "null id")
    rows += [(9, 5, "user", "gap"), (9, 900, "user", "far"), (9, 900, "user", "far"), (10, None, None, None), (11, -3, "user", "neg"), (11, 0, "user", "gap")]
    say(12, *(f"turn {k}" for k in range(700)))
    say(13, *(f"turn {k}" for k in range(600)))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.render(df.repartition(5)).collect()}
    assert got == brute(rows)
    assert 13 not in got and 12 in got and 1 not in got and 5 not in got


def test_empty_table(spark):
    assert chat.render(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_gives_the_same(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    want = sorted(c.execute(chat.SQL).fetchall())
    assert sorted((r.conv_id, r.n_turns, r.text) for r in chat.render(spark.read.parquet(path)).collect()) == want
