import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest

from pulsequilt.llm import audit

SF = "/root/testdata/sf0.001"
NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def slow(docs, labels):
    """The audit by replaying every order, document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    ids = defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            ids[t or ""].append(i)
    out = defaultdict(Counter)
    for i, text, lang in docs:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j < i for j in ids[t])}
        for p in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(p, 1):
                c = out[lang or "", "".join(p), step]
                c.update({"redundant": gone and fails[f], "unique_fails": fails[f] and sum(fails.values()) == 1})
                if fails[f] and not gone:
                    c.update({"removed": 1, "good_lost": i in good, "toxic_lost": i in toxic})
                gone |= fails[f]
                c["kept"] += not gone
    share = Counter()
    for (part, order, step), c in out.items():
        share[part, order[step - 1]] += c["removed"]
    return {(p, o, s): (*(c[n] for n in NUMBERS), share[p, o[s - 1]]) for (p, o, s), c in out.items()}


def rows(df):
    return {(r.part, r.filter_order, r.step): (*(r[n] for n in NUMBERS), r.shapley) for r in df.collect()}


def test_whole_table_against_a_loop_and_sql(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    df = audit.audit(docs, labels)
    got = rows(df)
    assert dict(df.dtypes)["step"] == "int" and all(dict(df.dtypes)[n] == "bigint" for n in (*NUMBERS, "shapley"))
    assert got == slow([(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names = ("part", "filter_order", "step", *NUMBERS, "shapley")
    assert {r[:3]: r[3:] for r in c.execute(f"SELECT {', '.join(names)} FROM ({audit.SQL})").fetchall()} == got


def test_awkward_rows(spark, awkward, no_documents):
    labels = spark.createDataFrame([(4, 1, 0), (4, None, 1), (None, 1, 1), (5, 0, None), (1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").withColumn("part", audit.F.lit("p"))
    docs = awkward.unionByName(awkward.withColumn("lang", audit.F.lit(None).cast("string"))).unionByName(awkward.where("doc_id = 7").withColumn("lang", audit.F.lit("")))
    got = rows(audit.audit(docs, labels))
    assert got == slow([(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r)[:3] for r in labels.collect()])
    assert {k[0] for k in got} == {"", "en"} and len(got) == 1200
    assert audit.audit(no_documents, labels).count() == 0
    assert rows(audit.audit(awkward, labels.where("false")))["en", "ABCDE", 1][4] == 0


@pytest.mark.parametrize("copies", [400])
def test_hot_text_null_ids_and_borders(spark, copies):
    """A third of all rows share a text, others have no id; texts stand at each filter's border."""
    borders = ["w " * 99, " ".join(f"w{k}" for k in range(100)), " ".join(f"w{k % 80}" for k in range(100)), " ".join(f"w{k % 79}" for k in range(100)), "A" + "b" * 9, "A" * 2 + "b" * 9, "a\x0bb\x0cc\x85d e", "É" * 30, "a|b", "50%"]
    docs = [(k, "hot text", "de") for k in range(copies)] + [(None, f"x {k % 7}", "fr") for k in range(copies)] + [(5000 + k, t, "en") for k, t in enumerate(borders)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(0, copies, 3)], "doc_id long, quality int, toxic int")
    assert rows(audit.audit(df, labels)) == slow(docs, [tuple(r) for r in labels.collect()])
