import random
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from kalibra.llm import filter_audit, queries

SCHEMA = "doc_id long, text string, lang string, removed string, good string"


def brute(rows, labels):
    """Every order applied literally, one document list at a time."""
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)

    def fails(row):
        i, text = row[0], row[1] or ""
        w = [x for x in text.replace("\t", " ").replace("\n", " ").split(" ") if x]
        out = set()
        out |= {"A"} if len(w) < 100 else set()
        out |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
        out |= {"D"} if set(text) & set("#$%&*|") else set()
        out |= {"E"} if i is not None and i > first[text] else set()
        return out

    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    facts = [(r[2] or "", fails(r), r[0] in good and r[0] is not None, r[0] in toxic and r[0] is not None) for r in rows]
    out = {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                failing = [x for x in own if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for key, v in out.items():
            if key[0] == part:
                v.append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        n = rng.choice([5, 99, 100, 130])
        text = " ".join(rng.choice(["Ab", "cd#", "EF", "gh"]) + str(rng.randrange(60 if i % 3 else 1000)) for _ in range(n))
        rows.append((i, text, rng.choice(["en", "de", None, ""]), "x", "y"))
    rows += [(70 + k, rows[3][1], rng.choice(["en", "fr"]), "x", "y") for k in range(12)]  # copies, one part has nothing else
    rows += [(3, rows[3][1], "en", "x", "y"), (None, rows[3][1], "de", None, None), (None, None, None, None, None), (90, None, "en", "x", "y"), (91, "", "en", "x", "y"), (92, "w " * 200_000, "en", "x", "y")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 90, 2)] + [(4, 0, 1), (4, 1, None), (None, 1, 1)]
    return rows, labels


def test_query_equals_every_order_applied(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in queries.op11_filter_audit(spark, str(tmp_path)).collect()}
    assert len(got) == 4 * 600
    assert got == brute(rows, labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    by_sql = con.execute(f"SELECT part, filter_order, step, {', '.join(names)} FROM ({queries.SQL['op11_filter_audit']})").fetchall()
    assert {r[:3]: r[3:] for r in by_sql} == got


def test_each_unordered_state_is_counted_once(spark):
    rows = spark.range(40).select((F.col("id") % 2).cast("string").alias("part"), (F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"))
    filters = {"x": F.col("a") == 0, "y": F.col("b") == 0, "z": F.lit(None).cast("boolean")}
    found = filter_audit.edges(rows, filters, "part", {"m": F.col("a") == 1}).collect()
    states = {(tuple(r.state), r.filter) for r in found}
    assert len(found) == 2 * len(states) and len(states) == 3 * 2**2
    assert all(r.removed == 0 for r in found if r.filter == "z")


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.facts(docs, labels)
    assert filter_audit.audit(rows, {"A": F.col("n_words") < 1, "B": F.col("is_copy")}, "part", {}).count() == 0
