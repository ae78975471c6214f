import random
import zlib

from pyspark.sql import functions as F

from pulseline.llm import toxicity as t

draw = random.Random(11)
INSULTS = ["gnarfel", "blotzen", "scrumple", "vekkit", "droobin"]


def corpus(n):
    rows, labels = [], []
    for i in range(n):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(15, 60))]
        toxic = i % 7 == 0
        for _ in range(draw.randrange(2, 5) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(INSULTS).upper() + draw.choice(["", ",", "!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents(spark, make_docs, odd_rows):
    rows, labels = corpus(900)
    rows += [(10_000 + (i or 0), x) for i, x in odd_rows]
    docs = make_docs(rows)
    told = spark.createDataFrame([*labels, (None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    model = t.fit(docs, told)
    scored = {r.doc_id: r.toxicity for r in t.score(docs, model).collect()}
    assert len(scored) == len({i for i, _ in rows}) and all(0 <= s <= 1 for s in scored.values())
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((scored[i] >= t.THRESHOLD) != bool(y) for i, y in held) <= 0.02 * len(held)
    assert all(s < t.THRESHOLD for i, s in scored.items() if i >= 10_000)
    assert any(word in "".join(model.lexicon) for word in INSULTS) and max(model.accuracies) > 0.9


def test_labels_of_held_out_rows_teach_nothing(spark, make_docs):
    rows, labels = corpus(300)
    docs = make_docs(rows)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (t.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a == b


def test_without_toxic_labels_or_rows(spark, make_docs, odd_rows):
    none = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for rows in (odd_rows, []):
        model = t.fit(make_docs(rows), none)
        assert model.lexicon == {}
        assert all(r.toxicity < 1e-9 for r in t.score(make_docs(rows), model).collect())


def test_null_blank_and_copied_texts_do_not_crowd_out_the_rest(spark, make_docs):
    rows, labels = corpus(900)
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = make_docs(rows)
    alone = t.fit(docs, told)
    crowd = make_docs([(None, " \n")]).crossJoin(spark.range(30_000)).drop("id")
    crowd = crowd.withColumn("text", F.when(F.rand(3) < 0.5, F.col("text")))
    assert t.fit(docs.unionByName(crowd), told) == alone
    copies = make_docs([(None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]).crossJoin(spark.range(30_000)).drop("id")
    for extra in (crowd, copies):
        model = t.fit(docs.unionByName(extra), told)
        scored = {r.doc_id: r.toxicity for r in t.score(docs, model).collect()}
        assert sum((scored[i] >= t.THRESHOLD) != bool(y) for i, y in labels) <= 0.02 * len(labels)


def test_hundreds_of_rare_insults_are_learnt(spark, make_docs):
    """200 insults, each in about 1.5% of the toxic texts, without shared beginnings."""
    own = random.Random(4)
    insults = ["".join(own.choice("bdfgklmnprstvz") for _ in range(9)) for _ in range(200)]
    rows, labels = [], []
    for i in range(9000):
        words = [f"w{own.randrange(400)}" for _ in range(own.randrange(15, 60))]
        if i % 6 == 0:
            words[5:5] = own.sample(insults, 3)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    docs = make_docs(rows)
    model = t.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sum(f"0{word}" in model.lexicon or any(f"{n}{word[:n]}" in model.lexicon for n in t.BEGINNINGS) for word in insults) >= 198
    scored = {r.doc_id: r.toxicity for r in t.score(docs, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((scored[i] >= t.THRESHOLD) != bool(y) for i, y in held) <= 0.02 * len(held)
