import random
import zlib

from pyspark.sql import functions as F

from noticeloom.llm.toxicity import NAMES, WordCodes, features, is_held_out, revealed, score_documents, terms


def auc(pairs):
    pairs = sorted(pairs)
    ranks, i = {}, 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        for k in range(i, j):
            ranks[k] = (i + j + 1) / 2
        i = j
    pos = [k for k, p in enumerate(pairs) if p[1]]
    n = len(pairs) - len(pos)
    return (sum(ranks[k] for k in pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * n)


def test_features():
    codes = WordCodes({"idiot": 3, "idio*": 1})
    got = dict(zip(NAMES, features("YOU are an 1d10t!! ok", codes), strict=True))
    assert revealed("1d10t") == "idiot"
    assert got["very_strong"] == 0.2 and got["prefix_mild"] == 0.2 and got["near_second_person"] > 0 and got["second_person"] == 0.2
    assert got["shouted"] == 0.2 and got["obfuscated"] == 0.2 and got["exclaims"] == 2 / 21
    assert features("", codes) == features(None, codes) == features(" \n", codes) == [0.0] * len(NAMES)
    odd = dict(zip(NAMES, features("ÄÖÜ\u00a0ПРИВЕТ\u3000idiot du", codes), strict=True))
    assert odd["very_strong"] == 0.25 and odd["shouted"] == 0.5 and odd["capitals"] == 9 / 16 and odd["second_person"] == 0.25
    assert terms("ÄÖÜ\u00a0idiot\u3000du") == {"äöü", "idiot", "idio*", "du"}
    assert len(features("ü" * 10_000 + " x" * 10_000, codes)) == len(NAMES)


def test_held_out_accuracy(spark):
    rnd = random.Random(2)
    mild = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        words = [rnd.choice(mild) for _ in range(rnd.choice([5, 40, 300]))]
        for _ in range(rnd.randint(1, 4) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["scum", "moron", f"lowei{rnd.choice(mild)}"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "scum"), (3, rows[3][1])]
    labels += [(7000, 1), (None, 1), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS features", "3 AS raw")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = score_documents(docs, known).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.score, r.doc_id % 5 == 0) for r in got if r.held_out and r.doc_id < 1500]
    assert auc(held) > 0.97
    flipped = known.withColumn("toxic", F.when(is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {(r.doc_id, r.score) for r in score_documents(docs.repartition(3), flipped).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    assert score_documents(docs.limit(0), known).count() == 0
    none = score_documents(docs.limit(5), known.limit(0)).collect()
    assert len(none) == 5 and {r.score for r in none} == {0.0}
