"""What co-training adds, and held-out labels."""

import random

from rulecast.llm import quality_classifier


def test_views_teach_each_other(spark):
    """Labelled documents share no word with the others; their sources tell good from bad. So only
    what the metadata model teaches about new words can judge new sources."""
    random.seed(6)

    def text(kind):
        return " ".join(f"{kind}{random.randrange(30)}" for _ in range(25))

    docs, labels = [], []
    for i in range(900):
        bad = i % 2
        if i < 300:
            row = (f"old{bad}", text(f"o{'ab'[bad]}"))
            labels.append((i, 0 if bad else 2, 0))
        elif i < 700:
            row = (f"old{bad}", text(f"n{'ab'[bad]}"))
        else:
            row = ("other", text(f"n{'ab'[bad]}"))
        docs.append((i, row[1], row[0], "en", len(row[1])))
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def right(rounds):
        got = {r["doc_id"]: r["kept"] for r in quality_classifier.score_documents(docs, labels, rounds).collect()}
        return sum(got[i] == (i % 2 == 0) for i in range(700, 900)) / 200

    assert right(0) < 0.7 and right(quality_classifier.ROUNDS) > 0.95


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = "crc32(cast(doc_id AS string)) % 5 > 0"
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.score_documents(docs, labels.where(known)).collect()}
    held = [(r["doc_id"], r["quality"] != 0 and r["toxic"] != 1) for r in labels.where(f"NOT {known}").collect()]
    good = [got[i] for i, kept in held if kept]
    assert len(held) > 700 and sum(got[i] == kept for i, kept in held) / len(held) > 0.96
    assert sum(good) / len(good) > 0.985
