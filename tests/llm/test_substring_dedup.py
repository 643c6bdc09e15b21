"""Paragraphs, long lines and runs of lines, against a plain reading."""

import random

import pytest

import check
from __spark_entry__ import queries
from rulecast.llm import substring_dedup

SF = "/root/testdata/sf0.001"


def removed_by_hand(texts, paragraph_words=8, run_words=30, run_lines=8):
    """id -> (lines, begin-end of removed ones) for texts in order of their ids."""
    met, out = {}, {}
    for i, text in texts:
        lines, at, paragraph = [], 0, 0
        for line in (text or "").split("\n"):
            if line.strip():
                lines.append((at, at + len(line), line.lower().split(), paragraph))
            else:
                paragraph += 1
            at += len(line) + 1
        units = set()
        for p in {x[3] for x in lines}:
            own = [n for n, x in enumerate(lines) if x[3] == p]
            if sum(len(lines[n][2]) for n in own) >= paragraph_words:
                units.add((own[0], own[-1]))
        size = lambda a, b: sum(len(x[2]) for x in lines[a:b + 1])
        for a in range(len(lines)):
            for b in range(a, min(a + run_lines, len(lines))):
                if size(a, b) >= run_words and (size(a, b - 1) < run_words or size(a + 1, b) < run_words):
                    units.add((a, b))
        gone = set()
        for a, b in sorted(units):
            words = " ".join(w for x in lines[a:b + 1] for w in x[2])
            if met.setdefault(words, (i, a)) != (i, a):
                gone |= {*range(a, b + 1)}
        out[i] = len(lines), ",".join(f"{lines[n][0]}-{lines[n][1]}" for n in sorted(gone))
    return out


def test_wrapped_passages_go_and_headings_stay(spark):
    words = [f"w{i}" for i in range(56)]
    wrapped = "\n".join(" ".join(words[i:i + 7]) for i in range(0, 56, 7))
    docs = spark.createDataFrame([(1, f"{wrapped}\nown"), (2, f"a\n{wrapped}\ntail"), (3, "OWN \nnew")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeated_units(docs).collect()}
    assert got == {1: f"{wrapped}\nown", 2: "a\ntail", 3: "OWN \nnew"}


def test_last_line_of_a_repeated_run_goes(spark):
    """A run that ends in a line which no run from an earlier line needs."""
    lines = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 29), ("b", 5), ("c", 20))]
    docs = spark.createDataFrame([(1, "\n".join([*lines, "x"])), (2, "\n".join(["y", *lines, "z"]))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_report(docs).collect()} == {1: 0, 2: 3}


@pytest.mark.parametrize("bounds", [(8, 30, 8), (3, 9, 3)])
def test_equals_a_plain_reading(spark, bounds):
    draw = random.Random(bounds[1])
    kinds = [" ".join(f"{c}{i}" for i in range(n)) for c, n in zip("abcdefgh", (1, 2, 3, 5, 8, 13, 21, 34))] + ["", " \t"]
    texts = [(i, "\n".join(draw.choice(kinds) if draw.random() < 0.9 else f"own{i} {k}" for k in range(draw.randrange(16)))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, th string, d long")
    names = dict(zip(("paragraph_words", "run_words", "run_lines"), bounds))
    got = {r["doc_id"]: (r["n_units"], r["removed_spans"]) for r in substring_dedup.substring_report(docs, **names).collect()}
    assert got == removed_by_hand(texts, *bounds)


def test_query_equals_a_plain_reading(spark):
    texts = check.connect(SF).execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    got = {r["doc_id"]: (r["n_units"], r["removed_spans"]) for r in queries()["op7_substring_dedup"](spark, SF).collect()}
    assert got == removed_by_hand(texts)
