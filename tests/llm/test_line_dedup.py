"""Runs of lines are judged by all their lines and words."""

import random

import pytest

from rulecast.llm import line_dedup, substring_dedup, units


def brute(rows, min_lines, long_words):
    """Removed lines and longest removed run of each document, by the longest run from each
    line that begins earlier too."""
    places = [(i, u) for i, lines in sorted(rows.items()) for u in range(len(lines))]
    gone, most = {i: set() for i in rows}, dict.fromkeys(rows, 0)
    for n, (i, u) in enumerate(places):
        longest = 0
        for j, v in places[:n]:
            k = 0
            while u + k < len(rows[i]) and v + k < len(rows[j]) and rows[i][u + k] == rows[j][v + k]:
                k += 1
            longest = max(longest, k)
        run = rows[i][u:u + longest]
        if longest >= min_lines or longest and sum(len(x.split()) for x in run) >= long_words:
            gone[i] |= {*range(u, u + longest)}
            most[i] = max(most[i], longest)
    return {i: (",".join(map(str, sorted(g))), most[i]) for i, g in gone.items()}


def test_two_line_run_of_many_words_goes(spark):
    a, b = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(9))
    rows = [(1, f"{a}\n{b}\nx"), (2, f"y\n{a}\n{b}\nz"), (3, f"{a}\nv"), (4, f"{b}\nx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["removed"] for r in line_dedup.line_report(docs).collect()} == {1: "", 2: "1,2", 3: "", 4: ""}
    assert {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_lines(docs).collect()}[2] == "y\nz"


@pytest.mark.parametrize("min_lines, long_words", [(3, 20), (5, 12)])
def test_runs_against_brute_force(spark, min_lines, long_words):
    random.seed(min_lines)
    kinds = [" ".join(f"{c}{i}" for i in range(n)) for c, n in zip("abcdefghij", (1, 2, 3, 5, 7, 9, 11, 14, 19, 21))]
    rows = {i: [random.choice(kinds) if random.random() < 0.8 else f"own{i}-{k}" for k in range(random.randrange(14))] for i in range(40)}
    rows[40] = rows[7] * 2
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows.items()], "doc_id long, text string")
    # Of rows equal in text each is a document of its own, as their ids differ.
    got = {r["doc_id"]: (r["removed"], r["longest_run"]) for r in line_dedup.line_report(docs, min_lines, long_words).collect()}
    assert got == brute(rows, min_lines, long_words)


def test_every_line_knows_its_longest_earlier_run(spark):
    """Copies of 1 to 40 lines, runs within runs, and a text that repeats itself."""
    random.seed(4)
    page = [f"p{i}" for i in range(40)]
    rows = {0: page, 1: ["a", *page[3:30], "b", *page[20:24]], 2: page[5:28] + page[9:40], 3: ["a", "b"] * 17, 4: page, 5: ["a"] * 9 + page[39:]}
    for i in range(6, 20):
        at = random.randrange(35)
        rows[i] = [f"own{i}", *page[at:at + random.randrange(1, 30)], *["a", "b"] * random.randrange(5)]
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows.items()], "doc_id long, text string")
    lines = line_dedup.text_units(docs, "line", fold=False)
    got = {(r["d"], r["unit"]): (r["run"], r["words"], (r["first"]["d"], r["first"]["unit"])) for r in line_dedup.repeated_runs(lines).collect()}
    places = [(i, u) for i, x in sorted(rows.items()) for u in range(len(x))]
    want = {}
    for n, (i, u) in enumerate(places):
        best = (0, None)
        for j, v in places[:n]:
            k = 0
            while u + k < len(rows[i]) and v + k < len(rows[j]) and rows[i][u + k] == rows[j][v + k]:
                k += 1
            if k > best[0]:
                best = (k, (j, v))
        if best[0]:
            want[i, u] = (best[0], best[0], best[1])  # a word a line
    assert got == want
    assert line_dedup.repeated_runs(lines.limit(0)).count() == 0


def test_columns_named_like_the_keys(spark):
    schema = "doc_id long, text string, d int, th string, unit int, `row` int, gone_units string, `a``b.c` int"
    rows = [(i, "x y\n" * 3 + "own" * i, 7, "t", 8, 9, "g", 10) for i in range(3)]
    docs = spark.createDataFrame(rows, schema)
    for kept in (line_dedup.remove_repeated_lines(docs, 2, 3), substring_dedup.remove_repeated_units(docs, paragraph_words=2, run_words=4, run_lines=2)):
        assert kept.columns == docs.columns
        assert all(tuple(r)[2:] == (7, "t", 8, 9, "g", 10) for r in kept.collect())


@pytest.mark.parametrize("bits", [1 << 26, 1 << 6])
def test_documents_that_lose_nothing_are_not_shuffled(spark, monkeypatch, bits):
    """Marked are those that lose lines and, with a table that is too small, others; the result is the same."""
    monkeypatch.setattr(units, "MARK_BITS", bits)
    page = "one two three\nfour five six\nseven eight nine"
    rows = [(i if i % 50 != 7 else None, page + f"\nown {i}" if i % 20 == 0 else None if i % 31 == 0 else f"own {i}\nalso {i}", 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    gone = line_dedup.repeated_lines(docs)[1]
    marked = units.maybe_among(units.keyed(docs), gone)
    assert marked.count() == 400 and marked.where("NOT maybe").join(gone, ["d", "th"]).isEmpty()
    if bits > 64:
        assert marked.where("maybe").count() == gone.select("d", "th").distinct().count() == 19
    got = line_dedup.remove_repeated_lines(docs)
    assert got.schema == docs.schema
    text = [t if t is None or i % 20 or i == 0 else f"own {i}" for i, (_, t, _) in enumerate(rows)]
    want = [(d, t, 5 if t is None else len(t)) for (d, _, _), t in zip(rows, text)]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
