"""Phrase collocations against counting by hand and against SQL."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

import check
from __spark_entry__ import oracle_sql, queries
from rulecast.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, phrase string, f long"
ODD = [
    (1, None, None, "x", 1), (2, "", "en", None, 2), (2, "", "en", None, 2), (3, " \t\n.;", "en", "x", None), (4, "ab " * 30_000, "fr", "x", 1),
    (5, "Ab\xa0cd É\x00x, ab", None, "x", 1), (6, "a b c " * 12 + "\x0b" + "a\tb  c?" * 12, "und", "x", 1), (None, "A B c", "de", "y", 2),
]


def by_hand(rows, depth):
    """(lang, words) -> occurrences, and words of each language."""
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", plain):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, depth + 1):
                counts.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    return counts, totals


def report(rows, depth, least, covered, top):
    counts, totals = by_hand(rows, depth)
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in found.items():
        if any(x == lang and len(v) > len(w) and covered[1] * b >= covered[0] * a
               and any(v[i:i + len(w)] == w for i in range(len(v))) for (x, v), b in found.items()):
            continue
        cuts = [(Fraction(1000000 * a * a, counts[lang, w[:k]] * counts[lang, w[k:]]).__floor__(), k, counts[lang, w[:k]], counts[lang, w[k:]])
                for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    rows, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return rows


def invented(n, seed):
    draw = random.Random(seed)
    words = ["the", "of", "a", "new", "york", "city", "hall", "É", "x'", "7"]
    return [(i, "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n"]) for _ in range(draw.randrange(80))),
             draw.choice(["en", "en", "fr", None]), "c", 3) for i in range(n)]


@pytest.mark.parametrize("shard_words", [1, 200, 1_000_000])
@pytest.mark.parametrize("depth", [2, 3, 5])
def test_equals_counting_by_hand(spark, shard_words, depth):
    rows = invented(60, 3) + ODD
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, co.collocations(docs, depth, 4, (50, 100), 40, shard_words).collect()))
    assert got == report(rows, depth, 4, (50, 100), 40)


def test_extensions_count_words_beside(spark):
    rows = invented(40, 5)
    counts, _ = by_hand(rows, 4)
    table = co.phrase_counts(spark.createDataFrame(rows, SCHEMA), 3, 1, extensions=True).where("phrase IS NOT NULL")
    for lang, phrase, f, before, after in table.collect():
        w = tuple(bytes(phrase).decode().split(" "))
        assert f == counts[lang, w]
        assert before == sum(n for (x, v), n in counts.items() if x == lang and len(v) == len(w) + 1 and v[1:] == w)
        assert after == sum(n for (x, v), n in counts.items() if x == lang and len(v) == len(w) + 1 and v[:-1] == w)
    assert table.count() == sum(len(w) <= 3 for _, w in counts)


def test_suffix_order():
    draw = random.Random(1)
    for letters in (1, 2, 9):
        pieces = [[draw.randrange(1, letters + 1) for _ in range(draw.randrange(1, 40))] for _ in range(30)]
        symbols = np.array([s for p in pieces for s in [*p, 0]])
        keys = [(list(symbols[i:i + list(symbols[i:]).index(0)]), i) for i in range(len(symbols))]
        # an end mark is below all words, and marks go by place
        want = sorted(range(len(symbols)), key=lambda i: ([(s, 0) for s in keys[i][0]] + [(0, i + len(keys[i][0]))]))
        assert co.suffix_order(symbols).tolist() == want


def test_filter_loses_no_phrase(spark):
    import pyarrow as pa

    phrases = spark.createDataFrame([("en", f"w{i} x{i}".encode()) for i in range(3000)], "lang string, phrase binary")
    words = co.phrase_filter(phrases)
    inside = pa.array([f"w{i} x{i}".encode() for i in range(3000)], pa.binary())
    outside = pa.array([f"w{i} y{i}".encode() for i in range(3000)], pa.binary())
    assert co._possible(words, "en", inside).all() and co._possible(words, "en", outside).mean() < 0.1


def test_exact_beyond_64_bits(spark):
    """Products of counts may pass 64 bits; the score is a whole number all the same."""
    row = spark.sql("""SELECT (cast(1000000 AS decimal(7, 0)) * (cast(a AS decimal(15, 0)) * cast(a AS decimal(15, 0))))
        div (cast(l AS decimal(15, 0)) * cast(r AS decimal(15, 0))) AS score FROM VALUES (123456789012L, 999999999999L, 123456789013L) t(a, l, r)""").first()
    assert row["score"] == 1000000 * 123456789012**2 // (999999999999 * 123456789013)


def test_tables(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    got = {(r["lang"], r["phrase"]): r for r in co.collocations(odd).collect()}
    assert got["fr", "ab ab ab"]["a"] == 29_998 and got["fr", "ab ab ab"]["n"] == 30_000
    assert ("fr", "ab ab") not in got and got["und", "a b c"]["a"] == 24 and ("und", "a b") not in got
    assert co.collocations(odd.limit(0)).isEmpty() and co.collocations(odd.where("doc_id < 4")).isEmpty()


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = queries()["op11_collocations"](spark, sf).toPandas()
    assert len(got) and check.difference(got, check.connect(sf).execute(oracle_sql()["op11_collocations"]).df()) is None
