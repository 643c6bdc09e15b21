"""The training-data operators against brute force, round trips and held-out rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import check
from __spark_entry__ import oracle_sql, queries
from rulecast.llm import (bpe, decontamination, jaccard_join, language_id, line_dedup, quality_classifier, quality_rules, sharding,
                          substring_dedup, units, url_filter)
from rulecast.llm.queries import URL_RULES, vocabulary_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int"
ODD = [
    (1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, "x", 1), (3, " \n\t ", "en", "s", 4, None, None),
    (4, "long " * 20_000 + "end", "en", "s", 100_003, "x", 2), (5, "one two three\none two three\nfour", "en", "s", 31, "x", 3),
    (5, "one two three\none two three\nfour", "en", "s", 31, "x", 3), (None, "no id at all here", "fr", None, 17, "x", 4),
    (6, "x" * 5000, "en", "s", 5000, "x", 5), (7, "### 12345", "en", "s", 9, "x", 6),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_url_filter", "op5_jaccard_join", "op7_substring_dedup", "op10_decontamination"])
def test_matches_sql(spark, name):
    got = queries()[name](spark, SF).toPandas()
    assert check.difference(got, check.connect(SF).execute(oracle_sql()[name]).df()) is None


# -- tokenizer


@pytest.fixture(scope="module")
def model():
    with open(vocabulary_path(), encoding="utf-8") as file:
        return bpe.BpeModel(file.read())


def test_bpe_equals_the_library(spark, model):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    random.seed(2)
    letters = [*"abcdeAB 's'T'll\n\t\x1c\x85\xa0éÉΣςİßﬁⅣ²½漢🙂", "<|endoftext|>", "'ve", "é", "　", "ᄀ", "ᅡ", "ᆨ"]
    texts = ["".join(random.choice(letters) for _ in range(random.randrange(60))) for _ in range(800)]
    texts += [r[1] for r in ODD if r[1]] + [check.connect(SF).execute("SELECT text FROM documents WHERE doc_id = 3").fetchone()[0]]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_streams_words_within_its_lookahead(model):
    random.seed(3)
    for letters in ("ab", "theran", "abcdefghijklmnopqrstuvwxyz"):
        word = "".join(random.choice(letters) for _ in range(5000)).encode()
        whole = model.merge([model.inner[b] for b in word[:-1]] + [model.final[word[-1]]])
        parts = [*model.stream_word(word, model.lookahead + 5)]
        assert len(parts) > 2 and [t for part in parts for t in part] == whole


def test_bpe_decoder_keeps_unfinished_characters(model):
    model_bytes, joined = model.token_bytes, model.joined
    try:
        model.joined, model.token_bytes = False, {0: b"\xf0\x9f", 1: b"\x99\x82", 2: b"\xff"}
        assert [*model.decode_slices([[0], [1], [2, 0]])] == ["", "🙂", "�", "�"]
    finally:
        model.joined, model.token_bytes = joined, model_bytes


def test_bpe_tables(spark, odd):
    got = {r["doc_id"]: r for r in bpe.bpe_digests(odd, vocabulary_path()).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 0 and got[1]["ids_sha256"] == hashlib.sha256().hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(odd, vocabulary_path()), vocabulary_path()).collect()
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in back} == {k: r["decoded_sha256"] for k, r in got.items()}


# -- lines and units


def test_line_dedup_removes_later_runs(spark, odd):
    lines = [f"line number {i} of the text" for i in range(6)]
    rows = [(10, "\n".join(lines)), (11, "\n".join(["own", *lines[1:4], "tail"])), (12, "\n".join([*lines[:2], "x"])), (13, "\n".join(lines))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in line_dedup.line_report(docs).collect()}
    assert got == {10: "", 11: "1,2,3", 12: "", 13: "0,1,2,3,4,5"}
    kept = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert kept == {10: rows[0][1], 11: "own\ntail", 12: rows[2][1]}
    assert line_dedup.remove_repeated_lines(odd).columns == odd.columns
    assert line_dedup.line_report(odd).count() == len(ODD) and line_dedup.line_report(odd.limit(0)).count() == 0


def test_substring_dedup_keeps_offsets(spark, odd):
    passage = "this passage of more than eight words is repeated here"
    rows = [(1, f"first\n\n{passage}\n\nend"), (2, f"{passage.upper()} \n \nother"), (3, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["removed_spans"] for r in substring_dedup.substring_report(docs).collect()}
    assert got == {1: "", 2: f"0-{len(passage) + 1}", 3: f"0-{len(passage)}"}
    assert {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeated_units(docs).collect()} == {1: rows[0][1], 2: "other"}
    assert substring_dedup.substring_report(odd).count() == len(ODD)
    assert substring_dedup.remove_repeated_units(odd.limit(0)).count() == 0


def test_without_units():
    assert units.without_units("a\nb\nc", "line", [1]) == "a\nc"
    assert units.without_units("a\nb\nc\n", "line", [2]) == "a\nb"
    assert units.without_units("\n a\nb", "line", [0]) == "b"


# -- url filter


def test_url_filter(spark):
    urls = ["http://A.example.NET/en/x", "https://example.net/de/", "http://u:p@www.bad.org:80/p.html?q", "http://bad.org/p#f", "none", None,
            "http://x.org/fr/1", "http://net", "http://b.example.com/de/1", "http://ok.com/?a://b"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    listed = spark.createDataFrame([("https://m.bad.org/p/",), ("http://x.org/fr/1",), (None,)], "url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, listed, URL_RULES).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/de/", "net/", "block"),
        2: ("u:p@www.bad.org:80", "/p.html", None, "block"), 3: ("bad.org", "/p", None, "block"), 4: ("", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("x.org", "/fr/1", "org/fr/", "allow"), 7: ("net", "", None, "allow"),
        8: ("b.example.com", "/de/1", "example.com/de/", "block"), 9: ("ok.com", "/", None, "allow")}
    assert url_filter.filter_urls(pages, listed.limit(0), []).where("verdict = 'block'").count() == 0
    assert url_filter.filter_urls(pages.limit(0), listed, URL_RULES).count() == 0


def test_bloom_filter_loses_no_key(spark):
    from pyspark.sql import functions as F

    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("canonical"))
    urls = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("canonical"), "id").withColumn(
        "h1", F.xxhash64("canonical")).withColumn("h2", F.expr("xxhash64(canonical, 7)"))
    hits = url_filter.possible_hits(urls, url_filter.bloom_blocks(keys, 5000)).where("possible")
    assert hits.where("id < 5000").count() == 5000 and hits.where("id >= 5000").count() < 300


# -- sharding


def test_min_cost_flow_is_cheapest():
    from itertools import product

    random.seed(4)
    for _ in range(30):
        supply = [random.randrange(4) for _ in range(3)]
        capacity = [random.randrange(3) for _ in range(2)]
        capacity.append(max(0, sum(supply) - sum(capacity)))
        price = [[random.randrange(5) for _ in range(3)] for _ in range(3)]
        flow = sharding.min_cost_flow(supply, capacity, lambda i, j: price[i][j])
        best = min(
            sum(price[i][j] for i, js in enumerate(split) for j in js)
            for split in product(*[_shares(s) for s in supply]) if all(sum(js.count(j) for js in split) <= c for j, c in enumerate(capacity)))
        assert sum(price[i][j] * n for (i, j), n in flow.items()) == best
        assert [sum(n for (i, _), n in flow.items() if i == k) for k in range(3)] == supply


def _shares(units_):
    from itertools import combinations_with_replacement

    return [*combinations_with_replacement(range(3), units_)]


def test_sharding_laws(spark, odd, tmp_path):
    rows = queries()["op4_sharding"](spark, "/root/testdata/sf0.01").toPandas()
    docs = check.connect("/root/testdata/sf0.01").execute("SELECT doc_id, text FROM documents").df()
    want = {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in zip(docs.doc_id, docs.text)}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows.itertuples()} == want
    sizes = rows.groupby("shard")["size"].sum()
    assert sorted(sizes.index) == [*range(24)] and sizes.max() - sizes.min() < 0.02 * sizes.mean()
    for _, slots in rows.groupby("shard")["slot"]:
        assert sorted(slots) == [*range(len(slots))]
    from pyspark.sql import functions as F

    placed = sharding.reshard(odd, 3, F.lit(0))
    assert placed.count() == len(ODD) and sharding.reshard(odd.limit(0), 3, F.lit(0)).count() == 0
    path = str(tmp_path / "shards")
    touched = sharding.rewrite_shards(odd, placed, path)
    assert 0 in touched and spark.read.parquet(path).count() == placed.where(F.col("shard").isin(touched)).count()


# -- jaccard join


def brute_components(rows, k, p, q):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            s = len(sets[a] & sets[b])
            if a < b and s and q * s >= p * (len(sets[a]) + len(sets[b]) - s):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words", [30, 2000])
def test_jaccard_components(spark, words):
    """Large groups of near copies at all distances, so that long lists and their rounds are met."""
    random.seed(words)
    rows = [(0, None), (1, ""), (2, "  ")]
    for _ in range(8):
        base = [f"w{random.randrange(words)}" for _ in range(random.choice([1, 2, 12, 40, 120]))]
        for _ in range(random.choice([1, 3, 60])):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 5])):
                copy[random.randrange(len(copy))] = f"w{random.randrange(words)}"
            rows.append((len(rows), " ".join(copy)))
    for k, p, q in ((3, 90, 100), (5, 80, 100)):
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, p, q).collect()
        assert {r[0]: (r[1], r[2]) for r in got} == brute_components(rows, k, p, q)


def test_jaccard_odd_rows(spark, odd):
    assert jaccard_join.jaccard_components(odd, 3, 90, 100).count() == len(ODD)
    assert jaccard_join.keep_one(odd).columns == odd.columns
    assert jaccard_join.jaccard_components(odd.limit(0), 3, 90, 100).count() == 0


# -- quality rules


def test_repetition_against_windows():
    random.seed(6)
    for size in (0, 1, 4, 30, 200):
        words = [random.choice("abcd"[:random.choice([1, 2, 4])]) for _ in range(size)]
        text = " ".join(words) + "\n" + " ".join(words[:size // 3])
        words = text.split()
        n = len(words)
        longest = quality_rules.longest_repeats(np.array([ord(w) for w in words], np.int64), [n])
        for i in range(n):
            most = max((k for j in range(n) if j != i for k in range(n - max(i, j) + 1) if words[i:i + k] == words[j:j + k]), default=0)
            assert longest[i] == most
        windows = Counter(tuple(words[i:i + 5]) for i in range(n - 4))
        covered = {i + k for i in range(n - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
        assert quality_rules.judge_texts([text])[0][4] == len(covered)


def test_repetition_rules(spark, odd):
    got = {r["doc_id"]: r for r in quality_rules.repetition_rules(odd).collect()}
    assert len(got) == len({r[0] for r in ODD}) and got[1]["n_words"] == 0 and got[1]["base_failed"]
    assert got[5]["n_dup_lines"] == 1 and got[7]["n_symbols"] == 3 and got[4]["n_words"] == 20_001
    assert quality_rules.repetition_rules(odd.limit(0)).count() == 0


# -- language id


def test_gru_gradients():
    net = language_id.ByteGru(3, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes, labels = language_id.pack([b"abc", b"defgh", b"z"]), np.array([0, 1, 2])
    _, grads = net.gradients(codes, labels)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, sides = net.p[k][at], []
        for step in (1e-3, -1e-3):
            net.p[k][at] = old + step
            sides.append(net.gradients(codes, labels)[0])
        net.p[k][at] = old
        assert abs((sides[0] - sides[1]) / 2e-3 - g[at]) < 1e-5


def test_language_accuracy_and_odd_rows(spark, odd):
    rows = queries()["op9_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    docs = check.connect("/root/testdata/sf0.01").execute("SELECT doc_id, lang FROM documents").df()
    both = rows.merge(docs, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.97 and both.score.between(0, 1).all()
    from pyspark.sql import functions as F

    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_languages(odd, F.lit(True)).collect()}
    assert got[1] == got[2] == got[7] == ("und", 0.0) and got[4][0] in ("en", "fr")
    assert language_id.identify_languages(odd.limit(0), F.lit(True)).count() == 0


# -- quality classifier


def test_quality_classifier(spark, odd):
    got = queries()["op6_quality_classifier"](spark, "/root/testdata/sf0.1").toPandas()
    labels = check.connect("/root/testdata/sf0.1").execute("SELECT * FROM labels").df().merge(got, on="doc_id")
    bad = (labels.quality == 0) | (labels.toxic == 1)
    assert (labels.kept == ~bad).mean() > 0.95 and labels.kept[~bad].mean() > 0.99
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.keep_good(odd, none).count() == len(ODD)
    some = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (7, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.score_documents(odd, some).count() == len(ODD)
    assert quality_classifier.keep_good(odd.limit(0), some).columns == odd.columns


# -- decontamination


def test_decontamination(spark, odd):
    item = " ".join(f"t{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "Short item"), (3, None), (4, ""), (10, item)], "item_id long, text string")
    rows = [(1, f"a b c {item[:52]} d"), (2, "x SHORT, item! y"), (3, "t1 t2 t3"), (4, None), (5, "w " * 100 + "short item" + " z" * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontamination.benchmark_hits(docs, bench).collect()}
    assert got == {1: (15, 2, True), 2: (2, 1, True), 3: (0, 0, False), 4: (0, 0, False), 5: (2, 1, False)}
    kept = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, bench).collect()}
    assert kept == {3: "t1 t2 t3", 4: None, 5: "w " * 100 + " z" * 100}
    assert decontamination.benchmark_hits(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.decontaminate(odd, bench).columns == odd.columns
    assert decontamination.decontaminate(odd.limit(0), bench).count() == 0


# -- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    everything = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r[0] for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert {r[0] for r in docs.select("doc_id").collect()} <= before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert 0 < last.count() == docs.count() < everything
    rows = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    # Stage 5 has left no near copies, stage 4 no contaminated document.
    assert all(c == i for i, (_, c) in brute_components(rows.items(), 5, 80, 100).items())
    assert corpus_pipeline.run(spark, SF).count() == last.count()
