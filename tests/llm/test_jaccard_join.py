"""Classes of one doc_id, blocks of nested groups, counted frequencies, scratch tables."""

import random
from pathlib import Path
from urllib.parse import unquote

import numpy as np

from rulecast.llm import jaccard_join
from rulecast.llm.common import stored, stored_alone


def test_doc_id_over_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    rows = [(3, a), (10, a), (10, b), (12, b), (20, c), (10, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs, 3, 90, 100).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (10, 3), (10, 3), (10, 3), (12, 3), (20, 20)]


def test_one_document_is_a_doc_id_and_a_text(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcd")
    rows = [(3, a), (10, a), (10, b), (11, c), (11, d), (12, d), (11, d), (20, c), (None, a), (21, None), (21, "")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, id int, th int, `row` int")
    kept = jaccard_join.keep_one(docs)
    assert kept.schema == docs.schema
    got = [tuple(r)[:2] for r in kept.collect()]
    assert sorted((g for g in got if g[1] not in (c, d)), key=str) == sorted([(3, a), (10, b), (None, a), (21, None), (21, "")], key=str)
    assert {g[1] for g in got} == {a, b, c, d, None, ""}
    assert len({g for g in got if g[1] == c}) == len({g for g in got if g[1] == d}) == 1


def test_blocks_of_nested_groups_grow_with_the_documents(spark, monkeypatch):
    """Passages that lie in one another, each in many documents that aren't near copies."""
    random.seed(4)
    monkeypatch.setattr(jaccard_join, "LIST_SIZE", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_SIZE", 40)
    counts, search = [], jaccard_join.search_blocks

    def counted(members, *rest):
        counts[-1] += members.count()
        return search(members, *rest)

    monkeypatch.setattr(jaccard_join, "search_blocks", counted)
    for n in (120, 240, 480):
        counts.append(0)
        rows = []
        for i in range(n):
            words = [f"p{j}" for j in range(24 + i % 30)] + [f"q{random.randrange(6)}-{j // 4}" for j in range(8)]
            rows.append((i, " ".join(words + ([f"own{i}"] if i % 5 else []))))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, 3, 90, 100).collect()}
        sets = {i: set(jaccard_join.text_shingles(t, 3).tolist()) for i, t in rows}
        want = {i: i for i in sets}
        for a in sets:
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    low, high = sorted((want[a], want[b]))
                    want = {i: low if c == high else c for i, c in want.items()}
        assert got == want
    # At most a membership for each list of a prefix (10 shingles, in 2 bands of sizes).
    assert all(count <= 20 * n for count, n in zip(counts, (120, 240, 480)))


def test_levels_follow_the_counts(spark):
    docs = spark.createDataFrame([(" ".join(["a b c", *([f"x{i}"] * 2)]),) for i in range(40)] + [(None,), ("",)], "text string")
    levels = jaccard_join.shingle_levels(docs.repartition(5), 3, 1 << 18)
    common, own = (jaccard_join.text_shingles(t, 3)[0] & (len(levels) - 1) for t in ("a b c", "c x7 x7"))
    assert levels[common] == int(8 * np.log2(41)) and levels[own] == 8
    assert not jaccard_join.shingle_levels(docs.limit(0), 3, 1 << 10).any()


def test_scratch_tables_are_deleted(spark):
    kept = stored_alone(spark, lambda: stored(stored(spark.range(5), "one"), "two").where("id > 1"), "three")
    assert kept.count() == 3
    folder = Path(unquote(kept.inputFiles()[0]).split(":", 1)[1]).parent.parent
    assert [x.name for x in folder.iterdir() if x.name.split("-")[0] in ("one", "two")] == []


def test_only_tokens_of_lists_are_sent(spark):
    rows = spark.createDataFrame([(5, 1, 0, [2, 3, -4]), (0, 2, 1, []), (9, 3, 2, [2])], "mask long, id long, about long, prefix array<long>")
    lists = spark.createDataFrame([(2 ^ 5,), (-4 ^ 5,), (2 ^ 9,)], "key long")
    got = sorted(map(tuple, jaccard_join.in_some_list(rows.repartition(1), lists).collect()))
    assert got == sorted([(2 ^ 5, 1, 0), (-4 ^ 5, 1, 0), (2 ^ 9, 3, 2)])
    assert jaccard_join.in_some_list(rows, lists.limit(0)).count() == 0
