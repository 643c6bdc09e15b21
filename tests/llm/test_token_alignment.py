"""Token alignment against a reading token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from __spark_entry__ import queries
from rulecast.llm import token_alignment as ta
from rulecast.llm.queries import SIDES, vocabulary_path

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\t  x", "<|endoftext|> a <s> b </s>", "▁", "naïve — “quotes” 漢字 🙂👩‍👧 ", "=" * 700, " " * 333 + "a", "x" * 20_000,
       "\x00\x01\x7f", "<0x41> &amp;", "é ﬁ ½", "the end", "the end", "\r\nline\r\n", "ﷺ" * 50, "a​﻿b"]


@pytest.fixture(scope="module")
def paths():
    return [vocabulary_path(name) for name in SIDES]


def tokens_by_hand(text, paths):
    """Ids and bytes of both sides, none where they don't give back the text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = tokens_by_hand.__dict__.setdefault("a", Tokenizer.from_file(paths[0]))
    a.encode_special_tokens = True
    b = tokens_by_hand.__dict__.setdefault("b", sentencepiece.SentencePieceProcessor(model_file=paths[1]))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in shown)}
    one = [(t, bytes(letters[c] for c in a.id_to_token(t))) for t in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(t, bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode()) for t in b.encode(text)]
    plain = (" " + text).encode()
    if not text or any(b"".join(x for _, x in side) != plain for side in (one, two)):
        return [], []
    return one, two


def by_hand(texts, paths):
    documents, holders = [], Counter()
    for text in texts:
        one, two = tokens_by_hand(text or "", paths)
        ends, at = [], 0
        sides = []
        for side in (one, two):
            at, places = 0, []
            for token, piece in side:
                at += len(piece)
                places.append((token, at))
            sides.append(places)
            ends.append({e for _, e in places})
        groups, queues = [], [iter(places) for places in sides]
        for end in sorted(ends[0] & ends[1]) if one else []:
            group = ([], [])
            for queue, tokens in zip(queues, group):
                for token, e in queue:
                    tokens.append(token)
                    if e == end:
                        break
            groups.append(group)
        links = [(x, y) for a, b in groups for x in a for y in b]
        holders.update(set(links))
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        documents.append((len(one), len(two), len(groups), links, hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    most = defaultdict(int)
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    return [(n_a, n_b, n_g, len(links), sum(holders[x] == most[x[0]] for x in links), sum(holders[x] for x in links), h)
            for n_a, n_b, n_g, links, h in documents]


def report(docs, paths):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return [tuple(r[c] for c in names) for r in sorted(ta.alignment_report(docs, *paths).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))]


def invented(n):
    draw = random.Random(6)
    letters = [*"aeiounrst  .,'\n", "the ", "tion", "é", "ß", "漢", "🙂", "  ", "==", "\t", "1", "2024", "A", "▁"]
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(120))) for _ in range(n)]


def test_equals_reading_by_hand(spark, paths, monkeypatch):
    texts = [t for t in ODD if t is None or len(t) < 2000] + invented(150)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, a long, row long").repartition(3)
    want = by_hand(texts, paths)
    assert report(docs, paths) == want
    monkeypatch.setattr(ta, "PAIRS_SENT", 0)
    assert report(docs, paths) == want


def test_words_give_the_ids_of_whole_texts(paths):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(paths[0])
    library.encode_special_tokens = True
    with open(paths[0]) as a, open(paths[1], "rb") as b:
        tokens = ta.Tokenizers(a.read(), b.read())
    draw = random.Random(8)
    plain = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028)]]
    odd = [*"\x0b\x0c\x1c\x1f\x85\xa0\u2028漢🙂٣", "'s", "'ll", "  ", "\n\n", "the", "12", "'T"]
    texts = [" " + "".join(draw.choice(letters) for _ in range(draw.randrange(80)))
             for letters in (plain, plain + odd, [*" '\n\tsat1.,"], [*"aé ½²'"], odd + [*"ab1. "]) for _ in range(400)]
    assert tokens.by_words and sum(ta.PLAIN.fullmatch(t) is not None for t in texts) > 1000
    assert tokens.encode_a(texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_large_groups_are_counted_in_bulk(paths):
    with open(paths[0]) as a, open(paths[1], "rb") as b:
        tokens = ta.Tokenizers(a.read(), b.read())
    texts = [t for t in ODD + invented(60) if t]
    al = ta.Alignment(tokens, texts)
    few = [x.tolist() for x in al.pairs()]
    before, ta.SPELLED = ta.SPELLED, 0
    try:
        assert [x.tolist() for x in al.pairs()] == few
    finally:
        ta.SPELLED = before


def test_overlaps(spark, paths):
    texts = [t for t in ODD if t is None or len(t) < 1000] + invented(40)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = defaultdict(list)
    for r in ta.token_overlaps(docs, *paths).collect():
        got[r["doc_id"]].append((r["a"], r["b"], r["begin"], r["end"], r["a_id"], r["b_id"], r["group"]))
    for i, text in enumerate(texts):
        spans = []
        for side in tokens_by_hand(text or "", paths):
            at, places = 0, []
            for token, piece in side:
                places.append((at, at + len(piece), token))
                at += len(piece)
            spans.append(places)
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        want = [(a, b, max(s, u), min(e, v), x, y, sum(c <= max(s, u) for c in common)) for a, (s, e, x) in enumerate(spans[0])
                for b, (u, v, y) in enumerate(spans[1]) if max(s, u) < min(e, v)]
        assert sorted(got[i]) == want


def test_tables(spark, paths):
    schema = "doc_id long, text string, n_a long, times string"
    docs = spark.createDataFrame([(i if i % 5 else None, t, 3, "x") for i, t in enumerate(ODD)], schema)
    got = ta.alignment_report(docs, *paths).collect()
    assert len(got) == len(ODD) and sum(r["doc_id"] is None for r in got) == 4
    assert ta.alignment_report(docs.limit(0), *paths).isEmpty() and ta.token_overlaps(docs.limit(0), *paths).isEmpty()


def test_query_equals_reading_by_hand(spark, paths):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    got = queries()["op12_token_alignment"](spark, SF).orderBy("doc_id").drop("doc_id").collect()
    assert [tuple(r) for r in got] == by_hand(texts, paths)


def test_words_are_divided_and_numbered_as_the_library_does(paths, monkeypatch):
    """The division of plain texts is that of all texts, and forgotten words are encoded anew."""
    monkeypatch.setattr(ta, "CACHE_WORDS", 40)
    tokens = ta.Tokenizers(open(paths[0], encoding="utf-8").read(), open(paths[1], "rb").read())
    random.seed(9)
    letters = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028))]
    texts = ["".join(random.choices([*letters, *" \n'sdmt12" * 20], k=random.randrange(40))) for _ in range(2000)]
    assert all(ta.PLAIN_WORDS.findall(t) == ta.WORDS.findall(t) for t in texts)
    for part in (texts[:300], texts[300:301], [], ["", "漢字 x"], texts[:300]):
        assert tokens.encode_a(part) == [x.ids for x in tokens.a.encode_batch(part, add_special_tokens=False)]
        assert len(tokens.known) < 40 + 40 * 300


def test_documents_next_to_each_other_share_no_token(paths):
    """Places set documents apart, also where one has no tokens."""
    tokens = ta.Tokenizers(open(paths[0], encoding="utf-8").read(), open(paths[1], "rb").read())
    texts = ["the end", "", "the", "the  end", "end", "\x00"]
    together, alone = ta.Alignment(tokens, texts), [ta.Alignment(tokens, [t]) for t in texts]
    assert len(together.overlaps()) == sum(len(x.overlaps()) for x in alone if len(x.a))
    assert together.a_group.max() + 1 == sum(x.a_group.max() + 1 for x in alone if len(x.a))
