import random

import pytest
from pyspark.sql import functions as F

from pitlake.llm import bpe, splitting
from pitlake.llm.bpe import VOCABULARY, encoded, library, token_counts
from pitlake.llm.packing import containers_needed, harmonic, packed
from pitlake.llm.splitting import pieces

ODD = ["", None, " ", "\n\n \t\n", "hello world", "Hello  World\r\n\r\nnext\r\n", "it's we'll 'S", "日本語のテキスト。次の文です。", "😀👍🏽 é ​﻿ x y", "<|endoftext|>", "a" * 5000, "=" * 333 + " " * 77 + "b", "\x00\x01", "1234567 89,01", " lead", "trail ", "x y z\x85w"]


def texts(seed, n):
    r = random.Random(seed)
    words = "revenue margin the of Umsatz trimestre 売上 12.5 % ( ) # Item 4. Outlook\n \n\n \r\n . ! ? | \t It's we're".split(" ") + ["\n", "\n\n", "  ", "# Head\n", "RISK FACTORS\n", "x" * 60, "。"]
    return ["".join(r.choice(words) + r.choice([" ", " ", " ", ""]) for _ in range(r.choice([3, 40, 400, 4000]))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return [(i, t, [0]) for i, t in enumerate(ODD + texts(1, 25))]


def test_encoding_equals_the_library(spark, docs):
    df = spark.createDataFrame(docs + docs[:3], "doc_id bigint, text string, ids array<int>")
    got = encoded(df, F.col("text"), ["doc_id"]).collect()
    want = library(VOCABULARY).encode_ordinary
    assert len(got) == len(docs) + 3
    for r in got:
        assert r.ids == want(docs[r.doc_id][1] or ""), docs[r.doc_id][1]
    assert {r.doc_id: r.tokens for r in token_counts(df, F.col("text"), ["doc_id"]).collect()} == {r.doc_id: len(r.ids) for r in got}


def test_parts(monkeypatch):
    import pyarrow as pa

    batch = pa.record_batch({"i": list(range(7)), "t": ["a" * 5, None, "", "b" * 50, "c", "d" * 9, "e"]})
    for size in (1, 10, 1000):
        monkeypatch.setattr(bpe, "PART_BYTES", size)
        parts = list(bpe._parts(batch, 1))
        assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(7)) and all(p.num_rows for p in parts)
    assert list(bpe._parts(batch.slice(0, 0), 1)) == []


def test_long_words_and_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 50)
    monkeypatch.setattr(bpe, "STEPS", 2)
    w, want = bpe._Words(VOCABULARY), library(VOCABULARY).encode_ordinary
    r = random.Random(2)
    many = texts(3, 6) + ["".join(r.choice("abcdefgh") for _ in range(800)), "ab" * 700, "aaab" * 99]
    for t in many:
        assert w.encode([t, "", None]) == [want(t), [], []]
        assert len(w.ids) <= max(50, len(set(w.find(t))))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert encoded(df, F.col("text"), ["doc_id"]).count() == 0
    assert pieces(df, "doc_id", "text", 64, 8).count() == 0
    assert packed(token_counts(df, F.col("text"), ["doc_id"]), "doc_id", "tokens", 64).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_harmonic(seed):
    r = random.Random(seed)
    c = r.choice([1, 7, 2048])
    sizes = [r.choice([0, 1, c, r.randrange(c + 1), min(c, int(r.lognormvariate(4, 1)))]) for _ in range(r.choice([0, 1, 5, 3000]))]
    bins, n = harmonic(sizes, c)
    load = [0] * n
    for b, s in zip(bins, sizes, strict=True):
        load[b] += s
    assert all(x <= c for x in load)
    if len(sizes) > 100:
        assert n <= containers_needed(sum(sizes), c) * 1.7 + 30


def test_packing_holds_everything_once(spark):
    r = random.Random(4)
    rows = [(i, r.choice([0, None, 1, 64, 65, 128, 1000, r.randrange(200)]), "x") for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:2], "id bigint, size int, container string")
    got = packed(df, "id", "size", 64, partitions=3).collect()
    load, parts = {}, {}
    for x in got:
        load[x.container] = load.get(x.container, 0) + x.length
        parts.setdefault(x.id, []).append((x.part, x.start, x.length))
    assert max(load.values()) <= 64
    for i, size, _ in rows:
        own = sorted(parts[i])
        times = 2 if i < 2 else 1
        assert sum(p[2] for p in own) == (size or 0) * times and len(own) == times * max(1, -(-(size or 0) // 64))
        if size and size <= 64:
            assert all(p == (0, 0, size) for p in own)
    assert sorted(map(tuple, packed(df, "id", "size", 64, partitions=3).collect())) == sorted(map(tuple, got))
    fill = sum(load.values()) / 64 / len(load)
    assert fill > 0.9
    with pytest.raises(Exception, match="negative"):
        packed(spark.createDataFrame([(1, -1)], "id int, size int"), "id", "size", 64).collect()


@pytest.mark.parametrize("limit,overlap,size", [(64, 8, 16_384), (64, 16, 700), (200, 0, 700), (40, 10, 300), (512, 64, 16_384)])
def test_pieces(spark, docs, monkeypatch, limit, overlap, size):
    monkeypatch.setattr(splitting, "RANGE", size)
    monkeypatch.setattr(splitting, "AFTER", min(size // 2, 2048))
    monkeypatch.setattr(splitting, "BEFORE", min(size // 4, 512))
    # workers would import the module anew: the functions run here, over the same ranges
    count, text_of = library(VOCABULARY).encode_ordinary, dict((d[0], d[1]) for d in docs)
    import pandas as pd

    df = spark.createDataFrame(docs, "doc_id bigint, text string, piece array<int>")
    r = splitting.ranges(df, "doc_id", "text").orderBy("item", "k").toPandas()
    tables = pd.concat(list(splitting._tables(limit, VOCABULARY)(iter([r]))))
    got = pd.concat(list(splitting._stitch(limit, overlap)(iter([tables]))))
    found = {k: g.sort_values("piece") for k, g in got.groupby("item")}
    check(found, text_of, count, limit, overlap)


def check(found, text_of, count, limit, overlap):
    assert set(found) == {i for i, t in text_of.items() if t and len(count(t)) > limit}
    for i, g in found.items():
        t, end = text_of[i], 0
        assert g["piece"].tolist() == list(range(len(g)))
        for x in g.itertuples():
            n = len(count(t[x.start : x.finish]))
            assert n <= limit and x.start <= end < x.finish
            if x.exact:
                assert n == x.tokens
                shared = len(count(t[x.start : end])) if x.piece else 0
                assert x.piece == 0 or shared == x.shared
            end = x.finish
        assert end == len(t)


def test_pieces_in_spark(spark, docs):
    count = library(VOCABULARY).encode_ordinary
    df = spark.createDataFrame(docs, "doc_id bigint, text string, piece array<int>")
    for limit, overlap in ((64, 8), (512, 64)):
        got = pieces(df, "doc_id", "text", limit, overlap).toPandas()
        text_of = {d[0]: d[1] for d in docs}
        for x in got.itertuples():
            assert text_of[x.doc_id][x.start : x.finish] == x.text and len(count(x.text)) == x.tokens <= limit
        check({k: g.assign(exact=False).sort_values("piece") for k, g in got.groupby("doc_id")}, text_of, count, limit, overlap)


def test_cuts_are_natural(spark):
    para = "The quick brown fox jumps over the lazy dog. It runs on and on."
    text = "\n\n".join(f"# Part {i}\n\n" + " ".join([para] * 3) for i in range(20))
    got = pieces(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id", "text", 80, 0).orderBy("piece").collect()
    assert all(x.text.startswith("# Part") for x in got)
    with pytest.raises(ValueError):
        pieces(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id", "text", 80, 40)


def test_packing_is_the_same_on_every_cluster(spark, monkeypatch):
    """How rows arrive, and in how many partitions, changes nothing."""
    from pitlake.llm import packing

    monkeypatch.setattr(packing, "SHARE", 500)
    r = random.Random(6)
    df = spark.createDataFrame([(i, r.randrange(1, 200)) for i in range(2600)], "id bigint, size int")
    a = sorted(map(tuple, packed(df.repartition(7), "id", "size", 64).collect()))
    assert a == sorted(map(tuple, packed(df.orderBy(F.desc("size")).coalesce(1), "id", "size", 64).collect()))
    assert len({x[0] >> 40 for x in a}) == 6


def test_both_ways_to_split_agree():
    """The spelled-out classes give the pattern's own words, with any characters."""
    import regex

    from pitlake.llm.bpe import PATTERN, splitter

    r, find, own = random.Random(8), splitter(), regex.compile(PATTERN).findall
    pick = [lambda: chr(r.randrange(128)), lambda: chr(r.randrange(0x3000)), lambda: chr(r.randrange(0xD800)), lambda: chr(r.randrange(0xE000, 0x10000)), lambda: r.choice(" \n\t'sdlabc12.\x1c\x1f\x85\xa0é。ー’"), lambda: chr(r.randrange(0x10000, 0x20000))]
    for n in range(4000):
        kinds = pick[:5] if n % 5 else pick
        text = "".join(r.choice(kinds)() for _ in range(r.randrange(60)))
        assert find(text) == own(text), ascii(text)
    assert find("") == []
