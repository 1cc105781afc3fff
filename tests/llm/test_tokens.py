"""Operators 3, 5, 6 and 7 against the libraries, and their own limits."""

import collections
import io
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagelattice.llm import packing, sstable, token_counts, tree_bpe
from pagelattice.llm.chunks import ChunkEncoder
from pagelattice.llm.common import new_folder

PARTS = ["a", "b", " ", "  ", "the", "▁", "\n", "é", "日", "本", "😀", "ing", "tion", "'", "'s", " the", ".", "</s>", "1", "\x00", "\t", " ", "<|endoftext|>", "<|end", "é", "́", "\x1c", "Σ", "ΑΣ ", "Straße", "ÀÉ", "İ"]
TEXTS = [None, "", " ", "one two", "One, two!", "x" * 5000, "日本語" * 2000, "a " * 3000, "a<|endoftext|>b", "  lead and trail  ", "don't\n\n stop\r\n", "ΑΣ ΣΑΣ"]


def some_texts(n, seed=0, most=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_like_the_library(tokenizer_path, name):
    library, own = Tokenizer.from_file(tokenizer_path(name)), ChunkEncoder(tokenizer_path(name), memo=500)
    texts = some_texts(3000) + [t or "" for t in TEXTS]
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == want.ids, t


def test_chunks_on_documents(spark, sf_dir, tokenizer_path):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library, own = Tokenizer.from_file(tokenizer_path(name)), ChunkEncoder(tokenizer_path(name))
        assert all(np.frombuffer(own.encode(t), "<u4").tolist() == e.ids for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True))


@pytest.fixture(scope="module")
def counter(tokenizer_path):
    return token_counts.PrefixCounter(tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def pieces(tokenizer_path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.sampled_from(PARTS), max_size=14).map("".join), budget=st.integers(0, 8))
def test_prefix_counts(counter, pieces, text, budget):
    want = [len(pieces.encode(text[:i])) for i in range(len(text) + 1)]
    assert counter.prefix_counts(text) == want
    units = counter.units(text) if text else []
    assert sum(counter.counts(units)) == want[-1]
    if text:
        assert counter.longest_prefix(units, counter.counts(units), budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_token_counts(spark, tokenizer_path, pieces):
    out = {r["doc_id"]: r for r in token_counts.token_counts(documents(spark, TEXTS), tokenizer_path("piece_bpe_32k.model"), limit=100).collect()}
    for i, t in enumerate(TEXTS):
        n = len(pieces.encode(t or ""))
        assert (out[i]["n_bytes"], out[i]["n_tokens"], out[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)
        assert len(pieces.encode((t or "")[: out[i]["chars_in_limit"]])) <= 100
    assert token_counts.prefix_counts(documents(spark, ["ab", None]), tokenizer_path("piece_bpe_32k.model")).orderBy("doc_id").first()["prefix_counts"] == [len(pieces.encode("ab"[:i])) for i in range(3)]


#: Marks that reorder and compose, Hangul by letters, parts of special strings, and strings that the cutting pattern treats apart.
MARKS = ["a", "b", "the", "\u0301", "\u0323", "\u0345", "\u0130", "e", "\u1100", "\u1161", "\u11a8", "\ud55c", "\uac00", "\u65e5", "<|endoftext|>", "<|endof", "'s", "'", "'re", "!!", "1", "ing", "\u03a3", "\u0cc6", "\u0cc2", "\u09c7", "\u09be", "\u200d", "\u304b", "\u3099", "\U0001f600"]


@pytest.mark.parametrize("leaf", [16, 64, 2048, 4096])
def test_tree_like_the_library(tokenizer_path, leaf):
    library, own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), tree_bpe.TreeEncoder(tokenizer_path("word_bpe_49k.json"), leaf)
    solid = [t.replace(" ", "").replace("\n", "") for t in some_texts(300, 2, 200)]
    rnd = random.Random(leaf)
    marks = ["".join(rnd.choice(MARKS + spaces) for _ in range(rnd.randint(0, 200))) for spaces in ([], [" "] * 9 + ["\n", "  "]) for _ in range(500)]
    # long stretches of marks that reorder, and of letters that no rule splits
    long = ["".join(random.Random(seed).choice("e\u0323\u0301") for _ in range(12_000)) for seed in (64, 95, 295, 302, 305)] + ["".join(rnd.choice(MARKS) for _ in range(9_000)) for _ in range(5)] + ["".join(rnd.choice("abcde") for _ in range(9_000))]
    texts = some_texts(300, 1, 200) + solid + marks + long + [t or "" for t in TEXTS]
    joins = 0
    for t, want, (ids, n) in zip(texts, library.encode_batch(texts, add_special_tokens=False), own.encode_all(texts), strict=True):
        assert list(ids) == want.ids, (t[:100], len(t))
        joins += n
    assert joins >= len(long)


def test_encode_decode(spark, tokenizer_path):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for r in tree_bpe.encode_decode(documents(spark, TEXTS), tokenizer_path("word_bpe_49k.json")).collect():
        ids = library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["ids"], r["decoded"]) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))


def test_real_texts_go_through_the_tree(spark, tokenizer_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    joins = 0
    for r in tree_bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json")).collect():
        assert r["ids"] == " ".join(map(str, library.encode(texts[r["doc_id"]], add_special_tokens=False).ids))
        joins += r["n_joins"]
    assert joins > 100


@pytest.mark.parametrize("run", [lambda d, path: token_counts.token_counts(d, path("piece_bpe_32k.model")), lambda d, path: tree_bpe.encode_decode(d, path("word_bpe_49k.json"))])
def test_odd_tables_of_tokens(spark, tokenizer_path, run):
    """Null ids, repeated rows, columns with clashing names, and an empty table."""
    names = "doc_id long, text string, n_tokens string, ids string, n_joins string, n_bytes string, lang string"
    odd = spark.createDataFrame([(1, "one two", "x", "x", "x", "x", "x"), (1, "one two", "x", "x", "x", "x", "x"), (None, "one", None, None, None, None, None), (2, None, None, None, None, None, None)], names)
    out = sorted(((r["doc_id"] or 0), r["n_tokens"]) for r in run(odd, tokenizer_path).collect())
    assert [i for i, _ in out] == [0, 1, 1, 2] and out[1] == out[2] and out[3] == (2, 0)
    assert run(odd.limit(0), tokenizer_path).count() == 0


@settings(max_examples=200, deadline=None)
@given(capacity=st.integers(1, 40), data=st.data())
def test_plan(capacity, data):
    counts = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(0, 50)))
    placed, sequences = collections.Counter(), 0
    for n, inside in packing.plan(counts, capacity):
        assert n > 0 and inside and sum(inside) <= capacity and sum(3 * x > capacity for x in inside) <= 2
        sequences += n
        for x in inside:
            placed[x] += n
    assert placed == +collections.Counter(counts)
    # best fit never leaves two sequences that would go into one
    assert sequences <= 2 * -(-sum(k * n for k, n in counts.items()) // capacity)


def test_packing(spark, sf_dir, tokenizer_path):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + TEXTS + ["same"] * 300
    rows = packing.pack_documents(documents(spark, texts), tokenizer_path("word_bpe_49k.json")).collect()
    by, held = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        got = [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in sorted(by[i], key=lambda r: r["piece"])]
        assert got == [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in rows)
    assert len(held) <= 1.1 * total / 2048 + 1


def test_packing_repeated_rows_and_nothing(spark, tokenizer_path):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, None, None)], "doc_id long, text string, offset string")
    assert packing.pack_documents(rows, tokenizer_path("word_bpe_49k.json")).count() == 3
    assert packing.pack_documents(rows.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


@settings(max_examples=50, deadline=None)
@given(docs=st.lists(st.tuples(st.integers(-(1 << 40), 1 << 40), st.lists(st.integers(0, 70000), max_size=30)), max_size=60), wide=st.booleans())
def test_shard(docs, wide):
    docs = sorted((i, [x if wide else x & 0xFFFF for x in ids]) for i, ids in docs)
    out = io.BytesIO()
    w = sstable.ShardWriter(out, wide, block_bytes=64)
    for i, ids in docs:
        w.add(i, np.array(ids, dtype="<u4").tobytes())
    w.close()
    r = sstable.ShardReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert [(i, np.frombuffer(v, "<u4").tolist()) for i, _, v in r.rows()] == [(i, ids) for i, ids in docs]
    for i, _ in docs:
        assert sorted(np.frombuffer(v, "<u4").tolist() for v in r.get(i)) == sorted(ids for k, ids in docs if k == i)
    assert r.get((1 << 41) + 1) == [] and r.get(None) == []
    assert sstable.key_of(None) < sstable.key_of(-5) < sstable.key_of(0) < sstable.key_of(7) and sstable.id_of(sstable.key_of(-5)) == -5


def test_shards(spark, tokenizer_path):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = TEXTS + some_texts(200, 5)
    docs = documents(spark, texts)
    for shard_bytes in (1 << 12, 1 << 25):
        folder = new_folder(spark, "test-shards")
        rows = sstable.read_shards(sstable.write_shards(docs, tokenizer_path("byte_bpe_50k.json"), folder, shard_bytes=shard_bytes), folder, with_ids=True).orderBy("doc_id").collect()
        start = 0
        for t, r in zip(texts, rows, strict=True):
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
            assert (r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (start, len(ids), ids, zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
            start += len(ids)
    folder = new_folder(spark, "test-shards")
    assert sstable.read_shards(sstable.write_shards(docs.limit(0), tokenizer_path("byte_bpe_50k.json"), folder), folder).count() == 0
    folder = new_folder(spark, "test-shards")
    odd = spark.createDataFrame([(None, "a", 1, 2), (2, "b", 3, 4), (2, "b", 3, 4)], "doc_id long, text string, order int, start int")
    assert [r["doc_id"] for r in sstable.read_shards(sstable.write_shards(odd, tokenizer_path("byte_bpe_50k.json"), folder), folder).orderBy("start").collect()] == [None, 2, 2]


def test_shards_of_one_identifier_are_split_and_found_again(spark, tokenizer_path):
    library, folder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), new_folder(spark, "test-shards")
    rows = [(7 if i % 3 else i, f"text {i} " * 20) for i in range(600)] + [(None, f"none {i} " * 20) for i in range(300)]
    manifest = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json"), folder, shard_bytes=1 << 13)
    assert manifest.count() > 8 and manifest.agg({"n_docs": "max"}).first()[0] < 300
    assert [r["doc_id"] for r in sstable.read_shards(manifest, folder).orderBy("start").collect()] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in sstable.lookup(manifest, folder, [7, None, 3, 4]).collect()))
    assert got == sorted((i is not None, i or 0, [*library.encode(t, add_special_tokens=False).ids, 0]) for i, t in rows if i in (7, None, 3))
