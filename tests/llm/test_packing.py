import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from textloom.llm import packing


def check(rows, texts, capacity=1024):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padded = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded, len(by_sequence)


def test_cuts_sum_up_and_fit():
    for n in [*range(1, 3000, 7), 1024, 2048]:
        parts = packing.cuts(n, 1024)
        assert sum(parts) == n and all(p in set(packing.class_sizes(1024)) for p in parts)
        assert len(parts) <= n // 1024 + 5


def test_leftovers_fit():
    left = {s: 1024 // s - 1 for s in packing.class_sizes(1024)}
    used = {}
    for (size, _), (b, at) in packing.leftover_bins(left, 1024).items():
        used.setdefault(b, []).append((at, size))
    for parts in used.values():
        end = 0
        for at, size in sorted(parts):
            assert at == end
            end += size
        assert end <= 1024


@pytest.mark.parametrize("text", ["", "hello  world\n\n x", "<|endoftext|> a<|endoftext|>", "日本語 \U0001f600   x", "a" * 3000, "  ", "'s 're\tx1y2", "İß́e\x00\x7f"])
def test_ids_are_those_of_the_vocabulary(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder(packing.vocabulary())(text) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" ", " " * 100_000, " " * 2_000_000, "\t" * 2_000_000 + "x", "a" + "\n" * 2_000_000 + " b", " \t\r\n" * 300_000, "ab " * 300_000 + "\u00a0" * 1_000_000])
def test_long_white_space(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder(packing.vocabulary())(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_text_of_white_space_is_packed(spark):
    texts = {1: " " * 1_000_000, 2: "a b", 3: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(packing.harmonic_pack(docs).collect(), texts)


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7)
    rows = packing.harmonic_pack(docs).collect()
    padded, sequences = check(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert padded < 0.02 * 1024 * sequences


def test_edge_rows(edge_docs, no_docs):
    docs = edge_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check(packing.harmonic_pack(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    rows = packing.harmonic_pack(edge_docs).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 5)
    assert [r["length"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1]
    assert packing.harmonic_pack(no_docs).count() == 0
