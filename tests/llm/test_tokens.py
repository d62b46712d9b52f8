import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracklume.llm import packing, token_files, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids_of(plain, text, end):
    return plain.encode(text or "", add_special_tokens=False).ids + [end]


def test_pieces_give_the_ids_of_whole_texts(plain):
    rng = random.Random(1)
    letters = "ab.,!?'s \n\t\r1é×² —日<AZ \x0b"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [None, "", " ", "a<|endoftext|>b", "don't  stop.\n\nIt, (ok)", "x" * 5000]
    ids, counts = tokens.Encoder(PATH, most=50).encode(pa.array(texts))  # forgets often
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, part in zip(texts, parts, strict=True):
        assert part.tolist() == ids_of(plain, text, 0)[:-1]


def test_files_round_trip(docs, rows, plain):
    files = token_files.write_token_files(docs, PATH, end_id=0, shards=7)
    found = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.doc_id)
    start = 0
    for (doc_id, text, *_), row in zip(sorted(rows, key=lambda r: r[0]), found, strict=True):
        want = np.asarray(ids_of(plain, text, 0), "<u4").tobytes()
        assert (row.doc_id, row.start, row.n_tokens, bytes(row.ids)) == (doc_id, start, len(want) // 4, want)
        start += row.n_tokens
    listed = files.manifest.orderBy("shard").collect()
    assert len(listed) > 1 and sum(r.n_docs for r in listed) == len(rows)
    one = next(ids for r in listed if (ids := token_files.document_ids(r.path, rows[0][0], files.dictionary)) is not None)
    assert one.tolist() == ids_of(plain, rows[0][1], 0)
    assert token_files.document_ids(listed[0].path, -5, files.dictionary) is None
    with pytest.raises(ValueError):
        token_files.document_ids(listed[0].path, 1, files.dictionary + b"x")


def test_files_of_null_and_repeated_ids(spark, empty, plain):
    rows = [(None, "no id"), (None, None), *[(4, "same")] * 30, (9, "last"), (1, "")]
    files = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, end_id=0, shards=5)
    found = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, None, 1, *[4] * 30, 9]
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    assert token_files.read_token_files(token_files.write_token_files(empty, PATH, end_id=0)).count() == 0


def test_packing_is_a_partition(docs, rows, plain):
    found = packing.packed(docs, PATH, end_id=1, window=256, piece=64, group_windows=8).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {r[0] for r in rows}
    for doc_id, text, *_ in rows:
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
        want = np.asarray(ids_of(plain, text, 1), "<u4").tobytes()
        assert b"".join(bytes(p.ids) for p in pieces) == want
        assert all(4 * p.length == len(p.ids) and p.doc_tokens == len(want) // 4 and want[4 * p.start :].startswith(bytes(p.ids)) for p in pieces)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
        assert sum(p.length for p in pieces) <= 256
    assert sum(r.length for r in found) / 256 / len(by_sequence) > 0.9


def test_packing_repeated_and_empty(spark, empty):
    rows = spark.createDataFrame([(3, "a b c")] * 50 + [(None, None)], "doc_id long, text string")
    assert packing.packed(rows, PATH, end_id=1).count() == 51
    assert packing.packed(empty, PATH, end_id=1).count() == 0


def test_differencing():
    # the textbook case: 8 7 6 5 4 differ by 2 after differencing
    sums = np.bincount(packing.differencing(np.asarray([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])
    assert sorted(sums) == [14, 16]
    rng = np.random.default_rng(3)
    for m in (1, 2, 3, 7, 20):
        sizes = rng.integers(1, 300, 150)
        window = packing.differencing(sizes, m)
        sums = np.bincount(window, weights=sizes, minlength=m)
        assert window.max() < m and sums.max() - sums.min() < 40
        assert np.bincount(packing.balanced(sizes, 300), weights=sizes).max() <= 300
    assert packing.differencing(np.asarray([5, 5, 5]), 10).tolist() != [0, 0, 0]


def test_crc_is_of_little_endian_words(spark):
    ids = np.asarray([1, 70000], "<u4").tobytes()
    row = spark.createDataFrame([(bytearray(ids),)], "ids binary").selectExpr("crc32(ids) c").first()
    assert row.c == zlib.crc32(ids)




def test_equal_hashes_are_not_taken_for_equal_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "span_hashes", lambda data, starts, values: np.asarray(data[starts] % 3, np.uint64))
    encode = tokens.Encoder(PATH)
    texts = ["one two three, four", "two\none", None, "", "six of one and three of four", "one two three, four"]
    for _ in range(2):  # with nothing kept, and with wrong pieces kept
        ids, counts = encode.encode(pa.array(texts))
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [encode.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_long_strings_of_two_letters_keep_their_ids():
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    encode = tokens.Encoder(PATH)
    ids, counts = encode.encode(pa.array(texts))
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
