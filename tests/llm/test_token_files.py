import numpy as np
import pytest
from tokenizers import Tokenizer

from tideline.llm import token_files as K
from tideline.llm import tokens
from tideline.session import shared_folder

ROWS = [(3, "Some text here.\nMore of it."), (1, None), (2, ""), (None, "null id"), (4, "word " * 9000), (4, "word " * 9000), (5, "<|endoftext|> Ünïcode 12345   x")] + [(100 + i, f"document number {i} " * (i % 40)) for i in range(300)]
SMALL = K.FileSettings(length=64, shards=8, least=4, most=64, key=7)


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("size", [1, 2, 3, 10, 1000, 4097])
def test_permutation(size):
    f = K.Feistel(size, 99)
    out = f.forward(np.arange(size))
    assert sorted(out) == list(range(size)) and (f.inverse(out) == np.arange(size)).all()
    if size == 4097:
        assert (K.Feistel(size, 98).forward(np.arange(size)) != out).mean() > 0.99 and abs(np.corrcoef(out, np.arange(size))[0, 1]) < 0.1


def test_ids_equal_the_other_library(plain):
    for _, text in ROWS:
        assert tokens.document_ids(text, tokens.vocabulary_path()).tolist() == plain(text)
    for text in ["a  b", " lead", "tail  ", "x\n\n y", "don't we'll I'M", "1234 五六 ½", "\t\t", "a b", "!!??", "é" * 50]:
        assert tokens.document_ids(text, tokens.vocabulary_path()).tolist() == plain(text)


def test_round_trip_and_resume(spark, plain):
    path = shared_folder(spark, "files")
    docs = spark.createDataFrame([(i, t, "s") for i, t in ROWS], "doc_id long, text string, slot string").repartition(5)
    pieces = K.write(docs, path, SMALL).toPandas()
    reader = K.Reader(spark, path)
    records = list(reader.read())
    assert sorted(pieces["slot"].unique()) == list(range(reader.total)) and len(records) == reader.total
    for start in (0, 1, reader.total // 2, reader.total - 1, reader.total):
        assert all((a == b).all() for a, b in zip(reader.read(start), records[start:], strict=True))
    used = np.zeros(reader.total, dtype=int)
    found = {}
    for r in pieces.itertuples():
        ids = records[r.slot][r.offset : r.offset + r.length]
        assert tokens.crc32(ids) == r.ids_crc32
        used[r.slot] += r.length
        found.setdefault(r.doc_id if r.doc_id == r.doc_id else None, []).append((r.start, ids.tolist()))
    for slot, n in enumerate(used):
        assert (records[slot][n:] == SMALL.pad).all() and (records[slot][:n] != SMALL.pad).all()
    for doc, text in ROWS:
        want, parts = plain(text), sorted(found[doc])
        whole = {}
        for start, ids in parts:
            whole.update(enumerate(ids, start))
        assert [whole[k] for k in range(len(want))] == want
    assert pieces["length"].sum() == sum(len(plain(t)) for _, t in ROWS)


def test_same_key_same_files(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    a, b = shared_folder(spark, "a"), shared_folder(spark, "b")
    K.write(docs, a, SMALL)
    K.write(docs, b, SMALL)
    assert all((x == y).all() for x, y in zip(K.Reader(spark, a).read(), K.Reader(spark, b).read(), strict=True))


def test_empty(spark):
    path = shared_folder(spark, "none")
    assert K.write(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    assert K.Reader(spark, path).total == 0 and list(K.Reader(spark, path).read()) == []
