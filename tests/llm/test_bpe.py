import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from pitpanel.llm import byte_bpe, token_files, tokens


def test_paths_of_object_stores_open():
    import pyarrow.fs as pafs

    if hasattr(pafs, "S3FileSystem"):
        for scheme in ("s3", "s3a", "s3n"):
            fs, name = token_files._open(f"{scheme}://bucket/folder/x.arrow")
            assert isinstance(fs, pafs.S3FileSystem) and name == "bucket/folder/x.arrow"
    assert token_files._open("/tmp/x")[1] == token_files._open("file:///tmp/x")[1] == token_files._open("file:/tmp/x")[1] == "/tmp/x"

ODD = [
    (1, "plain words, and don't they'll 've  two   spaces \n\n\t end  "),
    (2, None),
    (3, ""),
    (4, "naïve façade ñandú ÉÈ über 12345 x2² ½ ௧௨ 　 漢字 <|endoftext|> 🙂🙂\x1c\x1d\x85\xa0 á"),
    (5, "ab " * 700 + "'" + "l" * 300 + " " * 200 + "tail"),
    (6, "z" * 2500),
    (7, "it's " + "é" * 90 + "\n" * 70 + "1" * 80),
    (8, "ab " * 700 + "'" + "l" * 300 + " " * 200 + "tail"),
    (None, "no id"),
    (1, "plain words, and don't they'll 've  two   spaces \n\n\t end  "),
]


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (97, 40), (32_768, 1_024)])
def test_chunks_give_the_ids_of_the_whole_text(spark, enc, chunk, overlap):
    docs = spark.createDataFrame([(i, t, "x", b"y") for i, t in ODD], "doc_id long, text string, __text string, ids binary")
    out = byte_bpe.decode(byte_bpe.encode(docs, chunk_chars=chunk, overlap=overlap)).collect()
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out))
    want = []
    for i, t in ODD:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((-1 if i is None else i, len(ids), ids.tobytes(), (t or "").encode()))
    assert got == sorted(want)


def test_chunks_that_end_right_behind_white_space(spark, enc):
    runs = [" \xa0", "\n \u2003", "\n\n", "\t\u3000", "  ", "\r\n"]
    texts = ["a" * n + run + "x" + "b" * 9 + " c" * 40 for run in runs for n in range(20, 40)] + ["a" * 30 + " \xa0" * 60 + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in byte_bpe.encode(docs, chunk_chars=32, overlap=12).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_encode_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(docs).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(docs, chunk_chars=5, overlap=9)


def test_word_encoder_equals_the_library():
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    mine = tokens.WordEncoder(path)
    for text in [x or "" for _, x in ODD] + ["“quoted” — dash…  €5", "ẞ̀ x", "a_b__c 1_000", "hello <|endoftext|> x", "<|endoftext|><|endoftext|>", "<|endoftext", "tab\tand\r\nlines \x0b"]:
        assert np.frombuffer(mine.encode(text), mine.dtype).tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("length", "rows"), [(16, 3), (2048, 64)])
def test_files_read_back(spark, tmp_path, length, rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in ODD], "doc_id long, text string, place int").repartition(3)
    index = token_files.write(docs, str(tmp_path), length=length, batch_rows=rows).persist()
    got = {}
    for r in token_files.read(index).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, bytes(r.ids)))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start = 0
    for i, text in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (start, len(ids), ids.tobytes()) in got[i]
        start += len(ids)
    paths = {r.path for r in index.select("path").collect()}
    filled = 0
    for p in paths:
        f = token_files.TokenFile(p)
        n = sum(f.file.get_batch(b).num_rows for b in range(f.file.num_record_batches))
        for i in range(n):
            ids, mask = f.sequence(i)
            assert len(ids) == len(mask) == length and (ids[~mask] == 0).all()
            assert not np.diff(mask.astype(int)).clip(min=0).any()
            filled += mask.sum()
    assert filled == start


def test_op9_and_op2_on_the_small_tables(spark, enc):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in byte_bpe.op9(spark, d).collect():
        ids = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in token_files.op2(spark, d).collect()}
    start = 0
    assert rows.keys() == texts.keys()
    for i in sorted(texts):
        ids = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
