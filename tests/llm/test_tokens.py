import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidelog.llm import byte_bpe, token_files

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["word", " ", "  ", "\n", " \n ", "\t", "don't", "'re", "'", "Été", "ß", "中文", "🙂", "123", ",", "...", " ", "　", "<|endoftext|>", "\x1c", "é" * 20, "a" * 40]


@pytest.fixture(scope="module")
def texts():
    draw = np.random.default_rng(11)
    made = ["".join(draw.choice(PIECES, n)) for n in draw.integers(0, 200, 150)]
    return [*made, "", " ", "\n ", " a", "a ", "a  b", "a \n b", "\n \nb", "x\n", "one two three.\nFour five", " " * 700, "a" * 1500]


def test_word_encoder_equals_the_library(texts, monkeypatch):
    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    own = token_files.WordEncoder(JSON)
    assert [ids.tolist() for ids in own.encode(texts)] == want
    monkeypatch.setattr(token_files, "WORDS_KEPT", 10)
    assert [ids.tolist() for t in texts for ids in own.encode([t])] == want
    small = token_files.WordEncoder(JSON)
    for _ in range(2):
        assert [ids.tolist() for t in texts for ids in small.encode([t])] == want
    assert len(small.known) < 0.2 * len(own.known)


def test_special_tokens_are_text():
    ids = token_files.WordEncoder(JSON).encode(["a<|endoftext|>b", "<|endoftext|>"])
    assert all(50256 not in own and len(own) > 5 for own in ids)


def test_given_texts_equal_the_library():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    own = token_files.WordEncoder(JSON)
    for start in range(0, len(texts), 100):
        some = texts[start : start + 100]
        assert [ids.tolist() for ids in own.encode(some)] == [e.ids for e in own.tokenizer.encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    planes = token_files.to_planes(ids, kind)
    assert len(planes) == {"byte": 4, "bit": 32}[kind]
    assert (token_files.from_planes(planes, n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_round_trip(spark, texts, tmp_path, kind):
    rows = [*((i * 3, t) for i, t in enumerate(texts)), (None, "no id"), (None, None), (3, "a repeated id"), (6, texts[2])]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, start int").repartition(5)
    manifest = token_files.write_token_files(df, str(tmp_path / "files"), JSON, kind=kind, block_ids=64, file_ids=256)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(manifest).collect())
    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    want, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((at, doc_id, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    path = manifest.first()["path"]
    reader = token_files.Reader(path)
    assert len(reader.block(0)) == reader.index["blocks"][0][1]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.token_round_trip(spark, empty, JSON).count() == 0
    assert byte_bpe.token_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_a_damaged_file_is_refused(tmp_path):
    path = tmp_path / "x.tok"
    path.write_bytes(b"something else entirely")
    with pytest.raises(ValueError, match="not a token file"):
        token_files.Reader(str(path))


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 9), (50, 12), (23, 5)])
def test_chunks_equal_the_library(spark, texts, chunk, overlap):
    codec = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    rows = [*enumerate(texts), (None, texts[0]), (None, None), (3, texts[3])]
    df = spark.createDataFrame([(d, t, b"x") for d, t in rows], "doc_id long, text string, ids binary")
    encoded = byte_bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN, chunk, overlap)
    got = byte_bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()
    want = sorted((str(d), codec.encode(t or ""), (t or "").encode()) for d, t in rows)
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert isinstance(codec.encoding, tiktoken.Encoding)
