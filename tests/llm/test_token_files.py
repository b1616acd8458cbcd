"""Token files: an exact round trip, and files that are not what they should be."""

import io
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from claimgauge.llm import token_files as tf
from claimgauge.llm.shared_files import train_dictionary

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip_in_id_order(spark, tmp_path, monkeypatch):
    rng = random.Random(10)
    texts = [(i, " ".join("w%d" % rng.randrange(500) for _ in range(rng.choice([1, 20, 400])))) for i in range(200)]
    texts += [(500, None), (501, ""), (502, "x " * 40000), (503, "é\n\nü"), (None, "no id"), (7, "again")]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, n_tokens string").repartition(4)
    folder = f"file://{tmp_path}/tokens"
    files = tf.write_token_files(docs, PATH, folder)
    got = sorted(tf.read_token_files(files, folder).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(PATH)
    arrays = {}
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        arrays.setdefault(doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == sorted(-1 if i is None else i for i, _ in texts)
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in arrays[r.doc_id]
        at += r.n_tokens
    first = files.orderBy("part", "shard").first()
    name = first.path.removeprefix("file://")
    dictionary = (tmp_path / "tokens" / "dictionary").read_bytes()
    whole = tf.TokenFile(open(name, "rb").read(), dictionary)
    for i in (0, len(whole) // 2, len(whole) - 1):
        assert (tf.read_document(first.path, os.path.getsize(name), i, dictionary) == whole.ids(i)).all()


def test_special_tokens_in_texts_are_their_own_ids(spark, tmp_path):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "in<|endoftext|>side", "end.<|endoftext|>, (<|endoftext|>)"]
    folder = f"file://{tmp_path}/special"
    files = tf.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, folder)
    tokenizer = Tokenizer.from_file(PATH)
    for r in tf.read_token_files(files, folder).collect():
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def small_file(dictionary=b""):
    out = io.BytesIO()
    writer = tf.TokenFileWriter(out, 2, dictionary)
    for i, n in enumerate((3, 0, 1000)):
        writer.add(i, np.arange(n, dtype="<u2").tobytes(), n)
    writer.close()
    return out.getvalue()


def test_damaged_files_are_refused():
    data = small_file()
    assert [len(tf.TokenFile(data, b"").ids(i)) for i in range(3)] == [3, 0, 1000]
    for bad in (b"x" + data[1:], data[:-1] + b"x", data[:60] + data[61:]):
        with pytest.raises(Exception):
            tf.TokenFile(bad, b"")
    with pytest.raises(ValueError, match="dictionary"):
        tf.TokenFile(data, b"another")


def test_dictionary_of_few_and_many_samples():
    assert train_dictionary([], 100) == b""
    assert train_dictionary([b"abc", b""], 100) == b"abc"
    rng = random.Random(11)
    samples = [bytes(rng.choice(b"abcdefgh") for _ in range(300)) + b"common tail of all" for _ in range(200)]
    trained = train_dictionary(samples, 2000)
    assert len(trained) <= 2000 and len(small_file(trained)) > 0


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = f"file://{tmp_path}/none"
    assert tf.read_token_files(tf.write_token_files(docs, PATH, folder), folder).count() == 0
