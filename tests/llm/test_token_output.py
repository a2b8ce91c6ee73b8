import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from lodestone.llm import token_output as to


def rows():
    rng = random.Random(2)
    words = ["Hello", "wörld's", "it's", "a|b", "|", "<|endoftext|>", "12345", "ΑΣ", "ñandú!!", "x y", "q\x1cr", "étude", "!!!", "don't"]
    out = [(i * 2, " ".join(rng.choice(words) for _ in range(rng.randint(0, 400)))) for i in range(200)]
    out += [(None, "no id"), (7, None), (7, ""), (7, "b"), (7, "a"), (11, " \n"), (3, "one two " * 20000)]
    rng.shuffle(out)
    return out


def expected(data):
    t = Tokenizer.from_file(to.tokenizer_path())
    out, at = [], 0
    for i, text in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_round_trip_through_files(spark, tmp_path, monkeypatch):
    data = rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in data], "doc_id long, text string, shard int, payload string").repartition(3)
    path = f"file://{tmp_path}/tokens"
    to.write_tokens(docs, path, to.tokenizer_path())
    got = [tuple(r) for r in to.read_tokens(spark, path).collect()]
    key = lambda r: r[1]
    assert [tuple(r) for r in sorted(got, key=key)] == expected(data)
    digests = [tuple(r) for r in to.read_digests(spark, path).collect()]
    assert sorted(digests, key=key) == [r[:4] for r in expected(data)]


def test_empty_table(spark, tmp_path):
    to.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/t", to.tokenizer_path())
    assert to.read_digests(spark, f"file://{tmp_path}/t").count() == 0


def test_blocks_hold_any_ids():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1023, 1024, 1025, 5000):
        for ids in (rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 50000, n, dtype=np.uint32), np.full(n, 7, np.uint32), np.r_[np.zeros(max(0, n - 1), np.uint32), np.full(min(n, 1), 2**32 - 1, np.uint32)]):
            data = to.encode_segment([5, -(1 << 63)], [n, 0], ids)
            doc_ids, counts, back = to.decode_segment(data)
            assert doc_ids.tolist() == [5, -(1 << 63)] and counts.tolist() == [n, 0] and np.array_equal(back, ids)


def test_index_reaches_single_blocks_and_outliers_are_patched():
    ids = np.full(4096, 100, np.uint32)
    ids[::2] = 107
    ids[[5, 2000]] = 1 << 30
    data = to.encode_segment([1], [4096], ids)
    assert len(data) < 4096 * 3 // 8 + 200
    assert np.array_equal(to.decode_segment(data, 1, 2)[2], ids[1024:2048])


def test_encoder_forgets_and_stays_exact():
    t = Tokenizer.from_file(to.tokenizer_path())
    e = to.Encoder(to.tokenizer_path(), remembered=9000)
    for i in range(60):
        assert e.letters.size <= 9000
        text = " ".join(f"word{(i * j) % 97}x, common" for j in range(20))
        assert np.frombuffer(e(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_plainly(spark, tmp_path):
    from tokenizers import models, pre_tokenizers

    assert not to.Encoder(to.tokenizer_path()).plain
    other = Tokenizer(models.BPE({"a": 0, "b": 1, "B": 2, "Ġ": 3, "aĠ": 4}, [("a", "Ġ")]))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    other.save(f"{tmp_path}/other.json")
    assert to.Encoder(f"{tmp_path}/other.json").plain
    docs = spark.createDataFrame([(2, "a b"), (1, "B a a")], "doc_id long, text string")
    to.write_tokens(docs, f"file://{tmp_path}/o", f"{tmp_path}/other.json")
    got = {r.doc_id: r.ids for r in to.read_tokens(spark, f"file://{tmp_path}/o").collect()}
    assert got == {1: [2, 3, 4, 0, 2], 2: [4, 1, 2]}
