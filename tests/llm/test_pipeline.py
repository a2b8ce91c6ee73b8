import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import mixing, token_output


def tables(spark, folder):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        words = [word() for _ in range(rng.randint(30, 120))]
        if i % 6 == 0:
            words = [w + "$$$" for w in words]
        if i % 50 == 7:
            words[5:5] = items[i % 5][1].split()
        docs.append((i, " ".join(words), "en", f"s{min(i % 10, 3)}", 1, "extra"))
        labels.append((i, int(i % 6 != 0), 0))
    docs += [(400 + k, docs[k * 6 + 1][1], "en", "s1", 1, "extra") for k in range(20)]
    docs += [(500, None, None, None, None, None), (501, "", "en", "s1", 0, "extra")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, payload string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {d[0]: d[1] for d in docs}


def test_stages_and_run(spark, tmp_path):
    sf = f"file://{tmp_path}/sf"
    texts = tables(spark, sf)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [set(texts)]
    for n, (_, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = step(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"{sf}/stage{n}")
        docs = spark.read.parquet(f"{sf}/stage{n}")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        kept.append(set(ids))
    good, single, clean, mixed = kept[1:]
    prose = {i for i in texts if i < 300 and i % 6}
    assert prose <= good and not {i for i in texts if i < 300 and i % 6 == 0} & good
    assert good - single == {400 + k for k in range(20)} | ({501} & good if 500 in good else set())
    assert single - clean == {i for i in single if i < 300 and i % 50 == 7}
    assert mixed == clean
    rows = sorted(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), key=lambda r: r.start)
    position = {r.doc_id: r["__mix_position"] for r in mixing.mix(spark.read.parquet(f"{sf}/stage2")).collect()}
    assert [r.doc_id for r in rows] == sorted(position, key=position.get)
    t, at = Tokenizer.from_file(token_output.tokenizer_path()), 0
    for r in rows:
        ids = [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    again = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r.start)
    assert again == rows


def test_empty_documents(spark, tmp_path):
    sf = f"file://{tmp_path}/sf"
    tables(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs_out = step(spark, docs, sf)
        assert docs_out.count() == 0
