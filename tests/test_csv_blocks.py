import json
import random

import pytest

from lodestone.sources import csv_blocks
from lodestone.sources.text_validation import check_csv, csv_problems, spans_lines

PIECES = [b"a", b"b", b",", b",", b'"', b'"', b'""', b"\n", b"\n", b"\r\n", b"\r", b" ", b"\xc3\xa9", b"x,y\n", b'"q\nr",1\n', b'1,"2"\n']


def contents(rng, n):
    fixed = [b"", b"\n", b"\r\n", b"a", b"a,b\n", b"a,b\n\n1,2\n", b'a,b\n"x\ny",2\n', b'a,b\n"1,2\n', b'"a\nb",c\n1,2', b"a,b\r1,2\r3,4", b"a,b\r\n1,2\r\n\r\n", b'a,b\n1,"2"x\n1\n', b"\xef\xbb\xbfa,b\n1,2\n", b"\xff,b\n", b"a,\0\n", b'a,b\n1,x"y"\n', b'a\n""\n', b'a,b\n,""\n"",\n', b",\n1,2\n", b'a,b\n"' + b"long\n" * 50 + b'",2\n3,4\n']
    out = list(fixed)
    for _ in range(n):
        head = rng.choice([b"a,b\n", b"a,b\r\n", b"", b'"h\n1",k\n'])
        body = b"".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) if rng.random() < 0.5 else b"".join(rng.choice([b"1,2\n", b'"1\n,""\n",2\n', b"3,4\n", b'5,"6"\r\n']) for _ in range(rng.randint(0, 9)))
        out.append(head + body)
    return out


def expected(content):
    header, problems = check_csv(content)
    return header, sorted(problems), not problems and spans_lines(content)


@pytest.mark.parametrize(("size", "n"), [("9b", 30), ("60b", 120), ("1m", 250)])
def test_as_the_standard_parser_on_random_bytes(spark, tmp_path, size, n):
    rng = random.Random(5)
    for i, c in enumerate(contents(rng, n)):
        (tmp_path / f"f{i:04d}.csv").write_bytes(c)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = csv_problems(spark, str(tmp_path)).collect()
        parts = csv_blocks.blocks(spark, str(tmp_path / "f0019.csv")).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert parts > 2 or size == "1m"
    got = {}
    for r in rows:
        h, p, s = got.setdefault(r.file.rsplit("/", 1)[1], (json.loads(r.header), [], r.spans))
        p += [r.problem] * (r.problem is not None)
    for i, c in enumerate(contents(random.Random(5), n)):
        h, p, s = got[f"f{i:04d}.csv"]
        assert (h, sorted(p), s) == expected(c), c


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "big.csv"
    with open(path, "wb") as f:
        f.write(b"id,text\n")
        for i in range(40_000):
            f.write(b'%d,"line\none, ""%d"""\n' % (i, i) if i % 3 else b"%d,plain\n" % i)
        f.write(b'7,"never closed\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        assert csv_blocks.blocks(spark, str(path)).rdd.getNumPartitions() > 8
        assert [(r.problem, r.header) for r in csv_problems(spark, str(path)).collect()] == [(csv_blocks.OPEN_END, '["id", "text"]')]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
