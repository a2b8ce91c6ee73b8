from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import mixing


def ideal(blocks, weights):
    """What the ideal mixture has given each source after each slot, by walking from one used-up source to the next."""
    exact, done, out = [Fraction(w) for w in weights], [Fraction(0)] * len(blocks), []
    for _ in range(sum(blocks)):
        left = Fraction(1)
        while left:
            rates = [w if d < n else 0 for w, d, n in zip(exact, done, blocks, strict=True)]
            step = min([left, *[(n - d) * sum(rates) / r for r, d, n in zip(rates, done, blocks, strict=True) if r]])
            done = [d + step * r / sum(rates) for d, r in zip(done, rates, strict=True)]
            left -= step
        out.append(list(done))
    return out


CASES = [
    ([40, 7, 3], [5.0, 3.0, 2.0]), ([100, 1, 1], [1.0, 1.0, 1.0]), ([30, 50, 20], [0.1, 0.7, 0.2]), ([9, 9, 9, 9, 160], [1, 1, 1, 1, 0.3]),
    ([60, 60, 60], [1 / 3, 1 / 3, 1 / 3]), ([50, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1], [0.5, *[0.05] * 10]),
]


@pytest.mark.parametrize("blocks,weights", CASES)
def test_deviation_from_the_ideal_is_less_than_one_block(blocks, weights):
    slots = mixing.schedule(blocks, weights)
    assert sorted(t for own in slots for t in own) == list(range(sum(blocks)))
    done, of = [0] * len(blocks), {t: i for i, own in enumerate(slots) for t in own}
    for t, share in enumerate(ideal(blocks, weights)):
        done[of[t]] += 1
        assert all(abs(s - n) < 1 for s, n in zip(share, done, strict=True))


@pytest.mark.parametrize("blocks,weights", CASES)
def test_windows_and_choice_are_those_of_the_definition(blocks, weights):
    before, times = [Fraction(0)] * len(blocks), [[[None, None] for _ in range(n)] for n in blocks]
    for t, share in enumerate(ideal(blocks, weights)):
        for i, (a, b) in enumerate(zip(before, share, strict=True)):
            for j in range(blocks[i]):
                if a <= j < b:
                    times[i][j][0] = t  # it begins in this slot
                if a < j + 1 <= b:
                    times[i][j][1] = t + 1
        before = share
    assert mixing.windows(blocks, weights) == [[tuple(x) for x in own] for own in times]
    slots, left = mixing.schedule(blocks, weights), [0] * len(blocks)
    for t in range(sum(blocks)):
        i = min((times[i][j][1], i) for i, j in enumerate(left) if j < blocks[i] and times[i][j][0] <= t)[1]
        assert slots[i][left[i]] == t
        left[i] += 1


def test_deviation_over_many_slots_and_unequal_sources():
    """The default weights of sources of 10^9, 10^7, 10^5 and 10^3 documents over 100,000 slots, against the given weights."""
    weights = [n**0.5 for n in (10**9, 10**7, 10**5, 10**3)]
    share = [w / sum(weights) for w in weights]
    blocks = [int(100_000 * w) + 5 for w in share]
    slots = mixing.schedule(blocks, weights)
    of = np.empty(sum(blocks), int)
    for i, own in enumerate(slots):
        of[own] = i
    t = np.arange(1, 100_001)
    for i, w in enumerate(share):
        assert np.abs(np.cumsum(of[:100_000] == i) - w * t).max() < 1


def brute_order(blocks, first, second):
    slots = mixing.plan(blocks, first, second)
    return [(i, j) for _, i, j in sorted((t, i, j) for i, own in enumerate(slots) for j, t in enumerate(own))]


def test_sources_without_weight_come_last():
    order = brute_order([9, 4, 30, 2], [0.0, 1.0, 2.0, 0.0], [1.0] * 4)
    assert {i for i, _ in order[:34]} == {1, 2} and {i for i, _ in order[34:]} == {0, 3}


def test_every_document_is_placed_once(spark):
    rows = [(i, "big" if i % 3 else ("b" if i % 2 else None), i) for i in range(3000)] + [(None, "c", 1), (7, "b", 7), (7, "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, rn int").repartition(5)
    got = mixing.mix(docs, block_docs=4, weights={"big": 1.0, "b": 1.0}).collect()
    assert len(got) == len(rows) and len({r["__mix_position"] for r in got}) == len(rows)
    counts = {}
    for r in rows:
        counts[r[1]] = counts.get(r[1], 0) + 1
    names = sorted(counts, key=lambda s: (s is not None, s or ""))
    order = brute_order([-(-counts[s] // 4) for s in names], [1.0 if s in ("big", "b") else 0.0 for s in names], [counts[s] ** 0.5 for s in names])
    slot = {(r["source"], r["__mix_block"]): r["__mix_slot"] for r in got}
    assert slot == {(names[i], k): t for t, (i, k) in enumerate(order)}
    again = mixing.mix(docs.repartition(2), block_docs=4, weights={"big": 1.0, "b": 1.0}).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_order_of_rows_and_limits(spark, monkeypatch):
    docs = spark.createDataFrame([(i, str(i % 5)) for i in range(200)], "doc_id long, source string")
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 7)
    position = {r.doc_id: r["__mix_position"] for r in mixing.mix(docs).collect()}
    mixed = mixing.in_mixed_order(docs)
    assert mixed.columns == docs.columns
    assert [r.doc_id for r in mixed.collect()] == sorted(position, key=position.get)
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="reserved"):
        mixing.mix(docs.withColumn("__mix_x", docs.doc_id))


def test_any_number_of_sources(spark, monkeypatch):
    rows = [(i, "big" if i < 400 else "mid" if i < 500 else f"s{i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    one_by_one = {r.doc_id: r["__mix_position"] for r in mixing.mix(docs).collect()}
    assert len(set(one_by_one.values())) == 900
    monkeypatch.setattr(mixing, "SOURCES", 300)
    monkeypatch.setattr(mixing, "MAX_BUCKETS", 2)
    got = mixing.mix(docs, weights={"big": 2.0, "mid": 1.0, **{f"s{i}": 0.01 for i in range(500, 900)}}).collect()
    assert len({r["__mix_position"] for r in got}) == 900
    done, want = {"big": 0, "mid": 0, "s": 0}, {"big": 2.0, "mid": 1.0, "s": 4.0}
    slots = sorted({(r["__mix_slot"], "s" if r.source[0] == "s" else r.source) for r in got})
    for t, s in slots[:14]:  # until the first is used up
        done[s] += 1
        assert all(abs(n - (t + 1) * want[x] / 7) < 1 for x, n in done.items())


def test_blocks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 20)
    docs = spark.createDataFrame([(i, str(i % 3)) for i in range(1000)], "doc_id long, source string")
    got = mixing.mix(docs).collect()
    assert len({(r.source, r["__mix_block"]) for r in got}) <= 23
    assert len({r["__mix_position"] for r in got}) == 1000


def test_result_does_not_depend_on_the_size_of_buckets_or_pieces(spark, monkeypatch):
    """The numbering is plain hash order and the plan is the same, however it is cut."""
    docs = spark.createDataFrame([(i, "big" if i % 4 else f"s{i % 3}") for i in range(900)], "doc_id long, source string")
    whole = {r.doc_id: (r["__mix_block"], r["__mix_slot"], r["__mix_position"]) for r in mixing.mix(docs, block_docs=2).collect()}
    for name, value in {"BUCKET_DOCS": 7, "RUN": 8, "PLAN_BLOCKS": 40, "BROADCAST_BLOCKS": 0}.items():
        monkeypatch.setattr(mixing, name, value)
    again = {r.doc_id: (r["__mix_block"], r["__mix_slot"], r["__mix_position"]) for r in mixing.mix(docs, block_docs=2).collect()}
    assert whole == again


def test_blocks_keep_their_size_in_large_tables(spark):
    """4,200,000 documents: more than 2 ** 18 blocks of 16."""
    docs = spark.range(4_200_000).selectExpr("id AS doc_id", "CAST(id % 3 AS string) AS source")
    got = mixing.mix(docs)
    most, least, blocks, places = got.groupBy("source", "__mix_block").count().selectExpr("max(count)", "min(count)", "count(*)", "sum(count)").first()
    assert (most, least, blocks, places) == (16, 16, 262_500, 4_200_000)


def test_many_sources_are_scheduled_one_by_one(spark):
    """10,001 sources of one document and a large one: each keeps blocks of its own."""
    docs = spark.range(10_501).selectExpr("id AS doc_id", "IF(id < 500, 'big', CAST(id AS string)) AS source")
    got = mixing.mix(docs).where("source <> 'big'")
    assert got.selectExpr("count(DISTINCT __mix_slot)", "max(__mix_block)").first()[:] == (10_001, 0)
