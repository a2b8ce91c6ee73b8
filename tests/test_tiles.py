"""Units of work: how many tasks make the pairs, and how often a row travels."""

import pytest

from lodestone.operators.blocking import LARGEST_UNIT, Work


@pytest.mark.parametrize("parallelism", [8, 12])
def test_large_tables_are_dealt_in_few_large_tiles(parallelism):
    n, m, blocks = 216_000, 14_400, 25  # two tables by nation, 360 times sf0.1
    work = Work(n * m * blocks, n * m)
    side = work.unit(parallelism) ** 0.5
    sent = blocks * (n * -(-m // side) + m * -(-n // side))
    assert sent < 6 * blocks * (n + m) and work.unit(parallelism) <= LARGEST_UNIT


@pytest.mark.parametrize("pairs", [10**6, 36 * 10**7, 10**10, 10**13])
def test_every_core_has_many_units_and_tasks(pairs):
    work = Work(pairs, pairs)
    tasks = work.tasks(8)
    assert tasks * work.unit(8) <= pairs and tasks >= min(8 * 16, pairs // 5_000_000) and tasks <= max(8 * 16, pairs // 40_000_000 + 1)
