"""Packing by blocks against one loop over the order."""

import random

from contrail.operators import packing


def loop(rows, budget):
    """Packs of texts (order, tokens) by the definition."""
    out, number, fill = [], -1, None
    for order, n in sorted(rows):
        n = n or 0
        for piece, size in enumerate([budget] * (n // budget) + ([n % budget] if n % budget or n == 0 else [])):
            if fill is None or fill + size > budget:
                number, fill = number + 1, 0
            out.append((order, piece, size, number, fill))
            fill += size
    return out


def packed(spark, rows, budget):
    df = spark.createDataFrame(rows, "id long, tokens int")
    return sorted(tuple(r) for r in packing.pack(df, "id", "tokens", budget).collect())


def test_pieces_tables_and_groups(spark, monkeypatch):
    random.seed(31)
    rows = [(i * 7, random.choice([0, 1, 3, 40, 99, 100, 101, 250, None, random.randint(0, 120)])) for i in range(700)]
    random.shuffle(rows)
    for span, group in ((64, 1024), (1, 3)):  # many small blocks and groups
        monkeypatch.setattr(packing, "SPAN", span)
        monkeypatch.setattr(packing, "GROUP", group)
        assert packed(spark, rows, 100) == loop(rows, 100)


def test_odd_tables(spark):
    assert packed(spark, [], 10) == []
    for rows in ([(1, None), (2, 0)], [(5, 10), (6, 10), (7, 1)], [(1, 95)], [(1, 0), (2, 11)]):
        assert packed(spark, rows, 10) == loop(rows, 10)


def test_stretches_without_a_begin():
    """A stretch whose pieces all fit into the open pack opens none; joined tables follow it to the next one."""
    import numpy as np

    random.seed(32)
    for _ in range(200):
        sizes = [random.randint(0, 6) for _ in range(40)]
        start = np.cumsum([0, *sizes])[:-1]
        end = start + sizes
        cuts = sorted({0, 40, *[random.randint(0, 40) for _ in range(6)]})
        tables = [(int(start[a]), *packing.table_of(start[a:b], end[a:b], 10)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        state = other = (None, 0)
        for _, *t in tables:
            state = packing.after(state, *t, 10)
        other = packing.after(other, *packing.joined(tables, 10), 10)
        want = loop(list(enumerate(sizes)), 10)
        assert state == other == (int(start[[w[3] for w in want].index(want[-1][3])]), want[-1][3] + 1)
