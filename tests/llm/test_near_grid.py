"""The pipeline's near copies take candidates from operator 6's grid: what it connects are the nodes within three bits."""

import random

from roadspeed.llm import near


def test_grid_connects_all_within_three_bits(spark):
    r = random.Random(8)
    fps = [r.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in r.sample(range(64), k)) for f in fps for k in (0, 1, 3, 4, 9)]
    rows = [(bytes([i // 256, i % 256]), f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def parts():
        return [root(i) for i in range(len(fps))]

    def join(i, j):
        a, b = sorted((root(i), root(j)))
        parent[b] = a

    at = {node: i for i, (node, _) in enumerate(rows)}
    for x, y in near.grid_pairs(spark.createDataFrame([(bytearray(n), f) for n, f in rows], "node binary, fp long"), cell=16).collect():
        join(at[bytes(x)], at[bytes(y)])
    found, parent = parts(), list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                join(i, j)
    assert found == parts()
