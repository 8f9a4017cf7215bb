"""A signature that many texts share is compared block against block."""

from itertools import combinations

from kalmia.llm import spotsigs


def test_hot_signature_in_blocks(monkeypatch, spark):
    monkeypatch.setattr(spotsigs, "BLOCK", 8)
    dealt = []
    made = spotsigs.materialize
    monkeypatch.setattr(spotsigs, "materialize", lambda rows: dealt.append(made(rows)) or dealt[-1])
    sets = {i: [1, 2, 3, 4, 100 + i] if i % 2 else [1, 2, 3, 4, 100 + i, 200 + i // 4] for i in range(60)}
    prints = spark.createDataFrame(list(sets.items()), "id long, hashes array<bigint>")
    want = {}
    for a, b in combinations(sets, 2):
        x, y = set(sets[a]), set(sets[b])
        if (near := len(x & y) / len(x | y)) >= 0.5:
            want[a, b] = near
    got = spotsigs.near_duplicates(prints, 0.5).collect()
    assert len(got) == len(want) and all(abs(want[r["a"], r["b"]] - r["likeness"]) < 1e-9 for r in got)
    assert [r["blocks"] for d in dealt if "blocks" in d.columns for r in d.collect()]
