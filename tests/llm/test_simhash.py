import numpy as np
import pytest

from marginwise.llm import components, simhash


def brute(values, radius):
    values = np.asarray(values, dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)
    return simhash.roots_of(a, b, len(values))


def naive_fingerprint(text, k=4):
    import xxhash

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "one", "One two three", "a b c d", "É b C d e f a b c d e f", "x " * 40])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == naive_fingerprint(text)


@pytest.mark.parametrize("tile_rows", [8, 4096])
def test_links_are_complete(spark, tile_rows):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [seeds[k % 60] ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(64, k % 6, False)) for k in range(600)]
    crowd = [np.uint64(5) ^ (np.uint64(1) << np.uint64(b)) for b in range(40)]
    values = np.unique(np.array([*flips, *crowd, 0], dtype=np.uint64))
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint bigint")
    found = components.components(simhash.links(frame, 4, tile_rows)).collect()
    root = {r["id"]: r["component"] for r in found}
    want = brute(values, 4)
    signed = values.view(np.int64)
    groups = {}
    for v, r in zip(signed, want):
        groups.setdefault(r, set()).add(int(v))
    for group in groups.values():
        assert {root.get(v, v) for v in group} == {min(group)}


def test_tile_of_many_rows():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 2**12, 1500, dtype=np.uint64) * np.uint64(4097))
    a, b = simhash.tile_forest(values, 2)
    at = {int(v): i for i, v in enumerate(values)}
    ours = simhash.roots_of(np.array([at[int(x)] for x in a]), np.array([at[int(x)] for x in b]), len(values))
    assert (ours == brute(values, 2)).all()


def test_odd_documents(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 10
    empty = [r for r in rows if r["fingerprint"] == 0]
    assert {r["id"] for r in empty} == {2, 3, 4} and {r["component_id"] for r in empty} == {2}
    assert [r["component_id"] for r in rows if r["id"] is None] == [None]
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 40)]
    rows = components.components(spark.createDataFrame([*path, *star, (7, 7), (None, 3)], "a bigint, b bigint")).collect()
    found = {r["id"]: r["component"] for r in rows}
    assert len(rows) == len(found) == 61 + 39
    assert all(found[i] == 100 for i in range(100, 161)) and all(found[i] == 1 for i in range(1, 40))
