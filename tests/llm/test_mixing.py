"""op6: targets against a plain loop, exact quotas of the tree, disjoint blocks, whole mixes."""

from collections import Counter

import numpy as np
import pytest
from helpers import documents, prose, words

from slidegrid.llm import mixing as M


def plain_targets(sizes, weights=M.WEIGHTS, share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, live = {}, share * sum(sizes.values()), set(names)
    while live:
        w = sum(weight[s] for s in live)
        over = {s for s in live if left * weight[s] / w > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in live}
            break
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        live -= over
    return target


def check(rows, docs):
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs)
    source = {r["doc_id"]: r["source"] for r in docs}
    size = {r["doc_id"]: len(words(r["text"])) for r in docs}
    sums, taken = Counter(), Counter()
    for r in docs:
        sums[r["source"]] += size[r["doc_id"]]
    want = plain_targets(dict(sums))
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and len(r["shards"]) == r["copies"]
        taken[s] += r["taken"]
    for s in sums:
        assert abs(taken[s] - want[s]) <= max(size[r["doc_id"]] for r in docs if r["source"] == s) / 2 + 1e-6


def test_targets_and_mix(spark):
    for docs in (documents(spark), documents(spark, [(i, prose("en", i, 10 + i % 90), "en", "ab"[i % 11 == 0] if i % 7 else None) for i in range(300)])):
        rows = M.mix_sizes(docs).collect()
        check(rows, docs.collect())
        assert sorted(map(str, rows)) == sorted(map(str, M.mix_sizes(docs.repartition(5)).collect()))
    assert M.mix_sizes(documents(spark, [])).count() == 0
    assert M.mix_sizes(documents(spark, [(1, None, None, None)])).first()["taken"] == 0


def test_tree_splits_exactly():
    quotas = np.array([17, 0, 301, 5])
    leaves = list(M.shard_quotas(quotas, 7, 0, 7, 3))
    assert [s for s, _, _ in leaves] == list(range(7))
    assert (sum(own for _, _, own in leaves) == quotas).all()
    assert [int(own.sum()) for _, _, own in leaves] == [323 * (i + 1) // 7 - 323 * i // 7 for i in range(7)]
    before = np.zeros(4, dtype=int)
    for (_, at, own), alone in zip(leaves, [next(M.shard_quotas(quotas, 7, i, i + 1, 3)) for i in range(7)], strict=True):
        assert (at == before).all() and (alone[2] == own).all()  # a leaf needs no other leaf
        before = before + own


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(M.permuted(np.arange(n), n, 9).tolist()) == list(range(n))


def test_whole_mix(spark):
    docs = documents(spark)
    plain = M.mix_sizes(docs).collect()
    mixed = M.mix(docs, with_place=True)
    rows = mixed.collect()
    want = Counter()
    for r in plain:
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in rows) == Counter({k: n for k, n in want.items() if n})
    places = {}
    for r in rows:
        places.setdefault(r["shard"], []).append(r["place_in_shard"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert M.mix(docs, with_place=False).columns == docs.columns


def plain_plan(rows, targets, width, shard_blocks, seed, most=2):
    """row -> shards of its copies, by loops: blocks of the seeded order, drawn in permuted order, dealt by the tree."""
    sources = sorted(targets, key=lambda s: [ord(c) for c in s])
    held, drawn = [], []
    for number, source in enumerate(sources):
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: (r["place"], r["row"]))
        total, start, blocks = sum(r["size"] for r in own), 0, {}
        n = max(1, -(-total // width))
        for r in own:
            if r["size"]:
                blocks.setdefault(min(start // width, n - 1), []).append(r)
            start += r["size"]
        left, order = targets[source], []
        for k in range(most):
            for b in M.permuted(np.arange(n), n, M._node_key(seed, number, -1 - k)).tolist():
                if left <= 0:
                    break
                room, begin, inside = left, 0, []
                for r in blocks.get(b, []):
                    if begin + r["size"] / 2 <= room:
                        inside.append(r["row"])
                    begin += r["size"]
                order.append(inside)
                left -= begin
        held.append(order)
        drawn.append(len(order))
    quotas = np.array(drawn)
    shards = max(1, -(-int(quotas.sum()) // shard_blocks))
    out = {r["row"]: [] for r in rows}
    for group in range(-(-len(sources) // M.GROUP_SOURCES)):
        cut = slice(group * M.GROUP_SOURCES, (group + 1) * M.GROUP_SOURCES)
        sums = np.array([quotas[i : i + M.GROUP_SOURCES].sum() for i in range(0, len(sources), M.GROUP_SOURCES)])
        for shard, before, own in M.shard_quotas(quotas[cut], shards, 0, shards, seed, sums, group):
            for i in range(len(own)):
                for inside in held[group * M.GROUP_SOURCES + i][before[i] : before[i] + own[i]]:
                    for row in inside:
                        out[row].append(shard)
    return out


@pytest.mark.parametrize("per_group", [4096, 3])
def test_what_is_taken_are_the_blocks_the_tree_dealt(spark, monkeypatch, per_group):
    monkeypatch.setattr(M, "GROUP_SOURCES", per_group)
    rng = np.random.default_rng(1)
    rows = [{"row": i, "source": "abcdefgh"[min(7, int(rng.integers(0, 12)))], "size": int(rng.integers(0, 40)) if i % 50 else 900, "place": int(rng.integers(-(1 << 62), 1 << 62))} for i in range(900)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "row long, source string, size long, place long")
    got = M.plan(frame, seed=5, block_words=100, shard_blocks=4).collect()
    targets = {r["source"]: r["target"] for r in got}
    assert targets == pytest.approx(plain_targets({s: sum(r["size"] for r in rows if r["source"] == s) for s in targets}))
    want = plain_plan(rows, targets, 100, 4, 5)
    assert {r["row"]: sorted(s for s in (r["shard_1"], r["shard_2"]) if s is not None) for r in got} == {k: sorted(v) for k, v in want.items()}
    assert len({s for v in want.values() for s in v}) > 20


def test_groups_of_sources_split_exactly():
    quotas, shards = np.array([17, 0, 301, 5, 40, 1, 8]), 9
    sums = np.array([quotas[:3].sum(), quotas[3:6].sum(), quotas[6:].sum()])
    parts = [list(M.shard_quotas(quotas[3 * g : 3 * g + 3], shards, 0, shards, 3, sums, g)) for g in range(3)]
    for g, part in enumerate(parts):
        assert (sum(own for _, _, own in part) == quotas[3 * g : 3 * g + 3]).all()
    blocks = int(quotas.sum())
    assert [sum(int(part[i][2].sum()) for part in parts) for i in range(shards)] == [blocks * (i + 1) // shards - blocks * i // shards for i in range(shards)]


def test_written_files_are_the_shards_in_order(spark, tmp_path, monkeypatch):
    docs = documents(spark)
    placed = sorted(M.mix(docs, with_place=True).collect(), key=lambda r: (r["shard"], r["place_in_shard"]))
    M.mix(docs, with_place=False).write.parquet(str(tmp_path / "mix"))
    files = [[r["doc_id"] for r in spark.read.parquet(str(f)).collect()] for f in sorted((tmp_path / "mix").glob("*.parquet"))]
    by_shard = {}
    for r in placed:
        by_shard.setdefault(r["shard"], []).append(r["doc_id"])
    joined = {tuple(i for shard in some for i in by_shard[shard]) for some in [[s] for s in by_shard] + [sorted(by_shard)]}
    assert all(tuple(ids) in joined for ids in files if ids) and sum(map(len, files)) == len(placed)
