"""The near-copies stage against brute-force similarity of five-word shingles."""

import re

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from motorlens.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_kept(rows):
    """(doc_id, text) of what stays: the smallest doc_id of each group of chained pairs of similarity 0.8 or more."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common) > 0:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(set(least.values())) + [None] * sum(doc is None for doc, _ in rows)


def near_texts():
    rng = np.random.default_rng(11)
    word = lambda: "w" + str(rng.integers(0, 10**9))
    texts, line = [None, "", " \n", "a b", "A  b", "one two three four five six", "one two three four five six seven"], [word() for _ in range(20)]
    for length in (6, 12, 30, 60, 200, 500):
        for changes in (0, 1, 2, 3, 5, 9):
            for _ in range(4):
                own = [word() for _ in range(length)] + (line if length > 12 else [])
                copy = list(own)
                for at in rng.integers(0, len(own), changes):
                    copy[at] = word()
                again = list(copy)
                again[rng.integers(0, len(own))] = word()
                texts += [" ".join(own), " ".join(copy).upper(), " ".join(again), " ".join(own[: int(len(own) * rng.uniform(0.7, 1))])]
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[k]) for i, k in enumerate(order)]
    return rows + [(None, texts[-1] + " one more"), (None, "no id"), rows[5]]


@pytest.mark.parametrize("block, cell", [(None, None), (50, 5)])
def test_stage_links_all_pairs(spark, data, monkeypatch, block, cell):
    if block:
        monkeypatch.setattr(near_copies, "BLOCK", block)
        monkeypatch.setattr(near_copies, "CELL", cell)
        monkeypatch.setattr(near_copies, "SPLIT", 2)
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS).repartition(3)
    got = [r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, data).select("doc_id").collect()]
    assert sorted(got, key=lambda i: (i is None, i or 0)) == brute_kept(rows)


def test_a_large_group_makes_few_pairs(spark, data):
    """Copies of one text with few or many changes, most of them not near each other: links as by brute force, pairs in proportion to texts."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            own[at] = f"x{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS).repartition(3)
    tried = []
    close = near_copies.near
    near_copies.near = lambda pairs, *rest: tried.append(pairs.count()) or close(pairs, *rest)
    try:
        got = [r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, data).select("doc_id").collect()]
    finally:
        near_copies.near = close
    assert sorted(got) == brute_kept(rows) and sum(tried) < 8 * 260


def test_simhash_links_come_first(spark, data, monkeypatch):
    """What operator 5 links through vantage-point trees is joined by those links alone where they hold; the exact filter gets the rest."""
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS).repartition(3)
    sets = {near_copies.set_id(s): s for s in (near_copies.shingle_set((t or "").encode()) for _, t in rows)}
    prints = {k: near_copies.class_print(s) for k, s in sets.items()}
    asked = []
    close = near_copies.near
    monkeypatch.setattr(near_copies, "near", lambda pairs, *rest: asked.append({(r["a"], r["b"]) for r in pairs.select("a", "b").collect()}) or close(pairs, *rest))
    corpus_pipeline.near_copies(spark, docs, data).count()
    first, *rest = asked
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holds = lambda a, b: 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))
    assert len(first) > 20 and all(a < b and (prints[a] ^ prints[b]).bit_count() <= 2 for a, b in first)
    for a, b in first:
        if holds(a, b):
            root[find(a)] = find(b)
    assert all(find(a) != find(b) for a, b in set().union(*rest))
    assert any(holds(a, b) for a, b in set().union(*rest))  # SimHash alone would lose these


def test_pairs_of_shards_chain_what_is_linked():
    from motorlens.llm import op5_simhash

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    prints = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(6)]))
    for leaf in (4, 512):
        member, up = op5_simhash.shard_links(prints, leaf=leaf)
        a, b = op5_simhash.shard_pairs(prints, leaf=leaf)
        assert len(a) == len(member) > 100 and (np.bitwise_count(a ^ b) <= 2).all()
        root = {int(p): int(p) for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            x, y = sorted((find(x), find(y)))
            root[y] = x
        want = {int(p): int(p) for p in prints} | dict(zip(member.tolist(), up.tolist()))
        assert {p: find(p) for p in root} == want


def test_first_rows_of_runs():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"token": np.sort(rng.zipf(1.4, 400) % 120), "part": rng.integers(-1, 2, 400), "at": rng.integers(0, 5, 400).astype(np.int32), "set_id": rng.permutation(400), "n": np.full(400, 9, np.int32)})
    rows.loc[rows["token"] % 2 == 0, "part"] = -1
    rows = rows.sort_values(["token", "part", "at", "set_id"])
    rows = rows[(rows["token"] % 2 == 0) | (rows["part"] >= 0)]
    for size in (1, 3, 50, 1000):
        got = pa.Table.from_batches(near_copies.starred(iter(pa.Table.from_pandas(rows, preserve_index=False).to_batches(size)))).to_pandas()
        want = {}
        for (_, part), own in rows.groupby(["token", "part"]):
            if len(own) > 1 or part >= 0:
                want |= {r.set_id: own["set_id"].iloc[0] for r in own.itertuples()}
        assert dict(zip(got["set_id"], got["c_set"])) == want


def test_blocks_and_pairs_lose_nothing():
    rng = np.random.default_rng(12)
    rows = pd.DataFrame({"cell": np.sort(rng.zipf(1.6, 900) % 90), "set_id": rng.permutation(900), "n": rng.integers(80, 120, 900), "at": rng.integers(0, 9, 900)})
    rows["comp"], rows["side"] = rows["set_id"] % 200, rows["set_id"] % 2
    rows["whole"] = rows["cell"] % 3 > 0
    rows = rows.sort_values(["cell", "n", "set_id"])
    want = {
        tuple(sorted((a.set_id, b.set_id)))
        for _, own in rows.groupby("cell")
        for a in own.itertuples()
        for b in own.itertuples()
        if a.set_id < b.set_id and a.comp != b.comp and (a.whole or a.side != b.side) and 5 * min(a.n, b.n) >= 4 * max(a.n, b.n) and 9 * (1 + min(a.n - a.at - 1, b.n - b.at - 1)) >= 4 * (a.n + b.n)
    }
    import pyarrow as pa

    table = pa.Table.from_pandas(rows, preserve_index=False)
    blocks = list(near_copies._blocks(iter(table.to_batches(7)), 40))
    assert sum(map(len, blocks)) == 900
    got = {tuple(sorted((b["set_id"].iloc[x], b["set_id"].iloc[y]))) for b in blocks for i, j in near_copies.block_pairs(b) for x, y in zip(i.tolist(), j.tolist())}
    assert got == want
