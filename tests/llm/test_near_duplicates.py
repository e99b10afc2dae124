import random
import re
from collections import Counter, defaultdict

import pytest

from residua.llm import components
from residua.llm import near_duplicates as near_duplicates_module
from residua.llm.components import connected_components
from residua.llm.near_duplicates import NearDuplicateConfig, near_duplicates


def brute(rows, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed):
    r = random.Random(seed)
    rows, n = [], 0
    for _ in range(25):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randrange(30, 160))]
        for _ in range(r.choice([1, 1, 2, 12, 40])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                words[r.randrange(len(words))] = f"x{r.randrange(9999)}"
            if r.random() < 0.3:
                base = words  # chains: neighbours are alike, ends are not
            rows.append((n, " ".join(words).upper() if r.random() < 0.2 else "  ".join(words)))
            n += 1
    r.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        for k in (4, 5):
            got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), conf=NearDuplicateConfig(shingle_words=k)).collect()
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k)
            assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_small_passes_and_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates_module, "WAVES", (1, 2, 1 << 30))
    monkeypatch.setattr(near_duplicates_module, "BLOCK", 4)
    rows = corpus(3)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 5)


def test_edge_rows(spark, edge, no_docs):
    got = near_duplicates(edge).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and not by[2].kept and by[1].kept
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (3, 4, 5))
    assert by[None].component_id is None and by[None].kept
    assert by[8].component_id == 7 and by[7].n_shingles == 1
    assert near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_components_of_a_long_chain_and_a_star(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", one_task)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(200, 900)] + [(900, 899), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161))
    assert all(got[i] == 5 for i in range(200, 901)) and 7 not in got
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
