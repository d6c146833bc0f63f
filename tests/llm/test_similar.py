"""Similarity join: against all pairs, at the threshold, with hot groups, with odd rows."""

import numpy as np
import pytest

from prefmine.llm import similar
from prefmine.llm.words import mix
from tests.llm import brute
from tests.llm.conftest import ODD


def test_join_equals_all_pairs(query, rows):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in query("op7_jaccard_join")}
    assert got == brute.similar(rows)


def test_links_at_the_threshold(spark):
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    rows = [(0, " ".join(base))]
    for i, more in enumerate((24, 25, 26), 1):  # 100 of 124, 125 (just 0.8), 126; among them they share less
        rows.append((i, " ".join(base + [f"x{i}_{j}" for j in range(more)])))
    rows += [(10, "a b c"), (11, "a b c"), (12, "a b"), (13, " a\tb\n c "), (14, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar.classes(df).collect()}
    assert got == brute.similar(rows)
    assert got[1] == got[2] == (0, 1) and got[0] == (0, 2) and got[3] == (3, 0) and got[13] == (10, 2)


def test_a_hot_group_of_near_copies_and_a_shared_passage(spark):
    """Near copies by the hundred, exact copies of some, and texts that share a long passage only."""
    rng = np.random.default_rng(4)
    base, passage = [f"b{i}" for i in range(150)], [f"p{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.integers(0, 150, 2):
            words[at] = f"n{i}_{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]
    rows += [(2000 + i, " ".join(passage + [f"u{i}_{j}" for j in range(200)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar.classes(df).collect()}
    assert got == brute.similar(rows)
    kept = [r["doc_id"] for r in similar.one_of_each(df).collect()]
    assert len(kept) == len(set(kept)) == len({c for c, _ in got.values()})


def test_long_near_copies_are_linked_once(spark):
    """Few long texts are dealt into several cells, some of which stay empty."""
    words = [f"word{i}" for i in range(120_000)]  # 1.2 MB
    rows = [(10 * i + j, " ".join([f"group{i}", *words[i:], *[f"own{j}"] * 3])) for i in range(4) for j in range(2)]
    rows = [(i, t.replace("word", f"g{i // 10}w")) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar.classes(df).collect()}
    assert got == {i: (i // 10 * 10, 1) for i, _ in rows}


def test_ids_of_either_sign(spark):
    rng = np.random.default_rng(12)
    ids = np.unique(rng.integers(-(1 << 63), 1 << 63, 58)).tolist() + [-1, 0]
    rows = []
    for n, i in enumerate(ids):  # groups of four, each with one word of its own
        words = [f"g{n % 15}_{j}" for j in range(150)]
        words[int(rng.integers(0, 150))] = f"own{n}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar.classes(df).collect()}
    assert got == brute.similar(rows) and {k for _, k in got.values()} == {3}


def test_ids_that_repeat_with_differing_texts(spark):
    """Every text has its own links, whichever ids it shares."""
    rng = np.random.default_rng(8)
    base = [[f"g{g}w{j}" for j in range(120)] for g in range(8)]

    def text(g, own):
        words = list(base[g])
        words[int(rng.integers(0, 120))] = own
        return " ".join(words)

    five = [(1, text(0, "a")), (1, text(1, "b")), (2, text(0, "c")), (3, text(1, "d")), (4, text(2, "e"))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar.classes(spark.createDataFrame(five, "doc_id long, text string")).collect()}
    assert got == {1: (1, 2), 2: (1, 1), 3: (1, 1), 4: (4, 0)}
    assert sorted(r["doc_id"] for r in similar.one_of_each(spark.createDataFrame(five, "doc_id long, text string")).collect()) == [1, 1, 4]

    rows = [(int(rng.integers(0, 40)), text(int(rng.integers(0, 8)), f"own{n % 50}")) for n in range(90)]
    rows += [rows[0], rows[1], (100, rows[2][1]), (100, rows[3][1]), (101, ""), (101, rows[4][1]), (102, None), (103, " " + rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar.classes(df).collect()}
    assert got == brute.similar_rows(rows)
    kept = [(r["doc_id"], r["text"]) for r in similar.one_of_each(df).collect()]
    groups = brute.text_classes([t or "" for _, t in rows])
    assert sorted(groups[t or ""] for _, t in kept) == sorted(set(groups.values()))
    for i, t in kept:
        assert i == min(j for j, x in rows if groups[x or ""] == groups[t or ""])


def test_pruning_rarely_drops_what_reaches_the_threshold():
    need = similar.least_matches(0.8, 1e-6)
    assert list(need) == sorted(need) and need[-1] < 0.8 * similar.VALUES
    rng = np.random.default_rng(3)
    dropped = 0
    for trial in range(200):
        shared, own = 800, 100
        pool = mix(np.arange(trial * 10_000, trial * 10_000 + shared + 2 * own, dtype=np.uint64))
        a, b = similar.min_hashes([np.unique(pool[: shared + own]), np.unique(np.delete(pool, np.s_[shared : shared + own]))])
        same = np.cumsum((a == b).reshape(-1, similar.STEP).sum(1))
        dropped += bool((same < np.array(need)).any())
    assert dropped == 0
    different = similar.min_hashes([np.unique(mix(rng.integers(0, 1 << 60, 500).astype(np.uint64))) for _ in range(2)])
    assert (different[0] == different[1]).sum() < need[0]


@pytest.mark.parametrize("few", [True, False])
def test_verification_counts_exactly(few):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, 200).astype(np.uint64)) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    a, b = (a[:30], b[:30]) if few else (a, b)
    want = [5 * len(np.intersect1d(sets[x], sets[y])) >= 3 * len(np.union1d(sets[x], sets[y])) for x, y in zip(a, b)]
    assert similar._verified(sets, a, b, 0.6).tolist() == want


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("(id * 7919) % 4001 + 1 AS a", "((id + 1) * 7919) % 4001 + 1 AS b").unionByName(spark.createDataFrame([(9000, 9001), (9001, 9001)], "a long, b long"))
    got = {r["node"]: r["label"] for r in similar.components(edges).collect()}
    chain = [i * 7919 % 4001 + 1 for i in range(201)]
    assert {got[n] for n in chain} == {min(chain)} and got[9000] == got[9001] == 9000


def test_odd_rows(odd, none):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar.classes(odd).collect()}
    assert set(got) == {i for i, _ in ODD if i is not None}
    assert got[1] == got[2] == got[3] == got[11] == (1, 3) and got[6][0] == got[12][0] == 6 and got[12][1] == 1
    kept = similar.one_of_each(odd)
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 8, 9, 10] and kept.columns == odd.columns
    assert similar.classes(none).count() == 0 and similar.one_of_each(none).count() == 0
