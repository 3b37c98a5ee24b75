"""N-gram join, substring dedup and decontamination against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tidemill.llm import decontam, graph, ngram_join, substring_dedup, trie


def corpus(seed, n=160):
    """Texts with exact copies, near copies, shared passages and short ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(25)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.35:
            words = r.choice(rows)[1].split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 5, 12, 40, 90]))]
            if kind > 0.8:
                words = words + passage + words[:3]
        rows.append((i * 3, r.choice([" ", "\n", "  "]).join(w.upper() if r.random() < 0.01 else w for w in words)))
    return rows


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"chunk": 60, "cell": 500, "batch_bytes": 3000, "bucket_bytes": 3000})])
def test_join_finds_all_links(spark, seed, options):
    rows = corpus(seed)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert len(got) == len(rows)


def test_one_large_group_of_near_copies_in_many_chunks(spark):
    r = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5])):
            words[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), chunk=700, cell=2000)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)


def test_join_of_odd_rows(odd, empty):
    got = ngram_join.jaccard_components(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 12 and by[2].component_id == 1 and by[1].component_id == 1
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[4].component_id == 4
    assert by[6].n_shingles == 1 and by[7].component_id == 6 and by[8].n_shingles == 1
    assert by[None].component_id is None
    assert ngram_join.jaccard_components(empty).count() == 0


def test_rows_that_repeat_an_id_lose_no_link(spark):
    words = [f"w{i}" for i in range(40)]
    a, near, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"v{i}" for i in range(60))
    rows = [(9, a), (11, near)]
    found = lambda x: sorted((r.doc_id, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(x, "doc_id long, text string")).collect())
    assert found(rows) == [(9, 9), (11, 9)]
    assert found([*rows, (5, a), (5, other)]) == [(5, 5), (5, 5), (9, 5), (11, 5)]
    assert found([*rows, (5, other), (20, a), (20, other)]) == [(5, 5), (9, 9), (11, 9), (20, 5), (20, 9)]


def test_many_dissimilar_sets_of_one_pivot(spark):
    r = random.Random(8)
    rows = []
    for i in range(90):  # all share their first words; some are near copies of others, of other sizes
        words = [f"c{j}" for j in range(12)] + [f"u{i % 60}x{j}" for j in range(r.choice([3, 8, 20, 21, 25]))]
        rows.append((i, " ".join(words)))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), chunk=200, cell=400)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == brute_components(rows)


def test_trie_join_equals_pairs():
    r = np.random.default_rng(4)
    for _ in range(20):
        base = np.unique(r.integers(0, 60, 25).astype(np.uint64))
        sets = [np.unique(np.concatenate([base[r.random(len(base)) < 0.9], r.integers(0, 60, r.integers(1, 4)).astype(np.uint64)])) for _ in range(15)]
        group = trie.join(sets, (7, 3))
        links = [(i, j) for i in range(15) for j in range(i) if 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (len(sets[i]) + len(sets[j]))]
        root = list(range(15))
        for i, j in links:
            a, b = root[i], root[j]
            root = [a if x == b else x for x in root]
        assert [[group[i] == group[j] for j in range(15)] for i in range(15)] == [[root[i] == root[j] for j in range(15)] for i in range(15)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)] + [(200, 200)], "a long, b long")
    got = {r.node: r.root for r in graph.components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def brute_kept(rows, k=13):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("seed,options", [(5, {}), (6, {"batch_bytes": 2000, "bucket_bytes": 1500})])
def test_substring_dedup(spark, seed, options):
    rows = corpus(seed)
    got = substring_dedup.report(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **options))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == brute_kept(rows)


def test_substring_dedup_of_odd_rows(odd, empty):
    got = substring_dedup.remove_repeats(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 12 and by[3].n_words == 0 and by[3].kept == ""
    assert by[8].n_words == 30_000 and by[8].n_removed == 0  # windows of the text itself do not count
    assert by[2].kept == "The" and by[None].n_removed == 0 and by[None].n_words == 16
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_decontamination(spark, odd, empty):
    rows = [(1, "Quick, brown FOX jumps over the lazy dog and runs far away"), (12, "one TWO three"), (3, None), (4, ""), (5, "one two three"), (None, "one two three"), (None, None)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.scan(odd, items).collect()}
    assert got[1].n_hit == 12 and got[1].item_ids == [1] and odd.columns == decontam.scan(odd, items).columns[:5]
    text = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    assert text[got[1].hit_starts[0] : got[1].hit_ends[0]] == "quick brown fox jumps over the lazy dog and runs far away"
    assert got[6].item_ids == [5, 12] and got[7].n_hit == 3 and got[3].n_words == 0 and got[9].n_hit == 0
    split = {r.doc_id: r for r in decontam.scan(odd, items, item_bytes=20).collect()}  # several automata
    assert split == got


def test_decontamination_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5, "x", [1], 2, 3)], "doc_id long, text string, N_HIT int, found_starts string, item_ids array<int>, part int, item int")
    items = spark.createDataFrame([(7, "b c")], "item_id long, text string")
    scanned = decontam.scan(docs, items)
    assert scanned.columns == ["doc_id", "text", "found_starts", "part", "item", "n_words", "hit_starts", "hit_ends", "n_hit", "item_ids"]
    assert [tuple(r) for r in scanned.collect()] == [(1, "a b c d", "x", 2, 3, 4, [2], [5], 2, [7])]


def test_decontamination_of_reported_and_empty_rows(spark, odd, empty):
    items = spark.createDataFrame([(12, "one TWO three"), (5, "one two three")], "item_id long, text string")
    assert {r.doc_id: r.items_sha256 for r in decontam.report(decontam.scan(odd, items)).collect()}[6] == hashlib.sha256(b"12,5").hexdigest()
    assert decontam.scan(empty, items).count() == 0 and decontam.scan(odd, items.limit(0)).filter("n_hit > 0").count() == 0
