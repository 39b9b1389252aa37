"""Line dedup and near-dedup against all-pairs versions."""

import itertools
import random

import numpy as np
import pytest
from lithic.llm import common, linededup, simhash
from pyspark.sql import functions as F


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(line):
    return {line[k : k + linededup.SHINGLE] for k in range(max(1, len(line) - linededup.SHINGLE + 1))}


def test_jaccard_is_exact(texts):
    lines = [x for t in texts for x in t.split("\n")] + ["", "ab", "abcdefg", "ab", "日本語のテキスト例"]
    rng = random.Random(1)
    a, b = rng.choices(lines, k=300), rng.choices(lines, k=300)
    want = [len(shingle_set(x) & shingle_set(y)) / len(shingle_set(x) | shingle_set(y)) for x, y in zip(a, b)]
    assert np.allclose(linededup.jaccard(a, b), want, atol=0.003)


def brute_lines(texts):
    """(doc, line) -> (doc, line) that stays."""
    places, sets = {}, {}
    for d, t in enumerate(texts):
        for k, x in enumerate((t or "").split("\n")):
            if x.strip():
                places.setdefault(x.lower(), []).append((d, k))
                sets[x.lower()] = shingle_set(x.lower())
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= linededup.SIMILARITY * len(sets[a] | sets[b])]
    group = {}
    for line, root in components(sets, near).items():
        group.setdefault(root, []).extend(places[line])
    return {p: min(g) for g in group.values() for p in g if p != min(g)}


def test_lines_against_brute_force(docs, texts):
    want = brute_lines(texts)
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in linededup.duplicate_lines(docs).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) > 20


def test_removed_lines_are_gone(docs, texts):
    gone = {(r.doc_id, r.line_no) for r in linededup.duplicate_lines(docs).collect()}
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns
    want = {}
    for d, t in enumerate(texts):
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
        if left.strip():
            want[d] = left
    got = out.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_large_bucket_tries_failed_lines_against_the_rest():
    entries = np.zeros(9, linededup._ENTRY)
    entries["hash"] = [5] * 8 + [6]
    entries["line"] = np.arange(9) + 10
    got = linededup.bucket_pairs(entries)
    assert set(got["a"]) == {10} and sorted(got["b"]) == list(range(11, 18)) and set(got["bucket"]) == {5} and got["near"].all()
    entries["hash"] = [5] * 8 + [5]
    entries["sketch"] = [0, 0, 0x11111111, 0x11111100, 0x22222222, 0, 0, 0x1F, 0x33333333]
    got = linededup.bucket_pairs(entries)
    star = got["bucket"] == 5
    assert dict(zip(got["b"][star].tolist(), got["near"][star].tolist())) == {11: True, 12: False, 13: True, 14: False, 15: True, 16: True, 17: True, 18: False}
    # those apart from line 10 meet whom they are near to, once
    assert sorted(zip(got["a"][~star].tolist(), got["b"][~star].tolist())) == [(12, 13)] and set(got["bucket"][~star]) == {-1}


def test_every_candidate_pair_of_a_bucket_is_tried(monkeypatch):
    rng = np.random.default_rng(5)
    for budget in (7, 1 << 20):
        monkeypatch.setattr(linededup, "BUDGET", budget)
        entries = np.zeros(60, linededup._ENTRY)
        entries["hash"], entries["line"] = rng.integers(0, 4, 60), rng.permutation(60)
        entries["sketch"] = rng.choice(np.array([0, 0x11, 0x11111111, 0x22222211, 0x12121212], np.uint32), 60)
        got = linededup.bucket_pairs(entries)
        pairs = sorted(zip(got["a"][got["bucket"] < 0].tolist(), got["b"][got["bucket"] < 0].tolist()))
        assert len(set(pairs)) == len(pairs)
        tried = {*pairs, *zip(got["a"][got["near"]].tolist(), got["b"][got["near"]].tolist())}
        by_line = {int(e["line"]): e for e in entries}
        least = {int(h): min(int(e["line"]) for e in entries if e["hash"] == h) for h in entries["hash"]}
        for a, b in itertools.combinations(range(60), 2):
            x, y = by_line[a], by_line[b]
            if x["hash"] != y["hash"] or linededup.agreeing(x["sketch"], y["sketch"]) < linededup.AGREE:
                continue
            first = by_line[least[int(x["hash"])]]
            # near to the least line both, they are left to what their texts say about it
            both = all(linededup.agreeing(z["sketch"], first["sketch"]) >= linededup.AGREE for z in (x, y))
            assert both or (a, b) in tried


def test_lines_that_share_an_id_but_not_their_text(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"line number {k % 5} of five", k) for k in range(20)], "doc_id long, text string, __h long")
    real = linededup.line_table
    monkeypatch.setattr(linededup, "line_table", lambda keyed: real(keyed).withColumn("line", F.lit(7).cast("long")))
    lines, each, total = linededup.numbered_lines(rows)
    assert total == 5 and sorted(r.n for r in each.collect()) == [4] * 5
    assert len({(r.line, r.words) for r in lines.select("line", "words").distinct().collect()}) == 5


def test_bands_keep_their_chance_as_the_corpus_grows():
    assert linededup.banding(0) == linededup.banding(1 << 25) == (4, 28)
    for lines in (1, 1 << 26, 1 << 32, 1 << 40):
        rows, bands = linededup.banding(lines)
        assert 0.975 < 1 - (1 - linededup.GOAL**rows) ** bands < 0.99
    assert linededup.banding(1 << 40)[0] == 7


def test_more_rows_find_the_same(docs, texts, monkeypatch):
    monkeypatch.setattr(linededup, "FEW", 8)
    assert linededup.banding(300) == (6, 80)
    want = brute_lines(texts)
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in linededup.duplicate_lines(docs).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)


def test_big_groups_of_near_lines(spark):
    rng = random.Random(4)
    base = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60))
    lines = [base[:k] + "#" + base[k:] for k in range(0, 200, 5)]
    # far from the group's least line but near to another one
    far = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    assert linededup.duplicate_lines(far).count() == len(lines) - 1


def test_one_word_changed_in_a_line(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 8)))
    rows = [(0, "Copyright (c) 2019 John Smith. All rights reserved."), (1, "Copyright (c) 2020 John Smith. All rights reserved.")]
    for k in range(1, 201):
        w = [word()]
        while len(" ".join(w)) < 40 + k % 40:
            w.append(word())
        v = list(w)
        v[rng.randrange(len(w))] = word()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    got = {r.doc_id: r.kept_doc_id for r in linededup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == 0 and all(b == a - 1 and b % 2 == 0 for a, b in got.items())
    assert len(got) >= 0.9 * 201


def test_texts_are_read_once_for_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60))
    lines = [base[:k] + "#" + base[k:] for k in range(0, 200, 5)] + [base[: 60 + 2 * k] + base[::-1][: 200 - 2 * k] for k in range(40)]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    calls = {"_texts_of": 0, "_verified": 0}

    def counting(name, real):
        def call(*args):
            calls[name] += 1
            return real(*args)

        return call

    for name in calls:
        monkeypatch.setattr(linededup, name, counting(name, getattr(linededup, name)))
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in linededup.duplicate_lines(docs).collect()}
    # lines that fail against the least of their bucket are tried against the others, with the texts that were read before
    assert calls == {"_texts_of": 1, "_verified": 2}
    want = brute_lines(lines)
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)


def test_texts_are_not_hashed_for_repeats_where_no_id_repeats(docs, texts, monkeypatch):
    def fail(*_):
        raise AssertionError("the texts are read for repeats")

    monkeypatch.setattr(linededup, "collapse_repeats", fail)
    assert linededup.duplicate_lines(docs).count() >= 0.97 * len(brute_lines(texts))
    twice = docs.union(docs.limit(1))
    with pytest.raises(AssertionError):
        linededup.duplicate_lines(twice)


def test_odd_lines(odd, empty):
    rows = linededup.duplicate_lines(odd)
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in rows.collect()}
    assert got == {(7, 0): (1, 0), (7, 1): (1, 1), (6, 0): (5, 0)} and rows.count() == 3
    out = linededup.dedup_lines(odd)
    left = sorted((r.doc_id or 0, r[1] is None, (r[1] or "")[:9]) for r in out.collect())
    assert out.columns == odd.columns and [x[0] for x in left] == [0, 0, 1, 1, 2, 3, 4, 5, 8]
    assert linededup.duplicate_lines(empty).count() == 0 and linededup.dedup_lines(empty).columns == odd.columns


# -------------------------------------------------------------------- simhash
def brute_simhash(prints):
    bits = [np.unpackbits(np.frombuffer(p, np.uint8)).astype(int) if p else None for p in prints]
    edges = []
    for i, j in itertools.combinations([k for k, b in enumerate(bits) if b is not None], 2):
        diff = (bits[i] != bits[j]).reshape(simhash.TABLES, simhash.BITS).sum(axis=1)
        if diff.min() <= simhash.RADIUS and diff.sum() <= simhash.MAX_DIFF:
            edges.append((i, j))
    root = components([k for k, b in enumerate(bits) if b is not None], edges)
    return {k: r for k, r in root.items() if k != r}


def test_near_copies_against_brute_force(docs, texts):
    want = brute_simhash(simhash.fingerprints(texts))
    got = {r.doc_id: r.kept_id for r in simhash.simhash_duplicates(docs).collect()}
    assert got == want and len(want) >= 10


def test_ball_hashing_finds_all_pairs_within_the_radius():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (40, simhash.WIDTH), dtype=np.uint8)
    near = base.copy()
    for k in range(40):
        for bit in rng.choice(simhash.BITS * simhash.TABLES, rng.integers(0, 12), replace=False):
            near[k, bit // 8] ^= 128 >> bit % 8
    fps = np.unique(np.concatenate([base, near]), axis=0)
    want = brute_simhash([f.tobytes() for f in fps])
    edges = []
    for q in (4, 7):
        edges = []
        for table, lead in itertools.product(range(simhash.TABLES), range(1 << q)):
            edges += [(int(a), int(b)) for a, b in simhash.group_edges(fps, table, lead, q, budget=500)]
        root = components(range(len(fps)), edges)
        assert {k: r for k, r in root.items() if k != r} == want


def test_one_word_changed_is_found():
    rng = random.Random(8)
    found = 0
    for _ in range(60):
        w = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(150)]
        v = list(w)
        v[rng.randrange(150)] = "other"
        found += bool(brute_simhash(simhash.fingerprints([" ".join(w), " ".join(v)])))
    assert found >= 54


def test_texts_without_a_word(spark):
    rows = spark.createDataFrame([(1, "!!! ---"), (2, "!!! ---"), (3, "!!! --"), (4, "🙂🙂"), (5, "🙂🙂"), (6, " \n"), (7, " \n"), (8, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept_id) for r in simhash.simhash_duplicates(rows).collect()) == [(2, 1), (5, 4)]


def test_odd_documents(odd, empty):
    got = sorted((r.doc_id or 0, r.kept_id) for r in simhash.simhash_duplicates(odd).collect())
    assert got == [(6, 5), (7, 1)]
    out = simhash.simhash_dedup(odd)
    assert out.columns == odd.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 0, 1, 1, 2, 3, 4, 5, 8]
    assert simhash.simhash_duplicates(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)]
    want = components({n for e in edges for n in e}, edges)
    rows = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.component for r in rows}
    assert got == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in edges)} and len(rows) == len(got)
