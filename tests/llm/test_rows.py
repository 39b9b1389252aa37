"""Packing, mixing, token ids and counts, sharding."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lithic.llm import mixing, packing, sharding, tokencounts, tokenids
from lithic.llm.tokens import encoder
from pyspark.sql import functions as F


# ------------------------------------------------------------------- packing
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.integers(60, 100))
@settings(max_examples=60, deadline=None)
def test_groups_are_packed_whole(sizes, capacity):
    parts = packing.pack_group(sizes, capacity)
    assert sorted(k for p in parts for k in p) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in p) <= capacity for p in parts)


def plain_differencing(sizes, m):
    """The method on full tuples."""
    parts = [[(0, [])] * (m - 1) + [(s, [k])] for k, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0][0] - p[-1][0])
        a, b = parts[:2]
        parts = parts[2:] + [sorted((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b)))]
    return sorted(s for s, _ in parts[0])


@pytest.mark.parametrize("seed", range(4))
def test_differencing_is_near_equal(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 1000) for _ in range(60)]
    for m in (2, 5, 12):
        sums = sorted(s for s, _ in packing.differencing(sizes, m))
        plain = plain_differencing(sizes, m)
        assert sum(sums) == sum(sizes) and sums[-1] - sums[0] <= max(40, 2 * (plain[-1] - plain[0]))


def test_best_of_all_partitions():
    sizes = [8, 7, 6, 5, 4]
    best = min(max(sum(s for s, w in zip(sizes, c) if w == k) for k in range(2)) for c in itertools.product(range(2), repeat=5))
    assert max(s for s, _ in packing.differencing(sizes, 2)) - best <= 1


def test_large_group_takes_the_fewest_windows_that_fit():
    rng = random.Random(1)
    sizes = [rng.randint(10, 30) for _ in range(1500)]
    least = next(m for m in range(-(-sum(sizes) // 100), 1501) if max(s for s, _ in packing.differencing(sizes, m)) <= 100)
    assert least > 256 and len(packing.pack_group(sizes, 100)) == least


def test_windows(docs, texts):
    rows = packing.pack_windows(docs, capacity=100, group=16).collect()
    want = dict(enumerate(encoder().counts(texts).tolist()))
    got, held = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
        held[r.window] = held.get(r.window, 0) + r.n_tokens
    assert max(held.values()) <= 100 and sum(held.values()) / len(held) > 85
    for d, pieces in got.items():
        assert [s for s, _ in sorted(pieces)] == list(range(0, want[d], 100)) and sum(n for _, n in pieces) == want[d]
    assert set(got) == set(want)


def test_rows_that_look_alike_spread(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text " * 5).alias("text"))
    got = packing.pack_windows(rows, capacity=100, group=64).select(F.expr("window >> 24").alias("grp")).groupBy("grp").count().collect()
    assert len(got) == 63 and max(r["count"] for r in got) < 130


def test_neighbours_in_files_share_a_group(spark, tmp_path):
    rows = [(k, f"text of row {k} " * (k % 7)) for k in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    got = packing.pack_sequence(docs, capacity=200, group=50).collect()
    want = {k: len(encoder().encode_plain(t)) for k, t in rows if t}
    assert {(r.doc_id, r.start): r.n_tokens for r in got} == {(k, a): min(200, n - a) for k, n in want.items() for a in range(0, n, 200)}
    groups = {}
    for r in got:
        groups.setdefault(r.window >> 24, set()).add(r.doc_id // 50)
    assert len(groups) == 10 and all(len(g) == 1 for g in groups.values())


def test_odd_windows(odd, empty):
    rows = packing.pack_windows(odd).collect()
    assert {r.doc_id for r in rows} == {1, None, 4, 5, 6, 7, 8} and sum(r.doc_id == 1 for r in rows) == 3
    assert packing.pack_windows(empty).count() == 0


# -------------------------------------------------------------------- mixing
def test_exponent_meets_targets(spark):
    tokens = [900, 50, 30, 20]
    rows = spark.createDataFrame([(f"s{k}", t) for k, t in enumerate(tokens)], "source string, tokens long")
    a = mixing.exponent(rows, max_repeats=4)
    assert max((900 / t) ** (1 - a) for t in tokens) == pytest.approx(4, rel=1e-6)
    a = mixing.exponent(rows, target_entropy=1.2)
    w = np.array(tokens, float) ** a
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(1.2, abs=1e-6)
    assert mixing.exponent(rows, target_entropy=9) == 0 and mixing.exponent(rows, target_entropy=0.01) == 1 and mixing.exponent(rows.limit(1), max_repeats=2) == 1


def test_limit_holds_under_a_budget(spark):
    rows = spark.createDataFrame([("a", 900), ("b", 50)], "source string, tokens long")
    a = mixing.exponent(rows, max_repeats=4, budget=3000)
    quotas = {r.source: r.quota / r.tokens for r in mixing.source_budgets(rows, a, 3000).collect()}
    assert 3.98 < quotas["b"] <= 4.01 and quotas["a"] < 4
    # more than all tokens four times over can't keep to it, and is then spread evenly
    assert mixing.exponent(rows, max_repeats=4, budget=10_000) == 1
    even = {r.quota / r.tokens for r in mixing.source_budgets(rows, 1.0, 10_000).collect()}
    assert max(even) - min(even) < 0.02


@given(st.lists(st.integers(1, 10**6), min_size=2, max_size=6, unique=True), st.floats(1.01, 30))
@settings(max_examples=60, deadline=None)
def test_rounded_exponent_keeps_the_limit(tokens, limit):
    class Rows:
        def agg(self, *_):
            return self

        def first(self):
            return {"s": sum(tokens), "lo": min(tokens), "hi": max(tokens), "n": len(tokens)}

    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "F", __import__("unittest.mock").mock.MagicMock())
        a = mixing.exponent(Rows(), max_repeats=limit)
    assert (max(tokens) / min(tokens)) ** (1 - a) <= limit * (1 + 1e-12) and 0 <= a <= 1


def test_mix(docs, texts):
    rows = mixing.mix(docs, budget=4000, target_entropy=1.05, block_tokens=500).collect()
    length = {k: len(t.split()) for k, t in enumerate(texts)}
    total = {s: sum(n for k, n in length.items() if k % 3 == s) for s in range(3)}
    a = mixing.exponent(docs.sparkSession.createDataFrame([(f"src{s}", n) for s, n in total.items()], "source string, tokens long"), target_entropy=1.05)
    z = sum((n / sum(total.values())) ** a for n in total.values())
    for s in range(3):
        quota = 4000 * (total[s] / sum(total.values())) ** a / z
        own = [r for r in rows if r.source == f"src{s}"]
        assert quota <= sum(r.n_tokens for r in own) < quota + max(length.values())
        whole = [r.doc_id for r in own if r.epoch == 0]
        assert len(set(whole)) == len(whole) and (max(r.epoch for r in own) == 0 or set(whole) == {k for k in length if k % 3 == s})
    blocks = {}
    for r in rows:
        blocks.setdefault(r.block, []).append(r)
    for own in blocks.values():
        assert sorted(r.pos for r in own) == list(range(len(own)))
        assert abs(sum(r.n_tokens for r in own) - 500) <= 3 * max(length.values())


def test_mixed_rows_are_the_mix(spark, docs, texts, tmp_path):
    kwargs = {"max_repeats": 2.0, "block_tokens": 300}
    want = [r.doc_id for r in sorted(mixing.mix(docs, **kwargs).collect(), key=lambda r: (r.block, r.pos))]
    out = mixing.mix_documents(docs, **kwargs)
    out.write.parquet(str(tmp_path / "mixed"))
    got = [r.doc_id for f in sorted((tmp_path / "mixed").glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
    assert got == want and out.columns == docs.columns
    assert set(want) == set(range(len(texts)))
    for s in range(3):  # quotas are exceeded by less than a document
        own = [len(t.split()) for k, t in enumerate(texts) if k % 3 == s]
        drawn = sum(len(texts[d].split()) for d in want if d % 3 == s)
        assert drawn < 2 * sum(own) + max(own)


def test_odd_mix(odd, empty):
    rows = mixing.mix(odd).collect()
    assert {r.source for r in rows} == {"x", "y", ""} and {r.doc_id for r in rows} >= {1, 3, 5, 6, 7, 8}
    first = [(r.doc_id, r["__h"]) for r in rows if r.epoch == 0]
    assert len(set(first)) == len(first)
    assert mixing.mix_documents(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


# ------------------------------------------------------------------ token ids
ODD_TEXTS = ["", "\0", "a\0b", " ", "  x  y\n\n\nz", "don't we'll 'tis '' 's", "²3 Ⅷ4", "x" * 3000, "é à\x1c!\x1c!  \x85q", "\r\n\tfoo  bar", "<|endoftext|> a", "日本語 text"]


def test_encoder_equals_the_library(texts):
    enc = encoder()
    for _ in range(2):  # the second time from the table
        ids, sizes = enc.encode(ODD_TEXTS + texts)
        at = 0
        for t, n in zip(ODD_TEXTS + texts, sizes):
            assert ids[at : at + n].tolist() == enc.encode_plain(t)
            at += n
        assert enc.counts(ODD_TEXTS + texts).tolist() == sizes.tolist()


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_encoder_on_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder().encode([text])[0].tolist() == encoder().encode_plain(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"])
def test_other_vocabularies(name):
    enc = encoder(f"/opt/tokenizers/{name}")
    ids, sizes = enc.encode(["some text", "", "more"])
    assert sizes.tolist() == [len(enc.encode_plain(t)) for t in ["some text", "", "more"]] and ids[: sizes[0]].tolist() == enc.encode_plain("some text")


@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=300), max_size=5))
@settings(max_examples=80, deadline=None)
def test_blocks_round_trip(rows):
    ids = np.array([x for r in rows for x in r], np.uint32)
    data, size, starts, blocks = tokenids.encode_blocks(ids, np.array([len(r) for r in rows], np.int64))
    at = first = 0
    for r, n, b in zip(rows, size, blocks):
        blob = data[at : at + n].tobytes()
        assert tokenids.decode(blob).tolist() == r
        for k, s in enumerate(starts[first : first + b]):
            assert tokenids.decode_block(blob, int(s))[0].tolist() == r[128 * k : 128 * (k + 1)]
        at, first = at + n, first + b


def test_token_tables(docs, texts, odd, empty):
    for r in tokenids.token_id_blocks(docs).collect():
        assert tokenids.decode(r.data).tolist() == encoder().encode_plain(texts[r.doc_id]) and r.n_tokens == len(tokenids.decode(r.data))
    rows = tokenids.token_id_blocks(odd).collect()
    assert len(rows) == odd.count() and [(r.n_tokens, r.data) for r in rows if r.doc_id == 2] == [(None, None)] and [(r.n_tokens, bytes(r.data), r.block_starts) for r in rows if r.doc_id == 3] == [(0, b"", [])]
    assert tokenids.token_id_blocks(empty).count() == 0


# --------------------------------------------------------------- token counts
def test_counts_come_from_the_cache(spark, docs, texts, odd, empty, tmp_path):
    cache = f"file://{tmp_path}/cache"
    want = [len(encoder().encode_plain(t)) for t in texts]
    assert {r.doc_id: r.n_tokens for r in tokencounts.token_counts(docs, cache).collect()} == dict(enumerate(want))
    stored = spark.read.parquet(f"{cache}/batch=*")
    assert stored.count() == len(set(texts))
    # what is stored is taken as it is, and not encoded again
    marked = f"file://{tmp_path}/marked"
    stored.withColumn("n_tokens", F.lit(-1).cast("long")).write.parquet(f"{marked}/batch=0")
    more = docs.union(docs.limit(1).withColumn("text", F.lit("new\r\ntext")).withColumn("doc_id", F.lit(999).cast("long")))
    got = {r.doc_id: r.n_tokens for r in tokencounts.token_counts(more, marked).collect()}
    assert {n for d, n in got.items() if d != 999} == {-1} and got[999] == encoder().counts(["new\ntext"])[0]
    assert spark.read.parquet(f"{marked}/batch=*").count() == len(set(texts)) + 1
    # another vocabulary has entries of its own
    other = tokencounts.token_counts(docs, marked, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    assert -1 not in {r.n_tokens for r in other.collect()}
    rows = tokencounts.token_counts(odd, cache).collect()
    assert len(rows) == odd.count() and {r.doc_id: r.n_tokens for r in rows if r.doc_id in (2, 3)} == {2: None, 3: 0}
    assert tokencounts.token_counts(empty, cache).count() == 0 and tokencounts.token_counts(empty, f"{cache}-none").count() == 0


# ------------------------------------------------------------------- sharding
@pytest.mark.parametrize("limit", [200, 700, 3000, 10**9])
def test_shards_against_sql(docs, limit):
    con = duckdb.connect()
    documents = docs.toArrow()  # noqa: F841
    want = con.sql(sharding.OP7_SQL.replace(str(sharding.LIMIT), str(limit))).fetchall()
    got = [tuple(r) for r in sharding.assign_shards(docs, limit).collect()]
    assert sorted(got) == sorted(want)
    held = {}
    for _, shard, depth, n in got:
        assert len(shard) == depth
        held.setdefault(shard, []).append(n)
    assert all(sum(v) <= limit or len(v) == 1 for v in held.values())
    assert limit < 10**9 or set(held) == {""}
    assert not any(a != b and b.startswith(a) for a in held for b in held)


def test_odd_shards(spark, odd, empty, tmp_path):
    rows = sharding.assign_shards(odd, 20).collect()
    assert len(rows) == odd.count() and len({r.shard for r in rows if r.doc_id == 1 and r.n_bytes == 11}) == 1
    held = {}
    for r in rows:
        held.setdefault(r.shard, set()).add((r.doc_id, r.n_bytes))
    assert all(sum(n for _, n in own) <= 20 or len(own) == 1 for own in held.values())
    assert sharding.assign_shards(empty, 20).count() == 0
    sharding.write_shards(odd.toDF(*[f"{c}_{k}" if k == 8 else c for k, c in enumerate(odd.columns)]), str(tmp_path / "shards"), 20)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == odd.count()


def test_deep_splits(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"))
    got = sharding.assign_shards(rows, 20).collect()
    held = {}
    for r in got:
        held[r.shard] = held.get(r.shard, 0) + r.n_bytes
    assert max(held.values()) <= 20 and max(r.depth for r in got) > sharding.STEP and math.fsum(held.values()) == 30000
