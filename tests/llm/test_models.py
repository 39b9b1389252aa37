"""Quality classifier, top-k search, media, and the pipeline."""

import math
import random
import struct

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from lithic.llm import media, packing, quality, simhash, topk
from lithic.llm.tokens import encoder
from pyspark.sql import functions as F

from test_dedup import brute_lines, brute_simhash

DATA = "/root/testdata/sf0.01"


# -------------------------------------------------------------------- quality
def test_tables_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    y = (x[:, 2] > 0.3).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.98


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(4)
    x = rng.random((500, 3))
    model = quality.fit(x, (x.sum(axis=1) > 1.5).astype(float))
    for row, got in zip(x[:20], model.score(x[:20])):
        want = model.base + sum(t[int((e <= v).sum())] for t, e, v in zip(model.tables, model.edges, row))
        want += sum(t[int((model.coarse[i] <= row[i]).sum()), int((model.coarse[j] <= row[j]).sum())] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert got == pytest.approx(want)


def test_features_of_whole_texts():
    none = quality.Listed({k: np.zeros(0, np.uint64) for k in quality.LISTS})
    col = dict(zip(quality.FEATURES, quality.features(["Ab ab! 12|x\nq", "", "a" * 300000 + "!"], none).T))
    assert col["upper_share"][0] == pytest.approx(1 / 13) and col["bar_share"][0] == pytest.approx(1 / 13) and col["repeat_share"][0] == pytest.approx(1 / 5)
    assert col["bang_share"][2] == pytest.approx(1 / 300001) and col["log_chars"][1] == 0


@pytest.fixture(scope="module")
def labelled(spark):
    base = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    model = quality.train(docs, labels.where(~held))
    truth = labels.where(held).select("doc_id", F.col("quality").alias("good"), "toxic")
    rows = quality.score_documents(docs, model).join(truth, "doc_id").collect()
    clean = [r for r in rows if r.good and not r.toxic]
    poor = [r for r in rows if not r.good]
    toxic = [r for r in rows if r.good and r.toxic]
    assert sum(r.keep for r in clean) / len(clean) > 0.97
    assert sum(not r.keep for r in poor) / len(poor) > 0.93
    assert sum(not r.keep for r in toxic) / len(toxic) > 0.7


def test_odd_labels_and_documents(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0, 5), (1, 0, None, 5), (5, 1, 0, 5), (None, 1, 1, 5), (99, 0, 1, 5)], "doc_id long, quality int, toxic int, text int")
    model = quality.train(odd, labels)
    rows = quality.score_documents(odd, model).collect()
    assert len(rows) == odd.count() and all((r.quality, r.toxicity, r.keep) == (0, 0, False) for r in rows if r.doc_id in (2, 3, 4)) and [r.keep for r in rows if r.doc_id == 5] == [True]
    kept = quality.filter_documents(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.keep}
    assert quality.filter_documents(empty, quality.train(empty, labels.limit(0))).count() == 0


# ---------------------------------------------------------------------- top-k
def brute(items, k):
    out = {}
    for i, a in items:
        near = sorted((bin((a ^ b) & (2**64 - 1)).count("1"), j, b) for j, b in items if (j, b) != (i, a))
        out.setdefault((i, a), [(d, j) for d, j, _ in near[:k]])
    return out


@pytest.mark.parametrize("n", [3, 40, 1300])
def test_exact_neighbours(spark, n):
    rng = random.Random(n)
    centres = [rng.getrandbits(64) for _ in range(5)]
    items = []
    for k in range(n):
        code = rng.choice(centres)
        for b in rng.sample(range(64), rng.randrange(12)):
            code ^= 1 << b
        items.append((k, code - 2**64 if code >= 2**63 else code))
    rows = topk.top_k(spark.createDataFrame(items, "vec_id long, code long"), 7).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.vec_id, []).append((r.distance, r.neighbour_id))
    assert got == {i: v for (i, _), v in brute(items, 7).items()}


def test_queries_are_searched_among_all(spark):
    rng = random.Random(9)
    items = [(k, rng.getrandbits(63)) for k in range(600)]
    codes = spark.createDataFrame(items, "vec_id long, code long")
    want = brute(items, 5)
    for condition, ids in ((topk.ASKED, range(0, 600, 100)), (F.col("vec_id") == 3, [3])):
        got = {}
        for r in sorted(topk.top_k(codes, 5, condition).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.vec_id, []).append((r.distance, r.neighbour_id))
        assert got == {i: v for (i, _), v in want.items() if i in ids}
    assert topk.top_k(codes, 5, "vec_id < 0").count() == 0 and not [t for t in spark.catalog.listTables() if t.name.startswith("topk_index")]


def test_odd_vectors(spark):
    rows = [(1, [1.0] * 64), (1, [1.0] * 64), (2, [1.0] * 63 + [None]), (None, [1.0] * 64), (3, None), (4, []), (5, [-1.0] * 64), (6, [float("nan")] * 64)]
    codes = topk.binary_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit("clash")))
    got = {(r.vec_id, r.neighbour_id): r.distance for r in topk.top_k(codes).collect()}
    assert got == {(a, b): d for a, b, d in [(1, 2, 1), (1, 5, 64), (1, 6, 64), (2, 1, 1), (2, 5, 63), (2, 6, 63), (5, 6, 0), (5, 2, 63), (5, 1, 64), (6, 5, 0), (6, 2, 63), (6, 1, 64)]}
    assert topk.top_k(codes.limit(0)).count() == 0 and topk.top_k(codes.where("vec_id = 5")).count() == 0
    other = topk.binary_codes(spark.createDataFrame([(1, [0.1, 0.5]), (2, [0.1, 0.5])], "vec_id long, embedding array<double>"))
    assert [r.distance for r in topk.top_k(other).collect()] == [0, 0]


# ---------------------------------------------------------------------- media
def test_round_trip(texts):
    for text in [*texts, "", "a", "\n\n", "x" * 70000 + "\ny", "é\n日本"]:
        data = media.write([x.encode() for x in text.split("\n")])
        packets, complete = media.parse(data)
        lines = [p for p in packets if p[0] == 1]
        assert complete and b"\n".join(data[p[9] : p[9] + p[10]] for p in lines).decode() == text
        assert [p[3] for p in lines] == [k * 40_000_000 for k in range(len(lines))]
        notes = [p for p in packets if p[0] == 2]
        assert [data[p[9] : p[9] + p[10]] for p in notes] == [str(k).encode() for k in range(len(notes))]
        assert all(p[11] == (p[7] == 0 and p[8] == 0) for p in lines if p[8] == 0)


def test_vints():
    for n in (0, 1, 126, 127, 16382, 16383, 2**21, 2**40):
        raw = media._size(n)
        assert media.vint(raw, 0, len(raw)) == (n, len(raw))
    assert media.vint(b"\xff", 0, 1) == (None, 1)


def test_all_lacings():
    frames = [b"a" * 300, b"b" * 5, b"c" * 700, b"d"]
    for kind in (1, 3):
        data = media._laced(frames, kind)
        assert [data[a : a + n] for a, n in media.lace(data, 0, len(data), kind)] == frames
    same = [b"12", b"34", b"56"]
    data = media._laced(same, 2)
    assert [data[a : a + n] for a, n in media.lace(data, 0, len(data), 2)] == same
    assert media.lace(b"xyz", 0, 3, 0) == [(0, 3)]


def test_unknown_sizes_and_elements():
    data = media.write([b"one", b"two", b"three"])
    at = data.index(struct.pack(">I", media.SEGMENT))
    size, start = media.vint(data, at + 4, len(data))
    live = data[: at + 4] + b"\x01" + b"\xff" * 7 + data[start:]
    known, _ = media.parse(data)
    packets, complete = media.parse(live)
    assert complete and [p[10] for p in packets] == [p[10] for p in known]
    # a cluster of unknown size ends at the next one
    cluster = struct.pack(">I", media.CLUSTER) + b"\xff" + media._number(media.TIMESTAMP, 5) + media._make(media.SIMPLE_BLOCK, b"\x81\x00\x01\x80x") + b"\xec\x82ab"
    head = media._make(media.EBML, b"")
    packets, complete = media.parse(head + struct.pack(">I", media.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster + cluster)
    assert complete and [p[3] for p in packets] == [6_000_000] * 2 and packets[0][1] is None


def test_broken_files_give_what_comes_before(texts):
    data = media.write([x.encode() for x in texts[0].split("\n")] * 30)
    whole, _ = media.parse(data)
    rng = random.Random(6)
    for cut in rng.sample(range(len(data)), 60):
        packets, complete = media.parse(data[:cut])
        assert not complete and [p[:11] for p in packets] == [p[:11] for p in whole[: len(packets)]]
    for _ in range(400):
        bad = bytearray(data[:4000])
        bad[rng.randrange(len(bad))] = rng.randrange(256)
        media.parse(bytes(bad))


def packets_of(files):
    """Rows of the Arrow step over (doc_id, media)."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(files)), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "media"])
    return [r for b in media._parse_batches(iter([batch])) for r in b.to_pylist()]


def test_no_bytes_break_the_table(texts):
    data = media.write([x.encode() for x in texts[0].split("\n")] * 30)[:4000]
    rng = random.Random(7)
    for _ in range(60):
        files = []
        for _ in range(50):
            bad = bytearray(data)
            for _ in range(rng.choice([1, 1, 3])):
                bad[rng.randrange(len(bad))] = rng.randrange(256)
            files.append(bytes(bad))
        packets_of(files)
    packets_of([rng.randbytes(rng.randrange(200)) for _ in range(500)])


def test_a_file_written_by_hand():
    """Byte for byte after the format's specification, with ticks of 500,000 ns."""

    def block(body):
        return bytes([0xA3, 0x80 | len(body)]) + body

    xiph = bytes.fromhex("83 fff6 02 02 02 01 6161 62 63636363")  # three frames, of 2, 1 and the rest, 10 ticks early
    ebml = bytes.fromhex("83 0005 86 02 82 c0 6161 626262 6363")  # 2, one more, and the rest; a key frame
    fixed = bytes.fromhex("83 0000 04 01 6161 6262")  # two of two bytes
    group = bytes.fromhex("a0 8c a1 85 83 0007 00 78 9b 81 06 fb 80")  # one frame of 6 ticks that refers to another
    cluster = bytes.fromhex("e7 81 64") + block(xiph) + block(ebml) + block(fixed) + group
    head = bytes.fromhex("1a45dfa3 80 18538067 01ffffffffffffff 1549a966 87 2ad7b1 83 07a120 1654ae6b 4010 ae 8e d7 81 03 83 81 02 86 86 415f4f505553 ec 82 0000")
    data = head + bytes.fromhex("1f43b675") + bytes([0x80 | len(cluster)]) + cluster
    rows = packets_of([data])
    frames = [data[r["offset"] : r["offset"] + r["size"]] for r in rows]
    assert frames == [b"aa", b"b", b"cccc", b"aa", b"bbb", b"cc", b"aa", b"bb", b"x"]
    assert all(r["complete"] and (r["track"], r["track_type"], r["codec"]) == (3, 2, "A_OPUS") for r in rows)
    assert [r["timestamp_ns"] // 500_000 for r in rows] == [90] * 3 + [105] * 3 + [100] * 2 + [107]
    assert [r["keyframe"] for r in rows] == [False] * 3 + [True] * 3 + [False] * 3 and rows[8]["duration_ns"] == 3_000_000
    assert {r["cluster"] for r in rows} == {len(head) - 17} and [r["block"] for r in rows] == [0] * 3 + [1] * 3 + [2] * 2 + [3]


@pytest.mark.parametrize("what", ["type", "time", "scale", "long"])
def test_numbers_out_of_range(what):
    n = media._number
    track = media._make(media.TRACK_ENTRY, n(media.TRACK_NUMBER, 1) + n(media.TRACK_TYPE, 2**33 if what == "type" else 17))
    info = media._make(media.INFO, n(media.SCALE, 2**62 if what == "scale" else 1_000_000))
    stamp = media._make(media.TIMESTAMP, b"\xff" * 8 if what == "time" else b"\0" * 9 if what == "long" else b"\5")
    cluster = media._make(media.CLUSTER, stamp + media._make(media.SIMPLE_BLOCK, b"\x81\0\x01\x80x"))
    data = media._make(media.EBML, b"") + media._make(media.SEGMENT, info + media._make(media.TRACKS, track) + cluster)
    good = media._make(media.EBML, b"") + media._make(media.SEGMENT, media._make(media.CLUSTER, n(media.TIMESTAMP, 5) + media._make(media.SIMPLE_BLOCK, b"\x81\0\x01\x80x")))
    rows = packets_of([data, good, None, b""])
    assert [r["doc_id"] for r in rows] == [1] and rows[0]["complete"]


def test_media_tables(spark, odd, empty):
    files = media.text_media(odd)
    assert files.where("media is null").count() == 2
    rows = media.matroska_packets(files).collect()
    assert sum(r.track == 1 for r in rows if r.doc_id == 1) == 5 and not [r for r in rows if r.doc_id in (2, 3)]
    assert all(r.complete and r.codec for r in rows)
    raw = spark.createDataFrame([(1, b""), (2, b"not media"), (3, None)], "doc_id long, media binary").withColumn("track", F.lit(9))
    assert media.matroska_packets(raw).count() == 0 and media.matroska_packets(media.text_media(empty)).count() == 0


# ------------------------------------------------------------------- pipeline
def test_pipeline_stages(spark):
    """Each stage on what the one before kept of a whole table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialise(stage(spark, docs, DATA), f"test-{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert k == 4 or docs.columns == columns
    clean = {d for d, r in labels.items() if r.quality and not r.toxic}
    assert len(clean & kept[0]) > 0.97 * len(clean) and not [d for d, r in labels.items() if not r.quality and d in kept[0]][3:]
    assert kept[0] >= kept[1] >= kept[2] == kept[3] == kept[4]
    assert docs.columns == ["window", "doc_id", "start", "n_tokens"]


@pytest.fixture(scope="module")
def small(spark, docs, texts, tmp_path_factory):
    """A folder with ``documents`` and ``labels`` for the pipeline: junk is poor."""
    base = tmp_path_factory.mktemp("small")
    junk = spark.createDataFrame([(1000 + k, "$$ | 0 || " * 40, "en", "src0", 400) for k in range(40)], docs.schema)
    corpus_pipeline.materialise(docs.union(junk), "small").coalesce(1).write.parquet(f"{base}/documents.parquet")
    labels = [(k, 1, 0) for k in range(len(texts))] + [(1000 + k, 0, 0) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_pipeline_against_brute_force(spark, small, texts):
    """Every stage's rows against versions without Spark, on their own inputs."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    run = lambda k, docs: corpus_pipeline.materialise(corpus_pipeline.STAGES[k][1](spark, docs, small), f"brute-{k}")
    text_of = lambda df: {r.doc_id: r.text for r in df.collect()}

    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    kept = run(0, docs)
    for d, t in text_of(docs).items():
        x = quality.features([t], model["listed"])
        good = []
        for part in ("quality", "toxic"):
            m = model[part]
            score = m.base + sum(w[int((e <= v).sum())] for w, e, v in zip(m.tables, m.edges, x[0])) + sum(w[int((m.coarse[i] <= x[0][i]).sum()), int((m.coarse[j] <= x[0][j]).sum())] for (i, j), w in zip(m.pairs, m.pair_tables))
            good.append(1 / (1 + np.exp(-score)))
        assert (d in text_of(kept)) == (good[0] >= quality.THRESHOLD and good[1] < quality.THRESHOLD)
    assert set(text_of(kept)) == set(range(len(texts)))

    lines = run(1, kept)
    gone = brute_lines(texts)
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in enumerate(texts)}
    got = text_of(lines)
    assert set(got) >= {d for d, t in want.items() if t.strip()}
    assert sum(got[d] == want[d] for d in got) >= 0.97 * len(got)

    near = run(2, lines)
    order = sorted(got)
    dropped = brute_simhash(simhash.fingerprints([got[d] for d in order]))
    assert set(text_of(near)) == {d for k, d in enumerate(order) if k not in dropped}

    mixed = run(3, near)
    left = text_of(near)
    words = {d: len(t.split()) for d, t in left.items()}
    total = {s: sum(n for d, n in words.items() if d % 3 == s) for s in range(3)}
    high, low = max(total.values()), min(total.values())
    exponent = max(0.0, 1 - math.log(corpus_pipeline.MAX_REPEATS) / math.log(high / low)) if high > 2 * low else 0.0
    drawn = [r.doc_id for r in mixed.select("doc_id").collect()]
    for s in range(3):
        quota = high * (total[s] / high) ** exponent
        assert quota - 1 <= sum(words[d] for d in drawn if d % 3 == s) < quota + 1 + max(words.values())
        times = {drawn.count(d) for d in left if d % 3 == s}
        assert max(times) - min(times) <= 1 and min(times) >= 1

    windows = run(4, mixed).collect()
    held, pieces = {}, {}
    for r in windows:
        held[r.window] = held.get(r.window, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    size = {d: len(encoder().encode_plain(t)) for d, t in left.items()}
    assert max(held.values()) <= 4096
    for d in left:
        once = [(a, min(4096, size[d] - a)) for a in range(0, size[d], 4096)]
        assert sorted(pieces[d]) == sorted(once * drawn.count(d))
    # one group: the fewest windows that differencing can fill
    sizes = [n for own in pieces.values() for _, n in own]
    assert len(held) == len(packing.pack_group(sizes, 4096))


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_stages_on_odd_tables(spark, small, odd, empty, which, tmp_path):
    """NULLs, blanks, repeats and long texts, and no rows at all, through all stages."""
    rows = {"odd": odd, "empty": empty}[which]
    names = [f"TEXT_{k}" if k == 8 else c for k, c in enumerate(odd.columns)]  # Parquet can't be read with both names
    docs = corpus_pipeline.materialise(rows.toDF(*names), "odd")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if k == 0:  # the classifier keeps no blank text; the other stages get them all
            kept = corpus_pipeline.materialise(stage(spark, docs, small), "odd-0")
            assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {1, None, 5, 6, 7, 8}
            continue
        docs = corpus_pipeline.materialise(stage(spark, docs, small), f"odd-{k}")
        if k < 4:
            assert docs.columns == names
    got = {r.doc_id for r in docs.collect()}
    assert got == ({1, None, 4, 5, 8} if which == "odd" else set())
