"""Operators of the training-data pipeline against the libraries, DuckDB or brute force, and on odd rows."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gistmill.llm import binary, blocks, bpe, entry, jaccard, langmodel, linecrf, lines, mixing, quality, rankmerge, vectors

DATA = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, id long, kept string"
ODD = [
    (1, "Hello  wörld <|endoftext|>x don't\x1cq ΑΣ é aaaa hahahahaha", "en", "b", 1, "x", 1, None),
    (2, None, None, None, None, None, None, None),
    (None, "", "en", "a", 0, "x", 1, "k"),
    (4, "   ", "en", "a", 0, "x", 1, "k"),
    (4, "日本語 áb 12 <|startoftext|><|endoftext|>\n\n \xa0 x", "en", None, 3, "x", 1, "k"),
    (4, "日本語 áb 12 <|startoftext|><|endoftext|>\n\n \xa0 x", "en", None, 3, "x", 1, "k"),
    (5, "x" * 3000 + " " + "ab " * 20_000, "fr", "c", 9, "x", 1, "k"),
    (6, "a  b \n  c\n\n  d \n e\t\tf  ", "de", "c", 9, "x", 1, "k"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def both(odd, docs):
    return ((odd, [(r[0], r[1]) for r in ODD]), (docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd.limit(0), []))


def test_packing_round_trips():
    rng = np.random.default_rng(1)
    for a in (np.empty(0, np.int64), rng.integers(-9, 2**60, 1000), np.arange(7, dtype=np.uint8)):
        assert (blocks.unpack(blocks.pack(a))[0] == a).all()
    for codes in (np.empty(0, np.int32), rng.integers(0, 200_000, 300_000).astype(np.int32), (rng.pareto(0.3, 50_000) % 99_999).astype(np.int32)):
        assert (blocks.unpack_codes(*blocks.unpack(blocks.pack(*blocks.pack_codes(codes)))) == codes).all()


def test_op1_equals_the_library(odd, docs):
    tok = Tokenizer.from_file(WORD)
    for df, given in both(odd, docs):
        want = []
        for i, t in given:
            ids = tok.encode(t or "", add_special_tokens=False).ids
            text = tok.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert rows(bpe.op1(df, WORD)) == sorted(want, key=repr)
        apart = bpe.decode(bpe.encode(df, WORD), WORD)
        assert rows(apart) == rows(bpe.encode(df, WORD, decoded=True))


def test_op1_with_small_blocks(docs, monkeypatch):
    want = rows(bpe.op1(docs, WORD))
    monkeypatch.setattr(bpe, "CALL_WORDS", 7)
    docs.sparkSession.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(bpe.op1(docs.repartition(5), WORD)) == want
    finally:
        docs.sparkSession.conf.set("spark.sql.shuffle.partitions", "4")


def duck(sql, frame=None):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'") if frame is None or t != "documents" else con.register(t, frame)
    return con.execute(sql)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_queries_equal_sql(spark, name):
    got = entry.queries()[name](spark, DATA)
    res = duck(entry.oracle_sql()[name])
    at = [[d[0] for d in res.description].index(c) for c in got.columns]
    assert rows(got) == sorted((tuple(r[k] for k in at) for r in res.fetchall()), key=repr)


def test_op2_on_odd_rows(odd):
    got = {(r.doc_id, r.n_words): r for r in quality.op2(odd).collect()}
    assert got[(2, 0)].kept is False and got[(None, 0)].base_failed and not got[(4, 0)].kept
    long = got[(5, 20_001)]
    assert long.n_repeat_words == 20_000 and long.word_chars == 43_000 and long.base_failed
    assert got[(1, 8)].n_symbols == 4 and quality.op2(odd.limit(0)).count() == 0


def test_op2_counts_stop_words_in_any_form(spark, odd):
    text = " ".join(["The,", "(AND)", "«dans»", "of", "wall", "theory", "x-the"] * 12)
    got = quality.rules(spark.createDataFrame([(1, text)], "doc_id long, text string"), table=(quality.Rule("stop_words", "stop_ratio", 48 / 84, 48 / 84),)).first()
    assert not got.failed_stop_words and got.kept is False and got.base_failed
    named = odd.withColumnRenamed("ids", "_m").withColumnRenamed("id", "n_words")
    out = quality.rules(named, keep=("doc_id", "_m", "n_words", "kept"))
    assert out.columns[:4] == ["doc_id", "_m", "kept_n_words", "kept_kept"] and out.where("_m = 'x'").count() == 7 and out.where("n_words = 8").count() == 1


def repeated_brute(words):
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    return len({k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)})


def test_op2_counts_repeats(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (0, 1, 3, 4, 5, 8, 20, 60, 200)] + ["a b c a b c", "a a a a", "x a b c y a b c z"]
    got = {r.text: r.n for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", quality.repeated_words(quality.words_of(F.col("text"))).alias("n")).collect()}
    assert got == {t: repeated_brute(t.split()) for t in texts}


def test_op2_keeps_good_and_drops_bad(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op2(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n[(1, True)] >= 0.98 * (n[(1, True)] + n.get((1, False), 0)) and n.get((0, True), 0) <= 0.1 * n[(0, False)]


def test_op2_plan_is_native(docs):
    for df in (quality.op2(docs), lines.op7(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_op3_equals_the_library(odd, docs):
    tok = Tokenizer.from_file(BYTE)
    for df, given in both(odd, docs):
        want, start = [], 0
        for i, t in sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
            want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            start += len(ids)
        assert sorted(map(tuple, binary.op3(df, BYTE).collect()), key=lambda r: r[1]) == want


def test_op3_pieces_equal_the_pattern():
    pattern = re.compile(rb" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+(?= [^ \t-\r])|[ \t-\r]+")
    rng = np.random.default_rng(14)
    letters = np.frombuffer(b"ab  \t\n\r\x1c\xc2", np.uint8)
    given = [[], [b""], [b"", b""], [b"a", b"", b"b"], [b" ", b"x"], [b"x", b" y"], [b"x ", b"y"], [b"\n", b"\n"]]
    for texts in given + [[rng.choice(letters, int(rng.integers(0, 10))).tobytes() for _ in range(int(rng.integers(1, 5)))] for _ in range(1000)]:
        want = [pattern.findall(raw) for raw in texts]
        counts, codes, pieces = binary.cut(texts)
        assert counts.tolist() == [len(x) for x in want] and [pieces[k] for k in codes] == [p for x in want for p in x]


def test_op3_chunks_hold_all_texts_in_order(docs, monkeypatch):
    want = rows(binary.op3(docs, BYTE))
    monkeypatch.setattr(binary, "CHUNK_BYTES", 10)
    given = [b"", b"x" * 30, b"", b"abc", b"de", b"fghijk", b""]
    assert [t for c in binary.chunks(given) for t in c] == given and all(sum(map(len, c)) <= 10 or len(c) == 1 for c in binary.chunks(given) if c[0] != b"")
    small = binary.Pieces(BYTE)
    apart = [x for c in binary.chunks([(r.text or "").encode() for r in docs.collect()]) for x in small.encode(c)]
    assert sorted(len(x) + 1 for x in apart) == sorted(r[2] for r in want)


def test_shards_unpack_at_random(monkeypatch):
    rng = np.random.default_rng(3)
    for width in (1, 5, 8, 13, 16, 17, 32):
        ids = rng.integers(0, 2**width, 9999)
        shard = binary.Shard(binary.write_shard([7, None], np.array([4000, 5999]), ids, width))
        assert (shard.document(0) == ids[:4000]).all() and (shard.document(1) == ids[4000:]).all()
        for at, n in ((0, 0), (4095, 2), (4096, 1), (9998, 1), (17, 8000)):
            assert (shard.slice(at, n) == ids[at : at + n]).all()
    assert [binary.bit_width(v) for v in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_many_small_shards(docs, monkeypatch):
    want = rows(binary.op3(docs, BYTE))
    shard = binary.shards
    monkeypatch.setattr(binary, "SHARD_IDS", 500)
    path = binary.shared_dir(docs.sparkSession) + "/small"
    shard(docs, BYTE).write.mode("overwrite").parquet(path)
    got = binary.read_tokens(docs.sparkSession, path)
    assert rows(got.select("doc_id", "start", "n_tokens", F.crc32("ids"))) == want


def test_shards_are_read_where_they_lie(spark, docs):
    """Whatever their size: only the places of the ranges move."""
    path = binary.shared_dir(spark) + "/in_place"
    binary.shards(docs, BYTE).write.mode("overwrite").parquet(path)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = binary.read_tokens(spark, path)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert not any("Exchange hashpartitioning" in line and "data" in line for line in plan.splitlines())
        assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()) == sorted(tuple(r) for r in binary.op3(docs, BYTE).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_op4_tells_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    few = docs.where("doc_id < 3000")
    got = linecrf.op4(few, labels).join(labels, "doc_id").where("held_out")
    right = got.where("predicted = quality").count() / got.count()
    assert right > 0.97


def test_op4_on_odd_rows(spark, odd):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = linecrf.op4(odd, labels)
    assert got.count() == len(ODD) and got.where("score is null or score < 0 or score > 1").count() == 0
    assert {r.score for r in linecrf.op4(odd, labels.limit(0)).collect()} == {0.5} and linecrf.op4(odd.limit(0), labels).count() == 0
    held = {r.doc_id: r.held_out for r in got.collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())
    carried = linecrf.with_scores(odd, (np.zeros(60), np.zeros((2, 2))), name="s")
    assert carried.columns == [*odd.columns, "s"]


def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    unary, pair, lengths = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([4, 1, 4])
    good, both = linecrf.Chains(lengths).marginals(unary, pair)
    want, edges, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        p = {}
        for k in range(2**n):
            y = [k >> j & 1 for j in range(n)]
            p[tuple(y)] = math.exp(sum(u * s for u, s in zip(unary[at : at + n], y)) + sum(pair[a, b] for a, b in zip(y, y[1:])))
        z = sum(p.values())
        want += [sum(v for y, v in p.items() if y[j]) / z for j in range(n)]
        for y, v in p.items():
            for a, b in zip(y, y[1:]):
                edges[a, b] += v / z
        at += n
    assert np.allclose(good, want) and np.allclose(both, edges)


def water(sizes, weights, total, most):
    """Targets by capping and resharing until none is above its cap."""
    target, open_ = {}, set(sizes)
    while open_:
        rest = total - sum(target.values())
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if rest * weights[s] / w > most * sizes[s]}
        if not over:
            return target | {s: rest * weights[s] / w for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_op5_meets_targets(odd, docs):
    for df in (odd, docs):
        given = [(r.doc_id, r.text, r.source) for r in df.collect()]
        sizes = Counter()
        for _, t, s in given:
            sizes[s] += len((t or "").encode().split())
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = water({s: sizes[s] for s in order}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
        got = mixing.mix(df, carry=("source",)).select("doc_id", "size", "source_size", "target", "taken", "row.c0").collect()
        assert len(got) == len(given)
        taken, largest = Counter(), Counter()
        for r in got:
            assert r.source_size == sizes[r.c0] and abs(r.target - want[r.c0]) < 1e-6 * max(1, want[r.c0]) and 0 <= r.taken <= 2 * r.size
            taken[r.c0] += r.taken
            largest[r.c0] = max(largest[r.c0], r.size)
        assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
        assert rows(mixing.op5(df)) == rows(mixing.op5(df.repartition(3)))
    assert mixing.op5(odd.limit(0)).count() == 0


def test_op5_takes_by_ascending_keys(spark):
    rng = np.random.default_rng(12)
    given = [(k if k % 9 else None, ("w " * int(rng.integers(0, 40))) + ("12 # " * int(rng.integers(0, 9))) + f"t{k}", "abc"[int(rng.integers(0, 3))]) for k in range(700)]
    df = spark.createDataFrame(given, "doc_id long, text string, source string")
    keyed = df.select("*", mixing.key_of(F.col("doc_id"), F.col("text"), mixing.quality_of(F.col("text"))).alias("key"), F.xxhash64("text").alias("tie")).collect()
    got = {r.row.c0: r for r in mixing.mix(df, carry=("text",)).collect()}
    for source in "abc":
        own = sorted((r for r in keyed if r.source == source), key=lambda r: (r.key, r.doc_id is not None, r.doc_id or 0, r.tie))
        sizes = [len(r.text.split()) for r in own]
        whole, at = int(got[own[0].text].target // sum(sizes)), 0
        rest = got[own[0].text].target - whole * sum(sizes)
        for r, n in zip(own, sizes, strict=True):
            assert got[r.text].taken == n * (whole + (n > 0 and at + n / 2 <= rest)) and got[r.text].size == n
            at += n


@pytest.mark.parametrize("quality", [1.0, 0.3, 0.05])
def test_op5_bins_spread_any_quality(spark, quality):
    keys = spark.range(200_000).select(mixing.bin_of(mixing.key_of(F.col("id"), F.lit("x"), F.lit(quality))).alias("bin"))
    top = keys.groupBy("bin").count().agg(F.max("count")).first()[0]
    assert top <= 12 * 200_000 / mixing.BINS + 40


def test_op5_prefers_quality(spark):
    rng = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.lit("a").alias("source"), (F.col("id") % 2).alias("good"))
    one = rng.unionByName(spark.createDataFrame([(9999, "w " * 80_000, "b", 0)], rng.schema))
    got = mixing.mix(one, carry=("good",), quality=F.when(F.col("good") == 1, 1.0).otherwise(0.2)).where("row.c0 is not null and size = 2").groupBy("row.c0").agg(F.sum("taken").alias("t")).collect()
    taken = {r.c0: r.t for r in got}
    assert taken[1] >= taken[0]


def brute_links(x, threshold=0.95):
    g = x @ x.T >= threshold
    np.fill_diagonal(g, False)
    i, j = np.nonzero(g)
    return g.sum(axis=1), vectors.local_roots(len(x), i, j)


def test_op6_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base, base[:40] + rng.normal(size=(40, 24)) * 0.18, np.repeat(base[:1], 30, axis=0) + rng.normal(size=(30, 24)) * 0.05, base[5:8]]).astype(np.float32)
    ids = rng.permutation(len(x)) * 3
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, rid string")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    n, root = brute_links(u)
    smallest = {}
    for k, r in enumerate(root):
        smallest[r] = min(smallest.get(r, 10**9), int(ids[k]))
    want = sorted((int(ids[k]), int(n[k]), smallest[root[k]], int(ids[k]) == smallest[root[k]]) for k in range(len(x)))
    assert n.sum() > 500
    for band, tile in ((65_536, 8192), (40, 16), (9, 4)):
        monkeypatch.setattr(vectors, "BAND", band), monkeypatch.setattr(vectors, "TILE", tile)
        assert sorted(map(tuple, vectors.near_vectors(df).collect())) == want


def test_op6_folds_links_of_equal_vectors():
    """All of 6,000 rows alike, in two bands: 18 million links, of which no more than a square's are held."""
    import tracemalloc

    import pyarrow as pa

    unit = np.zeros((6000, 16))
    unit[:, 0] = 1.0
    rids = np.random.default_rng(8).permutation(6000).astype(np.int64)
    sides = [{"pair": "0-1", "number": k // 2, "tile": k % 2, "crossed": True, "rids": rids[k * 1500 : (k + 1) * 1500].tobytes(), "v": unit[:1500].tobytes()} for k in range(4)]
    batch = pa.RecordBatch.from_pylist(sides)
    tracemalloc.start()
    out = next(vectors.compare(np.eye(16), 0.95)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(out.column("n").to_pylist()) == {3000} and set(out.column("root").to_pylist()) == {0} and out.num_rows == 6000
    assert peak < 120_000_000


def test_op6_on_odd_rows(spark):
    x = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (None, [2.0, 4.0]), (7, [1.0, 2.0, 0.0]), (8, []), (9, [-1.0, 0.0]), (10, [float("inf"), 1.0])], "vec_id long, embedding array<float>")
    got = rows(vectors.near_vectors(x))
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 3, 5, True), (5, 3, 5, True), (None, 3, 5, True), (7, 3, 5, False), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True)], key=repr)
    assert vectors.near_vectors(x.limit(0)).count() == 0 and vectors.near_vectors(x.where("vec_id = 1")).collect()[0].kept


def kept_brute(given):
    def key(line):
        s = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)

    held = defaultdict(set)
    for i, t in given:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    hot = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    return [(i, len((t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if hot.get(key(x), i) == i)) for i, t in given]


def test_op7_equals_brute_force(spark, odd):
    a, b = "This line of forty or more characters is a hot one", "é" * 40
    given = [(k, f"own {k}\n {a.upper() if k % 2 else a}\t\n{b}\n{b}" if k % 3 else f"{a[:39]}\n{b}") for k in range(12)] + [(0, a), (3, None)]
    got = lines.dedup_lines(spark.createDataFrame(given, "doc_id long, text string"))
    assert rows(got.select("doc_id", "n_lines", "kept_text")) == sorted(kept_brute(given), key=repr)
    again = rows(lines.dedup_lines(odd).select("doc_id", "n_lines", "kept_text"))
    assert again == sorted([(i, len((t or "").split("\n")), t or "") for i, t, *_ in ODD], key=repr) and lines.op7(odd.limit(0)).count() == 0


def jaccard_brute(given, threshold=0.8):
    sets = []
    for _, t in given:
        w = (t or "").encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    n = Counter(x for l in links for x in l)
    i, j = (np.array([l[k] for l in links], np.int64) for k in (0, 1))
    return [n[k] for k in range(len(sets))], vectors.local_roots(len(sets), i, j)


def near_texts():
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(400)]
    out = []
    for g in range(12):
        base = rng.choice(words, 120).tolist()
        for _ in range(1 + 4 * g):
            t = list(base)
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(0, 120))] = "new"
            out.append(" ".join(t))
    return [(100 + k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("tile", [2048, 7])
def test_op8_equals_brute_force(spark, docs, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    for given in (near_texts(), [(r.doc_id, r.text) for r in docs.collect()]):
        n, root = jaccard_brute(given)
        smallest = {}
        for k, r in enumerate(root):
            smallest[r] = min(smallest.get(r, 10**12), given[k][0])
        want = sorted((i, smallest[root[k]], n[k]) for k, (i, _) in enumerate(given))
        got = jaccard.join(spark.createDataFrame(given, "doc_id long, text string"))
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == want


def test_op8_on_odd_rows(spark, odd):
    x = spark.createDataFrame([(1, None), (None, "a b"), (3, "a b"), (None, "a b"), (4, "a  b"), (5, ""), (6, "x y z w v u t s r q p"), (None, "q q"), (7, "x y z w v u t s r q p o")], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in jaccard.join(x).collect() if r.doc_id is not None)
    assert got == [(1, 1, 0, True), (3, 3, 3, True), (4, 3, 3, False), (5, 5, 0, True), (6, 6, 1, True), (7, 6, 1, False)]
    assert jaccard.join(odd).count() == len(ODD) and jaccard.join(odd.limit(0)).count() == 0


def test_op8_shortens_prefixes_on_the_links_found():
    assert jaccard.shortest_prefix(0.8) == 4 and jaccard.recall(0.8, 4) > 0.9999 > jaccard.recall(0.8, 5)
    close, far = np.zeros(jaccard.BINS), np.zeros(jaccard.BINS)
    close[-2], far[0] = 1000, 1000
    assert jaccard.next_prefix(close, 8, 0.8) == 8 and jaccard.next_prefix(far, 8, 0.8) == 4
    assert jaccard.next_prefix(close + far / 1e6, 8, 0.8) == 8 and jaccard.next_prefix(np.zeros(jaccard.BINS), 8, 0.8) == 4
    assert jaccard.next_prefix(far, 8, 0.8, 0.99) == 7


def test_op8_counts_a_pair_of_several_trees_once(spark):
    base = [f"w{k}" for k in range(300)]
    given = [(k, " ".join([*base, f"x{k}"])) for k in range(1300)]  # more than a tile, all pairs linked in all trees
    got = jaccard.join(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 1299)}


def test_op9_equals_counts(spark, docs, odd):
    for df, given in both(odd, docs):
        toks = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in given]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        c = Counter(w for i, ws in toks if not held(i) for w in ws)
        n, v = sum(c.values()), len(c)
        want = [(i, held(i), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in toks]
        got = langmodel.score(df).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
        assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
        if len(got) > 100:
            assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def lm_brute(given):
    """The score of each document by plain counting; weights by the same EM over cells made one token at a time."""
    toks = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in given]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    one, two, three = Counter(), Counter(), Counter()

    def grams(ws):
        for k, w in enumerate(ws):
            yield (ws[k - 2] if k > 1 else b"\n", ws[k - 1], w) if k else None, (ws[k - 1] if k else b"\n", w), w

    for i, ws in toks:
        if not held(i):
            for g3, g2, g1 in grams(ws):
                one[g1] += 1
                two[g2] += 1
                three[g3] += g3 is not None
    n, v = sum(one.values()), len(one)

    def parts(g3, g2, g1, less):
        c3, b3 = (three[g3] - less, two[g3[:2]] - less) if g3 else (0, 0)
        b2 = one[g2[0]] - less
        return b3, b2, c3 / b3 if b3 > 0 else 0.0, (two[g2] - less) / b2 if b2 > 0 else 0.0, (one[g1] - less) / max(n - less, 1)

    found = Counter()
    for i, ws in toks:
        if not held(i):
            for g in grams(ws):
                b3, b2, *p = parts(*g, 1)
                found[int(langmodel.cell_of(langmodel.bucket_of(np.array([b3]), np.array([b2])), *(np.array([x]) for x in p))[0])] += 1
    w = langmodel.learn(np.array(list(found), np.int64), np.array(list(found.values()), np.float64), v)
    out = []
    for _, ws in toks:
        total = 0.0
        for g in grams(ws):
            b3, b2, *p = parts(*g, 0)
            k = int(langmodel.bucket_of(np.array([b3]), np.array([b2]))[0])
            total += math.log10(w[k] @ np.array([*p, 1 / (v + 1)]))
        out.append(total)
    return out


@pytest.mark.parametrize("size", [10_000_000, 300])
def test_op9_scores_equal_brute_force(spark, odd, monkeypatch, size):
    monkeypatch.setattr(langmodel, "BLOCK_BYTES", size)
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 60)), p=np.arange(8, 0, -1) / 36)) for _ in range(90)]
    given = [(k, t) for k, t in enumerate(texts)] + [(90, None), (91, "A a a A b"), (92, "never seen words never seen"), (93, "never seen words here")]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in langmodel.score(df).collect()}
    assert np.allclose([got[i] for i, _ in given], lm_brute(given), atol=1e-9)
    rows_odd = [(r[0], r[1]) for r in ODD]
    assert np.allclose(sorted(r.score for r in langmodel.score(odd).collect()), sorted(lm_brute(rows_odd)), atol=1e-6)


def test_op9_codes_equal_split():
    rng = np.random.default_rng(11)
    letters = np.frombuffer("aAb \t\n\v\f\r\x1c\x00\u00a0\u00c4".encode(), np.uint8)
    given = [[b""], [b"", b""], [b" A b\x0bA ", b"", b"a"], [b"\n\n", b"x\n"]] + [[rng.choice(letters, int(rng.integers(0, 12))).tobytes() for _ in range(int(rng.integers(1, 5)))] for _ in range(500)]
    for texts in given:
        table = blocks.Codes()
        table[b"\n"]
        toks = [raw.lower().split() + [b"\n"] for raw in texts]
        codes = [table[w] for ws in toks for w in ws]
        lengths, got, words = langmodel.coded(texts)
        assert (lengths.tolist(), got.tolist(), words) == ([len(ws) for ws in toks], codes, list(table))


def test_op9_distinct_and_placed_equal_plain_sorts():
    rng = np.random.default_rng(12)
    for bound in (1, 3, 1000, 2**40, 2**62):
        for n in (0, 1, 50):
            keys = rng.integers(0, bound, n)
            for x, want in zip(langmodel.distinct(keys, bound), np.unique(keys, return_inverse=True), strict=True):
                assert (x == want).all()
    for n in (0, 1, 5, 50):
        h = rng.integers(0, 2**64, n, dtype=np.uint64)
        for twin in (0, 1, 2):  # equal, and different in the lowest bits alone
            if n > 3:
                h[1], h[3] = h[2] ^ np.uint64(twin), h[0] ^ np.uint64(twin)
            order, cuts = langmodel.placed(h, 7)
            assert (order == np.argsort(h, kind="stable")).all() and (cuts[0], cuts[-1]) == (0, n)


def test_op9_sorts_no_positions_of_all_tokens(monkeypatch):
    """Sorting the positions of a block's tokens by key took a third of the time; keys with their positions are sorted."""
    import pyarrow as pa

    rng = np.random.default_rng(13)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, 100)).encode() for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts, pa.binary())], names=["id", "text"])
    sizes, unique = [0], np.unique
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: (sizes.append(len(x)), unique(x, *a, **k))[1])
    made = list(langmodel.split_blocks(7, 2)(iter([batch])))
    assert sum(len(x) for x in made) == 1
    own = langmodel.Block(made[0].column("payload")[0].as_py())
    own.pair_all = np.full(len(own.first), 10**6)
    own.triples()
    tri, pair, at = own.tokens()
    assert max(sizes) <= len(texts) and len(at) == 40 * 101
    starts = np.cumsum(own.lengths) - own.lengths
    assert (pair[at] == own.at).all() and (tri[at] == own.tri_at).all() and set(np.flatnonzero(tri[at] < 0)) == set(starts)


def test_op9_probabilities_sum_to_one():
    """Over all words and the unknown one, for seen and unseen contexts."""
    total, vocabulary = 10, 4
    rng = np.random.default_rng(10)
    cell = rng.integers(0, 2 * langmodel.CONTEXTS * langmodel.BINS**2 * langmodel.WORD_BINS, 400)
    w = langmodel.learn(cell, rng.random(400) * 9, vocabulary)
    triple, pair, count = {"a": 2}, {"a": 2, "b": 1}, {"a": 5, "b": 3, "c": 1, "d": 1}
    for before, context, t, b in ((2, 3, triple, pair), (0, 3, {}, pair), (0, 0, {}, {})):
        k = langmodel.bucket_of(np.array([before]), np.array([context]))[0]
        p = [w[k, 0] * t.get(x, 0) / max(before, 1) + w[k, 1] * b.get(x, 0) / max(context, 1) + w[k, 2] * count.get(x, 0) / total + w[k, 3] / (vocabulary + 1) for x in "abcd?"]
        assert abs(sum(p) - 1) < 1e-12


def test_op10_equals_the_library(odd, docs):
    tok = Tokenizer.from_file(WORD)
    for df, given in both(odd, docs):
        want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in given]
        assert rows(rankmerge.op10(df, WORD)) == sorted(want, key=repr)


def test_op10_long_words_equal_the_library(monkeypatch):
    tok = Tokenizer.from_file(WORD)
    rng = np.random.default_rng(13)
    words = ["a" * n for n in (2, 3, 7, 50, 51)] + ["".join(rng.choice(list("etaoinsh"), n)) for n in (5, 40, 300, 2500)] + ["hahaha" * 30 + "ha"]
    want = [len(tok.encode(w, add_special_tokens=False).ids) for w in words]
    assert rankmerge.word_counts(words, WORD).tolist() == want
    monkeypatch.setattr(rankmerge, "LONG", 1)
    assert rankmerge.word_counts(words, WORD).tolist() == want
    huge = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 300_000))
    assert 60_000 < rankmerge.word_counts([huge], WORD)[0] < 300_000


def stage_brute(spark, rows, path):
    """What the stages after the classifier must keep of some rows, by plain Python: line dedup, then one of each near group."""
    kept = kept_brute([(r[0], r[1]) for r in rows])
    n, root = jaccard_brute([(i, t) for i, _, t in kept])
    low = {}
    for k, r in enumerate(root):
        low[r] = min(low.get(r, 10**12), kept[k][0])
    return {(i, t) for k, (i, _, t) in enumerate(kept) if low[root[k]] == i}


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline

    line = "This line of forty or more characters is in many documents"
    rows = [(k, f"{t}\n{line}" if k % 2 else t, "en", "a", None, k) for k, t in near_texts()[:60]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra long")
    stages = dict(corpus_pipeline.STAGES)
    after = stages["line_dedup"](spark, docs, DATA)
    assert {(r.doc_id, r.text, r.n_chars) for r in after.collect()} == {(i, t, len(t)) for i, _, t in kept_brute([(r[0], r[1]) for r in rows])}
    near = stages["ngram_jaccard"](spark, after, DATA)
    assert {(r.doc_id, r.text) for r in near.collect()} == stage_brute(spark, rows, DATA) and near.columns == docs.columns
    mixed = stages["mixing"](spark, near, DATA)
    taken = Counter(r.doc_id for r in mixed.collect())
    want = {r.doc_id: r.epochs for r in mixing.mix(near).collect() if r.epochs}
    assert taken == want and mixed.columns == docs.columns


def test_pipeline_keeps_one_row_of_a_near_group(spark):
    """Repeated and null ids do not name rows, and a map is no obstacle."""
    import corpus_pipeline

    base = " ".join(f"w{k}" for k in range(60))
    near, other, last = f"{base} end", " ".join(f"x{k}" for k in range(40)), " ".join(f"y{k}" for k in range(40))
    given = [(3, base), (5, near), (5, other), (None, base), (None, last), (7, ""), (None, None), (9, other), (9, other)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, {"k": "v"}, n) for n, (i, t) in enumerate(given)], "doc_id long, text string, lang string, source string, n_chars long, m map<string,string>, h long")
    got = dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, DATA)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "", r.m["k"]) for r in got.collect()) == sorted([(3, base, "v"), (5, other, "v"), (-1, last, "v"), (7, "", "v"), (-1, "", "v")])


def test_pipeline_on_odd_rows(spark, odd):
    import corpus_pipeline

    names = {"ids": "_score", "id": "_h", "kept": "_copy"}
    docs = odd.select(*[F.col(c).alias(names.get(c, c)) for c in odd.columns])
    for df, n in ((docs, len(ODD)), (docs.limit(0), 0)):
        out = df
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, out, DATA)
            if name != "bpe":
                assert out.columns == docs.columns and (out.count() > 0) == (n > 0)
            if name == "ngram_jaccard" and n:
                assert out.where("doc_id = 4 and text like '%12%'").count() == 1
        assert {(r.doc_id is None, r.text is None) for r in out.collect()} <= {(False, False), (True, False)}
        assert corpus_pipeline.STAGES[0][1](spark, df, DATA).columns == docs.columns


def test_pipeline(spark):
    import corpus_pipeline

    docs, at = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        at.append(out.count())
        if name != "bpe":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "ngram_jaccard":
            given = [(r.doc_id, r.text) for r in out.collect()]
            assert len({i for i, _ in given}) == len(given) and not any(jaccard_brute(given)[0])
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard", "mixing", "bpe"] and at[0] < 200 and at[2] < at[1]
    tok = Tokenizer.from_file(WORD)
    assert all(r.text == tok.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False) for r in corpus_pipeline.run(spark, DATA).collect())
