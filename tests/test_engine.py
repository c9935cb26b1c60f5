"""A sequential simulator of the key space as a second oracle, and the corners SQL doesn't reach."""

import random

import pytest
from pyspark.sql import functions as F

from keystrata import legacy
from keystrata.config import KeyspaceConfig
from keystrata.functions import hashing
from keystrata.operators import lookup, metrics, retention, scan, sketch, state
from keystrata.sources.log import LOG, checked, items_log, read_state, write_state


def make_log(n, keys, seed, clear=()):
    rng = random.Random(seed)
    rows, ts = [], 1_000
    for seq in range(n):
        ts += rng.randint(0, 50)
        op = "CLEAR" if seq in clear else rng.choice(["SET", "SET", "GET", "GET", "GET", "DELETE"])
        key = f"k{min(rng.randint(0, keys), rng.randint(0, keys))}"
        rows.append((seq, ts, op, key, float(seq), rng.choice([0, 1, 5]), rng.choice([0, 0, 60, 400])))
    return rows


def simulate(rows, as_of, default_ttl=0):
    store, m = {}, dict(hits=0, misses=0, sets=0, deletes=0, expirations=0, cost_added=0)
    for seq, ts, op, key, value, cost, ttl in rows:
        if op == "CLEAR":
            store, m = {}, dict.fromkeys(m, 0)
            continue
        e = store.get(key)
        alive = e is not None and (e[2] == 0 or ts <= e[2])
        if op == "GET":
            m["hits" if alive else "misses"] += 1
            continue
        m["expirations"] += e is not None and not alive
        if op == "SET":
            ttl = ttl if ttl > 0 else default_ttl
            store[key] = (value, cost if cost > 0 else 1, ts + ttl if ttl > 0 else 0, seq)
            m["sets"] += 1
            m["cost_added"] += store[key][1]
        else:
            m["deletes"] += alive
            store.pop(key, None)
    m["expirations"] += sum(1 for e in store.values() if 0 < e[2] < as_of)
    return store, m


@pytest.mark.parametrize("seed,clear,ttl", [(1, (), 0), (2, (150,), 0), (3, (10, 200), 90)])
def test_against_simulator(spark, seed, clear, ttl):
    rows = make_log(400, 12, seed, clear)
    as_of = rows[-1][1] + 30
    log, config = spark.createDataFrame(rows, LOG), KeyspaceConfig(default_ttl_ns=ttl)
    store, m = simulate(rows, as_of, ttl)
    got = {r.key: (r.value, r.cost, r.expire_at, r.seq) for r in state.materialise(log, config).collect()}
    assert got == store
    r = metrics.metrics(log, as_of, config).first()
    assert {k: r[k] for k in m} == m
    small = {tuple(x) for x in metrics.prior_mutation(state.normalised(log), stretch=16).select("seq", F.col("p.seq").alias("p")).collect()}
    assert small == {tuple(x) for x in metrics.prior_mutation(state.normalised(log)).select("seq", F.col("p.seq").alias("p")).collect()}
    kept = {k: e for k, e in store.items() if e[2] == 0 or as_of <= e[2]}
    assert {x.key for x in scan.scan(state.materialise(log, config), as_of).collect()} == set(kept)


@pytest.mark.parametrize("cap", [0, 1, 7, 1000])
def test_retention_equals_sorting(spark, cap):
    rng = random.Random(5)
    rows = [(f"k{i}", float(i), rng.randint(1, 4), 0, i) for i in range(60)]
    freq = [(f"k{i}", rng.choice([1, 1, 1, 2, 9])) for i in range(0, 60, 2)]
    st = spark.createDataFrame(rows, "key string, value double, cost long, expire_at long, seq long")
    fr = spark.createDataFrame(freq, "key string, freq long")
    use = dict(freq)
    order = sorted(rows, key=lambda r: (-use.get(r[0], 0), -r[4]))
    spent, want = 0, set()
    for r in order:
        spent += r[2]
        if spent > cap:
            break
        want.add(r[0])
    assert {r.key for r in retention.within_cost(st, fr, cap, 5).collect()} == want
    if cap:
        assert {r.key for r in retention.top_entries(st, fr, cap, 5).collect()} == {r[0] for r in order[:cap]}
    spread = retention._prefix(retention.ranked(st, fr, 5), F.col("cost"), cap, stretch=4)
    assert {r.key for r in spread.collect()} == want


def test_hashes(spark):
    mask = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def fnv(b):
        h = 0xCBF29CE484222325
        for c in b:
            h = (h ^ c) * 0x100000001B3 & mask
        return h

    def fast(b):
        if len(b) < 32:
            return fnv(b)
        h, whole = 0xCBF29CE484222325, len(b) // 8 * 8
        for i in range(0, whole, 8):
            h = (h ^ int.from_bytes(b[i : i + 8], "little")) * 0x100000001B3 & mask
            h = (h << 31 | h >> 33) & mask
        for c in b[whole:]:
            h = (h ^ c) * 0x100000001B3 & mask
        return h

    def mix(k):
        x = k & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    words = ["", "a", "hello", "wörld", "Привет", "x" * 31, "y" * 32, "0123456789" * 4 + "é", "z" * 40]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.fnv1a(F.col("w")).alias("h"), hashing.fast_fnv(F.col("w")).alias("f")).collect()
    for r in got:
        assert (r.h, r.f) == (signed(fnv(r.w.encode())), signed(fast(r.w.encode())))
    numbers = [0, 1, -1, 12345, -12345, 2**62, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", hashing.mix_int(F.col("n")).alias("h"), hashing.combine(F.col("n"), F.lit(77)).alias("c"))
    for r in df.collect():
        n = r.n & mask
        assert r.h == signed(mix(r.n)) and r.c == signed(n ^ (77 + 0x9E3779B97F4A7C15 + (n << 12) + (n >> 4)) & mask)


def test_sketches(spark):
    rows = spark.createDataFrame([(f"k{i % 37}",) for i in range(1000)], "key string")
    est = {r.key: r.est for r in sketch.cms_estimate(sketch.cms(rows, 1024), rows, 1024).collect()}
    assert len(est) == 37 and all(v >= 27 for v in est.values())
    assert {r.est for r in sketch.cms_estimate(sketch.cms(rows, 1024).limit(0), rows, 1024).collect()} == {0}
    a, d = spark.createDataFrame([("x",), ("x",), ("y",)], "key string"), spark.createDataFrame([("x",), ("y",)], "key string")
    assert [tuple(r) for r in sketch.member_set(a, d).collect()] == [("x", 1)]
    empty = sketch.bloom_fill(sketch.bloom(rows.limit(0), 64, 2), 64, 2).first()
    assert (empty.set_bits, empty.estimated_count) == (0, 0)


def test_struct_keys_pages_and_null_keys(spark, tmp_path):
    st = spark.createDataFrame([((1, "alice"), "a"), ((2, "bob"), "b")], "key struct<id:int,name:string>, value string").withColumn("expire_at", F.lit(0).cast("long"))
    asked = spark.createDataFrame([((1, "alice"),), ((1, "charlie"),)], "key struct<id:int,name:string>")
    assert sorted(r.found for r in lookup.has(st, asked, 5).collect()) == [False, True]
    assert scan.scan_prefix(st, "a", 5).count() == 0 and scan.scan_match(st, "*", 5).count() == 0
    rows = spark.createDataFrame([(f"k{i:02}", i, 1, 0, i) for i in range(15)], "key string, value int, cost long, expire_at long, seq long")
    first = [r.key for r in scan.page(rows, count=10).collect()]
    rest = [r.key for r in scan.page(rows, after=first[-1], count=10).collect()]
    assert first + rest == [f"k{i:02}" for i in range(15)]
    assert scan.scan_match(rows, "[", 5).count() == 0
    it = scan.KeyIterator(rows.orderBy("key"))
    assert it.next() and it.key == "k00" and it.count() == 15
    seen = []
    it.for_each(lambda k, v: seen.append(k) or len(seen) < 3)
    assert len(seen) == 3
    write_state(rows, str(tmp_path / "s"), files=2)
    assert read_state(spark, str(tmp_path / "s")).count() == 15
    with pytest.raises(Exception, match="null key"):
        checked(items_log(spark.createDataFrame([(None, 1)], "key string, value int"))).collect()


def test_legacy(spark):
    cache = legacy.CacheDriver(spark.createDataFrame([("a", 1, 0), ("b", 2, 50)], "key string, value int, expire_at long"))
    assert cache.get("b", 50).count() == 1 and cache.get("b", 51).count() == 0
    assert cache.set("a", 5, 10, 100).get("a", 110).first().value == 5
    assert {r.key for r in cache.remove_expired(60).keys().collect()} == {"a"}
    assert cache.truncate().close(0).count() == 0 and cache.flush_keys(cache.keys(), 60).keys().count() == 1


def test_config():
    with pytest.raises(ValueError):
        KeyspaceConfig(max_entries=0)
    with pytest.raises(ValueError):
        KeyspaceConfig(admission="never")
