"""Registered queries of the keyed-data engine and their DuckDB SQL.

The events table is read as a mutation log (see ``sources.log.event_log``); every
read names the instant it is made at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KeyspaceConfig
from ..functions import hashing
from ..operators.bounded import bounded
from ..operators import lookup, metrics, retention, scan, sketch, state
from ..sources.log import HOUR_NS, event_log
from .. import legacy

#: 2024-01-31 00:00:00 UTC.
AS_OF = 1_706_659_200_000_000_000
CLEAR_SEQ, TOP, CAP, WIDTH = 500, 20, 400, 4096
BATCH = ["user:1", "user:7", "user:1", "user:3", "user:x", "user:10", "user:x", "user:2"]

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

LOG = """log AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns,
  CASE WHEN event_type = 'error' THEN 'DELETE' WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'SET' END AS op,
  'user:' || user_id AS key, value, (length(props) + 1)::BIGINT AS cost,
  CASE WHEN event_type = 'purchase' THEN 21600000000000 ELSE 0 END AS ttl_ns FROM events)"""
MUT = LOG + """, mut AS (SELECT *, CASE WHEN ttl_ns > 0 THEN ts_ns + ttl_ns ELSE 0 END AS expire_at FROM log WHERE op IN ('SET', 'DELETE'))"""
STATE = MUT + """, state AS (SELECT key, value, cost, expire_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM mut) WHERE rn = 1 AND op = 'SET'),
live AS (SELECT * FROM state WHERE expire_at = 0 OR 1706659200000000000 <= expire_at)"""
RANKED = STATE + """, freq AS (SELECT key, count(*)::BIGINT AS freq FROM log WHERE op IN ('GET', 'SET') GROUP BY key),
ranked AS (SELECT live.*, coalesce(freq.freq, 0) AS freq FROM live LEFT JOIN freq USING (key)),
running AS (SELECT *, row_number() OVER (ORDER BY freq DESC, seq DESC) AS r, sum(cost) OVER (ORDER BY freq DESC, seq DESC ROWS UNBOUNDED PRECEDING) AS c FROM ranked)"""
_VALUES = "batch(pos, key) AS (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(BATCH)) + ")"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.materialise(_log(spark, sf_dir), cleared=False)


def _batch(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(BATCH)), "pos int, key string")


def _table(spark: SparkSession, sf_dir: str, name: str, key, value) -> DataFrame:
    """A table as a state whose entries never expire."""
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return t.select(key.alias("key"), value.alias("value"), F.lit(1).cast("long").alias("cost"), F.lit(0).cast("long").alias("expire_at"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages", F.col("url"), F.col("page_id"))


# Lookups


@query(f"WITH {STATE} SELECT key, value FROM live WHERE key = 'user:1'")
def kv_get(spark, d):
    return lookup.get(_state(spark, d), "user:1", AS_OF).select("key", "value")


@query(f"WITH {STATE} SELECT key, value, expire_at FROM state WHERE key = 'user:1'")
def kv_peek(spark, d):
    return lookup.peek(_state(spark, d), "user:1").select("key", "value", "expire_at")


@query(f"WITH {STATE}, {_VALUES} SELECT DISTINCT b.key, l.key IS NOT NULL AS found FROM batch b LEFT JOIN live l USING (key)")
def kv_has(spark, d):
    return lookup.has(_state(spark, d), _batch(spark), AS_OF)


@query(f"WITH {STATE} SELECT count(*)::BIGINT AS n FROM state")
def kv_len(spark, d):
    return lookup.length(_state(spark, d))


@query(f"WITH {STATE}, {_VALUES} SELECT key, value FROM live WHERE key IN (SELECT key FROM batch)")
def kv_get_many(spark, d):
    return lookup.get_many(_state(spark, d), _batch(spark), AS_OF).select("key", "value")


@query(f"WITH {STATE}, {_VALUES} SELECT b.pos::INTEGER AS pos, b.key, l.value, l.key IS NOT NULL AS found FROM batch b LEFT JOIN live l USING (key)")
def kv_get_batch(spark, d):
    return lookup.get_batch(_state(spark, d), _batch(spark), AS_OF)


@query(f"WITH {STATE}, {_VALUES} SELECT DISTINCT key FROM batch WHERE key NOT IN (SELECT key FROM live)")
def kv_missing_keys(spark, d):
    return lookup.missing(_state(spark, d), _batch(spark), AS_OF)


@query(f"WITH {STATE}, {_VALUES} SELECT coalesce(string_agg(key || '=' || value::DECIMAL(18, 4), ',' ORDER BY key), '') AS entries FROM live WHERE key IN (SELECT key FROM batch)")
def kv_batch_to_map(spark, d):
    pairs = F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("decimal(18,4)").cast("string")))
    return lookup.batch_to_map(_state(spark, d), _batch(spark), AS_OF).select(F.array_join(pairs, ",").alias("entries"))


# Scans


@query(f"WITH {STATE} SELECT key, value, cost, expire_at FROM live")
def kv_scan(spark, d):
    return scan.scan(_state(spark, d), AS_OF).select("key", "value", "cost", "expire_at")


@query(f"WITH {STATE} SELECT key FROM live")
def kv_keys(spark, d):
    return scan.KeyIterator(scan.scan(_state(spark, d), AS_OF)).keys()


@query(f"WITH {STATE} SELECT value FROM live")
def kv_values(spark, d):
    return scan.KeyIterator(scan.scan(_state(spark, d), AS_OF)).values()


@query("SELECT url AS key, page_id AS value FROM pages WHERE url > 'http://m' ORDER BY url LIMIT 10")
def kv_page(spark, d):
    return scan.page(_pages(spark, d), after="http://m", count=0).select("key", "value")


@query(f"WITH {STATE} SELECT key, value, expire_at FROM live WHERE starts_with(key, 'user:1')")
def kv_scan_prefix(spark, d):
    return scan.scan_prefix(_state(spark, d), "user:1", AS_OF).select("key", "value", "expire_at")


@query("SELECT url AS key, page_id AS value FROM pages WHERE starts_with(url, 'https://www.')")
def kv_scan_prefix_pushed(spark, d):
    return scan.scan_prefix(_pages(spark, d), "https://www.", AS_OF).select("key", "value")


@query("SELECT prefix, count(*)::BIGINT AS n FROM pages, (VALUES ('http://'), ('https://'), ('https://www.'), ('http://m.')) p(prefix) WHERE starts_with(url, prefix) GROUP BY prefix")
def kv_prefix_counts(spark, d):
    return scan.prefix_counts(_pages(spark, d), ["http://", "https://", "https://www.", "http://m.", "ftp://"])


def _glob(name: str, pattern: str, regex: str, table: str = "pages") -> None:
    def run(spark, d):
        rows = _pages(spark, d) if table == "pages" else _table(spark, d, "customer", F.col("c_name"), F.col("c_custkey"))
        return scan.scan_match(rows, pattern, AS_OF).select("key", "value")

    run.__name__ = name
    cols = "url AS key, page_id AS value" if table == "pages" else "c_name AS key, c_custkey AS value"
    query(f"SELECT {cols} FROM {table} WHERE regexp_full_match({cols.split()[0]}, '(?s){regex}')")(run)


_glob("kv_glob_star", "https://*/en/*", "https://.*/en/.*")
_glob("kv_glob_double_star", "http://**.html", "http://.*[.]html")
_glob("kv_glob_question", "*/en/???", ".*/en/...")
_glob("kv_glob_charset", "http*://[bm]*.example.[a-d]*", "http.*://[bm].*[.]example[.][a-d].*")
_glob("kv_glob_negated", "*://[!bw]*[!0-9]", ".*://[^bw].*[^0-9]")
_glob("kv_glob_escaped_member", r"*/en/[\0-9]*", ".*/en/[09-].*")
_glob("kv_glob_escape", r"*\?page=2*", ".*[?]page=2.*")
_glob("kv_glob_literal", "Customer#000000001", "Customer#000000001", "customer")


@query(f"WITH {STATE} SELECT key, value FROM live WHERE starts_with(key, 'user:1') ORDER BY key LIMIT 7")
def kv_find_by_prefix(spark, d):
    return scan.find_by_prefix(_state(spark, d), "user:1", 7, AS_OF).select("key", "value")


@query(f"WITH {STATE} SELECT key, value FROM live WHERE length(key) = 7")
def kv_get_by_hash(spark, d):
    return lookup.get_by_hash(_state(spark, d), 7, AS_OF, KeyspaceConfig(key_hasher=lambda k: F.char_length(k))).select("key", "value")


# Mutations


@query(f"WITH {STATE} SELECT key, value, cost, expire_at, seq FROM state")
def kv_lww_state(spark, d):
    return _state(spark, d)


@query(f"WITH {STATE} SELECT key, value, cost, expire_at, seq FROM state")
def kv_late_writes(spark, d):
    """The log in three batches, each with a third of all rows and the newest first: late SETs stay dead."""
    log, kept = _log(spark, d), None
    for k in (2, 1, 0):
        kept = state.merged(kept, log.where(F.col("seq") % 3 == k))
    return state.entries(kept)


@query(f"WITH {STATE}, items(key, value) AS (VALUES ('user:1', 1.5), ('user:new', 2.5), ('other', 3.5)) SELECT key, value::DOUBLE AS value, 0::BIGINT AS expire_at FROM items UNION ALL SELECT key, value, expire_at FROM state WHERE key NOT IN (SELECT key FROM items)")
def kv_set_many(spark, d):
    items = spark.createDataFrame([("user:1", 1.5), ("user:new", 2.5), ("other", 3.5)], "key string, value double")
    changes = items.select("key", F.lit("SET").alias("op"), "value", F.lit(1).cast("long").alias("cost"), F.lit(0).cast("long").alias("expire_at"), F.lit(2**62).alias("seq"))
    return state.upsert(_state(spark, d), changes).select("key", "value", "expire_at")


@query(f"WITH {STATE}, {_VALUES} SELECT key, value FROM state WHERE key NOT IN (SELECT key FROM batch)")
def kv_delete_many(spark, d):
    return state.delete_many(_state(spark, d), _batch(spark)).select("key", "value")


@query(f"WITH {STATE}, {_VALUES} SELECT count(*)::BIGINT AS deleted FROM state WHERE key IN (SELECT key FROM batch)")
def kv_delete_count(spark, d):
    return state.deleted_count(_state(spark, d), _batch(spark))


@query(f"WITH {MUT} SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM mut WHERE seq > {CLEAR_SEQ}) WHERE rn = 1 AND op = 'SET'")
def kv_clear(spark, d):
    log = _log(spark, d)
    clear = log.where(F.col("seq") == CLEAR_SEQ).withColumn("op", F.lit("CLEAR"))
    return state.materialise(log.where(F.col("seq") != CLEAR_SEQ).unionByName(clear)).select("key", "value", "seq")


@query(f"WITH {MUT}, h AS (SELECT *, lag(op) OVER w AS p_op, lag(value) OVER w AS p_value, lag(seq) OVER w AS p_seq FROM mut WINDOW w AS (PARTITION BY key ORDER BY seq)) SELECT key, p_value AS value, p_seq AS seq, seq AS by_seq FROM h WHERE op = 'SET' AND p_op = 'SET'")
def kv_overwritten(spark, d):
    return state.overwritten(_log(spark, d)).select("key", "value", "seq", "by_seq")


# Expiry


@query(f"WITH {STATE} SELECT key, expire_at FROM state WHERE key IN (SELECT key FROM mut WHERE op = 'SET' GROUP BY key HAVING count(*) > 1)")
def kv_overwrite_ttl(spark, d):
    again = _log(spark, d).where("op = 'SET'").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _state(spark, d).join(again, "key", "left_semi").select("key", "expire_at")


@query(f"WITH {LOG}, s AS (SELECT key, op, ts_ns + CASE WHEN ttl_ns > 0 THEN ttl_ns ELSE 86400000000000 END AS expire_at, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE op IN ('SET', 'DELETE')) SELECT key, expire_at FROM s WHERE rn = 1 AND op = 'SET' AND 1706659200000000000 <= expire_at")
def kv_default_ttl(spark, d):
    stored = state.materialise(_log(spark, d), KeyspaceConfig(default_ttl_ns=24 * HOUR_NS), cleared=False)
    return scan.scan(stored, AS_OF).select("key", "expire_at")


@query(f"WITH {STATE} SELECT key, value FROM live")
def kv_live_as_of(spark, d):
    return _state(spark, d).where(state.live(AS_OF)).select("key", "value")


@query(f"WITH {STATE} SELECT key, value, expire_at FROM state WHERE NOT (expire_at = 0 OR 1706659200000000000 <= expire_at)")
def kv_expired(spark, d):
    return _state(spark, d).where(state.expired(AS_OF)).select("key", "value", "expire_at")


@query(f"WITH {STATE} SELECT min(expire_at) AS next_expiry, count(*)::BIGINT AS scheduled FROM state WHERE expire_at > 0")
def kv_next_expiry(spark, d):
    return _state(spark, d).where("expire_at > 0").agg(F.min("expire_at").alias("next_expiry"), F.count(F.lit(1)).alias("scheduled"))


# Costs, retention


@query(f"WITH {STATE} SELECT sum(cost)::BIGINT AS used_cost, count(*)::BIGINT AS entries FROM live")
def kv_cost_total(spark, d):
    return scan.scan(_state(spark, d), AS_OF).agg(F.sum("cost").alias("used_cost"), F.count(F.lit(1)).alias("entries"))


@query(f"WITH {STATE} SELECT key, length(value::BIGINT::VARCHAR)::BIGINT AS cost FROM state")
def kv_cost_default(spark, d):
    log = _log(spark, d).withColumn("cost", F.lit(0).cast("long"))
    config = KeyspaceConfig(cost_func=lambda v: scan.cost_of(F.expr("cast(round(value) as bigint)")))
    return state.materialise(log, config, cleared=False).select("key", "cost")


@query(f"WITH {RANKED} SELECT key, value, freq FROM running WHERE r <= {TOP}")
def kv_lfu_topn(spark, d):
    return retention.top_entries(_state(spark, d), retention.frequencies(_log(spark, d)), TOP, AS_OF).select("key", "value", "freq")


@query(f"WITH {RANKED} SELECT key, cost, freq FROM running WHERE c <= {CAP}")
def kv_lfu_cost_cap(spark, d):
    return retention.within_cost(_state(spark, d), retention.frequencies(_log(spark, d)), CAP, AS_OF).select("key", "cost", "freq")


@query(f"WITH {RANKED} SELECT key, cost, 'capacity' AS reason FROM running WHERE r > {TOP}")
def kv_evicted(spark, d):
    stored = _state(spark, d)
    kept = retention.top_entries(stored, retention.frequencies(_log(spark, d)), TOP, AS_OF)
    return retention.evicted(stored, kept, AS_OF).select("key", "cost", "reason")


@query(f"WITH {RANKED}, s AS (SELECT *, row_number() OVER (ORDER BY freq, seq) AS slot FROM ranked), i AS (SELECT key, freq, row_number() OVER (ORDER BY seq DESC) AS slot FROM ranked) SELECT i.key, s.key AS victim, i.freq >= s.freq AS admitted FROM i JOIN s USING (slot) WHERE slot <= 10")
def kv_tinylfu_admit(spark, d):
    rows = retention.ranked(_state(spark, d), retention.frequencies(_log(spark, d)), AS_OF)
    slots = F.posexplode(F.col("x"))
    victims = rows.orderBy("freq", "seq").limit(10).agg(F.array_sort(F.collect_list(F.struct("freq", "seq", "key"))).alias("x")).select(slots).select(F.col("pos").alias("slot"), "col.key", "col.freq")
    incoming = rows.orderBy(F.desc("seq")).limit(10).agg(F.array_sort(F.collect_list(F.struct((-F.col("seq")).alias("seq"), "freq", "key"))).alias("x")).select(slots).select(F.col("pos").alias("slot"), "col.key", "col.freq")
    return retention.admit(incoming, victims)


@query(f"WITH {STATE}, n AS (SELECT count(*) AS n FROM live), r AS (SELECT key, value, row_number() OVER (ORDER BY md5('1:' || key), key) AS r FROM live) SELECT key, value FROM r, n WHERE r <= CASE WHEN n < 100 THEN n WHEN n < 1000 THEN 10 WHEN n < 10000 THEN 15 ELSE 20 END")
def kv_sample(spark, d):
    return retention.sample(scan.scan(_state(spark, d), AS_OF)).select("key", "value")


def _bounded(spark, d, **limits):
    return bounded(_log(spark, d), AS_OF, KeyspaceConfig(**limits))


@query(f"WITH {RANKED} SELECT key, value, cost, freq FROM running WHERE r <= {TOP} AND c <= {CAP}")
def kv_bounded(spark, d):
    return _bounded(spark, d, max_entries=TOP, max_cost=CAP).retained.select("key", "value", "cost", "freq")


@query(f"WITH {RANKED} SELECT key, cost, 'capacity' AS reason FROM running WHERE r > {TOP} OR c > {CAP}")
def kv_bounded_evicted(spark, d):
    return _bounded(spark, d, max_entries=TOP, max_cost=CAP).evicted.select("key", "cost", "reason")


@query(f"WITH {RANKED} SELECT key, freq, CASE WHEN freq < (SELECT min(freq) FROM running WHERE r <= {TOP}) THEN 'admission' ELSE 'capacity' END AS reason FROM running WHERE r > {TOP}")
def kv_rejected(spark, d):
    b = _bounded(spark, d, max_entries=TOP, admission="tinylfu")
    return b.rejected.unionByName(b.evicted).select("key", "freq", "reason")


@query(f"WITH {RANKED}, o AS (SELECT * FROM running WHERE r > {TOP}), l AS (SELECT min(freq) AS least FROM running WHERE r <= {TOP}) SELECT (SELECT count(*) FROM o, l WHERE freq >= least)::BIGINT AS evictions, (SELECT coalesce(sum(cost), 0) FROM o, l WHERE freq >= least)::BIGINT AS cost_evicted, (SELECT count(*) FROM o, l WHERE freq < least)::BIGINT AS rejections, (SELECT count(*) FROM log WHERE op = 'SET')::BIGINT AS sets")
def kv_bounded_metrics(spark, d):
    return _bounded(spark, d, max_entries=TOP, admission="tinylfu").metrics().select("evictions", "cost_evicted", "rejections", "sets")


# Frequencies and filters


@query(f"WITH {LOG} SELECT key, count(*)::BIGINT AS freq FROM log WHERE op IN ('GET', 'SET') GROUP BY key")
def kv_freq_exact(spark, d):
    return retention.frequencies(_log(spark, d))


def _md5(seed: str, key: str = "key") -> str:
    return f"('0x' || substr(md5({seed} || ':' || {key}), 1, 8))::BIGINT"


_CELLS = f"{LOG}, a AS (SELECT key, r, {_md5('r')} & {WIDTH - 1} AS b FROM log, range(4) t(r) WHERE op IN ('GET', 'SET'))"


@query(f"WITH {_CELLS}, s AS (SELECT r, b, least(count(*), 255)::BIGINT AS n FROM a GROUP BY ALL), e AS (SELECT key, min(n) AS est FROM (SELECT DISTINCT key, r, b FROM a) JOIN s USING (r, b) GROUP BY key), f AS (SELECT key, count(*) AS freq FROM log WHERE op IN ('GET', 'SET') GROUP BY key) SELECT key, est, est >= least(freq, 255) AS bounded FROM e JOIN f USING (key)")
def kv_cms_upper_bound(spark, d):
    rows = _log(spark, d).where(F.col("op").isin("GET", "SET"))
    est = sketch.cms_estimate(sketch.cms(rows, WIDTH, hasher=hashing.md5_hash), rows, WIDTH, hasher=hashing.md5_hash)
    return est.join(retention.frequencies(rows), "key").select("key", "est", (F.col("est") >= F.least("freq", F.lit(255))).alias("bounded"))


@query(f"WITH {_CELLS}, s AS (SELECT r, b, least(count(*), 15)::BIGINT // 2 AS n FROM a GROUP BY ALL) SELECT key, min(n)::BIGINT AS est FROM (SELECT DISTINCT key, r, b FROM a) JOIN s USING (r, b) GROUP BY key")
def kv_cms_halved(spark, d):
    rows = _log(spark, d).where(F.col("op").isin("GET", "SET"))
    halved = sketch.cms_halved(sketch.cms(rows, WIDTH, saturate=15, hasher=hashing.md5_hash))
    return sketch.cms_estimate(halved, rows, WIDTH, hasher=hashing.md5_hash)


@query(f"WITH {_CELLS}, s AS (SELECT r, b, least(count(*), 255)::BIGINT AS n FROM a GROUP BY ALL), c AS (SELECT key, count(*) AS n FROM log WHERE op IN ('GET', 'SET') GROUP BY key) SELECT key, (min(s.n) + max((c.n > 1)::INTEGER))::BIGINT AS est FROM (SELECT DISTINCT key, r, b FROM a) JOIN s USING (r, b) JOIN c USING (key) GROUP BY key")
def kv_tinylfu_estimate(spark, d):
    rows = _log(spark, d).where(F.col("op").isin("GET", "SET"))
    return sketch.tinylfu_estimate(sketch.cms(rows, WIDTH, hasher=hashing.md5_hash), sketch.doorkeeper_second(rows), rows, WIDTH, hashing.md5_hash)


BITS, PROBES = 4096, 3
_BITS = f"{LOG}, k AS (SELECT DISTINCT key FROM log), x AS (SELECT DISTINCT {_md5('i')} % {BITS} AS b FROM k, range({PROBES}) t(i))"


@query(f"WITH {_BITS} SELECT DISTINCT key, TRUE AS maybe FROM log WHERE {' AND '.join(f'{_md5(repr(str(i)))} % {BITS} IN (SELECT b FROM x)' for i in range(PROBES))}")
def kv_bloom_no_false_negative(spark, d):
    keys = _log(spark, d).select("key")
    return sketch.bloom_contains(sketch.bloom(keys, BITS, PROBES, hashing.md5_hash), keys, BITS, PROBES, hashing.md5_hash)


@query(f"WITH {_BITS} SELECT c_name AS key, {' AND '.join(f'{_md5(repr(str(i)), chr(99) + '_name')} % {BITS} IN (SELECT b FROM x)' for i in range(PROBES))} AS maybe FROM customer")
def kv_bloom_false_positives(spark, d):
    absent = _table(spark, d, "customer", F.col("c_name"), F.col("c_custkey")).select("key")
    return sketch.bloom_contains(sketch.bloom(_log(spark, d).select("key"), BITS, PROBES, hashing.md5_hash), absent, BITS, PROBES, hashing.md5_hash)


@query(f"WITH {_BITS}, n AS (SELECT count(*)::BIGINT AS n FROM x) SELECT n AS set_bits, round(n / {BITS}, 9) AS fill_ratio, floor(-{BITS / PROBES!r} * ln(1 - n / {BITS}))::BIGINT AS estimated_count FROM n")
def kv_bloom_estimated_count(spark, d):
    filled = sketch.bloom_fill(sketch.bloom(_log(spark, d).select("key"), BITS, PROBES, hashing.md5_hash), BITS, PROBES)
    return filled.select("set_bits", F.round("fill_ratio", 9).alias("fill_ratio"), "estimated_count")


_BLOCKS = f"{LOG}, k AS (SELECT DISTINCT key FROM log), x AS (SELECT DISTINCT {_md5(repr('0'))} % 8 AS k, {_md5('i')} % 512 AS b FROM k, range(1, 4) t(i))"


@query(f"WITH {_BLOCKS}, a AS (SELECT c_name AS key, {_md5(repr('0'), 'c_name')} % 8 AS k, {_md5('i', 'c_name')} % 512 AS b FROM customer, range(1, 4) t(i)) SELECT key, count(x.b) = 3 AS maybe FROM a LEFT JOIN x USING (k, b) GROUP BY key")
def kv_blocked_bloom(spark, d):
    absent = _table(spark, d, "customer", F.col("c_name"), F.col("c_custkey")).select("key")
    return sketch.blocked_contains(sketch.blocked_bloom(_log(spark, d).select("key"), 8, 3, hashing.md5_hash), absent, 8, 3, hashing.md5_hash)


@query(f"WITH {_BLOCKS}, f AS (SELECT k, count(*) / 512 AS r FROM x GROUP BY k) SELECT round(sum(r ** 3) / 8, 9) AS fp_rate FROM f")
def kv_blocked_fp_rate(spark, d):
    return sketch.blocked_fp_rate(sketch.blocked_bloom(_log(spark, d).select("key"), 8, 3, hashing.md5_hash), 8, 3).select(F.round("fp_rate", 9).alias("fp_rate"))


@query(f"WITH {LOG}, n AS (SELECT key, greatest((count(*) FILTER (op = 'SET') - count(*) FILTER (op = 'DELETE')), 0)::BIGINT AS n FROM log GROUP BY key) SELECT sum(n)::BIGINT AS entries, 65536::BIGINT AS capacity, round(sum(n) / 65536, 9) AS load_factor FROM n")
def kv_member_load(spark, d):
    log = _log(spark, d)
    found = sketch.member_figures(sketch.member_set(log.where("op = 'SET'"), log.where("op = 'DELETE'")), 65_536)
    return found.select("entries", "capacity", F.round("load_factor", 9).alias("load_factor"))


@query(f"WITH {LOG}, n AS (SELECT key, (count(*) FILTER (op = 'SET') - count(*) FILTER (op = 'DELETE'))::BIGINT AS n FROM log GROUP BY key) SELECT key, n FROM n WHERE n > 0")
def kv_member_set(spark, d):
    log = _log(spark, d)
    return sketch.member_set(log.where("op = 'SET'"), log.where("op = 'DELETE'"))


@query(f"WITH {LOG} SELECT key, count(*)::BIGINT AS n FROM log WHERE op IN ('GET', 'SET') GROUP BY key HAVING count(*) > 1")
def kv_doorkeeper_second_seen(spark, d):
    return sketch.doorkeeper_second(_log(spark, d))


@query(f"WITH {LOG}, m AS (SELECT max(seq) // 200 AS last FROM log), c AS (SELECT key, last - seq // 200 AS age, count(*) AS n FROM log, m WHERE op IN ('GET', 'SET') GROUP BY ALL) SELECT key, (sum(CASE WHEN age <= 84 THEN n::HUGEINT * (1::HUGEINT << (84 - age)::INTEGER) ELSE 0 END)::HUGEINT >> 85)::BIGINT AS freq FROM c GROUP BY key")
def kv_freq_aged(spark, d):
    return sketch.aged_frequencies(_log(spark, d), 200)


# Hashes


@query("WITH h AS (SELECT url AS key, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(hex(encode(url)), ''), lambda x: 0::UHUGEINT)), lambda a, b: a) AS x FROM pages), b AS (SELECT url AS key, [('0x' || substr(hex(encode(url)), 2 * i - 1, 2))::INTEGER FOR i IN range(1, octet_length(encode(url)) + 1)] AS bytes FROM pages), f AS (SELECT key, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(bytes, lambda x: x::UHUGEINT)), lambda a, c: (xor(a, c) * 1099511628211::UHUGEINT) & 18446744073709551615::UHUGEINT) AS u FROM b) SELECT key, (CASE WHEN u >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END)::BIGINT AS key_hash FROM f")
def kv_fnv1a(spark, d):
    return _pages(spark, d).select("key", hashing.fnv1a(F.col("key")).alias("key_hash"))


_M = "18446744073709551615::UHUGEINT"


@query(f"WITH a AS (SELECT c_custkey AS key, c_custkey::UHUGEINT AS x FROM customer), b AS (SELECT key, (xor(x, x >> 30) * 13787848793156543929::UHUGEINT) & {_M} AS x FROM a), c AS (SELECT key, (xor(x, x >> 27) * 10723151780598845931::UHUGEINT) & {_M} AS x FROM b), e AS (SELECT key, xor(x, x >> 31) AS u FROM c) SELECT key, (CASE WHEN u >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END)::BIGINT AS key_hash FROM e")
def kv_int_hash(spark, d):
    t = spark.read.parquet(f"{d}/customer.parquet")
    return t.select(F.col("c_custkey").alias("key"), hashing.mix_int(F.col("c_custkey")).alias("key_hash"))


@query(f"WITH a AS (SELECT c_custkey AS key, c_custkey::UHUGEINT AS x FROM customer), b AS (SELECT key, (xor(x, x >> 30) * 13787848793156543929::UHUGEINT) & {_M} AS x FROM a), c AS (SELECT key, (xor(x, x >> 27) * 10723151780598845931::UHUGEINT) & {_M} AS x FROM b), e AS (SELECT (xor(x, x >> 31) & 15::UHUGEINT)::BIGINT AS shard FROM c) SELECT shard, count(*)::BIGINT AS n FROM e GROUP BY shard")
def kv_shard_counts(spark, d):
    t = spark.read.parquet(f"{d}/customer.parquet")
    return t.select(hashing.shard_of(hashing.mix_int(F.col("c_custkey")), 16).alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


# Metrics


_READS = f"{MUT}, h AS (SELECT *, last_value(CASE WHEN op <> 'GET' THEN op END IGNORE NULLS) OVER w AS p_op, last_value(CASE WHEN op <> 'GET' THEN CASE WHEN ttl_ns > 0 THEN ts_ns + ttl_ns ELSE 0 END END IGNORE NULLS) OVER w AS p_exp FROM log WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), a AS (SELECT *, coalesce(p_op = 'SET' AND (p_exp = 0 OR ts_ns <= p_exp), FALSE) AS alive, coalesce(p_op = 'SET' AND p_exp > 0 AND ts_ns > p_exp, FALSE) AS ran_out FROM h), z AS (SELECT op, expire_at FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM mut) WHERE rn = 1)"


@query(f"WITH {_READS}, m AS (SELECT count(*) FILTER (op = 'GET' AND alive) AS hits, count(*) FILTER (op = 'GET' AND NOT alive) AS misses, count(*) FILTER (op = 'SET') AS sets, count(*) FILTER (op = 'DELETE' AND alive) AS deletes, count(*) FILTER (op <> 'GET' AND ran_out) AS before, sum(cost) FILTER (op = 'SET')::BIGINT AS cost_added FROM a) SELECT hits, misses, sets, deletes, before + (SELECT count(*) FROM z WHERE op = 'SET' AND expire_at > 0 AND expire_at < 1706659200000000000) AS expirations, 0::BIGINT AS rejections, 0::BIGINT AS buffer_drops, cost_added, hits / (hits + misses) AS hit_ratio FROM m")
def kv_metrics(spark, d):
    return metrics.metrics(_log(spark, d), AS_OF)


@query(f"WITH {_READS} SELECT round(avg(alive::INTEGER), 9) AS hit_ratio FROM a WHERE op = 'GET'")
def kv_hit_ratio(spark, d):
    m = metrics.metrics(_log(spark, d), AS_OF)
    return m.select(F.round(metrics.hit_ratio(F.col("hits"), F.col("misses")), 9).alias("hit_ratio"))


@query(f"WITH {_READS} SELECT seq, key, alive AS hit FROM a WHERE op = 'GET'")
def kv_reads(spark, d):
    return metrics.reads(_log(spark, d))


# Legacy facade


@query(f"WITH {STATE} SELECT key, value FROM live WHERE key <> 'user:2' UNION ALL SELECT 'fresh', 9.5")
def kv_legacy_close(spark, d):
    cache = legacy.CacheDriver(_state(spark, d).select("key", "value", "expire_at"))
    cache = cache.set("fresh", 9.5, 0, AS_OF).remove("user:2")
    return cache.close(AS_OF).select("key", "value")


@query(f"WITH {STATE} SELECT count(*) FILTER (expire_at > 0)::BIGINT AS queued, count(*)::BIGINT AS n FROM state")
def kv_legacy_queue(spark, d):
    return legacy.CacheDriver(_state(spark, d).select("key", "value", "expire_at")).sizes()
