"""The engine's queries over the driver's tables, each with its SQL.

Keys and values are strings here, so that both engines show the same types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import bloom, index, merge, read
from siltstone.sources import changelog, wal, workspace

#: The newest entry of a change log is that of the highest generation, then seq.
ORDER = ("gen", "seq")
#: Bounds of the range queries.
LOW, HIGH = "user-0010/00", "user-0020/05"
PROBE = "user-0012/03"
THRESHOLD = 1 << 16


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.from_events(spark, load(spark, sf_dir, "events"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of customers, present and absent ones."""
    return load(spark, sf_dir, "customer").selectExpr("format_string('user-%04d/%02d', c_custkey % 250, c_custkey % 10) as key").distinct()


def _merged(spark, sf_dir):
    return merge.newest(kv_log(spark, sf_dir), ORDER)


def merge_keep_tombstones(spark, sf_dir):
    return merge.merge(kv_log(spark, sf_dir), False, ORDER).select("key", "op", "value", "gen")


def merge_drop_tombstones(spark, sf_dir):
    return merge.merge(kv_log(spark, sf_dir), True, ORDER).select("key", "op", "value", "gen")


def scan_range(spark, sf_dir):
    return read.scan(kv_log(spark, sf_dir), LOW, HIGH, order=ORDER)


def scan_full(spark, sf_dir):
    return read.scan(kv_log(spark, sf_dir), order=ORDER)


def scan_start_only(spark, sf_dir):
    return read.scan(kv_log(spark, sf_dir), start=LOW, order=ORDER)


def scan_end_only(spark, sf_dir):
    return read.scan(kv_log(spark, sf_dir), end=HIGH, order=ORDER)


def scan_empty(spark, sf_dir):
    return read.scan(kv_log(spark, sf_dir), HIGH, LOW, order=ORDER)


def scan_first_keys(spark, sf_dir):
    """Early stop: the first 50 keys of a scan."""
    return read.scan(kv_log(spark, sf_dir), start=LOW, order=ORDER, limit=50)


def point_get(spark, sf_dir):
    return read.point_get(kv_log(spark, sf_dir), PROBE, ORDER).select("value")


def multi_get_tristate(spark, sf_dir):
    return read.tri_state(probes(spark, sf_dir), kv_log(spark, sf_dir), ORDER)


def multi_get(spark, sf_dir):
    return read.multi_get(probes(spark, sf_dir), kv_log(spark, sf_dir), ORDER)


def file_get_tristate(spark, sf_dir):
    """Tri-state lookup in one generation."""
    return read.tri_state(probes(spark, sf_dir), kv_log(spark, sf_dir).where("gen = 2"), ("seq",))


def file_all(spark, sf_dir):
    return merge.per_generation(kv_log(spark, sf_dir)).select("gen", "key", "op", "value")


def file_range_scan(spark, sf_dir):
    entries = read.entries_in_range(kv_log(spark, sf_dir).where("gen = 2"), LOW, HIGH)
    return merge.per_generation(entries).select("gen", "key", "op", "value")


def memtable_dump(spark, sf_dir):
    return merge.per_generation(kv_log(spark, sf_dir).where("gen = 5")).select("key", "op", "value")


def memtable_len(spark, sf_dir):
    """Live keys of the newest, unflushed generation."""
    last = merge.per_generation(kv_log(spark, sf_dir).where("gen = 5"))
    return last.agg(F.count_if(F.col("op") == 1).alias("live_keys"))


def memtable_size_bytes(spark, sf_dir):
    return merge.memtable_bytes(kv_log(spark, sf_dir))


def flush_dedupe(spark, sf_dir):
    return merge.per_generation(kv_log(spark, sf_dir)).groupBy("gen", "op").agg(F.count("*").alias("entries"))


def flush_boundaries(spark, sf_dir):
    return merge.flush_boundaries(kv_log(spark, sf_dir), THRESHOLD).groupBy("flush_no").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("running_bytes").alias("running_bytes")
    )


def num_entries(spark, sf_dir):
    return merge.per_generation(kv_log(spark, sf_dir)).groupBy("gen").agg(F.count("*").alias("entries"))


def sstable_count(spark, sf_dir):
    return kv_log(spark, sf_dir).agg(F.countDistinct("gen").alias("generations"))


def sparse_index(spark, sf_dir):
    return index.build(merge.per_generation(kv_log(spark, sf_dir)))


def sparse_index_lookup(spark, sf_dir):
    return index.search(sparse_index(spark, sf_dir), PROBE)


def sparse_index_lookup_many(spark, sf_dir):
    return index.search_many(sparse_index(spark, sf_dir), probes(spark, sf_dir))


def partial_compaction(spark, sf_dir):
    """Merge generations 1 to 4, keep tombstones and recency, and read everything."""
    log = kv_log(spark, sf_dir)
    middle = merge.merge(log.where("gen between 1 and 4"), False, ORDER).withColumn("gen", F.lit(4))
    return merge.newest(log.where("gen in (0, 5)").unionByName(middle), ORDER).select("key", "op", "value")


def oldest_compaction(spark, sf_dir):
    """Merge generations 0 to 3 without tombstones: the live rows stay the same."""
    log = kv_log(spark, sf_dir)
    oldest = merge.merge(log.where("gen <= 3"), True, ORDER).withColumn("gen", F.lit(3))
    return read.scan(log.where("gen > 3").unionByName(oldest), order=ORDER)


def tombstone_audit(spark, sf_dir):
    return merge.buried(kv_log(spark, sf_dir))


def shadowed_versions(spark, sf_dir):
    return merge.shadowed(kv_log(spark, sf_dir))


def _spoilt(log: DataFrame) -> Column:
    """Every 997th record in the last tenth of the log."""
    return (F.col("seq") % 997 == 996) & (F.col("seq") * 10 >= log.agg(F.max("seq") * 9).scalar())


def wal_replay_prefix(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    return wal.valid_prefix(log, _spoilt(log)).select("seq", "key", "op", "value")


def wal_replay_checksum(spark, sf_dir):
    """Checksums are made, some in the last tenth are spoilt, and the valid prefix replayed."""
    log = wal.with_crc(kv_log(spark, sf_dir))
    log = log.withColumn("crc", F.when(_spoilt(log), F.col("crc") + 1).otherwise(F.col("crc")))
    return wal.valid_prefix(log).select("seq", "key", "op", "value")


def upsert_kv(spark, sf_dir):
    return merge.newest(changelog.upserts_from_orders(load(spark, sf_dir, "orders"))).select("key", "value")


def bloom_no_false_negatives(spark, sf_dir):
    keys = kv_log(spark, sf_dir).select("key").distinct()
    shape = bloom.BloomShape.for_keys(keys.count())
    return bloom.might_contain(keys, bloom.build(keys, shape), shape)


def bloom_prunes_lookups(spark, sf_dir):
    """Lookup behind a filter of one generation: the result is that of the lookup."""
    entries = merge.per_generation(kv_log(spark, sf_dir).where("gen = 2"))
    shape = bloom.BloomShape.for_keys(entries.count())
    asked = bloom.might_contain(probes(spark, sf_dir), bloom.build(entries, shape), shape).where("might_contain")
    return entries.join(asked.select("key"), "key", "left_semi").select("key", "op", "value")


def store_round_trip(spark, sf_dir):
    """Load the log into a store generation by generation, compact, and scan."""
    from siltstone.store import Store

    log = kv_log(spark, sf_dir)
    with Store.open(spark, workspace.work_path(spark, "store"), auto_compact=False) as store:
        for gen in range(6):
            store.apply_many(log.where(F.col("gen") == gen))
        store.compact_all()
        return store.scan(ordered=False).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def store_restart(spark, sf_dir):
    """Single puts and deletes, read after a restart from the log alone."""
    from siltstone.store import Store

    path = workspace.work_path(spark, "store")
    nations = load(spark, sf_dir, "nation").select("n_name", "n_regionkey").collect()  # 25 rows at any scale
    with Store.open(spark, path, wal_batch=10, auto_compact=False) as store:
        for r in nations:
            store.put(r["n_name"].encode(), b"to be overwritten")
            store.put(r["n_name"].encode(), str(r["n_regionkey"]).encode())
            if r["n_regionkey"] == 0:
                store.delete(r["n_name"].encode())
    with Store.open(spark, path, auto_compact=False) as store:
        return store.scan(ordered=False).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def store_policy_compaction(spark, sf_dir):
    """Generations with deletes, a compaction of a ready tier, newer generations above it, and a batched lookup."""
    from siltstone.store import Store

    log = kv_log(spark, sf_dir)
    with Store.open(spark, workspace.work_path(spark, "store"), auto_compact=False) as store:
        for gen in range(6):
            store.apply_many(log.where(F.col("gen") == gen), batch=("kv_log", gen))
            if gen == 4:
                store.compact()
        asked = probes(spark, sf_dir).select(F.col("key").cast("binary").alias("key"))
        return store.multi_get(asked).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        merge_keep_tombstones, merge_drop_tombstones, scan_range, scan_full, scan_start_only, scan_end_only, scan_empty, scan_first_keys,
        point_get, multi_get_tristate, multi_get, file_get_tristate, file_all, file_range_scan, memtable_dump, memtable_len,
        memtable_size_bytes, flush_dedupe, flush_boundaries, num_entries, sstable_count, sparse_index, sparse_index_lookup,
        sparse_index_lookup_many, partial_compaction, oldest_compaction, tombstone_audit, shadowed_versions, wal_replay_prefix,
        wal_replay_checksum, upsert_kv, bloom_no_false_negatives, bloom_prunes_lookups, store_round_trip,
        store_restart, store_policy_compaction,
    )
}

_LOG = """with recursive kv_log as (
  select event_id as seq, printf('user-%04d/%02d', user_id, cast(event_id % 10 as int)) as key,
         case when event_type = 'error' then 2 else 1 end as op,
         case when event_type = 'error' then null else printf('%s:%.2f', event_type, value) end as value,
         cast(event_id * 6 // (select count(*) from events) as int) as gen
  from events),
pl as (select gen, key, op, value from (select *, row_number() over (partition by gen, key order by seq desc) r from kv_log) where r = 1),
d as (select key, op, value, gen from (select *, row_number() over (partition by key order by gen desc, seq desc) r from kv_log) where r = 1),
p as (select distinct printf('user-%04d/%02d', cast(c_custkey % 250 as int), cast(c_custkey % 10 as int)) as key from customer),
si as (select gen, cast((r - 1) // 64 as int) as chunk, min(key) as first_key, count(*) as n_entries
       from (select gen, key, row_number() over (partition by gen order by key) r from pl) group by 1, 2)
"""
_SCAN = "select key, value from d where op = 1"
_PREFIX = (
    "select seq, key, op, value from kv_log where seq < coalesce((select min(seq) from kv_log where seq % 997 = 996 "
    "and seq * 10 >= (select max(seq) * 9 from kv_log)), 9223372036854775807)"
)
_RANGE = f"key between '{LOW}' and '{HIGH}'"

ORACLE_SQL: dict[str, str] = {
    name: _LOG + sql
    for name, sql in {
        "merge_keep_tombstones": "select key, op, value, gen from d",
        "merge_drop_tombstones": "select key, op, value, gen from d where op = 1",
        "scan_range": f"{_SCAN} and {_RANGE}",
        "scan_full": _SCAN,
        "scan_start_only": f"{_SCAN} and key >= '{LOW}'",
        "scan_end_only": f"{_SCAN} and key <= '{HIGH}'",
        "scan_empty": f"{_SCAN} and key between '{HIGH}' and '{LOW}'",
        "scan_first_keys": f"{_SCAN} and key >= '{LOW}' order by key limit 50",
        "point_get": f"select value from d where op = 1 and key = '{PROBE}'",
        "multi_get_tristate": "select p.key, op is not null as exists_here, coalesce(op = 2, false) as is_deleted, value from p left join d on p.key = d.key",
        "multi_get": "select d.key, value from p join d on p.key = d.key where op = 1",
        "file_get_tristate": (
            "select p.key, op is not null as exists_here, coalesce(op = 2, false) as is_deleted, value "
            "from p left join (select * from pl where gen = 2) f on p.key = f.key"
        ),
        "file_all": "select gen, key, op, value from pl",
        "file_range_scan": f"select gen, key, op, value from pl where gen = 2 and {_RANGE}",
        "memtable_dump": "select key, op, value from pl where gen = 5",
        "memtable_len": "select count(*) filter (where op = 1) as live_keys from pl where gen = 5",
        "memtable_size_bytes": "select gen, cast(sum(strlen(key) + coalesce(strlen(value), 0) + 48) as bigint) as size_bytes from kv_log group by gen",
        "flush_dedupe": "select gen, op, count(*) as entries from pl group by gen, op",
        "flush_boundaries": (
            ", sums as (select seq, cast(sum(strlen(key) + coalesce(strlen(value), 0) + 48) over (order by seq) as bigint) as total from kv_log), "
            "flushes as (select cast(0 as bigint) as flush_no, cast(0 as bigint) as base, "
            f"(select min(total) from sums where total >= {THRESHOLD}) as upto union all select flush_no + 1, upto, "
            f"(select min(total) from sums where total >= flushes.upto + {THRESHOLD}) from flushes where upto is not null) "
            "select flush_no, min(seq) as first_seq, max(seq) as last_seq, max(total) as running_bytes from sums join flushes "
            "on total > base and (upto is null or total <= upto) group by 1"
        ),
        "num_entries": "select gen, count(*) as entries from pl group by gen",
        "sstable_count": "select count(distinct gen) as generations from kv_log",
        "sparse_index": "select gen, chunk, first_key, n_entries from si",
        "sparse_index_lookup": f"select gen, max(chunk) as chunk from si where first_key <= '{PROBE}' group by gen",
        "sparse_index_lookup_many": "select p.key, gen, max(chunk) as chunk from p join si on first_key <= p.key group by 1, 2",
        "partial_compaction": "select key, op, value from d",
        "oldest_compaction": _SCAN,
        "tombstone_audit": "select key from d where op = 2 and key in (select key from pl where op = 1)",
        "shadowed_versions": "select key, count(*) - 1 as shadowed from kv_log group by key",
        "wal_replay_prefix": _PREFIX,
        "wal_replay_checksum": _PREFIX,
        "bloom_no_false_negatives": "select distinct key, true as might_contain from kv_log",
        "bloom_prunes_lookups": "select key, op, value from pl where gen = 2 and key in (select key from p)",
        "store_round_trip": _SCAN,
        "store_restart": "select n_name as key, cast(n_regionkey as varchar) as value from nation where n_regionkey <> 0",
        "store_policy_compaction": "select d.key, value from p join d on p.key = d.key where op = 1",
    }.items()
} | {
    "upsert_kv": (
        "select key, value from (select printf('customer-%08d', o_custkey) as key, concat(cast(o_orderkey as varchar), ':', o_orderpriority) as value, "
        "row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) r from orders) where r = 1"
    )
}
