"""Command line: ``python -m siltstone.cli write|replay|scan PATH ...`` (O-S18, O-S19)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from siltstone.sources.manifest import Files
from siltstone.sources.wal import Record, WriteAheadLog


def write(spark: SparkSession, path: str, count: int, batch: int) -> int:
    """Append records key-%08d to the log of ``path``; reports every 10,000."""
    log = WriteAheadLog(Files(spark, path), batch)
    first = max((r.seq for r in log.replay()), default=0) + 1
    for i in range(count):
        log.append(Record(first + i, 1, b"key-%08d" % i, b"value-%08d-payload" % i))
        if (i + 1) % 10_000 == 0:
            print(f"wrote {i + 1} records", flush=True)
    log.sync()
    print(f"done: {count} records")
    return count


def replay(spark: SparkSession, path: str) -> int:
    """Count the valid records of the log, and show the last key."""
    found = WriteAheadLog(Files(spark, path)).replay(fence=False)
    print(f"recovered {len(found)} records" + (f", last key {found[-1].key.decode('utf-8', 'replace')}" if found else ""))
    return len(found)


def scan(spark: SparkSession, path: str, start: str | None, end: str | None) -> int:
    from siltstone.store import Store

    n = 0
    with Store.open(spark, path, auto_compact=False) as store:
        for key, value in store.items(None if start is None else start.encode(), None if end is None else end.encode()):
            print(key.decode("utf-8", "replace"), value.decode("utf-8", "replace"), sep="\t")
            n += 1
    return n


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltstone")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("write")
    p.add_argument("path")
    p.add_argument("count", type=int)
    p.add_argument("--batch", type=int, default=1000)
    sub.add_parser("replay").add_argument("path")
    p = sub.add_parser("scan")
    p.add_argument("path")
    p.add_argument("--start")
    p.add_argument("--end")
    a = parser.parse_args(args)
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    if a.command == "write":
        write(spark, a.path, a.count, a.batch)
    elif a.command == "replay":
        replay(spark, a.path)
    else:
        scan(spark, a.path, a.start, a.end)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
