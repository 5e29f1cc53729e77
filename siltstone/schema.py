"""Fixed schemas and operation codes of the key-value engine."""

from __future__ import annotations

from pyspark.sql import types as T

#: Operation codes of an entry.
PUT, DELETE = 1, 2

#: An entry of a generation.  ``recency`` orders generations (larger is newer) and
#: ``seq`` orders entries within one; a tombstone has a null value.
ENTRY = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("recency", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)

#: A record of the write-ahead log; ``crc`` covers op, key and value.
WAL_RECORD = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("crc", T.LongType(), False),
    ]
)
