"""Row types: reads, alignments, tags."""

from __future__ import annotations

from pyspark.sql import types as T

TAG = T.StructType([T.StructField("tag", T.StringType()), T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])

#: A read as it stands in its file. ``file_idx``: 0 for forward files, 1 for reverse ones; ``rec_idx``: its place.
READ = T.StructType(
    [
        T.StructField("file_idx", T.IntegerType()),
        T.StructField("rec_idx", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("seq", T.StringType()),
        T.StructField("qual", T.StringType()),
    ]
)

#: An alignment as it stands in its file, tags in order.
ALN = T.StructType(
    [
        T.StructField("file_idx", T.IntegerType()),
        T.StructField("rec_idx", T.LongType()),
        T.StructField("qname", T.StringType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("rname", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("mapq", T.IntegerType()),
        T.StructField("cigar", T.StringType()),
        T.StructField("rnext", T.StringType()),
        T.StructField("pnext", T.LongType()),
        T.StructField("tlen", T.LongType()),
        T.StructField("seq", T.StringType()),
        T.StructField("qual", T.StringType()),
        T.StructField("tags", T.ArrayType(TAG)),
    ]
)
