"""Target-distribution importance resampling over hashed n-grams.

Counting: DuckDB, one connection a worker, cuts the texts of a slice into words, unnests them, forms longer runs of
words by window functions, and hashes each distinct feature once through a registered zlib CRC-32; a text's counts by
bucket leave as two arrays and are spilled to Parquet in the shared folder. Spark merges the spilled counts into those
of the corpus and of the target, takes each bucket's gain, and sums a text's gains; the ranks come from a range
partitioning by score. What a text spills has at most ``buckets`` entries, and the gains are one row of ``buckets``
numbers, whatever the corpus.

score = weight + Gumbel noise drawn from a hash of seed and id, so the highest scores are a draw without replacement
whose odds follow the weights. Gains and noise are whole thousandths, rounded down.

Defined results: null texts have no words; a text without features has weight 0; null doc_ids hash as the empty string
and come last among ties; ties of score go to the smaller doc_id, then to the fewer features; repeated rows are scored
and drawn each on its own; an empty target leaves the smoothed odds of the corpus alone; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmesh.llm.common import LOWER, UPPER, documents, slices, state
from seqmesh.operators.order import numbered
from seqmesh.session import materialise, ship

BUCKETS = 10_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_COUNTS = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>"


def _crc32(column: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(x.encode()) for x in column.to_pylist()], pa.int64())


def counting_sql(n: int, buckets: int) -> str:
    """A text's counts by bucket over table ``slice`` (row, text): all runs of 1 to ``n`` words."""
    runs = ["word"]
    for k in range(1, n):
        runs.append(f"{runs[-1]} || ' ' || lead(word, {k}) OVER p")
    window = "WINDOW p AS (PARTITION BY row ORDER BY place)" if n > 1 else ""
    return f"""
    WITH cut AS MATERIALIZED (SELECT row, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM slice),
    placed AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM cut),
    runs AS (SELECT row, unnest([{", ".join(runs)}]) AS gram FROM placed {window}),
    grams AS MATERIALIZED (SELECT row, gram, count(*) AS n FROM runs WHERE gram IS NOT NULL GROUP BY ALL),
    hashed AS (SELECT gram, (zlib_crc32(gram) % {buckets})::INT AS bucket FROM (SELECT DISTINCT gram FROM grams)),
    dealt AS (SELECT row, bucket, sum(n)::BIGINT AS n FROM grams JOIN hashed USING (gram) GROUP BY ALL),
    listed AS (SELECT row, sum(n)::BIGINT AS n_features, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM dealt GROUP BY row)
    SELECT len(words)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
    FROM cut LEFT JOIN listed USING (row) ORDER BY row"""


def _connection():
    import duckdb

    # one thread a worker, and nothing on the executor's own disk
    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    con.create_function("zlib_crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def feature_counts(docs: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """A row for each document: doc_id, n_words, n_features, and the counts of the buckets that it has features in."""
    if n < 1 or buckets < 1:
        raise ValueError("features have one word or more, and there is at least one bucket")
    ship(docs.sparkSession)
    sql = counting_sql(n, buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = state(("importance",), _connection)
        for b in slices(batches):
            con.register("slice", pa.table({"row": pa.array(range(len(b)), pa.int64()), "text": b.column("text")}))
            found = con.sql(sql).to_arrow_table()
            con.unregister("slice")
            columns = [found.column(k).combine_chunks() for k in range(4)]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(c.cast(t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_features", "buckets", "counts"])

    return documents(docs).mapInArrow(run, _COUNTS)


def _merged(spilled: DataFrame, name: str) -> DataFrame:
    """(bucket, ``name``): the counts of all rows; each task adds its own up before anything is shuffled."""
    entries = spilled.select(F.explode(F.arrays_zip("buckets", "counts")).alias("e"))
    return entries.groupBy(F.col("e.buckets").cast("long").alias("bucket")).agg(F.sum("e.counts").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from the spilled counts of both sides, with one added to each count."""
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(F.broadcast(_merged(corpus, "s")), "bucket", "left").join(F.broadcast(_merged(target, "t")), "bucket", "left")
    held = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    held = materialise(held.coalesce(1), "bucket-counts")
    sums = held.agg(F.sum("s"), F.sum("t")).first()
    total_s, total_t = (F.lit(float(x + buckets)) for x in sums)
    s, t = (F.col(c).cast("double") + 1 for c in "st")
    return held.select("bucket", F.floor(1000 * F.log(t * total_s / (s * total_t))).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of the SHA-256 of ``seed:doc_id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, seed: int, percent: int = 10, n: int = 1, buckets: int = BUCKETS, least: int = 20) -> DataFrame:
    """A row for each document: doc_id, n_features, weight, score, and its rank if it is drawn.

    Of the documents with ``least`` words or more, ``percent`` in a hundred (rounded down) are drawn. ``target`` has a
    column text.
    """
    spilled = materialise(feature_counts(docs, n, buckets), "feature-counts")
    wanted = materialise(feature_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets), "target-counts")
    # buckets, a parameter, bounds these numbers
    gain = [r.gain for r in gains(spilled, wanted, buckets).orderBy("bucket").collect()]
    table = docs.sparkSession.createDataFrame([(gain,)], "gains array<long>")
    held = spilled.select("doc_id", "n_words", "n_features", "buckets", "counts", table.scalar().alias("gains"))
    parts = F.zip_with("buckets", "counts", lambda b, c: c * F.get(F.col("gains"), b))
    weight = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
    scored = held.select("doc_id", "n_words", "n_features", weight.alias("weight"))
    scored = materialise(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    fit = F.col("n_words") >= least
    drawn = scored.where(fit).count() * percent // 100
    order = {"_low": -F.col("score"), "_last": F.col("doc_id").isNull().cast("int")}
    placed = numbered(scored.where(fit).withColumns(order), ["_low", "_last", "doc_id", "n_features"], "_place")
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, rank.alias("rank")).unionByName(scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))
