"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass one scatters the whole rows uniformly into buckets small enough for memory,
by number of rows and by bytes: the shard comes from ``key`` by rendezvous
hashing, the bucket within the shard from a second seeded hash.  Pass two
gathers each bucket, Fisher-Yates shuffles it and lays the buckets end to end,
which gives every row a gapless slot in its shard.  Buckets are dealt to tasks
in ranges, so the shards are written where the buckets were gathered and the
rows move once (twice where the table of offsets, one row a bucket, is longer
than ``BROADCAST_ROWS``).

Law ``key``: the shard is the index whose seeded hash with the key is greatest
(ties: the smaller index).  One more shard adds one candidate, so a row either
stays or moves to the new shard.

The Fisher-Yates fold swaps within an array that is put in the order of the
rows' hashes first (two of 64 bits over all columns, nulls told apart) and draws
from a hash of (seed, bucket, step), so a lost task, or rows that arrive in
another order, give the same slots again.  A swap copies the bucket's array of
indexes, which is why a bucket is a few hundred rows.  A bucket that outgrew its
bound (one key on very many rows, very long rows) is split by the rows' hashes
into as many parts as it needs; its equal rows travel as one row with a number,
in blocks no larger than a bucket, and are written out again where they are
gathered.  Offsets are prefix sums in two levels, so that no task reads all
buckets of a shard.

Defined cases: a null key is a key of its own; a null text has no bytes; rows
that are equal in all columns are each kept and are interchangeable; an empty
table gives no rows; further columns of any type ride along; a column of the
input named ``shard`` or ``slot`` is written with an underscore after its name.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, shared_folder, table

#: Rows and bytes that one bucket holds on average; the unit of memory in pass two.
BUCKET_ROWS = 256
BUCKET_BYTES = 512 << 10
#: The most rows of four numbers each that are broadcast; a longer table is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_RUNS = itertools.count()


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    weights = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("w"), F.lit(-i).alias("i")) for i in range(shards)]
    return (-F.greatest(*weights)["i"] if shards > 1 else F.lit(0)).cast("int")


def fisher_yates(n: Column, seed: Column) -> Column:
    """A random order of 1..n: for i = n .. 2 swap elements i and j, 1 <= j <= i, drawn from hash(seed, i)."""

    def swap(a: Column, i: Column) -> Column:
        j = (F.pmod(F.xxhash64(seed, i), i) + 1).cast("int")
        moved = F.concat(
            F.slice(a, F.lit(1), j - 1),
            F.array(F.element_at(a, i)),
            F.slice(a, j + 1, i - j - 1),
            F.array(F.element_at(a, j)),
            F.slice(a, i + 1, n - i),
        )
        return F.when(i == j, a).otherwise(moved)

    steps = F.when(n > 1, F.sequence(n, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.sequence(F.lit(1), n), swap)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts and nested values by their length, 8 for every other column."""
    total = F.lit(8 * len(df.columns)).cast("long")
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.StructType)):
            c = c.cast("string")
        elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            continue
        total = total + F.coalesce(F.octet_length(c), F.lit(0))
    return total


def _row_hash(df: DataFrame, seed: int) -> Column:
    """64 bits of all columns; nulls and nested values are told apart, equal rows are not."""
    parts = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, T.AtomicType):
            c = F.to_json(F.struct(c), {"ignoreNullFields": "false"})
        parts += [c, c.isNull()]
    return F.xxhash64(F.lit(seed), *parts)


def _explode(n: Column, name: str, df: DataFrame, step: int = 1 << 16) -> DataFrame:
    """A row for each of 0 .. n - 1, without an array longer than ``step``."""
    some = df.withColumn("__n", n).withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {step}"))))
    last = F.least(F.col("__n"), (F.col("__at") + 1) * step) - 1
    return some.withColumn(name, F.explode(F.sequence(F.col("__at") * step, last))).drop("__n", "__at")


def _small(df: DataFrame) -> DataFrame:
    """A table of a few numbers a row, marked for broadcast where its count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def scatter(df: DataFrame, key: str, shards: int, *, seed: int, bucket_rows: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Pass one: entries with their shard, bucket and part, the sizes of the parts, and the columns that tell parts apart.

    An entry is a row, or ``n`` equal rows of a crowded bucket, with ``h1``,
    ``h2`` and ``block`` for its place; all follow from the rows alone.
    """
    total, volume = df.select(row_bytes(df).alias("bytes")).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    per_shard = max(1, -(-total // (shards * bucket_rows)), -(-volume // (shards * bucket_bytes)))
    k = F.col(f"`{key}`")
    entries = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        row_bytes(df).alias("bytes"),
        rendezvous(k, shards, seed).alias("shard"),
        rendezvous(k, shards + 1, seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), k), F.lit(per_shard)).alias("bucket"),
        _row_hash(df, seed + 3).alias("h1"),
        _row_hash(df, seed + 4).alias("h2"),
    )
    sizes = entries.groupBy("shard", "bucket").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes"))
    needed = F.ceil(F.greatest(F.col("count") / bucket_rows, F.col("bytes") / bucket_bytes))
    crowded = sizes.where((F.col("count") > 8 * bucket_rows) | (F.col("bytes") > 4 * bucket_bytes)).select("shard", "bucket", needed.alias("parts"))
    single = [F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("n")]
    crowded = checkpointed(crowded)
    if crowded.isEmpty():
        # a constant part is no key: it would hide from the planner that rows are dealt as they are grouped
        return entries.select("*", *single), sizes.withColumn("part", F.lit(0).cast("long")), ["shard", "bucket"]
    crowded = _small(crowded)
    calm = entries.join(crowded, ["shard", "bucket"], "left_anti").select("*", *single)
    same = entries.join(crowded, ["shard", "bucket"]).groupBy("shard", "bucket", "h1", "h2", "parts")
    merged = same.agg(F.count("*").alias("m"), *[F.first(c).alias(c) for c in ("row", "bytes", "grown_shard")])
    fit = F.greatest(F.lit(1), F.least(F.lit(bucket_rows), F.floor(F.lit(bucket_bytes) / F.greatest("bytes", F.lit(1)))))
    cut = _explode(F.ceil(F.col("m") / F.col("fit")), "block", merged.withColumn("fit", fit))
    cut = cut.withColumn("n", F.least(F.col("fit"), F.col("m") - F.col("block") * F.col("fit"))).withColumn("part", F.pmod(F.xxhash64("h1", "h2", "block"), "parts"))
    entries = calm.unionByName(cut.select(*calm.columns))
    at = ["shard", "bucket", "part"]
    return entries, entries.groupBy(*at).agg(F.sum("n").alias("count"), F.sum(F.col("n") * F.col("bytes")).alias("bytes")), at


def _offsets(sizes: DataFrame, span: int = 4096) -> DataFrame:
    """The slot at which each part begins: sums within ranges of buckets, and over the ranges before."""
    ranged = sizes.withColumn("range", F.expr(f"bucket div {span}"))
    inside = Window.partitionBy("shard", "range").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = ranged.groupBy("shard", "range").agg(F.sum("count").alias("total"))
    base = totals.select("shard", "range", F.coalesce(F.sum("total").over(before), zero).alias("base"))
    placed = ranged.withColumn("within", F.coalesce(F.sum("count").over(inside), zero)).join(base, ["shard", "range"])
    return placed.select("shard", "bucket", "part", (F.col("base") + F.col("within")).alias("offset"))


def shuffle_into_shards(df: DataFrame, key: str, shards: int, *, seed: int = 17, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """shard int, slot long, grown_shard int (with one more shard) and ``row``, a struct of all columns of df."""
    entries, sizes, at = scatter(df, key, shards, seed=seed, bucket_rows=bucket_rows, bucket_bytes=bucket_bytes)
    offsets = _small(checkpointed(_offsets(sizes).select(*at, "offset")))
    # pass two: gather a part, put it in a fixed order, shuffle it, lay it at its offset
    dealt = entries.select(*at, "h1", "h2", "block", "n", "row", "grown_shard").repartitionByRange(*at)
    gathered = dealt.groupBy(*at).agg(F.collect_list(F.struct("h1", "h2", "block", "n", "row", "grown_shard")).alias("rows"))
    # the indexes of the entries in the order of their hashes, one for each row that an entry stands for
    keys = F.sort_array(F.transform("rows", lambda r, i: F.struct(r["h1"], r["h2"], r["block"], i.alias("i"), r["n"].cast("int").alias("n"))))
    single = F.transform(keys, lambda e: e["i"])
    many = F.flatten(F.transform(keys, lambda e: F.array_repeat(e["i"], e["n"])))
    sorted_ = gathered.select(*at, "rows", F.when(F.exists("rows", lambda r: r["n"] > 1), many).otherwise(single).alias("index"))
    order = fisher_yates(F.size("index"), F.xxhash64(F.lit(seed + 2), *at))
    laid = sorted_.select(*at, "rows", "index", order.alias("order")).join(offsets, at)

    def place(nth: Column, pos: Column) -> Column:
        one = F.element_at("rows", F.element_at("index", nth) + 1)
        return F.struct((F.col("offset") + pos).cast("long").alias("slot"), one["grown_shard"].alias("grown_shard"), one["row"].alias("row"))

    return laid.select("shard", F.inline(F.transform("order", place)))


def flat(shuffled: DataFrame) -> DataFrame:
    """shard, slot and the row's own columns; those named shard or slot get an underscore after their name."""
    own = shuffled.schema["row"].dataType.names
    taken = {"shard", "slot"} | {n.lower() for n in own}
    named = []
    for n in own:
        out = n
        if n.lower() in ("shard", "slot"):
            while out.lower() in taken:
                out += "_"
            taken.add(out.lower())
        named.append(F.col("row").getField(n).alias(out))
    return shuffled.select("shard", "slot", *named)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard, the rows of a file in slot order; many files a shard, each of bounded size."""
    flat(shuffled).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """Write the shards of whole documents and digest them as they were written."""
    docs = table(spark, sf_dir, "documents")
    shuffled = shuffle_into_shards(docs, "doc_id", shards)
    path = f"{shared_folder(spark)}/shards-{spark.sparkContext.applicationId}-{next(_RUNS)}"
    write_shards(shuffled, path)
    written = spark.read.schema(flat(shuffled).schema).parquet(path)
    return written.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        rendezvous(F.col("doc_id"), shards + 1, 17).alias("grown_shard"),
    )
