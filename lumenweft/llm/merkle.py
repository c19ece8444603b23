"""Fixity audit of web archive replicas with Merkle trees.

A record's digest is the SHA-256 of its id, url and body.  Records are ordered
by id; a *range* is ``RANGE`` consecutive ids, below zero as above, and its leaf
hashes the ordered list of its ids, each with the number and the sum of its
records' digests (four 64-bit lanes as exact decimals): rows of one id combine
before the shuffle, so an id with very many rows stays cheap, and repeated rows
count as often as they occur.  Inner nodes hash the ordered digests of at most
``FAN_OUT`` children.  All replicas' trees are built in one go, side by side,
and each level is written before the next one reads it.

The audit compares the replicas' roots and ends there where they agree.  Then
it walks down: of each level only the children of nodes that differ are read.
Only the ranges that differ at the bottom are opened and compared record by
record.

Defined cases: a null url or body is told apart from an empty one; records of
a null id form a range and a branch of their own (a null range, compared as a
multiset); ids may be negative and as large as a long holds; a record that one
replica lacks is ``missing`` or ``extra`` there, one with other content is
``corrupt`` and one held in another number is ``miscounted``; two empty
replicas agree.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

RANGE = 64
FAN_OUT = 16
_FAULTS = "id long, range_begin long, range_end long, status string, primary_n long, replica_n long"


def record_digest(*columns: Column) -> Column:
    """SHA-256 over length-prefixed fields, so that no two field lists give the same bytes."""
    fields = []
    for c in columns:
        text = c.cast("string")
        fields += [F.coalesce(F.octet_length(text).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))]
    return F.sha2(F.concat(*fields), 256)


def _div(c: Column, by: int) -> Column:
    """Floor of c / by in whole numbers: exact for every long."""
    return F.call_function("div", c, F.lit(by).cast("long")) - F.when(c % by < 0, 1).otherwise(0)


def records(pages: DataFrame, *, key: str = "page_id", fields: tuple[str, ...] = ("url", "html"), span: int = RANGE) -> DataFrame:
    """range long, id long, digest string of every record."""
    k = F.col(key).cast("long")
    return pages.select(_div(k, span).alias("range"), k.alias("id"), record_digest(k, *map(F.col, fields)).alias("digest"))


def leaves(recs: DataFrame) -> DataFrame:
    """side, node long, digest: one row per side and range that holds records (columns side, range, id, digest)."""
    lanes = [F.sum(F.conv(F.substring("digest", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{i}") for i in range(4)]
    each = recs.groupBy("side", "range", "id").agg(F.count("*").cast("string").alias("n"), *lanes)
    row = F.struct("id", F.concat_ws(",", F.coalesce(F.col("id").cast("string"), F.lit("-")), "n", *[f"s{i}" for i in range(4)]).alias("t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["t"]), ";")
    return each.groupBy("side", F.col("range").alias("node")).agg(F.sha2(text, 256).alias("digest"))


def parents(level: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """The next level: the digest of at most fan_out ordered children (the null node stays alone)."""
    kids = F.sort_array(F.collect_list(F.struct("node", "digest")))
    text = F.array_join(F.transform(kids, lambda x: F.concat_ws("=", F.coalesce(x["node"].cast("string"), F.lit("-")), x["digest"])), ",")
    return level.groupBy("side", _div(F.col("node"), fan_out).alias("up")).agg(F.sha2(text, 256).alias("digest")).select("side", F.col("up").alias("node"), "digest")


def tree(recs: DataFrame, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Levels from the leaves to the roots: at most the nodes 0, -1 (ids below zero) and null of each side."""
    levels = [checkpointed(leaves(recs))]
    while levels[-1].where("node NOT IN (0, -1)").limit(1).count():
        levels.append(checkpointed(parents(levels[-1], fan_out)))
    return levels


def _unlike(level: DataFrame) -> DataFrame:
    """Nodes whose digests are not the same on both sides."""
    both = level.groupBy("node").agg(F.max(F.when(F.col("side") == 0, F.col("digest"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("digest"))).alias("r"))
    return both.where(~F.col("l").eqNullSafe(F.col("r"))).select("node")


def differing_ranges(levels: list[DataFrame], fan_out: int = FAN_OUT) -> DataFrame | None:
    """Compare the roots and descend, reading the children of nodes that differ; None if the roots agree."""
    suspects = checkpointed(_unlike(levels[-1]))
    if suspects.isEmpty():
        return None
    for level in reversed(levels[:-1]):
        below = level.withColumn("up", _div(F.col("node"), fan_out)).alias("c").join(suspects.alias("s"), F.col("c.up").eqNullSafe(F.col("s.node")), "left_semi")
        suspects = checkpointed(_unlike(below))
    return suspects.select(F.col("node").alias("range"))


def audit(primary: DataFrame, replica: DataFrame, *, key: str = "page_id", fields: tuple[str, ...] = ("url", "html"), span: int = RANGE, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per id whose records differ: id, range_begin, range_end, status, primary_n, replica_n.

    The counts are of the records that the other replica does not match.
    """
    sides = [records(x, key=key, fields=fields, span=span).withColumn("side", F.lit(s)) for s, x in enumerate((primary, replica))]
    recs = sides[0].unionByName(sides[1])
    bad = differing_ranges(tree(recs, fan_out), fan_out)
    if bad is None:
        return primary.sparkSession.createDataFrame([], _FAULTS)
    opened = recs.alias("x").join(bad.alias("b"), F.col("x.range").eqNullSafe(F.col("b.range")), "left_semi")
    counts = [F.count_if(F.col("side") == s).alias(n) for s, n in enumerate(("p", "r"))]
    counted = opened.groupBy("range", "id", "digest").agg(*counts)
    faults = counted.where(F.col("p") != F.col("r")).groupBy("range", "id").agg(F.sum("p").alias("primary_n"), F.sum("r").alias("replica_n"))
    status = F.when(F.col("replica_n") == 0, "missing").when(F.col("primary_n") == 0, "extra").when(F.col("primary_n") == F.col("replica_n"), "corrupt").otherwise("miscounted")
    begin = F.col("range") * span
    return faults.select("id", begin.alias("range_begin"), (begin + span - 1).alias("range_end"), status.alias("status"), "primary_n", "replica_n")


def damaged(pages: DataFrame) -> DataFrame:
    """The replica that the query audits: pages with planted faults of every kind."""
    p = F.col("page_id")
    html = (
        F.when(p % 389 == 7, F.concat("html", F.lit(" ")))
        .when(p % 1021 == 3, F.substring("html", 1, 40))
        .when(p.between(640, 700), F.lit(None))
        .otherwise(F.col("html"))
    )
    kept = pages.where((p % 1511 != 11) | p.isNull()).select("page_id", "url", html.alias("html"))
    return kept.unionByName(pages.where(p % 2003 == 5).select("page_id", "url", "html"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages)).withColumnRenamed("id", "page_id")


SQL = """
WITH a AS (SELECT page_id, url, html FROM pages),
b AS (
  SELECT page_id, url, CASE WHEN page_id % 389 = 7 THEN html || ' ' WHEN page_id % 1021 = 3 THEN substring(html, 1, 40)
    WHEN page_id BETWEEN 640 AND 700 THEN NULL ELSE html END AS html FROM pages WHERE page_id % 1511 <> 11 OR page_id IS NULL
  UNION ALL SELECT page_id, url, html FROM pages WHERE page_id % 2003 = 5
), counted AS (
  SELECT page_id, url, html, sum(p) AS p, sum(1 - p) AS r
  FROM (SELECT *, 1 AS p FROM a UNION ALL SELECT *, 0 AS p FROM b) GROUP BY ALL HAVING sum(p) <> sum(1 - p)
), faults AS (SELECT page_id, sum(p)::BIGINT AS primary_n, sum(r)::BIGINT AS replica_n FROM counted GROUP BY page_id)
SELECT page_id, page_id - (page_id % 64 + 64) % 64 AS range_begin, page_id - (page_id % 64 + 64) % 64 + 63 AS range_end,
  CASE WHEN replica_n = 0 THEN 'missing' WHEN primary_n = 0 THEN 'extra' WHEN primary_n = replica_n THEN 'corrupt' ELSE 'miscounted' END AS status,
  primary_n, replica_n FROM faults
"""
