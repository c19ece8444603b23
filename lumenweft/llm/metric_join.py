"""Embedding near-duplicates: an exact metric range join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so the join by cosine is a
range join in a metric.  A bounded sample of vectors are pivots; a vector's
home is the cell of its nearest pivot.  If x has its home in cell i and some y
of cell j < i lies within r of it, then by the triangle inequality

    d(x, p_j) <= d(x, y) + d(y, p_j) <= r + R_j          (R_j: radius of cell j)
    d(x, p_j) - d(x, p_i) <= 2 r,

and x lies within r of the plane between the two pivots.  x is replicated to
the cells j < i for which all three hold, and every cell joins its own vectors
with themselves and with its guests, apart from the others.  A pair is met in
one cell only.  A crowded cell is cut into blocks of bounded size and pairs of
blocks are joined; the kernel keeps counts and a spanning forest, never a pair.

Equal vectors are joined first, by their bytes, and counted.

Where vectors are spread evenly in many dimensions no pivot can separate them:
nearly all become guests and the work grows as the square of their number.
That is the price of exactness here; clustered data prune.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
components, or whose vec_id is null, links with nothing and is its own
component; vectors of unlike length do not link; repeated rows are vectors of
their own and link.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, hash_sample, table
from .components import components

COSINE = 0.9
#: Vectors per cell that the number of pivots aims at, and the most pivots.
CELL_ROWS, MOST_PIVOTS = 4096, 2048
#: The most own vectors and guests that one join of blocks holds.
OWN_BLOCK, GUEST_BLOCK = 16384, 65536
_SLACK = 1e-9
#: Distances to pivots that one step holds.
DISTANCES = 1 << 20
#: A dense group of so many rows in a block is counted as a ball; so many centres are tried.
BALL_ROWS, BALL_TRIES = 512, 16


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and the vector's bytes in double precision, divided by its norm; null where it links with nothing."""
    for batch in batches:
        units = []
        for v in batch.column(1).to_pylist():
            unit = None
            if v and None not in v:
                x = np.asarray(v, np.float64)
                most = np.abs(x).max()
                if np.isfinite(most) and most > 0:
                    x = x / most
                    unit = (x / np.sqrt(x @ x)).tobytes()
            units.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary())], ["id", "unit"])


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lower the labels (indexes of roots) until each pair shares one."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j = i[differ], j[differ]
        high, low = np.maximum(a[differ], b[differ]), np.minimum(a[differ], b[differ])
        parent = np.arange(len(label))
        np.minimum.at(parent, high, low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label = parent[label]


def _ball(units: np.ndarray, free: np.ndarray, half: float) -> np.ndarray | None:
    """Of the free rows the largest ball of angle ``half`` about one of a few of them; None if it is small."""
    at = np.nonzero(free)[0]
    if len(at) < BALL_ROWS:
        return None
    centres = at[:: -(-len(at) // BALL_TRIES)]
    near = units[at] @ units[centres].T >= np.cos(half)
    best = int(near.sum(0).argmax())
    inside = at[near[:, best]]
    if len(inside) < BALL_ROWS:
        return None
    return np.concatenate([[centres[best]], inside[inside != centres[best]]])


def link_block(ids: np.ndarray, copies: np.ndarray, units: np.ndarray, own: int, inside: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (copies counted) and forest label of each row.

    Rows below ``own`` are joined with those from ``own`` on, and with each
    other where ``inside``.  By the triangle inequality rows within half the
    angle of one centre all link, and a row much nearer or farther than the
    angle links with all or none of them: dense groups are counted, not compared.
    """
    n = len(ids)
    links, label = np.zeros(n, np.int64), np.arange(n)

    def pairs(rows: np.ndarray, others: np.ndarray, upper: bool) -> None:
        """Compare rows with others; where ``upper`` only with those of a greater index."""
        nonlocal label
        step = max(1, (1 << 21) // max(1, len(others)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            rest = others[others > some[0]] if upper else others
            near = units[some] @ units[rest].T >= cosine
            if upper:
                near &= rest[None, :] > some[:, None]
            i, j = np.nonzero(near)
            if len(i):
                i, j = some[i], rest[j]
                links[:] += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
                label = _forest(label, i, j)

    free = np.ones(own, bool)
    limit = float(np.arccos(cosine))
    slack = 1e-6  # far beyond rounding; what it leaves open is compared
    while inside and (ball := _ball(units[:own], free, limit / 2 - slack)) is not None:
        free[ball] = False
        centre = units[ball[0]]
        radius = float(np.arccos(np.clip(units[ball] @ centre, -1, 1)).max())
        total = copies[ball].sum()
        links[ball] += total - copies[ball]
        label = _forest(label, np.full(len(ball) - 1, ball[0]), ball[1:])
        rest = np.concatenate([np.nonzero(free)[0], np.arange(own, n)])
        angle = np.arccos(np.clip(units[rest] @ centre, -1, 1))
        whole = rest[angle <= limit - radius - slack]
        if len(whole):
            links[ball] += copies[whole].sum()
            links[whole] += total
            label = _forest(label, np.full(len(whole), ball[0]), whole)
        pairs(rest[(angle > limit - radius - slack) & (angle < limit + radius + slack)], ball, False)
    rows = np.nonzero(free)[0]
    if inside:
        pairs(rows, rows, True)
    pairs(rows, np.arange(own, n), False)
    return links, label


def _slices(batch: pa.RecordBatch, pivots: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts small enough for a table of distances to all pivots."""
    step = max(1, DISTANCES // max(1, pivots))
    return (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def _pivots(classes: DataFrame, most: int) -> np.ndarray:
    rows = hash_sample(classes.select("id", "unit"), "id", most, 31)
    return np.array([np.frombuffer(r.unit) for r in rows])


def _cells(classes: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """cell, own, id, copies, unit: a row for the home cell and one for each cell of which it is a guest."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for some in _slices(batch, len(p)):
                x = np.frombuffer(b"".join(some.column(0).to_pylist())).reshape(some.num_rows, -1)
                cos = x @ p.T
                at = cos.argmax(1)
                far = np.sqrt(np.maximum(0, 2 - 2 * cos[np.arange(len(x)), at]))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(far, pa.float64())], ["cell", "far"])

    radii = np.zeros(len(pivots))
    if len(pivots) > 1:
        for r in classes.select("unit").mapInArrow(home, "cell int, far double").groupBy("cell").agg(F.max("far").alias("r")).collect():
            radii[r.cell] = r.r
    spans = classes.sparkSession.sparkContext.broadcast(radii)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, reach = shared.value, spans.value + radius + _SLACK
        between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
        for batch in (some for whole in batches for some in _slices(whole, len(p))):
            x = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(batch.num_rows, -1)
            cos = x @ p.T
            square = np.maximum(0, 2 - 2 * cos)
            own = cos.argmax(1)
            d = np.sqrt(square)
            mine = d[np.arange(len(x)), own]
            plane = (square - mine[:, None] ** 2) <= 2 * (radius + _SLACK) * between[own] + _SLACK
            guest = plane & (d <= reach) & (d - mine[:, None] <= 2 * radius + _SLACK) & (np.arange(len(p))[None, :] < own[:, None])
            row, cell = np.nonzero(guest)
            row, cell = np.concatenate([np.arange(len(x)), row]), np.concatenate([own, cell])
            for at in range(0, len(row), 8192):  # replicas leave in small batches
                part = pa.array(row[at : at + 8192])
                isown = np.arange(at, at + len(part)) < len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[at : at + 8192], pa.int32()), pa.array(isown), *[batch.column(i).take(part) for i in range(3)]],
                    ["cell", "own", "id", "copies", "unit"],
                )

    return classes.select("id", "copies", "unit").mapInArrow(place, "cell int, own boolean, id long, copies long, unit binary")


def _joined(placed: DataFrame, cosine: float) -> DataFrame:
    """id, links and root (a linked id, the least of its block's component)."""
    sizes = placed.groupBy("cell").agg(F.count_if("own").alias("h"), F.count_if(~F.col("own")).alias("g"))
    blocks = sizes.select("cell", F.greatest(F.ceil(F.col("h") / OWN_BLOCK), F.lit(1)).alias("hb"), F.ceil(F.col("g") / GUEST_BLOCK).alias("gb"))
    cut = placed.join(F.broadcast(blocks), "cell")  # at most MOST_PIVOTS rows
    own, guest = F.col("own"), ~F.col("own")
    k = F.pmod(F.xxhash64("id"), F.when(own, F.col("hb")).otherwise(F.greatest("gb", F.lit(1))))
    cut = cut.withColumn("k", k)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # own block i meets blocks j >= i, itself included, and all guest blocks
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    to_own = F.transform(every(F.col("hb")), lambda j: pair("own", F.least(j, F.col("k")), F.greatest(j, F.col("k"))))
    to_guest = F.when(F.col("gb") > 0, F.transform(every(F.greatest("gb", F.lit(1))), lambda j: pair("guest", F.col("k"), j))).otherwise(F.array().cast("array<struct<kind:string,i:bigint,j:bigint>>"))
    met = F.transform(every(F.col("hb")), lambda i: pair("guest", i, F.col("k")))
    spread = cut.select("cell", "own", "id", "copies", "unit", "k", F.explode(F.when(own, F.concat(to_own, to_guest)).otherwise(met)).alias("p"))

    def join(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        kind, i = t["kind"][0].as_py(), t["i"][0].as_py()
        inside = kind == "own" and i == t["j"][0].as_py()
        if kind == "own":
            first = np.ones(len(t), bool) if inside else t["k"].to_numpy() == i
        else:
            first = t["own"].to_numpy()
        ids, copies = t["id"].to_numpy(), t["copies"].to_numpy()
        lengths = np.array([len(u.as_buffer()) for u in t["unit"]])
        out_id, out_links, out_root = [], [], []
        for length in np.unique(lengths):  # vectors of unlike length do not meet
            own_at, rest_at = (np.nonzero((lengths == length) & f)[0] for f in (first, ~first))
            own_at, rest_at = own_at[np.argsort(ids[own_at])], rest_at[np.argsort(ids[rest_at])]
            at = np.concatenate([own_at, rest_at])
            if not len(own_at):
                continue
            units = np.frombuffer(b"".join(t["unit"].take(pa.array(at)).to_pylist())).reshape(len(at), -1)
            links, label = link_block(ids[at], copies[at], units, len(own_at), inside, cosine)
            on = links > 0
            out_id.append(ids[at][on])
            out_links.append(links[on])
            out_root.append(ids[at][label][on])
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"id": flat(out_id), "links": flat(out_links), "root": flat(out_root)})

    flat = spread.select("cell", "own", "id", "copies", "unit", "k", "p.kind", "p.i", "p.j")
    return flat.groupBy("cell", "kind", "i", "j").applyInArrow(join, "id long, links long, root long")


def range_join(vectors: DataFrame, *, cosine: float = COSINE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector (columns vec_id and embedding)."""
    units = vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding").mapInArrow(_valid, "id long, unit binary")
    units = checkpointed(units.withColumn("digest", F.sha2("unit", 256)))
    usable = units.where("unit IS NOT NULL AND id IS NOT NULL")
    classes = checkpointed(usable.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit")))
    dims = [r.n for r in classes.select(F.octet_length("unit").alias("n")).distinct().collect()]
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    found = None
    for dim in dims:  # one range join per length of vector
        same = classes.where(F.octet_length("unit") == dim) if len(dims) > 1 else classes
        k = int(min(MOST_PIVOTS, max(1, -(-same.count() // cell_rows))))
        part = _joined(_cells(same, _pivots(same, k), radius), cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return units.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = checkpointed(found)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found, "id", "root").withColumnRenamed("node", "id")
    known = classes.select("digest", "id", "copies").join(links, "id", "left").join(roots, "id", "left")
    known = known.select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    out = units.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(known, "digest", "left")
    component = F.coalesce("c", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN comp c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
