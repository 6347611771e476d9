"""Embedding near-duplicates by PCA-ordered tiled comparison (operator 1).

Equal vectors of a label are one class.  Classes are rotated to principal axes, which keeps products.  Slabs of a label are
consecutive by cells of the second and third axis and then by the first, so that they are narrow in three; two slabs meet
in one task if the boxes around two of their tiles allow a link, and a slab travels once per slab near it.  Inside, slabs are cut into tiles by halving the widest of the leading axes, and two tiles are compared if the boxes around
them allow a link: products of the leading axes are summed first, the rest is bounded by the norms of the remaining parts,
and pairs that cannot reach the threshold stop there.  What is left is decided by the cosine of the vectors themselves in
double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise
from .components import connected_components

THRESHOLD = 0.93
#: Classes in a slab and in a tile, and the axis numbers after which products are cut off.
SLAB, TILE = 4096, 256
STAGES = (8, 24)
#: Leading axes by which tiles are cut and their boxes compared.
BOX = 8
#: Lengths of vectors, the commonest first, that get principal axes; others keep their own axes, which bound as surely.
LENGTHS = 16
#: Allowance for rounding in bounds; the decision itself has none.
_SLACK = 1e-9
#: Leading axes by whose cells tiles look each other up.
CELL_AXES = 3
SLAB_SCHEMA = "label string, dims int, slab long, low array<array<double>>, high array<array<double>>, ids array<long>, copies array<long>, vectors binary"
PART_SCHEMA = "id long, to long, links long"


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each of the commonest vector lengths the rotation to principal axes, from the summed second moments of its unit
    vectors.  What reaches the driver depends on these lengths alone."""
    common = [r["d"] for r in classes.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect()]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, rows in _by_length(batch.column(0)).items():
                unit = _unit(rows[1])
                sums[dims] = sums.get(dims, 0) + unit.T @ unit
        for dims, m in sums.items():
            flat = m.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), dims, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["dims", "at", "value"])

    summed = classes.where(F.size("vector").isin(common)).select("vector").mapInArrow(moments, "dims int, at int, value double").groupBy("dims", "at").agg(F.sum("value").alias("value"))
    cells: dict[int, dict[int, float]] = {}
    for row in summed.collect():
        cells.setdefault(row["dims"], {})[row["at"]] = row["value"]
    return {d: np.linalg.eigh(np.array([v[k] for k in range(d * d)]).reshape(d, d))[1][:, ::-1].copy() for d, v in cells.items()}


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) of the vectors of each length."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = column.offsets.to_numpy()[:-1]
    out = {}
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        out[d] = (rows, values[starts[rows][:, None] + np.arange(d)[None, :]])
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its greatest component near 1: exact, and products neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = _scaled(x)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _turn(x: np.ndarray, rotation: dict[int, np.ndarray]) -> np.ndarray:
    return x @ rotation[x.shape[1]] if x.shape[1] in rotation else x


def _lead(x: np.ndarray, rotation: dict[int, np.ndarray]) -> np.ndarray:
    """The leading axes of unit vectors, turned; vectors of fewer dimensions have zeros there."""
    turned = _turn(_unit(x), rotation)[:, :BOX]
    return np.pad(turned, ((0, 0), (0, BOX - turned.shape[1])))


def _reach(threshold: float) -> float:
    """How far apart two unit vectors may lie that link; no less than a twentieth, so that cells stay few."""
    return max((max(0.0, 2 - 2 * threshold) + _SLACK) ** 0.5, 0.05)


def _order(lead: np.ndarray, reach: float) -> np.ndarray:
    """The place of each row: by cells as wide as ``reach`` on the second and third axis, then by the first axis."""
    cell = lambda axis: np.floor(lead[:, axis] / reach).astype(np.int64) + 32
    return (cell(1) << 54) | (cell(2) << 48) | np.clip((lead[:, 0] + 1) * (1 << 46), 0, (1 << 48) - 1).astype(np.int64)


def slab_pairs(slabs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the slabs of one label and length, a <= b, of which the boxes around two tiles allow a link.

    Tiles look each other up by the cells, as wide as a link can reach, that their boxes touch in the first ``CELL_AXES`` axes; what
    shares a cell is compared by the whole boxes.  Only boxes travel here, one small row per tile and cell.
    """
    reach2, reach = max(0.0, 2 - 2 * threshold) + _SLACK, _reach(threshold)
    boxes = slabs.select("label", "dims", "slab", F.explode(F.arrays_zip("low", "high")).alias("box")).select("label", "dims", "slab", "box.low", "box.high")

    def in_cells(wider: float) -> DataFrame:
        out = boxes
        for axis in range(CELL_AXES):
            cell = lambda c, by: F.floor((F.col(c)[axis] + by) / reach).cast("int")  # noqa: B023, E731
            out = out.withColumn(f"c{axis}", F.explode(F.sequence(cell("low", -wider), cell("high", wider))))
        return out

    cells = [f"c{axis}" for axis in range(CELL_AXES)]
    own = in_cells(0.0).withColumnsRenamed({"slab": "a", "low": "a_low", "high": "a_high"})
    other = in_cells(reach).withColumnRenamed("slab", "b")
    gap = lambda z: F.greatest(F.lit(0.0), z["low"] - z["a_high"], z["a_low"] - z["high"])
    apart = F.aggregate(F.arrays_zip("a_low", "a_high", "low", "high"), F.lit(0.0), lambda total, z: total + gap(z) * gap(z))
    return own.join(other, ["label", "dims", *cells]).where(F.col("a") <= F.col("b")).where(apart <= reach2).select("a", "b").distinct()


def _slabs(classes: DataFrame, rotation: dict[int, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """Slabs of up to ``SLAB`` classes of one label and length, consecutive in ``_order``, with the boxes around its tiles."""
    reach = _reach(threshold)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.zeros(batch.num_rows, np.int64)
            for rows, x in _by_length(batch.column(3)).values():
                at[rows] = _order(_lead(x, rotation), reach)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["id", "label", "copies", "vector", "place"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            nonlocal seq
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            vectors = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lead = _lead(vectors.reshape(len(rows), -1), rotation)
            tiles = _tiles(lead, TILE)
            row = [rows["label"][0].as_py(), rows["dims"][0].as_py(), (part << 32) | seq, [lead[t].min(0).tolist() for t in tiles], [lead[t].max(0).tolist() for t in tiles], rows["id"].to_numpy(), rows["copies"].to_numpy(), vectors.tobytes()]
            seq += 1
            types = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.float64())), pa.list_(pa.list_(pa.float64())), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[f.split()[0] for f in SLAB_SCHEMA.split(", ")])

        key = lambda batch, k: (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
        for batch in batches:
            if not batch.num_rows:
                continue
            label, dims = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(1 + np.flatnonzero((label[1:] != label[:-1]) | (dims[1:] != dims[:-1]))).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and key(held[0], 0) != key(batch, a):
                    yield close()
                while a < b:
                    n = min(b - a, SLAB - sum(h.num_rows for h in held))
                    held.append(batch.slice(a, n))
                    a += n
                    if sum(h.num_rows for h in held) == SLAB:
                        yield close()
        if held:
            yield close()

    placed = classes.select("id", "label", "copies", "vector").mapInArrow(place, "id long, label string, copies long, vector array<double>, place long")
    ordered = placed.select("label", F.size("vector").alias("dims"), "place", "id", "copies", "vector").repartitionByRange("label", "dims", "place").sortWithinPartitions("label", "dims", "place", "id")
    return materialise(ordered.mapInArrow(gather, SLAB_SCHEMA), "slabs")


def _tiles(turned: np.ndarray, most: int = TILE) -> list[np.ndarray]:
    """Rows in tiles of up to ``most``, by halving at the median of the widest of the leading axes."""
    out, todo = [], [np.arange(len(turned))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        lead = turned[rows, :BOX]
        axis = int((lead.max(0) - lead.min(0)).argmax())
        order = rows[np.argsort(lead[:, axis], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def near_pairs(a: np.ndarray, b: np.ndarray, rotation: dict[int, np.ndarray], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of rows of two slabs with a cosine of ``threshold`` or more; of one slab, each pair once."""
    ta, tb = (_turn(_unit(x), rotation) for x in (a, b))
    left, right = _tiles(ta), None if same else _tiles(tb)
    right = left if same else right
    box = lambda t, rows: (t[rows, :BOX].min(0), t[rows, :BOX].max(0))
    boxes_a, boxes_b = [box(ta, r) for r in left], [box(tb, r) for r in right]
    reach = max(0.0, 2 - 2 * threshold) + _SLACK
    i, j = [], []
    for k, (rows, (low, high)) in enumerate(zip(left, boxes_a, strict=True)):
        for m in range(k if same else 0, len(right)):
            gap = np.maximum(0, np.maximum(low - boxes_b[m][1], boxes_b[m][0] - high))
            if gap @ gap > reach:
                continue
            x, y = compare(a[rows], b[right[m]], ta[rows], tb[right[m]], threshold, same and k == m)
            i.append(rows[x])
            j.append(right[m][y])
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (i, j))


def compare(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of rows of two tiles ``a`` and ``b`` (``ra`` and ``rb``: their unit vectors, turned) with a cosine of
    ``threshold`` or more; of one tile, each pair once."""
    dims = ra.shape[1]
    cuts = [c for c in STAGES if c < dims]
    rest = lambda r, c: np.sqrt(np.maximum(0, (r[:, c:] ** 2).sum(1)))  # noqa: E731  norm of what is left after c axes
    first = cuts[0] if cuts else dims
    bound = ra[:, :first] @ rb[:, :first].T
    open_ = bound + np.outer(rest(ra, first), rest(rb, first)) >= threshold - _SLACK
    if same:
        open_ &= np.triu(np.ones(open_.shape, bool), 1)
    i, j = np.nonzero(open_)
    total = bound[i, j]
    for c, to in zip(cuts, [*cuts[1:], dims], strict=False):
        if not len(i):
            break
        parts = []
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            parts.append(np.einsum("ij,ij->i", ra[i[s], c:to], rb[j[s], c:to]))
        total = total + np.concatenate(parts)
        left = total + (rest(ra, to)[i] * rest(rb, to)[j] if to < dims else 0) >= threshold - _SLACK
        i, j, total = i[left], j[left], total[left]
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        x, y = _scaled(a[i[s]]), _scaled(b[j[s]])
        cosine = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
        keep[s] = cosine >= threshold
    return i[keep], j[keep]


def _link(rotation: dict[int, np.ndarray], threshold: float):
    def run(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("slab")
        dims = int(pair["dims"].iloc[0])
        sides = [(np.asarray(ids), np.asarray(n), np.frombuffer(v, np.float64).reshape(-1, dims)) for ids, n, v in zip(pair["ids"], pair["copies"], pair["vectors"], strict=True)]
        same = len(sides) == 1
        (ia, na, a), (ib, nb, b) = sides[0], sides[-1]
        i, j = near_pairs(a, b, rotation, threshold, same)
        # links of each class, and for each the least class of either slab that it reaches here
        links_a = np.bincount(i, weights=nb[j], minlength=len(ia)).astype(np.int64)
        links_b = np.bincount(j, weights=na[i], minlength=len(ib)).astype(np.int64)
        ids = ia if same else np.concatenate([ia, ib])
        links = links_a + links_b if same else np.concatenate([links_a, links_b])
        jj = j if same else j + len(ia)
        order = np.argsort(ids)
        name = np.empty(len(ids), np.int64)
        name[order] = np.arange(len(ids))
        while True:
            before = name.copy()
            np.minimum.at(name, i, before[jj])
            np.minimum.at(name, jj, before[i])
            if (name == before).all():
                break
        have = links > 0
        return pd.DataFrame({"id": ids[have], "to": ids[order][name][have], "links": links[have]})

    return run


def link_embeddings(embeddings: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector, linked within equal labels at a cosine of ``threshold`` or more.

    A vector that is null, empty, zero, or holds a null or a component that is not finite links with nothing, nor does one
    without a label or of another length; it is its own component.  Copies of a vector link with each other and with the
    same others, and are compared once.  Rows with one vec_id are separate vectors of one name; very large and very small
    components compare as well as any.  An empty table gives no rows; other columns, also of the names above, are ignored.
    """
    x = F.col(vector)
    good = F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), F.col(label).cast("string")).alias("label"), F.when(F.coalesce(good, F.lit(False)), x.cast("array<double>")).alias("vector"))
    grouped = rows.where("label is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # rows that share a vec_id may be of different classes, so classes have numbers of their own, written once
    classes = materialise(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    rotation = axes(classes)
    slabs = _slabs(classes, rotation, threshold)
    pairs = slab_pairs(slabs, threshold)
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("slab"))
    meeting = sides.join(slabs.select("slab", "dims", "ids", "copies", "vectors"), "slab").select("a", "b", "slab", "dims", "ids", "copies", "vectors")
    parts = materialise(meeting.groupBy("a", "b").applyInPandas(_link(rotation, threshold), PART_SCHEMA), "links")
    links = parts.groupBy("id").agg(F.sum("links").alias("links"))
    reached = connected_components(parts.select(F.col("id").alias("a"), F.col("to").alias("b")).where("a <> b"))
    named = classes.select("label", "vector", "id", "least", "copies").join(links, "id", "left").join(reached.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(least, "component").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    out = rows.join(known, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
