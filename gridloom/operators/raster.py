"""Array operators on blocks: neighbourhoods as joins or numpy kernels over halo blocks, holes, patches, resampling, smoothing.

A block's cells travel as one row an (id, row, col). Kernels get stacks of whole blocks of one shape (blocks, rows, columns),
so that a call's cost is shared by many small blocks; a stack is bounded by STACK_CELLS or one block. Neighbourhood kernels
over larger rasters first deal each cell to every block whose halo holds it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def halo_explode(cells: DataFrame, size: int, halo: int, height: int, width: int, row: str = "row", col: str = "col") -> DataFrame:
    """Each cell once for every block (by, bx) of `size` whose border, widened by `halo`, holds it; own marks the block it is in."""
    span = lambda c, n: F.sequence(F.greatest(F.floor((F.col(c) - halo) / size), F.lit(0)), F.least(F.floor((F.col(c) + halo) / size), F.lit((n - 1) // size)))
    out = cells.withColumn("by", F.explode(span(row, height))).withColumn("bx", F.explode(span(col, width)))
    return out.withColumn("own", (F.floor(F.col(row) / size) == F.col("by")) & (F.floor(F.col(col) / size) == F.col("bx")))


def as_array(pdf: pd.DataFrame, value: str) -> tuple[np.ndarray, int, int]:
    """Cells of a block as a NaN-filled array with the place of its corner."""
    r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    r0, c0 = int(r.min()), int(c.min())
    a = np.full((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), np.nan)
    a[r - r0, c - c0] = pdf[value].to_numpy(float)
    return a, r0, c0


#: Cells that a worker gathers before it runs a kernel.
STACK_CELLS = 1 << 16


def stacks(rows: pd.DataFrame, starts: np.ndarray, value: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of one shape as (numbers of the blocks, NaN-filled stack, corner rows, corner columns, places of the rows in it)."""
    r, c, v = rows["row"].to_numpy(), rows["col"].to_numpy(), rows[value].to_numpy(float, na_value=np.nan)
    block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
    r0, c0 = np.minimum.reduceat(r, starts), np.minimum.reduceat(c, starts)
    h, w = np.maximum.reduceat(r, starts) - r0 + 1, np.maximum.reduceat(c, starts) - c0 + 1
    shape = np.unique(np.stack([h, w], 1), axis=0, return_inverse=True)[1].ravel()
    for kind in range(shape.max() + 1):
        blocks = np.flatnonzero(shape == kind)
        mine = np.flatnonzero(shape[block] == kind)
        at, n, m = np.searchsorted(blocks, block[mine]), int(h[blocks[0]]), int(w[blocks[0]])
        a = np.full((len(blocks), n, m), np.nan)
        place = (at * n + r[mine] - r0[block[mine]]) * m + c[mine] - c0[block[mine]]
        a.ravel()[place] = v[mine]
        yield blocks, a, r0[blocks], c0[blocks], np.stack([mine, place])


def in_blocks(cells: DataFrame, keys: Sequence[str], run: Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]], kinds: str) -> DataFrame:
    """run on the rows of many whole blocks at a time, with the places where each block starts. Rows of a block lie together
    after one shuffle and sort; the last block of a batch waits for the next batch."""
    names = cells.columns
    out = pa.schema([pa.field(f.name, t) for f, t in zip(_schema(kinds), _arrow(kinds), strict=True)])

    def whole(table: pa.Table, last: bool) -> tuple[Iterator[pa.RecordBatch], pa.Table]:
        rows = table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)
        rows["row"], rows["col"] = rows["row"].to_numpy("int64"), rows["col"].to_numpy("int64")
        new = np.zeros(len(rows), bool)
        new[0] = True
        for k in keys:
            code = pd.factorize(rows[k], use_na_sentinel=False)[0]
            new[1:] |= code[1:] != code[:-1]
        starts = np.flatnonzero(new)
        end = len(rows) if last else int(starts[-1])
        done = [pa.RecordBatch.from_pandas(f[out.names], schema=out, preserve_index=False) for f in run(rows.iloc[:end], starts if last else starts[:-1])] if end else []
        return done, table.slice(end)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, least = [], 0, STACK_CELLS
        for batch in source:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= least:
                done, rest = whole(pa.Table.from_batches(held), False)
                yield from done
                held, n = rest.combine_chunks().to_batches(), rest.num_rows
                least = max(STACK_CELLS, 2 * n)  # a block larger than a stack is not looked through at each batch
        if n:
            yield from whole(pa.Table.from_batches(held), True)[0]

    return cells.select(*names).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(batches, kinds)


def _schema(kinds: str) -> T.StructType:
    return T.StructType.fromDDL(kinds)


def _arrow(kinds: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in _schema(kinds)]


def per_block(cells: DataFrame, keys: Sequence[str], value: str, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], names: Sequence[str]) -> DataFrame:
    """Run a numpy kernel on stacks of blocks; a row a cell with the kernel's arrays, NaN as NULL."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name in keys)

    def run(rows: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        for blocks, a, r0, c0, _ in stacks(rows, starts, value):
            out, (_, rr, cc) = kernel(a), np.indices(a.shape)
            frame = rows.iloc[np.repeat(starts[blocks], a[0].size)][list(keys)].reset_index(drop=True)
            frame["row"], frame["col"] = (rr + r0[:, None, None]).ravel(), (cc + c0[:, None, None]).ravel()
            for n in names:
                v = np.asarray(out[n], float).ravel()
                frame[n] = pd.arrays.FloatingArray(v, np.isnan(v))
            yield frame

    return in_blocks(cells.select(*keys, "row", "col", value), keys, run, f"{kinds}, row long, col long, " + ", ".join(f"{n} double" for n in names))


def per_cell(cells: DataFrame, keys: Sequence[str], value: str, kernel: Callable[[np.ndarray], np.ndarray], name: str, own: str) -> DataFrame:
    """Run a numpy kernel on stacks of halo blocks; a row for each cell that `own` marks, NaN as NULL."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name in keys)

    def run(rows: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        mark = rows[own].to_numpy(bool)
        for _, a, _, _, (mine, place) in stacks(rows, starts, value):
            kept = mark[mine]
            frame = rows.iloc[mine[kept]][[*keys, "row", "col"]].reset_index(drop=True)
            v = np.asarray(kernel(a), float).ravel()[place[kept]]
            frame[name] = pd.arrays.FloatingArray(v, np.isnan(v))
            yield frame

    return in_blocks(cells.select(*keys, "row", "col", value, own), keys, run, f"{kinds}, row long, col long, {name} double")


# --- texture -----------------------------------------------------------------------------------------------------

METRICS = ("contrast", "homogeneity", "entropy", "correlation")


def shift_of(distance: int, angle: int) -> tuple[int, int]:
    """(rows, columns) to the neighbour: 0 degrees right, 90 up, diagonals rounded."""
    rad = np.deg2rad(angle)
    return int(np.rint(-distance * np.sin(rad))), int(np.rint(distance * np.cos(rad)))


def box_sum(a: np.ndarray, radius: int) -> np.ndarray:
    """Sums over square windows of the last two axes with replicated borders, by a summed-area table."""
    p = np.pad(a.astype(float), [(0, 0)] * (a.ndim - 2) + [(radius, radius)] * 2, mode="edge")
    s = np.pad(p.cumsum(-2).cumsum(-1), [(0, 0)] * (a.ndim - 2) + [(1, 0)] * 2)
    n = 2 * radius + 1
    return s[..., n:, n:] - s[..., :-n, n:] - s[..., n:, :-n] + s[..., :-n, :-n]


def texture(quantised: np.ndarray, levels: int, window: int = 5, distance: int = 1, angles: Iterable[int] = (0, 90)) -> dict[str, np.ndarray]:
    """Co-occurrence metrics in a moving window, averaged over angles; cells of the missing level (levels) count in no pair.

    A block or a stack of blocks of one shape.
    """
    h, w = quantised.shape[-2:]
    total = {m: np.zeros(quantised.shape) for m in METRICS}
    seen = np.zeros(quantised.shape)
    radius = window // 2
    for angle in angles:
        dy, dx = shift_of(distance, angle)
        rr = np.clip(np.arange(h) + dy, 0, h - 1)
        cc = np.clip(np.arange(w) + dx, 0, w - 1)
        i, j = quantised, quantised[..., rr[:, None], cc]
        ok = (i < levels) & (j < levels)
        x, y = np.where(ok, i, 0).astype(float), np.where(ok, j, 0).astype(float)
        n = box_sum(ok, radius)
        safe = np.maximum(n, 1)
        d2 = np.where(ok, (x - y) ** 2, 0.0)
        entropy = np.zeros(quantised.shape)
        pair = np.where(ok, i * levels + j, -1)
        for code in np.unique(pair[ok]):  # only pairs that occur
            c = box_sum(pair == code, radius)
            entropy += np.where(c > 0.5, c * np.log(np.maximum(c, 1)), 0)
        mx, my = box_sum(x, radius) / safe, box_sum(y, radius) / safe
        vx, vy = np.maximum(box_sum(x * x, radius) / safe - mx * mx, 0), np.maximum(box_sum(y * y, radius) / safe - my * my, 0)
        cov = box_sum(x * y, radius) / safe - mx * my
        found = {
            "contrast": box_sum(d2, radius) / safe,
            "homogeneity": box_sum(np.where(ok, 1 / (1 + d2), 0), radius) / safe,
            "entropy": np.log(safe) - entropy / safe,
            "correlation": cov / (np.sqrt(vx * vy) + 1e-10),
        }
        valid = n > 0.5
        for m in METRICS:
            total[m] += np.where(valid, found[m], 0)
        seen += valid
    mask = (quantised < levels) & (seen > 0)
    return {m: np.where(mask, total[m] / np.maximum(seen, 1), np.nan) for m in METRICS}


def line_sums(df: DataFrame, names: Sequence[str], keys: Sequence[str], axis: str, other: str, radius: int, size: int) -> DataFrame:
    """Columns summed over the places within radius along an axis of `size`; border cells count as often as they are replicated."""
    line = Window.partitionBy(*keys, other).orderBy(axis)
    near, first, last = line.rangeBetween(-radius, radius), F.greatest(radius - F.col(axis), F.lit(0)), F.greatest(F.col(axis) + radius - (size - 1), F.lit(0))
    border = lambda n, at: F.coalesce(F.sum(F.when(F.col(axis) == at, F.col(n))).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0))
    return df.withColumns({n: F.coalesce(F.sum(n).over(near), F.lit(0)) + first * border(n, 0) + last * border(n, size - 1) for n in names})


def texture_relational(cells: DataFrame, keys: Sequence[str], height: int, width: int, levels: int, window: int = 5, distance: int = 1, angle: int = 0) -> DataFrame:
    """Contrast and homogeneity of one angle in relational form: a join with the clamped neighbour, then sums along rows and
    along columns inside each block, so that a cell stays one row.

    The join is never a broadcast: its size is that of the cells, which a scan of packed blocks does not show.
    """
    dy, dx = shift_of(distance, angle)
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    there = cells.select(*keys, F.col("row").alias("nr"), F.col("col").alias("nc"), F.col("q").alias("j"), F.lit(1).alias("pairs"))
    pairs = cells.withColumn("nr", clamp(F.col("row") + dy, height)).withColumn("nc", clamp(F.col("col") + dx, width)).join(there.hint("merge"), [*keys, "nr", "nc"], "left")
    ok = (F.col("q") < levels) & (F.col("j") < levels)
    d2 = F.pow(F.col("q") - F.col("j"), 2)
    sums = pairs.select(*keys, "row", "col", "q", "pairs", ok.cast("int").alias("ok"), F.when(ok, d2).alias("d2"), F.when(ok, 1 / (1 + d2)).alias("h")).repartition(*keys)
    for axis, other, size in (("col", "row", width), ("row", "col", height)):
        sums = line_sums(sums, ["pairs", "ok", "d2", "h"], keys, axis, other, window // 2, size)
    mean = lambda n: F.when(F.col("ok") > 0, F.col(n) / F.col("ok"))
    out = sums.where((F.col("q") < levels) & (F.col("pairs") > 0)).dropDuplicates([*keys, "row", "col"])
    return out.select(*keys, "row", "col", mean("d2").alias("contrast"), mean("h").alias("homogeneity"))


# --- holes -------------------------------------------------------------------------------------------------------


def enclosed_holes(valid: np.ndarray) -> np.ndarray:
    """Cells that are not valid and that no 4-connected path of such cells joins to the border: the outside grows until it stops."""
    outside = np.zeros_like(valid)
    outside[..., [0, -1], :] = ~valid[..., [0, -1], :]
    outside[..., [0, -1]] |= ~valid[..., [0, -1]]
    while True:
        grown = outside.copy()
        grown[..., 1:, :] |= outside[..., :-1, :]
        grown[..., :-1, :] |= outside[..., 1:, :]
        grown[..., 1:] |= outside[..., :-1]
        grown[..., :-1] |= outside[..., 1:]
        grown &= ~valid
        if (grown == outside).all():
            return ~valid & ~outside
        outside = grown


def hole_fraction(cells: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Enclosed holes over all cells of each block."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name in keys)

    def run(rows: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        for blocks, a, _, _, _ in stacks(rows, starts, value):
            frame = rows.iloc[starts[blocks]][list(keys)].reset_index(drop=True)
            yield frame.assign(hole_px=enclosed_holes(~np.isnan(a)).sum((1, 2)), n_px=a[0].size)

    return in_blocks(cells.select(*keys, "row", "col", value), keys, run, f"{kinds}, hole_px long, n_px long")


def union_area(rects: np.ndarray) -> float:
    """Area of a union of rectangles (xmin, ymin, xmax, ymax), by sweeping the x coordinates."""
    if not len(rects):
        return 0.0
    xs = np.unique(rects[:, [0, 2]])
    area = 0.0
    for a, b in zip(xs[:-1], xs[1:], strict=True):
        rows = rects[(rects[:, 0] <= a) & (rects[:, 2] >= b)][:, [1, 3]]
        rows = rows[np.argsort(rows[:, 0])]
        top, length = -np.inf, 0.0
        for lo, hi in rows:
            length += max(0.0, hi - max(lo, top))
            top = max(top, hi)
        area += (b - a) * length
    return area


# --- filling, resampling, smoothing ------------------------------------------------------------------------------


def fill_nearest(a: np.ndarray) -> np.ndarray:
    """Missing cells of a block or of a stack of blocks get the nearest valid value of their block; on a tie that of the upper
    row, then of the left column.

    A row knows each place's nearest valid column in two running passes; rows further and further away are then tried,
    all cells at once, as long as their distance alone can still win.
    """
    if a.ndim == 2:
        return fill_nearest(a[None])[0]
    ok = ~np.isnan(a)
    some = ok.any((1, 2)) & ~ok.all((1, 2))
    if not some.any():
        return a
    if not some.all():
        out = a.copy()
        out[some] = fill_nearest(a[some])
        return out
    n, h, w = a.shape
    col, far = np.arange(w), 2 * (h + w)
    left = np.maximum.accumulate(np.where(ok, col, -far), axis=2)
    right = np.minimum.accumulate(np.where(ok, col, far)[..., ::-1], axis=2)[..., ::-1]
    near = np.where(col - left <= right - col, left, right)
    away = (near - col) ** 2
    best, row = away.copy(), np.broadcast_to(np.arange(h)[:, None], a.shape).copy()
    for step in range(1, h):
        if step * step > best.max():
            break
        for low, high, shift in ((step, h, -step), (0, h - step, step)):
            other = away[:, low + shift : high + shift] + step * step
            # the upper row wins a tie, and it comes first
            better = (other <= best[:, low:high]) if shift < 0 else (other < best[:, low:high])
            best[:, low:high] = np.where(better, other, best[:, low:high])
            row[:, low:high] = np.where(better, np.arange(low + shift, high + shift)[:, None], row[:, low:high])
    block = np.arange(n)[:, None, None]
    return a[block, row, near[block, row, col]]


def touching_edge(mask: np.ndarray) -> np.ndarray:
    """Cells of the mask's 4-connected parts that reach the border: runs of a row or column pass the mark on until none is new."""
    out = np.zeros_like(mask)
    out[[0, -1], :] |= mask[[0, -1], :]
    out[:, [0, -1]] |= mask[:, [0, -1]]
    while True:
        before = out
        for axis in (1, 0):
            m, o = (mask, out) if axis else (mask.T, out.T)
            run = (np.cumsum(~m, axis=1) + np.arange(m.shape[0])[:, None] * (m.shape[1] + 1)).ravel()
            marked = np.bincount(run, weights=(o & m).ravel()) > 0
            o = marked[run].reshape(m.shape) & m
            out = o if axis else o.T
        if (out == before).all():
            return out


def fill_holes(a: np.ndarray) -> np.ndarray:
    """Missing parts inside get the nearest valid value; those that reach the border stay missing. A block or a stack of them."""
    if a.ndim == 3:
        return np.stack([fill_holes(b) for b in a])
    missing = np.isnan(a)
    if not missing.any():
        return a
    return np.where(touching_edge(missing), np.nan, fill_nearest(a))


def bilinear(a: np.ndarray, factor: int) -> np.ndarray:
    """Upsample by a whole factor; weights of missing cells go to the valid ones, so nodata does not bleed."""
    h, w = a.shape[-2:]
    y, x = (np.arange(h * factor) + 0.5) / factor - 0.5, (np.arange(w * factor) + 0.5) / factor - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, h - 1), np.clip(np.floor(x).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    value, weight = np.zeros((*a.shape[:-2], len(y), len(x))), np.zeros((*a.shape[:-2], len(y), len(x)))
    for yy, xx, k in ((y0, x0, (1 - fy) * (1 - fx)), (y0, x1, (1 - fy) * fx), (y1, x0, fy * (1 - fx)), (y1, x1, fy * fx)):
        part = a[..., yy[:, None], xx]
        k = np.where(np.isnan(part), 0, k)
        value += np.nan_to_num(part) * k
        weight += k
    return np.where(weight > 0, value / np.maximum(weight, 1e-12), np.nan)


def smooth_tv(a: np.ndarray, weight: float = 5.0, rounds: int = 60) -> np.ndarray:
    """Total-variation smoothing in decibels: dual projection steps; missing cells are filled before and missing after."""
    return _in_decibels(a, lambda f: _tv(f, 1 / weight, rounds))


def _in_decibels(a: np.ndarray, smooth: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Smooth the blocks of a stack that have a valid cell; the others stay as they are."""
    if a.ndim == 2:
        return _in_decibels(a[None], smooth)[0]
    mask = np.isnan(a) | (a <= 0)
    some = ~mask.all((1, 2))
    out = a.copy()
    if some.any():
        a, mask = a[some], mask[some]
        f = fill_nearest(np.where(mask, np.nan, 10 * np.log10(np.where(mask, 1, a))))
        out[some] = np.where(mask, np.nan, 10 ** (smooth(f) / 10))
    return out


def _tv(f: np.ndarray, lam: float, rounds: int) -> np.ndarray:
    px, py = np.zeros_like(f), np.zeros_like(f)

    def div() -> np.ndarray:
        out = px + py
        out[..., 1:] -= px[..., :-1]
        out[..., 1:, :] -= py[..., :-1, :]
        return out

    for _ in range(rounds):
        u = div() - f / lam
        gx, gy = np.diff(u, axis=-1, append=u[..., -1:]), np.diff(u, axis=-2, append=u[..., -1:, :])
        norm = 1 + 0.25 * np.hypot(gx, gy)
        px, py = (px + 0.25 * gx) / norm, (py + 0.25 * gy) / norm
    return f - lam * div()


def smooth_nlm(a: np.ndarray, strength: float = 1.0, patch: int = 1, search: int = 3) -> np.ndarray:
    """Non-local means in decibels: weights from mean squared patch differences within a search window."""
    return _in_decibels(a, lambda f: _nlm(f, strength, patch, search))


def _nlm(f: np.ndarray, strength: float, patch: int, search: int) -> np.ndarray:
    h, w = f.shape[-2:]
    pad = np.pad(f, [(0, 0)] * (f.ndim - 2) + [(search, search)] * 2, mode="reflect" if min(h, w) > search else "edge")
    total, norm = np.zeros_like(f), np.zeros_like(f)
    for dy in range(-search, search + 1):
        for dx in range(-search, search + 1):
            other = pad[..., search + dy : search + dy + h, search + dx : search + dx + w]
            k = np.exp(-box_sum((f - other) ** 2, patch) / (2 * patch + 1) ** 2 / strength**2)
            total += k * other
            norm += k
    return total / norm


# --- patches -----------------------------------------------------------------------------------------------------


def patch_origins(height: int, width: int, size: int, stride: int, clamp: bool = False) -> tuple[list[int], list[int]]:
    """Upper left corners of sliding patches along each axis; clamp adds one that ends at the edge."""
    def axis(n: int) -> list[int]:
        at = list(range(0, max(n - size, 0) + 1, stride))
        return [*at, n - size] if clamp and n > size and at[-1] != n - size else at

    return axis(height), axis(width)


def patches(cells: DataFrame, keys: Sequence[str], height: int, width: int, size: int, stride: int, value: str = "v", clamp: bool = False) -> DataFrame:
    """Each patch's values in row order with its share of valid cells. A cell goes to the origins whose patch holds it: no join."""
    ys, xs = patch_origins(height, width, size, stride, clamp)
    holding = lambda c, at: F.filter(F.array(*map(F.lit, at)), lambda o: (F.col(c) >= o) & (F.col(c) < o + size))
    out = cells.withColumn("y0", F.explode(holding("row", ys))).withColumn("x0", F.explode(holding("col", xs)))
    one = F.array_sort(F.collect_list(F.struct("row", "col", F.col(value).alias("v"))))
    return out.groupBy(*keys, "y0", "x0").agg(F.transform(one, lambda s: s["v"]).alias("values"), (F.count(value) / F.count(F.lit(1))).alias("valid"))


def normalised(v: Column, mean: Column, std: Column, missing: float = 0.0) -> Column:
    return F.coalesce((v - mean) / F.when(std == 0, 1.0).otherwise(std), F.lit(missing))
