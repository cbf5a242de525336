"""Voxel volumes (x, y, z, gray) as long tables: statistics, grids, pyramids and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
BINS = 65536


def histogram(volume: DataFrame, bins: int = BINS) -> DataFrame:
    """(gray, n) for every gray value from 0 to bins - 1, empty ones too."""
    counts = volume.groupBy("gray").agg(F.count(F.lit(1)).alias("n"))
    every = volume.sparkSession.range(bins).select(F.col("id").cast("int").alias("gray"))
    return every.join(counts, "gray", "left").select("gray", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def centre_of_gravity(volume: DataFrame, threshold: int, step: float = 1.0) -> DataFrame:
    """Voxel centre (integer division) and world centre of the voxels with gray >= threshold."""
    solid = volume.filter(F.col("gray") >= threshold)
    sums = solid.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("long")).alias(f"s{c}") for c in AXES))
    return sums.select("n", *(F.floor(F.col(f"s{c}") / F.col("n")).alias(f"cog_{c}") for c in AXES), *((F.col(f"s{c}") / F.col("n") * step).alias(f"world_{c}") for c in AXES))


def inertia_tensor(volume: DataFrame, threshold: int) -> DataFrame:
    """Six entries of the inertia tensor about the truncated centre of gravity, off-diagonals negated, divided by the count."""
    cog = centre_of_gravity(volume, threshold).select("n", *(f"cog_{c}" for c in AXES))
    solid = volume.filter(F.col("gray") >= threshold).join(F.broadcast(cog))
    dx, dy, dz = (F.col(c) - F.col(f"cog_{c}") for c in AXES)
    terms = {"ixx": dy * dy + dz * dz, "iyy": dx * dx + dz * dz, "izz": dx * dx + dy * dy, "ixy": -dx * dy, "ixz": -dx * dz, "iyz": -dy * dz}
    return solid.agg(*(F.sum(t.cast("long")).alias(n) for n, t in terms.items()), F.count(F.lit(1)).alias("n")).select(*((F.col(n) / F.col("n")).alias(n) for n in terms))


def bounding_box(volume: DataFrame) -> DataFrame:
    return volume.agg(*(f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("min", F.min), ("max", F.max))))


def tile_stats(volume: DataFrame, size: int) -> DataFrame:
    """(tx, ty, tz, lo, hi, n, total): zone map of the tiles."""
    return volume.groupBy(*(F.floor(F.col(c) / size).alias(f"t{c}") for c in AXES)).agg(F.min("gray").alias("lo"), F.max("gray").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(F.col("gray").cast("long")).alias("total"))


def sub_histograms(volume: DataFrame, size: int, low: int, high: int, width: int) -> DataFrame:
    """Histograms of cells of side 2 * size that overlap by half, so a voxel counts in up to 8; bin -1 is under `low`, bin n over `high`."""
    last = (high - low) // width
    bin_ = F.when(F.col("gray") < low, -1).when(F.col("gray") >= high, last).otherwise(F.floor((F.col("gray") - low) / width)).alias("bin")
    cells = [F.filter(F.array(F.floor(F.col(c) / size) - 1, F.floor(F.col(c) / size)), lambda v: v >= 0) for c in AXES]
    # Voxels of one half cell and bin are counted before they are copied to the cells.
    part = volume.groupBy(*(F.floor(F.col(c) / size).alias(f"h{c}") for c in AXES), bin_).agg(F.count(F.lit(1)).alias("k"))
    for c in AXES:
        part = part.withColumn(f"c{c}", F.explode(F.filter(F.array(F.col(f"h{c}") - 1, F.col(f"h{c}")), lambda v: v >= 0)))
    return part.groupBy("cx", "cy", "cz", "bin").agg(F.sum("k").alias("n"))


def voxel_grid(points: DataFrame, leaf: float, least: int = 1, fields: tuple = ("x", "y", "z")) -> DataFrame:
    """Mean of the fields for each cell of side `leaf` with at least `least` points."""
    return points.groupBy(*(F.floor(F.col(c) / leaf).alias(f"c{c}") for c in AXES)).agg(F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f) for f in fields)).filter(F.col("n") >= least)


def voxel_covariance(points: DataFrame, leaf: float, least: int = 6) -> DataFrame:
    """Mean and sample covariance of the points of each cell."""
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    return points.groupBy(*(F.floor(F.col(c) / leaf).alias(f"c{c}") for c in AXES)).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in AXES), *(F.covar_samp(a, b).alias(f"cov_{a}{b}") for a, b in pairs)).filter(F.col("n") >= least)


def label_vote(points: DataFrame, leaf: float, label: str) -> DataFrame:
    """Most frequent label of each cell; a tie goes to the least label."""
    counts = points.groupBy(*(F.floor(F.col(c) / leaf).alias(f"c{c}") for c in AXES), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("cx", "cy", "cz").agg(F.sum("n").alias("n"), F.max(F.struct(F.col("n").alias("votes"), (-F.col("label")).alias("neg"))).alias("best")).select("cx", "cy", "cz", "n", (-F.col("best.neg")).alias("label"), F.col("best.votes").alias("votes"))


def grid_minimum(points: DataFrame, size: float, point_id: str = "point_id") -> DataFrame:
    """The point with the least z in each (x, y) cell; a tie goes to the least id."""
    best = F.min(F.struct("z", point_id, "x", "y")).alias("b")
    return points.groupBy(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(best).select("cx", "cy", *(F.col(f"b.{c}").alias(c) for c in (point_id, *AXES)))


def roi(volume: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """The voxels of a region [low, high) in its own coordinates, 0 where the region leaves the volume."""
    spark = volume.sparkSession
    size = [b - a for a, b in zip(low, high)]
    i = F.col("id")
    grid = spark.range(size[0] * size[1] * size[2]).select((i % size[0] + low[0]).cast("int").alias("x"), (F.floor(i / size[0]) % size[1] + low[1]).cast("int").alias("y"), (F.floor(i / (size[0] * size[1])) + low[2]).cast("int").alias("z"))
    inside = volume.filter(" AND ".join(f"{c} >= {a} AND {c} < {b}" for c, a, b in zip(AXES, low, high)))
    out = grid.join(inside, list(AXES), "left")
    return out.select(*((F.col(c) - a).alias(c) for c, a in zip(AXES, low)), F.coalesce("gray", F.lit(0)).alias("gray"))


def level_dims(dims: tuple, least: int = 32, most: int = 20) -> list[tuple]:
    """Dimensions of the levels of detail, dim >> level, until an axis falls below `least`."""
    out = [tuple(dims)]
    while len(out) < most and all(d >> len(out) >= least for d in dims):
        out.append(tuple(d >> len(out) for d in dims))
    return out


def tiled_dims(dims: tuple, tile: int, least: int = 32, most: int = 20) -> list[tuple]:
    """The same rounded up to whole tiles."""
    return [tuple(-(-d // tile) * tile for d in level) for level in level_dims(dims, least, most)]


def level_means(volume: DataFrame, level: int) -> DataFrame:
    """Octree roll-up: sum, count, least and largest gray of the cells of side 2 ** level."""
    return volume.groupBy(*(F.shiftright(c, level).alias(c) for c in AXES)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gray").cast("long")).alias("total"), F.min("gray").alias("lo"), F.max("gray").alias("hi"))


def decimate(volume: DataFrame, ratio: int) -> DataFrame:
    """Nearest sample of each parent voxel, the child at parent * ratio."""
    return volume.filter(" AND ".join(f"{c} % {ratio} = 0" for c in AXES)).select(*((F.col(c) / ratio).cast("int").alias(c) for c in AXES), "gray")


def pyramid(volume: DataFrame, levels: int) -> DataFrame:
    """All levels in one frame with column `level`; each voxel is read once."""
    kept = volume.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    own = F.expr(" AND ".join(f"{c} % shiftleft(1, level) = 0" for c in AXES))
    return kept.filter(own).select("level", *(F.expr(f"shiftright({c}, level)").alias(c) for c in AXES), "gray")


def trilinear(volume: DataFrame, samples: DataFrame, dims: tuple, sample_id: str = "sample_id", truncate: bool = True) -> DataFrame:
    """(sample_id, value): trilinear value at (x, y, z) of each sample; 0 outside [1, dim - 1).

    A sample is joined with its eight corners by their indices. With `truncate` the value is cut to a whole number.
    """
    inside = " AND ".join(f"{c} >= 1 AND {c} < {d - 1}" for c, d in zip(AXES, dims))
    s = samples.select(F.col(sample_id), *(F.col(c).alias(f"s{c}") for c in AXES), F.expr(inside).alias("inside"))
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (0, 1) for j in (0, 1) for k in (0, 1)))
    corner = s.filter("inside").select("*", F.inline(offsets))
    part = lambda c, o: F.when(F.col(o) == 1, F.col(f"s{c}") - F.floor(f"s{c}")).otherwise(1 - (F.col(f"s{c}") - F.floor(f"s{c}")))
    corner = corner.select(sample_id, *((F.floor(f"s{c}") + F.col(o)).cast("int").alias(c) for c, o in zip(AXES, "ijk")), (part("x", "i") * part("y", "j") * part("z", "k")).alias("weight"))
    value = corner.join(volume, list(AXES)).groupBy(sample_id).agg(F.sum(F.col("weight") * F.col("gray")).alias("value"))
    out = s.select(sample_id).join(value, sample_id, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return out.withColumn("value", F.col("value").cast("int")) if truncate else out


def resized(volume: DataFrame, dims: tuple, target: tuple) -> DataFrame:
    """(sample_id, value): trilinear resize, sample_id being the target's raster index.

    Voxel centres are aligned: target p samples the source at (p + 0.5) * d / t - 0.5, edges clamped.
    """
    i = F.col("id")
    grid = volume.sparkSession.range(target[0] * target[1] * target[2])
    place = ((i % target[0]), (F.floor(i / target[0]) % target[1]), F.floor(i / (target[0] * target[1])))
    scaled = [F.least(F.greatest((p + 0.5) * d / t - 0.5, F.lit(0.0)), F.lit(d - 1.0)) for p, d, t in zip(place, dims, target)]
    s = grid.select(i.alias("sample_id"), *(F.floor(v).alias(f"f{c}") for v, c in zip(scaled, AXES)), *((v - F.floor(v)).alias(f"w{c}") for v, c in zip(scaled, AXES)))
    # A corner of weight 0 is left out, so no corner lies outside.
    ends = lambda c: F.filter(F.array(F.struct(F.col(f"f{c}").alias("at"), (1 - F.col(f"w{c}")).alias("w")), F.struct((F.col(f"f{c}") + 1).alias("at"), F.col(f"w{c}").alias("w"))), lambda e: e["w"] > 0)
    for c in AXES:
        s = s.select("*", F.inline(ends(c))).withColumnsRenamed({"at": c, "w": f"own_{c}"})
    corner = s.select("sample_id", *(F.col(c).cast("int").alias(c) for c in AXES), (F.col("own_x") * F.col("own_y") * F.col("own_z")).alias("weight"))
    return corner.join(volume, list(AXES)).groupBy("sample_id").agg(F.sum(F.col("weight") * F.col("gray")).alias("value"))


def material_of(volume: DataFrame, regions: DataFrame, small: int = 10_000) -> DataFrame:
    """Voxels with the material whose [lo, hi) holds their gray. The regions are few (at most `small` rows, checked) and broadcast; more are joined by gray value."""
    n = regions.limit(small + 1).count()
    if n <= small:
        return volume.join(F.broadcast(regions), (F.col("gray") >= F.col("lo")) & (F.col("gray") < F.col("hi")))
    return volume.join(regions.select("material_id", "lo", "hi", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("gray")), "gray")


def materials_by_start(regions: DataFrame, start: str = "start") -> DataFrame:
    """Materials numbered from the highest start of their gray range down; there are at most as many as gray values."""
    return regions.withColumn("place", F.row_number().over(Window.orderBy(F.desc(start))))


def split_normals(hist: DataFrame, peaks: DataFrame, reach: int) -> DataFrame:
    """(gray, n, left, right): for each peak (gray, n) the deviations of the histogram about it on either side, within `reach` gray values: a normal curve with two widths.

    A histogram bin is sent to the peaks within reach, which are among 2 reach + 1 gray values.
    """
    sent = hist.filter("n > 0").select("gray", F.col("n").alias("k"), F.explode(F.sequence(F.col("gray") - reach, F.col("gray") + reach)).alias("peak"))
    both = peaks.select(F.col("gray").alias("peak"), "n").join(sent, "peak")
    d2 = (F.col("gray") - F.col("peak")) * (F.col("gray") - F.col("peak"))
    side = lambda on: F.sqrt(F.sum(F.when(on, F.col("k") * d2)) / F.sum(F.when(on, F.col("k"))))
    out = both.groupBy("peak", "n").agg(side(F.col("gray") <= F.col("peak")).alias("left"), side(F.col("gray") >= F.col("peak")).alias("right"))
    return out.withColumnRenamed("peak", "gray")


def region_stats(hist: DataFrame, regions: DataFrame) -> DataFrame:
    """For each material the mean gray and the deviation about its peak and about the mean, rounded up."""
    m = material_of(hist.filter("n > 0"), regions)
    g, n = F.col("gray").cast("double"), F.col("n")
    s = m.groupBy("material_id").agg(F.sum("n").alias("n"), F.sum(n * g).alias("s"), F.max(F.struct("n", (-F.col("gray")).alias("g"))).alias("top"), F.sum(n * g * g).alias("q"))
    mean, peak = F.col("s") / F.col("n"), -F.col("top.g")
    about = lambda c: F.sqrt(F.greatest(F.col("q") / F.col("n") - 2 * c * mean + c * c, F.lit(0.0)))
    return s.select("material_id", "n", peak.alias("peak"), F.ceil(mean).alias("mean"), F.ceil(about(peak.cast("double"))).alias("about_peak"), F.ceil(about(mean)).alias("about_mean"))


def otsu(hist: DataFrame) -> DataFrame:
    """(threshold, between): the gray with the largest between-class variance; a tie goes to the least.

    The histogram has at most 65536 rows, whatever the volume.
    """
    w = Window.orderBy("gray").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = F.col("gray") * F.col("n")
    c = hist.select("gray", F.sum("n").over(w).alias("w0"), F.sum(g).over(w).alias("s0"))
    total = hist.agg(F.sum("n").alias("w"), F.sum(g).alias("s"))
    c = c.join(F.broadcast(total)).filter("w0 > 0 AND w0 < w")
    d = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    between = (F.col("w0").cast("double") * (F.col("w") - F.col("w0"))) * d * d
    return c.select("gray", between.alias("between")).agg(F.max(F.struct("between", (-F.col("gray")).alias("g"))).alias("b")).select((-F.col("b.g")).alias("threshold"), F.col("b.between").alias("between"))


def smoothed(hist: DataFrame, weights: list[int]) -> DataFrame:
    """(gray, n, smooth): weighted mean over neighbouring gray values, weights symmetric about the middle."""
    k = len(weights) // 2
    w = Window.orderBy("gray")
    own = sum(F.coalesce(F.lag("n", k - i).over(w) if i < k else F.lead("n", i - k).over(w) if i > k else F.col("n"), F.lit(0)) * v for i, v in enumerate(weights))
    return hist.select("gray", "n", (own / sum(weights)).alias("smooth"))


def medians(hist: DataFrame, k: int) -> DataFrame:
    """(gray, n, smooth): median over 2 k + 1 neighbouring gray values, shorter at the ends (lower median)."""
    w = Window.orderBy("gray").rowsBetween(-k, k)
    s = F.array_sort(F.collect_list("n").over(w))
    return hist.select("gray", "n", F.element_at(s, (F.floor((F.size(s) - 1) / 2) + 1).cast("int")).alias("smooth"))


def local_maxima(hist: DataFrame, k: int) -> DataFrame:
    """Gray values whose count exceeds all counts within k on both sides."""
    before, after = (Window.orderBy("gray").rowsBetween(a, b) for a, b in ((-k, -1), (1, k)))
    top = hist.select("gray", "n", F.max("n").over(before).alias("a"), F.max("n").over(after).alias("b"))
    return top.filter("n > coalesce(a, -1) AND n > coalesce(b, -1)").select("gray", "n")


def iso50(peaks: DataFrame) -> DataFrame:
    """Midpoint of the two highest peaks of a histogram, air and material."""
    return peaks.orderBy(F.desc("n"), "gray").limit(2).agg((F.sum("gray") / F.count(F.lit(1))).alias("threshold"), F.min("gray").alias("air"), F.max("gray").alias("material"))


#: Steps that move the 21 low bits of a number apart, to every third place: shift, and the bits that stay.
APART = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def morton(x: str | Column, y: str | Column, z: str | Column) -> Column:
    """Interleaved bits of three whole numbers from 0 to 2^21 - 1, x lowest; other numbers are an error, null gives null."""
    axes = [(F.col(c) if isinstance(c, str) else c).cast("long") for c in (x, y, z)]
    out = F.lit(0).cast("long")
    for i, a in enumerate(axes):
        for shift, mask in APART:
            a = a.bitwiseOR(F.shiftleft(a, shift)).bitwiseAND(F.lit(mask).cast("long"))
        out = out.bitwiseOR(F.shiftleft(a, i))
    outside = (F.least(*axes) < 0) | (F.greatest(*axes) >= 1 << 21)
    return F.when(outside, F.raise_error(F.lit("a Morton code holds whole numbers from 0 to 2097151"))).otherwise(out)


def morton_sorted(points: DataFrame, size: float = 1.0, point_id: str = "point_id") -> DataFrame:
    """Points with the code `morton` of their cell, sorted by it and by id across partitions."""
    key = morton(*(F.floor(F.col(c) / size) for c in AXES))
    return points.withColumn("morton", key).orderBy("morton", point_id)


def uniform_sample(points: DataFrame, leaf: float, point_id: str = "point_id") -> DataFrame:
    """The point nearest to the middle of each cell; ties by id."""
    mid = {c: (F.floor(F.col(c) / leaf) + 0.5) * leaf for c in AXES}
    d2 = sum((F.col(c) - m) * (F.col(c) - m) for c, m in mid.items())
    return points.groupBy(*(F.floor(F.col(c) / leaf).alias(f"c{c}") for c in AXES)).agg(F.min(F.struct(d2.alias("d2"), point_id)).alias("b")).select("cx", "cy", "cz", F.col(f"b.{point_id}").alias(point_id))


def occupied(points: DataFrame, leaf: float) -> DataFrame:
    return points.select(*(F.floor(F.col(c) / leaf).alias(f"c{c}") for c in AXES)).distinct()


def octree_tiles(volume: DataFrame, size: int, levels: int) -> DataFrame:
    """(level, tx, ty, tz, lo, hi, file_id): tiles of every level with their zone map, file ids dense from 0 in each level by (tz, ty, tx).

    Levels above the first are rolled up from tiles, not from voxels, and a level's tiles
    are numbered through counts of its rows of tiles.
    """
    base = tile_stats(volume, size).select(F.lit(0).alias("level"), "tx", "ty", "tz", "lo", "hi")
    every, last = base, base
    for level in range(1, levels):
        last = last.groupBy(*(F.shiftright(f"t{c}", 1).alias(f"t{c}") for c in AXES)).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(F.lit(level).alias("level"), "tx", "ty", "tz", "lo", "hi")
        every = every.unionByName(last)
    rows = every.groupBy("level", "tz").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("level", "tz", (F.sum("n").over(Window.partitionBy("level").orderBy("tz")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("level", "tz").orderBy("ty", "tx"))
    return every.join(rows, ["level", "tz"]).select("level", "tx", "ty", "tz", "lo", "hi", (F.col("before") + place - 1).cast("long").alias("file_id"))


def pores(volume: DataFrame, threshold: int, width: int, height: int) -> DataFrame:
    """(pore, voxels, min/max of x, y, z): components of voxels under the threshold that share a face, named by their least raster index."""
    from geomill.operators.graph import components

    low = volume.filter(F.col("gray") < threshold).select(*AXES, (F.col("x") + width * (F.col("y") + height * F.col("z").cast("long"))).cast("long").alias("id"))
    steps = F.array(*(F.struct(*(F.lit(int(c == a)).alias(f"d{a}") for a in AXES)) for c in AXES))
    ahead = low.select(F.col("id").alias("a"), *AXES, F.inline(steps)).select("a", *((F.col(c) + F.col(f"d{c}")).alias(c) for c in AXES))
    pairs = ahead.join(low, list(AXES)).select("a", F.col("id").alias("b"))
    label = components(low.select("id"), pairs)
    return low.join(label, "id").groupBy(F.col("component").alias("pore")).agg(F.count(F.lit(1)).alias("voxels"), *(f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("min", F.min), ("max", F.max))))


def height_morphology(points: DataFrame, size: float, reach: int, op: str) -> DataFrame:
    """(cx, cy, z): erosion, dilation, opening or closing of the heights of a cloud over a raster of cells of width `size`.

    A cell has its least height (its greatest for dilation and closing); a step takes the least or greatest of the
    cells up to `reach` away along rows of cells and then along columns of what the rows gave, by running windows: that of
    the square where all its cells have points. Cells without points take no part and get no height. Points without a finite place are left out.
    """
    from geomill.operators.filters import finite

    steps = {"erode": (F.min,), "dilate": (F.max,), "open": (F.min, F.max), "close": (F.max, F.min)}[op]
    cells = points.filter(finite(*AXES)).groupBy(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(steps[0]("z").alias("z"))
    for f in steps:
        for along, across in (("cx", "cy"), ("cy", "cx")):
            cells = cells.withColumn("z", f("z").over(Window.partitionBy(across).orderBy(along).rangeBetween(-reach, reach)))
    return cells
