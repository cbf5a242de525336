"""3 x 3 x 3 stencils on voxel volumes, and window filters on images.

A voxel sends its gray to the neighbours it belongs to, with its weight, and one group-by
sums them: a single shuffle with map-side combining instead of 26 joins.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def spread(volume: DataFrame, weights: dict[tuple[int, int, int], tuple], names: tuple[str, ...]) -> DataFrame:
    """Sums of weight * gray over the neighbourhood, one for each name; `seen` counts the neighbours that exist."""
    kinds = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"), *(F.lit(w).alias(f"w_{n}") for n, w in zip(names, ws))) for (i, j, k), ws in weights.items()))
    sent = volume.select("*", F.inline(kinds)).select(*((F.col(c) - F.col(o)).alias(c) for c, o in zip(AXES, "ijk")), *((F.col("gray") * F.col(f"w_{n}")).alias(n) for n in names))
    return sent.groupBy(*AXES).agg(*(F.sum(n).alias(n) for n in names), F.count(F.lit(1)).alias("seen"))


def sobel(volume: DataFrame) -> DataFrame:
    """(x, y, z, gx, gy, gz) of voxels with a full neighbourhood; the vector points toward lower gray."""
    smooth, slope = (1, 2, 1), (1, 0, -1)
    weights = {(i - 1, j - 1, k - 1): (slope[i] * smooth[j] * smooth[k], smooth[i] * slope[j] * smooth[k], smooth[i] * smooth[j] * slope[k]) for i in range(3) for j in range(3) for k in range(3)}
    return spread(volume, weights, ("gx", "gy", "gz")).filter("seen = 27").drop("seen")


def central_difference(volume: DataFrame) -> DataFrame:
    """(x, y, z, dx, dy, dz) = (next - previous) / 2 along each axis, null at an edge."""
    steps = [(i, j, k, c, s) for n, c in enumerate(AXES) for s in (1, -1) for i, j, k in [tuple(s if m == n else 0 for m in range(3))]]
    kinds = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(step, ("i", "j", "k", "axis", "sign")))) for step in [(0, 0, 0, "", 0), *steps]))
    sent = volume.select(*AXES, "gray", F.inline(kinds)).select(*((F.col(c) - F.col(o)).alias(c) for c, o in zip(AXES, "ijk")), "axis", "sign", "gray")
    slope = lambda c: F.when(F.count_if(F.col("axis") == c) == 2, F.sum(F.when(F.col("axis") == c, F.col("sign") * F.col("gray"))) / 2)
    out = sent.groupBy(*AXES).agg(F.max(F.when(F.col("axis") == "", F.col("gray"))).alias("gray"), *(slope(c).alias(f"d{c}") for c in AXES))
    return out.filter("gray is not null")


def classified(volume: DataFrame, air: int) -> DataFrame:
    """(x, y, z, kind): 0 air (gray < air), 1 border (a neighbour of the 26 is air), 2 material."""
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)))
    near_air = volume.filter(F.col("gray") < air).select(*AXES, F.inline(around)).select(*((F.col(c) + F.col(o)).alias(c) for c, o in zip(AXES, "ijk"))).distinct()
    marked = volume.join(near_air.withColumn("near", F.lit(True)), list(AXES), "left")
    return marked.select(*AXES, F.when(F.col("gray") < air, 0).when(F.col("near"), 1).otherwise(2).alias("kind"))


def image_filter(image: DataFrame, kind: str, k: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, y, value): erode, dilate, mean or median over the (2 k + 1) square that lies in the image; median is the lower one. The columns `by` name an image."""
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-k, k + 1) for j in range(-k, k + 1)))
    sent = image.select(*by, "x", "y", "gray", F.inline(offsets)).select(*by, (F.col("x") + F.col("i")).alias("x"), (F.col("y") + F.col("j")).alias("y"), "gray")
    how = {"erode": F.min("gray"), "dilate": F.max("gray"), "mean": F.avg("gray")}.get(kind)
    if how is None:
        s = F.array_sort(F.collect_list("gray"))
        how = F.element_at(s, (F.floor((F.size(s) - 1) / 2) + 1).cast("int"))
    key = [*by, "x", "y"]
    return sent.groupBy(*key).agg(how.alias("value")).join(image.select(*key), key, "left_semi")


def convolved(image: DataFrame, kernel: list[list[float]], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, y, value): weighted mean over the square of the kernel's size that lies in the image; weights outside count for nothing."""
    k = len(kernel) // 2
    cells = F.array(*(F.struct(F.lit(i - k).alias("i"), F.lit(j - k).alias("j"), F.lit(float(w)).alias("w")) for j, row in enumerate(kernel) for i, w in enumerate(row) if w))
    sent = image.select(*by, "x", "y", "gray", F.inline(cells)).select(*by, (F.col("x") - F.col("i")).alias("x"), (F.col("y") - F.col("j")).alias("y"), "gray", "w")
    key = [*by, "x", "y"]
    return sent.groupBy(*key).agg((F.sum(F.col("gray") * F.col("w")) / F.sum("w")).alias("value")).join(image.select(*key), key, "left_semi")


def like_neighbours(image: DataFrame, k: int, within: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, y, n, top): neighbours of each pixel of an organised image in the (2 k + 1) square whose value differs by less than `within`, itself among them, and the largest of them.

    Values go along their row first and meet as lists, which then go along the column: two group-bys of 2 k + 1
    rows a pixel, without a join that could broadcast what was made many times as large.
    """
    key, steps = [*by, "x", "y"], F.explode(F.array(*map(F.lit, range(-k, k + 1)))).alias("i")
    own = lambda c: F.when(F.col("i") == 0, F.col(c))
    row = image.select(*key, "gray", steps).select(*by, (F.col("x") + F.col("i")).alias("x"), "y", "gray", own("gray").alias("own"))
    row = row.groupBy(*key).agg(F.collect_list("gray").alias("near"), F.collect_list("own").alias("own"))
    square = row.select(*key, "near", "own", steps).select(*by, "x", (F.col("y") + F.col("i")).alias("y"), "near", own("own").alias("own"))
    square = square.groupBy(*key).agg(F.flatten(F.collect_list("near")).alias("near"), F.flatten(F.collect_list("own")).alias("own"))
    like = F.flatten(F.transform("own", lambda g: F.filter("near", lambda v: F.abs(v - g) < within)))
    return square.select(*key, like.alias("like")).filter(F.size("like") > 0).select(*key, F.size("like").cast("long").alias("n"), F.array_max("like").alias("top"))


def integral_image(image: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, y, total): sum of gray over all pixels at or before (x, y). Row sums, then column sums of them."""
    row = image.select(*by, "x", "y", F.sum(F.col("gray").cast("long")).over(Window.partitionBy(*by, "y").orderBy("x")).alias("r"))
    return row.select(*by, "x", "y", F.sum("r").over(Window.partitionBy(*by, "x").orderBy("y")).alias("total"))


def band_labels(volume: DataFrame, dims: tuple[int, int, int], iso: int, spread: int, band: int) -> DataFrame:
    """(x, y, z, label): the band of voxels around gray = iso, as definite or probable background or foreground (DB, PB, PF, DF), null elsewhere.

    Voxels of gray = iso are PF and begin; in each of `band` rounds those reached in the last one
    reach their 26 neighbours, except voxels on the volume's outer layer, which reach none. What is reached
    is labelled by its gray: DB under iso - spread, PB from there to iso, PF from iso, DF over
    iso + spread. A voxel of exactly iso - spread or iso + spread is reached and carries the growth on, but gets no label.
    """
    from geomill.operators.graph import cut

    around = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(o, "ijk"))) for o in product((-1, 0, 1), repeat=3) if any(o)))
    inside = " AND ".join(f"{c} BETWEEN 1 AND {d - 2}" for c, d in zip(AXES, dims))
    seen = last = cut(volume.filter(F.col("gray") == iso).select(*AXES))
    for _ in range(band):
        near = last.filter(inside).select(*AXES, F.inline(around)).select(*((F.col(c) + F.col(o)).alias(c) for c, o in zip(AXES, "ijk"))).distinct()
        last = cut(near.join(seen, list(AXES), "left_anti"))
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    g = F.col("gray")
    label = F.when(g < iso - spread, "DB").when(g > iso + spread, "DF").when(g == iso, "PF").when((g > iso - spread) & (g < iso), "PB").when((g >= iso) & (g < iso + spread), "PF")
    return volume.join(seen.withColumn("seen", F.lit(True)), list(AXES), "left").select(*AXES, F.when(F.col("seen"), label).alias("label"))


def labels_along_gradient(volume: DataFrame, materials: list[tuple[int, int, int]], core: int) -> DataFrame:
    """(x, y, z, label): materials [low, high) of gray, with the voxels between two materials given to the brighter one that their gradient leads to.

    A voxel within its material by at least `core` gray values keeps its label. Any other one looks
    a step up its Sobel gradient: to the neighbour in the direction of all components that are at least half the
    largest, if that voxel is brighter. Steps are followed to where they end, at a sure voxel or where none leads
    on, by pointers that jump twice as far each round until none moves; gray rises on the way, so there are no
    circles. The label is the last voxel's; null outside all materials.
    """
    from geomill.operators.graph import cut

    label, sure = F.lit(None).cast("int"), F.lit(False)
    for low, high, name in materials:
        inside = (F.col("gray") >= low) & (F.col("gray") < high)
        label = F.when(inside, name).otherwise(label)
        sure = sure | (inside & (F.col("gray") >= low + core) & (F.col("gray") < high - core))
    own = volume.select(*AXES, "gray", label.alias("label"), sure.alias("sure"))
    most = F.greatest(*(F.abs(f"g{c}") for c in AXES))
    step = [F.when((most > 0) & (2 * F.abs(f"g{c}") >= most), -F.signum(f"g{c}")).otherwise(0).cast("int") for c in AXES]
    to = own.filter(~F.col("sure")).join(sobel(volume), list(AXES)).select(*AXES, "gray", *((F.col(c) + s).alias(f"t{c}") for c, s in zip(AXES, step)))
    there = own.select(*(F.col(c).alias(f"t{c}") for c in AXES), F.col("gray").alias("higher"))
    at = [f"t{c}" for c in AXES]
    moves = cut(to.join(there, at).filter("higher > gray").select(*AXES, *at))
    while True:
        ahead = moves.select(*(F.col(c).alias(f"t{c}") for c in AXES), *(F.col(f"t{c}").alias(f"n{c}") for c in AXES))
        jumped = moves.join(ahead, at, "left").select(*AXES, *(F.coalesce(f"n{c}", f"t{c}").alias(f"t{c}") for c in AXES), F.col("nx").isNotNull().alias("moved"))
        jumped = cut(jumped)
        moves = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            break
    ends = moves.join(own.select(*(F.col(c).alias(f"t{c}") for c in AXES), F.col("label").alias("found")), at).select(*AXES, "found", F.lit(True).alias("led"))
    return own.join(ends, list(AXES), "left").select(*AXES, F.when(F.col("led"), F.col("found")).otherwise(F.col("label")).alias("label"))


def profile_edges(profiles: DataFrame, key: list[str], at: str, value: str, least: int = 1) -> DataFrame:
    """(key, place, strength, rising): edges of each profile of whole numbers at consecutive places.

    The profile is smoothed by the binomial kernel (1, 4, 6, 4, 1) / 16. An edge is where its
    second derivative crosses zero while the first and the third have opposite signs, so that the slope is
    steepest there; its place lies between two samples by linear interpolation of the second derivative. The
    strength is the larger slope of the two samples (central difference), `least` the smallest that counts.
    All are sums of whole numbers until the last division.
    """
    w = Window.partitionBy(*key).orderBy(at)
    v = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w) if k < 0 else F.col(c)
    p = profiles.select(*key, at, F.col(value).cast("long").alias("_v"))
    p = p.withColumn("_s", v("_v", -2) + 4 * v("_v", -1) + 6 * v("_v", 0) + 4 * v("_v", 1) + v("_v", 2))
    p = p.withColumns({"_d1": v("_s", 1) - v("_s", -1), "_d2": v("_s", 1) - 2 * v("_s", 0) + v("_s", -1), "_d3": v("_s", 2) - 2 * v("_s", 1) + 2 * v("_s", -1) - v("_s", -2)})
    p = p.withColumns({"_n1": v("_d1", 1), "_n2": v("_d2", 1), "_n3": v("_d3", 1)})
    crosses = ((F.col("_d2") > 0) & (F.col("_n2") <= 0)) | ((F.col("_d2") < 0) & (F.col("_n2") >= 0))
    steep = F.greatest(F.abs("_d1"), F.abs("_n1")) / 32
    edges = p.filter(crosses & ((F.col("_d1") + F.col("_n1")) * (F.col("_d3") + F.col("_n3")) < 0) & (steep >= least))
    return edges.select(*key, (F.col(at) + F.col("_d2") / (F.col("_d2") - F.col("_n2"))).alias("place"), steep.alias("strength"), (F.col("_d1") + F.col("_n1") > 0).alias("rising"))


def run_lengths(volume: DataFrame, threshold: int) -> DataFrame:
    """(y, z, start, length): stretches along x of voxels with gray >= threshold."""
    w = Window.partitionBy("y", "z").orderBy("x")
    solid = volume.filter(F.col("gray") >= threshold)
    g: Column = F.col("x") - F.row_number().over(w)
    return solid.select("y", "z", "x", g.alias("g")).groupBy("y", "z", "g").agg(F.min("x").alias("start"), F.count(F.lit(1)).alias("length")).drop("g")
