"""Class rasters as (row, col, class) rows; tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(pixels: DataFrame, cell_row: Column, cell_col: Column) -> DataFrame:
    """row, col, cls, n, permille of each class in each coarse cell."""
    n = pixels.groupBy(cell_row.alias("row"), cell_col.alias("col"), "cls").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("permille", F.col("n") * 1000 / F.sum("n").over(Window.partitionBy("row", "col")))


def level(permille: Column) -> Column:
    """0 for none, then 1 to 4 from 0, 50, 250 and 500 permille."""
    return F.when(permille >= 500, 4).when(permille >= 250, 3).when(permille >= 50, 2).when(permille > 0, 1).otherwise(0)


def rescued(levels: DataFrame, present: DataFrame) -> DataFrame:
    """Levels with at least 1 where a class is known to be. Both: row, col, cls; levels: level."""
    all_ = levels.select("row", "col", "cls", "level").unionByName(present.select("row", "col", "cls", F.lit(1).alias("level")))
    return all_.groupBy("row", "col", "cls").agg(F.max("level").alias("level"))


def typical_share(lv: Column) -> Column:
    """A level's typical share of its cell: the middle of its band."""
    return F.element_at(F.array(F.lit(0.025), F.lit(0.15), F.lit(0.375), F.lit(0.75)), lv)


def mode_resample(pixels: DataFrame, factor: int, land: float = 0.5) -> DataFrame:
    """The most frequent class of each factor x factor block, ties to the smallest; blocks with
    less than a share of land (class not null) are null. Pixels: row, col, cls."""
    r, c = F.expr(f"row div {factor}").alias("row"), F.expr(f"col div {factor}").alias("col")
    n = pixels.groupBy(r, c, "cls").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col("cls").isNotNull(), F.struct((-F.col("n")).alias("v"), "cls")))["cls"]
    dry = F.sum(F.when(F.col("cls").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")
    return n.groupBy("row", "col").agg(F.when(dry >= land, best).alias("cls"))


def parent_votes(pairs: DataFrame, same_name: DataFrame) -> DataFrame:
    """child to parent: an equal name first, else the parent met most often. pairs: child, parent, n; same_name: child, parent."""
    vote = pairs.groupBy("child", "parent").agg(F.sum("n").alias("n")).groupBy("child").agg(F.min(F.struct((-F.col("n")).alias("v"), "parent"))["parent"].alias("voted"))
    return vote.join(same_name.withColumnRenamed("parent", "named"), "child", "full").select("child", F.coalesce("named", "voted").alias("parent"))


def top_patches(patches: DataFrame, cls: str, area: str, k: int = 10) -> DataFrame:
    return patches.withColumn("rk", F.row_number().over(Window.partitionBy(cls).orderBy(F.desc(area), "id"))).where(F.col("rk") <= k)


def pyramid(boxes: DataFrame, z0: int, z1: int) -> DataFrame:
    """id, z, x, y of all tiles of tile boxes (id, x0, y0, x1, y1 at zoom z1), from z1 up to z0."""
    t = boxes.withColumn("z", F.explode(F.sequence(F.lit(z0), F.lit(z1)))).withColumn("d", F.lit(z1) - F.col("z"))
    up = lambda c: F.expr(f"cast(floor({c} / pow(2, d)) as bigint)")
    t = t.select("id", "z", up("x0").alias("x0"), up("x1").alias("x1"), up("y0").alias("y0"), up("y1").alias("y1"))
    return t.withColumn("x", F.explode(F.expr("sequence(x0, x1)"))).withColumn("y", F.explode(F.expr("sequence(y0, y1)"))).select("id", "z", "x", "y")


def pyramid_counts(boxes: DataFrame, z0: int, z1: int) -> DataFrame:
    """id, z and the number of tiles, by arithmetic on the ranges."""
    t = boxes.withColumn("z", F.explode(F.sequence(F.lit(z0), F.lit(z1)))).withColumn("f", F.pow(F.lit(2.0), F.lit(z1) - F.col("z")))
    span = lambda a, b: F.floor(F.col(b) / F.col("f")) - F.floor(F.col(a) / F.col("f")) + 1
    return t.select("id", "z", (span("x0", "x1") * span("y0", "y1")).cast("bigint").alias("n"))


def with_stored_parent(tiles: DataFrame, stored: DataFrame, depth: int = 1) -> DataFrame:
    """Tiles (z, x, y) whose ancestor `depth` levels up is stored."""
    up = stored.select((F.col("z") + depth).alias("z"), F.col("x").alias("_px"), F.col("y").alias("_py"))
    t = tiles.withColumns({"_px": F.shiftright("x", depth), "_py": F.shiftright("y", depth)})
    return t.join(up, ["z", "_px", "_py"], "left_semi").drop("_px", "_py")


def blank_hashes(tiles: DataFrame, digest: str, least: int) -> DataFrame:
    """Contents that recur at least so often: blank tiles by experience."""
    return tiles.groupBy(digest).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def archive_directory(tiles: DataFrame) -> DataFrame:
    """first id, run length and digest of runs of consecutive ids with equal content, and each
    distinct content's order. tiles: tile_id, blob."""
    d = tiles.select("tile_id", F.sha2("blob", 256).alias("digest"))
    slab = F.expr("tile_id div 1048576")  # runs are cut at fixed ids, so that no window spans the archive
    w = Window.partitionBy(slab).orderBy("tile_id")
    new = ~((F.lag("tile_id").over(w) == F.col("tile_id") - 1) & (F.lag("digest").over(w) == F.col("digest")))
    run = d.withColumn("_run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w)).withColumn("_slab", slab)
    return run.groupBy("_slab", "_run", "digest").agg(F.min("tile_id").alias("tile_id"), F.count(F.lit(1)).alias("run_length")).select("tile_id", "run_length", "digest")


#: Ids of a block of tile_lookup: so many runs meet one wanted id at most.
LOOKUP_BLOCK = 32


def tile_lookup(directory: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest of wanted tile ids: runs keyed by each block of ids that they reach into, then the exact range."""
    reach = F.sequence(F.expr(f"tile_id div {LOOKUP_BLOCK}"), F.expr(f"(tile_id + run_length - 1) div {LOOKUP_BLOCK}"))
    d = directory.where("run_length > 0").select(F.col("tile_id").alias("_first"), "run_length", "digest", F.explode(reach).alias("_block"))
    return wanted.select("tile_id", F.expr(f"tile_id div {LOOKUP_BLOCK}").alias("_block")).join(d, "_block").where((F.col("tile_id") >= F.col("_first")) & (F.col("tile_id") < F.col("_first") + F.col("run_length"))).select("tile_id", "digest")


def union_footprint(cells: DataFrame) -> DataFrame:
    """Distinct cells of several packs. cells: pack, cell."""
    return cells.select("cell").distinct()
