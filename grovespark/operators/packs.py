"""Pack tables: offsets, fan-out, who wins among duplicates, layers of indexes, deltas by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovespark.functions.codecs import delta_target
from grovespark.functions.oid import oid
from grovespark.storage import Scratch

#: Bytes before the first object of a pack.
HEADER = 12


def offsets(entries: DataFrame, by: str = "pack", order: str = "seq", length: str = "len") -> DataFrame:
    """entries with `offset`: the header and what was written before, in each pack."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)) + HEADER)


def fanout(index: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, first_byte, count): how many ids begin with up to each first byte, 256 rows for each group.
    Ids are counted before anything is put in one place, so the running sum sees 256 rows a group."""
    by = by or []
    spark = index.sparkSession
    counts = index.groupBy(*by, F.conv(F.substring("oid", 1, 2), 16, 10).cast("int").alias("first_byte")).agg(F.count("*").alias("n"))
    every = spark.range(256).select(F.col("id").cast("int").alias("first_byte"))
    grid = index.select(*by).distinct().crossJoin(F.broadcast(every)) if by else every
    full = grid.join(counts, [*by, "first_byte"], "left")
    running = Window.partitionBy(*by).orderBy("first_byte").rowsBetween(Window.unboundedPreceding, 0)
    return full.select(*by, "first_byte", F.sum(F.coalesce("n", F.lit(0))).over(running).cast("bigint").alias("count"))


def winners(index: DataFrame, preferred: int | str | None = None) -> DataFrame:
    """One place for each id: the preferred pack's, else the one of the highest pack; the lowest offset in it.
    index: oid, pack_id, offset, and others."""
    names = [c for c in index.columns if c != "oid"]
    first = F.coalesce(F.col("pack_id") == F.lit(preferred), F.lit(False)) if preferred is not None else F.lit(False)
    best = index.groupBy("oid").agg(F.max_by(F.struct(*names), F.struct(first.cast("int"), "pack_id", -F.col("offset"))).alias("w"))
    return best.select("oid", "w.*")


def newest_layer(layers: DataFrame) -> DataFrame:
    """Of several layers (layer, oid, ...) the row of the highest for each id."""
    names = [c for c in layers.columns if c != "oid"]
    return layers.groupBy("oid").agg(F.max_by(F.struct(*names), "layer").alias("w")).select("oid", "w.*")


def layer_offsets(layers: DataFrame) -> DataFrame:
    """layers (layer, packs, objects) with what the layers below hold: first_pack and first_object."""
    below = Window.orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)  # a row for each layer
    return layers.select("layer", "packs", "objects", F.coalesce(F.sum("packs").over(below), F.lit(0)).alias("first_pack"), F.coalesce(F.sum("objects").over(below), F.lit(0)).alias("first_object"))


def incremental(index: DataFrame, base: DataFrame) -> DataFrame:
    """What a new layer holds: ids that no layer below has."""
    return winners(index.join(base.select("oid"), "oid", "left_anti"))


def positions(index: DataFrame) -> DataFrame:
    """index with `position` in the order of ids. Ids are spread evenly by their first four digits: each such range is numbered for
    itself, and the counts of the ranges say where it begins."""
    rows = index.withColumn("__range", F.substring("oid", 1, 4))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")  # 65,536 rows at most
    own = rows.withColumn("position", F.row_number().over(Window.partitionBy("__range").orderBy("oid")).cast("bigint") - 1)
    return own.join(F.broadcast(starts), "__range").withColumn("position", F.col("position") + F.col("__start")).drop("__range", "__start")


def uncovered(packs: DataFrame, midx: DataFrame) -> DataFrame:
    """Packs that a multi-pack index doesn't cover."""
    return packs.join(midx.select("pack").distinct(), "pack", "left_anti")


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Index rows of wanted ids (oid)."""
    return index.join(wanted.select("oid").distinct(), "oid")


def with_crc(entries: DataFrame, data: str = "data") -> DataFrame:
    return entries.withColumn("crc32", F.crc32(F.col(data).cast("binary")))


def object_count(index: DataFrame) -> DataFrame:
    return index.agg(F.count_distinct("oid").alias("objects"))


def pack_summary(index: DataFrame) -> DataFrame:
    return index.groupBy("pack").agg(F.count("*").alias("objects"))


def size_by_type(objects: DataFrame) -> DataFrame:
    """Objects and bytes by type, with a total (type null)."""
    return objects.rollup("type").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def resolve_deltas(entries: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """(pack, offset, type, oid, content) of pack entries (pack, offset, type, base_offset, base_oid, content), whatever pack a
    base lies in. A join by place and one by id settle a level of all chains at once; external: objects (oid, type, content)
    of the store, for bases outside. Entries without a base come out with a null oid."""
    scratch = Scratch(entries.sparkSession)
    done = scratch.keep(entries.where("base_offset IS NULL AND base_oid IS NULL").select("pack", "offset", "type", oid(F.col("content"), F.col("type")).alias("oid"), "content"))
    open_ = scratch.keep(entries.where("base_offset IS NOT NULL OR base_oid IS NOT NULL"))
    while not open_.isEmpty():
        known = done.select("oid", "type", "content")
        if external is not None:
            known = known.unionByName(external.select("oid", "type", "content"))
        known = known.dropDuplicates(["oid"]).select(F.col("oid").alias("base_oid"), F.col("type").alias("base_type"), F.col("content").alias("base"))
        by_place = open_.where("base_offset IS NOT NULL").join(done.select("pack", F.col("offset").alias("base_offset"), F.col("type").alias("base_type"), F.col("content").alias("base")), ["pack", "base_offset"])
        by_oid = open_.where("base_oid IS NOT NULL").join(known, "base_oid")
        names = ["pack", "offset", "base_type", "base", "content"]
        new = by_place.select(*names).unionByName(by_oid.select(*names)).select("pack", "offset", F.col("base_type").alias("type"), delta_target("base", "content").alias("content"))
        new = scratch.keep(new.select("pack", "offset", "type", oid(F.col("content"), F.col("type")).alias("oid"), "content"))
        if new.isEmpty():
            return done.unionByName(open_.select("pack", "offset", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("oid"), F.lit(None).cast("binary").alias("content")))
        done = done.unionByName(new)
        open_ = scratch.keep(open_.join(new.select("pack", "offset"), ["pack", "offset"], "left_anti"))
    return done
