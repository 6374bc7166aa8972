"""Catalogue reads: profiles, lists, faces, legends, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.relational import keep_first


def best_profiles(plants: DataFrame) -> DataFrame:
    """One profile a species: photographed with a name of its own, photographed, named, first. plants: species, id, photos, own_name."""
    photo = F.col("photos") > 0
    return keep_first(plants, "species", [F.desc(photo & F.col("own_name")), F.desc(photo), F.desc("own_name"), F.col("id")])


def often_lists(lists: DataFrame) -> DataFrame:
    """Adds tally: whether a code's list has no scores at all."""
    return lists.withColumn("tally", F.count("score").over(Window.partitionBy("code")) == 0)


def community_sites(c1: DataFrame, members: DataFrame) -> DataFrame:
    """Sites by code and species; the uncapped member counts win."""
    return c1.select("code", "species", F.col("sites").alias("a")).join(members.select("code", "species", F.col("sites").alias("b")), ["code", "species"], "full").select("code", "species", F.coalesce("b", "a").alias("sites"))


def sections(members: DataFrame, here: DataFrame, near: DataFrame) -> DataFrame:
    """Group members in sections here, near and rest. here, near: species, sites."""
    m = members.join(here.select("species", F.col("sites").alias("h")), "species", "left").join(near.select("species", F.col("sites").alias("n")), "species", "left")
    section = F.when(F.col("h") > 0, "here").when(F.col("n") > 0, "near").otherwise("rest")
    order = F.row_number().over(Window.partitionBy("grp", section).orderBy(F.desc(F.coalesce("h", "n", F.lit(0))), "species"))
    return m.select("grp", "species", section.alias("section"), order.alias("pos"))


def faces(cards: DataFrame, k: int = 5) -> DataFrame:
    """The first k cards: each key and each profile once, those with photos first. cards: pos, key, profile, photos."""
    once = keep_first(keep_first(cards, "key", [F.col("pos")]), "profile", [F.col("pos")])
    return once.orderBy(F.desc(F.col("photos") > 0), "pos").limit(k)


def legend(rows: DataFrame) -> DataFrame:
    """Legend order: groups by their oldest unit, the oldest first and Other last; rows of one colour
    stand together where the first of them stands. rows: grp, pos, age, colour."""
    g = Window.partitionBy("grp")
    placed = rows.withColumns({"_g": F.max("age").over(g), "_c": F.min("pos").over(Window.partitionBy("grp", "colour"))})
    order = Window.orderBy(F.col("grp") == "Other", F.desc("_g"), "grp", "_c", "pos")
    return placed.withColumn("rk", F.row_number().over(order)).drop("_g", "_c")


def integrity(files: DataFrame) -> DataFrame:
    """verdict by file: missing, short, long or ok. files: name, need, have (bytes; null: absent)."""
    return files.withColumn("verdict", F.when(F.col("have").isNull(), "missing").when(F.col("have") < F.col("need"), "short").when(F.col("have") > F.col("need"), "long").otherwise("ok"))


def first_hit(hits: DataFrame, kinds: list[str]) -> DataFrame:
    """By tap, the hit of the kind that comes first, then the nearest. hits: tap, kind, dist, id."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return keep_first(hits, "tap", [rank, F.col("dist"), F.col("id")])


def looked_up(wanted: DataFrame, tables: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Adds found and by: the first of several lookups that has a row. tables: tag, table (key, value), column of wanted."""
    out, drop = wanted, []
    tag = F.lit(None).cast("string")
    for name, t, column in tables:
        one = t.groupBy("key").agg(F.min("value").alias(f"_{name}"))
        out = out.join(one, out[column] == one["key"], "left").drop("key")
        drop.append(f"_{name}")
    for name, *_ in reversed(tables):
        tag = F.when(F.col(f"_{name}").isNotNull(), name).otherwise(tag)
    return out.withColumn("found", F.coalesce(*drop)).withColumn("by", tag).drop(*drop)


def alias_map(classes: DataFrame, aliases: str, order: str) -> DataFrame:
    """alias to class; each alias's first definition wins. classes: cls, aliases ('a|b|c')."""
    e = classes.select("cls", order, F.explode(F.split(aliases, r"\|")).alias("alias")).where("alias <> ''")
    return keep_first(e, "alias", [F.col(order), F.col("cls")]).select("alias", "cls")


def credits(sources: list[DataFrame], key: str) -> DataFrame:
    """One credit row an id from several tables, the earlier table first."""
    out = None
    for i, s in enumerate(sources):
        part = s.withColumn("_p", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return keep_first(out, key, [F.col("_p")]).drop("_p")


def creator_totals(items: DataFrame) -> DataFrame:
    """creator, n, licences (map), by n down and then lower-case name. items: creator, licence."""
    n = items.groupBy("creator", "licence").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("creator").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("licence", "n")))).alias("licences"))


def work_list(plants: DataFrame, photos: str) -> DataFrame:
    """Photos of all plants, each stored name once, where it first occurs. plants: id, photos (array of struct name, ...)."""
    e = plants.select("id", F.posexplode(photos).alias("pos", "p")).select("id", "pos", "p.*")
    return keep_first(e, "name", [F.col("id"), F.col("pos")])


def zscore_choice(items: DataFrame, group: str, cost: Column, x: str, current: Column, margin: float) -> DataFrame:
    """The pick of each group by cost plus the z-score of x, unless the current one is within the margin of it."""
    w = Window.partitionBy(group)
    z = F.when(F.stddev_pop(x).over(w) > 0, (F.col(x) - F.avg(x).over(w)) / F.stddev_pop(x).over(w)).otherwise(F.lit(0.0))
    scored = items.withColumn("rank_score", cost + z).withColumn("_cur", current)
    best = scored.groupBy(group).agg(F.max(F.struct("rank_score", (-F.col("id")).alias("nid"))).alias("b"), F.max(F.when(F.col("_cur"), F.struct("rank_score", (-F.col("id")).alias("nid")))).alias("c"))
    keep = F.col("c").isNotNull() & (F.col("b.rank_score") - F.col("c.rank_score") < margin)
    return best.select(group, F.when(keep, -F.col("c.nid")).otherwise(-F.col("b.nid")).alias("id"), keep.alias("kept"))


def quota_pick(candidates: DataFrame, cls: str, person: str, kind: str, quotas: dict[str, int], order: list[Column]) -> DataFrame:
    """Up to a quota of each kind by class, further pictures of one person after first ones."""
    dup = F.row_number().over(Window.partitionBy(cls, kind, person).orderBy(*order)) - 1
    rk = F.row_number().over(Window.partitionBy(cls, kind).orderBy("dup", *order))
    quota = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(kind)), F.lit(0))
    return candidates.withColumn("dup", dup).withColumn("rk", rk).where(F.col("rk") <= quota)


def fit_zoom(width: Column, height: Column, view_w: float, view_h: float, tile: float = 512.0) -> Column:
    """Zoom at which a box (shares of the world) fills a view."""
    return F.log2(F.least(F.lit(view_w) / (width * tile), F.lit(view_h) / (height * tile)))


def silhouette(form: Column, height: Column) -> Column:
    """Shape class from a form's words and a height in metres."""
    f = F.lower(F.coalesce(form, F.lit("")))
    return (
        F.when(f.rlike("fern"), "fern").when(f.rlike("grass|sedge|rush"), "grass").when(f.rlike("climber|vine"), "climber").when(f.rlike("moss|liverwort|lichen"), "moss")
        .when(f.rlike("tree") & (F.coalesce(height, F.lit(10.0)) >= 4), "tree").when(f.rlike("tree|shrub"), F.when(F.coalesce(height, F.lit(1.0)) >= 1, "shrub").otherwise("low shrub"))
        .when(f.rlike("herb|daisy|orchid|lily"), "herb").otherwise("other")
    )


def status(notes: Column) -> Column:
    """The gravest status in an array of notes."""
    has = lambda w: F.exists(notes, lambda n: F.lower(n).contains(w))
    return F.when(has("endangered"), "endangered").when(has("vulnerable"), "vulnerable").when(has("rare"), "rare")


def verdict(code: Column, magic: Column) -> Column:
    """What a download's status and first bytes say: ok, gone, retry or refused."""
    image = magic.isin("FFD8FF", "89504E", "524946")
    return F.when(code == 200, F.when(image, "ok").otherwise("refused")).when(code.isin(404, 410), "gone").when((code >= 500) | code.isin(408, 429) | code.isNull(), "retry").otherwise("refused")


def merged_facts(register: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts with the register first, the sheet's common name only if the genus agrees; and the conflicts. Both: ref, botanical, common, height."""
    j = register.alias("r").join(sheets.alias("s"), "ref", "full")
    genus = lambda c: F.substring_index(F.col(c), " ", 1)
    agree = F.coalesce(genus("r.botanical") == genus("s.botanical"), F.lit(True))
    facts = j.select("ref", F.coalesce("r.botanical", "s.botanical").alias("botanical"), F.coalesce(F.col("r.common"), F.when(agree, F.col("s.common"))).alias("common"), F.coalesce("r.height", "s.height").alias("height"))
    return facts, j.where(~agree).select("ref", F.col("r.botanical").alias("register"), F.col("s.botanical").alias("sheet"))


def references(rows: DataFrame) -> DataFrame:
    """One row a reference: largest number of trees, most frequent note, sheets in order. rows: ref, trees, note, sheet."""
    note = rows.where("note is not null").groupBy("ref", "note").agg(F.count(F.lit(1)).alias("n")).groupBy("ref").agg(F.min(F.struct((-F.col("n")).alias("v"), "note"))["note"].alias("note"))
    return rows.groupBy("ref").agg(F.max("trees").alias("trees"), F.sort_array(F.collect_set("sheet")).alias("sheets")).join(note, "ref", "left")


def ref_key(ref: Column) -> list[Column]:
    """Sort keys: plain digits before letter prefixes, numbers as numbers."""
    return [F.regexp_extract(ref, "^([A-Za-z]*)", 1), F.coalesce(F.regexp_extract(ref, "([0-9]+)", 1).try_cast("bigint"), F.lit(0)), ref]
