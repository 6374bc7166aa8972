"""Resolving names between lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Endings that one word of each gender has, by declension.
DECLENSIONS = {"U": ("us", "um", "a"), "I": ("is", "e"), "R": ("er", "ra", "rum"), "S": ("er", "ris", "re")}


def spelling_keys(epithet: Column) -> Column:
    """Keys under which spellings of an epithet meet: without hyphens and diaereses, with one i or
    two in -i and -ae, and by stem and declension where more than two letters come before the ending."""
    e = F.translate(F.lower(epithet), "ëï-", "ei")
    other = F.when(e.rlike("ii$|iae$"), F.regexp_replace(e, "i(i|ae)$", "$1")).when(e.rlike("i$|ae$"), F.regexp_replace(e, "(i|ae)$", "i$1"))
    bases = F.array_compact(F.array(e, other))

    def stem(ending: str, kind: str) -> Column:
        bare = lambda w: F.left(w, F.length(w) - len(ending))
        return F.transform(bases, lambda w: F.when(w.endswith(ending) & (F.length(w) > len(ending) + 2), F.concat(bare(w), F.lit(f"|{kind}"))))

    stems = [stem(ending, kind) for kind, endings in DECLENSIONS.items() for ending in endings]
    return F.array_distinct(F.array_compact(F.concat(bases, *stems)))


def candidates(names: DataFrame, accepted: DataFrame) -> DataFrame:
    """name, target, how (exact, variant): same genus and a shared spelling key. Both: name ('Genus epithet')."""
    key = lambda d, c: d.select(F.col("name").alias(c), F.substring_index("name", " ", 1).alias("g"), F.explode(spelling_keys(F.substring_index("name", " ", -1))).alias("k"))
    pairs = key(names, "name").join(key(accepted, "target"), ["g", "k"]).select("name", "target").distinct()
    return pairs.withColumn("how", F.when(F.col("name") == F.col("target"), "exact").otherwise("variant"))


def decided(names: DataFrame, cands: DataFrame, by_hand: DataFrame) -> DataFrame:
    """name, target, relation: by hand first, then the exact name, then a single variant; several are ambiguous."""
    n = cands.groupBy("name").agg(F.max(F.when(F.col("how") == "exact", F.col("target"))).alias("exact"), F.countDistinct("target").alias("n"), F.min("target").alias("one"))
    j = names.select("name").join(by_hand.select("name", F.col("target").alias("hand")), "name", "left").join(n, "name", "left")
    relation = F.when(F.col("hand").isNotNull(), "hand").when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "variant").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return j.select("name", F.when(relation == "hand", F.col("hand")).when(relation == "exact", F.col("exact")).when(relation == "variant", F.col("one")).alias("target"), relation.alias("relation"))


def owned_elsewhere(cands: DataFrame, accepted: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Adds others: the accepted names, but for the candidate's own, that bear the target as their
    name or as a synonym; sorted, empty for none. cands: name, target; accepted: name; synonyms: name, accepted."""
    bearers = accepted.select(F.col("name").alias("target"), F.col("name").alias("_owner")).unionByName(synonyms.select(F.col("name").alias("target"), F.col("accepted").alias("_owner")))
    pairs = cands.select("name", "target").distinct().join(bearers.distinct(), "target").where("_owner <> name")
    others = pairs.groupBy("name", "target").agg(F.sort_array(F.collect_set("_owner")).alias("others"))
    return cands.join(others, ["name", "target"], "left").withColumn("others", F.coalesce("others", F.array().cast("array<string>")))


def accepted_table(taxa: DataFrame) -> DataFrame:
    """accepted id, name and its synonyms, out of a flat taxonomy (id, name, accepted_id or null)."""
    syn = taxa.where("accepted_id is not null and accepted_id <> id").groupBy("accepted_id").agg(F.sort_array(F.collect_list("name")).alias("synonyms"))
    own = taxa.where("accepted_id is null or accepted_id = id")
    return own.join(syn.withColumnRenamed("accepted_id", "_a"), F.col("id") == F.col("_a"), "left").select("id", "name", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"))


def transfers(links: DataFrame) -> DataFrame:
    """Evidence of genus transfers: pairs of genera under which linked names share an epithet key. links: name, target."""
    g = lambda c: F.substring_index(c, " ", 1)
    same = F.arrays_overlap(spelling_keys(F.substring_index("name", " ", -1)), spelling_keys(F.substring_index("target", " ", -1)))
    return links.where((g("name") != g("target")) & same).groupBy(g("name").alias("old"), g("target").alias("new")).agg(F.count(F.lit(1)).alias("n"))


def qualified_states(text: Column) -> Column:
    """State codes of a list such as 'Tas (native and naturalised), Vic': array of struct state, note."""
    parts = F.filter(F.split(text, r",\s*(?![^(]*\))"), lambda p: F.btrim(p) != "")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\s*([A-Za-z]+)", 1).alias("state"), F.nullif(F.regexp_extract(p, r"\(([^)]*)\)", 1), F.lit("")).alias("note")))


def attach_one(classes: DataFrame, labels: DataFrame, score: str) -> tuple[DataFrame, DataFrame]:
    """At most one label a class (the best by score), and the labels left over. labels: label, cls, score."""
    rk = labels.join(classes.select("cls"), "cls", "left_semi").withColumn("_rk", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc(score), "label")))
    taken = rk.where("_rk = 1").drop("_rk")
    return taken, labels.join(taken.select("label"), "label", "left_anti")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("italic", T.BooleanType())])))
def botanical_runs(s: pd.Series) -> pd.Series:
    """A botanical name as runs: genus, epithets and rank's epithets in italics; ranks, authors, cultivars and brackets upright."""
    import re

    ranks = {"subsp.", "ssp.", "var.", "f.", "sp.", "spp.", "aff.", "cf.", "x", "×"}

    def one(t: str | None) -> list[dict]:
        out: list[dict] = []
        quoted = depth = 0
        for i, w in enumerate((t or "").split()):
            opens, closes = w.count("("), w.count(")")
            upright = bool(quoted or depth or opens or w.startswith(("'", "‘")) or w.lower() in ranks)
            italic = not upright and (i == 0 or bool(re.fullmatch(r"[a-z][a-z-]+", w)))
            depth = max(0, depth + opens - closes)
            if w.startswith(("'", "‘")):
                quoted = 1
            if w.endswith(("'", "’")):
                quoted = 0
            if out and out[-1]["italic"] == italic:
                out[-1]["text"] += " " + w
            else:
                out.append({"text": w, "italic": italic})
        return out

    return s.map(one)
