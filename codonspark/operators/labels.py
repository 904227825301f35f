"""Labels of proteins from annotation text, lineages and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonspark.plans.frames import seeded

CLASSES = ("noTP", "SP", "mTP", "cTP", "lTP")
#: Fixed taxon numbers.
EUKARYOTA, VIRIDIPLANTAE, METAZOA, FUNGI = "2759", "33090", "33208", "4751"
PRESETS = ("viridiplantae", "metazoa", "fungi", "non_viridiplantae_euk", "protist_core")
#: Fixed synonyms.
NON_PLANT = ("nonplant", "non_plant", "non_plants", "other", "metazoa", "fungi", "animal", "animals")
PLANT = ("plant", "plants", "viridiplantae")


def _signals(text: Column) -> dict[str, Column]:
    t = F.lower(F.coalesce(text, F.lit("")))
    return {"text": t, "sp": t.contains("secreted") | t.contains("signal peptide"), "mtp": t.contains("mitochond"), "ctp": t.contains("chloroplast") | t.contains("plastid"),
            "thylakoid": t.contains("thylakoid"), "lumen": t.contains("lumen") | t.contains("luminal")}


def from_location_text(text: Column) -> Column:
    """struct(label, perox, ambiguous) inferred from an annotation of subcellular location."""
    s = _signals(text)
    ltp = s["thylakoid"] & s["lumen"]
    label = F.when(ltp, "lTP").when(s["ctp"], "cTP").when(s["mtp"], "mTP").when(s["sp"], "SP").otherwise("noTP")
    several = sum(x.cast("int") for x in (s["sp"], s["mtp"], s["ctp"], ltp)) > 1
    return F.struct(label.alias("label"), F.when(s["text"].contains("peroxisom"), "yes").otherwise("no").alias("perox"), F.when(ltp & s["ctp"], s["sp"] | s["mtp"]).otherwise(several).alias("ambiguous"))


def strict_label(text: Column, group: Column) -> Column:
    """struct(label, reason): the class if the text is clear for the organism group (plant or not), else null and why not."""
    s = _signals(text)
    plant = F.lower(F.trim(F.coalesce(group, F.lit("")))) == "plant"
    plastid, ltp = plant & s["ctp"], plant & s["thylakoid"] & s["lumen"]
    clash = (sum(x.cast("int") for x in (s["sp"], s["mtp"], plastid)) > 1) | (ltp & (s["sp"] | s["mtp"]))
    noise = s["text"].contains("membrane") & ~s["text"].contains("thylakoid lumen")
    reason = (F.when(F.trim(s["text"]) == "", "missing_location_text").when(~plant & (s["ctp"] | s["thylakoid"]), "nonplant_plastid").when(clash, "ambiguous").when(ltp & noise, "ltp_membrane_noise")
              .when(~ltp & plastid & s["thylakoid"], "thylakoid_not_lumen").otherwise(""))
    label = F.when(ltp, "lTP").when(plastid, "cTP").when(s["mtp"], "mTP").when(s["sp"], "SP").otherwise("noTP")
    return F.struct(F.when(reason == "", label).alias("label"), reason.alias("reason"))


def taxon_ids(lineage: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(lineage, F.lit("")), F.lit(r"\b(\d+)\b"), F.lit(1)))


def lineage_presets(lineage: Column) -> Column:
    """array<string> of the presets that a lineage belongs to, null without taxon numbers."""
    ids = taxon_ids(lineage)
    has = lambda x: F.array_contains(ids, x)
    euk, plant, animal, fungus = has(EUKARYOTA), has(VIRIDIPLANTAE), has(METAZOA), has(FUNGI)
    tests = dict(zip(PRESETS, (plant, animal, fungus, ~plant, ~plant & ~animal & ~fungus), strict=True))
    return F.when(F.size(ids) > 0, F.array_compact(F.array(*[F.when(euk & test, F.lit(name)) for name, test in tests.items()])))


def split_by_preset(rows: DataFrame, lineage: str = "lineage_ids") -> DataFrame:
    """Rows once for each preset they belong to, as ``preset``; ready for write.partitionBy('preset')."""
    return rows.withColumn("preset", F.explode(lineage_presets(F.col(lineage))))


def kingdom(lineage: Column) -> Column:
    """Kingdom of a lineage text of taxon numbers that blanks follow."""
    padded = F.concat(F.coalesce(lineage, F.lit("")), F.lit(" "))
    return F.when(padded.contains(VIRIDIPLANTAE + " "), "Viridiplantae").when(padded.contains(METAZOA + " "), "Metazoa").when(padded.contains(FUNGI + " "), "Fungi").otherwise("Other")


def organism_group(value: Column) -> Column:
    """plant, non_plant or empty; null for a value that is neither known nor empty.

    ``organism_group_of`` goes on to kingdom and lineage where the value is empty.
    """
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"[\s\-]+", "_")
    return F.when(text.isin("", "unknown", "auto"), "").when(text.isin(*PLANT), "plant").when(text.isin(*NON_PLANT), "non_plant")


def organism_group_of(rows: DataFrame) -> Column:
    """The group that a table's columns tell, as text: ``organism_group`` if it says anything, else plant or non_plant by ``kingdom``, else
    by ``lineage_ids``, else unknown. Columns that the table lacks say nothing."""
    held = lambda name: F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in rows.columns else F.lit("")
    own, realm, ids = held("organism_group"), F.lower(held("kingdom")), taxon_ids(held("lineage_ids"))
    by_kingdom = F.when(realm == "viridiplantae", "plant").when(realm.isin("metazoa", "fungi", "other"), "non_plant")
    euk = F.array_contains(ids, EUKARYOTA)
    by_lineage = F.when(euk & F.array_contains(ids, VIRIDIPLANTAE), "plant").when(euk, "non_plant")
    return F.when(own != "", own).otherwise(F.coalesce(by_kingdom, by_lineage, F.lit("unknown")))


#: Fixed: names of classes, without blanks, bars and hyphens.
CLASS_NAMES = {
    "noTP": ("notp", "none", "cytosol", "cytoplasm"),
    "SP": ("sptp", "sp", "signalpeptide", "secreted"),
    "mTP": ("mtp", "mitochondria", "mitochondrion"),
    "cTP": ("ctp", "chloroplast", "plastid"),
    "lTP": ("ltp", "thylakoid", "lumen"),
}
#: Fixed: what is read as yes, no and nothing.
YES = ("1", "y", "yes", "true", "t", "peroxisome", "peroxisomal")
NO = ("0", "n", "no", "false", "f", "non-peroxisomal", "not_peroxisomal")
NOTHING = ("", "na", "nan", "none")


def localization_class(value: Column) -> Column:
    """The class that a name stands for, in any case; raises in the job for null and for names that are unknown."""
    text = F.regexp_replace(F.lower(F.trim(value.cast("string"))), r"[\s_\-]+", "")
    known = F.coalesce(*[F.when(text.isin(*names), F.lit(c)) for c, names in CLASS_NAMES.items()])
    return F.coalesce(known, F.raise_error(F.concat(F.lit("no such localization: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("string"))


def yes_no(value: Column, default: str = "no") -> Column:
    """yes or no; ``default`` where nothing is said. Raises in the job for what is unknown."""
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    known = F.when(text.isin(*YES), "yes").when(text.isin(*NO), "no").when(text.isin(*NOTHING), default)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("neither yes nor no: "), value.cast("string"))).cast("string"))


def label_summary(rows: DataFrame, labels: str = "localization_labels") -> DataFrame:
    """(label, n) of semicolon-joined labels."""
    one = F.explode(F.transform(F.split(F.coalesce(labels, F.lit("")), ";"), lambda x: F.trim(x)))
    return rows.select(one.alias("label")).where("label <> ''").groupBy("label").agg(F.count("*").alias("n"))


#: Stretches of the hash's range that a class is laid out over; only their counts are put in order.
BUCKET_BITS = 12


def ranked(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """``rows`` with _rank (from 0) within their class, in the order of a seeded hash of the key, then the key; and _count, the class's rows.

    A class is never brought into one task: rows are numbered within stretches of the hash's range, and a stretch starts at
    the count of those before it.
    """
    rows = rows.withColumn("_h", seeded(seed, key)).withColumn("_bucket", F.call_function("shiftright", "_h", F.lit(60 - BUCKET_BITS)))
    held = rows.groupBy(F.col(label).alias("_label"), F.col("_bucket").alias("_at")).agg(F.count("*").alias("_n"))
    every = Window.partitionBy("_label")
    ahead = every.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_label", "_at", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(every).alias("_count"))
    rank = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_h", key))
    out = rows.withColumn("_inside", rank).join(held, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_at")))
    return out.withColumn("_rank", F.col("_ahead") + F.col("_inside") - 1).drop("_h", "_bucket", "_label", "_at", "_ahead", "_inside")


def stratified_folds(rows: DataFrame, k: int, label: str = "label", key: str = "input_order", seed: int = 1) -> DataFrame:
    """``rows`` with fold (from 0): each class is dealt round in the order of a seeded hash of the key."""
    return ranked(rows, label, key, seed).withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_count")


def capped_sample(rows: DataFrame, most: int, label: str = "label", key: str = "input_order", seed: int = 1) -> DataFrame:
    """At most ``most`` rows of each class, by a seeded hash of the key. Tasks keep no more than that of a class before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(seeded(seed, key), key))
    return rows.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")
