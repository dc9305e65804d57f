"""Textual references to graph edges, by joins on computed keys.

Every qualified name is filed once under each of its dotted suffixes, so a suffix lookup is an equi-join.
Candidates of all rules are united: a single-part reference also reaches every symbol of its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.graph import cut

#: Method names too common to say which symbol is meant.
COMMON_METHODS = (
    "write values update strip startswith splitlines split setdefault rstrip replace read pop lower keys join items get fetchone fetchall "
    "extend endswith encode decode copy close clear append add"
).split()


def suffixes(symbols: DataFrame) -> DataFrame:
    """(key, id, exact): dotted suffixes of the qualified names; of equal names the last symbol stands for all."""
    last = symbols.groupBy("qualname").agg(F.max("id").alias("id"))
    parts = F.split("qualname", r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, k, F.size(parts)), ".").alias("key"), (k == 1).alias("exact")))
    return last.select("id", F.explode(keys).alias("k")).select("k.key", "id", "k.exact")


def best_suffixes(symbols: DataFrame) -> DataFrame:
    """(key, id): as suffixes, but a key that is an exact name leads to that symbol only."""
    rows = suffixes(symbols)
    exact = rows.where("exact").select("key", F.lit(True).alias("__exact"))
    return rows.join(exact, "key", "left").where(F.col("exact") | F.col("__exact").isNull()).select("key", "id")


def resolve(symbols: DataFrame, references: DataFrame, imports: DataFrame) -> DataFrame:
    """Distinct edges (src, dst, kind) without loops.

    references: (src, ref, kind), with file and src_name of the source if they are at hand.  Each becomes a row per key
    that it may be filed under, and all of them meet the names in one join; only dotted ones that found nothing are
    looked up once more, by their last part.
    """
    if "src_name" not in references.columns:
        references = references.join(symbols.select(F.col("id").alias("src"), "file", F.col("qualname").alias("src_name")), "src")
    refs = references.where("ref <> ''").withColumn("parts", F.split("ref", r"\."))
    single, first, last = F.size("parts") == 1, F.col("parts")[0], F.element_at("parts", -1)
    owner = F.expr("regexp_replace(src_name, '[.][^.]*$', '')")
    module = F.replace(F.regexp_replace("file", r"\.py$", ""), F.lit("/"), F.lit("."))
    # The last import of an alias counts.
    alias = imports.groupBy("file", F.when(F.col("alias") != "", F.col("alias")).otherwise(F.col("name")).alias("first")).agg(F.max_by(F.struct("module", "name"), "ord").alias("i"))
    rest = F.array_join(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), ".")
    base = F.when(F.col("i.name") == F.col("i.module"), F.col("i.module")).otherwise(F.concat_ws(".", "i.module", "i.name"))
    target = F.when(F.col("i").isNotNull(), F.when(single, base).otherwise(F.concat_ws(".", base, rest)))
    of_self = F.when((F.size("parts") == 2) & first.isin("self", "cls"), F.concat_ws(".", owner, F.col("parts")[1]))
    of_module = F.when(single, F.concat_ws(".", module, "ref"))
    keys = F.array_distinct(F.array_compact(F.array("ref", of_self, target, of_module)))
    full = lambda key: F.struct(key.alias("key"), F.lit(False).alias("plain"))
    by_name = F.when(single, F.array(F.struct(F.col("ref").alias("key"), F.lit(True).alias("plain")))).otherwise(F.array().cast("array<struct<key: string, plain: boolean>>"))
    filed = refs.withColumn("first", first).join(alias, ["file", "first"], "left")
    wanted = filed.select("src", "ref", "kind", F.explode(F.concat(F.transform(keys, full), by_name)).alias("k")).select("src", "ref", "kind", "k.key", "k.plain")
    names = symbols.select(F.col("name").alias("key"), "id")
    index = best_suffixes(symbols).select("key", F.lit(False).alias("plain"), F.col("id").alias("dst")).unionByName(names.select("key", F.lit(True).alias("plain"), F.col("id").alias("dst")))
    found = cut(wanted.join(index, ["key", "plain"]).select("src", "ref", "kind", "dst"))
    open_refs = refs.where(~single & ~last.isin(*COMMON_METHODS)).select("src", "ref", "kind", last.alias("key"))
    open_refs = open_refs.join(found.where(F.contains("ref", F.lit("."))).select("src", "ref", "kind"), ["src", "ref", "kind"], "left_anti")
    by_last = open_refs.join(names, "key").select("src", F.col("id").alias("dst"), "kind")
    return found.select("src", "dst", "kind").unionByName(by_last).where("src <> dst").distinct()
