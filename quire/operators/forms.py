"""Form fields: names, kinds, values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import storage

READ_ONLY, REQUIRED, RADIO, PUSH, COMBO = 1 << 0, 1 << 1, 1 << 15, 1 << 16, 1 << 17


def has_flag(flags: Column, bit: int) -> Column:
    return F.coalesce(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(False))


def field_type(ft: Column, flags: Column) -> Column:
    """The kind of a field from its type name and flags."""
    button = F.when(has_flag(flags, PUSH), "push_button").when(has_flag(flags, RADIO), "radio_button").otherwise("checkbox")
    choice = F.when(has_flag(flags, COMBO), "combo_box").otherwise("list_box")
    return F.when(ft == "Tx", "text").when(ft == "Btn", button).when(ft == "Ch", choice).when(ft == "Sig", "signature").otherwise("unknown")


def qualified(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, name, ft, ff) of the fields of a form tree (doc_id, id, parent, t, ft, ff).

    A field's name is those from the root down, joined by points; type and flags come from the
    nearest node that has them. Each round goes up one level for all fields still under way, until
    there are none; a field that never comes to a root (its parents are a ring, or not there) has no name
    and isn't listed.
    """
    up = nodes.select("doc_id", F.col("id").alias("parent"), F.col("parent").alias("_p"), F.col("t").alias("_t"), F.col("ft").alias("_ft"), F.col("ff").alias("_ff"))
    leaves = nodes.join(nodes.select("doc_id", F.col("parent").alias("id")).distinct(), ["doc_id", "id"], "left_anti")
    now = leaves.select("doc_id", "id", "parent", F.col("t").alias("name"), "ft", "ff")
    done = now.filter("parent IS NULL")
    most, rounds = None, 0
    while True:
        now = now.filter("parent IS NOT NULL").join(up, ["doc_id", "parent"]).select("doc_id", "id", F.col("_p").alias("parent"), F.concat_ws(".", "_t", "name").alias("name"), F.coalesce("ft", "_ft").alias("ft"), F.coalesce("ff", "_ff").alias("ff"))
        rounds += 1
        if rounds % 4 == 0:
            now = storage.cut(now)
        done = done.unionByName(now.filter("parent IS NULL"))
        if now.filter("parent IS NOT NULL").isEmpty():
            return done.drop("parent")
        if rounds == 16:  # beyond this depth, rings are told by the number of nodes
            most = nodes.groupBy("doc_id").count().agg(F.max("count")).first()[0]
        if most is not None and rounds > most:
            return done.drop("parent")


def described(fields: DataFrame) -> DataFrame:
    """fields (ft, ff) with type, read_only and required."""
    return fields.withColumns({"type": field_type(F.col("ft"), F.col("ff")), "read_only": has_flag(F.col("ff"), READ_ONLY), "required": has_flag(F.col("ff"), REQUIRED)})


def fill(fields: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields with values set, values not placed): read-only, unknown, push-button and signature
    fields take none."""
    settable = ~has_flag(F.col("ff"), READ_ONLY) & F.col("type").isin("text", "checkbox", "radio_button", "combo_box", "list_box")
    new = values.select("doc_id", "name", F.col("value").alias("_v"), F.lit(True).alias("_set"))
    out = fields.join(new, ["doc_id", "name"], "left").withColumn("value", F.when(F.coalesce("_set", F.lit(False)) & settable, F.col("_v")).otherwise(F.col("value")))
    return out.select(*fields.columns), values.join(fields.filter(settable).select("doc_id", "name"), ["doc_id", "name"], "left_anti")


def modify(fields: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Sets what an update gives (not null) and leaves the rest."""
    new = updates.select("doc_id", "name", *[F.col(c).alias(f"_n_{c}") for c in columns])
    out = fields.join(new, ["doc_id", "name"], "left")
    return out.withColumns({c: F.coalesce(f"_n_{c}", c) for c in columns}).select(*fields.columns)


def create(fields: DataFrame, new: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields and the new ones, rejected with error): a new field needs a page that is there, a name not
    yet taken, and a known type."""
    there = pages.select("doc_id", "page").distinct().withColumn("_page", F.lit(True))
    taken = fields.select("doc_id", "name").distinct().withColumn("_taken", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("page"))
    judged = new.withColumn("_nth", nth).join(there, ["doc_id", "page"], "left").join(taken, ["doc_id", "name"], "left")
    error = F.when(F.col("_page").isNull(), "no such page").when(F.col("_taken").isNotNull() | (F.col("_nth") > 1), "name is taken").when(F.col("type") == "unknown", "unknown type")
    judged = judged.withColumn("error", error).drop("_page", "_taken", "_nth")
    ok = judged.filter("error IS NULL").drop("error")
    return fields.unionByName(ok.select(*[c for c in ok.columns if c in fields.columns]), allowMissingColumns=True), judged.filter("error IS NOT NULL")


def has_form(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """docs with has_form."""
    some = fields.select("doc_id").distinct().withColumn("_f", F.lit(True))
    return docs.join(some, "doc_id", "left").withColumn("has_form", F.coalesce("_f", F.lit(False))).drop("_f")
