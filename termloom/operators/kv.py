"""Key-value semantics over a log of operations (gid, key, op, value, seq); op is put, append or del."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.placement import get_id

KEY_FIELDS = ("gid", "key")


def fold(log: DataFrame) -> DataFrame:
    """(gid, key, values, is_list): the state after the whole log.

    A put replaces, a del removes, an append adds to what is there: nothing becomes a list of one, one value a list
    of two. A null key of a put is the id of its value. Only what follows a key's last put or del is gathered.
    """
    rows = log.withColumn("key", F.coalesce("key", F.when(F.col("op") == "put", get_id(F.col("value"))))).where("key IS NOT NULL")
    last = rows.where("op <> 'append'").groupBy(*KEY_FIELDS).agg(F.max(F.struct("seq", "op", "value")).alias("base"))
    tail = rows.join(last.select(*KEY_FIELDS, F.col("base.seq").alias("since")), list(KEY_FIELDS), "left").where("op = 'append' AND seq > coalesce(since, -1)")
    added = tail.groupBy(*KEY_FIELDS).agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("t"))
    both = last.join(added, list(KEY_FIELDS), "full_outer")
    put = F.col("base.op") == "put"
    base = F.when(put, F.array(F.col("base.value"))).otherwise(F.array().cast("array<string>"))
    more = F.coalesce(F.transform("t", lambda x: x["value"]), F.array().cast("array<string>"))
    state = both.select(*KEY_FIELDS, F.concat(F.coalesce(base, F.array().cast("array<string>")), more).alias("values"), F.col("t").isNotNull().alias("is_list"), F.coalesce(put, F.lit(False)).alias("put"))
    return state.where("put OR is_list").drop("put")


def latest_puts(log: DataFrame) -> DataFrame:
    """Last write of each key, deletions left out and appends ignored."""
    last = log.where("op <> 'append'").groupBy(*KEY_FIELDS).agg(F.max(F.struct("seq", "op", "value")).alias("m"))
    return last.where("m.op = 'put'").select(*KEY_FIELDS, "m.value")


def keys(state: DataFrame) -> DataFrame:
    return state.select(*KEY_FIELDS).distinct()


def get(state: DataFrame, gid: str, key: str) -> DataFrame:
    """The value's row, or none: a caller turns none into 'Key not found'."""
    return state.where((F.col("gid") == gid) & (F.col("key") == key))


def deletions(log: DataFrame) -> DataFrame:
    """(gid, key, seq, found, old): each del with the value it returned, or found false if there was nothing to delete."""
    w = Window.partitionBy(*KEY_FIELDS).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(F.col("op") != "append", F.struct("seq", "op", "value"))).over(w)
    appended = F.max(F.when(F.col("op") == "append", F.col("seq"))).over(w)
    rows = log.withColumn("b", before).withColumn("a", appended).where("op = 'del'")
    found = F.coalesce(F.col("b.op") == "put", F.lit(False)) | F.coalesce(F.col("a") > F.coalesce(F.col("b.seq"), F.lit(-1)), F.lit(False))
    return rows.select(*KEY_FIELDS, "seq", found.alias("found"), F.when(F.col("b.op") == "put", F.col("b.value")).alias("old"))


def movement_plan(keyed: DataFrame, kid: Column, old_nids: Column, new_nids: Column, place) -> DataFrame:
    """(key, from_nid, to_nid) of the keys whose node changes with the group."""
    moved = keyed.select("key", place(kid, old_nids).alias("from_nid"), place(kid, new_nids).alias("to_nid"))
    return moved.where("from_nid <> to_nid")


def file_name(key: Column, longest: int = 250) -> Column:
    """A key as a file name: its UTF-8 bytes in hex, or H and a hash if that is too long."""
    hex_ = F.lower(F.hex(F.encode(key, "UTF-8")))
    return F.when(F.length(hex_) > longest, F.concat(F.lit("H"), F.sha2(key, 256))).otherwise(hex_)


def key_of_file(name: Column) -> Column:
    """The key of a hex file name; null for hashed names, whose key lies beside the file."""
    return F.when(~name.startswith("H"), F.decode(F.unhex(name), "UTF-8"))
