"""Identifiers and the functions that place a key on one of several nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(s: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(s.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def get_id(s: Column) -> Column:
    """SHA-256 of the string's JSON text, in hex."""
    return F.sha2(json_text(s), 256)


def node_id(ip: Column, port: Column) -> Column:
    return F.sha2(F.to_json(F.struct(ip.alias("ip"), port.alias("port"))), 256)


def short_id(nid: Column) -> Column:
    return F.left(nid, F.lit(5))


def message_id(at: Column, message: Column) -> Column:
    return F.sha2(F.to_json(F.struct(at.alias("date"), message.alias("mss"))), 256)


def hex_mod(hex_: Column, n: Column) -> Column:
    """A hex number of any length modulo n, digit by digit."""
    digits = F.split(F.lower(hex_), "")
    step = lambda a, d: (a * 16 + F.conv(d, 16, 10).cast("bigint")) % n.cast("bigint")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("bigint"), step)


def naive_hash(kid: Column, nids: Column) -> Column:
    """The node at position kid mod n of the sorted ids; null without nodes."""
    return F.try_element_at(F.array_sort(nids), (hex_mod(kid, F.nullif(F.size(nids), F.lit(0))) + 1).cast("int"))


def consistent_hash(kid: Column, nids: Column) -> Column:
    """The least node id not below the key's, else the least of all."""
    return F.coalesce(F.array_min(F.filter(nids, lambda n: n >= kid)), F.array_min(nids))


def rendezvous_hash(kid: Column, nids: Column) -> Column:
    """The node whose id, appended to the key's and hashed, is greatest."""
    scored = F.transform(nids, lambda n: F.struct(F.sha2(F.concat(F.lit('"'), kid, n, F.lit('"')), 256).alias("h"), n.alias("n")))
    return F.array_max(scored)["n"]
