"""Column functions of fingerprints, hash-based random numbers and JSON packets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SCHEMA_VERSION = 1
#: Control packets that are understood.
CONTROLS = ("set_day_type", "set_time_band", "request_snapshot")


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys; nulls are written."""
    row = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def digest(*typed: tuple[str, Column]) -> Column:
    """SHA-256 of values, each as its type tag, length and text; a null is a tag of its own."""
    parts = []
    for tag, value in typed:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.lit(tag), F.length(text).cast("string"), F.lit(":"), text), F.lit("n")))
    return F.sha2(F.concat(*parts), 256)


def ordered_fingerprint(order: list[str], text: Column, separator: str = "|") -> Column:
    """An aggregate: SHA-256 of a group's texts in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("_text"))))
    return F.sha2(F.array_join(F.transform(rows, lambda x: x["_text"]), separator), 256)


def fold_in(seed: int, *tokens: Column) -> Column:
    return F.xxhash64(F.lit(seed), *tokens)


def uniform(key: Column) -> Column:
    """From 0 up to 1, of a hashed key."""
    return F.pmod(key, F.lit(1 << 53)) / float(1 << 53)


def unit_interval(text: Column) -> Column:
    """The first eight bytes of a text's SHA-256, little-endian, from 0 to 1."""
    h = F.sha2(text, 256)
    swapped = F.concat(*[F.substring(h, 2 * k + 1, 2) for k in range(7, -1, -1)])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)").cast("double") / float((1 << 64) - 1)


def weighted_choice(options: Column, roll: Column, default: str) -> Column:
    """The name of the first option (name, weight) whose running sum of weights reaches roll times their sum."""
    total = F.aggregate(options, F.lit(0.0), lambda a, x: a + x["weight"])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("name"))
    step = lambda a, x: F.struct((a["sum"] + x["weight"]).alias("sum"), F.coalesce(a["name"], F.when(a["sum"] + x["weight"] >= roll * total, x["name"])).alias("name"))
    return F.when(total <= 0, default).otherwise(F.coalesce(F.aggregate(options, start, step)["name"], F.lit(default)))


def parsed_control(body: Column) -> Column:
    """Struct (control, value, rejected) of a JSON control packet; what isn't understood is no control, with the reason."""
    kind, value = F.get_json_object(body, "$.type"), F.get_json_object(body, "$.value")
    known = kind.isin(*CONTROLS)
    rejected = F.when(F.get_json_object(body, "$").isNull(), "malformed").when(kind.isNull(), "no_type").when(~known, "unsupported_type").when((kind != "request_snapshot") & value.isNull(), "no_value")
    ok = rejected.isNull()
    return F.struct(F.when(ok, kind).otherwise("noop").alias("control"), F.when(ok & (kind != "request_snapshot"), value).alias("value"), rejected.alias("rejected"))


def envelope(packet_type: str, tick: Column, payload: Column) -> Column:
    return F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(packet_type).alias("packet_type"), tick.alias("tick"), payload.alias("payload")))
