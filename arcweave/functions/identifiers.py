"""Scalar functions on columns: identifiers, names, times, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcweave.schema import FULLNAME_PATTERN, NODE_TYPES, PERMISSIONS, SWHID_PATTERN, TARGET_TYPES, TYPE_CODE, UNTYPED_ORIGINS, VISIT_CLASSES


def swhid(node_type: Column | str, digest: Column) -> Column:
    return F.concat(F.lit("swh:1:"), F.lit(node_type) if isinstance(node_type, str) else node_type, F.lit(":"), digest)


def origin_swhid(url: Column) -> Column:
    return swhid("ori", F.sha1(url.cast("binary")))


def is_swhid(text: Column) -> Column:
    return text.rlike(SWHID_PATTERN)


def swhid_type(text: Column) -> Column:
    return F.substring(text, 7, 3)


def swhid_hash(text: Column) -> Column:
    return F.lower(F.substring(text, 11, 40))


def _chosen(value: Column, options: dict, default: Column | None = None) -> Column:
    out = default if default is not None else F.lit(None)
    for k, v in options.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def type_code(node_type: Column) -> Column:
    return _chosen(node_type, TYPE_CODE).cast("tinyint")


def type_name(code: Column) -> Column:
    return _chosen(code, dict(enumerate(NODE_TYPES))).cast("string")


def swhid_bytes(text: Column) -> Column:
    """22 bytes: the version, the code of the type, the hash."""
    return F.concat(F.unhex(F.lit("01")), F.unhex(F.lpad(F.hex(type_code(swhid_type(text)).cast("bigint")), 2, "0")), F.unhex(swhid_hash(text)))


def swhid_of_bytes(data: Column) -> Column:
    code = F.conv(F.hex(F.substring(data, 2, 1)), 16, 10).cast("int")
    return swhid(type_name(code), F.lower(F.hex(F.substring(data, 3, 20))))


def target_type(value: Column) -> Column:
    """Node type of a relation's target type; an unknown one is an error."""
    return _chosen(value, TARGET_TYPES, F.when(value.isNull(), F.raise_error(F.lit("no target type"))).otherwise(F.raise_error(F.concat(F.lit("unknown target type "), value)))).cast("string")


def permission(mode: Column) -> Column:
    """The git mode if it is one of the known ones, else null."""
    return F.when(mode.isin(*PERMISSIONS), mode)


def permission_name(mode: Column) -> Column:
    return _chosen(mode, PERMISSIONS, F.lit("none")).cast("string")


def visit_class(loader: Column, origin: Column) -> Column:
    """Class of a loader; of the origin's known loader where none is given. Anything else is an error."""
    loader = F.coalesce(loader, _chosen(origin, UNTYPED_ORIGINS))
    out = F.raise_error(F.concat(F.lit("unknown visit type "), F.coalesce(loader, F.lit("null")), F.lit(" of "), F.coalesce(origin, F.lit("null"))))
    for name, loaders in VISIT_CLASSES.items():
        out = F.when(loader.isin(*loaders), F.lit(name)).otherwise(out)
    return out.cast("string")


def person_key(fullname: Column) -> Column:
    """Pseudonym of a person: base64 of the hash of the full name."""
    return F.base64(F.unhex(F.sha2(fullname.cast("binary"), 256)))


def parsed_fullname(fullname: Column) -> Column:
    """Struct of name, email, local and domain part; null if the text isn't `name <local@domain>`."""
    part = lambda i: F.regexp_extract(fullname, FULLNAME_PATTERN, i)
    return F.when(fullname.rlike(FULLNAME_PATTERN), F.struct(part(1).alias("name"), part(2).alias("email"), part(3).alias("local"), part(4).alias("domain")))


def reversed_path(url: Column) -> Column:
    """Sort key of urls: parts between slashes, last first, without slashes at the end."""
    return F.array_join(F.reverse(F.split(F.rtrim(url, F.lit("/")), "/")), "/")


def swapped_protocol(url: Column) -> Column:
    return F.when(url.startswith("git://"), F.concat(F.lit("https://"), F.substring(url, F.lit(7), F.length(url)))).when(url.startswith("https://"), F.concat(F.lit("git://"), F.substring(url, F.lit(9), F.length(url))))


def lossy_text(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def seconds(time: Column) -> Column:
    return F.unix_seconds(time)


def packed_visit(timestamp: Column, full: Column, code: Column) -> Column:
    return F.shiftleft(timestamp, 5).bitwiseOR(F.shiftleft(full.cast("bigint"), 4)).bitwiseOR(F.lit(8)).bitwiseOR(code.cast("bigint"))


def packed_branch(name_id: Column) -> Column:
    return F.shiftleft(name_id, 3)


def packed_entry(name_id: Column, permission_code: Column) -> Column:
    return F.shiftleft(name_id, 3).bitwiseOR(permission_code.cast("bigint"))


def unpacked_entry(label: Column) -> Column:
    return F.struct(F.shiftrightunsigned(label, 3).alias("name_id"), label.bitwiseAND(F.lit(7)).cast("int").alias("permission_code"))


def unpacked_visit(label: Column) -> Column:
    return F.struct(F.shiftrightunsigned(label, 5).alias("visit_timestamp"), (F.shiftrightunsigned(label, 4).bitwiseAND(F.lit(1)) == 1).alias("is_full_visit"), label.bitwiseAND(F.lit(7)).cast("int").alias("visit_code"))
