"""Identifiers that are pure functions of content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace of chunk ids.
CHUNK_NAMESPACE = "1f7a0c26-3d51-5b8e-9a44-6e0c2f8d1b73"


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5: SHA-1 of namespace and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def chunk_id(accn: Column, start: Column, end: Column, prefix: str = "") -> Column:
    return uuid5(CHUNK_NAMESPACE, F.concat(F.lit(prefix), accn, F.lit(":"), start.cast("string"), F.lit(":"), end.cast("string")))
