"""Deterministic identifiers, computed in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the OID namespace of RFC 4122, as hex.
_OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"
_VARIANT = {d: "89ab"[int(d, 16) & 3] for d in "0123456789abcdef"}


def uuid5_oid(name: Column) -> Column:
    """Name-based UUID, version 5, in the OID namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_OID_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(
        F.substring(digest, 17, 1), "".join(_VARIANT), "".join(_VARIANT.values())
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def point_id(
    namespace: Column, file_path: Column, symbol: Column, start_line: Column, end_line: Column
) -> Column:
    """Id of a chunk: a re-indexed, unchanged chunk keeps it."""
    span = F.concat_ws("-", start_line.cast("string"), end_line.cast("string"))
    return uuid5_oid(F.concat_ws("|", namespace, file_path, symbol, span))


def model_tag(model_name: str) -> str:
    return model_name.replace("/", "_").replace("BAAI_", "")


def cache_key(text: Column, model_name: str) -> Column:
    return F.concat(F.lit(f"embed:{model_tag(model_name)}:"), F.sha2(text, 256))
