"""Deterministic ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own namespaces, derived from a name each.
MEMORY, PROCEDURE, FACT, PREDICATE, PROVENANCE = (uuid.uuid5(uuid.NAMESPACE_URL, f"mnemospark:{n}").hex for n in ("memory", "procedure", "fact", "predicate", "provenance"))


def uuid5(namespace_hex: str, *parts: Column) -> Column:
    """UUID version 5 of the parts joined by NUL; a null part counts as empty."""
    name = F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts])
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)
