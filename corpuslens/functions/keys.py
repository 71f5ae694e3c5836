"""Licence keys and fingerprints as columns. Products, prefixes and salts are parameters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from corpuslens.functions.text import strip

KeyConfig = Mapping[str, tuple[str, str]]  # product -> (prefix, salt)


def repo_fingerprint(url: Column) -> Column:
    return F.substring(F.sha2(F.lower(strip(url)), 256), 1, 16)


def key_hash(key: Column) -> Column:
    return F.sha2(strip(key), 256)


def masked_key(key: Column) -> Column:
    parts = F.split(strip(key), "-")
    return F.when(
        F.size(parts) == 4, F.concat(F.get(parts, F.lit(0)), F.lit("-****-****-"), F.get(parts, F.lit(3)))
    ).otherwise("****-****-****-****")


def key_format_ok(key: Column, product: Column, config: KeyConfig) -> Column:
    """PREFIX-XXXX-XXXX-XXXX with the prefix of the product; unknown products fail."""
    out = F.lit(False)
    for name, (prefix, _) in config.items():
        out = F.when(product == name, strip(key).rlike(rf"^{prefix}(-[A-Z0-9]{{4}}){{3}}$")).otherwise(out)
    return out


def key_checksum_ok(key: Column, product: Column, config: KeyConfig) -> Column:
    """The last segment is the start of the salted hash of the two middle ones."""
    parts = F.split(strip(key), "-")
    out = F.lit(False)
    for name, (_, salt) in config.items():
        body = F.concat(F.lit(f"{salt}:"), F.get(parts, F.lit(1)), F.lit("-"), F.get(parts, F.lit(2)))
        good = F.upper(F.substring(F.sha2(body, 256), 1, 4)) == F.get(parts, F.lit(3))
        out = F.when(product == name, F.coalesce((F.size(parts) == 4) & good, F.lit(False))).otherwise(out)
    return out
