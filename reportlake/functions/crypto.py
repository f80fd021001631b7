"""Hashes, keyed hashes and sealing with built-in expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex; the pads are worked out once on the driver."""
    k = hashlib.sha256(key).digest() if len(key) > BLOCK else key
    k = k.ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ p for b in k)) for p in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def chain_link(previous: Column, *parts: Column) -> Column:
    """SHA-256 over the previous link and the parts, joined by pipes."""
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), *parts), 256)


def seal(text: Column, key: bytes) -> Column:
    """AES-256-GCM, URL-safe base64."""
    return F.translate(F.base64(F.aes_encrypt(text, F.lit(hashlib.sha256(key).digest()))), "+/", "-_")


def unseal(sealed: Column, key: bytes) -> Column:
    """The text, or null under a wrong key."""
    return F.try_aes_decrypt(F.unbase64(F.translate(sealed, "-_", "+/")), F.lit(hashlib.sha256(key).digest())).cast("string")
