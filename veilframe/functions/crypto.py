"""Keyed identities and value encryption with Spark's own functions.

Keys reach the executors as scalar subqueries over a one-row table, so no key
shows up as a literal in a query plan or in the event log.
"""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_BLOCK = 64


@dataclass(frozen=True)
class VaultKey:
    """Columns for one secret. Build with :func:`vault_key`."""

    inner: Column
    outer: Column
    cipher: Column

    def __repr__(self) -> str:
        return "VaultKey(...)"


def _derived(secret: bytes, label: bytes) -> bytes:
    return hmac.new(secret, label, hashlib.sha256).digest()


def vault_key(spark: SparkSession, secret: bytes) -> VaultKey:
    """The key columns of a caller's secret (any length, 32 random bytes best)."""
    if not secret:
        raise ValueError("the secret must not be empty")
    block = _derived(secret, b"identity").ljust(_BLOCK, b"\0")
    parts = (
        bytearray(b ^ 0x36 for b in block),
        bytearray(b ^ 0x5C for b in block),
        bytearray(_derived(secret, b"enc")),
    )
    table = spark.createDataFrame([parts], "inner binary, outer binary, cipher binary")
    return VaultKey(*(table.select(name).scalar() for name in ("inner", "outer", "cipher")))


def hmac_sha256(message: Column, key: VaultKey) -> Column:
    inner = F.unhex(F.sha2(F.concat(key.inner, message), 256))
    return F.unhex(F.sha2(F.concat(key.outer, inner), 256))


def identity(entity: Column, value: Column, key: VaultKey) -> Column:
    """Keyed identity of a value of an entity type: base64url without padding."""
    message = F.concat(F.encode(entity, "UTF-8"), F.lit(bytearray(b"\0")), F.encode(value, "UTF-8"))
    # Three passes over bytes; translate would look each character up as a string.
    plain = F.rtrim(F.base64(hmac_sha256(message, key)), F.lit("="))
    return F.replace(F.replace(plain, F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))


def encrypt(value: Column, identity_column: Column, key: VaultKey) -> Column:
    """AES-GCM of a value, bound to the row it belongs to."""
    return F.aes_encrypt(
        F.encode(value, "UTF-8"), key.cipher, F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), identity_column
    )


def decrypt(value: Column, identity_column: Column, key: VaultKey) -> Column:
    """The value again; a wrong key, row or changed bytes raise an error."""
    plain = F.aes_decrypt(value, key.cipher, F.lit("GCM"), F.lit("DEFAULT"), identity_column)
    return F.decode(plain, "UTF-8")


def decrypt_or_null(value: Column, identity_column: Column, key: VaultKey) -> Column:
    """The value again, or null where :func:`decrypt` would raise an error."""
    plain = F.try_aes_decrypt(value, key.cipher, F.lit("GCM"), F.lit("DEFAULT"), identity_column)
    return F.decode(plain, "UTF-8")
