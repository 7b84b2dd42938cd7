"""Keyed hashes and column encryption as built-in column expressions."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, functions as F

PREFIX = "aes256gcm:"
_BLOCK = 64


def _pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer padded key of RFC 2104, worked out once on the driver."""
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(body: Column, key: bytes | str) -> Column:
    """Lower-case hex HMAC-SHA256 of a string or binary column."""
    inner, outer = _pads(key.encode() if isinstance(key, str) else key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), body.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def signature_valid(body: Column, signature: Column, key: bytes | str) -> Column:
    """True only for a present, matching signature; case of the hex is ignored."""
    given = F.lower(F.coalesce(signature, F.lit("")))
    return F.coalesce((given != "") & (given == hmac_sha256(body, key)), F.lit(False))


def callback_valid(link_id: Column, payment_id: Column, signature: Column, key: bytes | str) -> Column:
    return signature_valid(F.concat(link_id, F.lit("|"), payment_id), signature, key)


def derive_key(secret: str, salt: str = "paymend", info: str = "column-key") -> bytes:
    """32-byte key: 64 hex digits are taken as they are, other text is stretched (RFC 5869)."""
    if len(secret) == 64:
        try:
            return bytes.fromhex(secret)
        except ValueError:
            pass
    root = hmac.new(salt.encode(), secret.encode(), hashlib.sha256).digest()
    return hmac.new(root, info.encode() + b"\x01", hashlib.sha256).digest()


def encrypt(value: Column, key: bytes) -> Column:
    """``aes256gcm:`` + base64 of nonce, ciphertext and tag; empty and null pass through."""
    sealed = F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"))
    return F.when(F.coalesce(value, F.lit("")) == "", value).otherwise(
        F.concat(F.lit(PREFIX), F.base64(sealed))
    )


def is_encrypted(value: Column) -> Column:
    return F.coalesce(F.startswith(value, F.lit(PREFIX)), F.lit(False))


def decrypt(value: Column, key: bytes) -> Column:
    """Plain text; a value without the prefix or under another key comes back unchanged."""
    # A payload that is not base64 yields null here, not an error.
    body = F.try_to_binary(F.substring(value, len(PREFIX) + 1, 2_000_000_000), F.lit("base64"))
    opened = F.try_aes_decrypt(body, F.lit(key), F.lit("GCM"), F.lit("DEFAULT")).cast("string")
    return F.when(is_encrypted(value), F.coalesce(opened, value)).otherwise(value)
