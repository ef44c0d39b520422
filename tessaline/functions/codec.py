"""Binary codecs and encryption as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessaline.errors import InvalidRequest

#: Fixed values of the value envelope: version, and the place where the pointer begins.
VERSION, START = "01", "02"
KEY_BYTES = 32


def _little_endian(number: Column, size: int) -> Column:
    digits = F.lpad(F.hex(number), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def _from_little_endian(raw: Column, size: int) -> Column:
    digits = F.hex(raw)
    return F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]), 16, 10).cast("bigint")


def encode_envelope(payload: Column) -> Column:
    """Version, pointer size, start, end (little-endian, 2 + length) and the payload. Null stays null."""
    end = F.octet_length(payload).cast("bigint") + 2
    size = F.when(end < 256, 1).when(end < 65536, 2).otherwise(4)
    pointer = F.when(size == 1, _little_endian(end, 1)).when(size == 2, _little_endian(end, 2)).otherwise(_little_endian(end, 4))
    header = F.concat(F.lit(VERSION), F.lpad(F.hex(size), 2, "0"), F.lit(START), pointer)
    return F.concat(F.unhex(header), payload)


def decode_envelope(raw: Column) -> Column:
    """The payload; empty where the pointer size is none of 1, 2, 4, 8. Null stays null."""
    size = F.conv(F.hex(F.substring(raw, 2, 1)), 16, 10).cast("int")

    def arm(n: int) -> Column:
        end = _from_little_endian(F.substring(raw, 4, n), n)
        return raw.substr(F.lit(4 + n), (end - 2).cast("int"))

    out = F.when(size == 1, arm(1)).when(size == 2, arm(2)).when(size == 4, arm(4)).when(size == 8, arm(8))
    return F.when(raw.isNotNull(), F.coalesce(out, F.unhex(F.lit(""))))


def encode_record(payload: Column, entry_size: Column | int) -> Column:
    """A fixed-width record: zeros, a marker byte and the payload at the right end; null if it is too long."""
    size = F.lit(entry_size) if isinstance(entry_size, int) else entry_size
    padded = F.unhex(F.lpad(F.concat(F.lit("01"), F.hex(payload)), (2 * (size + 3)).cast("int"), F.lit("0")))
    return F.when(F.octet_length(payload) <= size, padded)


def decode_record(raw: Column) -> Column:
    """What follows the first marker byte after the flag byte; empty without a marker."""
    body = F.substring(F.hex(raw), 3, 1 << 30)
    bare = F.regexp_replace(body, "^(00)*01", "")
    return F.when(raw.isNotNull(), F.unhex(F.when(body.rlike("^(00)*01"), bare).otherwise("")))


def is_skipped(raw: Column) -> Column:
    """Bit 0 of a record's flag byte."""
    return F.conv(F.hex(F.substring(raw, 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(1)) == 1


def set_skipped(raw: Column) -> Column:
    """The record with bit 0 of its flag byte set."""
    flag = F.conv(F.hex(F.substring(raw, 1, 1)), 16, 10).cast("int").bitwiseOR(F.lit(1))
    return F.concat(F.unhex(F.lpad(F.hex(flag), 2, "0")), F.substring(raw, 2, 1 << 30))


def encode_meta(entry_size: Column, name: Column) -> Column:
    """List metadata: entry size (8 bytes), length of the name (4 bytes), name; little-endian."""
    raw = name.cast("binary")
    return F.concat(F.unhex(_little_endian(entry_size.cast("bigint"), 8)), F.unhex(_little_endian(F.octet_length(raw).cast("bigint"), 4)), raw)


def decode_meta(raw: Column) -> Column:
    """Struct (entry_size, name); null where the stored length passes the end."""
    length = _from_little_endian(F.substring(raw, 9, 4), 4)
    whole = F.octet_length(raw) >= 12 + length
    return F.when(whole, F.struct(_from_little_endian(F.substring(raw, 1, 8), 8).alias("entry_size"), raw.substr(F.lit(13), length.cast("int")).cast("string").alias("name")))


def derive_key(key: str) -> Column:
    """The key's bytes, repeated or cut to 32. Bytes, not characters: keys can be of any script."""
    if not key:
        raise InvalidRequest("the encryption key is empty")
    raw = F.lit(key).cast("binary")
    return F.rpad(raw, KEY_BYTES, raw)


def encrypt(payload: Column, key: str) -> Column:
    """AES-256-GCM: nonce, ciphertext, tag."""
    return F.aes_encrypt(payload, derive_key(key), F.lit("GCM"))


def decrypt(payload: Column, key: str, strict: bool = False) -> Column:
    """The plain bytes; with a wrong key null, or an error if strict."""
    return (F.aes_decrypt if strict else F.try_aes_decrypt)(payload, derive_key(key), F.lit("GCM"))


def as_text(payload: Column) -> Column:
    return payload.cast("string")
