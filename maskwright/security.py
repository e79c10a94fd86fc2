"""Password protection of change maps: PBKDF2 for the key, Spark's authenticated AES for the bytes."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import SparkSession, functions as F

# Rounds and salt size of the key derivation.
ROUNDS, SALT = 390_000, 16


def _key(password: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ROUNDS, 32)


def encrypt(spark: SparkSession, data: bytes, password: str) -> bytes:
    """Salt, then nonce, ciphertext and tag."""
    salt = os.urandom(SALT)
    row = spark.createDataFrame([(bytearray(data), bytearray(_key(password, salt)))], "data binary, key binary").select(F.aes_encrypt("data", "key", F.lit("GCM"), F.lit("DEFAULT")))
    return salt + bytes(row.first()[0])


def decrypt(spark: SparkSession, blob: bytes, password: str) -> bytes:
    """The bytes that were encrypted; ValueError for a wrong password or a damaged blob."""
    if len(blob) > SALT:
        row = spark.createDataFrame([(bytearray(blob[SALT:]), bytearray(_key(password, blob[:SALT])))], "data binary, key binary").select(F.try_aes_decrypt("data", "key", F.lit("GCM"), F.lit("DEFAULT")))
        if (data := row.first()[0]) is not None:
            return bytes(data)
    raise ValueError("Incorrect password or corrupted mapping file")
