"""Checks of stored contents and signatures of packages."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the signature block: magic, 32-byte key, 64-byte signature at the end.
BLOCK_MAGIC, BLOCK_BYTES = "4E50534947310000", 104


def verify(index: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``relative_path, ok, reason`` of each entry that stores bytes; a failure is a row, not an error."""
    joined = index.where("duplicate_of is null").select("relative_path", "content_hash", F.col("size").alias("expected")).join(rebuilt.select("relative_path", "size", "content_hex"), "relative_path", "left")
    empty = (F.col("expected") == 0) & F.col("content_hex").isNull()
    actual = F.md5(F.unhex(F.coalesce("content_hex", F.lit(""))))
    reason = F.when(~empty & F.col("content_hex").isNull(), "missing chunk").when(F.col("expected") != F.coalesce("size", F.lit(0)), "size mismatch").when(actual != F.col("content_hash"), "hash mismatch")
    return joined.select("relative_path", reason.isNull().alias("ok"), reason.alias("reason"))


def verify_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("total"), F.count_if("ok").alias("verified"), F.count_if(~F.col("ok")).alias("failed"))


def is_signed(content: Column) -> Column:
    """The last 104 bytes begin with the signature's magic."""
    return (F.octet_length(content) >= BLOCK_BYTES) & (F.hex(F.substring(content, -BLOCK_BYTES, 8)) == BLOCK_MAGIC)


def unsigned_length(content: Column) -> Column:
    return F.octet_length(content).cast("long") - F.when(is_signed(content), BLOCK_BYTES).otherwise(0)


def prefix_sha256(content: Column, length: Column) -> Column:
    return F.sha2(F.substring(content, F.lit(1), length.cast("int")), 256)


class Ed25519:
    """Signatures by the JVM's own provider; keys are raw 32-byte strings."""

    PUBLIC_HEAD = bytes.fromhex("302a300506032b6570032100")  # fixed DER prefixes of the key format
    PRIVATE_HEAD = bytes.fromhex("302e020100300506032b657004220420")

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.security = self.jvm.java.security

    def generate(self) -> tuple[bytes, bytes]:
        """(private, public)."""
        pair = self.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
        factory = self.security.KeyFactory.getInstance("Ed25519")
        spec = lambda name: self.jvm.java.lang.Class.forName(f"java.security.spec.{name}")
        private = factory.getKeySpec(pair.getPrivate(), spec("PKCS8EncodedKeySpec")).getEncoded()
        public = factory.getKeySpec(pair.getPublic(), spec("X509EncodedKeySpec")).getEncoded()
        return bytes(private)[-32:], bytes(public)[-32:]

    def sign(self, private: bytes, message: bytes) -> bytes:
        if len(private) != 32:
            raise ValueError("a private key has 32 bytes")
        key = self.security.KeyFactory.getInstance("Ed25519").generatePrivate(self.security.spec.PKCS8EncodedKeySpec(self.PRIVATE_HEAD + private))
        signer = self.security.Signature.getInstance("Ed25519")
        signer.initSign(key)
        signer.update(message)
        return bytes(signer.sign())

    def verify(self, public: bytes, message: bytes, signature: bytes) -> bool:
        key = self.security.KeyFactory.getInstance("Ed25519").generatePublic(self.security.spec.X509EncodedKeySpec(self.PUBLIC_HEAD + public))
        checker = self.security.Signature.getInstance("Ed25519")
        checker.initVerify(key)
        checker.update(message)
        try:
            return bool(checker.verify(signature))
        except Exception:  # a malformed signature
            return False


def table_digest(df: DataFrame) -> bytes:
    """SHA-256 that does not depend on row order: the sum of row digests, modulo 2^256 in 32-bit parts."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    sums = df.select(row.alias("r")).agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring("r", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"w{i}") for i in range(8)]).first()
    return hashlib.sha256("|".join(str(v) for v in sums).encode()).digest()
