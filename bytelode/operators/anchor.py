"""What a ledger's root is anchored by: the typed-data digest (EIP-712), the call data and the transaction hash. Nothing is sent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelode.functions.keccak import keccak256, keccak256_batch

# The types that are hashed, and the called function's selector.
DOMAIN_TYPE = b"EIP712Domain(string name,string version,uint256 chainId,address verifyingContract)"
ANCHOR_TYPE = b"ForensicLedgerAnchor(bytes32 merkleRoot,uint64 records,uint64 timestamp,string officer)"
SELECTOR = "6a2c30f4"


@dataclass(frozen=True)
class Domain:
    """Where a root is anchored: contract as 40 hex digits."""

    name: str
    version: str
    chain_id: int
    contract: str

    def separator(self) -> bytes:
        kind, name, version = keccak256_batch([DOMAIN_TYPE, self.name.encode(), self.version.encode()])
        words = kind + name + version + self.chain_id.to_bytes(32, "big") + bytes.fromhex(self.contract).rjust(32, b"\0")
        return keccak256_batch([words])[0]


def _word(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n.cast("long"))), 64, "0")


def anchor(roots: DataFrame, domain: Domain) -> DataFrame:
    """To rows with merkle_root (64 hex digits), records, timestamp (seconds), officer and signature (hex, or null: empty; a prefix up to a
    colon is dropped) adds digest, call_data and tx_hash, all as hex with 0x. A root that isn't 32 bytes of hex is hashed as zeros."""
    root = F.when(F.rlike("merkle_root", F.lit("^[0-9a-fA-F]{64}$")), F.lower("merkle_root")).otherwise(F.lit("0" * 64))
    signature = F.regexp_replace(F.coalesce("signature", F.lit("")), "^[^:]*:", "")
    fields = [F.lit(keccak256_batch([ANCHOR_TYPE])[0]), F.unhex(F.concat(root, _word(F.col("records")), _word(F.col("timestamp")))), keccak256(F.encode("officer", "UTF-8"))]
    digest = keccak256(F.concat(F.lit(b"\x19\x01" + domain.separator()), keccak256(F.concat(*fields))))
    call = F.concat(F.lit("0x" + SELECTOR), root, _word(F.col("records")), _word(F.lit(0x60)), _word(F.floor(F.length(signature) / 2)), signature)
    made = roots.withColumn("_digest", digest)
    return made.select(
        *roots.columns, F.concat(F.lit("0x"), F.lower(F.hex("_digest"))).alias("digest"), call.alias("call_data"),
        F.concat(F.lit("0x"), F.lower(F.hex(keccak256(F.concat("_digest", F.encode(signature, "UTF-8")))))).alias("tx_hash"),
    )
