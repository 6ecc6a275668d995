"""API keys: hashing, validation and lifecycle as append-only versions (SC1-SC3, FL11, SNK7, JN9)."""

from __future__ import annotations

import hashlib
import hmac
import secrets
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, EXPIRY_DAYS, GRACE_HOURS = "ea_", 90, 24
KEYS = "key_id string, name string, key_hash string, prefix string, scopes array<string>, status string, created_at timestamp, expires_at timestamp, rotated_at timestamp, grace_expires_at timestamp, version long"


def hash_key(raw: Column) -> Column:
    return F.sha2(F.trim(raw), 256)


def has_scope(scopes: Column, wanted: Column) -> Column:
    return wanted.isNull() | F.array_contains(scopes, "admin") | F.coalesce(F.array_contains(scopes, wanted), F.lit(False))


def validate_keys(requests: DataFrame, keys: DataFrame, now: Column | None = None) -> DataFrame:
    """Requests (request_id, raw_key, required_scope) with is_valid and error_code; the checks keep their order."""
    now = F.current_timestamp() if now is None else now
    known = keys.select("key_hash", "key_id", "scopes", "status", "expires_at", "grace_expires_at")
    rows = requests.withColumn("key_hash", hash_key(F.coalesce("raw_key", F.lit("")))).join(known, "key_hash", "left")
    late = lambda c: F.col(c).isNotNull() & (now > F.col(c))
    rotating = F.col("status") == "rotating"
    code = (
        F.when(F.trim(F.coalesce("raw_key", F.lit(""))) == "", "MISSING_KEY")
        .when(F.col("key_id").isNull(), "INVALID_KEY")
        .when(F.col("status") == "revoked", "REVOKED_KEY")
        .when(F.col("status") == "expired", "EXPIRED_KEY")
        .when(rotating & late("grace_expires_at"), "GRACE_PERIOD_EXPIRED")
        .when(~rotating & late("expires_at"), "EXPIRED_KEY")
        .when(~has_scope(F.col("scopes"), F.col("required_scope")), "INSUFFICIENT_SCOPE")
    )
    return rows.withColumn("error_code", code).select("request_id", "key_id", "error_code", F.col("error_code").isNull().alias("is_valid"))


def expire_late(keys: DataFrame, now: Column) -> DataFrame:
    """Keys whose time has passed, as new versions with status expired."""
    rotating = F.col("status") == "rotating"
    late = (rotating & (now > F.col("grace_expires_at"))) | ((F.col("status") == "active") & (now > F.col("expires_at")))
    return keys.filter(late).withColumn("status", F.lit("expired")).withColumn("version", F.col("version") + 1)


def same_hash(a: str, b: str) -> bool:
    return hmac.compare_digest(a.encode(), b.encode())


def new_key(spark: SparkSession, name: str, scopes: list[str], now: datetime, days: int = EXPIRY_DAYS) -> tuple[str, DataFrame]:
    """A raw key, shown once, and its first version."""
    raw = PREFIX + secrets.token_urlsafe(32)
    row = (secrets.token_hex(8), name, hashlib.sha256(raw.encode()).hexdigest(), raw[:7] + "...", scopes, "active", now, now + timedelta(days=days), None, None, 1)
    return raw, spark.createDataFrame([row], KEYS)


def rotate_key(spark: SparkSession, keys: DataFrame, key_id: str, now: datetime, grace_hours: int = GRACE_HOURS) -> tuple[str, DataFrame]:
    """The old key as rotating until its grace ends, with a new key of the same name and scopes."""
    old = keys.filter(F.col("key_id") == key_id)
    row = old.first()
    if row is None:
        raise ValueError(f"unknown key {key_id}")
    raw, fresh = new_key(spark, row["name"], list(row["scopes"]), now)
    turned = old.withColumn("status", F.lit("rotating")).withColumn("rotated_at", F.lit(now)).withColumn("grace_expires_at", F.lit(now + timedelta(hours=grace_hours))).withColumn("version", F.col("version") + 1)
    return raw, turned.unionByName(fresh)


def revoke_key(keys: DataFrame, key_id: str) -> DataFrame:
    return keys.filter(F.col("key_id") == key_id).withColumn("status", F.lit("revoked")).withColumn("version", F.col("version") + 1)
