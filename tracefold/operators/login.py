"""Login events: from raw columns to the twelve normalised ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions import text as T

# Raw and normalised names.
COLUMNS = {
    "User ID": "user_id", "IP Address": "ip", "Country": "country", "Region": "region", "City": "city", "Device Type": "device", "Login Timestamp": "login_timestamp", "Login Successful": "login_successful",
}


def normalize(raw: DataFrame) -> DataFrame:
    """Cleaned texts, UTC times, outcomes and tokens; rows without a time or a known user go."""
    if missing := [c for c in COLUMNS if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    df = raw.select(*(F.col(f"`{c}`").alias(n) for c, n in COLUMNS.items()))
    df = df.withColumns({c: T.clean(F.col(c)) for c in ("user_id", "ip", "country", "region", "city", "device")})
    df = df.withColumns({"login_timestamp": F.try_to_timestamp(F.col("login_timestamp").cast("string")), "login_successful": T.outcome(F.col("login_successful"))})
    df = df.where("login_timestamp is not null and user_id <> 'unknown'")
    df = df.withColumns({"ip_token": T.ip_token(F.col("ip")), "device_token": T.device_family(F.col("device")), "geo_token": T.geo_token(F.col("country"), F.col("region"), F.col("city"))})
    df = df.withColumn("context_token", F.concat_ws("|", "ip_token", "device_token", "geo_token"))
    return df.select("user_id", "ip", "country", "region", "city", "device", "ip_token", "device_token", "geo_token", "context_token", "login_timestamp", "login_successful")
