"""Webhook verification and trigger selection, as predicates over data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds for which a signed request stays valid.
WINDOW_SECONDS = 300


def signature(timestamp: Column, payload: Column, secret: Column) -> Column:
    """SHA-256 of timestamp, payload and secret joined by dots, as hex."""
    return F.sha2(F.concat_ws(".", timestamp.cast("string"), payload, secret), 256)


def verify(requests: DataFrame, now: Column, secret: Column, window: int = WINDOW_SECONDS) -> DataFrame:
    """Add ``fresh``, ``signed`` and ``accepted`` to requests (sent_at, payload, sig); times are epoch seconds."""
    age = now - F.col("sent_at")
    fresh = age.between(0, window)
    signed = F.coalesce(F.col("sig") == signature(F.col("sent_at"), F.col("payload"), secret), F.lit(False))
    return requests.withColumn("fresh", fresh).withColumn("signed", signed).withColumn("accepted", fresh & signed)


def matching(definitions: DataFrame, url: Column) -> DataFrame:
    """Definitions any of whose triggers (structs of cron and webhook) has this webhook."""
    return definitions.where(F.exists("triggers", lambda t: t["webhook"] == url))


def schedules(definitions: DataFrame) -> DataFrame:
    """Each definition's schedule: its first trigger with a cron text; none, no schedule."""
    crons = F.filter(F.transform("triggers", lambda t: t["cron"]), lambda c: c.isNotNull() & (c != ""))
    return definitions.withColumn("cron", F.get(crons, F.lit(0))).where("cron IS NOT NULL")


def valid_address(ip: Column, port: Column) -> Column:
    """Whether a dotted address has four octets up to 255 and the port is one."""
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    return ip.rlike(rf"^{octet}(\.{octet}){{3}}$") & port.between(1, 65535)


def bearer_token(header: Column) -> Column:
    """The token of an ``Authorization: Bearer`` header, else null."""
    parts = F.split(F.trim(header), r"\s+")
    return F.when((F.size(parts) == 2) & (parts[0] == "Bearer"), parts[1])


def token_state(requests: DataFrame, now: Column, renew_s: int = 3600) -> DataFrame:
    """The state of each request (id, header, expires_at) at ``now``, in epoch seconds: ``missing`` without a bearer token,
    ``expired``, ``renewed`` where the token ends within ``renew_s`` seconds, else ``valid``; a token without an end is expired."""
    token = bearer_token(F.col("header"))
    live = F.coalesce(F.col("expires_at") >= now, F.lit(False))
    state = F.when(token.isNull(), "missing").when(~live, "expired").when(F.col("expires_at") < now + renew_s, "renewed").otherwise("valid")
    return requests.select("id", token.alias("token"), state.alias("state"))
