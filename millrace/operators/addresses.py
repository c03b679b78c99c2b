"""Hosts by the addresses that they resolve to, judged against networks by an interval join.

Nothing here looks a name up: (host, address) is a table that another program fills.
"""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import host_of, unsafe_reason

# Loopback, private, link-local, reserved and multicast networks, and those of them that are public.
INNER = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
]
OPEN = ["192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]


def span(address: Column) -> Column:
    """struct(version, low, high) of an address or network, ends as hexadecimal numbers of one width; null for what is neither. A mapped address counts as the one it maps."""

    @F.arrow_udf("struct<version: int, low: string, high: string>")
    def read(column: pa.Array) -> pa.Array:
        out = []
        for text in column.to_pylist():
            try:
                net = ipaddress.ip_network((text or "").strip(), strict=False)
            except ValueError:
                out.append(None)
                continue
            low, high, version, width = int(net.network_address), int(net.broadcast_address), net.version, 8 if net.version == 4 else 32
            if version == 6 and low >> 32 == 0xFFFF and high >> 32 == 0xFFFF:
                low, high, version, width = low & 0xFFFFFFFF, high & 0xFFFFFFFF, 4, 8
            out.append({"version": version, "low": f"{low:0{width}x}", "high": f"{high:0{width}x}"})
        return pa.array(out, pa.struct([("version", pa.int32()), ("low", pa.string()), ("high", pa.string())]))

    return read(address)


def networks(spark: SparkSession) -> DataFrame:
    """(network, inner): networks that must not be reached, and exceptions from them."""
    return spark.createDataFrame([(n, True) for n in INNER] + [(n, False) for n in OPEN], "network string, inner boolean")


def judged(addresses: DataFrame, nets: DataFrame, address: str = "address") -> DataFrame:
    """Rows with `inner`: whether the narrowest network that holds the address is inner; false outside all networks, null for what is no address.

    Networks are dealt out under the first bytes that they span, and an address meets those
    under its own first byte; ends are compared as texts of one width.
    """
    first = lambda c: F.conv(F.substring(c, 1, 2), 16, 10).cast("int")
    wide = nets.select("inner", span(F.col("network")).alias("s")).where("s is not null").select("inner", "s.*")
    wide = wide.withColumn("byte", F.explode(F.sequence(first(F.col("low")), first(F.col("high")))))
    own = addresses.select(address).distinct().withColumn("s", span(F.col(address))).where("s is not null").select(address, F.col("s.version").alias("version"), F.col("s.low").alias("at"), first(F.col("s.low")).alias("byte"))
    # Of the networks that hold an address the narrowest begins last, and of those that begin together it ends first.
    hit = own.join(wide, ["version", "byte"]).where("low <= at and at <= high").groupBy(address).agg(F.max_by("inner", F.struct("low", F.translate("high", "0123456789abcdef", "fedcba9876543210"))).alias("inner"))
    known = own.select(address).join(hit, address, "left").select(address, F.coalesce("inner", F.lit(False)).alias("inner"))
    return addresses.join(known, address, "left")


def resolved_reason(urls: DataFrame, addresses: DataFrame, nets: DataFrame, url: str = "url") -> DataFrame:
    """(url, reason): why a URL must not be followed, judged by its own text, else by the addresses (host, address) of its host; null where nothing speaks against it.

    One inner address is enough; a host without any that can be read couldn't be resolved.
    Hosts that are addresses themselves are judged as they stand.
    """
    rows = urls.select(url).distinct().withColumn("reason", unsafe_reason(F.col(url))).withColumn("host", host_of(F.col(url)))
    found = judged(addresses.select(F.lower("host").alias("host"), "address"), nets).groupBy("host").agg(F.bool_or("inner").alias("inner"))
    named = ~F.col("host").rlike(r"^[0-9.]+$|:")
    out = rows.join(found, "host", "left")
    by_address = F.when(named & F.col("inner").isNull(), "host has no address").when(named & F.col("inner"), "internal or private address")
    return out.select(url, F.coalesce("reason", by_address).alias("reason"))
