"""Address columns against the fixed ranges."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.functions import urls


def public_addresses(rows: DataFrame, column: str) -> DataFrame:
    """rows plus `public`: whether an IPv4 or IPv6 address lies outside all non-public ranges; what is no address isn't public.

    Addresses are compared as hex digits of equal length, so that no number is too wide. The ranges are fixed and few: the
    range join is a broadcast one, and no pair of rows is made for public addresses.
    """
    ranges = rows.sparkSession.createDataFrame(urls.address_ranges(), "__lo string, __hi string")
    special = [ipaddress.ip_address(a).packed.hex() for a in urls.PUBLIC_IPV4]
    numbered = rows.withColumn("__n", urls.address_hex(F.col(column)))
    within = F.col("__n").between(F.col("__lo"), F.col("__hi")) & (F.length("__n") == F.length("__lo"))
    inside = numbered.join(F.broadcast(ranges), within, "left")
    public = F.col("__n").isNotNull() & (F.col("__lo").isNull() | F.col("__n").isin(*special))
    return inside.withColumn("public", public).drop("__n", "__lo", "__hi")
