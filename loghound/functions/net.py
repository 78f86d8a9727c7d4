"""IPv4 helpers (F7) and the numeric form used by range joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4_SHAPE = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def octets(ip: Column) -> Column:
    return F.transform(F.split(ip, r"\."), lambda o: o.try_cast("int"))


def is_ipv4(ip: Column) -> Column:
    """dotted quad with every octet in 0..255."""
    return F.coalesce(ip.rlike(IPV4_SHAPE) & F.forall(octets(ip), lambda o: o <= 255), F.lit(False))


def ip_to_long(ip: Column) -> Column:
    """Numeric value of a valid IPv4 address, NULL otherwise."""
    o = octets(ip)
    val = (F.try_element_at(o, F.lit(1)).cast("bigint") * 16777216 + F.try_element_at(o, F.lit(2)).cast("bigint") * 65536
           + F.try_element_at(o, F.lit(3)).cast("bigint") * 256 + F.try_element_at(o, F.lit(4)).cast("bigint"))
    return F.when(is_ipv4(ip), val)


def ip_class(ip: Column) -> Column:
    """``invalid``, ``private`` (10/8, 172.16/12, 192.168/16, 127/8,
    169.254/16, 224/8) or ``public``."""
    o = octets(ip)
    a = F.try_element_at(o, F.lit(1))
    b = F.try_element_at(o, F.lit(2))
    private = ((a == 10) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31))
               | (a == 127) | ((a == 169) & (b == 254)) | (a == 224))
    return (F.when(~is_ipv4(ip), F.lit("invalid"))
            .when(private, F.lit("private"))
            .otherwise(F.lit("public")))
