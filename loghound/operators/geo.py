"""Country of a client by a range join with a table of address blocks.

The user gives the blocks (start, end, code) and, if wanted, the names of the
codes; nothing is looked up over the network.  Addresses become texts of hex
digits (8 for IPv4, 32 for IPv6) with their family in front, so one order and
one prefix rule serve both.

The range join is an equality join on prefixes.  A block goes to the one
bucket that is the longest common prefix (of a fixed list of lengths) of its
ends; what sticks out over whole sub-buckets at either end goes one level
deeper.  An address looks into one bucket of each length.  Buckets of short
prefixes hold few blocks and may be asked by very many addresses, so these
are dealt over ``SALT`` parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import ip_class, ip_to_long

# --- fixed values: labels of clients without a country ---
PRIVATE_LABEL = "プライベートIP"
UNKNOWN_LABEL = "不明"
# --- end of fixed values ---

#: Prefix lengths of the buckets, in hex digits behind the family mark.
LEVELS = {"4": [0, 2, 4, 6], "6": [0, 4, 8, 12, 16, 24]}
DIGITS = {"4": 8, "6": 32}
#: Parts of a bucket whose prefix is at most this long.
SALT, SALTED_UP_TO = 16, 2


def _v6_digits(ip: Column) -> Column:
    """32 hex digits of an IPv6 address, NULL if it is none; ``::`` and a dotted tail are understood."""
    tail = F.regexp_extract(ip, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    as_hex = F.lower(F.lpad(F.hex(ip_to_long(tail)), 8, "0"))
    text = F.when(tail == "", F.lower(ip)).otherwise(F.concat(
        F.regexp_replace(F.lower(ip), r"\d+\.\d+\.\d+\.\d+$", ""), F.substring(as_hex, 1, 4), F.lit(":"),
        F.substring(as_hex, 5, 4)))
    halves = F.split(text, "::", -1)

    def groups(part: Column) -> Column:
        return F.filter(F.split(F.coalesce(part, F.lit("")), ":", -1), lambda g: g != "")

    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    missing = F.lit(8) - F.size(left) - F.size(right)
    zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
    plain = ~text.contains("::")
    good = (text.rlike(r"^[0-9a-f]{1,4}(:[0-9a-f]{1,4}){7}$") & plain) | (
        text.rlike(r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$") & (missing >= 1))
    padded = F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0"))
    return F.when(good, F.array_join(padded, ""))


def address_key(ip: Column) -> Column:
    """Family mark and hex digits of an address: a text that sorts like the address; NULL if invalid."""
    v4 = F.lower(F.lpad(F.hex(ip_to_long(ip)), 8, "0"))
    return F.when(ip.contains(":"), F.concat(F.lit("6"), _v6_digits(ip))).otherwise(F.concat(F.lit("4"), v4))


def is_private(ip: Column, key: Column) -> Column:
    """F7, and for IPv6 the loopback address, fc00::/7 and fe80::/10."""
    v6 = (key == "6" + "0" * 31 + "1") | key.rlike("^6f[cd]") | key.rlike("^6fe[89ab]")
    return F.when(key.startswith("6"), v6).otherwise(ip_class(ip) == "private")


def _at_level(key: Column, level: Column) -> Column:
    return F.substring(key, F.lit(1), level + 1)


def _common_level(start: Column, end: Column) -> Column:
    """The longest prefix length of the list on which both ends agree."""
    out = F.lit(0)
    for level in sorted({n for v in LEVELS.values() for n in v}):
        families = [f for f, v in LEVELS.items() if level in v]
        out = F.when(F.substring(start, 1, 1).isin(*families)
                     & (F.substring(start, 1, level + 1) == F.substring(end, 1, level + 1)), F.lit(level)).otherwise(out)
    return out


def block_buckets(blocks: DataFrame) -> DataFrame:
    """(prefix, part, low, high, start, end, code): every block in the buckets of its pieces.

    Blocks with an invalid address, ends of two families or a start behind
    their end are left out.
    """
    keyed = blocks.select(address_key(F.col("start_ip")).alias("start"), address_key(F.col("end_ip")).alias("end"),
                          F.col("code").cast("string").alias("code"))
    keyed = keyed.filter((F.substring("start", 1, 1) == F.substring("end", 1, 1)) & (F.col("start") <= F.col("end")))
    start, end = F.col("start"), F.col("end")
    family = F.substring(start, 1, 1)
    digits = F.when(family == "4", DIGITS["4"]).otherwise(DIGITS["6"])
    table = F.when(family == "4", F.array(*map(F.lit, LEVELS["4"]))).otherwise(F.array(*map(F.lit, LEVELS["6"])))
    level = F.col("level")
    deeper = F.element_at(F.filter(table, lambda n: n > level), 1)
    lev = keyed.withColumn("level", _common_level(start, end)).withColumn("digits", digits).withColumn(
        "deeper", F.when(F.size(F.filter(table, lambda n: n > level)) > 0, deeper))
    # the ends of the sub-buckets that hold the two ends of the block
    first = _at_level(start, F.col("deeper"))
    last = _at_level(end, F.col("deeper"))
    first_end = F.rpad(first, F.col("digits") + 1, F.lit("f"))
    last_start = F.rpad(last, F.col("digits") + 1, F.lit("0"))

    def piece(low, high, where):
        return F.when(where, F.struct(low.alias("low"), high.alias("high")))

    inner = F.col("deeper").isNotNull() & (first < last)

    def number(prefix):  # of a sub-bucket within its bucket: at most eight digits
        return F.conv(F.substring(prefix, level + 2, F.col("deeper") - level), 16, 10).cast("long")

    # sub-buckets that lie whole between the two: only then a piece stays in the bucket itself
    between = inner & (number(last) - number(first) > 1)
    pieces = F.array_compact(F.array(
        piece(start, F.when(inner, first_end).otherwise(end), F.lit(True)),
        piece(first_end, last_start, between),
        piece(last_start, end, inner)))
    out = (lev.select("start", "end", "code", F.explode(pieces).alias("p"))
           .select("start", "end", "code", F.col("p.low").alias("low"), F.col("p.high").alias("high")))
    out = out.withColumn("level", _common_level(F.col("low"), F.col("high")))
    parts = F.when(F.col("level") <= SALTED_UP_TO, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    return out.select(_at_level(F.col("low"), F.col("level")).alias("prefix"), F.explode(parts).alias("part"),
                      "low", "high", "start", "end", "code")


def ip_country(ips: DataFrame, blocks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(ip, country) of every different address in the column ``ip``.

    ``blocks`` has start_ip, end_ip, code; ``names`` code, name.  Of several
    blocks around an address the one that starts last counts, of these the
    one that ends first (for nested blocks: the smallest), then the least
    code.  A code without a name stands for itself.  Private addresses are
    PRIVATE_LABEL; invalid ones and those in no block UNKNOWN_LABEL.
    """
    one = ips.select("ip").where("ip IS NOT NULL").distinct().withColumn("key", address_key(F.col("ip")))
    family = F.substring("key", 1, 1)
    part = F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int")
    looks = [(f, n) for f, v in LEVELS.items() for n in v]
    probe = one.filter(F.col("key").isNotNull()).select("ip", "key", F.explode(F.array_compact(F.array(*[
        F.when(family == f, F.struct(F.substring("key", 1, n + 1).alias("prefix"),
                                     (part if n <= SALTED_UP_TO else F.lit(0)).alias("part")))
        for f, n in looks]))).alias("b")).select("ip", "key", "b.prefix", "b.part")
    flipped = F.translate("start", "0123456789abcdef", "fedcba9876543210")
    best = (probe.join(block_buckets(blocks), ["prefix", "part"])
            .filter((F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high")))
            .groupBy("ip").agg(F.min(F.struct(flipped.alias("s"), F.col("end").alias("e"), F.col("code").alias("code"))).alias("b"))
            .select("ip", F.col("b.code").alias("code")))
    found = one.join(best, "ip", "left")
    if names is not None:
        table = names.select(F.col("code").cast("string").alias("code"), F.col("name").alias("_name")).groupBy("code").agg(
            F.min("_name").alias("_name"))
        found = found.join(table, "code", "left").withColumn("code", F.coalesce("_name", "code"))
    private = F.coalesce(is_private(F.col("ip"), F.col("key")), F.lit(False))
    return found.select("ip", F.when(private, F.lit(PRIVATE_LABEL)).otherwise(
        F.coalesce(F.col("code"), F.lit(UNKNOWN_LABEL))).alias("country"))

