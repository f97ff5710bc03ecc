"""160-bit ids as 40 hex digits, their XOR distance, node-id validation and compact codecs, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS = 5


def parse_hex(s: Column) -> Column:
    """40 hex digits in lower case, else null."""
    return F.when(s.rlike(r"^[0-9a-fA-F]{40}\z"), F.lower(s))


def parse_raw(b: Column) -> Column:
    """20 bytes as hex, else null."""
    return F.when(F.octet_length(b) == 20, F.lower(F.hex(b)))


def limb(s: Column, i: int) -> Column:
    return F.conv(F.substring(s, 1 + 8 * i, 8), 16, 10).cast("long")


def xor(a: Column, b: Column) -> Column:
    """The distance as five 32-bit numbers, most significant first; arrays order as the distances do."""
    return F.array(*(limb(a, i).bitwiseXOR(limb(b, i)) for i in range(LIMBS)))


def xor_hex(a: Column, b: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(limb(a, i).bitwiseXOR(limb(b, i))), 8, "0") for i in range(LIMBS))))


def common_prefix(a: Column, b: Column) -> Column:
    """Leading bits that agree, 160 for equal ids."""
    out = F.lit(160)
    for i in reversed(range(LIMBS)):
        x = limb(a, i).bitwiseXOR(limb(b, i))
        out = F.when(x != 0, 32 * (i + 1) - F.length(F.bin(x))).otherwise(out)
    return out.cast("int")


def _crc_table() -> list[int]:
    """Of CRC-32C, from its reflected polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


CRC_TABLE = _crc_table()


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ip_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null for anything else."""
    parts = F.transform(F.split(ip, r"\."), lambda p: p.try_cast("long"))
    number = lambda x: F.when(F.forall(x, lambda p: p < 256), F.aggregate(x, F.lit(0).cast("long"), lambda a, p: a * 256 + p))
    return F.when(ip.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}\z"), let(parts, number))


def crc32c(number: Column) -> Column:
    """Of a 32-bit number's four big-endian bytes."""
    table = F.array(*map(F.lit, CRC_TABLE)).cast("array<bigint>")
    step = lambda crc, byte: F.shiftrightunsigned(crc, 8).bitwiseXOR(F.get(table, crc.bitwiseXOR(byte).bitwiseAND(255).cast("int")))
    data = lambda n: F.array(*(F.shiftrightunsigned(n, shift).bitwiseAND(255) for shift in (24, 16, 8, 0)))
    return F.aggregate(let(number, data), F.lit(0xFFFFFFFF).cast("long"), step).bitwiseXOR(0xFFFFFFFF)


def _seed_crc(ip: Column, r: Column) -> Column:
    return crc32c(ip_number(ip).bitwiseAND(0x030F3FFF).bitwiseOR(F.shiftleft(r.cast("long"), 29)))


def derive(ip: Column, r: Column, rest: Column) -> Column:
    """The id that the address and a three-bit number give; other bits are those of ``rest``."""
    third = lambda crc: F.shiftrightunsigned(crc, 8).bitwiseAND(0xF8).bitwiseOR(F.conv(F.substring(rest, 5, 2), 16, 10).cast("long").bitwiseAND(7))
    last = F.conv(F.substring(rest, 39, 2), 16, 10).cast("long").bitwiseAND(0xF8).bitwiseOR(r.cast("long").bitwiseAND(7))
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    head = let(_seed_crc(ip, r.bitwiseAND(7)), lambda crc: F.concat(F.lpad(F.hex(F.shiftrightunsigned(crc, 16)), 4, "0"), two(third(crc))))
    return F.lower(F.concat(head, F.substring(rest, 7, 32), two(last)))


def valid_for_ip(node_id: Column, ip: Column) -> Column:
    """Whether the id's first 21 bits and last three fit the address; false if it is no IPv4 address."""
    def fits(node: Column) -> Column:
        r = F.conv(F.substring(node, 39, 2), 16, 10).cast("long").bitwiseAND(7)
        head = F.conv(F.substring(node, 1, 6), 16, 10).cast("long")
        return F.shiftrightunsigned(head, 3) == F.shiftrightunsigned(_seed_crc(ip, r), 11)

    return F.coalesce(let(node_id, fits), F.lit(False))


def _uint(b: Column, at, n: int) -> Column:
    return F.conv(F.hex(F.substring(b, at, F.lit(n)) if isinstance(at, Column) else F.substring(b, at, n)), 16, 10).cast("long")


def _address(b: Column, at) -> Column:
    sub = lambda k: at + k
    return F.struct(F.concat_ws(".", *(_uint(b, sub(k), 1).cast("string") for k in range(4))).alias("ip"), _uint(b, sub(4), 2).cast("int").alias("port"))


def decode_peers(values: Column) -> Column:
    """Peers of a list of 6-byte strings; null if any has another length."""
    return F.when(F.forall(values, lambda v: F.octet_length(v) == 6), F.transform(values, lambda v: _address(v, F.lit(1))))


def encode_peer(ip: Column, port: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(ip_number(ip)), 8, "0"), F.lpad(F.hex(port.cast("long")), 4, "0")))


def decode_nodes(b: Column) -> Column:
    """Nodes of a string of 26-byte records; null if its length is no multiple. The string is read from its row once, not once a record."""
    none = F.array().cast("array<struct<id:string,addr:struct<ip:string,port:int>>>")
    one = lambda x, i: F.struct(F.lower(F.hex(F.substring(x, i * 26 + 1, F.lit(20)))).alias("id"), _address(x, i * 26 + 21).alias("addr"))

    def nodes(x: Column) -> Column:
        n = F.floor(F.octet_length(x) / 26).cast("int")
        return F.when(F.octet_length(x) % 26 == 0, F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: one(x, i))).otherwise(none))

    return let(b, nodes)


def encode_node(node_id: Column, ip: Column, port: Column) -> Column:
    """26 bytes; null for an address that is not IPv4."""
    return F.unhex(F.concat(node_id, F.hex(encode_peer(ip, port))))


def split_samples(b: Column) -> Column:
    """The whole 20-byte ids of a string, as hex."""
    n = F.floor(F.octet_length(b) / 20).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lower(F.hex(F.substring(b, i * 20 + 1, F.lit(20)))))).otherwise(F.array().cast("array<string>"))


def node_status(age: Column, failures: Column, window, threshold: int) -> Column:
    """``age`` and ``window`` in the same unit."""
    return F.when(failures >= threshold, "bad").when((age < window) & (failures == 0), "good").otherwise("questionable")


def in_bucket(node_id: Column, low: Column, high: Column) -> Column:
    """Half open; a zero upper end is none."""
    return (node_id >= low) & ((high == "0" * 40) | (node_id < high))


def in_prefix(low: Column, depth: Column, seed: Column) -> Column:
    """An id that shares its first ``depth`` bits with ``low``, the others from a hash of ``seed``."""
    digest, out = F.sha1(seed.cast("string").cast("binary")), []
    for i in range(LIMBS):
        keep = F.least(F.greatest(depth - 32 * i, F.lit(0)), F.lit(32))
        mask = F.lit(0xFFFFFFFF).bitwiseAND(F.lit(0xFFFFFFFF) - (F.pow(F.lit(2.0), 32 - keep).cast("long") - 1))
        own = limb(low, i).bitwiseAND(mask)
        rest = limb(digest, i).bitwiseAND(F.lit(0xFFFFFFFF).bitwiseXOR(mask))
        out.append(F.lpad(F.hex(own.bitwiseOR(rest)), 8, "0"))
    return F.lower(F.concat(*out))


def clamp_interval(seconds: Column, default: int, least: int, most: int) -> Column:
    """Not positive: the default; below the least: the least; above a positive most: the most."""
    x = F.greatest(F.when(seconds <= 0, F.lit(default)).otherwise(seconds), F.lit(least))
    return F.least(x, F.lit(most)) if most > 0 else x


def shorten_interval(seconds: Column, total: Column, returned: Column, default: int) -> Column:
    """When a node has more samples than it returned, ask again within twice the default."""
    return F.when((total > returned) & (total > 0), F.least(seconds, F.lit(2 * default))).otherwise(seconds)


def jitter(node_id: Column, round_: Column, most: int) -> Column:
    """A number from 0 to below ``most`` that an id gets in a round."""
    return F.conv(F.substring(F.md5(F.concat(node_id, F.lit(":"), round_.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % most if most > 0 else F.lit(0).cast("long")


def announce_token(ip: Column, window: Column, secret: str) -> Column:
    """Four bytes (hex) that an address gets in a rotation window."""
    return F.substring(F.sha1(F.concat(ip, F.lit(":" + secret + ":"), window.cast("string")).cast("binary")), 1, 8)


def token_valid(token: Column, ip: Column, window: Column, secret: str) -> Column:
    """Of this window or the one before."""
    return (token == announce_token(ip, window, secret)) | (token == announce_token(ip, window - 1, secret))


def effective_port(implied: Column, port: Column, source_port: Column) -> Column:
    """Null where it is no port."""
    p = F.when(F.coalesce(implied, F.lit(0)) != 0, source_port).otherwise(port)
    return F.when(p.between(1, 65535), p)


def unknown_method(error: Column) -> Column:
    return F.coalesce(F.get(error, F.lit(0)).cast("int") == 204, F.lit(False))
