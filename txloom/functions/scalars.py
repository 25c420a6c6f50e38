"""Column builders: hashes, byte order, keys, compact sizes, backoff, and validity of urls and addresses.

Binary values are handled as lowercase hex where their bytes must be cut or turned round: reverse() on BINARY would
turn characters, not bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TXID = r"\A[a-fA-F0-9]{64}\z"
TOKEN_LIMIT = 4096
# Hosts that are refused by name.
BLOCKED_HOSTS = ("metadata.google.internal", "metadata", "metadata.goog", "169.254.169.254", "fd00:ec2::254")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_of(b: Column | str) -> Column:
    return F.lower(F.hex(col(b)))


def sha256_hex(b: Column | str) -> Column:
    """Hex of SHA-256 over a string's UTF-8 or a binary's bytes."""
    return F.sha2(col(b).cast("binary"), 256)


def double_sha256_hex(hex_: Column | str) -> Column:
    """Hex of SHA-256 of SHA-256 over the bytes that hex_ spells."""
    return F.sha2(F.unhex(F.sha2(F.unhex(col(hex_)), 256)), 256)


def reversed_hex(hex_: Column | str, size: int | None = None) -> Column:
    """The bytes that hex_ spells, last first, in lower case. A few bytes (of a known size) are one concatenation; more are
    turned round as characters of a character set that has one for each byte."""
    h = col(hex_)
    if size is None or size > 8:
        return F.lower(F.hex(F.encode(F.reverse(F.decode(F.unhex(h), "ISO-8859-1")), "ISO-8859-1")))
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])


def little_endian_hex(n: Column | str, size: int) -> Column:
    return reversed_hex(F.lpad(F.lower(F.hex(col(n).cast("long"))), size * 2, "0"), size)


def compact_size_hex(n: Column | str) -> Column:
    """1, 3, 5 or 9 bytes: values below 253 as they are, others after a marker byte; little-endian."""
    n = col(n).cast("long")
    return (
        F.when(n < 253, little_endian_hex(n, 1))
        .when(n <= 0xFFFF, F.concat(F.lit("fd"), little_endian_hex(n, 2)))
        .when(n <= 0xFFFFFFFF, F.concat(F.lit("fe"), little_endian_hex(n, 4)))
        .otherwise(F.concat(F.lit("ff"), little_endian_hex(n, 8)))
    )


def short_hash(text: Column) -> Column:
    """The first 8 bytes of SHA-256, in hex."""
    return F.substring(sha256_hex(text), 1, 16)


def txid_set_hash(txids: Column | str) -> Column:
    return short_hash(F.array_join(F.array_sort(col(txids)), ","))


def scope_key(kind: Column | str, block: Column | str, index: Column | str, txid: Column | str, txids: Column | str) -> Column:
    """What makes a callback of its kind the same one again; seen-callbacks leave the subtree out."""
    kind, txids = col(kind), col(txids)
    return (
        F.when(kind == "BLOCK_PROCESSED", col(block))
        .when(kind == "STUMP", F.concat_ws(":", col(block), col(index).cast("string")))
        .when(F.size(txids) > 0, txid_set_hash(txids))
        .otherwise(F.coalesce(col(txid), F.lit("")))
    )


def idempotency_key(kind: Column | str, block: Column | str, index: Column | str, txid: Column | str, txids: Column | str) -> Column:
    scope = scope_key(kind, block, index, txid, txids)
    return F.when(scope != "", F.concat_ws(":", scope, col(kind))).otherwise("")


def dedup_key(scope: Column | str, url: Column | str, kind: Column | str) -> Column:
    """Null for an empty scope: such messages are never duplicates of each other."""
    return F.when(F.coalesce(col(scope), F.lit("")) != "", sha256_hex(F.concat_ws(":", col(scope), col(url), col(kind))))


def partition_key(kind: Column | str, subtree: Column | str, block: Column | str, index: Column | str, url: Column | str) -> Column:
    """Subtree, else block (with the subtree's index, unless the whole block is meant), then the url; one partition, in order."""
    some = lambda c: F.coalesce(col(c), F.lit("")) != ""
    scoped = lambda c: F.concat(c, F.lit("|"), col(url))
    return (
        F.when(some(subtree), scoped(col(subtree)))
        .when(some(block) & (col(kind) == "BLOCK_PROCESSED"), scoped(col(block)))
        .when(some(block), scoped(F.concat(col(block), F.lit("#"), F.coalesce(col(index), F.lit(0)).cast("string"))))
        .otherwise(col(url))
    )


def hash_int32(text: Column | str) -> Column:
    """The first 4 bytes of SHA-256 as a signed big-endian integer."""
    n = F.conv(F.substring(sha256_hex(text), 1, 8), 16, 10).cast("long")
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n).cast("int")


def linear_backoff(now: Column | str, base_seconds: int, retry: Column | str) -> Column:
    return col(now) + F.make_interval(secs=F.lit(base_seconds) * col(retry))


def exponential_backoff_ms(attempt: Column | str) -> Column:
    return F.least(F.lit(10_000.0), F.lit(500.0) * F.pow(F.lit(2.0), col(attempt) - 1)).cast("long")


def sibling(offset: Column | str) -> Column:
    return col(offset).bitwiseXOR(F.lit(1))


def bytes_or_none(text: Column | str) -> Column:
    """Hex if all hex and of even length, else base64."""
    t = F.trim(col(text))
    return F.when(t.rlike("^([0-9a-fA-F]{2})+$"), F.unhex(t)).otherwise(F.unbase64(t))


def size_text(n: Column | str) -> Column:
    n = col(n).cast("double")
    return F.when(n >= 1 << 30, F.format_string("%.1f GB", n / (1 << 30))).when(n >= 1 << 20, F.format_string("%.1f MB", n / (1 << 20))).when(n >= 1 << 10, F.format_string("%.1f KB", n / (1 << 10))).otherwise(F.format_string("%d B", n.cast("long")))


def json_list(text: Column | str) -> Column:
    return F.from_json(col(text), "array<string>")


def ipv4_number(host: Column | str) -> Column:
    """The address as a number, or null if host is not a dotted quad."""
    parts = F.split(col(host), r"\.")
    ok = col(host).rlike(r"\A(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}\z")
    at = lambda i: parts.getItem(i).cast("long")
    return F.when(ok, ((at(0) * 256 + at(1)) * 256 + at(2)) * 256 + at(3))


def blocked_ipv4(n: Column, allow_private: bool = False) -> Column:
    """Unspecified and multicast always; loopback, link-local and private ranges unless allowed."""
    within = lambda a, b, c, d, bits: F.shiftright(n, 32 - bits) == ((a * 256 + b) * 256 + c) * 256 + d >> 32 - bits
    always = (n == 0) | within(224, 0, 0, 0, 4)
    private = within(127, 0, 0, 0, 8) | within(169, 254, 0, 0, 16) | within(10, 0, 0, 0, 8) | within(172, 16, 0, 0, 12) | within(192, 168, 0, 0, 16)
    return always if allow_private else always | private


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable, which the optimizer does not write out at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ipv6_groups(host: Column | str) -> Column:
    """The eight 16-bit groups of an IPv6 address (without brackets; a zone is left out), or null if host is none."""

    def hexed(tail: Column) -> Column:
        return F.concat(F.lower(F.hex(F.shiftright(tail, 16))), F.lit(":"), F.lower(F.hex(tail.bitwiseAND(F.lit(0xFFFF)))))

    def whole(h: Column) -> Column:
        end = let(ipv4_number(F.regexp_extract(h, r"(\d+\.\d+\.\d+\.\d+)\z", 1)), hexed)
        return F.when(h.contains("."), F.concat(F.regexp_extract(h, r"\A(.*:)[^:]*\z", 1), end)).otherwise(h)

    def side(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":", -1))

    def joined(v: Column) -> Column:
        gap = 8 - F.size(v["a"]) - F.size(v["b"])
        return F.when(gap > 0, F.concat(v["a"], F.array_repeat(F.lit("0"), gap), v["b"]))

    def spread(halves: Column) -> Column:
        two = let(F.struct(side(F.element_at(halves, 1)).alias("a"), side(F.try_element_at(halves, F.lit(2))).alias("b")), joined)
        return F.when(F.size(halves) == 1, F.split(F.element_at(halves, 1), ":", -1)).when(F.size(halves) == 2, two)

    def numbers(g: Column) -> Column:
        good = (F.size(g) == 8) & F.forall(g, lambda x: x.rlike(r"\A[0-9a-f]{1,4}\z"))
        return F.when(good, F.transform(g, lambda x: F.conv(x, 16, 10).cast("long")))

    bare = F.regexp_replace(F.lower(col(host)), r"%.*\z", "")
    return let(let(let(bare, lambda h: F.split(whole(h), "::", -1)), spread), numbers)


def blocked_ipv6(g: Column, allow_private: bool = False) -> Column:
    """Unspecified and multicast always; loopback, link-local and unique local unless allowed; an IPv4 address that is
    mapped into IPv6 is judged as such."""
    at = lambda i: F.element_at(g, i + 1)
    zero = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
    mapped = zero(5) & (at(5) == 0xFFFF)
    always = zero(8) | (at(0) >= 0xFF00)
    private = (zero(7) & (at(7) == 1)) | (F.shiftright(at(0), 6) == 0xFE80 >> 6) | (F.shiftright(at(0), 9) == 0xFC00 >> 9)
    return F.when(mapped, blocked_ipv4(at(6) * 65536 + at(7), allow_private)).otherwise(always if allow_private else always | private)


def blocked_literal(host: Column, allow_private: bool = False) -> Column:
    """Whether an address of either family is blocked; null if host is a name."""

    def judged(bare: Column) -> Column:
        four = let(ipv4_number(bare), lambda n: F.when(n.isNotNull(), blocked_ipv4(n, allow_private)))
        six = let(ipv6_groups(bare), lambda g: F.when(g.isNotNull(), blocked_ipv6(g, allow_private)))
        return F.when(bare.contains(":"), F.coalesce(six, F.lit(True))).otherwise(four)

    return let(F.regexp_replace(host, r"\A\[|\]\z", ""), judged)


def blocked_ip(address: Column, allow_private: bool = False) -> Column:
    """The same for what must be an address; text that is none is blocked."""
    return F.coalesce(blocked_literal(F.lower(F.trim(address)), allow_private), F.lit(True))


def url_error(url: Column | str, allow_private: bool = False) -> Column:
    """Why a callback url is refused, or null. Names that need a resolver pass here."""
    def parts(u: Column) -> Column:
        part = lambda name: F.try_parse_url(u, F.lit(name))
        return F.struct(F.lower(part("PROTOCOL")).alias("scheme"), F.lower(F.trim(part("HOST"))).alias("host"), part("USERINFO").alias("user"))

    def judged(p: Column) -> Column:
        host = p["host"]
        return (
            F.when(p["scheme"].isNull() | ~p["scheme"].isin("http", "https"), "unsupported scheme")
            .when(host.isNull() | (host == ""), "missing host")
            .when(p["user"].isNotNull(), "userinfo not allowed")
            .when(F.regexp_replace(host, r"\A\[|\]\z", "").isin(*BLOCKED_HOSTS), "blocked host")
            .when(F.coalesce(blocked_literal(host, allow_private), F.lit(False)), "blocked address")
        )

    u = col(url)
    return F.when(u.isNull() | (u == ""), "empty url").otherwise(let(parts(u), judged))


def registry_key(url: Column | str) -> Column:
    return sha256_hex(url)


def stump_key(ref: Column | str) -> Column:
    """A proof's content address without the folder that stores put before it."""
    return F.regexp_replace(col(ref), "^stump/", "")


def seconds_or(text: Column | str, default: int) -> Column:
    """A duration like 90s, 1h30m, 1.5h or 250ms in seconds; the default if it is malformed or not above zero."""
    t = F.regexp_replace(col(text), "\u00b5s|\u03bcs", "us")
    part = r"(\d{1,9}(?:\.\d{1,9})?)(h|ms|m|s|us|ns)"
    numbers, units = F.regexp_extract_all(t, F.lit(part), F.lit(1)), F.regexp_extract_all(t, F.lit(part), F.lit(2))
    size = F.create_map(*[F.lit(x) for unit in (("h", 3600.0), ("m", 60.0), ("s", 1.0), ("ms", 1e-3), ("us", 1e-6), ("ns", 1e-9)) for x in unit])
    value = F.aggregate(F.zip_with(numbers, units, lambda n, u: n.cast("double") * F.element_at(size, u)), F.lit(0.0), lambda a, x: a + x)
    return F.when(t.rlike(rf"\A(?:{part})+\z") & (value > 0), value).otherwise(F.lit(float(default)))


def snippet(body: Column | str, kept: int = 4096, shown: int = 256) -> Column:
    """What a log shows of an answer: its first bytes only; a character that the cut splits becomes a replacement mark."""
    first = F.substring(F.substring(col(body).cast("binary"), 1, kept), 1, shown)
    return F.make_valid_utf8(first.cast("string"))


def root_matches(root: Column | str, want: Column | str) -> Column:
    """Equal in either byte order."""
    return (col(root) == F.lower(col(want))) | (reversed_hex(root) == F.lower(col(want)))
