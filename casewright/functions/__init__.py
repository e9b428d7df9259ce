"""Scalar functions of evidence work, as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Clocks: name, ticks per second, seconds from 1970 to their zero (fixed values).
CLOCKS = (
    ("unix_s", 1, 0), ("unix_ms", 1_000, 0), ("unix_us", 1_000_000, 0), ("unix_ns", 1_000_000_000, 0),
    ("filetime", 10_000_000, -11_644_473_600), ("webkit", 1_000_000, -11_644_473_600),
    ("apple_s", 1, 978_307_200), ("apple_ns", 1_000_000_000, 978_307_200), ("hfs", 1, -2_082_844_800),
)


def clock_micros(value: Column, ticks: int, zero: int) -> Column:
    """Microseconds since 1970 of an exact count of ticks; whole numbers throughout."""
    v = value.cast("decimal(38,0)")
    scaled = F.floor(v * (1_000_000 // ticks)) if ticks <= 1_000_000 else F.floor(v / (ticks // 1_000_000))
    return (scaled + F.lit(zero).cast("decimal(38,0)") * 1_000_000).cast("decimal(38,0)")


def epoch_candidates(value: Column, lo_us: int = 0, hi_us: int = 4_102_444_800_000_000) -> Column:
    """Array of (clock, micros, plausible): every reading, none of them chosen."""
    rows = []
    for name, ticks, zero in CLOCKS:
        us = clock_micros(value, ticks, zero)
        rows.append(F.struct(F.lit(name).alias("clock"), us.alias("micros"), us.between(lo_us, hi_us).alias("plausible")))
    return F.array(*rows)


def dos_datetime(word: Column) -> Column:
    """A packed FAT date (high 16 bits) and time; null where the calendar has no such instant."""
    d, t = F.shiftright(word, 16), word.bitwiseAND(F.lit(0xFFFF))
    part = lambda x, s, m: F.shiftright(x, s).bitwiseAND(F.lit(m)).cast("int")
    made = F.try_make_timestamp(part(d, 9, 127) + 1980, part(d, 5, 15), part(d, 0, 31), part(t, 11, 31), part(t, 5, 63), part(t, 0, 31) * 2)
    return F.when(part(t, 0, 31) < 30, made)  # Spark takes second 60 for the next minute


def ole_micros(days: Column) -> Column:
    """OLE days to microseconds since 1970; the fraction of a negative day runs forward."""
    whole = F.when(days >= 0, F.floor(days)).otherwise(F.ceil(days))
    return F.rint((whole + F.abs(days - whole) - 25569) * 86_400_000_000).cast("long")


def to_utc(raw: Column, assume_utc: bool = False) -> Column:
    """Struct (micros, basis): an offset or Z is honoured; without one the time is null unless UTC is assumed, and says so."""
    zoned = raw.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    t = F.unix_micros(F.try_to_timestamp(raw))
    basis = F.when(t.isNull(), "invalid").when(zoned, "stated").otherwise("assumed" if assume_utc else "none")
    return F.struct(F.when(zoned | F.lit(assume_utc), t).alias("micros"), basis.alias("basis"))


def bit_flags(value: Column, names: Sequence[str]) -> Column:
    """Names of the set bits, lowest first."""
    return F.filter(F.array(*(F.when(value.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names))), lambda x: x.isNotNull())


def rot13(col: Column) -> Column:
    a, b = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(col, a + b, a[13:] + a[:13] + b[13:] + b[:13])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ancestors(path: Column) -> Column:
    """Every directory above a path, the highest first."""
    p = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: F.array_join(F.slice(p, 1, i), "/"))


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def window_entropy(df: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """``(id, window, bits)``: bits per character of each window of ``width`` characters; the last may be shorter."""
    windows = df.select(id_col, F.posexplode(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))).alias("window", "t"))
    chars = windows.select(id_col, "window", F.explode(F.split("t", "")).alias("c")).where("c <> ''").groupBy(id_col, "window", "c").agg(F.count("*").cast("double").alias("n"))
    # with sums of n and n log n, no second pass over the counts is needed
    sums = chars.groupBy(id_col, "window").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(id_col, "window", (F.log2("t") - F.col("s") / F.col("t")).alias("bits"))


def human_bytes(n: Column) -> Column:
    """Of two as near the even tenth, as C prints them."""
    tenth = lambda x: F.bround(x.cast("decimal(38,10)"), 1).cast("double")
    return F.when(n >= 1 << 20, F.format_string("%.1f MB", tenth(n / (1 << 20)))).when(n >= 1 << 10, F.format_string("%.1f KB", tenth(n / (1 << 10)))).otherwise(F.format_string("%d B", n.cast("long")))


def sanitise(col: Column) -> Column:
    """Control characters become a full stop; nothing is cut."""
    return F.regexp_replace(col, r"[\x00-\x1F\x7F]", ".")


def csv_safe(col: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(col.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), col)).otherwise(col)


def canonical_digest(entries: Column) -> Column:
    """SHA-256 of a map as JSON with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries)))), 256)


#: White space between the words of a command line; a vertical tab is part of a word.
BLANK = r"[\t\n\f\r ]"
_WORD = r"[^\t\n\f\r ]"


def first_word(text: Column) -> Column:
    """The first word of a text, past white space of any kind; empty if there is none."""
    return F.regexp_extract(text, f"^{BLANK}*({_WORD}+)", 1)


def leading_command(line: Column) -> Column:
    """The program a command line starts: past assignments and sudo, without its directory; empty if a directory is all there is.

    What is passed is not taken back, or a line that ends in a directory would yield a part of that.
    """
    return F.regexp_extract(line, f"^{BLANK}*+(?:[A-Za-z_]+={_WORD}*{BLANK}+)*+(?:sudo{BLANK}+(?={_WORD}))?+(?:{_WORD}*/)?+({_WORD}+)", 1)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value worked out once: an expression that is used in many branches would be worked out in each."""
    return F.get(F.transform(F.array(value), f), 0)


def _ipv4(addr: Column) -> Column:
    """The number of an IPv4 address in dotted form, else null."""
    octet = lambda p, i: F.get(p, i).cast("long")
    fits = addr.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(fits, _let(F.split(addr, r"\."), lambda p: octet(p, 0) * (1 << 24) + octet(p, 1) * (1 << 16) + octet(p, 2) * (1 << 8) + octet(p, 3)))


#: Address blocks that are not public (fixed values): first address as a number, prefix length, class.
IPV4_BLOCKS = (
    (0x00000000, 8, "reserved"), (0x0A000000, 8, "private"), (0x64400000, 10, "shared"), (0x7F000000, 8, "loopback"), (0xA9FE0000, 16, "link_local"), (0xAC100000, 12, "private"), (0xC0A80000, 16, "private"),
    (0xC0000200, 24, "documentation"), (0xC6120000, 15, "reserved"), (0xC6336400, 24, "documentation"), (0xCB007100, 24, "documentation"), (0xE0000000, 4, "multicast"), (0xF0000000, 4, "reserved"),
)


def address_class(addr: Column) -> Column:
    """``private, loopback, link_local, shared, documentation, multicast, reserved`` or ``public``; ``invalid`` if it is no address; null for null. IPv6 by its prefix, an IPv4 address in one by itself."""
    return _let(F.lower(F.trim(addr)), lambda low: _let(_ipv4(F.regexp_replace(low, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", "$1")), lambda number: _class_of(low, number)))


def _class_of(low: Column, number: Column) -> Column:
    v4 = F.coalesce(*(F.when(F.shiftright(number, 32 - bits) == first >> (32 - bits), name) for first, bits, name in IPV4_BLOCKS), F.lit("public"))
    six = low.rlike(r"^[0-9a-f:]+(%[0-9a-z]+)?$") & low.contains(":")
    v6 = F.when(low == "::1", "loopback").when(low == "::", "reserved").when(low.rlike("^fe[89ab][0-9a-f]:"), "link_local").when(low.rlike("^f[cd][0-9a-f]{2}:"), "private")
    v6 = v6.when(low.rlike("^ff[0-9a-f]{2}:"), "multicast").when(low.rlike("^2001:db8:"), "documentation").otherwise("public")
    return F.when(low.isNull(), None).when(number.isNotNull(), v4).when(six, v6).otherwise("invalid")


def _own(kind: Column) -> Column:
    return kind.isin("private", "shared", "loopback", "link_local")


def is_internal(addr: Column) -> Column:
    """Whether an address is of this side: private, shared, loopback or link-local."""
    return _own(address_class(addr))


def side_of(source: Column, target: Column) -> Column:
    """``internal, outbound, inbound`` or ``external``, by the classes of both ends; ``unknown`` where an end is no address."""
    known = lambda a: F.coalesce(a != "invalid", F.lit(False))
    a, b = _own(source), _own(target)
    return F.when(~known(source) | ~known(target), "unknown").when(a & b, "internal").when(a, "outbound").when(b, "inbound").otherwise("external")


def traffic_side(source: Column, target: Column) -> Column:
    """:func:`side_of` two addresses."""
    return _let(address_class(source), lambda a: _let(address_class(target), lambda b: side_of(a, b)))


def luhn(digits: Column) -> Column:
    """Whether a number passes the check-digit rule of payment cards."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, F.expr("0") + F.when(c.cast("int") >= 5, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0
