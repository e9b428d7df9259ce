"""Projections, filters and predicates over evidence rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def match_any(df: DataFrame, cols: Sequence[str], patterns: Sequence[str], regex: bool = False, ci: bool = True) -> DataFrame:
    """Rows in which a column matches a pattern; ``matched`` lists the patterns in the given order."""

    def hit(p: str) -> Column:
        body = p if regex else re.escape(p)
        return any_of([F.coalesce(F.col(c).rlike(("(?i)" if ci else "") + body), F.lit(False)) for c in cols])

    found = F.filter(F.array(*(F.when(hit(p), F.lit(p)) for p in patterns)), lambda x: x.isNotNull())
    return df.withColumn("matched", found).where(F.size("matched") > 0)


def search(df: DataFrame, col: str, pattern: str, order: Sequence[str], exclude: str | None = None, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """A page of the rows that match and are not excluded, and a row with the count of all of them."""
    hits = df.where(F.col(col).rlike(pattern))
    if exclude:
        hits = hits.where(~F.col(col).rlike(exclude))
    return hits.orderBy(*order).offset(offset).limit(limit), hits.agg(F.count("*").alias("matched"))


def filter_events(df: DataFrame, id_col: str, ids: Sequence, ts: str, time_prefix: str, contains: str) -> DataFrame:
    """Event ids, a prefix of the time as text, and a text anywhere in the record."""
    record = F.lower(F.to_json(F.struct(*df.columns)))
    return df.where(F.col(id_col).isin(*ids) & F.date_format(ts, "yyyy-MM-dd HH:mm:ss").startswith(time_prefix) & record.contains(contains.lower()))


def filter_files(df: DataFrame, name: str, contains: Sequence[str] = (), regex: str | None = None) -> DataFrame:
    """File rows whose name holds any of the needles, if there are any, and matches the pattern, if there is one."""
    keep = any_of([F.lower(name).contains(n.lower()) for n in contains]) if contains else F.lit(True)
    return df.where(keep & (F.col(name).rlike(regex) if regex else F.lit(True)))


def upper_bound(until: str) -> Column:
    """The instant before which a time lies that is not after ``until``: a bare date covers its whole day."""
    return F.to_timestamp(F.lit(until)) + F.expr("interval 1 day") if len(until) == 10 else F.to_timestamp(F.lit(until)) + F.expr("interval 1 microsecond")


def time_window(df: DataFrame, ts: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows from ``since`` on and not after ``until``, to the precision of ``until``."""
    keep = F.lit(True)
    if since:
        keep &= F.col(ts) >= F.to_timestamp(F.lit(since))
    if until:
        keep &= F.col(ts) < upper_bound(until)
    return df.where(keep)


def account(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``left_out``: the name of the first rule that drops a row, or null for a row that stays."""
    return df.withColumn("left_out", F.coalesce(*(F.when(cond, F.lit(name)) for name, cond in rules)))


def apply_sensitivity(df: DataFrame, mark: str, cols: Sequence[str], mode: str = "withhold", redact: Sequence[str] = ()) -> DataFrame:
    """Sensitive rows are withheld, kept or dropped; patterns are then redacted in every column named."""
    if mode not in ("withhold", "keep", "drop"):
        raise ValueError(mode)
    hidden = F.coalesce(F.col(mark).cast("boolean"), F.lit(False))
    if mode == "drop":
        df = df.where(~hidden)
    for c in cols:
        value = F.when(hidden, F.lit("[withheld]")).otherwise(F.col(c)) if mode == "withhold" else F.col(c)
        for p in redact:
            value = F.regexp_replace(value, p, "[redacted]")
        df = df.withColumn(c, value)
    return df


#: Query names whose values are credentials (fixed values).
SECRET_NAMES = ("access_token", "api_key", "auth", "key", "password", "passwd", "secret", "sig", "token")


def mask_urls(url: Column, names: Sequence[str] = SECRET_NAMES) -> Column:
    """User-info passwords, and values of credential names in query and fragment, become ``***``."""
    user = F.regexp_replace(url, r"(://[^/?#@:]*):[^/?#@]*@", "$1:***@")
    return F.regexp_replace(user, rf"([?&#](?:{'|'.join(names)})=)[^&#]*", "$1***")


def withheld_names(url: Column, names: Sequence[str] = SECRET_NAMES) -> Column:
    """What :func:`mask_urls` withholds of a url, by name, each once and in order: ``user-info`` for a password before the host."""
    user = F.when(url.rlike(r"://[^/?#@:]*:[^/?#]*@"), F.array(F.lit("user-info"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(user, F.regexp_extract_all(url, F.lit(rf"[?&#]({'|'.join(names)})=[^&#]+"), F.lit(1)))))


#: No letter, mark, digit or underscore of any script, or an end of the text; what ``\b`` takes for a letter depends on the engine.
EDGE = r"(^|[^\p{L}\p{M}\p{N}_])", r"([^\p{L}\p{M}\p{N}_]|$)"


def flag_phrases(col: Column, phrases: Sequence[str]) -> Column:
    """The phrases that a text uses as whole words, in the given order and in any case; letters of all scripts make up words."""
    return F.filter(F.array(*(F.when(col.rlike(f"(?iu){EDGE[0]}{re.escape(p)}{EDGE[1]}"), F.lit(p)) for p in phrases)), lambda x: x.isNotNull())


def refang(col: Column) -> Column:
    """Indicators as written for reading, back to what they stand for."""
    out = F.regexp_replace(F.trim(col), r"^[hH][xX][xX][pP]", "http")
    for a, b in ((r"\[\.\]", "."), (r"\(\.\)", "."), (r"\[:\]", ":"), (r"\[at\]", "@")):
        out = F.regexp_replace(out, a, b)
    return out


#: Shapes of indicators, tried in this order (fixed values).
INDICATOR_SHAPES = (
    ("sha256", r"^[0-9a-fA-F]{64}$"),
    ("sha1", r"^[0-9a-fA-F]{40}$"),
    ("md5", r"^[0-9a-fA-F]{32}$"),
    ("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://"),
    ("email", r"^[^@\s/]+@[^@\s/]+\.[a-zA-Z]+$"),
    ("ipv4", r"^[0-9]{1,3}(\.[0-9]{1,3}){3}(/[0-9]{1,2})?$"),
    ("ipv6", r"^[0-9a-fA-F]*:[0-9a-fA-F:]+(/[0-9]{1,3})?$"),
    ("path", r"^(/|[a-zA-Z]:\\|\\\\)"),
    ("domain", r"^([a-zA-Z0-9_-]+\.)+[a-zA-Z]{2,}$"),
)


def indicator_type(col: Column) -> Column:
    return F.coalesce(*(F.when(col.rlike(p), F.lit(name)) for name, p in INDICATOR_SHAPES), F.lit("untyped"))


def secret_shaped(col: Column) -> Column:
    """Text of the shape of a credential: 12 to 128 characters, no space, letters and digits both."""
    return F.coalesce((F.length(col) >= 12) & (F.length(col) <= 128) & col.rlike(r"^[A-Za-z0-9+/_=.-]+$") & col.rlike("[0-9]") & col.rlike("[A-Za-z]"), F.lit(False))


def outcome(col: Column, success: Sequence[str], failure: Sequence[str]) -> Column:
    """True, false, or null for codes that are neither, such as prompts."""
    return F.when(col.isin(*success), F.lit(True)).when(col.isin(*failure), F.lit(False))


def flag_notable(col: Column, sets: dict[str, Sequence[str]]) -> Column:
    """The first named set that an operation belongs to."""
    return F.coalesce(*(F.when(col.isin(*ops), F.lit(name)) for name, ops in sets.items()))


def matching_readers(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Names of the readers whose pattern fits a path, sorted."""
    return F.array_sort(F.filter(F.array(*(F.when(path.rlike(p), F.lit(name)) for name, p in rules)), lambda x: x.isNotNull()))
