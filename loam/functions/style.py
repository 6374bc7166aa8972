"""Predicates and lookups of map styles, addresses and file heads."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def allowed_url(url: Column, starts: list[str], ends: list[str]) -> Column:
    """Strict allow-list: one of the beginnings and one of the endings; null is not allowed."""
    a, b = F.lit(False), F.lit(False)
    for s in starts:
        a = a | url.startswith(s)
    for e in ends:
        b = b | url.endswith(e)
    return F.coalesce(a & b, F.lit(False))


def allowed_host(url: Column, hosts: list[str]) -> Column:
    """An https address whose host is one of these or below one."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#:]+)", 1))
    ok = host.isin(*hosts)
    for h in hosts:
        ok = ok | host.endswith("." + h)
    return F.coalesce(ok & (host != ""), F.lit(False))


def prune_rule(spec: Column) -> Column:
    """'size<N@Z', 'blank@Z' or 'blank' as struct of kind, limit and zoom; null for anything else."""
    p = r"^(?:(size)<(\d+)@(\d+)|(blank)(?:@(\d+))?)$"
    part = lambda i: F.nullif(F.regexp_extract(spec, p, i), F.lit(""))
    kind = F.coalesce(part(1), part(4))
    return F.when(spec.rlike(p), F.struct(kind.alias("kind"), part(2).cast("bigint").alias("limit"), F.coalesce(part(3), part(5)).cast("int").alias("zoom")))


def content_kind(head: Column) -> Column:
    """What the first bytes of a file say: jpeg, png, gzip, pmtiles or null."""
    h = F.hex(F.substring(head, 1, 8))
    return F.when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("89504E47"), "png").when(h.startswith("1F8B"), "gzip").when(h.startswith("504D54696C6573"), "pmtiles")


def match(x: Column, cases: dict, default) -> Column:
    """The value of the first equal case, or the default (also for null)."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(cases.items())])
    return F.coalesce(F.try_element_at(table, x), F.lit(default))


def step(x: Column, first: float, stops: list[tuple[float, float]]) -> Column:
    """The value of the last stop not above x; `first` below all."""
    out = F.lit(first)
    for at, value in stops:
        out = F.when(x >= at, value).otherwise(out)
    return out


def interpolate(x: Column, stops: list[tuple[float, float]]) -> Column:
    """Linear between stops, constant outside."""
    out = F.lit(stops[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(x < x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0)).otherwise(out)
    return F.when(x <= stops[0][0], float(stops[0][1])).otherwise(out)


def scale_bar(metres: Column) -> Column:
    """The largest 1, 2 or 5 times a power of ten that is at most so long."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(metres)))
    lead = metres / power
    return F.when(lead >= 5, 5 * power).when(lead >= 2, 2 * power).otherwise(power)


def over_white(red: Column, alpha: Column) -> Column:
    """One colour part seen over white."""
    return F.rint(red * alpha + 255 * (1 - alpha)).cast("int")


def policy(kind: Column, table: dict[str, tuple[int, int, int]]) -> Column:
    """struct of concurrency, retries and streak limit of a kind of work, by a small table."""
    out = F.lit(None).cast("struct<concurrency:int,retries:int,streak:int>")
    for name, (a, b, c) in table.items():
        out = F.when(kind == name, F.struct(F.lit(a).alias("concurrency"), F.lit(b).alias("retries"), F.lit(c).alias("streak"))).otherwise(out)
    return out
