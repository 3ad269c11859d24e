"""Link rules: canonical form, per-channel allow list, host checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfledger import fixed_values as V

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 2)


def host(url: Column) -> Column:
    """Host name without credentials and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 4)


def has_login(url: Column) -> Column:
    return authority(url).contains("@")


def by_chain(chain: Column, values: dict[str, Column | str]) -> Column:
    """A value chosen by chain name; NULL for an unknown chain."""
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(chain == name, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def domain_of(chain: Column) -> Column:
    return by_chain(chain, {c.name: c.domain for c in V.CHAINS})


def belongs(chain: Column, url: Column) -> Column:
    """https, no credentials, and the chain's own host with or without ``www.``."""
    site = domain_of(chain)
    own = (host(url) == site) | (host(url) == F.concat(F.lit("www."), site))
    return F.coalesce((scheme(url) == "https") & ~has_login(url) & own, F.lit(False))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href``: absolute, protocol-relative, rooted, query-only or relative to the base folder."""
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
            .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
            .when(href.startswith("/"), F.concat(origin, href))
            .when(href.startswith("?"), F.concat(origin, path(base), href))
            .when(href == "", base)
            .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), href)))


def _pairs(url: Column) -> Column:
    return F.filter(F.split(query(url), "&"), lambda p: p != "")


def canonical(url: Column) -> Column:
    """Without fragment and known trackers; parameters that choose a variant stay, in order."""
    def kept(pair: Column) -> Column:
        name = F.lower(F.substring_index(pair, "=", 1))
        return ~name.startswith("utm_") & ~name.isin(V.TRACKERS)
    pairs = F.filter(_pairs(url), kept)
    normal = F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    base = F.concat(scheme(url), F.lit("://"), authority(url), path(url))
    return F.when(F.size(normal) > 0, F.concat(base, F.lit("?"), F.array_join(normal, "&"))).otherwise(base)


def channel_hosts(spark: SparkSession) -> DataFrame:
    """Allowed hosts with their channel: one row per fixed host name."""
    rows = [(h, c.slug, c.hosts[0], c.query or "") for c in V.LINK_CHANNELS for h in c.hosts]
    return spark.createDataFrame(rows, "_host string, channel string, _site string, _name string")


def with_channel_link(df: DataFrame, column: str) -> DataFrame:
    """Add ``channel`` (by host), ``link`` (normal form or NULL) and ``link_error`` (reject reason or NULL) of
    hand-entered links.  The host table is fixed and tiny, so it is broadcast."""
    url = F.trim(column)
    route = F.regexp_replace(path(url), r"/+$", "")
    rows = df.withColumn("_host", host(url)).join(F.broadcast(channel_hosts(df.sparkSession)), "_host", "left")
    rows = rows.withColumn("_route", F.when(route == "", "/").otherwise(route))
    rows = rows.withColumn("_kept", F.filter(
        _pairs(url), lambda p: (F.substring_index(p, "=", 1) == F.col("_name")) & p.rlike("^[^=]*=.")))
    route_ok = reduce(lambda rest, c: F.when(F.col("channel") == c.slug, F.col("_route").rlike("^" + c.path + "$"))
                      .otherwise(rest), V.LINK_CHANNELS, F.lit(False))
    reason = (F.when(F.length(url) > 500, "length")
              .when((scheme(url) != "https") | authority(url).rlike(r"@|:\d+$"), "scheme")
              .when(F.col("channel").isNull(), "host").when(~route_ok, "path")
              .when(F.exists("_kept", lambda p: ~p.rlike(r"^[^=]*=\d{1,20}$")), "variant"))
    base = F.concat(F.lit("https://"), F.col("_site"), F.col("_route"))
    whole = F.when(F.size("_kept") > 0, F.concat(base, F.lit("?"), F.array_join("_kept", "&"))).otherwise(base)
    return (rows.withColumn("link_error", reason).withColumn("link", F.when(F.col("link_error").isNull(), whole))
            .drop("_host", "_route", "_site", "_name", "_kept"))


def repair_path(href: Column, prefix: Column) -> Column:
    """Collapse a duplicated leading folder (``/a//a/x`` to ``/a/x``); query and fragment are dropped."""
    plain = F.regexp_extract(href, r"^([^?#]*)", 1)
    parts = F.filter(F.split(plain, "/"), lambda p: p != "")
    head = F.get(parts, 0)
    repeated = F.forall(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p == head)
    same = F.concat(F.lit("/"), head, F.lit("/")) == prefix
    return F.when((F.size(parts) >= 2) & repeated & same, F.concat(prefix, F.element_at(parts, -1))).otherwise(plain)


def with_parameter(url: Column, name: str, value: Column) -> Column:
    """Set one query parameter: replaced in place when present, else added at the end; the fragment is kept out."""
    pairs = F.filter(_pairs(url), lambda p: p.contains("=") & ~p.endswith("="))
    pair = F.concat(F.lit(name + "="), value.cast("string"))
    mine = F.exists(pairs, lambda p: F.substring_index(p, "=", 1) == name)
    replaced = F.transform(pairs, lambda p: F.when(F.substring_index(p, "=", 1) == name, pair).otherwise(p))
    final = F.when(mine, replaced).otherwise(F.array_append(pairs, pair))
    return F.concat(scheme(url), F.lit("://"), authority(url), path(url), F.lit("?"), F.array_join(final, "&"))


def pinned(chain: Column, url: Column, variant: Column) -> Column:
    """Link that opens exactly the locked variant."""
    return F.when((chain == "TGDD") & variant.isNotNull(), with_parameter(url, "code", variant)).otherwise(url)
