"""Append-only store of records and events: latest view, commits, history, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions.crypto import chain_link, hmac_sha256
from reportlake.functions.text import tenant_slug


def minute_of(iso: Column) -> Column:
    """ISO times with or without offset, seconds and ``T``, as comparable text to the minute."""
    return F.left(F.replace(iso, F.lit(" "), F.lit("T")), F.lit(16))


def latest(records: DataFrame, key: str = "id") -> DataFrame:
    """The newest version of every record: by ``updated``, then the longer trail, then arrival.

    Rows without key are left out; of equal rows one remains.  One aggregation, no sort:
    ``max_by`` combines on the map side, so a key with a third of the rows is no burden."""
    rank = F.struct(minute_of(F.col("updated")), F.coalesce(F.size("trail"), F.lit(-1)), F.col("arrived"))
    whole = F.struct(*records.columns)
    return records.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(whole, rank).alias("r")).select("r.*")


def commit(writes: DataFrame, keys: list[str], base: str, order: str) -> DataFrame:
    """Adds ``accepted``: of several writes on one base version the earliest wins."""
    w = Window.partitionBy(*keys, base).orderBy(order)
    return writes.withColumn("accepted", F.row_number().over(w) == 1)


def capped(rows: DataFrame, owner: list[str], order: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows of every owner."""
    w = Window.partitionBy(*owner).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no tombstone."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def imported_once(rows: DataFrame, text: str, order: str) -> DataFrame:
    """One row per content digest, the first by ``order``."""
    digest = rows.where(F.col(text).isNotNull()).withColumn("digest", F.sha1(text))
    return digest.groupBy("digest").agg(F.min(order).alias(order))


def tenants(rows: DataFrame) -> DataFrame:
    return rows.select(tenant_slug(F.col("tenant")).alias("tenant")).distinct()


def transitions(records: DataFrame) -> DataFrame:
    """``before, what, n``: steps of the trails of the newest versions."""
    steps = latest(records).select("id", F.filter("trail", lambda s: s.isNotNull()).alias("t"))
    name = lambda s: F.regexp_replace(s["what"], " via .*$", "")
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("t")),
        lambda i: F.struct(F.when(i > 1, name(F.get("t", i - 2))).otherwise("").alias("before"), name(F.get("t", i - 1)).alias("what")),
    )
    return steps.where("size(t) > 0").select(F.explode(pairs).alias("p")).groupBy("p.before", "p.what").agg(F.count(F.lit(1)).alias("n"))


def verify_chain(entries: DataFrame, chain: str, order: str, *parts: str) -> DataFrame:
    """``chain, links, intact, first_break``: every link against its recorded predecessor, per chain."""
    w = Window.partitionBy(chain).orderBy(order)
    checked = entries.withColumns(
        {
            "pos": (F.row_number().over(w) - 1).cast("bigint"),
            "ok": F.col("link") == chain_link(F.lag("link").over(w), *(F.col(p).cast("string") for p in parts)),
        }
    )
    return checked.groupBy(chain).agg(
        F.count(F.lit(1)).alias("links"), F.bool_and("ok").alias("intact"), F.min(F.when(~F.col("ok"), F.col("pos"))).alias("first_break")
    )


def chained(entries: DataFrame, chain: str, order: str, *parts: str) -> DataFrame:
    """Adds ``link``: SHA-256 over the previous link and the parts, along each chain.

    A link needs the one before it, so a chain is folded in one row; what is folded are
    digests of the parts, not the parts."""
    body = F.concat_ws("|", *(F.col(p).cast("string") for p in parts))
    rows = entries.select(chain, order, body.alias("__body"))
    whole = rows.groupBy(chain).agg(F.array_sort(F.collect_list(F.struct(order, "__body"))).alias("es"))
    start = F.array().cast("array<string>")
    links = F.aggregate("es", start, lambda acc, e: F.concat(acc, F.array(F.sha2(F.concat_ws("|", F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), e["__body"]), 256))))
    made = whole.select(chain, F.explode(F.arrays_zip("es", links.alias("links"))).alias("z")).select(chain, F.col(f"z.es.{order}").alias(order), F.col("z.links").alias("link"))
    return entries.join(made, [chain, order])


def signed_counts(entries: DataFrame, chain: str, key: bytes) -> DataFrame:
    """``chain, signed_ok, signed_bad``: signatures of links that hold under the key."""
    right = F.col("signature") == hmac_sha256(key, F.col("link"))
    given = F.coalesce(F.col("signature"), F.lit("")) != ""
    return entries.groupBy(chain).agg(F.count_if(given & right).alias("signed_ok"), F.count_if(given & ~right).alias("signed_bad"))


def checked_steps(records: DataFrame) -> DataFrame:
    """``id, pos, what, ok``: the steps of each record's trail that change its state, and
    whether the state before allows them: created, then signed, then delivered (again as
    often as wanted)."""
    steps = F.filter(F.transform("trail", lambda s: F.lower(F.regexp_replace(s["what"], " (?:via|past) .*$", ""))), lambda x: x.isin("created", "signed", "delivered"))
    rows = latest(records).select("id", F.when(F.col("trail").isNotNull(), steps).alias("t"))
    before = lambda i: F.when(i > 0, F.get("t", i - 1)).otherwise("")
    allowed = lambda x, i: F.when(x == "created", i == 0).when(x == "signed", before(i).isin("", "created")).otherwise(before(i).isin("signed", "delivered"))
    return rows.select("id", F.posexplode(F.transform("t", lambda x, i: F.struct(x.alias("what"), allowed(x, i).alias("ok")))).alias("pos", "s")).select("id", "pos", "s.*")


def allowed(users: DataFrame, roles: DataFrame, action: str, default: str = "attending") -> DataFrame:
    """``user`` of those whose role (``default`` where none is set) may do ``action``;
    ``roles``: role, action."""
    may = roles.where(F.col("action") == action).select("role").distinct()
    return users.select("user", F.coalesce("role", F.lit(default)).alias("role")).join(may, "role", "left_semi").select("user")


def kept_versions(versions: DataFrame, keys: list[str], order: str, keep: int = 10) -> DataFrame:
    """The newest version of every key and the ``keep`` before it, with ``version`` counted
    from 1."""
    up, down = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys).orderBy(F.desc(order))
    return versions.withColumns({"version": F.row_number().over(up).cast("bigint"), "__age": F.row_number().over(down)}).where(F.col("__age") <= keep + 1).drop("__age")


def copied(source: DataFrame, target: DataFrame, keys: list[str], valid: Column, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to write, tally) of a move from one store to another: invalid rows are not
    written, those whose key the target has only with ``overwrite``."""
    there = target.select(*keys).distinct().withColumn("__there", F.lit(True))
    judged = source.join(there, keys, "left").withColumn(
        "outcome", F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(F.col("__there") & ~F.lit(overwrite), "skipped").otherwise("copied")
    ).drop("__there")
    return judged.where("outcome = 'copied'").drop("outcome"), judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def with_tenant(rows: DataFrame, default: str = "default") -> DataFrame:
    """Rows of an older table with the tenant column it lacks; repeated runs change nothing."""
    return rows if "tenant" in rows.columns else rows.withColumn("tenant", F.lit(default))


def number_between(c: Column, low: float, high: float, default: float) -> Column:
    """A text as number within bounds; ``default`` for what is none (null, NaN, infinite)."""
    x = c.try_cast("double")
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, default).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def flag(c: Column, default: bool = False) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin("1", "true", "yes", "on"), True).when(word.isin("0", "false", "no", "off", ""), False).otherwise(default)


def changed_fields(stored: DataFrame, draft: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, before, after`` of the fields whose values differ, nulls included."""
    long = lambda df, name: df.select(key, F.explode(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f).cast("string"))))).alias("field", name))
    both = long(stored, "before").join(long(draft, "after"), [key, "field"])
    return both.where(~F.col("before").eqNullSafe(F.col("after")))
