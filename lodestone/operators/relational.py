"""Keyed merges, diffs and access rules over relations.

A null key matches nothing, so its row is new, gone or kept as the operation has it; of rows that repeat a key all take part, unless an
operator says which one stays. Empty tables are empty sides; further columns pass through where the result has the input's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, digest: str, switch: str | None = None) -> DataFrame:
    """(key, change) of two snapshots: created, deleted, updated (digest differs), toggled (only the switch differs), same."""
    a = old.select(key, F.col(digest).alias("_a"), (F.col(switch) if switch else F.lit(None)).alias("_x"), F.lit(True).alias("_old"))
    b = new.select(key, F.col(digest).alias("_b"), (F.col(switch) if switch else F.lit(None)).alias("_y"), F.lit(True).alias("_new"))
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "updated").when(~F.col("_x").eqNullSafe(F.col("_y")), "toggled").otherwise("same")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def upsert(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of `rows` replace those of `base` with their key; others are added."""
    return base.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def revised(base: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """Applies (key, new_value): rev grows by one for a changed row, its enabled flag stays."""
    new = F.col("_new")
    joined = base.join(changes.select(key, F.col("new_value").alias("_new")), key, "left")
    changed = new.isNotNull() & ~new.eqNullSafe(F.col(value))
    return joined.withColumns({value: F.coalesce(new, F.col(value)), "rev": F.when(changed, F.col("rev") + 1).otherwise(F.col("rev"))}).drop("_new")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of greatest `order` of each key, as one aggregate that is combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(key, *(F.col("_b").getField(c).alias(c) for c in rest))


def without_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is there; those with a null key have none."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def ip_number(ip: Column) -> Column:
    """IPv4 as a long; null if it is not four numbers up to 255."""
    parts = F.transform(F.split(ip, r"\."), lambda p: F.when(p.rlike("^[0-9]{1,3}$"), p.cast("long")))
    ok = (F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull() & (p <= 255))
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def cidr_range(cidr: Column) -> Column:
    """struct(low, high) of an IPv4 range; null for a bad one."""
    bits = F.split_part(cidr, F.lit("/"), F.lit(2))
    n = F.when(bits.rlike("^[0-9]{1,2}$"), bits.cast("int"))
    base = ip_number(F.split_part(cidr, F.lit("/"), F.lit(1)))
    size = F.pow(F.lit(2), 32 - n).cast("long")
    low = base - base % size
    return F.when(base.isNotNull() & (n <= 32), F.struct(low.alias("low"), (low + size - 1).alias("high")))


def allowed(client: Column, acl: Column) -> Column:
    """Whether an array of ranges lets a client in: an empty list lets all in, a bad client is denied, bad ranges are skipped."""
    ip = ip_number(client)
    inside = F.exists(acl, lambda c: F.coalesce((cidr_range(c)["low"] <= ip) & (ip <= cidr_range(c)["high"]), F.lit(False)))
    return F.when(acl.isNull() | (F.size(acl) == 0), True).when(ip.isNull(), False).otherwise(inside)


def clone_tenant(rows: DataFrame, column: str, source: int, target: int) -> DataFrame:
    """Adds the source tenant's rows under the target's id."""
    return rows.unionByName(rows.where(F.col(column) == source).withColumn(column, F.lit(target).cast(rows.schema[column].dataType)))


def app_fits(app: Column, installed: list[str]) -> Column:
    """Whether a row names no app (null or blank), or an installed one."""
    return app.isNull() | (F.trim(app) == "") | app.isin(installed)


#: Folders that say a document's type, and folders of models before them.
TYPES = ("action", "plan", "qna", "cve")
MODELS = ("gpt-oss", "gpt", "llama", "general")


def without_model(path: Column) -> Column:
    return F.regexp_replace(path, f"^(?:{'|'.join(MODELS)})/", "")


def type_of_path(path: Column, default: str = "qna") -> Column:
    """The first folder of a path if it is a type, else the default; null for a null path."""
    first = F.split_part(path, F.lit("/"), F.lit(1))
    return F.when(first.isin(*TYPES), first).when(path.isNotNull(), default)


def first_kind(hits: DataFrame, key: str, kind: str, first: str) -> DataFrame:
    """Of each key the hits of the kind `first`; where it has none, all others. Keys without hits have no rows."""
    best = hits.where(F.col(kind) == first)
    return best.unionByName(hits.where(F.col(kind) != first).join(best.select(key).distinct(), key, "left_anti"))


def merged_maps(left: Column, right: Column) -> Column:
    """One map of both, right entries win; named m. A null map counts as an empty one."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(left, none), F.coalesce(right, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b).alias("m")


def edited(base: DataFrame, edits: DataFrame, key: str, vector: str, payload: str) -> DataFrame:
    """Applies edits (key, vector, payload, reembed): the payload always, the vector where `reembed` holds. Unknown keys are ignored."""
    e = edits.select(key, F.col(vector).alias("_v"), F.col(payload).alias("_p"), "reembed")
    new = F.coalesce(F.col("reembed"), F.lit(False)) & F.col("_v").isNotNull()
    return base.join(e, key, "left").withColumns({vector: F.when(new, F.col("_v")).otherwise(F.col(vector)), payload: F.coalesce("_p", payload)}).drop("_v", "_p", "reembed")
