"""References to records that do not exist at the time of the reference (problem 1).

Method: a distributed left anti-join of the *distinct* foreign keys against the parent keys, joined back to the
referring rows for the rows themselves and for counts per table and period.

Shape of the plan
    1. ``refs`` is reduced to one row per key with the first and last time it is used. The reduction combines on
       the map side, so a key that holds a third of all rows costs one row per map task.
    2. Those keys are anti-joined against parent lives that cover the whole span of use. What remains is suspect;
       it splits into keys without any parent and keys whose parents lived only part of the time.
    3. Rows of absent keys are orphans. Rows of partly living keys meet one row per (key, hour) that holds the lives
       begun in that hour and the latest end of all earlier ones, a running maximum over the key's hours, so neither
       a hot key nor a burst of references within an hour is gathered into one task.
    4. Both joins back salt the referring rows by the count of the most used key; the suspect keys, unique and few, are
       repeated once per salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.catalog import clean_id, materialize, trimmed

#: References of one key that a task should have; a key with more is dealt out over as many salts as its number asks for.
ROWS_PER_SALT = 1_000_000
#: Before the key of a reference by module name; no cleaned id begins with it.
MODULE = "\x01"
FOREVER = "9999-12-31 00:00:00"


def edge_references(edges: DataFrame) -> DataFrame:
    """One row per edge with a target: (ref_table, ref_id, scope, key, at). Edges without a target refer to nothing."""
    return edges.where("target_id is not null").select(
        F.lit("edges").alias("ref_table"),
        F.col("edge_id").alias("ref_id"),
        F.col("repository_id").alias("scope"),
        clean_id("target_id").alias("key"),
        F.col("observed_at").alias("at"),
    )


def import_target():
    """Module an import names: ``module``, or for a relative one the importing module less ``level`` parts plus ``module``."""
    parts = F.split(trimmed("module_name"), r"\.")
    level = F.coalesce(F.col("level"), F.lit(0))
    keep = F.greatest(F.size(parts) - level, F.lit(0))
    base = F.array_join(F.slice(parts, F.lit(1), keep), ".")
    module = trimmed("module")
    relative = F.coalesce(F.col("is_relative"), level > 0)
    return F.when(~relative | F.col("module_name").isNull(), module).otherwise(
        F.when(base == "", module).otherwise(F.concat_ws(".", base, module))
    )


def import_references(imports: DataFrame, external_modules: DataFrame) -> DataFrame:
    """One row per import with a module, without absolute imports of external roots.

    ``external_modules`` is a dimension of module roots; it joins by equality, and Spark decides by its size
    whether it is broadcast.
    """
    relative = F.coalesce(F.col("is_relative"), F.coalesce(F.col("level"), F.lit(0)) > 0)
    named = imports.where("module is not null").select(
        F.lit("imports").alias("ref_table"),
        F.col("import_id").alias("ref_id"),
        F.col("repository_id").alias("scope"),
        import_target().alias("key"),
        F.col("observed_at").alias("at"),
        F.when(~relative, F.element_at(F.split(trimmed("module"), r"\."), 1)).alias("root"),
    )
    roots = external_modules.select(trimmed("module_root").alias("root")).where("root is not null").distinct()
    return named.join(roots, "root", "left_anti").drop("root")


def node_lives(nodes: DataFrame, key) -> DataFrame:
    """Distinct lives (scope, key, born, gone); an open end is far in the future. Repeated deliveries collapse."""
    return (
        nodes.select(
            F.col("repository_id").alias("scope"),
            key.alias("key"),
            F.col("first_seen_at").alias("born"),
            F.coalesce(F.col("deleted_at"), F.lit(FOREVER).cast(nodes.schema["first_seen_at"].dataType)).alias("gone"),
        )
        .where("key is not null and scope is not null and born is not null and born < gone")
        .distinct()
    )


def orphan_references(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """Rows of ``refs`` (ref_table, ref_id, scope, key, at) without a life of (scope, key) at ``at``.

    A null ``at`` or ``scope`` matches no life, so such a row is an orphan; a null key refers to nothing and is
    left out; repeated rows stay rows of their own; empty inputs give an empty result (no refs) or all refs (no lives).
    """
    k = ["scope", "key"]
    refs = refs.where("key is not null")
    odd = refs.where("scope is null or at is null")
    refs = refs.where("scope is not null and at is not null")
    lives = materialize(lives, "lives")
    used = materialize(refs.groupBy(*k).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n")), "used-keys")
    salts = max(1, -(-(used.agg(F.max("n")).first()[0] or 0) // ROWS_PER_SALT))
    u, p = used.alias("u"), lives.alias("p")
    same = (F.col("u.scope") == F.col("p.scope")) & (F.col("u.key") == F.col("p.key"))
    covering = (F.col("p.born") <= F.col("u.first_at")) & (F.col("p.gone") > F.col("u.last_at"))
    suspect = materialize(u.join(p, same & covering, "left_anti").select(*k), "suspect-keys")
    some = lives.join(suspect, k, "left_semi")
    known = some.select(*k).distinct().withColumn("known", F.lit(True))
    salted = suspect.join(known, k, "left").select(*k, F.coalesce("known", F.lit(False)).alias("known")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hit = refs.withColumn("salt", _salt(salts)).join(salted, [*k, "salt"]).drop("salt")
    hit = materialize(hit, "suspect-refs")
    absent = hit.where("not known").drop("known")
    return absent.unionByName(_dead_at(hit.where("known").drop("known"), some, salts)).unionByName(odd)


def _salt(salts: int):
    return F.pmod(F.xxhash64("ref_table", "ref_id"), F.lit(salts)).cast("int")


def _dead_at(refs: DataFrame, lives: DataFrame, salts: int) -> DataFrame:
    """Rows of ``refs`` at whose time the latest end of all lives begun so far has passed.

    Lives are few against references. Per (key, hour) there is one row: the latest end of lives begun in earlier hours, carried
    by a running maximum over the key's hours, and the lives begun in that hour. References meet it by an equi-join with
    salt, so no window holds them, however many of one key fall into one hour.
    """
    k = ["scope", "key", "hour"]
    begun = lives.select("scope", "key", F.date_trunc("hour", "born").alias("hour"), "born", "gone")
    hours = refs.select("scope", "key", F.date_trunc("hour", "at").alias("hour")).distinct()
    per_hour = begun.groupBy(*k).agg(F.max("gone").alias("top"), F.collect_list(F.struct("born", "gone")).alias("begun"))
    before = Window.partitionBy("scope", "key").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    known = hours.join(per_hour, k, "full_outer").select(*k, "begun", F.max("top").over(before).alias("carried"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    seen = refs.withColumn("hour", F.date_trunc("hour", "at")).withColumn("salt", _salt(salts)).join(known, [*k, "salt"])
    inside = F.array_max(F.transform(F.filter("begun", lambda x: x["born"] <= F.col("at")), lambda x: x["gone"]))
    until = F.greatest(inside, F.col("carried"))
    return seen.where(until.isNull() | (until <= F.col("at"))).select("ref_table", "ref_id", "scope", "key", "at")


def all_references(edges: DataFrame, imports: DataFrame, external_modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    return edge_references(edges), import_references(imports, external_modules)


def orphans(edges: DataFrame, imports: DataFrame, external_modules: DataFrame, nodes: DataFrame) -> DataFrame:
    """Orphaned edges and imports: (ref_table, ref_id, scope, key, at).

    Both kinds go through one set of joins. Imports name modules by name, edges name nodes by id, so the keys of imports
    get a mark of their own; a Module node lives under both its id and its name.
    """
    e, i = all_references(edges, imports, external_modules)
    mark = F.lit(MODULE)
    refs = e.unionByName(i.withColumn("key", F.concat(mark, "key")))
    names = node_lives(nodes.where("label = 'Module'"), F.concat(mark, trimmed("name")))
    out = orphan_references(refs, node_lives(nodes, clean_id("id")).unionByName(names))
    return out.withColumn("key", F.regexp_replace("key", "^" + MODULE, ""))


def orphan_report(refs: DataFrame, found: DataFrame) -> DataFrame:
    """Orphans and references per table and month of the reference: (ref_table, period, n_refs, n_orphans).

    Both sides are counted on their own and joined as counts, so no row-sized join is repeated.
    """
    period = F.date_format("at", "yyyy-MM").alias("period")
    total = refs.groupBy("ref_table", period).agg(F.count(F.lit(1)).alias("n_refs"))
    lost = found.groupBy("ref_table", period).agg(F.count(F.lit(1)).alias("n_orphans"))
    null_safe = (total.ref_table == lost.ref_table) & total.period.eqNullSafe(lost.period)
    return total.join(lost, null_safe, "left").select(
        total.ref_table, total.period, "n_refs", F.coalesce("n_orphans", F.lit(0)).cast("bigint").alias("n_orphans")
    )
