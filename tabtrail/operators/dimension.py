"""Category dimension changes, overrides, validation and keyed upserts
(S2, S3, S4, S5, S11-S14).

The write endpoints are re-expressed as change feeds applied in bulk:

* a feed row is ``(seq, op, id, name, description, color, wellness_type,
  set_description)`` with ``op`` in create / update / delete; phases apply in that order;
* create: rejected when the name exists already or an earlier create in the feed used
  it (``name`` is unique); the new id is the row's ``id``;
* update: the target must exist after the creates; name, color and wellness_type change
  to the last *truthy* value in feed order, description to the last row whose
  ``set_description`` is true (that value may be null or ''); a row carrying no change
  is rejected ('no updates');
* delete: the first delete of an existing id wins, others are 'not found'; sessions of
  deleted categories get ``category_id = null`` (FK ON DELETE SET NULL).

Everything is anti/semi joins and keyed aggregates; no step needs a global order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM_COLS = ["id", "name", "description", "color", "wellness_type"]


def _truthy(c):
    return c.isNotNull() & (c != "")


def seed_if_absent(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """Add seed rows whose name is not present yet."""
    add = seed.join(existing.select("name"), "name", "left_anti")
    return existing.select(*DIM_COLS).unionByName(add.select(*DIM_COLS))


def list_categories(c: DataFrame) -> DataFrame:
    """S3: all categories ordered by name (distributed sort)."""
    return c.select(*DIM_COLS).orderBy("name", "id")


def _first_creates(ch: DataFrame) -> DataFrame:
    """The first create of every usable name: (name, seq, row); combined on the map side."""
    cr = ch.filter((F.col("op") == "create") & _truthy(F.col("name")))
    return cr.groupBy("name").agg(F.min(F.struct("seq", *[c for c in DIM_COLS if c != "name"])).alias("c"))


def _after_create(base: DataFrame, ch: DataFrame) -> DataFrame:
    firsts = _first_creates(ch).join(base.select("name"), "name", "left_anti")
    return base.unionByName(firsts.select(F.col("name"), *[F.col("c")[f].alias(f) for f in DIM_COLS if f != "name"]))


def _has_change():
    return (_truthy(F.col("name")) | _truthy(F.col("color")) | _truthy(F.col("wellness_type"))
            | F.coalesce(F.col("set_description"), F.lit(False)))


def _per_id(ch: DataFrame) -> DataFrame:
    """The feed's updates and deletes reduced once per id: last value of each field that an
    update sets, and the first delete."""
    update = F.col("op") == "update"
    sets = {f: update & _truthy(F.col(f)) for f in ("name", "color", "wellness_type")}
    sets["description"] = update & F.coalesce(F.col("set_description"), F.lit(False))
    return ch.filter(F.col("op").isin("update", "delete")).groupBy("id").agg(
        *[F.max_by(F.col(f), F.when(cond, F.col("seq"))).alias("_u_" + f) for f, cond in sets.items()],
        *[F.max(F.when(cond, F.lit(True))).alias("_h_" + f) for f, cond in sets.items()],
        F.min(F.when(F.col("op") == "delete", F.col("seq"))).alias("_del"))


def apply_category_changes(c: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply a change feed; returns (categories, rejected(seq, op, id, reason))."""
    ch = changes.select("seq", "op", "id", "name", "description", "color", "wellness_type",
                        "set_description")
    base = c.select(*DIM_COLS)
    created = _after_create(base, ch)
    x = created.join(_per_id(ch), "id", "left").filter(F.col("_del").isNull())
    final = x.select("id", *[F.when(F.col("_h_" + f).isNotNull(), F.col("_u_" + f)).otherwise(F.col(f)).alias(f)
                             for f in DIM_COLS[1:]])
    return final, _rejected(base, created, ch)


def _rejected(base: DataFrame, created: DataFrame, ch: DataFrame) -> DataFrame:
    cr = ch.filter(F.col("op") == "create")
    firsts = _first_creates(ch).select(F.col("name").alias("_fn"), F.col("c.seq").alias("_fseq"))
    cr = (cr.join(base.select(F.col("name").alias("_bn")), F.col("name") == F.col("_bn"), "left")
          .join(firsts, F.col("name") == F.col("_fn"), "left"))
    bad = F.col("_bn").isNotNull() | ~F.coalesce(F.col("seq") == F.col("_fseq"), F.lit(False))
    rej_create = cr.filter(bad).select(
        "seq", "op", "id", F.when(_truthy(F.col("name")), F.lit("duplicate name"))
        .otherwise(F.lit("name required")).alias("reason"))
    rest = ch.filter(F.col("op").isin("update", "delete")).join(
        created.select(F.col("id").alias("_eid")), F.col("id") == F.col("_eid"), "left")
    first_del = ch.filter(F.col("op") == "delete").groupBy("id").agg(F.min("seq").alias("_dseq"))
    rest = rest.join(first_del, "id", "left")
    absent = F.col("_eid").isNull()
    reason = (F.when(absent, F.lit("not found"))
              .when((F.col("op") == "update") & ~_has_change(), F.lit("no updates"))
              .when((F.col("op") == "delete") & (F.col("seq") != F.col("_dseq")), F.lit("not found")))
    rej_rest = rest.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        "seq", "op", "id", "reason")
    return rej_create.unionByName(rej_rest)


def deleted_ids(changes: DataFrame) -> DataFrame:
    """Ids that the feed deletes (deleting an id that does not exist changes nothing)."""
    return changes.filter(F.col("op") == "delete").select("id").distinct()


def cascade_delete(s: DataFrame, deleted: DataFrame) -> DataFrame:
    """Sessions of deleted categories lose their category (set null)."""
    d = deleted.select(F.col("id").alias("_del")).distinct()
    x = s.join(d, s["category_id"] == F.col("_del"), "left")
    return x.select(*[F.when(F.col("_del").isNotNull(), F.lit(None).cast("long"))
                      .otherwise(F.col(c)).alias(c) if c == "category_id" else F.col(c)
                      for c in s.columns])


def apply_overrides(s: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set ``category_id`` by session id (last override per id in ``seq`` order);
    returns (sessions with ``overridden`` flag, overrides whose session is missing)."""
    o = overrides.groupBy("session_id").agg(
        F.max_by("category_id", "seq").alias("_new_cat"))
    x = s.join(o, s["id"] == o["session_id"], "left")
    out = x.select(*[F.when(F.col("session_id").isNotNull(), F.col("_new_cat"))
                     .otherwise(F.col(c)).alias(c) if c == "category_id" else F.col(c)
                     for c in s.columns],
                   F.col("session_id").isNotNull().alias("overridden"))
    missing = o.join(s.select(F.col("id").alias("session_id")), "session_id", "left_anti") \
        .select("session_id", F.col("_new_cat").alias("category_id"))
    return out, missing


def validate_chunks(df: DataFrame, keys: Sequence[str] = ("id", "user_id")) -> DataFrame:
    """Flag rows whose url, duration or timestamp is falsy (null, '' or 0)."""
    miss = F.array_compact(F.array(
        F.when(~_truthy(F.col("url")), F.lit("url")),
        F.when(F.col("duration").isNull() | (F.col("duration") == 0), F.lit("duration")),
        F.when(F.col("timestamp").isNull() | (F.col("timestamp") == 0), F.lit("timestamp"))))
    bad = F.size(miss) > 0
    return df.select(*keys, F.when(bad, F.lit("rejected")).otherwise(F.lit("valid")).alias("status"),
                     F.when(bad, F.lit("Missing required fields")).alias("reason"),
                     F.when(bad, F.array_join(miss, ",")).alias("missing_fields"))


def split_valid(df: DataFrame, keys: Sequence[str] = ("id", "user_id")) -> tuple[DataFrame, DataFrame]:
    """(valid rows as they came, rejected rows with reason and missing fields)."""
    ok = (_truthy(F.col("url")) & (F.coalesce("duration", F.lit(0)) != 0)
          & (F.coalesce("timestamp", F.lit(0)) != 0))
    rejected = validate_chunks(df, keys).filter(F.col("status") == "rejected").drop("status")
    return df.filter(ok), rejected


def last_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row a key (nulls are one value): the last by ``order``, then by a hash of the row, so
    that the choice does not depend on how rows arrive. Combined before the exchange."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order, F.xxhash64(*rows.columns)))
    return rows.groupBy(*key).agg(last.alias("_last")).select("_last.*")


def upsert(current: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Keyed upsert; rows of ``new`` replace rows of ``current`` with the key. Of new rows with one
    key the last by ``order`` counts; ``new`` may have columns for that which ``current`` lacks."""
    rows = last_per_key(new, key, order).select(*current.columns)
    keys = rows.select(*[F.col(k).alias(f"_new_{k}") for k in key])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in key])
    return current.join(keys, same, "left_anti").unionByName(rows)
