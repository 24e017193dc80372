"""Category change feed, cascade, overrides, validation and keyed upserts."""

from tabtrail.operators import dimension as dm
from tabtrail.sources.tables import seed_categories

CH = ("seq long, op string, id long, name string, description string, color string, "
      "wellness_type string, set_description boolean")


def test_change_feed(spark):
    c = seed_categories(spark)
    ch = spark.createDataFrame([
        (1, "create", 100, "Reading", "Books", "#123456", "growth", None),
        (2, "create", 101, "Reading", "dup", "#000000", "growth", None),     # duplicate name
        (3, "create", 102, "Learning", "x", "#000000", "growth", None),     # existing name
        (4, "update", 1, None, None, "#AAAAAA", None, False),
        (5, "update", 1, "", "", "", "", True),                             # clears description
        (6, "update", 100, "Reading list", None, None, None, False),
        (7, "update", 55, None, None, "#BBBBBB", None, False),              # not found
        (8, "update", 2, None, None, None, None, False),                    # nothing to change
        (9, "delete", 6, None, None, None, None, None),
        (10, "delete", 6, None, None, None, None, None),                    # already gone
    ], CH)
    final, rejected = dm.apply_category_changes(c, ch)
    f = {r.id: r for r in final.collect()}
    assert 6 not in f and 100 in f and 101 not in f
    assert (f[1].color, f[1].description) == ("#AAAAAA", "")
    assert f[100].name == "Reading list" and f[100].description == "Books"
    rej = sorted((r.seq, r.reason) for r in rejected.collect())
    assert rej == [(2, "duplicate name"), (3, "duplicate name"), (7, "not found"),
                   (8, "no updates"), (10, "not found")]
    s = spark.createDataFrame([(1, 6), (2, 1), (3, None)], "id long, category_id long")
    out = {r.id: r.category_id for r in dm.cascade_delete(s, dm.deleted_ids(ch)).collect()}
    assert out == {1: None, 2: 1, 3: None}


def test_overrides_validation_upsert(spark):
    s = spark.createDataFrame([(1, "u", 10, 5, 2), (2, "", 0, 0, None)],
                              "id long, url string, duration long, timestamp long, category_id long")
    o = spark.createDataFrame([(1, 1, 7), (2, 1, 8), (3, 9, 1)], "seq long, session_id long, category_id long")
    got, missing = dm.apply_overrides(s, o)
    assert {r.id: (r.category_id, r.overridden) for r in got.collect()} == {1: (8, True), 2: (None, False)}
    assert [r.session_id for r in missing.collect()] == [9]
    v = {r.id: (r.status, r.missing_fields) for r in
         dm.validate_chunks(s.withColumn("user_id", s.id)).collect()}
    assert v == {1: ("valid", None), 2: ("rejected", "url,duration,timestamp")}
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "user_id long, date string, v long")
    new = spark.createDataFrame([(1, "b", 20), (1, "c", 30)], "user_id long, date string, v long")
    assert sorted(tuple(r) for r in dm.upsert(old, new, ["user_id", "date"]).collect()) == \
        [(1, "a", 1), (1, "b", 20), (1, "c", 30)]
    seeded = dm.seed_if_absent(spark.createDataFrame(
        [(50, "Learning", None, None, None)], "id long, name string, description string, "
        "color string, wellness_type string"), seed_categories(spark))
    assert seeded.count() == 8 and seeded.filter("name = 'Learning'").first().id == 50
