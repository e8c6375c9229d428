import pytest

from tessella.operators import kinds


def test_kinds_pass_columns_through_and_fail_early(spark):
    kinds.registered(spark)
    spark.sql("SELECT 7 AS id, array(1, 2, 3, 4, 5, 6) AS gray, 2 AS height, 3 AS width, 'x' AS note UNION ALL SELECT 8, null, 2, 3, null").createOrReplaceTempView("shown")
    coded = spark.sql("SELECT * FROM run_kind('encode_image', TABLE(shown))")
    assert coded.columns == ["id", "note", "image"]
    coded.createOrReplaceTempView("coded")
    rows = spark.sql("SELECT * FROM run_kind('decode_image_batch', TABLE(coded)) ORDER BY id").collect()
    assert [tuple(r) for r in rows] == [(7, "x", 2, 3, 3, 63), (8, None, None, None, None, None)]
    assert spark.sql("SELECT * FROM run_kind('encode_image', TABLE(SELECT * FROM shown WHERE id = 9))").count() == 0
    w = spark.sql("SELECT * FROM run_kind('generate_weight_map', TABLE(SELECT 1 AS id, 8 AS tile_size, 2 AS overlap))").collect()
    assert len(w) == 64 and max(r["weight"] for r in w) == pytest.approx(1) and min(r["weight"] for r in w) == 0
    for text, why in (("run_kind('paint', TABLE(shown))", "unknown kind 'paint'"), ("run_kind('decode_image_batch', TABLE(shown))", "needs the columns image"), ("run_kind('encode_image', 5)", "must be a table")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM {text}").collect()
