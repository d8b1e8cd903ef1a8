from __future__ import annotations

from hexlane.plans import registry


def test_no_stage_with_methods_beyond_the_jvm(spark, sf):
    """Larger methods of generated code are interpreted; the wide blocks had them."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    for name in ("main_block_5", "pack_block", "second_block"):
        registry.QUERIES[name](spark, sf)
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
        spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
