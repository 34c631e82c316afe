"""Values set at paths of a variant."""

import json

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import paths


@pytest.mark.parametrize(("raw", "path", "value", "want"), [
    (None, "$.a.b", 1, {"a": {"b": 1}}),
    ("[1]", "$.a", "x", {"a": "x"}),
    ('{"a": 3, "z": [1, null]}', "$.a.b.c", 1, {"a": {"b": {"c": 1}}, "z": [1, None]}),
    ('{"a": 3}', "$.a[*]", 1, {"a": [1]}),
    ('{"a": 3}', "$.a[*]", [1, 2], {"a": [1, 2]}),
    ('{"a": [{"x": 1}, {"x": 2}, {"x": 3}]}', "$.a[*].y", [7, 8], {"a": [{"x": 1, "y": 7}, {"x": 2, "y": 8}, {"x": 3}]}),
    ('{"a": [{"x": 1}]}', "$.a[*].y.z", [7, 8], {"a": [{"x": 1, "y": {"z": 7}}, {"y": {"z": 8}}]}),
    ('{"it\'s": 1}', "$.it's", 2, {"it's": 2}),
])
def test_put(spark, raw, path, value, want):
    got = spark.range(1).select(F.to_json(paths.put(paths.variant(F.lit(raw).cast("string")), path, F.lit(value))).alias("v")).first().v
    assert json.loads(got) == want
