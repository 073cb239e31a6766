"""Hand-made fixtures modelled on the reference's form placeholders (FIXTURES.md section 1)."""

from pyspark.sql import types as T

NUMBERS = T.StructType([T.StructField("column1", T.LongType()), T.StructField("column2", T.StringType()),
                        T.StructField("column3", T.StringType())])
NUMBERS_ROWS = [(99, "a", "x"), (100, "b", None), (101, None, "y"), (None, "c", "z"),
                (150, "a", "x"), (150, "a", "x"), (250, "d", "w")]

MEASURES = T.StructType([T.StructField("key1", T.StringType()), T.StructField("key2", T.StringType()),
                         T.StructField("col1", T.DoubleType()), T.StructField("col2", T.DoubleType())])
MEASURES_ROWS = [("a", "x", 1.0, 5.0), ("a", "x", 3.0, 5.0), ("a", "y", None, 5.0), ("b", "y", None, 5.0),
                 ("b", "y", None, 5.0), (None, "x", 7.0, 5.0), ("c", None, 2.0, 5.0)]

LOOKUP = T.StructType([T.StructField("key1", T.StringType()), T.StructField("key2", T.StringType()),
                       T.StructField("column1", T.StringType()), T.StructField("column2", T.StringType())])
LOOKUP_ROWS = [("a", "x", "L1", "l1"), (None, "x", "Lnull", "lnull"), ("z", "z", "Lz", "lz"),
               ("a", "x", "L1b", "l1b")]

ROUTED = T.StructType([T.StructField("id", T.LongType()), T.StructField("value", T.StringType())])
ROUTED_ROWS = [(1, "value1"), (2, "value2"), (3, "other"), (4, None), (5, "a/b"), (6, "value1"), (7, "c\\d")]

JSON_ROWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("payload", T.StringType())])
JSON_ROWS_ROWS = [(1, '{"a": 1, "b": {"c": "x", "d": [1, 2]}}'), (2, '{"a": 2}'), (3, '{"b": {"c": "y"}}'),
                  (4, None)]


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)
