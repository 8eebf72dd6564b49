"""Tables of styled document text."""

from pyspark.sql import types as T

#: One row for each glyph or run of glyphs; ord is the reading order on the page.
GLYPHS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("ord", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("font", T.StringType()), T.StructField("size", T.DoubleType()),
    T.StructField("x0", T.DoubleType()), T.StructField("top", T.DoubleType()), T.StructField("x1", T.DoubleType()), T.StructField("bottom", T.DoubleType()),
])

#: One row for each annotation; runs are its contents cut where bold begins or ends.
ANNOTATIONS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("idx", T.IntegerType()),
    T.StructField("author", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("contents", T.StringType()),
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("bold", T.BooleanType())]))),
])
