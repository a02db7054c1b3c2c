"""Explicit schemas of the files that are read; nothing is inferred."""

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LONG, DOUBLE, TEXT = T.LongType(), T.DoubleType(), T.StringType()

#: Files of an interaction data set: user, item, half-star rating and epoch second; item, title and genres.
RATINGS_CSV = _schema(userId=LONG, movieId=LONG, rating=DOUBLE, timestamp=LONG)
ITEMS_CSV = _schema(movieId=LONG, title=TEXT, genres=TEXT)
