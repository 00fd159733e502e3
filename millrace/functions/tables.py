"""Table functions that SQL can call, next to the tables of its FROM list."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register(spark: SparkSession) -> None:
    """Make ``json_pairs(text)`` known to SQL: one row (key, value) per field of a JSON object.

    ``SELECT ... FROM events, LATERAL json_pairs(props)`` gives each event its
    own rows. Values that are no text come as JSON. A null, a text that is no
    JSON and JSON that is no object give no row.
    """
    class JsonPairs:
        def eval(self, text: str):
            try:
                fields = json.loads(text) if text else None
            except ValueError:
                fields = None
            for key, value in fields.items() if isinstance(fields, dict) else ():
                yield key, value if isinstance(value, str) else json.dumps(value)

    spark.udtf.register("json_pairs", udtf(JsonPairs, returnType="key STRING, value STRING", useArrow=True))
