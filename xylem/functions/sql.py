"""SQL functions: ``register(spark)`` adds them to a session.

``xml_texts(xml, expr)``, ``xml_strings(xml, expr)`` and ``xml_fragments(xml, expr)`` give arrays of strings for each row; ``expr`` may be a column.
``xpath_text(xml, expr)`` is the table form, one row for each text run: ``SELECT * FROM docs, LATERAL xpath_text(docs.xml, '//a')``.
``xml_decode(s)`` replaces entities. Null texts or expressions give empty arrays and no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from xylem.sources.markup import decode

from . import interp


def _many(f):
    def of(xml: pd.Series, expr: pd.Series) -> pd.Series:
        return pd.Series([f(x, e) if x is not None and e is not None else [] for x, e in zip(xml, expr)])

    return pandas_udf(of, "array<string>")


@udtf(returnType="result string")
class XPathText:
    def eval(self, xml: str, expr: str):
        if xml is not None and expr is not None:
            for text in interp.texts(xml, expr):
                yield (text,)


def register(spark: SparkSession) -> None:
    spark.udf.register("xml_texts", _many(interp.texts))
    spark.udf.register("xml_strings", _many(interp.strings))
    spark.udf.register("xml_fragments", _many(interp.raws))
    spark.udf.register("xml_decode", pandas_udf(lambda s: s.map(lambda x: None if x is None else decode(x)), "string"))
    spark.udtf.register("xpath_text", XPathText)
