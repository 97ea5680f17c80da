"""V1 syntax verdict: Python's ``json`` strictness, Arrow-batched.

Spark's Variant parser is more lenient than Python's (it accepts trailing
text after the value) and stricter on ``NaN``; the verdict, line, column and
message of a syntax error follow Python 3.13's ``json`` module, so they come
from it. Structure checks after a successful parse stay native.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# of documents that are valid for Python's json but have no Variant value
NO_STRUCTURE = "Structure not available: NaN, Infinity, nesting or size beyond the limits of a value"

SYNTAX_T = T.StructType([
    T.StructField("ok", T.BooleanType()), T.StructField("line", T.IntegerType()),
    T.StructField("col", T.IntegerType()), T.StructField("msg", T.StringType()),
])


def _verdict(text):
    if text is None:
        return (None, None, None, None)
    try:
        json.loads(text)
        return (True, None, None, None)
    except json.JSONDecodeError as e:
        return (False, e.lineno, e.colno, e.msg)
    except RecursionError:
        return (False, None, None, "maximum nesting depth exceeded")


@pandas_udf(SYNTAX_T)
def syntax_verdict(text: pd.Series) -> pd.DataFrame:
    rows = [_verdict(t) for t in text]
    return pd.DataFrame(rows, columns=["ok", "line", "col", "msg"]).astype(
        {"line": "Int32", "col": "Int32"}
    )
