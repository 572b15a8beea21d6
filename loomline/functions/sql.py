"""SQL surface: the table function scan_lines and the function count_lines."""

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .classify import counts, line_records
from .languages import builtin


@udtf(returnType="line_no int, kind string, in_comment boolean, text string", useArrow=True)
class ScanLines:
    """``scan_lines(content, language)``: a row for each physical line."""

    def eval(self, content: str, language: str):
        language = builtin().get(language)
        if content is None or language is None:
            return
        for n, (kind, inside, text, _) in enumerate(line_records(content.encode("utf-8", "surrogatepass"), language), 1):
            yield n, kind, inside, text.decode("utf-8", "replace")


def register(spark: SparkSession) -> None:
    @F.pandas_udf("code long, comment long, blank long")
    def count_lines(content: pd.Series, language: pd.Series) -> pd.DataFrame:
        known = builtin()
        rows = [counts((c or "").encode(), known[name]) if name in known else (None, None, None) for c, name in zip(content, language, strict=True)]
        return pd.DataFrame(rows, columns=["code", "comment", "blank"], dtype="Int64")

    spark.udtf.register("scan_lines", ScanLines)
    spark.udf.register("count_lines", count_lines)
