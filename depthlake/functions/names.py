"""Data file names: exchange-source-dataset-start-end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEWEST = 6


def parse_file_name(name: Column) -> Column:
    """struct(exchange, dataSource, dsID, startTimestamp, endTimestamp) of a file name; fewer than six parts are an error."""
    tokens = F.split(F.regexp_replace(F.regexp_replace(name, "^.*/", ""), "\\.[^.]*$", ""), "-")
    enough = F.size(tokens) >= FEWEST
    made = F.struct(
        F.get(tokens, 0).alias("exchange"),
        F.get(tokens, 1).alias("dataSource"),
        F.array_join(F.slice(tokens, 3, F.greatest(F.size(tokens) - 4, F.lit(0))), "-").alias("dsID"),
        F.get(tokens, F.size(tokens) - 2).alias("startTimestamp"),
        F.get(tokens, F.size(tokens) - 1).alias("endTimestamp"),
    )
    kind = "struct<exchange:string,dataSource:string,dsID:string,startTimestamp:string,endTimestamp:string>"
    return F.when(enough, made).otherwise(F.raise_error(F.concat(F.lit("not a data file name: "), name)).cast(kind))


def inst_of(ds_id: Column) -> Column:
    """The instrument of a dataset id: without its depth."""
    return F.regexp_replace(ds_id, "-400$", "")
