"""What the operators share: reading tables, written intermediate tables, word splitting, names of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.tables import new_folder, shared_dir, table, written

__all__ = ["SPACES", "free", "new_folder", "one_space", "partitions", "shared_dir", "table", "written"]

#: The white space of the contracts: space and the code points 9 to 13.
SPACES = " \t\n\v\f\r"


def free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes for docs to have no such column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def one_space(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null counts as empty.

    Byte searches do the common work; the regular expression runs only over texts that hold a run.
    """
    flat = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " +", " ")).otherwise(flat)


def partitions(spark: SparkSession) -> int:
    """The number of partitions that the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
