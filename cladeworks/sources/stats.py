"""Run statistics as CSV tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of the three kinds of statistics.
RUN = ("algorithm", "input_file", "output_file", "running_time_s", "max_cpu_mb", "max_gpu_mb", "exit_code")
BENCHMARK = ("alg", "num-taxa", "gene-trees", "replicate", "sb", "spmin", "spmax", "rf-rate", "running-time-s", "max-cpu-mb", "max-gpu-mb")
DISCORDANCE = ("num-taxa", "gene-trees", "replicate", "sb", "spmin", "spmax", "gt-gt", "gt-st")


def first_number(text: Column) -> Column:
    """The first unsigned number of a report; null if it has none."""
    found = F.regexp_extract(text, r"[0-9]+(\.[0-9]+)?", 0)
    return F.when(found != "", found)


def last_field(text: Column, label: str) -> Column:
    """The last field, between blanks, of the first line of a report that has ``label``; null if none has."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(label))), F.lit(0))
    return F.regexp_extract(line, r"(\S+)\s*$", 1)


def write(rows: DataFrame, path: str, columns: tuple[str, ...], mode: str = "overwrite") -> None:
    """CSV with a header and these columns in this order; a missing one is an error. mode: overwrite, append or ignore."""
    rows.select(*(f"`{c}`" for c in columns)).write.mode(mode).option("header", True).csv(path)
