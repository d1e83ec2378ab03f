"""How often every distinct term occurs, and in how many records."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_blanks = str.maketrans(dict.fromkeys(WHITE, " "))


def name_value(name: str | None) -> str | None:
    """NFC, lower case, trimmed, every run of Unicode white space one space; null for null and blank."""
    if name is None:
        return None
    text = unicodedata.normalize("NFC", name).lower().translate(_blanks)
    return " ".join(w for w in text.split(" ") if w) or None


@F.pandas_udf(T.StringType())
def name_values(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``name_value`` over batches."""
    for batch in names:
        yield batch.map(name_value, na_action="ignore")


def term_frequencies(tokens: DataFrame, term: str, record: str, weight: str | None = None, salts: int = 1024) -> DataFrame:
    """``term``, ``occurrences`` (rows with that term, or the sum of ``weight``), ``records`` (distinct non-null ``record`` values).

    Last-seen counters: tokens are hash-partitioned by term and a salt of the record and ordered by record; each counter
    keeps occurrences, records and the record seen last, and counts a record when it differs from that one. No set of records is kept
    anywhere. The salt splits a hot term: the salts of a term hold disjoint records, so their counts add up. Rows without a record, which count no record, are
    salted by the partition that they come from.
    Null terms are left out; a null record counts as an occurrence only. An empty table gives an empty result.
    """
    spread = F.pmod(F.when(F.col(record).isNotNull(), F.xxhash64(record)).otherwise(F.spark_partition_id().cast("long")), F.lit(salts))
    cells = Window.partitionBy(term, "_salt").orderBy(F.col(record).asc_nulls_first())
    rows = tokens.where(F.col(term).isNotNull()).select(F.col(term), F.col(record), spread.alias("_salt"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    new = F.col(record).isNotNull() & ~F.col(record).eqNullSafe(F.lag(record).over(cells))
    return rows.withColumn("_new", new.cast("long")).groupBy(term).agg(F.sum("_w").alias("occurrences"), F.sum("_new").alias("records"))


def marked_names(records: DataFrame, rare: int = 1, common: float = 0.1) -> DataFrame:
    """``name_value``, ``n_records``, ``n_papers``, ``mark`` over current registry records.

    mark: ``rare`` = exactly ``rare`` distinct papers, ``common`` = more than the share ``common`` of all distinct papers, else null; of both, ``rare``
    is given only where the name isn't common. Null and blank names are left out,
    yet their papers count among all papers.
    """
    papers = F.when(F.size("paper_ids") > 0, F.col("paper_ids")).otherwise(F.array(F.lit(None).cast("int")))
    rows = records.select(name_values("canonical_name").alias("name_value"), F.posexplode(papers).alias("_at", "paper_id")).withColumn("_first", (F.col("_at") == 0).cast("long"))
    counted = term_frequencies(rows, "name_value", "paper_id", "_first").withColumnsRenamed({"occurrences": "n_records", "records": "n_papers"})
    total = records.select(F.explode("paper_ids").alias("_p")).agg(F.countDistinct("_p").alias("_all"))
    everything = counted.join(F.broadcast(total))
    mark = F.when(F.col("n_papers") > F.col("_all") * common, "common").when(F.col("n_papers") == rare, "rare")
    return everything.select("name_value", "n_records", "n_papers", mark.alias("mark"))
