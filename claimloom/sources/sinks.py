"""Writers: keyed tables, partitioned chunks, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.lineage import cut
from claimloom.operators.upsert import new_rows, split_parsed, upsert


def _exists(rows: DataFrame, path: str) -> bool:
    spark = rows.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_upsert(incoming: DataFrame, path: str, key: str, order: str) -> None:
    """Overlay a stored parquet table with the last incoming row of each key. The union is written to the checkpoint folder before the table is replaced, as it reads what it replaces."""
    stored = incoming.sparkSession.read.parquet(path) if _exists(incoming, path) else incoming.limit(0)
    cut(upsert(stored, incoming, key, order)).write.mode("overwrite").parquet(path)


def append_new(incoming: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key is not stored yet; repeated keys within the input are appended once."""
    fresh = incoming.dropDuplicates([key])
    if _exists(incoming, path):
        fresh = new_rows(fresh, incoming.sparkSession.read.parquet(path), key)
    fresh.write.mode("append").parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks in folders by paper, a few files each."""
    chunks.repartition("paper_id").sortWithinPartitions("paper_id", "chunk_idx").write.mode("overwrite").partitionBy("paper_id").parquet(path)


def write_parsed(rows: DataFrame, parsed: str, path: str, quarantine: str) -> None:
    """Rows that parsed to one folder, the others, with their raw text, to another."""
    good, bad = split_parsed(rows, parsed)
    good.write.mode("append").parquet(path)
    bad.write.mode("append").json(quarantine)


def append_part(rows: DataFrame, path: str, part: int) -> None:
    """Records of one part of a run appended under ``path``/part=<n>; readers see all parts as one table with the column part."""
    rows.withColumn("part", F.lit(part)).write.mode("append").partitionBy("part").parquet(path)


def write_structures(rows: DataFrame, path: str) -> None:
    """Structure lines (paper_id, pos, line) of each pass (column ``kind``: raw, corrected) as text, a file for each paper and kind under kind=<k>/paper_id=<n>."""
    joined = rows.groupBy("kind", "paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("value"))
    joined.write.mode("overwrite").partitionBy("kind", "paper_id").text(path)


def timing_lines(calls: DataFrame) -> DataFrame:
    """``paper_id``, ``report``: the timed calls (paper_id, nth, section, seconds) of each paper as a table in text."""
    row = F.concat(F.lit("| "), F.col("nth").cast("string"), F.lit(" | "), F.col("section"), F.lit(" | "), F.format_number("seconds", 1), F.lit(" |"))
    papers = calls.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", row.alias("row")))), lambda x: x["row"]), "\n").alias("_rows"), F.sum("seconds").alias("_all"))
    head = F.concat(F.lit("## Paper "), F.col("paper_id").cast("string"), F.lit(": "), F.format_number("_all", 1), F.lit(" s\n\n| # | Section | Seconds |\n| :--- | :--- | :--- |\n"))
    return papers.select("paper_id", F.concat(head, "_rows", F.lit("\n")).alias("report"))


def write_items(items: DataFrame, path: str, kind: str) -> None:
    """Tables or figures of papers as JSON, in folders by kind and paper; papers written before are replaced."""
    rows = items.withColumn("kind", F.lit(kind))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "paper_id").json(path)


def write_evaluation(scored: DataFrame, path: str) -> None:
    """Judged answers as JSON, a folder for each system; a system's earlier result is replaced."""
    scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("system").json(path)


def write_vectors(fresh: DataFrame, path: str, version: int) -> None:
    """Vectors written back beside the table they belong to: a version of its own for each run, never inside a query. ``current_vectors`` reads the latest of each key.

    A version that is written again, as after a failure, replaces itself.
    """
    fresh.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def current_vectors(rows: DataFrame, key: str) -> DataFrame:
    """The latest version of each key's vector."""
    columns = [c for c in rows.columns if c not in (key, "version")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "version").alias("_v")).select(key, "_v.*")
