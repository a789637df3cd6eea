"""Delimited inputs, result tables and their provenance."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _first_line(spark: SparkSession, path: str) -> DataFrame:
    """(value): the first line of the first file of a path, by name; of the files only the list is read."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").agg(F.min("path")).first()[0]
    if files is None:
        raise ValueError(f"no file with content at {path}")
    return spark.read.text(files).limit(1)


def matrix_header(spark: SparkSession, path: str) -> DataFrame:
    """(position, gene) from the first line alone; position follows file order, from 0."""
    return (_first_line(spark, path).select(F.posexplode(F.split("value", "\t")).alias("position", "gene")).filter("position > 0")
            .withColumn("position", F.col("position") - 1))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(item, cells) of a wide tab-separated matrix as text, so that no plan has a column per gene.

    The path may hold several files; the header stands in the first one by name, and a line that repeats it is a header too.
    """
    head = _first_line(spark, path).scalar()
    parts = F.split("value", "\t", -1)
    return spark.read.text(path).filter(F.col("value") != head).select(parts[0].alias("item"), F.slice(parts, 2, F.size(parts)).alias("cells"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(accession, qualifier, term, evidence, aspect) of an annotation file; '!' lines are comments.

    A gzip file is one split: its rows are spread out after reading.
    """
    cols = [f"c{i}" for i in range(17)]
    raw = spark.read.option("sep", "\t").option("comment", "!").option("quote", "").schema(", ".join(f"{c} string" for c in cols)).csv(path)
    rows = raw.select(F.col("c1").alias("accession"), F.coalesce("c3", F.lit("")).alias("qualifier"), F.col("c4").alias("term"),
                      F.col("c6").alias("evidence"), F.col("c8").alias("aspect"))
    return rows.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else rows


def _gene_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def read_idmap(spark: SparkSession, path: str) -> DataFrame:
    """(gene, accession) from an id file whose accessions are separated by '|'."""
    rows = _gene_file(spark, path).filter(F.col("ensembl_gene_id").isNotNull() & F.col("uniprot_ids").isNotNull())
    return (rows.select(F.col("ensembl_gene_id").alias("gene"), F.explode(F.split("uniprot_ids", "[|]")).alias("accession"))
            .withColumn("accession", F.trim("accession")).filter("accession <> ''").distinct())


def read_gene_names(spark: SparkSession, path: str) -> DataFrame:
    """(gene, symbol, aliases, family): aliases from alias and previous symbols, family the first group."""
    names = F.split(F.concat_ws("|", "alias_symbol", "prev_symbol"), "[|]")
    return _gene_file(spark, path).filter(F.col("ensembl_gene_id").isNotNull()).select(
        F.col("ensembl_gene_id").alias("gene"), "symbol",
        F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "").alias("aliases"),
        F.split("gene_group", "[|]")[0].alias("family"))


def read_gene_list(spark: SparkSession, path: str, split: str | None = None, stratum: str | None = None) -> DataFrame:
    """Rows of a gene list, optionally of one split and stratum."""
    rows = _gene_file(spark, path)
    for name, value in (("split", split), ("stratum", stratum)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def content_hash(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, sha256) of each row's content, so that no file is ever one value."""
    return rows.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def table_hash(df: DataFrame) -> DataFrame:
    """One hash of a table's rows, whatever their order or partitioning: the sum of 60 bits of each row's md5, with the row count.

    A row's text is its columns in order of name, each as its length in characters, a colon and its text, null as a bare minus, so that no two
    different rows give the same text. Equal rows add up, so that repeated rows change the hash.
    """
    def field(c: str) -> Column:
        v = F.col(f"`{c}`").cast("string")
        return F.when(v.isNull(), "-").otherwise(F.concat(F.length(v).cast("string"), F.lit(":"), v))
    text = F.concat(F.lit(""), *[field(c) for c in sorted(df.columns)])
    bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.sum(bits).cast("decimal(38,0)").cast("string").alias("hash"), F.count("*").alias("n"))


def write_keyed(df: DataFrame, path: str, key: dict) -> None:
    """Write a table next to a one-row provenance table that names the configuration it was built from."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(key, sort_keys=True),)], "key string").write.mode("overwrite").parquet(f"{path}/provenance")


def read_keyed(spark: SparkSession, path: str, key: dict) -> DataFrame:
    """Read such a table; a different configuration is refused."""
    have, want = spark.read.parquet(f"{path}/provenance").first()["key"], json.dumps(key, sort_keys=True)
    if have != want:
        raise ValueError(f"table at {path} is stale: built with {have}, this configuration is {want}")
    return spark.read.parquet(f"{path}/data")


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    """Write named result tables, such as tested terms, runs, predictions and invalid answers."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_results(spark: SparkSession, path: str, name: str, optional: bool = False) -> DataFrame | None:
    """Read one result table; a missing optional table gives None."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(f"{path}/{name}")
    except AnalysisException:
        if optional:
            return None
        raise


def significant_view(terms: DataFrame) -> DataFrame:
    return terms.filter("significant")


def finished_view(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'COMPLETED' AND current_code")
