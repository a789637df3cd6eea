"""File round trips: Spark writes inputs derived from the tables, the readers load them again."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.operators import matrix
from enrichspark.plans import q_compare, q_stats, q_text  # noqa: F401  their fragments
from enrichspark.plans.registry import query, rounded
from enrichspark.session import shared_dir, wide
from enrichspark.sources import ontology, reports, tables


def _path(m, name):
    return f"{shared_dir(m.spark)}/{name}-{uuid.uuid4().hex}"


def write_matrix(m):
    """Wide matrix with a row per supplier and segment and a column per nation."""
    long = m.obs.select(F.concat_ws("|", "gene", "tissue").alias("item"), "ct", "value")
    nations = m.table("nation").select(F.col("n_nationkey") + 26).orderBy("n_nationkey")
    cols = [str(r[0]) for r in nations.collect()]  # 25 header names
    cells = wide(long, m.obs.count(), "item").groupBy("item").pivot("ct", [int(c) for c in cols]).agg(F.first("value"))
    line = F.concat_ws("\t", "item", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols])
    head = m.spark.createDataFrame([("\t".join(["index"] + cols),)], "value string").coalesce(1)
    path = _path(m, "matrix")
    head.unionByName(cells.select(line.alias("value"))).write.text(path)
    return path


@query("read_matrix", """
SELECT gene AS supplier, tissue, CAST(ct AS BIGINT) ct, CAST(value AS BIGINT) AS value FROM t_obs WHERE value IS NOT NULL""")
def _(m):
    path = write_matrix(m)
    long = matrix.unpivot_matrix(tables.read_matrix(m.spark, path), tables.matrix_header(m.spark, path)).filter("value IS NOT NULL")
    supplier, tissue = matrix.parse_pair(F.col("item"))
    return rounded(long.select(supplier.cast("bigint").alias("supplier"), tissue.alias("tissue"),
                               F.col("gene").cast("bigint").alias("ct"), "value"))


@query("matrix_header", """
SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS position, CAST(n_nationkey + 26 AS VARCHAR) gene FROM nation""")
def _(m):
    return rounded(tables.matrix_header(m.spark, write_matrix(m)))


def write_obo(m):
    """Parts as stanzas: parents k div 2 and k div 3, one synonym of each of two scopes, one alternative id."""
    k = F.col("p_partkey")
    pid = lambda c: F.concat(F.lit("PT:"), F.lpad(c.cast("string"), 7, "0"))
    half, third = F.floor(k / 2), F.floor(k / 3)
    lines = F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: "), pid(k)), F.concat(F.lit("name: "), "p_name", F.lit(" "), k),
                        F.concat(F.lit("namespace: "), F.when(F.col("p_size") > 25, "biological_process").otherwise("molecular_function")),
                        F.concat(F.lit('def: "A '), "p_type", F.lit(' thing." [ref:'), k, F.lit("]")),
                        F.concat(F.lit('synonym: "'), "p_brand", F.lit(" "), k, F.lit('" EXACT []')),
                        F.concat(F.lit('synonym: "old '), "p_name", F.lit('" RELATED [x]')),
                        F.concat(F.lit("alt_id: "), pid(k + 1000000)),
                        F.when(k >= 2, F.concat(F.lit("is_a: "), pid(half), F.lit(" ! parent"))),
                        F.when(k >= 3, F.concat(F.lit("relationship: part_of "), pid(third), F.lit(" ! whole"))),
                        F.when(F.col("p_size") == 1, F.lit("is_obsolete: true")), F.lit(""))
    path = _path(m, "obo")
    m.table("part").select(lines.alias("value")).write.text(path)
    head = F.concat(F.lit("format-version: 1.2\ndata-version: releases/"), F.count("*"), F.lit("\n"))
    m.table("part").agg(head.alias("value")).write.mode("append").text(path)
    return path


@query("read_version", "SELECT 'releases/' || count(*) AS version FROM part")
def _(m):
    return ontology.read_version(m.spark, write_obo(m))


def stanzas(m):
    return ontology.read_stanzas(m.spark, write_obo(m))


PID = "'PT:' || lpad(CAST({0} AS VARCHAR), 7, '0')"


@query("read_obo_terms", f"""
SELECT {PID.format('p_partkey')} id, p_name || ' ' || p_partkey AS label, CASE WHEN p_size > 25 THEN 'biological_process' ELSE 'molecular_function' END namespace,
  'A ' || p_type || ' thing.' definition, CASE WHEN p_size = 1 THEN 'OBSOLETE' ELSE 'OK' END status FROM part""")
def _(m):
    return ontology.obo_terms(stanzas(m))


@query("read_obo_edges", f"""
SELECT {PID.format('p_partkey')} child, {PID.format('p_partkey // 2')} parent, 'is_a' rel FROM part WHERE p_partkey >= 2
UNION ALL SELECT {PID.format('p_partkey')}, {PID.format('p_partkey // 3')}, 'part_of' FROM part WHERE p_partkey >= 3""")
def _(m):
    return ontology.obo_edges(stanzas(m))


@query("read_obo_synonyms", f"""
SELECT {PID.format('p_partkey')} id, p_brand || ' ' || p_partkey AS text, 'EXACT' AS scope FROM part
UNION ALL SELECT {PID.format('p_partkey')}, 'old ' || p_name, 'RELATED' FROM part""")
def _(m):
    return ontology.obo_synonyms(stanzas(m))


@query("read_obo_alternatives", f"SELECT {PID.format('p_partkey + 1000000')} alt_id, {PID.format('p_partkey')} id FROM part")
def _(m):
    return ontology.obo_alternatives(stanzas(m))


@query("read_annotations", """
SELECT 'S' || l_suppkey accession, CASE WHEN l_tax = 0.0 THEN 'NOT|involved' ELSE '' END qualifier, 'PT:' || l_partkey AS term, l_returnflag evidence,
  CASE WHEN l_linestatus = 'F' THEN 'P' ELSE 'C' END aspect FROM lineitem""")
def _(m):
    path = _path(m, "annotations") + ".gz"
    line = F.concat_ws("\t", F.lit("DB"), F.concat(F.lit("S"), "l_suppkey"), F.lit("sym"), F.when(F.col("l_tax") == 0.0, "NOT|involved").otherwise(""),
                       F.concat(F.lit("PT:"), "l_partkey"), F.lit("ref"), F.col("l_returnflag"), F.lit(""),
                       F.when(F.col("l_linestatus") == "F", "P").otherwise("C"), *[F.lit("x")] * 8)
    rows = m.table("lineitem").select(line.alias("value"))
    m.spark.createDataFrame([("!comment",)], "value string").unionByName(rows).write.option("compression", "gzip").text(path)
    return tables.read_annotations(m.spark, path)


def write_gene_file(m):
    s = m.table("supplier")
    k = F.col("s_suppkey")
    path = _path(m, "genes")
    reports.write_delimited(s.select(
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("ENS"), k)).alias("ensembl_gene_id"), F.col("s_name").alias("symbol"),
        F.concat(F.lit("U"), k, F.lit("| V"), k, F.lit("|")).alias("uniprot_ids"),
        F.when(F.col("s_nationkey") > 5, F.concat(F.lit("A"), k, F.lit("|B"), k)).alias("alias_symbol"),
        F.concat(F.lit("old"), k).alias("prev_symbol"), F.concat(F.lit("F"), "s_nationkey", F.lit("|G")).alias("gene_group"),
        F.when(k % 2 == 0, "dev").otherwise("test").alias("split"), F.when(F.col("s_nationkey") < 12, "carrying").otherwise("not_carrying").alias("stratum")), path)
    return path


@query("read_idmap", """
SELECT 'ENS' || s_suppkey gene, unnest(['U' || s_suppkey, 'V' || s_suppkey]) accession FROM supplier WHERE s_acctbal > 0""")
def _(m):
    return tables.read_idmap(m.spark, write_gene_file(m))


@query("read_gene_names", """
SELECT 'ENS' || s_suppkey gene, s_name symbol, CASE WHEN s_nationkey > 5 THEN 'A' || s_suppkey || ',B' || s_suppkey || ',' ELSE '' END || 'old' || s_suppkey aliases,
  'F' || s_nationkey family FROM supplier WHERE s_acctbal > 0""")
def _(m):
    return tables.read_gene_names(m.spark, write_gene_file(m)).withColumn("aliases", F.array_join("aliases", ","))


@query("read_gene_list", "SELECT s_name symbol FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey < 12")
def _(m):
    return tables.read_gene_list(m.spark, write_gene_file(m), "dev", "carrying").select("symbol")


@query("keyed_baselines", "SELECT unit, CAST(term AS BIGINT) term, baseline, n_genes FROM t_baselines")
def _(m):
    """Baselines written with their key and read back; another key is refused."""
    path, key = _path(m, "baselines"), {"min_term_size": 3, "depth": 3}
    tables.write_keyed(m.baselines, path, key)
    try:
        tables.read_keyed(m.spark, path, {"min_term_size": 4, "depth": 3})
        raise AssertionError("a stale table was accepted")
    except ValueError:
        return rounded(tables.read_keyed(m.spark, path, key))


def _written(m, name: str, build) -> DataFrame | None:
    """A result table after a trip through the files of a run."""
    path = _path(m, f"results_{name}")
    tables.write_results({name: build}, path)
    assert tables.read_results(m.spark, path, "absent", optional=True) is None
    return tables.read_results(m.spark, path, name)


@query("result_tables", """
SELECT unit, gene, CAST(term AS BIGINT) term, term_size, hits intersection, round(p, 6) p, round(p_gscs, 6) p_gscs, significant FROM t_gscs
WHERE significant""")
def _(m):
    rows = tables.significant_view(_written(m, "terms", m.tested))
    return rounded(rows.select("unit", "gene", "term", "term_size", "intersection", "p", "p_gscs", "significant"))


@query("result_runs", "SELECT run_id, gene, condition, status, code_hash FROM e_runs WHERE status = 'COMPLETED' AND code_hash = 'h1'")
def _(m):
    from enrichspark.plans.q_compare import current, event_runs
    runs = tables.finished_view(_written(m, "runs", event_runs(m).withColumn("current_code", current())))
    return runs.select("run_id", "gene", "condition", "status", "code_hash")


@query("result_predictions", """
SELECT key, row_number() OVER (PARTITION BY key ORDER BY position) AS rank, id, written FROM n_resolved WHERE id IS NOT NULL AND NOT dup""")
def _(m):
    from enrichspark.plans.q_text import resolved
    rows = _written(m, "predictions", resolved(m).filter("rank IS NOT NULL").select("key", "rank", "id", "written"))
    return rows.select("key", F.col("rank").cast("bigint").alias("rank"), "id", "written")


@query("result_invalid", "SELECT key, position, written FROM n_resolved WHERE id IS NULL")
def _(m):
    from enrichspark.plans.q_text import resolved
    rows = _written(m, "invalid", resolved(m).filter("id IS NULL").select("key", "position", "written"))
    return rows.select("key", F.col("position").cast("bigint").alias("position"), "written")


@query("report_files", "SELECT condition, count(*) n FROM e_runs GROUP BY 1")
def _(m):
    """A report table through JSON and back."""
    from enrichspark.plans.q_compare import event_runs
    path = _path(m, "report")
    reports.write_json(event_runs(m).groupBy("condition").agg(F.count("*").alias("n")), path)
    return m.spark.read.schema("condition string, n bigint").json(path)


@query("report_markdown", """
WITH r AS (SELECT condition, count(*) n, avg(score) AS mean FROM e_runs GROUP BY 1)
SELECT CAST(0 AS BIGINT) line, '| condition | n | mean |' AS text UNION ALL SELECT 1, '|---|---|---|'
UNION ALL SELECT 1 + row_number() OVER (ORDER BY condition), '| ' || condition || ' | ' || n || ' | ' || printf('%.4f', mean) || ' |' FROM r""")
def _(m):
    """A small report as the lines of its Markdown."""
    from enrichspark.plans.q_compare import event_runs
    rows = event_runs(m).groupBy("condition").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).orderBy("condition")
    lines = reports.markdown(rows).splitlines()  # as many as there are conditions, refused beyond 200
    return rounded(m.spark.createDataFrame(list(enumerate(lines)), "line long, text string"))


@query("content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(m):
    return tables.content_hash(m.table("documents"), "doc_id", "text")


CENTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *CENTS, "l_returnflag", "l_linestatus", "l_shipdate")


def _field_sql(c: str) -> str:
    v = f"CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR)" if c in CENTS else f"CAST({c} AS VARCHAR)"
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE length({v}) || ':' || {v} END"


@query("table_hash", f"""
SELECT CAST(sum(CAST('0x' || substr(md5({' || '.join(_field_sql(c) for c in sorted(LINE_COLUMNS))}), 1, 15) AS BIGINT)) AS VARCHAR) AS hash, count(*) AS n FROM lineitem""")
def _(m):
    """All columns of the line items; amounts as whole hundredths, whose text is the same everywhere."""
    cents = [F.round(F.col(c) * 100).cast("long").alias(c) if c in CENTS else F.col(c) for c in LINE_COLUMNS]
    return tables.table_hash(m.table("lineitem").select(*cents))
