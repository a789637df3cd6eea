"""Text queries: documents and conversations as texts, orders as model answers, parts as named terms."""

from pyspark.sql import functions as F

from enrichspark.functions.text import normalise
from enrichspark.operators import matrix, names, sampling, text
from enrichspark.plans.q_stats import _two_factor
from enrichspark.plans.registry import query, rounded
from enrichspark.plans.sql import fragment


@query("normalise_text", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) hash FROM documents")
def _(m):
    return m.table("documents").select("doc_id", F.md5(normalise(F.col("text"))).alias("hash"))


# every document followed by a trailer built from its own source and language
DEF_SQL = """text || ' [' || upper(lang) || 'X] Known as ' || source || '-positive, ' || lang || '-negative cells. One ' || source
  || '-high cell. Examples: ' || source || '.'"""


@query("clean_definition", f"""
WITH d AS (SELECT doc_id, {DEF_SQL} AS t FROM documents),
p AS (SELECT doc_id, t, string_split(regexp_replace(trim(regexp_replace(t, '\\s?\\[[A-Z]{{2,6}}\\]', '', 'g')), '\\.\\s+', '.' || chr(1), 'g'), chr(1)) s FROM d),
c AS (SELECT doc_id, t, trim(array_to_string(list_filter(s, lambda x: len(regexp_extract_all(x,
  '(?i)\\b[\\w/]+-(?:positive|negative|high|low|bright|dim)\\b')) < 2 AND NOT regexp_matches(trim(x), '^(?i)Examples?:')), ' ')) k FROM p)
SELECT doc_id, md5(CASE WHEN k = '' THEN t ELSE k END) hash, CASE WHEN k = '' THEN 0 ELSE length(t) - length(k) END removed FROM c""")
def _(m):
    d = m.table("documents").select("doc_id", F.expr("""concat(text, ' [', upper(lang), 'X] Known as ', source, '-positive, ', lang,
      '-negative cells. One ', source, '-high cell. Examples: ', source, '.')""").alias("t"))
    return text.clean_definition(d, "t").select("doc_id", F.md5("cleaned").alias("hash"), F.col("removed").cast("bigint").alias("removed"))


@query("term_definitions", """
SELECT p_partkey id, CASE WHEN p_type = 'PROMO' THEN '(none)' ELSE p_name || ' of ' || p_brand END definition FROM part""")
def _(m):
    raw = F.when(F.col("p_type") == "PROMO", F.lit(None).cast("string")).when(
        F.col("p_type") == "ECONOMY", F.concat_ws(" of ", "p_name", "p_brand")).otherwise(
        F.concat(F.lit('"'), "p_name", F.lit(" of "), "p_brand", F.lit('" [ref:1]')))
    return m.table("part").select(F.col("p_partkey").alias("id"), text.definition_of(raw).alias("definition"))


@query("prompt_size", """
SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) tokens, round(floor(length(text) / 4) / 1000, 6) utilization,
  floor(length(text) / 4) / 1000 >= 0.98 overflow FROM documents""")
def _(m):
    tokens, share, over = text.prompt_size(F.col("text"), 1000)
    return rounded(m.table("documents").select("doc_id", tokens.alias("tokens"), share.alias("utilization"), over.alias("overflow")))


TOKENS = """list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda w: length(w) > 2 AND w NOT IN
  ('cell', 'cells', 'of', 'the', 'and', 'in', 'a', 'an', 'type', 'types', 'positive', 'negative'))"""


@query("property_overlap", f"""
SELECT conv_id, turn, round(s, 6) AS share, s >= 0.6 restates FROM (
  SELECT b.conv_id, b.turn, CASE WHEN len({TOKENS.format('b.text')}) > 0 THEN
    len(list_intersect({TOKENS.format('b.text')}, {TOKENS.format('a.text')})) / CAST(len({TOKENS.format('b.text')}) AS DOUBLE) ELSE 0 END s
  FROM conversations b JOIN conversations a ON a.conv_id = b.conv_id AND a.turn = b.turn - 1)""")
def _(m):
    c = m.table("conversations")
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("shown"))
    share, restates = text.property_overlap(F.col("text"), F.col("shown"))
    return rounded(c.join(prev, ["conv_id", "turn"]).select("conv_id", "turn", share.alias("share"), restates.alias("restates")))


@query("blinding_scan", """
WITH f AS (SELECT conv_id, lower(word) term, min(turn) since FROM (
  SELECT conv_id, turn, unnest(string_split(text, ' ')) word FROM conversations) WHERE length(word) >= 3 GROUP BY 1, 2),
h AS (SELECT c.conv_id, c.turn, term FROM conversations c JOIN f ON f.conv_id = c.conv_id AND c.turn > since
  WHERE contains(lower(text), term) AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9])\\Q' || term || '\\E($|[^A-Za-z0-9])'))
SELECT c.conv_id, c.turn, coalesce(string_agg(term, '~' ORDER BY term), '') hits, count(term) = 0 ok
FROM conversations c LEFT JOIN h ON h.conv_id = c.conv_id AND h.turn = c.turn GROUP BY 1, 2""")
def _(m):
    """Words of earlier turns that come back in a turn."""
    c = m.table("conversations")
    words = c.select("conv_id", "turn", F.explode(F.split("text", " ")).alias("term")).select("conv_id", "turn", F.lower("term").alias("term"))
    out = text.blinding_scan(c, words, ["conv_id", "turn"], 3, "turn")
    return out.select("conv_id", "turn", F.array_join(F.array_sort("hits"), "~").alias("hits"), "ok")


# -- rendering
def _resolved(m):
    return m.terms.withColumn("resolved", F.col("status") == "OK")


@query("grouped_list", """
WITH r AS (SELECT gene, tissue, o.ct, CASE WHEN status = 'OK' THEN label ELSE '(unresolved: ' || o.ct || ')' END || ' (CL id: ' || o.ct || ')' c,
  coalesce(status, 'x') <> 'OK' bad FROM t_obs o LEFT JOIN t_terms ON id = o.ct WHERE value = 1),
l AS (SELECT gene, tissue, '- ' || tissue || ' (UBERON id: ' || tissue || '): ' || string_agg(c, ', ' ORDER BY ct) line,
  count(*) FILTER (bad) n FROM r GROUP BY 1, 2)
SELECT gene, string_agg(line, chr(10) ORDER BY tissue) AS text, count(*) n_groups, CAST(sum(n) AS BIGINT) n_unresolved FROM l GROUP BY 1""")
def _(m):
    tissues = m.tissue_closed.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("label"), F.lit(True).alias("resolved"))
    return text.grouped_list(matrix.positive_items(m.obs).select("gene", "ct", "tissue"), _resolved(m), tissues)


@query("unresolved_pairs", """
SELECT gene, CAST(o.ct AS BIGINT) ct, tissue, FALSE ct_resolved, TRUE tissue_resolved FROM t_obs o LEFT JOIN t_terms ON id = o.ct
WHERE value = 1 AND coalesce(status, 'x') <> 'OK'""")
def _(m):
    tissues = m.tissue_closed.select(F.col("src").alias("id")).distinct().withColumn("resolved", F.lit(True))
    return rounded(text.unresolved_pairs(matrix.positive_items(m.obs).select("gene", "ct", "tissue"), _resolved(m), tissues))


fragment("t_chain", """
SELECT src, string_agg(CASE WHEN status = 'OK' THEN label ELSE '(unresolved: ' || anc || ')' END, ' -> ' ORDER BY depth, anc) chain
FROM t_isa3 LEFT JOIN t_terms ON id = anc WHERE depth > 0 AND depth <= 2 GROUP BY 1""")
fragment("t_blocks", """
SELECT ct id, ct || ' - ' || CASE WHEN status = 'OK' THEN label ELSE '(unresolved: ' || ct || ')' END || chr(10) || '  Definition: '
  || CASE WHEN status = 'OK' THEN definition ELSE '(no definition available)' END || chr(10) || '  Broader categories: '
  || CASE WHEN status = 'OK' AND chain IS NOT NULL THEN chain ELSE '(none found within depth 2)' END block
FROM (SELECT DISTINCT ct FROM t_obs) LEFT JOIN t_terms ON id = ct LEFT JOIN t_chain ON src = ct""")


@query("glossary", """
SELECT gene, md5(string_agg(block, chr(10) || chr(10) ORDER BY id)) hash, count(*) n_terms
FROM (SELECT DISTINCT gene, ct id FROM t_obs WHERE value = 1) JOIN t_blocks USING (id) GROUP BY 1""")
def _(m):
    used = matrix.positive_items(m.obs).select("gene", F.col("ct").alias("id"))
    blocks = text.glossary_blocks(m.obs.select(F.col("ct").alias("id")).distinct(), _resolved(m), m.isa3, 2)
    return text.glossary(used, blocks).select("gene", F.md5("glossary").alias("hash"), "n_terms")


def pct(x):
    return f"CAST(round({x} * 100) AS INT) || '%'"


def spct(x):
    return f"CASE WHEN round({x} * 100) >= 0 THEN '+' ELSE '' END || CAST(round({x} * 100) AS INT) || '%'"


@query("render_features", f"""
WITH s AS (SELECT *, round(observed - expected, 9) e FROM t_two_factor WHERE tested AND abs(observed - expected) >= 0.05),
l AS (SELECT gene, kind, term, abs(e) ae, '  ' || label || '  [observed ' || {pct('observed')} || ' vs expected ' || {pct('expected')} || ', excess '
  || {spct('e')} || ', n=' || (n_pos + n_neg) || ']' t FROM s JOIN (SELECT DISTINCT kind, term, label FROM t_features) USING (kind, term)),
k AS (SELECT gene, CASE kind WHEN 'process' THEN 0 WHEN 'lineage' THEN 1 ELSE 2 END pl, 'Enriched — ' || CASE kind
  WHEN 'process' THEN 'biological processes (what these cells do)' WHEN 'lineage' THEN 'cell lineages (what these cells are)'
  ELSE 'tissues (where these cells are)' END || ':' || chr(10) || string_agg(t, chr(10) ORDER BY round(-ae, 9), term) b FROM l GROUP BY gene, kind)
SELECT gene, string_agg(b, chr(10) || chr(10) ORDER BY pl) AS text FROM k GROUP BY 1""")
def _(m):
    labels = m.features.select("kind", "term", "label").distinct()
    rows = _two_factor(m).filter("tested").withColumn("excess", F.round("excess", 9)).filter(F.abs("excess") >= 0.05)
    return text.render_features(rows.join(labels, ["kind", "term"]), "Enriched")


@query("render_counts", """
SELECT unit, gene, string_agg(term || ' | ' || label || ' | carried by ' || size || ' | gene expressed in ' || hits || ' of them', chr(10) ORDER BY term) evidence_table
FROM t_evidence LEFT JOIN t_terms ON id = term GROUP BY 1, 2""")
def _(m):
    return text.render_counts(m.evidence, m.terms)


fragment("t_rendered", f"""
SELECT unit, gene, coalesce(string_agg(l, chr(10) ORDER BY rp, o, term) FILTER (excess >= 0), '(none)') enriched_table,
  coalesce(string_agg(l, chr(10) ORDER BY rp, o, term) FILTER (excess < 0), '(none)') depleted_table FROM (
  SELECT unit, gene, term, excess, round(p, 9) rp, -round(abs(excess), 9) o, term || ' | ' || label || ' | expressed in ' || hits || '/' || size || ' ('
    || {pct('observed')} || ') vs expected ' || {pct('expected')} || ' | excess ' || {spct('excess')} l
  FROM t_corrected LEFT JOIN t_terms ON id = term WHERE tested) GROUP BY 1, 2""")


@query("render_corrected", "SELECT * FROM t_rendered")
def _(m):
    return text.render_corrected(m.corrected, m.terms)


@query("assemble_prompts", f"""
SELECT gene, variant, md5(replace(replace(replace(template, '{{summary}}', summary), '{{enriched_table}}', enriched_table), '{{depleted_table}}', depleted_table)) hash
FROM (SELECT *, 'The gene is reliably expressed in ' || n_pos || ' of ' || n_called || ' cell types (' || {pct('n_pos / CAST(n_called AS DOUBLE)')} || ').' summary
      FROM t_rendered JOIN t_rates USING (unit, gene) WHERE unit = 'cell_types'),
  (VALUES ('true', '{{summary}}' || chr(10) || '{{enriched_table}}' || chr(10) || 'Depleted:' || chr(10) || '{{depleted_table}}'),
          ('none', 'No expression evidence is available for this gene.')) v(variant, template)""")
def _(m):
    t = m.spark.createDataFrame([("true", "{summary}\n{enriched_table}\nDepleted:\n{depleted_table}"),
                                 ("none", "No expression evidence is available for this gene.")], "variant string, template string")
    rows = (text.render_corrected(m.corrected, m.terms).join(m.rates, ["unit", "gene"]).filter("unit = 'cell_types'")
            .withColumn("summary", text.summary_line(F.col("n_pos"), F.col("n_called"), "cell types")))
    return text.assemble_prompts(rows, t, ["summary", "enriched_table", "depleted_table"]).select("gene", "variant", F.md5("prompt").alias("hash"))


fragment("t_sample_rows", "SELECT s.gene, s.index, s.ct, split_part(s.item, '|', 2) tissue FROM t_sample s")


@query("render_sample", """
SELECT gene, string_agg(index || '. ' || CASE WHEN status = 'OK' THEN label ELSE '(unresolved: ' || ct || ')' END || ' (in ' || tissue || ')',
  chr(10) ORDER BY index) AS text FROM t_sample_rows LEFT JOIN t_terms ON id = ct GROUP BY 1""")
def _(m):
    return text.render_sample(sampling.balanced_sample(m.obs, 40), _resolved(m))


@query("render_sample_grounded", """
SELECT gene, md5(string_agg(index || '. ' || CASE WHEN status = 'OK' THEN label ELSE '(unresolved: ' || ct || ')' END || ' (in ' || tissue || ')'
  || chr(10) || '     Cell type definition: ' || CASE WHEN status = 'OK' THEN definition ELSE '(no definition available)' END
  || CASE WHEN status = 'OK' AND chain IS NOT NULL THEN chr(10) || '     Broader categories: ' || chain ELSE '' END,
  chr(10) ORDER BY index)) hash FROM t_sample_rows LEFT JOIN t_terms ON id = ct LEFT JOIN t_chain ON src = ct GROUP BY 1""")
def _(m):
    chains = text.ancestor_chains(m.isa3.filter("depth <= 2"), _resolved(m))
    return text.render_sample(sampling.balanced_sample(m.obs, 40), _resolved(m), chains).select("gene", F.md5("text").alias("hash"))


# -- parsing
def event_answers(m):
    """Event properties as model answers: fenced, bare, incomplete or not JSON."""
    body = F.replace(F.col("props"), F.lit("}"), F.lit(', "hypothesis": "h", "predictions": ["a"]}'))
    kind = F.col("event_id") % 4
    return m.table("events").select("event_id", F.when(kind == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
                                    .when(kind == 1, body).when(kind == 2, F.col("props"))
                                    .otherwise(F.concat(F.lit("no json "), "props", F.lit(" {"))).alias("text"))


@query("parse_responses", """
SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN 'OK' ELSE 'FAILED_PARSE' END status,
  CASE WHEN event_id % 4 IN (0, 1) THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END k FROM events""")
def _(m):
    out = text.parse_responses(event_answers(m), ["hypothesis", "predictions"])
    return out.select("event_id", "status", F.when(F.col("status") == "OK", F.get_json_object("payload", "$.k").cast("long")).alias("k"))


@query("recognition_audit", """
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) n_ids_recognized, event_id % 3 n_examples FROM events""")
def _(m):
    k = F.get_json_object("props", "$.k")
    ex = F.transform(F.sequence(F.lit(1), (F.col("event_id") % 3).cast("int")), lambda i: F.concat(F.lit('"e'), i.cast("string"), F.lit('"')))
    ex = F.when(F.col("event_id") % 3 > 0, F.array_join(ex, ",")).otherwise("")
    p = m.table("events").select("event_id", F.concat(F.lit('{"n_ids_recognized": '), k, F.lit(', "recognized_examples": ['), ex, F.lit("]}")).alias("payload"))
    return text.recognition_audit(p).select("event_id", "n_ids_recognized", F.col("n_examples").cast("bigint").alias("n_examples"))


@query("parse_verdicts", """
SELECT l_orderkey, CAST(l_linenumber % 4 AS BIGINT) AS index, arg_max(CASE WHEN l_returnflag = 'A' THEN 'applies' ELSE 'partial' END, l_linenumber) verdict
FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_returnflag) l_returnflag FROM lineitem GROUP BY 1, 2) WHERE l_returnflag <> 'N' GROUP BY 1, 2""")
def _(m):
    li = m.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("f"))
    v = F.when(F.col("f") == "A", "applies").when(F.col("f") == "R", "partial")
    entry = F.struct("l_linenumber", F.struct((F.col("l_linenumber") % 4).alias("index"), v.alias("verdict")).alias("j"))
    packed = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.transform(
        F.array_sort(F.collect_list(entry)), lambda x: x["j"]).alias("judgments"))).alias("payload"))  # at most seven lines per order
    return text.parse_verdicts(packed, ["l_orderkey"])


# -- names
fragment("n_terms", """
SELECT p_partkey id, p_name || ' ' || p_brand || ' ' || p_partkey AS label,
  CASE WHEN p_type = 'PROMO' THEN 'molecular_function' WHEN p_type = 'STANDARD' THEN 'cellular_component' ELSE 'biological_process' END namespace FROM part""")
fragment("n_syn", """
SELECT p_partkey id, p_name || '-' || p_size || ' ' || p_brand AS text, 'EXACT' AS scope FROM part
UNION ALL SELECT p_partkey, 'old ' || p_name || ' ' || p_partkey, 'RELATED' FROM part""")
fragment("n_norm", """
SELECT DISTINCT trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS name, id, namespace FROM n_terms
UNION SELECT trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), s.id, namespace FROM n_syn s JOIN n_terms t ON t.id = s.id WHERE scope = 'EXACT'""")
fragment("n_index", """
SELECT name, min(id) id FROM n_norm WHERE namespace = 'biological_process' GROUP BY 1 HAVING count(DISTINCT id) = 1""")


def named_terms(m):
    kind = (F.when(F.col("p_type") == "PROMO", "molecular_function").when(F.col("p_type") == "STANDARD", "cellular_component")
            .otherwise("biological_process"))
    part = m.table("part")
    terms = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_partkey").alias("label"), kind.alias("namespace"))
    syn = (part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("-"), "p_size", F.lit(" "), "p_brand").alias("text"), F.lit("EXACT").alias("scope"))
           .unionByName(part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.lit("old"), "p_name", "p_partkey").alias("text"), F.lit("RELATED").alias("scope"))))
    return terms, syn


@query("name_index", "SELECT name, id FROM n_index")
def _(m):
    return names.name_index(*named_terms(m))


WRITTEN = """CASE l_linenumber % 5 WHEN 0 THEN upper(replace(label, ' ', '-')) WHEN 1 THEN p_name || '-' || p_size || ' ' || p_brand
  WHEN 2 THEN 'GO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') WHEN 3 THEN 'mystery ' || p_partkey ELSE label END"""
fragment("n_answers", f"""
SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS position, {WRITTEN} written, label
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN n_terms ON id = p_partkey""")
fragment("n_resolved", """
SELECT *, row_number() OVER (PARTITION BY key, id ORDER BY position) > 1 AND id IS NOT NULL dup FROM (
  SELECT key, position, written, CASE WHEN starts_with(written, 'GO:') THEN (SELECT t.id FROM n_terms t WHERE t.id = TRY_CAST(substr(written, 4) AS BIGINT) AND namespace = 'biological_process')
    ELSE (SELECT i.id FROM n_index i WHERE i.name = trim(regexp_replace(lower(written), '[^a-z0-9]+', ' ', 'g'))) END id FROM n_answers)""")


def order_answers(m):
    """Answers of each order as the JSON a model would return, parsed back into rows."""
    part = m.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_size")
    li = m.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct().join(part, "l_partkey")
    label = F.concat_ws(" ", "p_name", "p_brand", "l_partkey")
    n = F.col("l_linenumber") % 5
    written = (F.when(n == 0, F.upper(F.replace(label, F.lit(" "), F.lit("-")))).when(n == 1, F.concat("p_name", F.lit("-"), "p_size", F.lit(" "), "p_brand"))
               .when(n == 2, F.concat(F.lit("GO:"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")))
               .when(n == 3, F.concat(F.lit("mystery "), F.col("l_partkey").cast("string"))).otherwise(label))
    # every form an answer may take: objects with the text in several fields, and plain strings
    fields = [F.when(n == i, F.to_json(F.struct(*cols))) for i, cols in enumerate((
        (F.lit("").alias("name"), written.alias("id"), F.lit("high").alias("confidence")), (written.alias("name"), F.lit(0.5).alias("confidence")),
        (written.alias("go_id"), F.lit(1).alias("confidence")), (written.alias("term"),)))]
    quoted = F.regexp_replace(F.to_json(F.array(written)), r"^\[|\]$", "")
    entry = F.coalesce(*fields, quoted).alias("entry")
    packed = li.groupBy(F.col("l_orderkey").alias("key")).agg(F.concat(
        F.lit('{"predictions": ['),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", entry))), lambda x: x["entry"]), ", "),
        F.lit("]}")).alias("payload"))
    return names.answer_entries(packed, "key", "payload")


@query("answer_entries", """
SELECT key, position, written, CASE (SELECT any_value(l_linenumber % 5) FROM (SELECT DISTINCT l_orderkey k, l_linenumber,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 p
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)) WHERE k = key AND p = position) WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 END::DOUBLE confidence
FROM n_answers""")
def _(m):
    return rounded(order_answers(m))


def resolved(m):
    terms, syn = named_terms(m)
    process = terms.filter("namespace = 'biological_process'")
    ids = process.select(F.concat(F.lit("GO:"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("name"), "id")
    cands = m.table("part").filter("p_size <= 10").select(F.col("p_partkey").alias("id"))
    return names.resolve_predictions(order_answers(m), names.name_index(terms, syn).unionByName(ids), cands, "key")


@query("resolve_predictions", """
SELECT key, id, rank, id IN (SELECT p_partkey FROM part WHERE p_size <= 10) in_table FROM (
  SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY position) AS rank FROM n_resolved WHERE id IS NOT NULL AND NOT dup)""")
def _(m):
    return rounded(resolved(m).filter("rank IS NOT NULL").select("key", "id", "rank", "in_table"))


@query("resolution_diagnostics", """
SELECT key, count(*) n_raw, count(*) FILTER (id IS NOT NULL AND NOT dup) n_valid, count(*) FILTER (id IS NULL) n_invalid, CAST(0 AS BIGINT) n_beyond, count(*) FILTER (dup) n_duplicate,
  count(*) FILTER (id IS NOT NULL AND NOT dup AND id IN (SELECT p_partkey FROM part WHERE p_size <= 10)) n_in_table,
  count(*) FILTER (id IS NOT NULL AND NOT dup AND id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 10)) n_outside_table,
  round(count(*) FILTER (id IS NOT NULL AND NOT dup AND id IN (SELECT p_partkey FROM part WHERE p_size <= 10))
    / nullif(CAST(count(*) FILTER (id IS NOT NULL AND NOT dup) AS DOUBLE), 0), 6) frac_in_table FROM n_resolved GROUP BY 1""")
def _(m):
    return rounded(names.resolution_diagnostics(resolved(m), "key"))


@query("constrained_predictions", """
SELECT key, TRY_CAST(substr(written, 4) AS BIGINT) id, row_number() OVER (PARTITION BY key ORDER BY position) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY key, written ORDER BY position) d FROM n_answers WHERE starts_with(written, 'GO:')
    AND TRY_CAST(substr(written, 4) AS BIGINT) IN (SELECT p_partkey FROM part WHERE p_size <= 10)) WHERE d = 1""")
def _(m):
    cands = m.table("part").filter("p_size <= 10").select(F.concat(F.lit("GO:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("id"))
    out = names.resolve_predictions(order_answers(m), cands.select(F.col("id").alias("name"), "id"), cands, "key", "constrained",
                                    "^GO:\\s*(\\d{7})")
    return rounded(out.filter("rank IS NOT NULL").select("key", F.substring("id", 4, 7).cast("bigint").alias("id"), "rank"))


@query("name_forms", """
SELECT count(*) n, count(*) FILTER (lower(written) = lower(label)) n_official,
  count(*) FILTER (lower(written) <> lower(label) AND NOT starts_with(upper(written), 'GO:')) n_other_form,
  count(*) FILTER (starts_with(upper(written), 'GO:')) n_as_id
FROM n_resolved r JOIN n_terms t ON t.id = r.id WHERE NOT dup""")
def _(m):
    terms, _syn = named_terms(m)
    rows = resolved(m).filter("rank IS NOT NULL").join(terms.select("id", "label"), "id")
    return names.name_forms(rows)


fragment("n_invalid", """
SELECT DISTINCT CASE l_linenumber WHEN 1 THEN label WHEN 2 THEN 'Old ' || p_name || ' ' || p_partkey WHEN 3 THEN 'new ' || label
  WHEN 4 THEN p_name || ' activity' WHEN 5 THEN p_name || '-' || p_size || ' ' || p_brand ELSE 'mystery ' || p_partkey END AS text
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN n_terms ON id = p_partkey""")


@query("classify_invalid", """
WITH a AS (SELECT text, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS name FROM n_invalid),
hits AS (SELECT name, count(*) FILTER (namespace = 'biological_process') np, bool_or(namespace = 'molecular_function') f,
  bool_or(namespace <> 'biological_process') o FROM n_norm GROUP BY 1),
loose AS (SELECT trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS name, min(s.id) lid FROM n_syn s JOIN n_terms t ON t.id = s.id
  WHERE scope = 'RELATED' AND namespace = 'biological_process' GROUP BY 1),
pn AS (SELECT id, list_distinct(string_split(trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')), ' ')) ts FROM n_terms WHERE namespace = 'biological_process'),
w AS (SELECT id, unnest(ts) tok, ts FROM pn),
an AS (SELECT DISTINCT name, list_distinct(string_split(name, ' ')) ats FROM a),
near AS (SELECT name, min_by(id, (-j, id)) nid FROM (
  SELECT DISTINCT x.name, w.id, len(list_intersect(ats, ts)) / CAST(len(ats) + len(ts) - len(list_intersect(ats, ts)) AS DOUBLE) j
  FROM (SELECT name, ats, tok FROM (
    SELECT name, ats, tok, row_number() OVER (PARTITION BY name ORDER BY f NULLS FIRST, tok) r FROM (SELECT name, ats, unnest(ats) tok FROM an)
    LEFT JOIN (SELECT tok, count(*) f FROM w GROUP BY 1) USING (tok)) WHERE r <= len(ats) - ceil(len(ats) * 0.75) + 1) x JOIN w USING (tok)) WHERE j >= 0.75 GROUP BY 1)
SELECT text, class, CASE class WHEN 'loose synonym' THEN lid WHEN 'reworded' THEN nid END nearest FROM (
  SELECT text, lid, nid, CASE WHEN coalesce(np, 0) > 1 THEN 'ambiguous' WHEN o THEN CASE WHEN f THEN 'molecular function' ELSE 'cellular component' END
    WHEN lid IS NOT NULL THEN 'loose synonym' WHEN nid IS NOT NULL THEN 'reworded'
    WHEN list_contains(string_split(a.name, ' '), 'activity') OR list_contains(string_split(a.name, ' '), 'binding') THEN 'function wording' ELSE 'not a name' END class
  FROM a LEFT JOIN hits USING (name) LEFT JOIN loose USING (name) LEFT JOIN near USING (name))""")
def _(m):
    part = m.table("part").withColumnRenamed("p_partkey", "l_partkey")
    li = m.table("lineitem").select("l_linenumber", "l_partkey").join(part, "l_partkey")
    label, n = F.concat_ws(" ", "p_name", "p_brand", "l_partkey"), F.col("l_linenumber")
    asked = (F.when(n == 1, label).when(n == 2, F.concat_ws(" ", F.lit("Old"), "p_name", "l_partkey")).when(n == 3, F.concat_ws(" ", F.lit("new"), label))
             .when(n == 4, F.concat_ws(" ", "p_name", F.lit("activity"))).when(n == 5, F.concat("p_name", F.lit("-"), "p_size", F.lit(" "), "p_brand"))
             .otherwise(F.concat_ws(" ", F.lit("mystery"), "l_partkey")))
    return names.classify_invalid(li.select(asked.alias("text")), *named_terms(m))
