"""Names to term ids: exact resolution, and a diagnosis of names that do not resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from enrichspark.functions.text import jaccard, normalise

PROCESS, FUNCTION = "biological_process", "molecular_function"


def _names(terms: DataFrame, synonyms: DataFrame, scopes: tuple[str, ...]) -> DataFrame:
    """(name, id, namespace): normalised labels and synonyms of the given scopes."""
    syn = (synonyms.filter(F.col("scope").isin(*scopes)).join(terms.select("id", "namespace"), "id")
           .select(normalise(F.col("text")).alias("name"), "id", "namespace"))
    own = terms.filter(F.col("label").isNotNull()).select(normalise(F.col("label")).alias("name"), "id", "namespace")
    return own.unionByName(syn).distinct()


def name_index(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(name, id) of process labels and EXACT synonyms; a name of two terms resolves to nothing and is left out."""
    n = _names(terms, synonyms, ("EXACT",)).filter(F.col("namespace") == PROCESS)
    return (n.groupBy("name").agg(F.min("id").alias("id"), F.max("id").alias("_other"))
            .filter(F.col("id") == F.col("_other")).select("name", "id"))


# fixed values: the fields an answer's text may stand in, after the one asked for, and the list they stand in
ANSWER_FIELDS = ("go_id", "name", "term", "id")
ANSWER_LIST = "predictions"


def answer_entries(responses: DataFrame, key: str, payload: str, field: str = "name") -> DataFrame:
    """(key, position, written, confidence) of the entries of each JSON answer, positions from 0.

    An entry is a plain string or an object with its text in `field` or, where that is missing or empty, in one of ANSWER_FIELDS; other
    entries are skipped and take no position. Only a number counts as confidence. What isn't JSON, or has no such list, gives no rows.
    """
    entries = F.from_json(payload, f"{ANSWER_LIST} array<variant>")[ANSWER_LIST]

    def read(v):
        def of(path, kind):
            return F.try_variant_get(v, f"$.{path}", kind)
        plain = F.schema_of_variant(v) == "STRING"
        kind = F.schema_of_variant(of("confidence", "variant"))
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        text = F.coalesce(*[F.nullif(of(f, "string"), F.lit("")) for f in dict.fromkeys((field, *ANSWER_FIELDS))])
        return F.struct(F.when(plain, F.nullif(F.try_variant_get(v, "$", "string"), F.lit(""))).otherwise(text).alias("written"),
                        F.when(~plain & number, of("confidence", "double")).alias("confidence"))
    written = F.filter(F.transform(entries, read), lambda e: e["written"].isNotNull())
    return responses.select(key, F.posexplode(written).alias("position", "_e")).select(key, "position", "_e.written", "_e.confidence")


def resolve_predictions(answers: DataFrame, index: DataFrame, candidates: DataFrame, key: str, mode: str = "freeform",
                        id_pattern: str = "(?:GO:)?\\s*(\\d{7})", prefix: str = "GO:", max_predictions: int | None = None) -> DataFrame:
    """Resolved predictions of answers(key, position, written, confidence), position from 0.

    constrained keeps ids among the candidates. freeform takes an id when the text is one (and index lists it
    under that text) or a name from the index. Later repeats are dropped and ranks are closed up.
    index is (name, id) and for freeform ids also holds the id text itself as a name. With max_predictions, later
    answers are not resolved but stay, marked beyond, so that they are counted.
    """
    rows = answers.withColumn("beyond", F.lit(False) if max_predictions is None else F.col("position") >= max_predictions)
    digits = F.regexp_extract("written", id_pattern, 1)
    as_id = F.concat(F.lit(prefix), digits)
    cand = candidates.select(F.col("id").alias("_cid"), F.lit(True).alias("in_table"))
    if mode == "constrained":
        found = rows.withColumn("_cid", F.when(digits != "", as_id)).join(cand, "_cid", "left") \
                    .withColumn("id", F.when(F.col("in_table"), F.col("_cid"))).drop("_cid", "in_table")
    else:
        written = F.trim("written")
        is_id = F.upper(written).startswith(prefix) & written.rlike("^" + id_pattern + "$")
        name = F.when(is_id, as_id).otherwise(normalise(F.col("written")))
        found = (rows.withColumn("_name", name)
                 .join(index.select(F.col("name").alias("_name"), "id"), "_name", "left").drop("_name"))
    found = found.withColumn("id", F.when(~F.col("beyond"), F.col("id")))
    first = Window.partitionBy(key, "id").orderBy("position")
    seen = found.withColumn("duplicate", F.col("id").isNotNull() & (F.row_number().over(first) > 1))
    valid = F.col("id").isNotNull() & ~F.col("duplicate")
    rank = F.sum(F.when(valid, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("position"))
    return (seen.withColumn("rank", F.when(valid, rank))
            .join(cand, F.col("id") == F.col("_cid"), "left").drop("_cid")
            .withColumn("in_table", F.coalesce("in_table", F.lit(False))))


def resolution_diagnostics(resolved: DataFrame, key: str) -> DataFrame:
    """Per answer: raw, valid and invalid predictions, valid ones inside and outside the candidate table and the share inside."""
    valid = F.col("rank").isNotNull()
    out = resolved.groupBy(key).agg(
        F.count("*").alias("n_raw"), F.count_if(valid).alias("n_valid"), F.count_if(F.col("id").isNull() & ~F.col("beyond")).alias("n_invalid"), F.count_if("beyond").alias("n_beyond"),
        F.count_if("duplicate").alias("n_duplicate"), F.count_if(valid & F.col("in_table")).alias("n_in_table"),
        F.count_if(valid & ~F.col("in_table")).alias("n_outside_table"))
    return out.withColumn("frac_in_table", F.when(F.col("n_valid") > 0, F.col("n_in_table") / F.col("n_valid")))


def classify_invalid(texts: DataFrame, terms: DataFrame, synonyms: DataFrame, min_jaccard: float = 0.75) -> DataFrame:
    """(text, class, nearest): why each distinct text is not a process name; all names are searched for rewordings."""
    asked = texts.select("text").distinct().withColumn("name", normalise(F.col("text")))
    every = _names(terms, synonyms, ("EXACT",))
    hits = every.groupBy("name").agg(
        F.count_if(F.col("namespace") == PROCESS).alias("n_process"),
        F.max((F.col("namespace") == FUNCTION).cast("int")).alias("is_function"),
        F.max((F.col("namespace") != PROCESS).cast("int")).alias("is_other"))
    process = terms.filter(F.col("namespace") == PROCESS)
    loose = (_names(process, synonyms, ("BROAD", "NARROW", "RELATED"))
             .join(process.select("id", normalise(F.col("label")).alias("_own")), "id").filter(F.col("name") != F.col("_own"))
             .groupBy("name").agg(F.min("id").alias("loose_id")))
    named = process.select(F.col("id").cast("string").alias("key"), "id", normalise(F.col("label")).alias("name"))
    near = near_names(asked.select(F.col("name").alias("key"), "name").distinct(), named, min_jaccard)
    rows = asked.join(hits, "name", "left").join(loose, "name", "left").join(near, "name", "left")
    spelled = F.split("name", " ")
    cls = (F.when(F.coalesce("n_process", F.lit(0)) > 1, "ambiguous")
           .when(F.col("is_other") == 1, F.when(F.col("is_function") == 1, "molecular function").otherwise("cellular component"))
           .when(F.col("loose_id").isNotNull(), "loose synonym").when(F.col("_near").isNotNull(), "reworded")
           .when(F.array_contains(spelled, "activity") | F.array_contains(spelled, "binding"), "function wording")
           .otherwise("not a name"))
    nearest = F.when(F.col("class") == "loose synonym", F.col("loose_id")).when(F.col("class") == "reworded", F.col("_near.id"))
    return rows.withColumn("class", cls).withColumn("nearest", nearest).select("text", "class", "nearest")


def near_names(asked: DataFrame, named: DataFrame, min_jaccard: float, split_above: int = 256) -> DataFrame:
    """(name, _near): the id of the most similar name by word overlap, at least min_jaccard, per asked name.

    The sizes of two word sets fix how many words they must share. Ordered by rarity, the first shared word then stands so early
    in both that enough words follow it, and a second one, where two are needed, no more than a place later. Names meet
    on both sizes and that first word; a word of more than split_above names meets together with the next shared word, so that
    common words make no large groups. No candidate is lost.
    """
    def split(df):
        return df.select("key", F.explode(F.array_distinct(F.split("name", " "))).alias("token"))
    freq = split(named).groupBy("token").agg(F.count("*").alias("f"))

    def profile(df):
        rare_first = F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "token")))
        return (split(df).join(freq, "token", "left").groupBy("key").agg(rare_first.alias("_t"))
                .withColumn("tokens", F.transform("_t", lambda x: x["token"])).withColumn("n", F.size("_t")))

    def meets(df, other):
        """One row per size of the other side and word or pair of words to meet on."""
        low, high = F.ceil(F.col("n") * min_jaccard - 1e-9).cast("int"), F.floor(F.col("n") / min_jaccard + 1e-9).cast("int")
        shared = F.ceil((F.col("n") + F.col(other)) * min_jaccard / (1 + min_jaccard) - 1e-9).cast("int")

        def words(x, i):
            later = F.filter(F.slice("_t", i + 2, F.col("n") - F.col("shared") + 1 - i), lambda y: y["f"] > 0)
            pairs = F.transform(later, lambda y: F.concat_ws(" ", x["token"], y["token"]))
            return (F.when(x["f"] == 0, F.array().cast("array<string>")).when((x["f"] > split_above) & (F.col("shared") > 1), pairs)
                    .otherwise(F.array(x["token"])))
        first = F.slice("_t", F.lit(1), F.col("n") - F.col("shared") + 1)
        return (df.withColumn(other, F.explode(F.sequence(low, high))).withColumn("shared", shared)
                .withColumn("meet", F.explode(F.flatten(F.transform(first, words)))))
    a = meets(profile(asked), "n_other").select("key", "tokens", "meet", "n", "n_other")
    b = (meets(profile(named), "n_other").join(named.select("key", "id"), "key")
         .select("meet", F.col("n_other").alias("n"), F.col("n").alias("n_other"), "id", F.col("tokens").alias("tokens_b")))
    return (a.join(b, ["meet", "n", "n_other"])
            .select(F.col("key").alias("name"), "id", jaccard(F.col("tokens"), F.col("tokens_b")).alias("j"))
            .filter(F.col("j") >= min_jaccard)
            .groupBy("name").agg(F.min(F.struct((-F.col("j")).alias("o"), "id")).alias("_near")))


def name_forms(preds: DataFrame, prefix: str = "GO:") -> DataFrame:
    """How valid answers were written: official name, another form, or an id."""
    w = F.trim(F.coalesce("written", F.lit("")))
    other = F.lower(w) != F.lower("label")
    is_id = F.upper(w).startswith(prefix)
    return preds.agg(F.count("*").alias("n"), F.count_if(~other).alias("n_official"),
                     F.count_if(other & ~is_id).alias("n_other_form"), F.count_if(is_id).alias("n_as_id"))
