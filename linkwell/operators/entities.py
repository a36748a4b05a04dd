"""Catalogue records: index documents, queries and organisations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkwell.functions import text as T
from linkwell.operators.joins import lookup_optional, lookup_required, null_safe


def present(column: str) -> F.Column:
    """The column's value, or null where it is empty text."""
    c = F.col(column)
    return F.when(c.isNotNull() & (c.cast("string") != ""), c)


def clean_strings(df: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """Every text column tokenised, but for those named."""
    return df.select(*[T.tokenize(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) and f.name not in but else F.col(f.name) for f in df.schema])


def index_documents(products: DataFrame, brands: DataFrame, categories: DataFrame) -> DataFrame:
    """Search documents: id, name with brand, category id and name, barcodes, source, unit, synonyms."""
    rows = lookup_optional(products, "brand_id", brands, "id", "name", "_brand")
    rows = lookup_required(rows, "category_id", categories, "id", "name", "_category")
    # a file may be one split, and a lookup may gather rows by a key of few values: the text work is dealt out anew
    rows = rows.repartition("id", "name")
    names = F.array_join(F.transform("synonyms", lambda s: s["name"]), "\n")
    docs = rows.select(
        "id", F.concat_ws(" ", "name", "_brand").alias("name"), F.col("category_id").alias("categoryId"), F.col("_category").alias("categoryName"), "barcodes",
        present("source").alias("source"), T.unit_text(F.col("unit_name")).alias("unitName"), T.unique_words(names).alias("synonyms"))
    return clean_strings(docs, but=("source", "categoryName"))


def query_names(products: DataFrame, links: DataFrame) -> DataFrame:
    """(qid, synid, name): a linked product asks with each of its synonyms, any other with its own name."""
    linked = products.join(links.select(F.col("_id").alias("id")), "id", "left_semi")
    alone = products.join(links.select(F.col("_id").alias("id")), "id", "left_anti")
    by_synonym = linked.select(F.col("id").alias("qid"), F.explode("synonyms").alias("s")).select("qid", F.col("s.id").alias("synid"), F.col("s.name").alias("name"))
    own = alone.select(F.col("id").alias("qid"), F.lit(None).cast("long").alias("synid"), "name")
    return by_synonym.unionByName(own).where(F.trim("name") != "")


def organisations(products: DataFrame) -> DataFrame:
    """(qid, synid, org): of each synonym, and of the product itself with a null synid.

    A synonym that was merged with the master belongs to the product's own organisation.
    """
    rows = products.select(F.col("id").alias("qid"), T.organisation(F.col("comment")).alias("main"), "synonyms")
    each = rows.select("qid", "main", F.explode("synonyms").alias("s"))
    of = F.when(F.col("s.comment") == "merged with master", F.col("main")).otherwise(T.organisation(F.when(F.col("s.comment") != "merged with master", F.col("s.comment"))))
    return each.select("qid", F.col("s.id").alias("synid"), of.alias("org")).unionByName(rows.select("qid", F.lit(None).cast("long").alias("synid"), F.col("main").alias("org")))


def corpus(products: DataFrame, queries: DataFrame) -> DataFrame:
    """Master texts (fid set) and query texts (qid set) in one table of normalised text."""
    master = products.select(F.lit(None).cast("long").alias("qid"), F.lit(None).cast("long").alias("synid"), F.col("id").alias("fid"), T.normalize(F.col("name")).alias("text"))
    asked = queries.select("qid", "synid", F.lit(None).cast("long").alias("fid"), T.normalize(F.col("name")).alias("text"))
    return master.unionByName(asked)


def pair_texts(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Pairs with the token lists of both sides, without label noise and empty sides."""
    asked = corpus.where("fid IS NULL").select(F.col("qid").alias("_q"), F.col("synid").alias("_s"), T.words(F.col("text")).alias("q_terms"))
    master = corpus.where("fid IS NOT NULL").select("fid", T.words(F.col("text")).alias("d_terms"))
    joined = pairs.join(asked, (pairs["qid"] == asked["_q"]) & pairs["synid"].eqNullSafe(asked["_s"])).drop("_q", "_s").join(master, "fid")
    return without_noise(joined)


def without_noise(pairs: DataFrame) -> DataFrame:
    """No pairs with an empty side, none that are labelled different although their tokens are equal."""
    return pairs.where((F.size("q_terms") > 0) & (F.size("d_terms") > 0) & ~((F.col("target") == 0) & (F.col("q_terms") == F.col("d_terms"))))


def synonym_name(pairs: DataFrame, products: DataFrame, out: str = "name") -> DataFrame:
    """Pairs (qid, synid) with the name of that synonym of their product, or with the product's own where synid is null.

    Null where the product has no such synonym.
    """
    own = products.select(F.col("id").alias("_q"), F.col("name").alias("_own"), F.col("synonyms").alias("_syn"))
    named = F.get(F.filter("_syn", lambda s: s["id"] == F.col("synid")), 0)["name"]
    return pairs.join(own, F.col("qid") == F.col("_q"), "left").withColumn(out, F.when(F.col("synid").isNull(), F.col("_own")).otherwise(named)).drop("_q", "_own", "_syn")


def joined_names(products: DataFrame) -> DataFrame:
    """Products with the names of their synonyms and mistypes as one array, ``all_names``; null arrays count as empty."""
    names = lambda c: F.coalesce(F.transform(c, lambda s: s["name"]), F.array().cast("array<string>"))
    return products.withColumn("all_names", F.concat(names("synonyms"), names("mistypes")))


def with_existing(df: DataFrame, key: str = "qid") -> DataFrame:
    """Without groups whose true row was not retrieved: those that hold a place of -1."""
    lost = df.where("ix = -1").select(key).distinct()
    return df.join(lost, key, "left_anti")


def error_sheet(errors: DataFrame, q_texts: DataFrame, d_texts: DataFrame) -> DataFrame:
    """Errors (qid, synid, fid, prob, target, error_type) with the whole texts of both sides, worst first within their type."""
    q = null_safe(errors, q_texts.select("qid", "synid", F.col("text").alias("q")), ["qid", "synid"], "left")
    return q.join(d_texts.select("fid", F.col("text").alias("d")), "fid", "left").orderBy("error_type", F.when(F.col("error_type") == 1, -F.col("prob")).otherwise(F.col("prob")), "qid", "synid", "fid")


def retrieved(samples: DataFrame) -> DataFrame:
    """Samples without true rows that retrieval missed (place -1)."""
    return samples.where("ix <> -1")


def for_fitting(corpus: DataFrame, held_out: DataFrame) -> DataFrame:
    """The corpus without the queries of held-out samples (qid); master rows, whose qid is null, stay."""
    return corpus.join(held_out.select("qid").where("qid IS NOT NULL").distinct(), "qid", "left_anti")
