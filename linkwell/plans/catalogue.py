"""Registered queries: each applies library operators to the driver's tables.

Stand-ins: ``documents`` and ``part`` are catalogues, ``benchmark`` the queries, ``documents.source`` the
organisation, md5 of squeezed lower-case text the barcode, ``lineitem`` per order the ranking groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwell.functions import similarity, text
from linkwell.operators import entities, features, joins, metrics, ranking, retrieval, sampling, segments, vectors
from linkwell.operators.quantiles import quantiles
from linkwell.plans import models
from linkwell.plans.oracle import ORACLE_SQL
from linkwell.storage import materialize, scratch_path, stored, table

__all__ = ["ORACLE_SQL", "QUERIES"]
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[ \\t\\n\\r]+", " "))


def coded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(squeezed(F.col("text")).cast("binary")).alias("barcode"), "source")


# scans, lookups, keyed joins


@query
def scan_project_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("chars"))


@query
def enrich_brand_category(spark, d):
    part = table(spark, d, "part")
    brand = part.select(F.col("p_brand").alias("b")).distinct().select(F.regexp_replace("b", "Brand#", "").cast("int").alias("id"), F.col("b").alias("name")).where("id <= 20")
    kind = part.select(F.col("p_type").alias("name")).distinct().select(F.md5(F.col("name").cast("binary")).alias("id"), "name")
    rows = part.select("p_partkey", "p_name", F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("brand_id"), F.md5(F.col("p_type").cast("binary")).alias("category_id"))
    rows = joins.lookup_optional(rows, "brand_id", brand, "id", "name", "brand")
    rows = joins.lookup_required(rows, "category_id", kind, "id", "name", "category")
    return rows.select("p_partkey", F.trim(F.concat_ws(" ", "p_name", "brand")).alias("name"), "category")


@query
def lookup_left_missing(spark, d):
    nation = table(spark, d, "nation").where("n_nationkey < 20")
    return joins.lookup_optional(table(spark, d, "supplier"), "s_nationkey", nation, "n_nationkey", "n_name", "nation").select("s_suppkey", "nation")


@query
def lookup_existing(spark, d):
    links = table(spark, d, "customer").select(F.when(F.col("c_nationkey") < 15, F.col("c_nationkey")).alias("n"), "c_custkey")
    return joins.lookup_link(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", links, "n", "c_custkey", "existing")


@query
def semi_known_keys(spark, d):
    good = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return joins.known(table(spark, d, "orders"), good, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query
def anti_known_keys(spark, d):
    asked = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.unknown(table(spark, d, "customer"), asked, ["c_custkey"]).select("c_custkey")


@query
def range_key_scan(spark, d):
    keys = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.known(table(spark, d, "lineitem").where("l_linenumber <= 3 AND l_quantity >= 10"), keys, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query
def count_scan(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query
def truth_unique_link(spark, d):
    docs = coded(spark, d)
    feed = docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("feed_id"), "barcode")
    master = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("master_id"), "barcode")
    return joins.unique_links(feed, master, "feed_id", "master_id", "barcode")


@query
def nullsafe_pair_join(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey")).alias("synid"), F.col("l_partkey").alias("fid"))
    org = rows.select("qid", "synid", (F.col("qid") % 7).alias("org")).distinct()
    return joins.null_safe(rows, org, ["qid", "synid"]).select("qid", "synid", "fid", "org")


@query
def array_explode_overlap(spark, d):
    conv = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return conv.select("conv_id", F.arrays_overlap("roles", F.array(F.lit("system"), F.lit("tool"))).alias("overlap"), F.size(F.array_intersect("roles", F.array(F.lit("user"), F.lit("system")))).alias("n_common"))


@query
def barcode_numbers(spark, d):
    events = table(spark, d, "events").select("event_id", text.barcode_numbers(F.split(F.regexp_replace("props", "[^0-9,]", ""), ",")).alias("codes"))
    return events.select("event_id", F.explode("codes").alias("code"))


@query
def keep_first(spark, d):
    rows = table(spark, d, "conversations").withColumn("size", F.length("text"))
    return joins.keep_first(rows, ["conv_id", "role"], [F.col("turn")]).select("conv_id", "role", "turn", "size")


# text


@query
def tokens_ascii(spark, d):
    rows = table(spark, d, "documents").select("doc_id", retrieval.ascii_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    checksum = F.aggregate(F.transform("terms", lambda t, i: (i + 1).cast("long") * F.length(t)), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"), checksum.alias("checksum"))


@query
def char_clean_fold(spark, d):
    cleaned = text.strip_symbols(text.clean_characters(F.lower("text")))
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold_letters(cleaned).cast("binary")).alias("clean_md5"))


@query
def number_boundary_split(spark, d):
    name = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("mm "), F.replace(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")), F.lit("kg"))
    named = table(spark, d, "part").select("p_partkey", name.alias("name")).repartition("p_partkey")  # the file may be one split
    return named.select("p_partkey", F.array_join(text.words(text.split_numbers(F.lower("name"))), " ").alias("split"))


@query
def number_mask(spark, d):
    words = F.split(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(text.mask_numbers(words), " ").alias("masked"))


@query
def unit_expand(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("g", "ml", "kg", "mm", "cm", "x")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    tokens = F.array(F.lit("size"), (F.col("p_size") + 10).cast("string"), unit)
    return table(spark, d, "part").select("p_partkey", F.array_join(text.expand_units(tokens), " ").alias("expanded"))


@query
def analysed_terms(spark, d):
    terms = text.analyse(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(terms).alias("n_terms"), F.md5(F.array_join(terms, " ").cast("binary")).alias("terms_md5"))


@query
def token_chunks(spark, d):
    pieces = text.chunks(retrieval.ascii_terms(F.col("text")), 64)
    return table(spark, d, "documents").select("doc_id", F.posexplode(pieces).alias("k", "terms")).select("doc_id", "k", F.md5(F.array_join("terms", " ").cast("binary")).alias("chunk_md5"))


@query
def unique_tokens_ordered(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(F.array_distinct(retrieval.ascii_terms(F.col("text"))), " ").cast("binary")).alias("unique_md5"))


@query
def stopword_length_filter(spark, d):
    stop = ("the", "of", "and", "to", "in", "is", "that", "for", "de", "la", "le", "der", "die", "und")
    kept = text.of_length(text.without_stop_words(F.split(F.lower("text"), "[ \\t\\n\\r]+"), stop))
    return table(spark, d, "documents").select("doc_id", F.size(kept).alias("n_kept"), F.md5(F.array_join(kept, " ").cast("binary")).alias("kept_md5"))


@query
def org_parse(spark, d):
    comment = F.concat(F.lit("{"), "source", F.lit("|"), "lang")
    return table(spark, d, "documents").select("doc_id", text.organisation(comment).alias("org"))


@query
def product_text(spark, d):
    synonyms = F.array(F.concat("p_type", F.lit(" "), "p_name"), F.lower("p_type"))
    return table(spark, d, "part").select("p_partkey", text.product_text(F.col("p_name"), synonyms, F.col("p_brand"), True).alias("text"))


@query
def tokenize_names(spark, d):
    name = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("g "), "p_brand", F.lit(" 3,2%"))
    named = table(spark, d, "part").select("p_partkey", name.alias("name")).repartition("p_partkey")  # the file may be one split
    return named.select("p_partkey", text.tokenize(F.col("name")).alias("tokens"), text.normalize(F.col("name")).alias("normal"))


def products(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("brand_id"), F.length("p_type").cast("long").alias("category_id"),
        F.array(F.col("p_partkey").cast("string")).alias("barcodes"), F.lit("").alias("source"), F.lower("p_type").alias("unit_name"),
        F.array(F.struct(F.col("p_partkey").alias("id"), F.concat("p_type", F.lit(" "), "p_name").alias("name"), F.lit("").alias("comment"))).alias("synonyms"))


@query
def index_documents(spark, d):
    part = table(spark, d, "part")
    brands = part.select(F.col("p_size").cast("long").alias("id"), F.concat(F.lit("brand"), F.col("p_size").cast("string")).alias("name")).distinct().where("id < 30")
    kinds = part.select("p_type").distinct().groupBy(F.length("p_type").cast("long").alias("id")).agg(F.min("p_type").alias("name"))
    return entities.index_documents(products(spark, d), brands, kinds).withColumn("barcodes", F.array_join("barcodes", ","))


@query
def synonym_names(spark, d):
    key = F.col("p_partkey")
    pairs = table(spark, d, "part").select(key.alias("qid"), F.when(key % 3 == 1, key).when(key % 3 == 2, F.lit(-1)).cast("long").alias("synid"))
    return entities.synonym_name(pairs, products(spark, d))


@query
def all_names(spark, d):
    mistypes = F.array(F.struct(F.reverse("name").alias("name")))
    return entities.joined_names(products(spark, d).withColumn("mistypes", mistypes)).select("id", F.array_join("all_names", "|").alias("names"))


@query
def url_quote(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_quote(F.col("url")).alias("quoted"))


# retrieval and samples


def asked(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), retrieval.ascii_terms(F.col("text")).alias("terms"))


def indexed(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), retrieval.ascii_terms(F.col("text")).alias("terms"))


@query
def doc_freq(spark, d):
    return retrieval.document_frequency(indexed(spark, d))


@query
def term_freq(spark, d):
    return retrieval.postings(indexed(spark, d)).groupBy("term").agg(F.sum("tf").alias("tf"), F.max("tf").alias("max_tf"))


@query
def bm25_topk(spark, d):
    return retrieval.bm25_topk(asked(spark, d), indexed(spark, d))


@query
def bm25_two_fields(spark, d):
    part = table(spark, d, "part")
    terms = lambda *c: text.analyse(F.concat_ws(" ", *c))
    docs = part.select(F.col("p_partkey").alias("id"), terms("p_name", "p_brand").alias("name"), terms("p_type", "p_name").alias("synonyms"))
    asking = part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("qid")).select("qid", terms("p_name", "p_type").alias("terms"))
    return retrieval.search(asking, retrieval.build_index(docs, ["name", "synonyms"], count_empty=False), 20, {"name": 5.0, "synonyms": 1.0})


def grown(spark, docs: DataFrame, fields: list[str], count_empty: bool) -> segments.SegmentIndex:
    """An index that four arrivals, a correction and merges have made; a fourth of the documents came twice."""
    index = segments.SegmentIndex(spark, scratch_path(spark, "segments"), fields, count_empty)
    docs = materialize(docs, "arrivals")
    arrival = F.pmod(F.xxhash64("id"), F.lit(4))
    for i in range(4):
        index.add(docs.where(arrival == i))
    old = docs.where(arrival == 1).select("id", *[F.array(F.lit("outdated")).alias(f) for f in fields])
    index.add(old)
    index.add(docs.where(arrival == 1))
    index.merge()
    return index


@query
def segment_topk(spark, d):
    return grown(spark, indexed(spark, d), ["terms"], True).search(asked(spark, d))


@query
def segment_two_fields(spark, d):
    part = table(spark, d, "part")
    terms = lambda *c: text.analyse(F.concat_ws(" ", *c))
    docs = part.select(F.col("p_partkey").alias("id"), terms("p_name", "p_brand").alias("name"), terms("p_type", "p_name").alias("synonyms"))
    asking = part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("qid")).select("qid", terms("p_name", "p_type").alias("terms"))
    return grown(spark, docs, ["name", "synonyms"], False).search(asking, 20, {"name": 5.0, "synonyms": 1.0})


def candidates(spark, d) -> DataFrame:
    """The best documents of each query, searched once for each state of the tables."""
    return stored(spark, d, ("documents", "benchmark"), "candidates", bm25_topk).select("qid", F.lit(None).cast("long").alias("synid"), "fid", "score", "ix")


def truth(spark, d) -> DataFrame:
    return stored(spark, d, ("documents", "benchmark"), "truth", lambda spark, d: retrieval.shared_run_truth(asked(spark, d), indexed(spark, d)))


@query
def score_share_flag(spark, d):
    part = Window.partitionBy("qid")
    rows = candidates(spark, d).join(truth(spark, d), "qid", "left").withColumn("target", F.coalesce((F.col("fid") == F.col("true_id")).cast("int"), F.lit(0)))
    return rows.select("qid", "fid", "ix", r6(F.col("score") / F.sum("score").over(part)).alias("share"), F.max("target").over(part).alias("found"))


@query
def miss_replacement(spark, d):
    return sampling.label(candidates(spark, d), truth(spark, d)).select("qid", "fid", r6("score").alias("score"), "target", "existing", "ix")


def found_at(spark, d) -> DataFrame:
    return sampling.positions(asked(spark, d).select("qid", F.lit(None).cast("long").alias("synid")), candidates(spark, d), truth(spark, d))


@query
def positions(spark, d):
    return found_at(spark, d).select("et_id", "el_id", "i")


@query
def recall_at_n(spark, d):
    return metrics.recall_at(found_at(spark, d)).select("n", r6("share").alias("share"), r6("recall").alias("recall"))


@query
def recall_scale(spark, d):
    return metrics.recall_scale(sampling.label(candidates(spark, d), truth(spark, d))).select(r6("recall_scale").alias("recall_scale"))


@query
def negatives_seeded(spark, d):
    docs = coded(spark, d)
    linked = truth_unique_link(spark, d).select(F.col("feed_id").alias("doc_id"))
    rest = joins.unknown(docs.where("doc_id % 2 = 1"), linked, ["doc_id"]).select("doc_id")
    return sampling.balanced(linked, rest, "doc_id", "s1")


@query
def shuffled_rows(spark, d):
    return sampling.shuffled(table(spark, d, "customer").select("c_custkey"), F.col("c_custkey"), "s2")


@query
def positions_by_barcode(spark, d):
    codes = lambda text, key: F.array((F.length(text) % 97).cast("long"), (F.col(key) % 89 + 100).cast("long"))
    asking = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.lit(None).cast("long").alias("synid"), codes("text", "item_id").alias("barcodes"), F.col("item_id").alias("src_id"))
    return sampling.barcode_positions(asking, candidates(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("fid"), codes("text", "doc_id").alias("barcodes"))).drop("synid")


@query
def org_split(spark, d):
    rows = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang").alias("org"))
    return sampling.org_split(rows, "org", 0.1)


@query
def nested_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang").alias("org"))
    train, vali, test = sampling.parts(sampling.nested_split(rows, "org", 0.1))
    return train.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("train").alias("part"), "n").unionByName(
        vali.agg(F.count(F.lit(1)).alias("n")).select(F.lit("vali").alias("part"), "n")).unionByName(test.agg(F.count(F.lit(1)).alias("n")).select(F.lit("test").alias("part"), "n"))


@query
def hash_split(spark, d):
    org = F.col("source")
    return table(spark, d, "documents").select("doc_id", (sampling.unit_hash(org, "test") < 0.1).alias("test"), (sampling.unit_hash(org, "vali") < 0.1).alias("vali"))


@query
def pair_noise_filter(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("fid"), retrieval.ascii_terms(F.col("text")).alias("d_terms"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), retrieval.ascii_terms(F.col("text")).alias("q_terms"))
    pairs = sampling.label(candidates(spark, d), truth(spark, d)).join(queries, "qid").join(docs, "fid")
    return entities.without_noise(pairs).select("qid", "fid", "target", F.size("q_terms").alias("q_len"), F.size("d_terms").alias("d_len"))


# pair features


def name_pairs(spark, d) -> DataFrame:
    """Pairs of distinct part names that share a word, with the names' smallest part keys."""
    names = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.split("p_name", " ").alias("terms"))
    word = lambda side: names.select(F.col("id").alias(f"{side}_id"), F.col("terms").alias(f"{side}_terms"), F.explode("terms").alias("word"))
    return word("q").join(word("d"), "word").where("q_id <> d_id").drop("word").dropDuplicates(["q_id", "d_id"])


def featured(spark, d, built) -> DataFrame:
    pairs = name_pairs(spark, d)
    return pairs.select("q_id", "d_id", *[r6(c.cast("double")).alias(n) for n, c in built(F.col("q_terms"), F.col("d_terms")).items()])


@query
def length_features(spark, d):
    return featured(spark, d, similarity.length_features)


@query
def levenshtein_matrix(spark, d):
    return featured(spark, d, similarity.edit_matrix)


@query
def token_set_features(spark, d):
    return featured(spark, d, similarity.token_set_features)


@query
def qgram_distance(spark, d):
    return featured(spark, d, lambda q, t: {"qgram": similarity.text_features(q, t)["qgram"]})


@query
def prefix_suffix(spark, d):
    return featured(spark, d, lambda q, t: {k: v for k, v in similarity.text_features(q, t).items() if k != "qgram"})


def arrow_part(spark, d, names) -> DataFrame:
    rows = name_pairs(spark, d).withColumn("f", similarity.batch_features(names)("q_terms", "d_terms"))
    return rows.select("q_id", "d_id", *[r6(F.col(f"f.{n}")).alias(n) for n in names])


@query
def jaro_features(spark, d):
    return arrow_part(spark, d, [f"jaro_{k}" for k in range(1, 6)])


@query
def jaro_winkler_features(spark, d):
    return arrow_part(spark, d, [f"jaro_win_{k}" for k in range(1, 6)])


@query
def lcs_features(spark, d):
    return arrow_part(spark, d, [*(f"lcsseq_{k}" for k in range(1, 6)), "lcsseq", "lcsstr"])


@query
def fuzzy_ratio_features(spark, d):
    return arrow_part(spark, d, ["fuzz_ratio", "fuzz_partial_ratio", "fuzz_token_sort_ratio", "fuzz_token_set_ratio"])


@query
def soft_token_features(spark, d):
    return arrow_part(spark, d, list(similarity.TOKENS))


@query
def extra_pair_features(spark, d):
    return arrow_part(spark, d, similarity.EXTRA_NAMES)


@query
def all_pair_features(spark, d):
    return similarity.pair_features(name_pairs(spark, d)).drop("q_terms", "d_terms")


# vectors


@query
def tfidf_cosine(spark, d):
    weights = vectors.tfidf(indexed(spark, d).where(F.size("terms") > 0))
    pairs = weights.select(F.col("id").alias("q"), (F.col("id") + 1).alias("d")).join(weights.select(F.col("id").alias("d")), "d", "left_semi")
    return vectors.paired_distance(pairs, weights).select("q", "d", r6("distance").alias("distance"))


@query
def embedding_cosine_topk(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(rows.where("vec_id % 100 = 0"), rows, 10)


@query
def embedding_pair_stats(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    means = vectors.mean_vector(rows, "label", "embedding")
    return rows.join(joins.small(means), "label").select("vec_id", r6(1 - vectors.cosine(F.col("embedding"), F.col("mean"))).alias("distance"))


@query
def embedding_set_distances(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    sets = rows.groupBy((F.floor(F.col("vec_id") / 50)).alias("g")).agg(F.collect_list("embedding").alias("vs"))
    q, t = sets.withColumnRenamed("vs", "q"), sets.select((F.col("g") - 1).alias("g"), F.col("vs").alias("t"))
    return q.join(t, "g").select("g", *[r6(c).alias(n) for n, c in vectors.set_distances(F.col("q"), F.col("t")).items()])


def word_table(spark, d) -> DataFrame:
    """A vector for each word of the names that begins with no b: its first and last letters and its length."""
    word = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct().where("word NOT LIKE 'b%'")
    return word.select("word", F.array(F.ascii("word") - 96, F.ascii(F.right("word", F.lit(1))) - 96, F.length("word")).cast("array<double>").alias("vector"))


@query
def known_words(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("tokens"))
    return features.known_tokens(rows, ["p_partkey"], word_table(spark, d)).select("p_partkey", F.array_join("tokens", " ").alias("known"))


@query
def pair_dataset(spark, d):
    pairs = name_pairs(spark, d)
    rows = pairs.select(
        F.col("q_id").alias("qid"), F.lit(None).cast("long").alias("synid"), F.col("d_id").alias("fid"), ((F.col("q_id") + F.col("d_id")) % 2).cast("int").alias("target"),
        F.round(F.size(F.array_intersect("q_terms", "d_terms")) / F.size("q_terms"), 6).alias("score"), F.pmod(F.col("d_id"), F.lit(20)).cast("int").alias("ix"), "q_terms", "d_terms")
    names = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.split("p_name", " ").alias("terms"))
    weights, held = vectors.tfidf(names), features.token_vectors(names, ["id"], word_table(spark, d), "terms")
    side = lambda f: f.withColumnRenamed("id", "qid").withColumn("synid", F.lit(None).cast("long"))
    distances = [
        features.tfidf_distances(rows, side(weights), weights.withColumnRenamed("id", "fid")),
        features.vector_distances(rows, side(held), held.withColumnRenamed("id", "fid"))]
    out = features.pair_dataset(rows, distances, {"length": similarity.length_features, "token_set": similarity.token_set_features}, arrow=False)
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# ranking data


@query
def group_has_both(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("qid"), "doc_id", F.col("toxic").alias("target"))
    return ranking.mixed_groups(rows, ["qid"]).select("qid", "doc_id", "target")


@query
def standard_scale(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    scaled = ranking.standard_scale(rows, ["l_quantity", "l_extendedprice"])
    return scaled.select("l_orderkey", "l_linenumber", r6("l_quantity").alias("quantity"), r6("l_extendedprice").alias("price"))


def ranked_items(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("target"), "l_quantity", "l_discount")


@query
def letor_rows(spark, d):
    rows = ranking.number_groups(ranked_items(spark, d), ["l_orderkey"])
    return rows.select("group_no", "l_linenumber", ranking.letor_line(F.col("target"), F.col("group_no"), [F.col("l_quantity"), F.col("l_discount")]).alias("line"))


@query
def group_sizes(spark, d):
    rows = ranking.number_groups(ranked_items(spark, d), ["l_orderkey"])
    return rows.groupBy("group_no").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("positives"))


@query
def list_truncate(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    return ranking.truncate_lists(rows, ["l_orderkey"], order, 3).select("l_orderkey", "l_linenumber", "l_quantity")


@query
def list_discards(spark, d):
    sizes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("lists"), F.sum("n").alias("docs"), F.sum(F.greatest(F.col("n") - 3, F.lit(0))).alias("discarded"))


# evaluation


def judged(spark, d) -> DataFrame:
    """Labelled documents with a rule's score: a stand-in for a model's probability."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    score = F.round(F.pmod(F.col("n_chars") * 37 + F.col("doc_id") * 11, F.lit(1000)) / 1000.0, 3)
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "source", F.col("toxic").alias("target"), "quality", score.alias("prob"))


@query
def dcg_ndcg_at_k(spark, d):
    return metrics.ndcg(judged(spark, d), ["source"], "target", "prob", "doc_id").select("source", "k", r6("dcg").alias("dcg"), r6("ndcg").alias("ndcg"))


@query
def mean_ndcg(spark, d):
    return metrics.mean_ndcg(metrics.ndcg(judged(spark, d), ["source"], "target", "prob", "doc_id", method=0))


@query
def first_relevant(spark, d):
    return metrics.first_relevant(judged(spark, d), ["source"], "target", "prob", "doc_id")


@query
def ordered_pair_accuracy(spark, d):
    return metrics.ordered_pairs(judged(spark, d), ["source"], "target", "prob", "doc_id").select("source", "pairs", "correct", r6(F.try_divide("correct", "pairs")).alias("opa"))


@query
def arp(spark, d):
    return metrics.average_relevant_place(judged(spark, d), ["source"], "target", "prob", "doc_id").select("source", r6("arp").alias("arp"))


@query
def classification_report(spark, d):
    return metrics.report(judged(spark, d), "target", "prob")


@query
def confusion(spark, d):
    return metrics.confusion(judged(spark, d), "target", "prob")


@query
def pr_curve(spark, d):
    return metrics.pr_curve(judged(spark, d), "target", "prob").select("threshold", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query
def pr_curve_ap(spark, d):
    return metrics.average_precision(metrics.pr_curve(judged(spark, d), "target", "prob"))


@query
def abstain_curve(spark, d):
    scale = metrics.recall_scale(sampling.label(candidates(spark, d), truth(spark, d)))
    out = metrics.abstention_curve(judged(spark, d), ["source"], "target", "prob", "doc_id", scale=scale)
    return out.select("topn", "threshold", "tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "mean_precision")])


@query
def type_errors(spark, d):
    return metrics.type_errors(judged(spark, d), "target", "prob").select("doc_id", "prob", "target", "error_type")


@query
def prob_histogram(spark, d):
    return metrics.histogram(judged(spark, d), "target", "prob").select("target", "bin", "n", r6("density").alias("density"))


@query
def group_best_prob(spark, d):
    return judged(spark, d).groupBy("source").agg(F.max("prob").alias("best"), F.max("target").alias("has"))


@query
def match_share(spark, d):
    return metrics.match_share(judged(spark, d), ["source"]).select(r6("share").alias("share"))


@query
def describe_prob(spark, d):
    rows = judged(spark, d)
    quartiles = {f"q{k}": r6(F.lit(v).cast("double")) for k, v in enumerate(quantiles(rows, "prob", [0.25, 0.5, 0.75]), 1)}
    whole = rows.agg(F.count("prob").alias("n"), r6(F.avg("prob")).alias("mean"), r6(F.stddev_samp("prob")).alias("std"), F.min("prob").alias("lo"), F.max("prob").alias("hi"))
    return whole.select("n", "mean", "std", "lo", *[c.alias(n) for n, c in quartiles.items()], "hi")


@query
def precision_at_cut(spark, d):
    return judged(spark, d).where("prob > 0.8").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("target")).alias("precision"))


@query
def org_frequencies(spark, d):
    counts = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.join(F.broadcast(total)).select("source", "n", r6(F.col("n") / F.col("t")).alias("freq")).orderBy(F.desc("n"), "source").limit(40)


@query
def size_classes(spark, d):
    sizes = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("n").agg(F.count(F.lit(1)).alias("orgs"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("members"))


@query
def watch_list(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return judged(spark, d).join(docs, "doc_id").orderBy("source", "target", F.desc("prob"), "doc_id").select("source", "doc_id", "target", "prob", "text")


@query
def error_sheet(spark, d):
    pairs = metrics.type_errors(judged(spark, d), "target", "prob").select(F.col("doc_id").alias("qid"), F.lit(None).cast("long").alias("synid"), F.col("doc_id").alias("fid"), "prob", "target", "error_type")
    docs = table(spark, d, "documents")
    sheet = entities.error_sheet(pairs, docs.select(F.col("doc_id").alias("qid"), F.lit(None).cast("long").alias("synid"), F.col("source").alias("text")), docs.select(F.col("doc_id").alias("fid"), "text"))
    return sheet.select("qid", "fid", "prob", "target", "error_type", "q", "d")


# models

for _name, _model in models.QUERIES.items():
    QUERIES[_name] = _model
