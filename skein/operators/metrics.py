"""Retrieval metrics over (qid, pos, doc) predictions and (qid, doc) gold rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hits(pred: DataFrame, gold: DataFrame) -> DataFrame:
    return pred.join(gold.select("qid", "doc").distinct().withColumn("hit", F.lit(1)), ["qid", "doc"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def ranking_metrics(pred: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """By query: precision (of k), recall (by place), NDCG and reciprocal rank; zeros without predictions."""
    size = gold.groupBy("qid").agg(F.count_distinct("doc").alias("n_gold"))
    h = _hits(pred, gold)
    top = h.groupBy("qid").agg(
        F.sum(F.when(F.col("pos") <= k, F.col("hit")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("pos") <= k, F.col("hit") / F.log2(F.col("pos") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("hit") == 1, F.col("pos"))).alias("first"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    x = size.join(top, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return x.select(
        "qid", F.round(zero(F.col("hits") / k), 6).alias("precision"), F.round(zero(F.col("hits") / F.col("n_gold")), 6).alias("recall"),
        F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"), F.round(zero(1 / F.col("first")), 6).alias("mrr"),
    )


def macro_average(by_query: DataFrame) -> DataFrame:
    return by_query.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "ndcg", "mrr")))


def set_metrics(pred: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """By query: recall on sets, precision of the top-k's length, F1; rounded to four places."""
    top = pred.filter(F.col("pos") <= k)
    size = gold.groupBy("qid").agg(F.count_distinct("doc").alias("n_gold"))
    got = _hits(top, gold).groupBy("qid").agg(F.count(F.lit(1)).alias("shown"), F.count_distinct(F.when(F.col("hit") == 1, F.col("doc"))).alias("hits"))
    p, r = F.coalesce(F.col("hits") / F.col("shown"), F.lit(0.0)), F.coalesce(F.col("hits") / F.col("n_gold"), F.lit(0.0))
    return size.join(got, "qid", "left").select("qid", F.round(r, 4).alias("recall"), F.round(p, 4).alias("precision"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"))


def pooled_recall(pred: DataFrame, gold: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """(k, recall): the mean over all queries (qid) of recall on sets among the first k, rounded to four places; 0 for a query without gold."""
    ks = sorted(set(ks))
    need = gold.select("qid", "doc").distinct()
    first = need.join(pred.groupBy("qid", "doc").agg(F.min("pos").alias("first")), ["qid", "doc"], "left")
    by = first.groupBy("qid").agg(*((F.count_if(F.col("first") <= k) / F.count(F.lit(1))).alias(f"r{k}") for k in ks))
    means = queries.select("qid").distinct().join(by, "qid", "left").agg(*(F.avg(F.coalesce(f"r{k}", F.lit(0.0))).alias(f"r{k}") for k in ks))
    return means.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.round(F.coalesce(f"r{k}", F.lit(0.0)), 4).alias("recall")) for k in ks))))


def hit_classes(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(class, n): queries by how many entries of their list are gold, against the length of their gold list.

    Lists count, not sets: an entry that is shown twice hits twice, and a gold text that is there twice must be hit twice.
    """
    wanted = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    hits = pred.join(gold.select("qid", "doc").distinct(), ["qid", "doc"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    x = wanted.join(hits, "qid", "left").select(F.coalesce("hits", F.lit(0)).alias("hits"), "n_gold")
    kind = F.when(F.col("hits") == 0, "zero").when(F.col("hits") < F.col("n_gold"), "partial").otherwise("full")
    return x.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def recall_class(recall: Column) -> Column:
    return F.when(recall >= 1, "full").when(recall > 0, "partial").otherwise("zero")


def cumulative(by_query: DataFrame, batch: int) -> DataFrame:
    """Running means of recall at each batch boundary; (qid, recall), with a dense place n from 1.

    Batches are summed first, so the running total passes one row for each batch through a task.
    """
    per = by_query.groupBy(F.floor((F.col("n") - 1) / batch).alias("batch")).agg(F.count(F.lit(1)).alias("c"), F.sum("recall").alias("s"))
    w = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("batch", F.sum("c").over(w).alias("queries"), F.round(F.sum("s").over(w) / F.sum("c").over(w), 6).alias("mean_recall"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two methods' (qid, recall): means, their difference, rows that differ, queries without recall."""
    x = a.select("qid", F.col("recall").alias("a")).join(b.select("qid", F.col("recall").alias("b")), "qid")
    return x.agg(
        F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("difference"),
        F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-9).alias("differing"), F.count_if(F.col("a") == 0).alias("zero_a"), F.count_if(F.col("b") == 0).alias("zero_b"),
    )


def align_questions(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, text) on both sides: equal normalised texts (the last of the right side), else the best word overlap above one half,
    else the questions and the gold rows that are left over, in the order of their ids.

    An overlap above one half of the longer side's words means a common word among each side's rarer half of words, so the
    candidates are joined on those (a prefix filter, which loses none) and then counted.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    a = left.select(F.col("id").alias("a"), norm(F.col("text")).alias("t"))
    every = right.select(F.col("id").alias("b"), norm(F.col("text")).alias("t"))
    b = every.groupBy("t").agg(F.max("b").alias("b"))
    exact = a.join(b, "t").select("a", "b", F.lit("exact").alias("how"))
    rest = a.join(exact, "a", "left_anti")
    words = lambda x, k: x.select(k, F.explode(F.array_distinct(F.split("t", " "))).alias("x"))
    often = words(b, "b").groupBy("x").agg(F.count(F.lit(1)).alias("n"))

    def prefixes(x: DataFrame, k: str) -> DataFrame:
        sorted_ = words(x, k).join(often, "x", "left").groupBy(k).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "x"))).alias("w"))
        sorted_ = sorted_.select(k, F.col("w.x").alias(f"w{k}"))
        return sorted_.withColumn("x", F.explode(F.slice(f"w{k}", F.lit(1), F.size(f"w{k}") - F.floor(F.size(f"w{k}") / 2).cast("int"))))

    pairs = prefixes(rest, "a").join(prefixes(b, "b"), "x").dropDuplicates(["a", "b"])
    score = F.size(F.array_intersect("wa", "wb")) / F.greatest(F.size("wa"), F.size("wb"))
    scored = pairs.withColumn("s", score).filter("s > 0.5")
    near = scored.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.col("s").desc(), "b"))).filter("_n = 1").select("a", "b", F.lit("overlap").alias("how"))
    matched = exact.union(near)
    ranked = lambda x, k: x.select(F.row_number().over(Window.orderBy(k)).alias("_n"), k)  # noqa: E731  ids of what no text matched
    place = ranked(rest.join(near, "a", "left_anti"), "a").join(ranked(every.select("b").join(matched, "b", "left_anti"), "b"), "_n")
    return matched.union(place.select("a", "b", F.lit("place").alias("how")))


def recall_by_index(pred: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(qid, pos, doc) against gold (qid, idx, doc): the share of gold rows whose text is, sign for sign, among the first k. Equal gold texts count each."""
    top = pred.filter(F.col("pos") <= k).select("qid", "doc").distinct().withColumn("hit", F.lit(1))
    return gold.join(top, ["qid", "doc"], "left").groupBy("qid").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


def recall_table(pred: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """One row for each k: mean recall_by_index, how many queries have all, some or none, and the queries with none."""
    found = gold.join(pred.groupBy("qid", "doc").agg(F.min("pos").alias("first")), ["qid", "doc"], "left")
    by = found.groupBy("qid").agg(*((F.count_if(F.col("first") <= k) / F.count(F.lit(1))).alias(f"r{k}") for k in ks))
    rows = by.select("qid", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks))).alias("x")).select("qid", "x.k", "x.recall")
    share = recall_class(F.col("recall"))
    return rows.groupBy("k").agg(
        F.round(F.avg("recall"), 6).alias("mean_recall"), *(F.count_if(share == c).alias(c) for c in ("full", "partial", "zero")),
        F.array_sort(F.collect_list(F.when(share == "zero", F.col("qid")))).alias("without"),
    )


def truncate_pairs(pred: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides (qid dense from 0) cut to the shorter one's number of queries."""
    most = min(x.agg(F.max("qid")).first()[0] for x in (pred, gold))  # two numbers
    return pred.filter(F.col("qid") <= most), gold.filter(F.col("qid") <= most)


def stage_stats(chunks: DataFrame, events: DataFrame) -> DataFrame:
    """Chunks, events, and events for each chunk, rounded to two places."""
    n, m = chunks.agg(F.count(F.lit(1)).alias("chunks")), events.agg(F.count(F.lit(1)).alias("events"))
    return n.join(F.broadcast(m)).withColumn("events_per_chunk", F.round(F.when(F.col("chunks") > 0, F.col("events") / F.col("chunks")).otherwise(0.0), 2))


def index_range(df: DataFrame, index: str, first: int, last: int) -> DataFrame:
    """Rows whose index lies in first..last, both included."""
    return df.filter(F.col(index).between(first, last))


def gold_documents(questions: DataFrame, style: str) -> DataFrame:
    """(qid, idx, doc): the supporting documents of each question as 'title\ncontent'.

    joined, spaced: context documents whose title supports, sentences joined without or with a space; paragraphs: the supporting
    paragraphs; stripped: paragraphs if there are any, else each supporting title once, its sentences stripped and joined by
    spaces, empty ones dropped. Any other style has no gold documents.
    """
    strings = "array<string>"
    context = F.transform("context", lambda c: F.struct(c[0].alias("title"), F.coalesce(F.from_json(c[1], strings), F.array(c[1])).alias("sentences")))
    supporting = F.transform("supporting_facts", lambda f: f[0])
    text = lambda t, c: F.concat(t, F.lit("\n"), c)
    paragraphs = F.transform(F.filter("paragraphs", lambda p: F.coalesce(p["is_supporting"], F.lit(False))), lambda p: text(F.coalesce(p["title"], F.lit("")), F.coalesce(p["paragraph_text"], F.lit(""))))
    if style in ("joined", "spaced"):
        sep = "" if style == "joined" else " "
        docs = F.transform(F.filter(context, lambda c: F.array_contains(supporting, c["title"])), lambda c: text(c["title"], F.array_join(c["sentences"], sep)))
    elif style == "paragraphs":
        docs = paragraphs
    elif style == "stripped":
        strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
        last = lambda t: F.element_at(F.filter(context, lambda c: c["title"] == t), -1)
        body = F.transform(F.filter(F.array_distinct(supporting), lambda t: F.exists(context, lambda c: c["title"] == t)), lambda t: F.struct(t.alias("t"), strip(F.array_join(F.transform(last(t)["sentences"], strip), " ")).alias("c")))
        facts = F.transform(F.filter(body, lambda x: (x["t"] != "") & (x["c"] != "")), lambda x: text(x["t"], x["c"]))
        docs = F.when(F.coalesce(F.size("paragraphs"), F.lit(0)) > 0, paragraphs).otherwise(facts)
    else:
        docs = F.array().cast(strings)
    qid = F.coalesce(F.nullif("id", F.lit("")), F.col("_id"))
    return questions.select(qid.alias("qid"), F.posexplode(docs).alias("idx", "doc"))
