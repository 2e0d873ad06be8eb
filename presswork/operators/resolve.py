"""From what a user typed to a query key: numbers, names, topics, and at last the texts of articles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions import text
from presswork.sources.logs import staged

Search = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def numeric_key(asked: Column) -> Column:
    """Whole numbers with single blanks between them; null if anything else was typed."""
    flat = F.trim(F.regexp_replace(asked, r"\s+", " "))
    return F.when(flat.rlike("^[0-9]+( [0-9]+)*$"), flat)


def _rarest(pieces: DataFrame, index: DataFrame) -> DataFrame:
    """(piece, gram): of each piece's trigrams (or the piece itself, if it is shorter) the one that the fewest rows of the
    index hold; none if one of them is in no row. index: row, gram, each pair once."""
    grams = pieces.select("piece", F.explode(text.trigrams(F.col("piece"))).alias("gram"))
    counts = index.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    known = grams.join(counts, "gram", "left").groupBy("piece").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("gram"), F.min(F.coalesce("df", F.lit(0))).alias("df"))
    return known.where("df > 0").select("piece", "gram")


def matches(asks: DataFrame, names: DataFrame, name: str, key: list[str]) -> DataFrame:
    """(ask, key, pass) of the names that hold what was asked, whatever the case; pass is the strictest that fits (1: the
    whole name, 2: its beginning, 3: another stretch).

    A text that is asked for by many is looked up once, by its rarest trigram; names are indexed by their stretches of up
    to three characters, so the index grows with their length.
    """
    asked = asks.select("ask", F.lower(F.trim("asked")).alias("piece")).where("piece <> ''")
    held = names.where(F.length(name) > 0).select(*{*key, name}).distinct().withColumn("_name", F.lower(name))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length("_name") - (n - 1)), lambda i: F.substring(F.col("_name"), i, F.lit(n)))
    every = [F.when(F.length("_name") >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]
    index = held.select(*key, "_name", F.explode(F.array_distinct(F.concat(*every))).alias("gram"))
    wanted = _rarest(asked.select("piece").distinct(), index)
    fits = F.when(F.col("_name") == F.col("piece"), 1).when(F.startswith("_name", F.col("piece")), 2).when(F.contains("_name", F.col("piece")), 3)
    met = wanted.join(index, "gram").withColumn("pass", fits).where("pass IS NOT NULL")
    return asked.join(met.groupBy("piece", *key).agg(F.min("pass").alias("pass")), "piece").select("ask", *key, "pass")


def of_each_text(stage: Callable[..., DataFrame], asks: DataFrame, *others) -> DataFrame:
    """What a stage finds for each ask, of whose text alone it depends: each text is looked up once, whoever asks for it."""
    texts = asks.where("asked is not null").select("asked").distinct()
    found = stage(texts.select(F.col("asked").alias("ask"), "asked"), *others).withColumnRenamed("ask", "asked")
    return asks.select("ask", "asked").join(found, "asked").drop("asked")


def best(rows: DataFrame, group: str, order: list) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_k = 1").drop("_k")


def by_display_name(asks: DataFrame, query_map: DataFrame) -> DataFrame:
    """(ask, query_key): of the first pass with any match, the key that most rows match; ties by key.

    query_map: row, query_key, display_query.
    """
    shown = query_map.select("row", "query_key", "display_query").distinct().groupBy("query_key", "display_query").agg(F.count("*").alias("rows"))
    shown = shown.withColumn("_shown", F.col("display_query"))
    met = matches(asks, shown, "display_query", ["query_key", "rows", "_shown"]).groupBy("ask", "pass", "query_key").agg(F.sum("rows").alias("n"))
    return best(met, "ask", ["pass", F.col("n").desc(), "query_key"]).select("ask", "query_key")


def best_key_of_topics(rows: DataFrame, query_map: DataFrame, group: list[str]) -> DataFrame:
    """(group, query_key, score): each key's largest score among the group's topics. rows: group, topic_id."""
    return rows.join(query_map.select("topic_id", "query_key", "score"), "topic_id").groupBy(*group, "query_key").agg(F.max("score").alias("score"))


def by_topic_name(asks: DataFrame, topics: DataFrame, query_map: DataFrame, most: int = 20) -> DataFrame:
    """(ask, query_key): the key of largest score among the topics that the first pass with any key matches.

    topics: topic_id, display_name, news_count. A pass looks at the `most` largest topics that it matches, and holds
    those of stricter passes.
    """
    return of_each_text(_by_topic_name, asks, topics, query_map, most)


def _by_topic_name(asks: DataFrame, topics: DataFrame, query_map: DataFrame, most: int) -> DataFrame:
    met = matches(asks, topics, "display_name", ["topic_id", "news_count"]).withColumn("pass", F.explode(F.sequence("pass", F.lit(3))))
    place = F.row_number().over(Window.partitionBy("ask", "pass").orderBy(F.col("news_count").desc(), "topic_id"))
    met = met.withColumn("place", place).where(F.col("place") <= most)
    keys = best_key_of_topics(met.select("ask", "pass", "topic_id"), query_map, ["ask", "pass"])
    return best(keys, "ask", ["pass", F.col("score").desc(), "query_key"]).select("ask", "query_key")


def holding(terms: DataFrame, rows: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """(ask, id) of the rows with one of the ask's terms (three characters or more) in a column.

    Each term is looked up once, by its rarest trigram among all rows; only ids are joined on it, and the texts come in for
    the pairs of a term and a row that are left.
    """
    texts = rows.select(id_col, *(F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in columns))
    index = texts.select(id_col, F.explode(F.array_distinct(F.concat(*(text.trigrams(F.col(c)) for c in columns)))).alias("gram"))
    asked = terms.select("ask", F.explode("terms").alias("piece"))
    pairs = _rarest(asked.select("piece").distinct(), index).join(index, "gram").select("piece", id_col)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.col(c), F.col("piece"))
    found = pairs.join(texts, id_col).where(hit).select("piece", id_col).distinct()
    return asked.join(found, "piece").select("ask", id_col).distinct()


def by_article_text(asks: DataFrame, articles: DataFrame, article_topics: DataFrame, query_map: DataFrame) -> DataFrame:
    """(ask, query_key): the key of largest score among the topics of articles that hold the phrase or one of its tokens."""
    return of_each_text(_by_article_text, asks, articles, article_topics, query_map)


def _by_article_text(asks: DataFrame, articles: DataFrame, article_topics: DataFrame, query_map: DataFrame) -> DataFrame:
    """Articles of one title or abstract are one value with all their topics; terms are looked up in the values."""
    values = articles.select("article_id", F.explode(F.array(F.lower("title"), F.lower("abstract"))).alias("value")).join(article_topics.select("article_id", "topic_id"), "article_id").select("value", "topic_id").distinct()
    terms = asks.select("ask", F.explode(text.search_terms(F.col("asked"))).alias("piece"))
    pieces = terms.select(F.col("piece").alias("ask"), F.array("piece").alias("terms")).distinct()
    texts = values.select(F.col("value").alias("id"), "value").distinct()
    found = holding(pieces, texts, ["value"], "id").join(values, F.col("id") == F.col("value")).select(F.col("ask").alias("piece"), "topic_id").distinct()
    topics = terms.join(found, "piece").select("ask", "topic_id").distinct()
    return best(best_key_of_topics(topics, query_map, ["ask"]), "ask", [F.col("score").desc(), "query_key"]).select("ask", "query_key")


def resolve(asks: DataFrame, query_map: DataFrame, topics: DataFrame, articles: DataFrame, article_topics: DataFrame) -> DataFrame:
    """(ask, query_key, source): numbers as they are, else by display name, topic name or article text, the first that
    finds a key; query_key is null where none does. asks: ask, asked."""
    texts = asks.where("asked is not null").select(F.col("asked").alias("ask"), "asked").distinct()  # each is resolved once
    typed = texts.select("ask", "asked", numeric_key(F.col("asked")).alias("query_key"))
    words = typed.where("query_key is null").select("ask", "asked")
    stages = [
        typed.where("query_key is not null").select("ask", "query_key"),
        by_display_name(words, query_map), by_topic_name(words, topics, query_map), by_article_text(words, articles, article_topics, query_map),
    ]
    found = None
    for k, stage in enumerate(stages):
        one = stage.withColumn("stage", F.lit(k))
        found = one if found is None else found.unionByName(one)
    first = found.groupBy("ask").agg(F.min_by("query_key", "stage").alias("query_key"), F.min("stage").alias("stage"))
    source = F.when(F.col("stage").isNull(), "unresolved").when(F.col("stage") == 0, "numeric_query_key").otherwise("lexical_v1")
    return asks.select("ask", "asked").join(first.withColumnRenamed("ask", "asked"), "asked", "left").select("ask", "query_key", source.alias("source"))


def exact_alias(asks: DataFrame, query_map: DataFrame, topics: DataFrame, most: int = 20) -> DataFrame:
    """(ask, query_key): by a display query that is what was asked, whatever the case, else by a topic's name that is.

    Of several keys the one with most rows, or the largest score among the `most` largest topics; ties by key.
    """
    asked = asks.select("ask", F.lower(F.trim("asked")).alias("name")).where("name <> ''")
    shown = asked.join(query_map.select(F.lower("display_query").alias("name"), "query_key"), "name").groupBy("ask", "query_key").agg(F.count("*").alias("n"))
    shown = best(shown, "ask", [F.col("n").desc(), "query_key"]).select("ask", "query_key", F.lit(0).alias("stage"))
    named = asked.join(topics.select(F.lower("display_name").alias("name"), "topic_id", "news_count"), "name")
    named = named.withColumn("place", F.row_number().over(Window.partitionBy("ask").orderBy(F.col("news_count").desc(), "topic_id"))).where(F.col("place") <= most)
    keyed = best(best_key_of_topics(named.select("ask", "topic_id"), query_map, ["ask"]), "ask", [F.col("score").desc(), "query_key"]).select("ask", "query_key", F.lit(1).alias("stage"))
    return shown.unionByName(keyed).groupBy("ask").agg(F.min_by("query_key", "stage").alias("query_key"))


def exact_topic(asks: DataFrame, topics: DataFrame) -> DataFrame:
    """(ask, topic_id): the topic whose name is what was asked, whatever the case; of several the largest, then the least."""
    asked = asks.select("ask", F.lower(F.trim("asked")).alias("name")).where("name <> ''")
    named = asked.join(topics.select(F.lower("display_name").alias("name"), "topic_id", "news_count"), "name")
    return best(named, "ask", [F.col("news_count").desc(), "topic_id"]).select("ask", "topic_id")


def vote_of_hits(hits: DataFrame, article_topics: DataFrame, query_map: DataFrame, most: int = 10) -> DataFrame:
    """(ask, query_key): the `most` best hits vote for their topics with their fused scores, a topic of a further source
    counting a quarter more; the key whose row has the largest vote times score wins (then the least match_rank, then
    the key). If no key knows these topics, the first topic of the best hit that has one is the key.

    hits: ask, doc, fusion, rank. article_topics: article_id, topic_id, source_rank.
    """
    top = hits.where(F.col("rank") <= most).select("ask", F.col("doc").alias("article_id"), F.greatest("fusion", F.lit(1e-9)).alias("vote"), "rank")
    voted = top.join(article_topics, "article_id")
    share = F.col("vote") * F.when(F.col("source_rank") > 0, 1.25).otherwise(1.0)
    votes = voted.groupBy("ask", "topic_id").agg(F.round(F.sum(share), 12).alias("vote"))
    keys = votes.join(query_map.select("topic_id", "query_key", "score", "match_rank"), "topic_id").withColumn("score", F.round(F.col("vote") * F.col("score"), 12))
    known = best(keys, "ask", [F.col("score").desc(), "match_rank", "query_key"]).select("ask", "query_key", F.lit(0).alias("stage"))
    # the topics of the best hit come before those of the others, and these in order of their ids
    ahead = F.struct((F.col("rank") > 1).alias("later"), "article_id", "source_rank", "topic_id")
    first = voted.groupBy("ask").agg(F.min(ahead)["topic_id"].cast("string").alias("query_key")).withColumn("stage", F.lit(1))
    return known.unionByName(first).groupBy("ask").agg(F.min_by("query_key", "stage").alias("query_key"))


def resolve_hybrid(asks: DataFrame, query_map: DataFrame, topics: DataFrame, article_topics: DataFrame, search: Search) -> DataFrame:
    """(ask, query_key, source, confidence): numbers as they are, then exact names; what is still open is searched for,
    and if the search is to be trusted, its hits' topics vote.

    search: a batch of asks (ask, asked) -> hits (query, doc, fusion, rank) and verdicts (query, dense, accepted). Only
    asks that no earlier stage has answered reach it. source is numeric_query_key, exact_alias, hybrid_v1, or why there is
    no key: blank, rejected (the gate, or no hit) or unresolved (hits without a topic). confidence is 1, or that of the
    best vector hit.
    """
    typed = asks.select("ask", "asked", numeric_key(F.col("asked")).alias("query_key"))
    numbers = typed.where("query_key is not null").select("ask", "query_key", F.lit("numeric_query_key").alias("source"), F.lit(1.0).alias("confidence"))
    words = typed.where("query_key is null").select("ask", "asked")
    alias = staged(exact_alias(words, query_map, topics), "aliases").select("ask", "query_key", F.lit("exact_alias").alias("source"), F.lit(1.0).alias("confidence"))
    blank = words.where(F.coalesce(F.trim("asked"), F.lit("")) == "").select("ask", F.lit(None).cast("string").alias("query_key"), F.lit("blank").alias("source"), F.lit(None).cast("double").alias("confidence"))
    open_ = words.where(F.coalesce(F.trim("asked"), F.lit("")) != "").join(alias.select("ask"), "ask", "left_anti")
    open_ = staged(open_, "open-asks")
    hits, verdicts = search(open_)
    sure = verdicts.where("accepted").select(F.col("query").alias("ask"), F.col("dense").alias("_dense"))
    voted = vote_of_hits(hits.join(sure.select(F.col("ask").alias("query")), "query", "left_semi").withColumnRenamed("query", "ask"), article_topics, query_map)
    state = F.when(F.col("_dense").isNull(), "rejected").when(F.col("query_key").isNull(), "unresolved").otherwise("hybrid_v1")
    found = open_.select("ask").join(sure, "ask", "left").join(voted, "ask", "left").select("ask", "query_key", state.alias("source"), F.when(F.col("query_key").isNotNull(), F.col("_dense")).alias("confidence"))
    return numbers.unionByName(alias).unionByName(blank).unionByName(found)


def alias_topic(asks: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ask, topic_id, pass): the least topic of the first pass that matches an alias. aliases: alias, topic_id."""
    least = aliases.groupBy("alias").agg(F.min("topic_id").alias("topic_id"))  # no other of a name can be the least
    return of_each_text(lambda texts: best(matches(texts, least, "alias", ["topic_id"]), "ask", ["pass", "topic_id"]), asks)


def lexical_baseline(asks: DataFrame, aliases: DataFrame, articles: DataFrame, article_topics: DataFrame, limit: int) -> DataFrame:
    """(ask, topic_id, article_id, score, rank): articles of the alias's topic at 1.0, and those that hold the words at
    their lexical score. Without an alias the topic is the least of the matching articles'."""
    return of_each_text(_lexical_baseline, asks, aliases, articles, article_topics, limit)


def _lexical_baseline(asks: DataFrame, aliases: DataFrame, articles: DataFrame, article_topics: DataFrame, limit: int) -> DataFrame:
    """Articles of equal title and abstract are scored once, as a class; the first `most` articles lie in the first `most`
    classes in order of score and least article, and among the `most` least articles of each."""
    most = max(limit * 20, 50)
    ranked = F.row_number().over(Window.partitionBy("title", "abstract").orderBy("article_id"))
    own = articles.select("article_id", "title", "abstract").withColumn("_k", ranked).where(F.col("_k") <= most)
    classes = own.groupBy("title", "abstract").agg(F.min("article_id").alias("first"), F.sort_array(F.collect_list("article_id")).alias("ids"))
    terms = asks.select("ask", text.search_terms(F.col("asked")).alias("terms"))
    met = holding(terms, classes.select("first", "title", "abstract"), ["title", "abstract"], "first").join(terms, "ask").join(classes, "first")
    met = met.select("ask", "first", "ids", text.lexical_score(F.col("terms"), F.col("title"), F.col("abstract")).alias("score"))
    place = lambda item: F.row_number().over(Window.partitionBy("ask").orderBy(F.col("score").desc(), item))
    met = met.withColumn("place", place("first")).where(F.col("place") <= most).select("ask", F.explode("ids").alias("article_id"), "score")
    met = met.withColumn("place", place("article_id")).where(F.col("place") <= most).drop("place")
    least = met.join(article_topics, "article_id").groupBy("ask").agg(F.min("topic_id").alias("_least"))
    topic = asks.select("ask").join(alias_topic(asks, aliases).select("ask", "topic_id"), "ask", "left").join(least, "ask", "left")
    topic = topic.select("ask", F.coalesce("topic_id", "_least").alias("topic_id")).where("topic_id is not null")
    # of a topic's articles, all at 1.0, only the first by id can be among the best
    of_topic = article_topics.select("topic_id", "article_id").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("topic_id").orderBy("article_id"))).where(F.col("_k") <= limit).drop("_k")
    whole = topic.join(of_topic, "topic_id").select("ask", "article_id", F.lit(1.0).alias("score"))
    scored = whole.unionByName(met).groupBy("ask", "article_id").agg(F.max("score").alias("score")).join(topic, "ask")
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.col("score").desc(), "article_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)
