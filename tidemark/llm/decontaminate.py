"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Test items are cut into phrases of ``window`` words; an item of fewer words is one phrase. Phrases with
the same words are one phrase with several items.

1. Every test term's frequency in the training texts is counted (combined inside the map tasks).
2. The index keeps postings (term, document, position) of the terms that phrases ask for: the two
   rarest of each phrase.
3. The rarest term's list, less the term's offset, gives the phrase starts that could be; it is
   intersected with the second term's list at its offset.
4. What is left is compared with the words of the text: exactly for phrases, or for proximity with all
   terms inside ``slop`` words around the rarest one.

Terms and phrases are broadcast only if counted to at most ``BROADCAST_ROWS``; beyond it they are
joined by shuffle, and adaptive execution splits frequent terms.

Defined results: words are those of the lower-cased (A-Z only) text; a null text has none; items
without words never occur; rows that share an id are told apart by their texts and identical rows get
the same result each; null ids are kept; extra columns are left out; empty
tables give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cascade import let
from tidemark.llm.stage import stored

WINDOW = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    # lower() is right, and much faster, where a text has no other letters than ASCII
    lowered = F.when(F.octet_length(plain) == F.length(plain), F.lower(plain)).otherwise(F.translate(plain, UPPER, LOWER))
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def bounded(rows: DataFrame) -> DataFrame:
    """``rows`` with a broadcast hint where they are counted to be few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text hash (rows that share an id differ there) and text; null ids get a key of their own."""
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text")


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, version, position, term of every word of keyed documents."""
    return docs.select("doc_id", "version", F.posexplode(words_of(F.col("text"))).alias("position", "term"))


def item_phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """phrase (its hash), words, item_id of every window of every item."""
    cut = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    listed = cut.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), F.lit(window)).alias("words"))
    return listed.select(F.xxhash64("words").alias("phrase"), "words", "item_id").distinct()


def rarest_terms(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, n, term and offset of the rarest term, and of the second (term2, offset2; null for one word)."""
    # a phrase of several items stands once a word
    different = phrases.select("phrase", "words").dropDuplicates(["phrase"])
    listed = different.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term"))
    wanted = bounded(listed.select("term").distinct())
    seen = tokens(docs).join(wanted, "term").groupBy("term").agg(F.count("*").alias("times"))
    # at most ``window`` rows a phrase
    ranked = listed.join(seen, "term").groupBy("phrase", "n").agg(F.sort_array(F.collect_list(F.struct("times", "offset", "term"))).alias("r"))
    # a phrase with a term that never stands in the texts can't occur
    return ranked.where(F.size("r") == F.col("n")).select(
        "phrase", "n", F.col("r")[0]["term"].alias("term"), F.col("r")[0]["offset"].alias("offset"),
        F.get("r", F.lit(1))["term"].alias("term2"), F.get("r", F.lit(1))["offset"].alias("offset2"),
    )


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: term, doc_id, version, position of the asked terms."""
    return stored(tokens(docs).join(bounded(terms.distinct()), "term").select("term", "doc_id", "version", "position").distinct(), "postings")


def candidates(index: DataFrame, rarest: DataFrame) -> DataFrame:
    """phrase, doc_id, version, start: places where both rarest terms stand at their offsets."""
    asked = bounded(rarest)
    first = index.join(asked, "term").withColumn("start", F.col("position") - F.col("offset")).where("start >= 0").drop("term", "position")
    one = first.where("term2 is null").select("phrase", "doc_id", "version", "start")
    second = index.select(F.col("term").alias("term2"), F.col("doc_id").alias("id2"), F.col("version").alias("version2"), F.col("position").alias("at2"))
    same = F.expr("a.term2 = b.term2 and a.at2 = b.at2 and a.version = b.version2 and a.doc_id <=> b.id2")
    two = first.where("term2 is not null").withColumn("at2", F.col("start") + F.col("offset2"))
    both = two.alias("a").join(second.alias("b"), same).select("a.phrase", "a.doc_id", "a.version", "a.start")
    return one.unionByName(both)


def _with_words(found: DataFrame, docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Per document: the candidate list and the text's words."""
    words = phrases.select("phrase", "words").dropDuplicates(["phrase"])
    lists = found.join(bounded(words), "phrase").groupBy("doc_id", "version").agg(
        F.collect_set(F.struct("phrase", "start", "words")).alias("tried")
    )
    return lists.alias("l").join(docs.alias("d"), F.expr("l.version = d.version and l.doc_id <=> d.doc_id")).select(
        "l.doc_id", "l.version", "l.tried", "d.text"
    )


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, phrase, start, n of exact matches; the phrases) for keyed documents."""
    phrases = item_phrases(items, window)
    rarest = stored(rarest_terms(docs, phrases), "rarest")
    index = postings(docs, rarest.select("term").unionByName(rarest.where("term2 is not null").select(F.col("term2").alias("term"))))
    joined = _with_words(candidates(index, rarest), docs, phrases)
    exact = let(
        words_of(F.col("text")),
        lambda w: F.filter("tried", lambda c: F.slice(w, c["start"] + 1, F.size(c["words"])) == c["words"]),
    )
    found = joined.select("doc_id", "version", F.explode(exact).alias("m")).select(
        "doc_id", "version", "m.phrase", F.col("m.start").alias("start"), F.size("m.words").alias("n")
    )
    return found.distinct(), phrases


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 20, window: int = WINDOW) -> DataFrame:
    """doc_id, version, phrase, position: all words of the phrase stand within ``slop`` words of its rarest one, in any order."""
    phrases = item_phrases(items, window)
    rarest = stored(rarest_terms(docs, phrases), "rarest")
    index = postings(docs, rarest.select("term"))
    near = index.join(bounded(rarest.select("phrase", "term")), "term").selectExpr("phrase", "doc_id", "version", "position as start")
    inside = let(
        words_of(F.col("text")),
        lambda w: F.filter("tried", lambda c: F.size(F.array_except(
            c["words"], F.slice(w, F.greatest(F.lit(1), c["start"] + 1 - slop), F.least(c["start"], F.lit(slop)) + slop + 1)
        )) == 0),
    )
    return _with_words(near, docs, phrases).select("doc_id", "version", F.explode(inside).alias("m")).select(
        "doc_id", "version", "m.phrase", F.col("m.start").alias("position")
    ).distinct()


def covered(spans: Column) -> Column:
    """Positions inside sorted (start, n) spans."""
    step = lambda s, x: F.struct(
        F.greatest(s["end"], x["start"] + x["n"]).alias("end"),
        (s["total"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(s["end"], x["start"]))).alias("total"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")), step)["total"]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, the sorted list of items, contaminated, and the ``version`` hash of its text."""
    named = keyed(docs)
    found, phrases = phrase_matches(named, items, window)
    found = stored(found, "matches")
    spans = found.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
    owners = found.select("doc_id", "version", "phrase").distinct().join(bounded(phrases.select("phrase", "item_id")), "phrase")
    lists = owners.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hits = spans.alias("s").join(lists.alias("i"), F.expr("s.version = i.version and s.doc_id <=> i.doc_id")).select(
        F.col("s.doc_id").alias("hit_id"), F.col("s.version").alias("hit_version"), covered(F.col("spans")).alias("n_hit"), "items"
    )
    sized = named.select("doc_id", "version", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return sized.join(hits, F.expr("version = hit_version and doc_id <=> hit_id"), "left").select(
        "doc_id", "version", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
