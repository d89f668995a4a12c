"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

Words are maximal runs of letters a-z (A-Z lower-cased), digits and characters
from U+0080 on. A benchmark item's windows are its runs of 13 words; an item
with fewer words is one window. Method:

1. count, over all documents, the words that occur in windows;
2. take each window's two rarest words (ties: the word, then the offset) as its
   anchors; a window with a word that no document has cannot occur;
3. index: write the postings (word, document, position) of the anchor words;
4. shift each posting by its anchor's offset and intersect the lists of a
   window's anchors: what both point to is a candidate start;
5. compare the candidate's words with the window's and mark the words inside.

A document is known by a hash of its id and text, so that a null id and ids that
rows share work; the anchors met are a set of bits, so that a row that occurs
twice counts none twice. Step 5 compares each row's own words, so two documents
of one hash cannot give a wrong hit.

Only anchors are indexed, never the frequent words of a window. Grouping is by
(window, document, start), so no word or passage gathers in one task. Lists of
words and candidates that come from the benchmark are broadcast up to a counted
limit and shuffled beyond it.

Defined results: a null or empty text has no words and is clean; an item
without words is ignored; repeated windows count once and repeated rows are
judged one by one, those with a null id too; empty tables give no hits or an empty table; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Rows of a word or id list that are broadcast at most (about 100 bytes each).
BROADCAST_ROWS = 500_000


def words(text: Column | str) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def counted(df: DataFrame) -> DataFrame:
    """Mark a list as broadcast if it is short enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(phrase, tokens, n, items): distinct windows with the items that have them."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), words(text_col).alias("w")).where(F.size("w") > 0)
    size = F.least(F.lit(width), F.size("w"))
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)))
    rows = rows.select("item", F.slice("w", F.col("start"), size).alias("tokens"))
    rows = rows.groupBy(F.array_join("tokens", " ").alias("phrase")).agg(F.first("tokens").alias("tokens"), F.collect_set("item").alias("items"))
    return rows.withColumn("n", F.size("tokens"))


def window_anchors(windows: DataFrame, frequencies: DataFrame, lists: int) -> DataFrame:
    """The ``lists`` (63 at most) rarest words of each window that can occur: (phrase, word, offset, bit)."""
    places = windows.select("phrase", F.posexplode("tokens").alias("offset", "word"))
    rated = places.join(frequencies, "word", "left")
    by = Window.partitionBy("phrase")
    rated = rated.withColumn("rank", F.row_number().over(by.orderBy(F.coalesce("frequency", F.lit(0)), "word", "offset")))
    rated = rated.withColumn("least", F.min(F.coalesce("frequency", F.lit(0))).over(by))
    return rated.where((F.col("rank") <= lists) & (F.col("least") > 0)).select("phrase", "word", "offset", F.expr("shiftleft(1L, rank - 1)").alias("bit"))


def frequencies(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences in all documents of each word of ``vocabulary``."""
    return docs.select(F.explode(words("text")).alias("word")).join(counted(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("frequency"))


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The index: (word, id, position) of every occurrence of ``vocabulary``."""
    places = docs.select("id", F.posexplode(words("text")).alias("position", "word"))
    return places.join(counted(vocabulary), "word", "left_semi").select("word", "id", "position")


def candidate_starts(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(phrase, id, start) to which all anchors of a window point."""
    shifted = index.join(counted(anchors), "word").select("phrase", "id", "bit", (F.col("position") - F.col("offset")).alias("start"))
    need = anchors.groupBy("phrase").agg(F.bit_or("bit").alias("need"))
    met = shifted.where("start >= 0").groupBy("phrase", "id", "start").agg(F.bit_or("bit").alias("met"))
    return met.join(counted(need), "phrase").where("met = need").select("phrase", "id", "start")


def proximity_matches(index: DataFrame, anchors: DataFrame, slack: int) -> DataFrame:
    """(phrase, id, start, other): anchors whose starts differ by ``slack`` at most.

    Starts meet in cells of slack + 1 words and their neighbours, an equi-join.
    """
    shifted = index.join(counted(anchors), "word").select("phrase", "id", "offset", (F.col("position") - F.col("offset")).alias("start"))
    lowest = anchors.groupBy("phrase").agg(F.min("offset").alias("lowest"))
    shifted = shifted.join(counted(lowest), "phrase").withColumn("cell", F.floor(F.col("start") / (slack + 1)))
    left = shifted.where("offset = lowest").select("phrase", "id", "start", F.explode(F.array(F.col("cell") - 1, "cell", F.col("cell") + 1)).alias("cell"))
    right = shifted.where("offset != lowest").select("phrase", "id", F.col("start").alias("other"), "cell")
    return left.join(right, ["phrase", "id", "cell"]).where(F.abs(F.col("start") - F.col("other")) <= slack).select("phrase", "id", "start", "other").distinct()


def judged(rows: DataFrame, hit: Column, items: Column) -> DataFrame:
    listed = F.array_sort(items)
    return rows.select(
        "id",
        F.size("w").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        listed.alias("items"),
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, share: int = 20
) -> DataFrame:
    """Return (id_col, n_words, n_hit, n_items, items_sha256, items, contaminated).

    A document is contaminated if a word is hit and at least one word in
    ``share`` is.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("key"))
    windows = stored(item_windows(items, item_col, item_text_col, width), "windows")
    vocabulary = windows.select(F.explode("tokens").alias("word")).distinct()
    counts = stored(frequencies(docs, vocabulary), "frequencies")
    anchors = stored(window_anchors(windows, counts, 2), "anchors")
    index = stored(postings(docs.select(F.col("key").alias("id"), "text"), anchors.select("word").distinct()), "postings")
    starts = candidate_starts(index, anchors).join(counted(windows.select("phrase", "n", "items")), "phrase")
    found = stored(starts.groupBy(F.col("id").alias("key")).agg(F.collect_list(F.struct("start", "n", "phrase", "items")).alias("found")), "candidates")

    ids = counted(found.select("key"))
    maybe = docs.join(ids, "key", "left_semi").join(found, "key").select("id", words("text").alias("w"), "found")
    exact = F.filter("found", lambda c: F.array_join(F.slice("w", c["start"] + 1, c["n"]), " ") == c["phrase"])
    maybe = maybe.withColumn("found", exact)
    places = F.array_distinct(F.flatten(F.transform("found", lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1))))
    hit = judged(maybe, F.size(places), F.array_distinct(F.flatten(F.transform("found", lambda c: c["items"]))))
    rest = docs.join(ids, "key", "left_anti").select("id", words("text").alias("w"))
    clean = judged(rest, F.lit(0), F.array().cast("array<string>"))
    out = hit.unionByName(clean).withColumnRenamed("id", id_col)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
