"""Benchmark passages in documents: a prefix-filtered join, verified exactly. DataFrame functions only.

Every benchmark item is cut into windows. A window can only occur where its
rarest word occurs, so that word (by its count in the documents) is the
window's necessary prefix token. Documents hand on the places of such words
alone, each with its neighbours; a place joins the windows of that token, the
window's length and the token's position in it must fit into the document,
and the neighbours must equal the window word by word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.tables import id_and_text, written

#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The most window words and bytes that one pass over the documents takes; more make more passes.
PASS_WORDS = 200_000
PASS_BYTES = 8 << 20


def plain_words(text: Column) -> Column:
    """The words of a text; none for null. lower() is right, and quick, where a text is all ASCII."""
    ascii_lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower)
    return F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, win) of every window; an item with fewer words, but not none, is one window."""
    words = items.select("item_id", plain_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    cut = F.when(F.size("words") <= window, F.array("words")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1))), lambda i: F.slice("words", i, window))
    )
    return words.select("item_id", F.explode(cut).alias("win"))


def _passes(wins: DataFrame) -> int:
    size = wins.agg(F.sum(F.size("win")), F.sum(F.octet_length(F.array_join("win", " ")))).first()
    return max(1, -(-(size[0] or 0) // PASS_WORDS), -(-(size[1] or 0) // PASS_BYTES))


def _values(df: DataFrame) -> list[str]:
    return [r[0] for r in df.collect()]


def _matches(words: DataFrame, wins: DataFrame, window: int) -> DataFrame:
    """(row, doc_id, text_code, n_words, hit) of each place of a prefix token, and a row for each document without one."""
    vocabulary = _values(wins.select(F.explode("win").alias("w")).distinct())
    counts = words.select(F.explode(F.filter("words", lambda w: w.isin(vocabulary))).alias("w")).groupBy("w").count()
    each = wins.select("wid", F.explode(F.array_distinct("win")).alias("w")).join(counts, "w", "left")
    rarest = each.groupBy("wid").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "w")).alias("rarest"))
    # a window with a word that no document holds occurs nowhere
    prefixes = written(
        wins.join(rarest.where("rarest.n > 0"), "wid").select("wid", "win", F.col("rarest.w").alias("token"), (F.array_position("win", F.col("rarest.w")) - 1).cast("int").alias("ahead")),
        "prefixes",
    )
    tokens = _values(prefixes.select("token").distinct())
    n = F.size("words")

    def place(i: Column) -> Column:
        low = F.greatest(i - (window - 1), F.lit(0))
        return F.struct(i.alias("at"), low.alias("low"), F.element_at("words", i + 1).alias("token"), F.slice("words", low + 1, i - low + window).alias("near"))

    rare = F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.element_at("words", i + 1).isin(tokens)))
    places = words.select("row", "doc_id", "text_code", n.alias("n_words"), F.explode_outer(F.transform(rare, place)).alias("p")).select("row", "doc_id", "text_code", "n_words", "p.*")
    start = F.col("at") - F.col("ahead")
    fits = (start >= 0) & (start + F.size("win") <= F.col("n_words"))
    same = F.slice("near", start - F.col("low") + 1, F.size("win")) == F.col("win")
    return places.join(F.broadcast(prefixes), "token", "left").select(
        "row", "doc_id", "text_code", "n_words", F.when(fits & F.when(fits, same), F.struct(start.alias("start"), F.size("win").alias("length"), "wid")).alias("hit")
    )


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """One row for each row of docs: its words, those inside an occurrence of a benchmark window, and the items found.

    text_code is xxhash64 of the text.
    Null and empty texts have no words; an item without words has no windows;
    an empty table of items hits nothing, and an empty table of documents gives
    an empty one. Repeated rows give repeated results; null ids stay null, and
    an item of null id hits words but is not counted. Other columns are not
    read. Windows beyond PASS_WORDS or PASS_BYTES are dealt over several passes
    of the documents, so what is broadcast stays below those sizes (a single
    longer window aside).
    """
    of_items = written(windows(items.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")), window), "item_windows")
    wins = written(of_items.select("win").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    passes = _passes(wins)
    words = id_and_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_code"), plain_words(F.col("text")).alias("words"))
    found = None
    for k in range(passes):
        part = _matches(words, wins.where(F.pmod("wid", F.lit(passes)) == k), window)
        found = part if found is None else found.unionByName(part)
    covered = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n")),
        lambda acc, h: F.struct(
            F.greatest(acc["reach"], h["start"] + h["length"]).alias("reach"),
            (acc["n"] + F.greatest(h["start"] + h["length"] - F.greatest(acc["reach"], h["start"]), F.lit(0))).alias("n"),
        ),
    )["n"]
    hits = written(
        found.groupBy("row", "doc_id", "text_code", "n_words").agg(F.collect_set("hit").alias("hits")).select(
            "row", "doc_id", "text_code", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.array_distinct(F.transform("hits", lambda h: h["wid"])).alias("wids")
        ),
        "hits",
    )
    of_wid = of_items.where(F.col("item_id").isNotNull()).distinct().join(wins, "win").select("wid", "item_id")
    named = hits.select("row", F.explode("wids").alias("wid")).join(of_wid, "wid").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return hits.join(named, "row", "left").select("doc_id", "text_code", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """The rows of docs, all columns as they are, without a word inside an occurrence of a benchmark window."""
    found = contaminated(docs, items, id_col, text_col, window=window).where("contaminated")
    keys = written(found.select(F.coalesce("doc_id", F.lit(0)).alias("key_id"), F.col("doc_id").isNull().alias("key_null"), F.col("text_code").alias("key_code")).distinct(), "contaminated")
    d, code = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    return docs.join(keys, (F.coalesce(d, F.lit(0)) == keys["key_id"]) & (d.isNull() == keys["key_null"]) & (code == keys["key_code"]), "left_anti")
