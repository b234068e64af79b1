"""Benchmark decontamination with a broadcast set of benchmark windows.

Every 13 consecutive words of an item are a window; an item with fewer words, but not none, is one
window. The hashes of all windows are broadcast, the windows of each text are looked up in them, and
hits are verified on the words themselves. A word inside an occurrence of a window is hit.

A text is one row from scan to look-up and only hits are shuffled. The set is sent in chunks of at
most ``set_rows`` windows, one scan of the texts each, so a task never holds more than one chunk.

Edge cases: NULL and empty texts have no words and are clean; NULL items give no window; items with
the same window share it; repeated rows of a text each get the result; a NULL id is an id like any
other; an empty benchmark leaves every text clean.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginwise.llm.text import fresh, lower_ascii, whole
from marginwise.session import stored

WINDOW = 13
SET_ROWS = 1_000_000
#: Characters between words, upper case kept apart: letters are lower-cased when words are compared.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(whole(text), BREAKS + "+"), "")


def marks(words: Column) -> Column:
    """A hash per word that ignores case; a coarser match than ASCII case, verified later."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def window_marks(marked: Column, size: int) -> Column:
    """A hash per window of ``size`` words."""
    at = F.transform(
        marked, lambda h, i: F.xxhash64(F.lit(size), h, *[F.get(marked, i + k) for k in range(1, size)])
    )
    return F.slice(at, 1, F.greatest(F.size(marked) - (size - 1), F.lit(0)))


def joined(words: Column, start: Column, size: Column) -> Column:
    return lower_ascii(F.array_join(F.slice(words, start, size), " "))


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(window, size, item): the words of each distinct window of each item, as text."""
    rows = items.select(F.col(id_col).alias("item"), item_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    rows = rows.select("item", "words", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("at"))
    return rows.select("item", "size", joined(F.col("words"), F.col("at"), F.col("size")).alias("window")).distinct()


def hits(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    set_rows: int = SET_ROWS,
) -> DataFrame:
    """(id, text_hash, copies, n_words, positions, items) per distinct id and text.

    ``positions`` holds the sorted numbers (from 1) of the hit words, ``items`` the ids of the items
    with a window in the text.
    """
    by_item = stored(benchmark_windows(items, item_col, item_text_col, window), "benchmark-windows")
    words = F.split("window", " ")
    windows = by_item.select("size", "window").distinct().withColumn("marked", marks(words))
    windows = stored(windows.withColumn("mark", window_mark_of(windows, window)).drop("marked"), "window-set")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most ``window`` numbers
    chunks = max(1, -(-windows.count() // set_rows))

    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("text_hash"), item_words(F.col("text")).alias("words"))
    rows = rows.withColumn("marked", marks(F.col("words")))
    # Before the windows of each size stands one NULL, the row that every text has.
    looked_up = F.concat(F.array(F.lit(None).cast("bigint")), *[window_marks(F.col("marked"), k) for k in sizes])
    rows = rows.select("id", "text_hash", "words", looked_up.alias("marks"))
    # The outer form, as the other one adds a filter in which the arrays are built anew per element.
    rows = rows.select("id", "text_hash", "words", F.posexplode_outer("marks").alias("at", "mark"))

    def chunk(k: int) -> DataFrame:
        part = windows.where(F.pmod("mark", F.lit(chunks)) == k) if chunks > 1 else windows
        found = rows.join(F.broadcast(part), "mark", "left").where((F.col("at") == 0) | F.col("window").isNotNull())
        # Windows of lesser sizes come first.
        before, start = F.lit(0), F.lit(0)
        for size in sizes:
            start = F.when(F.col("size") == size, F.col("at") - before).otherwise(start)
            before = before + F.greatest(F.size("words") - (size - 1), F.lit(0))
        found = found.withColumn("start", start)
        true_hit = (F.col("at") > 0) & (joined(F.col("words"), F.col("start"), F.col("size")) == F.col("window"))
        own = (F.col("at") == 0) & F.lit(k == 0)
        return found.where(own | true_hit).select(
            "id", "text_hash", F.when(own, F.size("words")).alias("n_words"), "window", "start", "size"
        )

    found = reduce(DataFrame.unionByName, [chunk(k) for k in range(chunks)])
    spot = F.when(F.col("window").isNotNull(), F.struct("window", "start", "size"))
    texts = found.groupBy("id", "text_hash").agg(
        F.count("n_words").alias("copies"),
        F.max("n_words").cast("bigint").alias("n_words"),
        F.collect_set(spot).alias("spots"),
    )
    texts = stored(texts, "window-hits")
    positions = F.array_sort(
        F.array_distinct(
            F.flatten(F.transform("spots", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
        )
    )
    named = (
        texts.where(F.size("spots") > 0)
        .select("id", "text_hash", F.explode("spots.window").alias("window"))
        .distinct()
        .join(by_item, "window")
        .groupBy("id", "text_hash")
        .agg(F.collect_set("item").alias("items"))
        .select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "items")
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    item_type = by_item.schema["item"].dataType
    return texts.join(named, same, "left").select(
        "id", "text_hash", "copies", "n_words", positions.alias("positions"),
        F.coalesce("items", F.array().cast(f"array<{item_type.simpleString()}>")).alias("items"),
    )


def window_mark_of(windows: DataFrame, window: int) -> Column:
    """The hash of a window of any size, from the hashes of its words."""
    marked = F.col("marked")
    by_size = [
        F.when(F.col("size") == k, F.xxhash64(F.lit(k), *[F.get(marked, F.lit(i)) for i in range(k)]))
        for k in range(1, window + 1)
    ]
    return F.coalesce(*by_size)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) per row of ``docs``."""
    found = hits(docs, items, **names)
    n_hit = F.size("positions").cast("bigint")
    rows = found.withColumn("n_hit", n_hit).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("id", "n_words", "n_hit", "items", contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def _joined_back(docs: DataFrame, found: DataFrame, p: str, id_col: str, text_col: str, how: str) -> DataFrame:
    same = docs[id_col].eqNullSafe(found[f"{p}id"]) & (F.xxhash64(whole(docs[text_col])) == found[f"{p}hash"])
    return docs.join(found, same, how)


def remove_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` without the contaminated ones; other columns pass through, whatever their names."""
    p = fresh(docs)
    found = hits(docs, items, id_col, text_col, **names)
    bad = found.where(contaminated(F.size("positions"), F.col("n_words")))
    bad = bad.select(F.col("id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}hash"))
    return _joined_back(docs, bad, p, id_col, text_col, "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` with every hit word, and what stands between it and the word before, cut out of the text;
    other columns pass through, whatever their names."""
    p = fresh(docs)
    found = hits(docs, items, id_col, text_col, **names).where(F.size("positions") > 0)
    bad = found.select(F.col("id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}hash"), F.col("positions").alias(f"{p}at"))
    letters = BREAKS.replace("[", "[^", 1)
    parts = F.regexp_extract_all(F.col(text_col), F.lit(f"{BREAKS}*{letters}+|{BREAKS}+"), F.lit(0))
    rows = _joined_back(docs, bad, p, id_col, text_col, "left").withColumn(f"{p}parts", parts)
    # The k-th part holds the k-th word.
    kept = F.array_except(F.sequence(F.lit(1), F.size(f"{p}parts")), F.col(f"{p}at"))
    rest = F.transform(kept, lambda k: F.get(f"{p}parts", k - 1))
    text = F.when(F.col(f"{p}at").isNull(), F.col(text_col)).otherwise(F.array_join(rest, ""))
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
