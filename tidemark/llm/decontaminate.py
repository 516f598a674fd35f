"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are runs of ASCII letters (A-Z lowered), digits and non-ASCII characters.
A window is SPAN consecutive words of an item; an item of fewer words, but not
none, is one window.  Every k-gram of words has a hash; of each `reach`
consecutive hashes a text, document or item, keeps the least (winnowing), so texts
that share SPAN = k + reach - 1 words share a kept hash at the same place of that
window.  Kept hashes of the documents are joined with those of the items, and each
meeting is extended to the window that kept it, whose words are compared.

Before any row is made, a document's kept hashes are tried against a bitmap of the
items' kept hashes (a scalar, see common.bitmap): it lets all matches pass and little else.  The join that follows is what
decides.

Null texts have no words; neither have empty ones.  Rows of equal id and text
have equal results, one for each row.  Items without an id are one item, without
words none; without items nothing is hit.  An empty table gives an empty one.  Texts
of any length count whole.  Only the id and text columns are read; decontaminate()
gives all columns back, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, discard, let, maybe, text_key, text_of, written

SPAN = 10
GRAM = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _range(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, n: Column, k: int) -> Column:
    """The hash of each k consecutive words, from the words' hashes."""
    return F.transform(_range(n - (k - 1)), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def _with_words(df: DataFrame, text_col: str) -> DataFrame:
    """Adds w (words), n (their number), h (their hashes)."""
    own = df.withColumn("w", words(text_of(text_col)))
    return own.withColumn("n", F.size("w")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def item_windows(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """Distinct item_id (string), length, words (space-joined) of the items' windows."""
    own = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words(text_of(text_col)).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    length = F.least(F.col("n"), F.lit(span))
    starts = F.sequence(F.lit(0), F.col("n") - length)
    made = own.select("item_id", length.alias("length"), F.explode(F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, length), " "))).alias("words"))
    return made.distinct()


def _window(start: Column, length: int, h: Column) -> Column:
    return F.struct(start.cast("int").alias("s"), F.lit(length).alias("length"), h.alias("h"), F.array_join(F.slice("w", start + 1, length), " ").alias("words"))


def _tried(bits: Column, longs: int):
    """A gram and its place, if the filter lets it pass."""
    return lambda g, s: F.when(maybe(bits, longs, g), F.struct(s.alias("s"), g.alias("h")))


def _elected(bits: Column, longs: int, reach: int):
    """The least gram of the window that begins at a place, and that place, if the filter lets it pass."""
    return lambda s: let(F.array_min(F.slice("g", s + 1, reach)), lambda h: F.when(maybe(bits, longs, h), F.struct(s.alias("s"), h.alias("h"))))


def _windowed(k: int):
    return lambda x: _window(x["s"], k, x["h"])


def kept(windows: DataFrame, *, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """windows (of item_windows()) with h, the hash that winnowing keeps of each: the least of its grams, of a short one that of all its words."""
    hashes = F.transform(F.split("words", " "), lambda x: F.xxhash64(x))
    out = windows.withColumn("h", hashes)
    # The lengths are few (at most `span`); each has its own fixed expression.
    each = F.array_min(_grams(F.col("h"), F.lit(span), gram))
    for k in range(1, span):
        each = F.when(F.col("length") == k, F.get(_grams(F.col("h"), F.lit(k), k), 0)).otherwise(each)
    return out.withColumn("h", each)


def hits(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row for each distinct id and text of docs: id_col, text_key, copies, n_words, n_hit, items (sorted strings), hit (array of start, end in words, merged).

    copies: how many rows of docs are alike in both.  No text is shuffled; what goes
    on from a document are its windows whose kept hash may be an item's.
    """
    reach = span - gram + 1
    windows = written(kept(item_windows(items, id_col=item_col, text_col=item_text_col, span=span), span=span, gram=gram))
    shape = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.countDistinct("h").alias("n")).collect()}  # at most `span` rows
    own = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), text_of(text_col).alias("_text"))
    own = _with_words(own, "_text")
    found = []
    for k, n in sorted(shape.items()):
        bits, longs = bitmap(windows.where(F.col("length") == k).select("h").distinct(), n)
        own = own.withColumn(f"bits{k}", bits)
        if k < span:  # items of fewer words: every gram of that length is tried
            met = F.transform(_grams(F.col("h"), F.col("n"), k), _tried(F.col(f"bits{k}"), longs))
        else:
            own = own.withColumn("g", _grams(F.col("h"), F.col("n"), gram))
            met = F.transform(_range(F.size("g") - (reach - 1)), _elected(F.col(f"bits{k}"), longs, reach))
        own = own.withColumn(f"met{k}", F.filter(met, lambda x: x.isNotNull()))
        found.append(F.transform(f"met{k}", _windowed(k)))
    candidates = F.concat(*found) if found else F.array().cast("array<struct<s:int,length:int,h:bigint,words:string>>")
    rows = written(own.select("id", "text_key", F.col("n").cast("long").alias("n_words"), candidates.alias("c")))
    owners = written(windows.groupBy("length", "h", "words").agg(F.sort_array(F.collect_set("item_id")).alias("owners")))
    discard(windows)
    each = rows.select("id", "text_key", F.explode("c").alias("c")).select("id", "text_key", "c.*")
    # Kept hashes meet; the words of the window that kept one decide.
    joined = each.join(owners, ["h", "length", "words"]).select("id", "text_key", F.lit(0).cast("long").alias("n_words"), F.lit(0).alias("row"), F.struct("s", (F.col("s") + F.col("length")).alias("e")).alias("hit"), "owners")
    base = rows.select("id", "text_key", "n_words", F.lit(1).alias("row"), F.lit(None).cast("struct<s:int,e:int>").alias("hit"), F.lit(None).cast("array<string>").alias("owners"))
    per = base.unionByName(joined).groupBy("id", "text_key").agg(F.max("n_words").alias("n_words"), F.sum("row").cast("int").alias("copies"), F.sort_array(F.collect_set("hit")).alias("_hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("owners")))).alias("items"))
    merged = F.aggregate(
        "_hits",
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda done, x: F.when((F.size(done) > 0) & (x["s"] <= F.get(done, F.size(done) - 1)["e"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.get(done, F.size(done) - 1)["s"].alias("s"), F.greatest(F.get(done, F.size(done) - 1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(done, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))),
    )
    # How many words the hits cover: those past the furthest end so far.
    covered = F.aggregate("_hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end")))["n"]
    return per.select(F.col("id").alias(id_col), "text_key", "copies", "n_words", covered.cast("long").alias("n_hit"), "items", merged.alias("hit"))


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """hits() with one row for each row of docs."""
    found = hits(docs, items, id_col=id_col, **options)
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("_copy", "copies")


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that share a window with an item; columns as they were."""
    found = hits(docs, items, id_col=id_col, text_col=text_col, **options)
    bad = written(found.where("n_hit > 0").select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key")))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_id"]) & (text_key(text_col) == bad["_key"]), "left_anti")
