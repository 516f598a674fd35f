"""Secret scans with corpus-wide ownership, in DataFrame operations only.

Candidates are what patterns find in a text: leftmost, non-overlapping for each
kind.  The base kinds (assign, access, hex) always stay.  The kinds of EXTRA are
shapes that documentation copies around as well: they are added only where their
value looks owner-specific in the whole corpus, i.e. at most OWNERS distinct
owners and at most REPOSITORIES distinct repositories have it: a value that one
owner copies through many repositories is an example, too.  For this, value hashes
are aggregated by distinct owners and repositories (pre-aggregated, so a value that
a third of the rows have costs one row for each task).  Each span, base or added, is
marked live (owner-specific) or example (widely copied) by the same counts.

The corpus has no repositories of its own: a repository is by default an owner's
documents of one language (the columns of `repository_cols`).

A regular expression's places come from splitting a text by it: the lengths of
the parts between and of the matches add up to the matches' offsets, in code
points.  Texts without a match are scanned once for each kind.

Null texts are empty and have no spans.  Rows of equal id and text have equal
results, one for each row.  Null owners count as one owner, null parts of a
repository as empty.  An empty table gives an empty one.  Texts of any length are
scanned whole; a text's matches are one array.  Of the columns only those named in
the options are read; redact() gives all back, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, text_key, text_of, written

#: kind, pattern, group that is the value, least characters of that group (fixed values of the base kinds).
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
EXTRA = [
    ("forge", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,}|glpat-[A-Za-z0-9_-]{20,})", 0, 20),
    ("chat", r"\bxox[abprs]-[A-Za-z0-9-]{20,}", 0, 20),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 20),
    ("live", r"\b(?:sk|rk|pk)_live_[A-Za-z0-9]{16,}", 0, 20),
    ("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}-----END", 0, 32),
]
KINDS = [k for k, *_ in BASE + EXTRA]
OWNERS, REPOSITORIES = 2, 4
MASK = "[SECRET]"
#: Matches that are walked one by one.
BLOCK = 256


def _matches(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """array of struct(start, end, rank, value): the matches whose group is long enough.

    Matches are walked in blocks: an array grows by one element within a block only, and by a
    block else, so that a text of very many matches does not cost their square.
    """
    kind = "array<struct<start:int,end:int,rank:int,value:bigint>>"
    parts = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    both = let(whole, lambda w: F.arrays_zip(F.slice(parts, 1, F.size(w)).alias("p"), w.alias("w"), (value if group else w).alias("v")))

    def step(a, x):
        begin = a["at"] + F.char_length(x["p"])
        end = begin + F.char_length(x["w"])
        one = F.struct(begin.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.xxhash64(x["v"]).alias("value"))
        return F.struct(end.alias("at"), F.when(F.char_length(x["v"]) >= least, F.concat(a["found"], F.array(one))).otherwise(a["found"]).alias("found"))

    def walk(m):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int")), lambda b: F.slice(m, b * BLOCK + 1, BLOCK))
        none = F.array().cast(kind).alias("found")
        merge = lambda a, block: let(F.aggregate(block, F.struct(a["at"].alias("at"), none), step), lambda r: F.struct(r["at"].alias("at"), F.concat(a["found"], r["found"]).alias("found")))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none), merge)["found"]

    return F.when(text.rlike(pattern), let(both, walk)).otherwise(F.array().cast(kind))


def candidates(text: Column) -> Column:
    """All kinds' matches, by start, then end and kind."""
    return F.concat(*[_matches(text, i, p, g, n) for i, (_, p, g, n) in enumerate(BASE + EXTRA)])


def _named(spans: Column) -> Column:
    """kind:start:end of the spans, by start, then kind as listed; comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """One row for each distinct id and text: id_col, text_key, copies, base, spans (arrays of struct start, end, rank, live), n_live.

    No text is shuffled.  What a document has found is written once and read twice:
    for the ownership of the values and for the spans.
    """
    repository = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository_cols])
    own = docs.select(F.col(id_col), text_key(text_col).alias("text_key"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), repository.alias("repository"), candidates(text_of(text_col)).alias("found"))
    rows = written(own)
    values = rows.select("owner", "repository", F.explode("found.value").alias("value"))
    # Written, so that both sides of the join below are plain tables and Spark can split a value that many rows have.
    few = (F.col("owners") <= owners) & (F.col("repositories") <= repositories)
    ownership = written(values.distinct().groupBy("value").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("repositories")).select("value", few.alias("live")))
    once = written(rows.groupBy(id_col, "text_key").agg(F.count("*").cast("int").alias("copies"), F.first("found").alias("found")))
    discard(rows)
    spans = once.select(id_col, "text_key", F.explode("found").alias("s")).select(id_col, "text_key", "s.*")
    judged = spans.join(ownership, "value").select(id_col, "text_key", F.struct("start", "end", "rank", "live").alias("s"))
    per = judged.groupBy(id_col, "text_key").agg(F.sort_array(F.collect_list("s")).alias("all"))
    per = per.select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"), "all")
    joined = once.join(per, once[id_col].eqNullSafe(per["_id"]) & (once["text_key"] == per["_key"]), "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:int,end:int,rank:int,live:boolean>>"))
    base = F.filter(every, lambda s: s["rank"] < len(BASE))
    kept = F.filter(every, lambda s: (s["rank"] < len(BASE)) | s["live"])
    return joined.select(id_col, "text_key", "copies", base.alias("base"), kept.alias("spans"), F.size(F.filter(kept, lambda s: s["live"])).cast("long").alias("n_live"))


def report(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base, spans (strings), n_live; one row for each row of docs."""
    found = scan(docs, id_col=id_col, **options)
    count = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long")
    named = found.select(id_col, *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)], _named(F.col("base")).alias("base"), _named(F.col("spans")).alias("spans"), "n_live", F.explode(F.sequence(F.lit(1), "copies")).alias("_copy"))
    return named.drop("_copy")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mask: str = MASK, n_chars_col: str | None = None, **options) -> DataFrame:
    """docs with every span of scan() replaced by mask; columns as they were.

    n_chars_col: a column to set to the new number of code points.  Texts without a
    candidate stay where they are; only the others meet their spans.
    """
    text = F.col(f"`{text_col}`")
    may = F.coalesce(text.rlike("|".join(f"(?:{p})" for _, p, *_ in BASE + EXTRA)), F.lit(False))
    mine, key, spans, new_text = (f"{c}_{uuid.uuid4().hex}" for c in ("id", "key", "spans", "text"))  # no column of docs has such a name
    found = scan(docs, id_col=id_col, text_col=text_col, **options).where(F.size("spans") > 0).select(F.col(id_col).alias(mine), F.col("text_key").alias(key), F.col("spans").alias(spans))
    hit = docs.where(may)
    joined = hit.join(found, hit[id_col].eqNullSafe(found[mine]) & (text_key(text_col) == found[key]), "left")
    # Merged spans, then the parts between them: each part is copied once.
    merged = F.aggregate(
        F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,rank:int,live:boolean>>")),
        F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))),
        lambda a, s: F.when(s["start"] >= F.element_at(a, -1)["end"], F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))))
        ),
    )
    new = joined.withColumn(spans, merged)
    parts = F.transform(spans, lambda s, i: F.substring(text, s["end"] + 1, F.coalesce(F.get(F.col(spans), i + 1)["start"], F.char_length(text)) - s["end"]))
    new = new.withColumn(new_text, F.array_join(parts, mask))
    columns = [F.col(new_text).alias(c) if c == text_col else F.char_length(new_text).cast(docs.schema[c].dataType).alias(c) if c == n_chars_col else hit[f"`{c}`"] for c in docs.columns]
    return docs.where(~may).unionByName(new.select(*columns))
