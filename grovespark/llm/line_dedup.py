"""Line dedup by winnowing over line hashes, in DataFrame operations alone.

A document is its sequence of lines that aren't blank (white space at both ends doesn't count), as 128-bit
hashes. Every RUN lines in a row are a window; of each window the smallest hash (the last of equals) is
selected. Selected positions are the document's fingerprints: two documents that share RUN lines in a
row share a fingerprint at the same place of them, so none is missed.

1. Positions are joined by fingerprint: those whose fingerprint stands nowhere else go no further. What is kept is
   (document, position), not the document.
2. A joined position is extended both ways by the windows around it that selected it: each reaches over the lines before and
   after it that a match of so many lines can hold, and windows are compared by digest within their fingerprint. Windows
   that overlap chain to the whole repeated run. Any other window of the document is never looked at. The m
   windows with equal digests make m - 1 matches, each with the earliest one, so a common line or passage costs as much as
   its occurrences, not their pairs.
3. The lines of every window but the earliest are deleted.

Runs are measured in words, too: one or two lines in a row of LONG_WORDS words or more are windows of their own beside those of
RUN lines, in documents of any length, with the smallest hash in them selected as well.

So a line goes if and only if, by (id, digest of the text, line), there stand earlier too: RUN lines in a row that it is in; or fewer in
a row that hold LONG_WORDS words; or all lines of its document of fewer than RUN lines, as all lines of another one or as
lines of LONG_WORDS words anywhere. Without `long_words` lines alone count.

Null and empty texts have no lines and are kept as they are. Blank lines stay, but a document of
which every other line goes is dropped. Rows with the same id and text are one document and get the
same decision; ties of a fingerprint or window are ordered by that. Null ids come first. An empty table gives an empty one. Only the
id and text are looked at; other columns are carried, but for one named lines_deleted, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.llm.shared import drop_table, fresh, write_table

#: Lines of the shortest run that counts.
RUN = 3
#: Words of a run of fewer lines that counts.
LONG_WORDS = 50
_SEED, _WHITE = 0x5DEECE66, " \t\r\x0b\x0c"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_WHITE))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, mark, n_lines, lines): the id, a digest of the text, and (h, g, order, line, words) of the lines that
    aren't blank: two hashes, the negative place among them, the place in the text, and the number of words."""
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(_bare(x).alias("x"), i.alias("line"))), lambda s: s["x"] != "")
    pairs = F.transform(lines, lambda s, i: F.struct(F.xxhash64(s["x"]).alias("h"), F.xxhash64(F.lit(_SEED), s["x"]).alias("g"), (-i).alias("order"), s["line"].alias("line"), F.size(F.split(s["x"], r"[ \t\r\x0b\x0c]+")).alias("words")))
    hashed = docs.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("mark"), F.size(F.split(F.col(text_col), "\n")).alias("n_lines"), pairs.alias("lines"))
    return hashed.where(F.size("lines") > 0)


def _selected(run: int, long_words: int | None) -> Column:
    """(start, size, position) of each window: where it begins, its lines, and the position it selects."""

    def windows(starts: Column, size: int) -> Column:
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.size("lines"), F.lit(size)).alias("size"), (-F.array_min(F.slice("lines", s + 1, size))["order"]).alias("position")))

    def long_starts(size: int) -> Column:
        words = lambda s: F.aggregate(F.slice("lines", s + 1, size), F.lit(0), lambda n, x: n + x["words"])
        return F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda s: (s + size <= F.size("lines")) & (words(s) >= long_words))

    out = [windows(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("lines") - run)), run)]
    if long_words is not None:
        out += [windows(long_starts(size), size) for size in range(1, run)]
    return F.concat(*out)


def repeated_lines(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = LONG_WORDS) -> DataFrame:
    """(doc, mark, line): the lines to delete, by their place in the text (from 0)."""
    hashed = _hashed(docs, id_col, text_col).dropDuplicates(["doc", "mark"]).withColumn("w", F.explode(_selected(run, long_words)))
    hashed = hashed.select("doc", "mark", "w", F.slice("lines", F.col("w")["start"] + 1, F.col("w")["size"]).alias("window"), F.col("lines")[F.col("w")["position"]].alias("least"))
    content = F.transform("window", lambda x: F.struct(x["h"], x["g"]))
    windows = hashed.select(
        "doc", "mark", F.col("w")["start"].alias("start"), F.col("w")["size"].alias("size"), F.col("w")["position"].alias("position"), F.col("least")["h"].alias("h"), F.col("least")["g"].alias("g"),
        F.transform("window", lambda x: x["line"]).alias("span"), F.xxhash64(content).alias("low"), F.xxhash64(F.lit(_SEED), content).alias("high"),
    )
    windows = write_table(windows, "windows")

    place = F.struct("doc", "mark", "position")
    shared = windows.groupBy("h", "g").agg(F.min(place).alias("a"), F.max(place).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("h", "g")
    extended = write_table(windows.join(shared, ["h", "g"]).drop("position"), "matches")
    drop_table(windows)
    key, where = ["h", "g", "low", "high", "size"], F.struct("doc", "mark", "start")
    first = extended.groupBy(*key).agg(F.min(where).alias("first"), F.max(where).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    later = extended.join(first, key).where(~where.eqNullSafe(F.col("first")))
    return later.select("doc", "mark", F.explode("span").alias("line")).distinct()


def dedup_lines(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = LONG_WORDS) -> DataFrame:
    """docs with later repeated runs of lines deleted, and `lines_deleted`; all other columns are as before.
    A document of which nothing but blank lines is left is dropped."""
    gone = repeated_lines(docs, run, id_col, text_col, long_words)
    # a byte for each line up to the last that goes: 1 goes. Its place is found at once, however long the text
    ends = gone.groupBy("doc", "mark").agg(F.max("line").alias("last"))
    flags = ends.select("doc", "mark", F.explode(F.sequence(F.lit(0), "last")).alias("line"), F.lit("0").alias("flag")).unionByName(gone.withColumn("flag", F.lit("1")))
    flags = flags.groupBy("doc", "mark", "line").agg(F.max("flag").alias("flag"))
    doc, mark, mask, count, own_id, own_mark = fresh(docs, "doc", "mark", "mask", "count", "id", "text")
    masks = flags.groupBy("doc", "mark").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "flag"))), lambda x: x["flag"]), "").cast("binary").alias(mask),
        F.sum(F.col("flag").cast("int")).alias(count),
    )
    masks = masks.withColumnsRenamed({"doc": doc, "mark": mark})
    marked = docs.withColumns({own_id: F.col(id_col).cast("long"), own_mark: F.xxhash64(text_col)})
    both = marked.join(masks, F.col(own_id).eqNullSafe(F.col(doc)) & (F.col(own_mark) == F.col(mark)), "left")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: (i >= F.length(mask)) | (F.substring(F.col(mask), i + 1, F.lit(1)) == F.lit(b"0")))
    new = F.when(F.col(count) > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))
    out = both.select(*[(new if c == text_col else F.col(c)).alias(c) for c in docs.columns if c != "lines_deleted"], F.coalesce(count, F.lit(0)).cast("int").alias("lines_deleted"))
    return out.where((F.col("lines_deleted") == 0) | F.col(text_col).rlike(r"[^ \t\r\n\x0b\x0c]"))
