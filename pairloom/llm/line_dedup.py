"""Line deduplication by overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines of a document is a window, named by 128
bits of hash. Where a window occurs more than once in the corpus, every
occurrence but the first (by doc_id, then place) is a repeat; the lines that
repeats cover, merged, are removed.

Defined results: a null text has no lines and stays null; documents of fewer
than three lines have no window and stay whole; lines are compared exactly and
blank lines count. Of twin rows (equal doc_id and text) one has the first
occurrences; in the others every window is a repeat, so of three lines or more
none stays. Every row keeps its own other columns; of twins that differ in them, that with the
least hash of all its columns has the first occurrences, however the rows are dealt. Rows
that only share an id are told apart by their text. A null id orders after all others. Columns besides doc_id and
text are carried by :func:`remove_repeats` and never looked at. A text of any
length is one row of lines, its windows go through the shuffle as 40 bytes each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import row_key, twin_keys
from pairloom.session import Scratch, settle

WINDOW = 3
LAST = 2**63 - 1


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """(w1, w2, k1, k2, d, at): a row per window; d is the id for ordering."""
    k1, k2 = row_key("doc_id", "text")
    lines = docs.where("text is not null").select(k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("d"), F.split("text", "\n", -1).alias("lines"))
    long = lines.where(F.size("lines") >= size)
    # each line is hashed once; a window's name is made from the names of its lines
    named = long.select("k1", "k2", "d", F.transform("lines", lambda x: F.xxhash64(x)).alias("h1"), F.transform("lines", lambda x: F.xxhash64(F.lit("second"), x)).alias("h2"))

    def window(names: str, i: Column) -> Column:
        return F.xxhash64(*[F.get(F.col(names), i + j) for j in range(size)])

    starts = F.sequence(F.lit(0), F.size("h1") - size)
    pairs = F.transform(starts, lambda i: F.struct(window("h1", i).alias("w1"), window("h2", i).alias("w2")))
    return named.select("k1", "k2", "d", F.posexplode(pairs).alias("at", "w")).select("w.w1", "w.w2", "k1", "k2", "d", "at")


def repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(k1, k2, at): where the later occurrences of repeated windows start."""
    windows = _windows(docs, size)
    place = F.struct("d", "k1", "k2", "at")
    # twins share (k1, k2): within a document a place counts once
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    # written out, so that both sides of the join get exchanges that AQE can split at a hot window
    first = settle(first.select("w1", "w2", "first"), "line-windows")
    found = windows.join(first, ["w1", "w2"]).where(place > F.col("first"))
    return found.select("k1", "k2", "at")


def covered(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(k1, k2, gone): per document the sorted line numbers that repeats cover. The array holds at
    most the document's own lines."""
    starts = repeats(docs, size).groupBy("k1", "k2").agg(F.collect_set("at").alias("starts"))
    lines = F.flatten(F.transform("starts", lambda s: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: s + j)))
    return starts.select("k1", "k2", F.array_sort(F.array_distinct(lines)).alias("gone"))


def remove_repeats(docs: DataFrame, size: int = WINDOW, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of ``docs`` with the shortened text, and the numbers of lines and of removed lines
    under the names of ``counts``, which ``docs`` must not have."""
    k1, k2 = row_key("doc_id", "text")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(own.alias("row"), k1.alias("k1"), k2.alias("k2"), F.col("text").alias("text"))
    scratch = Scratch(docs.sparkSession)
    twins = twin_keys(docs.where("text is not null").select(k1.alias("k1"), k2.alias("k2")), "k1", "k2", scratch)
    if twins is None:
        numbered = keyed.withColumn("copy", F.lit(1).cast("bigint"))
    else:
        # rows equal in all columns meet as partial aggregates, with their number; only of these one stands for the others
        whole = F.to_json("row", {"ignoreNullFields": "false"})
        same = keyed.join(twins, ["k1", "k2"], "left_semi").withColumn("h", F.struct(F.xxhash64(whole), F.xxhash64(F.lit("second"), whole)))
        kinds = scratch.settle(same.groupBy("k1", "k2", "h").agg(F.first("row").alias("row"), F.first("text").alias("text"), F.count("*").alias("copies")), "line-kinds")
        first = scratch.settle(kinds.groupBy("k1", "k2").agg(F.min("h").alias("least")), "line-first")
        placed = kinds.join(first, ["k1", "k2"])  # a key of very many kinds meets one row
        low = F.when(F.col("h") == F.col("least"), 1).otherwise(2).cast("bigint")
        copies = placed.select("row", "k1", "k2", "text", F.explode(F.sequence(low, low + F.col("copies") - 1)).alias("copy"))
        numbered = keyed.join(twins, ["k1", "k2"], "left_anti").withColumn("copy", F.lit(1).cast("bigint")).unionByName(copies)
    joined = numbered.join(covered(docs, size), ["k1", "k2"], "left")
    out = joined.select("row", "text", "copy", F.col("gone").alias("found"), F.split("text", "\n", -1).alias("lines"))
    count = F.coalesce(F.size("lines"), F.lit(0))
    none = F.array().cast("array<int>")
    every = F.when(count >= size, F.sequence(F.lit(0), count - 1)).otherwise(none)
    out = out.withColumn("gone", F.when(F.col("copy") > 1, every).otherwise(F.coalesce("found", none)))
    stay = F.array_except(F.when(count > 0, F.sequence(F.lit(0), count - 1)), "gone")  # hashed: linear in the lines
    text = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    shorter = out.select("row", count.cast("bigint").alias("n_lines"), F.size("gone").cast("bigint").alias("n_removed"), text.alias("shorter"))
    return shorter.select(*[F.col("shorter").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns], F.col("n_lines").alias(counts[0]), F.col("n_removed").alias(counts[1]))


def digest(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that is left; a null text counts as empty)."""
    slim = docs.select("doc_id", "text")
    out = remove_repeats(slim, size)
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("bigint").alias("n_lines"), "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same rows in SQL: lines, windows, first occurrences, what is left.
ORACLE = """
with lines as (
  select doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line
  from documents where text is not null
), windows as (
  select doc_id, pos, line || chr(10) || lead(line) over w || chr(10) || lead(line, 2) over w as win
  from lines window w as (partition by doc_id order by pos)
), ranked as (
  select doc_id, pos, row_number() over (partition by win order by doc_id, pos) as occurrence
  from windows where win is not null
), gone as (
  select distinct doc_id, pos + j as pos from ranked, (values (0), (1), (2)) as o(j) where occurrence > 1
), marked as (
  select lines.doc_id, lines.pos, line, gone.pos is not null as removed
  from lines left join gone on lines.doc_id = gone.doc_id and lines.pos = gone.pos
), summed as (
  select doc_id, count(*) as n_lines, count(*) filter (where removed) as n_removed,
    string_agg(line, chr(10) order by pos) filter (where not removed) as kept
  from marked group by doc_id
)
select d.doc_id, cast(coalesce(s.n_lines, 0) as bigint) as n_lines, cast(coalesce(s.n_removed, 0) as bigint) as n_removed,
  sha256(coalesce(s.kept, '')) as kept_sha256
from documents d left join summed s on d.doc_id = s.doc_id
"""
