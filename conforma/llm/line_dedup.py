"""Near-duplicate lines over the whole corpus: an exact set-similarity join on the word sets of lines, in DataFrame functions.

1. Equal lines are one line, stored once with its first place, A-Z lower-cased and every white space a space.
2. A line's words are put in order of rarity: a class by a fixed-size table of hashed counts over all distinct lines, then the
   word's hash. It is a total order, so lines with Jaccard >= t share a word among their first n - ceil(t n) + 1.
3. Lines meet by these words. A word that occurs once meets nothing. Frequent words are split by length: a line goes to the
   keys of its own band of lengths and the one below, as lines of similar sets have lengths in the same or adjacent bands.
   Very frequent words of lines of at most LONG words are split further, by the second common word (which lies among the first
   n - ceil(t n) + 2) and by the exact lengths that the positional filter allows. Longer lines, of which this would make keys by
   the cube of their words, keep the bands; lines that may have partners on both sides of LONG have keys of both kinds.
4. Within a key, pairs must pass the length filter, the positional filter and a bound on the bits in which their parity
   signatures differ. In large keys each line first meets the earliest line alone, which settles groups of near copies without
   making their pairs; lines still open after that meet all earlier ones.
5. The Jaccard similarity of what is left is verified on the words themselves.

A line goes if an earlier line is similar to it; whether that one stays doesn't matter. Order: doc_id, line number, then a
hash of the text (which matters only for rows that share a doc_id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, small
from .common import materialise as written

THRESHOLD = 0.75
#: Size of the table of hashed word counts, one class byte each, however large the corpus is.
TABLE_BITS = 20
#: Words on more lines are split by bands of lengths; beyond SPLIT_LINES by a second word and exact lengths.
BAND_LINES = 512
SPLIT_LINES = 1 << 14
#: Lines of more different words have two keys a word at most, however frequent it is.
LONG = 32
#: Keys of at most so many lines are compared in full at once; in larger ones the earliest line comes first.
SMALL_KEY = 512
#: Classes of counts: steps to a doubling. Class 0 is a count of one.
STEPS = 3
UPPER, LOWER, GAPS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "\t\n\x0b\x0c\r"


def lowered(line: Column) -> Column:
    """line with A-Z lower-cased and every white space a space. Plain ASCII takes the faster of two equal ways."""
    plain = F.octet_length(line) == F.char_length(line)
    for gap in GAPS:
        plain &= ~F.contains(line, F.lit(gap))
    return F.when(plain, F.lower(line)).otherwise(F.translate(line, UPPER + GAPS, LOWER + " " * len(GAPS)))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df stored (see common.materialise), after which its shuffle files go: nothing reads them again, and a corpus leaves many."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


# Arrays are exploded by the outer forms, even where none is empty: for the others the optimizer adds a filter on the array's
# size to the scan, which makes the array a second time.


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the row's text), line_no (from 0), line, k1, k2 (hashes of line) of all lines; rows without doc_id or text have none."""
    rows = documents(docs).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("*", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def _place() -> Column:
    return F.struct("doc_id", "line_no", "text_key")


def distinct_lines(rows: DataFrame) -> DataFrame:
    """A stored table of the different lines with a word: line (a number), doc_id, line_no, text_key (of its first place), k1, k2, copies, low."""
    first = rows.groupBy("k1", "k2").agg(F.min(_place()).alias("f"), F.count("*").alias("copies"), F.any_value("line").alias("text"))
    # generated, so that it is made once
    first = first.select("k1", "k2", "f", "copies", F.explode(F.array(lowered(F.col("text")))).alias("low")).where(F.trim("low") != "")
    return materialise(first.select(F.monotonically_increasing_id().alias("line"), "f.doc_id", "f.line_no", "f.text_key", "k1", "k2", "copies", "low"), "lines")


def copied_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no of every line that isn't the first of its equals."""
    several = materialise(lines.where("copies > 1").select("k1", "k2", _place().alias("f")), "copied-lines")
    met = rows.drop("line").join(small(several, several.count()), ["k1", "k2"])
    return met.where(_place() != F.col("f")).select("doc_id", "text_key", "line_no")


def rarity_table(lines: DataFrame, bits: int = TABLE_BITS) -> DataFrame:
    """One stored row, classes: for each of 2**bits buckets of word hashes a number, STEPS times the binary logarithm of the occurrences in all lines."""
    words = lines.select(F.explode_outer(F.split("low", " ")).alias("w")).where("w != ''")
    counts = words.select(F.xxhash64("w").bitwiseAND((1 << bits) - 1).cast("int").alias("b")).groupBy("b").agg(F.count("*").alias("c"))
    # bounded by the table's size, whatever the corpus
    got = counts.where("c > 1").select("b", F.least(F.floor(STEPS * F.log2("c")), F.lit(127)).cast("int").alias("c"))
    # stored, so that the shuffle files go
    got = materialise(got, "word-counts").toArrow()
    table = np.zeros(1 << bits, np.int8)
    table[got["b"].to_numpy()] = got["c"].to_numpy()
    return materialise(lines.sparkSession.createDataFrame(pa.table({"classes": pa.array([table], pa.list_(pa.int8()))})), "word-classes")


def _class_of(count: int) -> int:
    return int(STEPS * np.log2(count))


def line_order(lines: DataFrame) -> Column:
    """A column that orders lines by doc_id and line number: one number where both fit into one, else the two."""
    x = lines.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("line_no").alias("number")).first()
    width = (x["number"] or 0) + 1
    if x["least"] is None or (max(abs(x["least"]), abs(x["most"])) + 1) * width >= 1 << 63:
        return F.struct("doc_id", "line_no")
    return F.col("doc_id") * F.lit(width).cast("long") + F.col("line_no")


def posting_rows(lines: DataFrame, table: DataFrame, threshold: float = THRESHOLD, band_lines: int | None = None, split_lines: int | None = None) -> DataFrame:
    """k, side, line, at, n, pos, s0, s1: a row for every key of every line.

    Two lines of a key are compared unless side % 3 is 1 for both or 2 for both; side is 3 more for lines with keys of two words. at: see line_order; n: different words;
    pos: place of the word that the key is of; s0, s1: a parity signature of 64 bits, of 128 for over 64 words.
    """
    bits = TABLE_BITS
    hashes = F.array_remove(F.array_distinct(F.transform(F.split("low", " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))

    def key(h: Column) -> Column:
        slot = h.bitwiseAND((1 << bits) - 1).cast("int")
        # never null: numbers that may be null would be sorted as objects
        rank = F.coalesce(F.get("classes", slot).cast("long"), F.lit(0).cast("long"))
        return F.shiftleft(rank, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    # a scalar subquery, used in one place alone: it becomes part of that expression, and no row carries the table
    rows = lines.select("line", line_order(lines).alias("at"), "low", table.scalar().alias("classes"))
    rows = rows.select("line", "at", F.sort_array(F.transform(hashes, key)).alias("t"))
    rows = rows.withColumn("n", F.size("t"))
    bands, splits = (_class_of(BAND_LINES if band_lines is None else band_lines), _class_of(SPLIT_LINES if split_lines is None else split_lines))
    low = F.ceil(F.col("n") * threshold - 1e-9).cast("int")
    rows = rows.withColumn("p", F.col("n") - low + 1)
    # the words behind the prefix's are of use only if one of the prefix is split by a second word
    first = F.when((F.col("n") <= LONG) & (F.shiftrightunsigned(F.get("t", F.col("p") - 1), 56) > splits), F.slice("t", 1, F.col("p") + 1))
    sign = "aggregate(t, 0L, (a, x) -> a ^ {})"
    bit = "shiftleft(1L, cast(x & 63 as int))"
    half = sign.format(f"case when x & 64 = {{}} then {bit} else 0L end")
    s0, s1 = f"case when n <= 64 then {sign.format(bit)} else {half.format(0)} end", f"case when n <= 64 then 0L else {half.format(64)} end"
    rows = rows.select("line", "at", "n", "p", first.alias("first"), F.slice("t", 1, F.col("p")).alias("f"), F.expr(s0).alias("s0"), F.expr(s1).alias("s1"))
    rows = rows.select("line", "at", "n", "p", "first", "s0", "s1", F.posexplode_outer("f").alias("pos", "w"))
    rank = F.shiftrightunsigned("w", 56)
    # a word that occurs once meets nothing
    rows = rows.where(rank > 0)
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.001 / threshold)))

    def k(side: int, *parts: Column | str) -> Column:
        return F.struct(F.xxhash64("w", *parts).alias("k"), F.lit(side).alias("side"))

    # lengths of partners with which the words from pos on suffice
    most = F.floor((F.col("n") - F.col("pos")) * ((1 + threshold) / threshold) + 1e-9).cast("int") - F.col("n")
    high = F.least(F.floor(F.col("n") / threshold + 1e-9).cast("int"), most)
    lengths = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    second = F.when(F.col("n") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.slice("first", F.col("pos") + 2, F.col("p")))

    def split(v: Column) -> Column:
        def at(m: Column) -> Column:
            side = F.when(m == F.col("n"), 0).when(m < F.col("n"), 1).otherwise(2)
            return F.struct(F.xxhash64("w", v, F.least(m, F.col("n")), F.greatest(m, F.col("n"))).alias("k"), side.alias("side"))

        return F.transform(lengths, at)

    banded = F.array(k(0, band), k(1, band - 1))
    # a line of at most LONG words may have a partner of more
    both = F.when(F.col("n") > LONG * threshold - 1e-9, banded).otherwise(F.array().cast(rows.select(banded.alias("x")).schema["x"].dataType))
    short = F.concat(both, F.flatten(F.transform(second, split)))
    keys = F.when(rank <= bands, F.array(k(0))).when((rank <= splits) | (F.col("n") > LONG), banded).otherwise(short)
    rows = rows.select(F.explode_outer(keys).alias("e"), F.col("first").isNotNull().alias("loose"), "line", "at", "n", "pos", "s0", "s1").where(F.col("e").isNotNull())
    return rows.select("e.k", (F.col("e.side") + F.when(F.col("loose"), 3).otherwise(0)).alias("side"), "line", "at", "n", "pos", "s0", "s1")


def possible(a: str, b: str, threshold: float) -> Column:
    """Whether rows a and b of a key pass the signature, length and positional filters; what drops most pairs comes first."""
    n, m, p, q = (F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos"))
    need = F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)
    room = F.least(p, q) + F.least(n - p, m - q)
    s = [F.col(f"{a}.s{j}").bitwiseXOR(F.col(f"{b}.s{j}")) for j in range(2)]
    # similar sets differ in at most this many words; a signature of 128 bits is folded to compare it with one of 64
    differ = (n + m) * ((1 - threshold) / (1 + threshold)) + 1e-9
    folded = F.bit_count(s[0].bitwiseXOR(s[1])) <= differ
    apart = (F.bit_count(s[0]) + F.bit_count(s[1]) <= differ) | (n <= 64) | (m <= 64)
    return folded & apart & (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9) & (room >= need)


def _met(a: str, b: str, threshold: float) -> Column:
    at, on = F.col(f"{a}.at"), F.col(f"{b}.at")
    earlier = (at < on) | ((at == on) & (F.col(f"{a}.line") < F.col(f"{b}.line")))
    sides = (F.col(f"{a}.side") % 3 != F.col(f"{b}.side") % 3) | (F.col(f"{a}.side") % 3 == 0)
    return possible(a, b, threshold) & earlier & sides


def first_pairs(posts: DataFrame, threshold: float = THRESHOLD, small_key: int | None = None) -> DataFrame:
    """a, b (lines), c, hot: all pairs of keys of at most small_key lines, in larger ones those with the earliest line.

    c: common first words. hot: null, or a larger key; each of its lines is told in a row as b, with c = 0 if it doesn't pass the filters.
    Beyond the first words of the line whose first words end earlier, t n - 1 words at most are common, so with too few common
    first words a pair isn't given, unless it may have more of them in keys of two words, or its lines meet in a larger key.
    """
    limit = SMALL_KEY if small_key is None else small_key
    own = Window.partitionBy("k").orderBy("at", "line")
    all_ = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = posts.select("*", F.row_number().over(own).alias("r"), F.count("*").over(all_).alias("c"))
    a, b = ranked.where((F.col("c") > 1) & ((F.col("c") <= limit) | (F.col("r") == 1))).alias("a"), posts.alias("b")
    large, met = F.col("a.c") > limit, _met("a", "b", threshold)
    both = a.join(b, (F.col("a.k") == F.col("b.k")) & (large | met))
    n, m = F.col("a.n"), F.col("b.n")
    lacks = F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9) - F.ceil(F.greatest(n, m) * threshold - 1e-9) + 1
    need = F.when(large | ((F.col("a.side") >= 3) & (F.col("b.side") >= 3)), 0).otherwise(lacks).cast("int")
    rows = both.select(F.col("a.line").alias("a"), F.col("b.line").alias("b"), need.alias("need"), F.when(large, F.col("a.k")).alias("hot"), F.when(~large | met, 1).alias("met"))
    pairs = rows.groupBy("a", "b", "hot").agg(F.count("met").alias("c"), F.min("need").alias("need"))
    return pairs.where(F.col("c") >= F.col("need")).drop("need")


def more_pairs(posts: DataFrame, hot: DataFrame, gone: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b of the keys in hot (stored, column k): lines b that aren't in gone (stored, column line) with all earlier lines."""
    # the rows of few keys: stored, as they are read twice
    some = materialise(posts.join(small(hot, hot.count()), "k", "left_semi"), "hot-postings")
    a, b = some.alias("a"), some.join(small(gone, gone.count()), "line", "left_anti").alias("b")
    return a.join(b, (F.col("a.k") == F.col("b.k")) & _met("a", "b", threshold)).select(F.col("a.line").alias("a"), F.col("b.line").alias("b")).distinct()


def pair_lines(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """A stored table of line, its place f and its different words t, for all lines in pairs (a, b)."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct(), "pair-lines")
    words = F.array_remove(F.array_distinct(F.split("low", " ")), "")
    return materialise(lines.join(small(ids, ids.count()), "line", "left_semi").select("line", _place().alias("f"), words.alias("t")), "pair-words")


def verified(pairs: DataFrame, some: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """line: the later one of every pair (a, b) whose word sets are similar; some: see pair_lines."""
    a, b = (some.select(F.col("line").alias(x), F.col("f").alias(f"f{x}"), F.col("t").alias(f"t{x}")) for x in "ab")
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    both = both.select("a", "b", "fa", "fb", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.explode(F.array(F.size(F.array_intersect("ta", "tb")))).alias("shared"))
    alike = both.where(F.col("shared") >= threshold * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9)
    return alike.select(F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("line")).distinct()


def similar_lines(lines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """line of every one of lines (see distinct_lines) to which an earlier one is similar."""
    table = rarity_table(lines)
    found = materialise(first_pairs(posting_rows(lines, table, threshold), threshold), "line-pairs")
    pairs = found.where("c > 0")
    some = pair_lines(pairs, lines)
    # of each line the candidate with most common first words is verified first, the rest only if that one isn't similar
    best = materialise(pairs.groupBy("b").agg(F.max(F.struct("c", "a")).alias("m")).select("m.a", "b"), "best-pairs")
    gone = materialise(verified(best, some, threshold), "lines-gone")
    rest = pairs.select("a", "b").distinct().join(best, ["a", "b"], "left_anti").join(small(gone.withColumnRenamed("line", "b"), gone.count()), "b", "left_anti")
    gone = materialise(gone.union(verified(rest, some, threshold)).distinct(), "lines-gone")
    large = found.where("hot IS NOT NULL")
    hot = materialise(large.select(F.col("hot").alias("k")).distinct(), "hot-keys")
    if hot.count():
        # keys are made again for the lines of large keys alone
        members = materialise(large.select(F.col("b").alias("line")).distinct(), "hot-lines")
        posts = posting_rows(lines.join(small(members, members.count()), "line", "left_semi"), table, threshold)
        more = materialise(more_pairs(posts, hot, gone, threshold).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "line-pairs")
        gone = materialise(gone.union(verified(more, pair_lines(more, lines), threshold)).distinct(), "lines-gone")
    return gone


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), line_no of every line with a word to which an earlier line is similar, equal lines included.

    Rows with a null doc_id take no part. Rows with equal doc_id and text are one document. Rows that share a doc_id alone are
    documents of their own; among their lines the order is line number, then text_key.
    """
    rows = line_rows(docs)
    lines = distinct_lines(rows)
    gone = similar_lines(lines, threshold)
    firsts = lines.join(small(gone, gone.count()), "line", "left_semi").select("doc_id", "text_key", "line_no")
    return copied_lines(rows, lines).union(firsts).distinct()


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with text less its later similar lines, and n_lines, n_removed (long). Columns of docs of these names are replaced.

    A null text stays null, with 0 lines; rows with a null doc_id stay as they are. A text all of whose lines go is empty.
    Rows with equal doc_id and text come out alike (see removed_lines). Other columns stay; an empty table gives an empty
    result. Columns named _doc, _key or _gone are refused.
    """
    if {"_doc", "_key", "_gone"} & set(docs.columns):
        raise ValueError("columns _doc, _key and _gone are reserved")
    docs = docs.drop("n_lines", "n_removed")
    # the numbers of removed lines in order, behind a -1: what stays lies between them
    gone = F.array_sort(F.concat(F.array(F.lit(-1)), F.collect_list("line_no")))
    lists = removed_lines(docs, threshold).groupBy("doc_id", "text_key").agg(gone.alias("_gone"), F.count("*").alias("c"))
    lists = materialise(lists, "lines-removed")
    # the numbers of a document's removed lines are within its text's size, so a broadcast is bounded by both counts
    size = lists.agg(F.count("*").alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()
    lists = small(lists.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "_gone"), size["n"] + size["c"] // 2)
    joined = docs.join(lists, (F.col("doc_id").cast("long") == F.col("_doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_key")), "left")

    def between(lines: Column) -> Column:
        # slices of the lines, so that a text's work grows with its lines alone
        cut = lambda k: F.slice(lines, F.get("_gone", k) + 2, F.coalesce(F.get("_gone", k + 1), F.size(lines)) - F.get("_gone", k) - 1)
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("_gone") - 1), cut)), "\n")

    kept = F.get(F.transform(F.array(F.split("text", "\n")), between), 0)
    out = {c: F.col(c) for c in docs.columns} | {"text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)}
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    n_removed = (F.size("_gone") - 1).cast("long")
    return joined.select(*(v.alias(c) for c, v in out.items()), n_lines.alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(n_removed).cast("long").alias("n_removed"))
