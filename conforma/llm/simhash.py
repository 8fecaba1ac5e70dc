"""SimHash fingerprints: hashes of weighted terms vote on signed bits; permuted block tables find near fingerprints.

Terms are pairs of adjacent words (a text of one word has that word), weighted by how often they occur. Only DataFrame
functions are used: terms are exploded, and the votes of two bits at a time are summed in lanes of one long, so a row needs
BITS / 2 sums that Spark compiles and pre-aggregates by hash: all that is carried along is numbers.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, documents, materialise, small

BITS = 128
#: Bits of a lane of votes: two lanes in a long. A text has fewer terms than a lane counts, as Spark's strings are under 2 GB.
LANE = 32
#: Rows that a range of the next-document search holds, about, and the most ranges; a range is sorted, with spills, not held.
BUCKET_ROWS, RANGES = 256, 1 << 16
#: Fingerprints within so many bits are near.
RADIUS = 3


def terms(text: Column) -> Column:
    """Hashes of the pairs of adjacent words of a text, one per occurrence; of the word, if there is one; none without words."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(words)
    pairs = F.zip_with(F.slice(hashes, 1, F.greatest(n - 1, F.lit(0))), F.slice(hashes, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.when(n < 2, hashes).otherwise(pairs)


def _spread(h: Column, first: int) -> Column:
    """Bits first and first + 1 of h, each in its lane."""
    low = F.shiftrightunsigned(h, first).bitwiseAND(F.lit(3))
    return (low * F.lit(1 + (1 << (LANE - 1)))).bitwiseAND(F.lit(1 + (1 << LANE)))


def fingerprints(texts: DataFrame, keys: list[str], carry: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """keys, carried columns (numbers), n_terms and fingerprint: bits / 4 lower-case hex digits, all 0 for a text without terms.

    A bit is 1 if more terms (by weight) have it set than not. texts has a column text; null texts are empty. Rows with
    equal keys must have equal texts and carried columns; they give one row (their votes add up, which changes no majority).
    """
    words, plan = bits // 64, range(0, 64, 2)
    rows = texts.select(*keys, *carry, F.explode_outer(terms(F.coalesce("text", F.lit("")))).alias("_t"))
    hashed = [F.col("_t"), *(F.xxhash64(F.lit(k), F.col("_t")) for k in range(1, words))]
    sums = [F.sum(_spread(h, i)).alias(f"_{k}_{i}") for k, h in enumerate(hashed) for i in plan]
    voted = rows.groupBy(*keys).agg(*(F.max(c).alias(c) for c in carry), F.count("_t").alias("n_terms"), *sums)

    def word(k: int) -> Column:
        out = F.lit(0).cast("long")
        for i in plan:
            for j in range(2):
                ones = F.shiftrightunsigned(F.coalesce(f"_{k}_{i}", F.lit(0)), j * LANE).bitwiseAND(F.lit((1 << LANE) - 1))
                out = out.bitwiseOR(F.shiftleft(((2 * ones > F.col("n_terms")) & (F.col("n_terms") > 0)).cast("long"), i + j))
        return F.lower(F.lpad(F.hex(out), 16, "0"))

    return voted.select(*keys, *carry, "n_terms", F.concat(*[word(k) for k in range(words)]).alias("fingerprint"))


def _longs(fingerprint: Column, bits: int) -> list[Column]:
    """A fingerprint's hex digits as numbers of 32 bits."""
    return [F.conv(F.substring(fingerprint, 8 * i + 1, 8), 16, 10).cast("long") for i in range(bits // 32)]


def distance(a: Column, b: Column, bits: int = BITS) -> Column:
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_longs(a, bits), _longs(b, bits))), F.lit(0))


def near_pairs(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, bits: int = BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of different fingerprints within radius bits: a, b, distance (a < b), and a_<name>, b_<name> of each carried column.

    prints: a column fingerprint and the carried ones, which equal fingerprints must have alike.

    A fingerprint is cut into blocks; two within the radius differ in at most radius blocks, so they agree on some
    blocks - radius of them. For every choice of such blocks a table is keyed by them (the permuted tables of the
    method, all in one keyed by the choice), and pairs within a key are compared. A pair comes once: from the choice of the
    first blocks that it agrees on. Equal fingerprints count as one. By default two of radius + 2 blocks must agree, 51 bits or so
    of 128, so hardly any but near copies share a key; the join of a large key is one that Spark can split.
    """
    blocks = blocks or min(radius + 2, bits // 4)
    digits = bits // 4
    if blocks <= radius or blocks > digits:
        raise ValueError("blocks must be over radius and at most bits / 4")
    edges = [digits * i // blocks for i in range(blocks + 1)]
    distinct = prints.select("fingerprint", *carry).dropna(subset=["fingerprint"])
    distinct = distinct.dropDuplicates(["fingerprint"]) if carry else distinct.distinct()
    parts = [F.substring("fingerprint", edges[i] + 1, edges[i + 1] - edges[i]) for i in range(blocks)]
    choices = list(combinations(range(blocks), blocks - radius))
    keys = F.array(*[F.xxhash64(F.lit(c), *[parts[i] for i in choice]) for c, choice in enumerate(choices)])
    numbers = _longs(F.col("fingerprint"), bits)
    keyed = distinct.select(*carry, *[x.alias(f"w{i}") for i, x in enumerate(numbers)], F.posexplode_outer(keys).alias("c", "k"))
    a, b = keyed.alias("a"), keyed.alias("b")
    apart = [F.col(f"a.w{i}").bitwiseXOR(F.col(f"b.w{i}")) for i in range(len(numbers))]
    far = sum((F.bit_count(x) for x in apart), F.lit(0))

    def differ(block: int) -> Column:
        """Whether two fingerprints differ in a block of hex digits."""
        found = F.lit(False)
        for i, x in enumerate(apart):
            mask = sum(15 << (4 * (7 - d + 8 * i)) for d in range(max(edges[block], 8 * i), min(edges[block + 1], 8 * i + 8)))
            found = found | (x.bitwiseAND(mask) != 0) if mask else found
        return found

    # of the choices that a pair agrees on, that of its first blocks: all other blocks before its last one differ
    first = F.lit(False)
    for c, choice in enumerate(choices):
        here = F.col("a.c") == c
        for x in set(range(choice[-1])).difference(choice):
            here = here & differ(x)
        first = first | here
    met = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.c") == F.col("b.c")) & (far <= radius) & (F.struct(*[f"a.w{i}" for i in range(len(numbers))]) < F.struct(*[f"b.w{i}" for i in range(len(numbers))])) & first)

    def digits_of(row: str) -> Column:
        return F.concat(*[F.lower(F.lpad(F.hex(f"{row}.w{i}"), 8, "0")) for i in range(len(numbers))])

    return met.select(digits_of("a").alias("a"), digits_of("b").alias("b"), far.cast("int").alias("distance"), *[F.col(f"{row}.{c}").alias(f"{row}_{c}") for row in "ab" for c in carry])


def near_counts(prints: DataFrame, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """A stored table of the fingerprints of several documents or with others within radius bits: fingerprint, n_near (the number of these others), near_id (the smallest doc_id of them and its own).

    prints: doc_id, fingerprint.
    """
    owner = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    # pairs are counted where they are found, and stored nowhere
    pairs = near_pairs(owner.select("fingerprint", "doc_id"), radius, bits=bits, carry=("doc_id",))
    ends = F.explode(F.array(F.struct(F.col("a").alias("f"), F.col("b_doc_id").alias("d")), F.struct(F.col("b").alias("f"), F.col("a_doc_id").alias("d")))).alias("x")
    met = pairs.select(ends).groupBy(F.col("x.f").alias("fingerprint")).agg(F.count("*").alias("n_near"), F.min("x.d").alias("m"))
    near = owner.join(met, "fingerprint", "left").where((F.col("copies") > 1) | F.col("n_near").isNotNull())
    return materialise(near.select("fingerprint", "n_near", F.least("m", "doc_id").alias("near_id")), "near-counts")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_id, next_text: of the document with the next larger doc_id; the last one's is the first one.

    Texts are shuffled once: documents are dealt into ranges of doc_id, cut at quantiles of all doc_ids, and each range
    also gets a copy of the first document of the next range. Of equal doc_ids the order is by text. Null texts are empty;
    rows with a null doc_id come first.
    """
    return _with_next(docs).drop("_bucket")


def _with_next(docs: DataFrame) -> DataFrame:
    """The rows of with_next and the range of each, _bucket, by which they are dealt to tasks."""
    rows = documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    n = rows.count()
    cuts = max(2, min(RANGES, n // BUCKET_ROWS))
    found = rows.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 10 * cuts).alias("q")).first()["q"] or []
    cut = sorted(set(found))
    # number of cuts at or below doc_id, in two short steps
    at = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    tall = max(1, round(len(cut) ** 0.5))
    top = F.size(F.filter(F.array(*[F.lit(c) for c in cut[::tall]]), lambda c: c <= at)) if cut else F.lit(0)
    table = docs.sparkSession.createDataFrame([(i // tall + 1, i, cut[i : i + tall]) for i in range(0, len(cut), tall)] or [(-1, 0, [])], "_top int, _base int, _cuts array<long>")
    # as many numbers as there are cuts, at most RANGES
    rows = rows.withColumn("_top", top).join(F.broadcast(table), "_top", "left")
    rows = rows.withColumn("_bucket", F.coalesce(F.col("_base") + F.size(F.filter("_cuts", lambda c: c <= at)), F.lit(0))).drop("_top", "_base", "_cuts")
    # one row per range, each with its first document
    firsts = rows.groupBy("_bucket").agg(F.min(F.struct(at.alias("d"), "text")).alias("f"))
    firsts = materialise(firsts, "range-firsts")
    used = sorted(r["_bucket"] for r in firsts.select("_bucket").collect())
    back = docs.sparkSession.createDataFrame(list(zip(used, used[-1:] + used[:-1])), "_bucket int, _to int")
    copies = firsts.join(F.broadcast(back), "_bucket").select(F.when(F.col("f.d") > -(2**63), F.col("f.d")).alias("doc_id"), F.col("f.text").alias("text"), F.col("_to").alias("_bucket"), F.lit(1).alias("_copy"))
    both = rows.withColumn("_copy", F.lit(0)).unionByName(copies)
    own = Window.partitionBy("_bucket").orderBy("_copy", F.col("doc_id").asc_nulls_first(), "text")
    linked = both.select("*", F.lead("doc_id").over(own).alias("next_id"), F.lead("text").over(own).alias("next_text"))
    return linked.where(F.col("_copy") == 0).select("_bucket", "doc_id", "text", "next_id", "next_text")


def fingerprint_edits(docs: DataFrame, bits: int = BITS, radius: int = RADIUS) -> DataFrame:
    """One row per distinct doc_id and text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near, near_id.

    The edited text is the text with its last half (rounded down, in code points) replaced by the first as many code points
    of the next document (see with_next), or all of it. Likeness is 1 - distance / bits. Null texts are empty. n_near: how many
    other fingerprints are within radius bits (see near_pairs); near_id: the smallest doc_id among these and the own one.
    """
    rows = _with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("next_h", F.xxhash64("next_text"))
    # the digest as numbers of 15 hex digits, 4 in the last, so that what is carried through the votes is numbers
    digest, parts = F.sha2(F.encode("edited", "UTF-8"), 256), [(1 + 15 * i, min(15, 64 - 15 * i)) for i in range(5)]
    rows = rows.select("_bucket", "doc_id", "text", "edited", "h", "next_id", "next_h", "n_chars", F.explode_outer(F.array(digest)).alias("digest"))
    rows = rows.select("*", *[F.conv(F.substring("digest", at, n), 16, 10).cast("long").alias(f"e{i}") for i, (at, n) in enumerate(parts)])
    carry = ("next_id", "next_h", "n_chars", *(f"e{i}" for i in range(5)))
    both = F.explode_outer(F.array(F.struct(F.lit(0).alias("w"), F.col("text")), F.struct(F.lit(1).alias("w"), F.col("edited").alias("text")))).alias("x")
    # a range is in one task, so grouping within it moves no votes
    texts = rows.select("_bucket", "doc_id", "h", *carry, both).select("_bucket", "doc_id", "h", *carry, "x.w", "x.text")
    prints = fingerprints(texts, ["_bucket", "doc_id", "h", "w"], carry, bits)
    merged = prints.groupBy("_bucket", "doc_id", "h").agg(*(F.max(c).alias(c) for c in carry), F.max(F.when(F.col("w") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("w") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    merged = materialise(merged.drop("_bucket"), "fingerprints")
    following = merged.select(F.col("doc_id").alias("_i"), F.col("h").alias("_h"), F.col("fingerprint").alias("_f"))
    out = merged.join(following, F.col("next_id").eqNullSafe(F.col("_i")) & (F.col("next_h") == F.col("_h")), "left")
    near = near_counts(merged.select("doc_id", "fingerprint"), radius, bits)
    out = out.join(small(near, near.count()), "fingerprint", "left")

    def likeness(other: str) -> Column:
        return 1 - distance(F.col("fingerprint"), F.col(other), bits) / F.lit(float(bits))

    sha = F.concat(*[F.lower(F.lpad(F.hex(f"e{i}"), n, "0")) for i, (_, n) in enumerate(parts)])
    return out.select("doc_id", "n_chars", sha.alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness("edited_fingerprint").alias("near_edited"), likeness("_f").alias("near_next"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("near_id", "doc_id").alias("near_id"))
