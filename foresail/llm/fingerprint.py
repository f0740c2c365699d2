"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

The five-word shingles of a text (the whole sequence if it has fewer words) are hashed once; the top bits of a hash name its bin, and each bin keeps its
smallest hash. An empty bin takes the value of a filled one by optimal densification: bin i's own random sequence of bins, drawn by a 2-universal hash of (i, attempt), is
followed until it meets a filled bin; after ``ATTEMPTS`` draws the filled bin with the smallest hash of (i, bin) is taken, which ends the same kind of sequence. The low
``BITS`` bits of every bin are packed into a string of hexadecimal digits. Two fingerprints are as alike as the share of equal bins, corrected for bins
that agree by chance: (m - 2^-b) / (1 - 2^-b), not under 0.

Null texts are empty. Texts without words have the fingerprint of no shingle, an empty string; it is like itself (1) and unlike others (0).
Equal texts have equal fingerprints. Repeated rows and ties of ids are ordered by their text. Null ids come last in descending order. Very long texts are
hashed whole. Other columns of the input are not read, so their names can't clash. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch

SHINGLE = 5
BINS = 128
BITS = 8
ATTEMPTS = 6
_LOG = BINS.bit_length() - 1


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(word_array: Column) -> Column:
    """Sorted hashes of the shingles, from hashes of the words; the order of unsigned hashes is that of bins."""
    hashed = F.transform(word_array, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
        return F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(_let(hashed, shingles))


def _bin(h: Column) -> Column:
    """Signed hashes sort from the negative; their top bits with the sign turned count up from 0."""
    return (F.shiftright(h, 64 - _LOG) + BINS // 2).cast("int")


def filled_bins(sorted_hashes: Column) -> Column:
    """map<bin, value>: the first hash of each bin, low bits only."""
    firsts = F.filter(sorted_hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(sorted_hashes, i - 1))))
    return F.map_from_arrays(F.transform(firsts, _bin), F.transform(firsts, lambda h: F.pmod(h, F.lit(1 << BITS)).cast("int")))


def _digit(v: Column) -> Column:
    return F.lpad(F.lower(F.hex(v)), BITS // 4, "0")


def packed(filled: Column) -> Column:
    """The fingerprint string from the map of filled bins."""
    dense = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.try_element_at(filled, b))
    keys = F.map_keys(filled)

    def draw(own: Column) -> Column:
        def densified(v: Column, i: Column) -> Column:
            tries = [F.get(own, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(ATTEMPTS)]
            rest = F.try_element_at(
                filled, F.array_min(F.transform(keys, lambda k: F.struct(F.xxhash64(i, k, F.lit(ATTEMPTS)).alias("h"), k.alias("k")))).getField("k")
            )
            return F.coalesce(v, *tries, rest)

        return F.transform(own, densified)

    return F.when(F.size(keys) == 0, F.lit("")).otherwise(F.array_join(F.transform(_let(dense, draw), _digit), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins of two fingerprints, without what chance gives."""
    step = BITS // 4
    same = F.size(
        F.filter(
            F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * step + 1, F.lit(step)) == F.substring(b, i * step + 1, F.lit(step))
        )
    ) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest((same - chance) / (1 - chance), F.lit(0.0)))


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """The table with a fingerprint of one of its texts; steps are columns of their own, so that none is computed twice."""
    h, m = f"__{out}_hashes", f"__{out}_bins"
    return df.withColumn(
        h, shingle_hashes(words(F.coalesce(F.col(text_col), F.lit(""))))
    ).withColumn(m, filled_bins(F.col(h))).withColumn(out, packed(F.col(m))).drop(h, m)


def next_in_order(df: DataFrame, id_col: str, text_col: str, carry: list[str], parts: int, add=lambda d: d) -> DataFrame:
    """Each row with what the next row by descending id carries, after the last the first, as struct column __next.

    Ranges of ids between quantiles are dealt to tasks; a window in each range finds all but each range's last, whose next is the first
    row of the range below it, from a table with one row for each range. ``add`` derives what is carried beyond the text from a row's text, so
    that finding the first rows needs it for these alone.
    """
    plain, df = df.select(id_col, text_col), add(df)
    bounds = df.agg(
        F.percentile_approx(id_col, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10_000)).alias("b")
    ).first().b if parts > 1 else []
    bounds = sorted(set(bounds or []))
    ids = F.col(id_col)
    part = F.when(ids.isNull(), F.lit(-1)).otherwise(
        F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < ids)) if bounds else F.lit(0)
    )
    order = [F.col(id_col).desc_nulls_last(), F.col(text_col).desc_nulls_last()]
    w = Window.partitionBy("__part").orderBy(*order)
    rows = df.withColumn("__part", part.cast("int")).withColumn("__c", F.struct(*carry))
    rows = rows.withColumn("__next", F.lead("__c").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    # ranges that hold rows, with the row each begins with, and the range that comes before in descending order
    most = F.max(F.struct(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(text_col).alias("own"))).alias("m")
    firsts = plain.withColumn("__part", part.cast("int")).groupBy("__part").agg(most).select("__part", F.col("m.own").alias(text_col))
    firsts = Scratch(df.sparkSession, "ranges").save(add(firsts).select("__part", F.struct(*carry).alias("__c")), "firsts")
    heads = firsts.select(F.collect_list(F.struct("__part")).alias("p")).first().p if parts else []
    have = sorted((r["__part"] for r in heads), reverse=True)  # at most one number for each range
    below = [(p, have[(i + 1) % len(have)]) for i, p in enumerate(have)]
    spark = df.sparkSession
    link = spark.createDataFrame(below, "__of int, __part int") if below else spark.createDataFrame([], "__of int, __part int")
    heads = link.join(firsts, "__part").select(F.col("__of").alias("__part"), F.col("__c").alias("__head"))
    out = rows.join(heads, "__part", "left")
    return out.withColumn("__next", F.coalesce("__next", "__head")).drop("__part", "__c", "__first", "__head")


def edited_fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = next_in_order(rows, "id", "text", ["text", "fingerprint"], parts, lambda d: with_fingerprint(d, "text", "fingerprint"))
    n = F.length("text")
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("half", F.floor(n / 2).cast("int"))
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - F.col("half")), F.substring(F.col("__next.text"), F.lit(1), F.col("half"))
    )
    rows = rows.select("id", "n_chars", "fingerprint", F.col("__next.fingerprint").alias("next_fingerprint"), edited.alias("edited"))
    rows = with_fingerprint(rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "edited_fingerprint")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
