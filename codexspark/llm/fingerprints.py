"""Document fingerprints: a bottom-k sketch of the hashes of five-word shingles, with DataFrame operations only.

A sketch is the sorted array of the k smallest distinct 64-bit shingle hashes. Sketches of parts merge into the sketch
of the whole; two of them estimate resemblance, containment and the count of distinct shingles. Words are
`[^\\x20\\x09-\\x0D]+` in lower case; a text with fewer than five words has its whole sequence as one shingle.

Null and empty texts have an empty sketch: two empty ones are alike (1), an empty and another one are not (0). Equal
texts have equal sketches, whatever the row; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexspark.llm.shared import SPLIT, let

SIZE = 5
K = 128


def shingle_hashes(text: Column, size: int = SIZE) -> Column:
    """64-bit hashes of a text's shingles, one for each window of words; words are hashed once each."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")

    def windows(hashes: Column) -> Column:
        n = F.size(hashes)
        each = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))
        return F.when(n >= size, each).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def sketch(text: Column, k: int = K) -> Column:
    return bottom(shingle_hashes(text), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both contents together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(df: DataFrame, keys: list[str], sketch_col: str, k: int = K, salt: int = 32) -> DataFrame:
    """One sketch for each key from the sketches of its parts. Each step keeps k hashes of a group, salted first, so a
    hot key is spread and nothing grows with the number of parts."""
    own = df.select(*keys, F.explode(sketch_col).alias("__hash")).distinct()
    own = own.withColumn("__salt", F.pmod("__hash", F.lit(salt)))
    for by in ([*keys, "__salt"], keys):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("__hash"))
        own = own.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")
    return own.groupBy(*keys).agg(F.sort_array(F.collect_list("__hash")).alias(sketch_col))


def distinct_shingles(sketch_col: Column, k: int = K) -> Column:
    """Estimated count: exact below k, else from the share of the hash range that the k-th smallest closes off."""
    reach = (F.get(sketch_col, F.lit(k - 1)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch_col) < k, F.size(sketch_col).cast("double")).otherwise(F.lit(k - 1.0) / reach)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    def over(union: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(union, a), b))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))

    return let(merged(a, b, k), over)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has as well."""
    union = distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def printed(sketch_col: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch_col, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def numbers(values: list[int]) -> Column:
    """Numbers as one array: a single literal once the plan is optimised, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def range_place(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most value, looked up in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds) - 1) + 1
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= value))
    fine = lambda c: F.slice(numbers(bounds), (c - 1) * step + 1, step)
    return let(below(numbers(bounds[::step])), lambda c: F.when(c > 0, (c - 1) * step + below(fine(c))).otherwise(0))


def with_next(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs (doc_id, text) cut into ranges of ids, each with the first rows of the range after it as guests, so that a
    window over a range sees every row's successor; the first range follows the last. Columns `range` and `guest`
    come with it. The bounds are quantiles of the ids, as many as four times the shuffle partitions: all that the
    driver sees. Texts move once. Rows without id have no successor and are spread by a hash."""
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(key).cast("long").alias("id")).filter("id is not null")
    cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    place = range_place(F.col(key).cast("long"), sorted(set(cuts)))
    firsts = dict(ids.groupBy(range_place(F.col("id"), sorted(set(cuts))).alias("range")).agg(F.min("id")).collect())
    full = sorted(firsts)
    if not full:
        return docs.withColumns({"range": F.lit(0), "guest": F.lit(0)})
    before = {r: full[i - 1] for i, r in enumerate(full)}
    size = full[-1] + 1
    # A range without rows has no first id; nothing looks it up.
    first = numbers([firsts.get(r, 0) for r in range(size)])
    previous = numbers([before.get(r, -1) for r in range(size)])
    home = lambda r: F.struct(r.alias("range"), F.lit(0).alias("guest"))
    away = lambda r: F.struct(F.get(previous, r).cast("int").alias("range"), F.lit(1).alias("guest"))
    where = let(place, lambda r: F.when(F.get(first, r) == F.col(key), F.array(home(r), away(r))).otherwise(F.array(home(r))))
    lost = F.array(F.struct((-1 - F.pmod(F.xxhash64("text"), F.lit(n))).cast("int").alias("range"), F.lit(0).alias("guest")))
    return docs.withColumn("__at", F.explode(F.when(F.col(key).isNull(), lost).otherwise(where))).withColumns({"range": F.col("__at.range"), "guest": F.col("__at.guest")}).drop("__at")


def tail_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text, n_chars, edited, print, edited_print, next_print) for each row of (doc_id, text): the edited text
    has its last quarter replaced by as many first characters of the next document in ascending doc_id (ties by text;
    after the last comes the first; a row without id has no next one, so its quarter is cut off)."""
    order = Window.partitionBy("range").orderBy("guest", "doc_id", "text")
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    after = F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order))
    rows = rows.withColumn("after", after).withColumn("n_chars", F.char_length("text").cast("long"))
    part = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - part).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.coalesce("after", F.lit("")), F.lit(1), part)))
    rows = rows.withColumns({"print": sketch(F.col("text"), k), "edited_print": F.when(F.col("guest") == 0, sketch(F.col("edited"), k))}).drop("after")
    follow = F.when(F.col("doc_id").isNotNull(), F.lead("print").over(order))
    return rows.withColumn("next_print", follow).filter("guest = 0").drop("guest", "range")
