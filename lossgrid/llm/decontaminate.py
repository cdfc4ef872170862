"""Benchmark decontamination: size-partitioned MinHash sketches find short items in long documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossgrid.llm.common import keep, lookup, text_or_empty

WORDS = 5
THRESHOLD = 0.8
# sketches, or items with their shingles, are broadcast up to so many bytes in all; beyond it the same join shuffles
BROADCAST_BYTES = 64 << 20


def _words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, size: Column | int, hashed: bool) -> Column:
    """The runs of `size` words as strings or as 64-bit hashes; none in a shorter text."""
    size = F.lit(size) if isinstance(size, int) else size

    def one(i: Column) -> Column:
        run = F.concat_ws(" ", F.slice(words, i, size))
        return F.xxhash64(run) if hashed else run

    none = F.array().cast("array<bigint>" if hashed else "array<string>")
    enough = (F.size(words) >= size) & (F.size(words) > 0)
    return F.when(enough, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), one)).otherwise(none)


def _once(value: Column, use) -> Column:
    """use(value), bound by a one-element transform: named in a lambda, an expression is evaluated for every element."""
    return F.transform(F.array(value), use)[0]


def shingles(text: Column, sizes: list[int], hashed: bool) -> Column:
    """The distinct runs of so many words of a text."""
    return F.array_distinct(_once(_words(text), lambda w: F.concat(*[_runs(w, n, hashed) for n in sizes])))


def item_shingles(text: Column, words: int) -> Column:
    """The distinct runs of `words` words of an item; a shorter one is one run, a blank one none."""
    return F.array_distinct(_once(_words(text), lambda w: _runs(w, F.least(F.size(w), F.lit(words)), False)))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) for every item of which a document holds enough.

    Containment is the part of an item's distinct `words`-word shingles that the document has; pairs of at least
    `threshold` are returned. An item of fewer words is one shingle, and every document that has these words in
    succession holds it; null and blank texts on either side match nothing. Rows that repeat a document's id are judged
    each by itself and the best one counts; those that repeat an item's id are united. A null id is an id like any
    other. Empty tables give an empty result, and other columns are not read.

    Search. Items are partitioned by size, the power of two below their shingle count. An item of n shingles that is
    contained to the threshold misses at most n - ceil(threshold * n) of them, so the one more with the smallest
    hashes, its bottom-k MinHash sketch, cannot all be missing: looking up the sketches finds every pair. Partitions
    whose smallest item needs more shingles than a document has are not searched in it. Candidates are then verified on
    the shingles themselves. Documents are cut into shingles of `words` words and of the fewer words that items have.

    Sketches and items are broadcast while their bytes are counted few. Else the documents' hashes, or the candidate
    pairs, are written down and looked up by a shuffle in which frequent keys are split.
    """
    by_item = (
        items.select(F.col(item_id).alias("item_id"), text_or_empty(item_text).alias("text"))
        .distinct()
        .select("item_id", item_shingles(F.col("text"), words).alias("s"))
        .groupBy("item_id")
        .agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))
        .where(F.size("s") > 0)
        .select("item_id", "s", F.size("s").alias("n_shingles"))
        .withColumn("needed", F.ceil(F.col("n_shingles") * F.lit(threshold) - F.lit(1e-9)).cast("int"))
        .withColumn("size_class", F.floor(F.log2("n_shingles")).cast("int"))
        .withColumn("item", F.monotonically_increasing_id())
    )
    by_item = keep(by_item, "benchmark-items")
    hashes = F.array_sort(F.transform("s", lambda x: F.xxhash64(x)))
    classes = by_item.groupBy("size_class").agg(F.min("needed").alias("least"))  # at most 32 rows
    sketches = by_item.select(
        "item", "size_class", F.explode(F.slice(hashes, F.lit(1), F.col("n_shingles") - F.col("needed") + 1)).alias("hash")
    )
    by_hash = sketches.join(F.broadcast(classes), "size_class").groupBy("hash")
    by_hash = keep(by_hash.agg(F.collect_list(F.struct("item", "least")).alias("found")), "benchmark-sketches")

    def total(df: DataFrame, size: Column) -> int:
        return df.agg(F.sum(size)).first()[0] or 0

    lengths = by_item.select(F.explode("s").alias("x")).select(F.size(F.split("x", " ")).alias("n")).distinct()
    sizes = sorted({words, *[r["n"] for r in lengths.collect()]})  # at most `words` numbers

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(doc_text).alias("text"))
    seen = rows.select("doc_id", shingles(F.col("text"), sizes, True).alias("h"))
    probes = seen.select("doc_id", F.size("h").alias("n"), F.explode("h").alias("hash"))
    if total(by_hash, 24 + 16 * F.size("found")) <= BROADCAST_BYTES:
        hits = probes.join(F.broadcast(by_hash), "hash")
    else:
        hits = lookup(keep(probes, "benchmark-probes"), by_hash, "hash", "inner")
    hits = hits.select("doc_id", "n", F.inline("found")).where("n >= least")
    candidates = keep(hits.select("doc_id", "item").distinct(), "benchmark-candidates")

    asked = candidates.groupBy("doc_id").agg(F.collect_list("item").alias("items"))
    asked = asked.withColumnRenamed("doc_id", "asked_id")
    texts = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("asked_id"))).select(
        "doc_id", "items", shingles(F.col("text"), sizes, False).alias("d")
    )
    pairs = texts.select("doc_id", "d", F.explode("items").alias("item"))
    table = by_item.select("item", "item_id", "s", "n_shingles", "needed")
    if total(by_item, 64 + F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + 16 + F.octet_length(x))) <= BROADCAST_BYTES:
        judged = pairs.join(F.broadcast(table), "item")
    else:
        judged = lookup(keep(pairs, "benchmark-pairs"), table, "item", "inner")
    found = judged.select("doc_id", "item_id", "n_shingles", "needed", F.size(F.array_intersect("s", "d")).alias("n_shared"))
    return (
        found.where("n_shared >= needed")
        .groupBy("doc_id", "item_id", "n_shingles")
        .agg(F.max("n_shared").cast("long").alias("n_shared"))
        .select(
            "doc_id",
            "item_id",
            "n_shared",
            F.col("n_shingles").cast("long").alias("n_shingles"),
            (F.col("n_shared") / F.col("n_shingles")).alias("containment"),
        )
    )
