"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Texts become lower-case tokens in which numbers, names and units are typed placeholders, so a question whose numbers,
names or units were swapped keeps its template. Every window of `size` template tokens is hashed and joined with the
windows of the benchmark. Where windows of an item meet a document in one stretch, the slots of these windows are lined
up again with the original values: an item's value should stand for one and the same value throughout (and the other way
round); a match most of whose slots conflict is rejected as a chance likeness of templates.

A window is a 64-bit hash, so the scan of documents keeps no text; the texts that slots need are read again for
matched documents only. Only the benchmark's windows are broadcast, and only below `broadcast_rows` of them; beyond, the
same join shuffles both sides. Windows that meet are counted by (document, item, stretch) with partial sums first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Units that make a slot after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles mg g kg t lb lbs oz ton tons gram grams kilogram kilograms "
    "ml cl l liter liters litre litres s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months "
    "year years hz khz mhz ghz w kw mw v kv j kj cal kcal pa kpa bar c f k usd eur gbp dollar dollars euro euros cent cents percent "
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters"
).split()
#: Marks a name; U+0002 does not occur in prose.
NAME = "\u0002"


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text. A capitalised word within a sentence starts with NAME; figures joined by . , : / are one token."""
    marked = F.regexp_replace(F.translate(text, NAME, " "), r"(?<=[\p{Ll},;] )(?=\p{Lu}\p{Ll})", NAME)
    blank = r"[^\p{L}\p{N}" + NAME + "]"
    return F.filter(F.split(F.lower(marked), rf"(?<![0-9]){blank}+|{blank}+(?![0-9])"), lambda t: t != "")


def template(words: Column) -> Column:
    """Tokens with numbers, names, and units after numbers replaced by #, @ and %."""
    is_number = lambda t: t.between("0", "9￿")  # noqa: E731  the first character is a digit
    return F.transform(
        words,
        lambda t, i: F.when(is_number(t), F.lit("#"))
        .when(t.startswith(NAME), F.lit("@"))
        .when(t.isin(UNITS) & (i > 0) & is_number(F.get(words, i - 1)), F.lit("%"))
        .otherwise(t),
    )


def windows(template_col: str, size: int) -> Column:
    """Hashes of all windows of size tokens, in order; none if there are fewer tokens."""
    c = F.col(template_col)
    starts = F.when(F.size(c) >= size, F.sequence(F.lit(1), F.size(c) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(c, i, size)))


def _literals(window: Column) -> Column:
    return F.size(F.filter(window, lambda t: ~t.isin("#", "@", "%")))


def _plain(word: Column) -> Column:
    return F.translate(word, NAME, "")


def _whole(words: Column, template_col: Column, at: Column | int, length: int | Column) -> Column:
    """Hash of a whole template of `length` tokens at a place. Its first word counts as itself: whether it is a name depends on what is before it."""
    first = F.when(F.get(words, at).startswith(NAME), _plain(F.get(words, at))).otherwise(F.get(template_col, at))
    return F.xxhash64(length if isinstance(length, Column) else F.lit(length), first, F.slice(template_col, at + 2, length - 1))


def benchmark_windows(benchmark: DataFrame, size: int, literals: int) -> DataFrame:
    """(item_id, at, hash, words, whole, few, item_windows, item_tokens): windows with enough literal tokens of each different (item_id, text).

    An item without such a window is one window, its whole template (whole); few: that has under three literal tokens.
    """
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("words")).distinct()
    items = materialise(items.withColumn("template", template(F.col("words"))).where(F.size("words") > 0), "bench-items")
    found = items.select("item_id", "words", "template", F.posexplode(windows("template", size)).alias("at", "hash"))
    found = found.where(_literals(F.slice("template", F.col("at") + 1, size)) >= literals)
    whole = items.join(found.select("item_id", "words").distinct(), ["item_id", "words"], "left_anti")
    n = F.size("words")
    whole = whole.select("item_id", F.lit(0).alias("at"), _whole(F.col("words"), F.col("template"), F.lit(0), n).alias("hash"), "words", F.lit(True).alias("whole"), (_literals(F.col("template")) < 3).alias("few"))
    found = found.select("item_id", "at", "hash", F.slice("words", F.col("at") + 1, size).alias("words"), F.lit(False).alias("whole"), F.lit(False).alias("few")).union(whole)
    found = found.withColumn("item_windows", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    return found.join(items.groupBy("item_id").agg(F.sum(F.size("words")).alias("item_tokens")), "item_id")


def _seen(slim: DataFrame, size: int, lengths: list[int]) -> DataFrame:
    """(doc_id, pos, hash): windows of documents, and of the lengths of whole items."""
    worded = slim.withColumn("words", tokens(F.col("text")))
    if not lengths:
        return worded.select("doc_id", template(F.col("words")).alias("template")).select("doc_id", F.posexplode(windows("template", size)).alias("pos", "hash"))
    worded = worded.withColumn("template", template(F.col("words")))
    placed = lambda hashes: F.transform(hashes, lambda h, i: F.struct(i.alias("pos"), h.alias("hash")))
    at = lambda n: lambda i: _whole(F.col("words"), F.col("template"), i, n)
    all_ = [placed(windows("template", size))]
    for n in lengths:
        starts = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>"))
        all_.append(placed(F.transform(starts, at(n))))
    return worded.select("doc_id", F.explode(F.concat(*all_)).alias("w")).select("doc_id", "w.pos", "w.hash")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 8, literals: int = 5, share: float = 0.3, run: int = 13, cover: float = 0.65, broadcast_rows: int = 200_000
) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, n_slots) for each document and item it holds, in its own or other values.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. A document holds an item if, within
    one stretch of it, at least `share` of the item's windows (of `size` tokens, `literals` of them no slots) meet it, or
    windows of `run` tokens on one diagonal do, or windows that cover `cover` of the item's tokens do, and most slots are
    consistent. Items without a window are one window as a whole; with under three literal tokens they must be verbatim.
    Null and empty texts, and rows with a null doc_id, hold nothing and are not found. Rows of one doc_id count as one
    document; repeated items are one. Empty tables give none.
    """
    bench = materialise(benchmark_windows(benchmark, size, literals), "bench-windows")
    known = bench.select("hash").distinct()
    known = F.broadcast(known) if bench.count() <= broadcast_rows else known
    lengths = sorted(r[0] for r in bench.where("whole").select(F.size("words")).distinct().collect())
    slim = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = materialise(_seen(slim, size, lengths).join(known, "hash", "left_semi").distinct(), "met-windows")
    met = seen.join(bench, "hash").withColumn("diagonal", F.col("pos") - F.col("at"))
    # Insertions shift the diagonal. Stretches as wide as the item overlap by half, so a smaller shift stays within one.
    # Each diagonal is a stretch of its own too: copies in other values nearby do not make its slots conflict.
    width = F.greatest(F.col("item_tokens"), F.lit(size))
    sides = F.array(*(F.struct(F.lit(k).alias("side"), F.floor((F.col("diagonal") + F.floor(width * k / 2)) / width).alias("stretch")) for k in (0, 1)), F.struct(F.lit(2).alias("side"), F.col("diagonal").cast("long").alias("stretch")))
    met = materialise(met.select("*", F.explode(sides).alias("s")).select("*", "s.*").drop("s"), "stretches")
    keys = ["doc_id", "item_id", "side", "stretch"]
    runs = met.groupBy(*keys, "diagonal", "item_windows", "item_tokens").agg(F.count(F.lit(1)).alias("n"), F.collect_set("at").alias("ats"))
    runs = runs.groupBy(*keys, "item_windows", "item_tokens").agg(F.max("n").alias("longest"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("n_windows"))
    long_enough = (F.col("n_windows") >= share * F.col("item_windows")) | (F.col("longest") >= run - size + 1)
    runs = materialise(runs.withColumn("enough", long_enough).where(F.col("enough") | (F.col("n_windows") * size >= cover * F.col("item_tokens"))), "runs")
    return _consistent(slim, met.join(runs.select(*keys), keys, "left_semi"), runs, cover)


def _consistent(docs: DataFrame, met: DataFrame, runs: DataFrame, cover: float) -> DataFrame:
    """Stretches that match enough, and most of whose slots have values that stand for one another; the longest one of each (doc_id, item_id).

    Only places inside matched windows count. A slot conflicts if its item's value stands for several values of the
    document there, or the other way round.
    """
    keys = ["doc_id", "item_id", "side", "stretch"]
    wanted = docs.join(runs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("words", tokens(F.col("text"))).select(F.col("doc_id").alias("d"), F.col("words").alias("doc_words"))
    wanted = wanted.withColumn("doc_template", template(F.col("doc_words")))
    places = met.select(*keys, "diagonal", "at", "few", F.posexplode("words").alias("offset", "item_value"))
    places = places.select(*keys, "diagonal", (F.col("at") + F.col("offset")).alias("place"), _plain(F.col("item_value")).alias("item_value"), "few").distinct()
    covered = places.groupBy(*keys).agg(F.count_distinct("place").alias("covered"))
    at = F.col("place") + F.col("diagonal")
    lined = places.join(wanted, F.col("doc_id") == F.col("d"))
    pairs = lined.where((at >= 0) & F.get("doc_template", at).isin("#", "@", "%"))
    pairs = materialise(pairs.select(*keys, "place", "item_value", "few", _plain(F.get("doc_words", at)).alias("doc_value"), F.get("doc_template", at).alias("kind")).distinct(), "slots")
    one_way = pairs.groupBy(*keys, "kind", "item_value").agg((F.min("doc_value") != F.max("doc_value")).alias("split"))
    back = pairs.groupBy(*keys, "kind", "doc_value").agg((F.min("item_value") != F.max("item_value")).alias("merged"))
    judged = pairs.join(one_way, [*keys, "kind", "item_value"]).join(back, [*keys, "kind", "doc_value"])
    conflicts = F.sum((F.col("split") | F.col("merged")).cast("long"))
    other = F.max(F.col("few") & (F.col("item_value") != F.col("doc_value")))
    checked = judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_slots"), conflicts.alias("conflicts"), other.alias("other"))
    kept = runs.join(covered, keys).join(checked, keys, "left").where(F.col("enough") | (F.col("covered") >= cover * F.col("item_tokens")))
    kept = kept.where((F.coalesce("conflicts", F.lit(0)) * 2 <= F.coalesce("n_slots", F.lit(0))) & ~F.coalesce("other", F.lit(False)))
    best = kept.groupBy("doc_id", "item_id", "item_windows").agg(F.max(F.struct("n_windows", F.coalesce("n_slots", F.lit(0)).alias("n_slots"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_windows").alias("n_windows"), "item_windows", F.col("b.n_slots").cast("long").alias("n_slots"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of docs that hold no benchmark item, unchanged; rows with a null doc_id or text stay."""
    found = contaminated(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def decontamination_query(spark, sf_dir: str) -> DataFrame:
    """op7: benchmark items found in all documents."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
