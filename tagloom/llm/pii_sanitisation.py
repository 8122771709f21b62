"""PII by information-theoretic sanitisation. DataFrame functions only.

Base detection marks e-mail addresses, IP addresses, payment cards and phone numbers. Their values are the protected
entities. How much a term tells about an entity c is its pointwise mutual information with c, estimated from the corpus:
the number of different texts in which the term stands within `reach` words of c, of those that hold the term at all.
As a share of what c itself carries, -log p(c), that is 1 - log p(c | term) / log p(c). Entities seen once count like any
other; instead of a least number of sightings the estimates are shrunk: p(c | term) by `prior` texts without c, and a term
must stand near protected entities in most texts that hold it, which one text alone cannot show. Terms are generalised
where the share reaches `generalise`, and removed where it reaches `remove`, wherever they occur. Copies of a text are one
piece of evidence.

Matches are placed without a Python scan: split() and regexp_extract_all() cut a text into gaps and matches, whose
lengths add up to positions. Every pattern starts where its run starts, so long runs cost no more than short ones.
Only contexts of entities and counts of texts are shuffled, with partial sums first. Terms are broadcast only up to
`broadcast_bytes`; beyond that the same join shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST, fits, materialise, within

#: Kinds in the order of listing, what a text must hold for a match, and the patterns.
KINDS = ("email", "ip", "card", "phone")
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": "(?:[0-9][ -]?){15}[0-9]", "phone": r"\+[0-9]"}
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Kinds that the method adds, listed after the others.
GENERALISED, REMOVED = "term", "disclosure"
#: What sanitise() puts in place of a span.
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", GENERALISED: "[TERM]", REMOVED: ""}
#: Blanks between words, words, what surrounds a term within its word, and the type of a list of spans.
BLANK, WORD, EDGES = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    """Whether a match counts. Lengths are tested before the costly part."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(match) < 16, False).when(F.length(_digits(match)).between(16, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _placed(text: Column, pattern: str, kind: str) -> Column:
    """array<struct(kind, start, end, value)> of a pattern's matches, end exclusive, in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ends = F.transform(F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("g"), F.concat(matches, F.array(F.lit(""))).alias("m")), lambda x: F.struct(x["g"].alias("g"), x["m"].alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["m"] != "", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(ends, start, step, lambda acc: acc["spans"])


def base_spans(text: Column, kind: str) -> Column:
    """Valid base matches of a kind; an empty array for most texts, after one quick test."""
    none = F.array().cast(SPANS)
    return F.when(text.rlike(NEEDS[kind]), F.filter(_placed(text, PATTERNS[kind], kind), lambda s: _valid(kind, s["value"]))).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def term_of(word: Column) -> Column:
    """A word in lower case without punctuation around it."""
    return F.regexp_replace(F.lower(word), EDGES, "")


def told_share(both: Column, term: Column, entity: Column, texts: Column | int, prior: float) -> Column:
    """What a term tells about an entity, as a share of what the entity itself carries, from numbers of texts. `prior` texts more are supposed to hold the term without the entity."""
    return 1 - F.log(both / (term + prior)) / F.log(entity / (texts if isinstance(texts, Column) else F.lit(float(texts))))


def _tied(near: Column, term: Column) -> Column:
    """Whether a term stands near protected entities in most texts that hold it, by a rate shrunk by one text: a single text proves nothing."""
    return near * 2 > term + 1


def near_terms(marked: DataFrame, texts: int, reach: int, least: float, prior: float) -> DataFrame:
    """(entity, term, n_both, n_entity, n_near) from marked (text, base): different texts with both side by side, with the entity, and with the term near any entity.

    A term is in at least as many texts as it is near entities in. Pairs that fall below the least share by that bound,
    as common words do, go at once: nothing that counting all texts could bring would keep them.
    """
    each = marked.where(F.size("base") > 0).select("text", F.explode("base").alias("s"))
    span = 24 * reach  # characters that hold `reach` usual words
    begin = F.greatest(F.col("s.start") - span, F.lit(0))
    before, after = F.substr("text", begin + 1, F.col("s.start") - begin), F.substr("text", F.col("s.end") + 1, F.lit(span))
    words = lambda part: F.filter(F.split(part, BLANK), lambda w: w != "")
    near = F.concat(F.reverse(F.slice(F.reverse(words(before)), 1, reach)), F.slice(words(after), 1, reach))
    value = F.when(F.col("s.kind").isin("card", "phone"), _digits(F.col("s.value"))).otherwise(F.lower("s.value"))
    mentions = materialise(each.select(F.xxhash64("text").alias("t"), F.concat_ws(":", "s.kind", value).alias("entity"), near.alias("near")).distinct(), "mentions")
    entities = mentions.select("entity", "t").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") < texts)
    each = mentions.select("t", "entity", F.explode(F.transform("near", term_of)).alias("term")).where((F.length("term") >= 3) & F.col("term").rlike(r"\p{L}"))
    each = materialise(each.distinct(), "near-words")
    n_near = each.select("t", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_near")).where(_tied(F.col("n_near"), F.col("n_near")))
    pairs = each.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    bounded = pairs.join(n_near, "term").join(entities, "entity").where(told_share(F.col("n_both"), F.col("n_near"), F.col("n_entity"), texts, prior) >= least)
    return materialise(bounded.select("entity", "term", "n_both", "n_entity", "n_near"), "entity-terms")


def text_counts(texts: DataFrame, terms: DataFrame, broadcast_bytes: int) -> DataFrame:
    """(term, n_term): number of different texts that hold each of the terms. Copies share one text's weight, so counts are combined before the shuffle."""
    copies = materialise(texts.groupBy(F.xxhash64("text").alias("c")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    weighed = texts.withColumn("t", F.xxhash64("text")).join(within(copies, broadcast_bytes), F.col("t") == F.col("c"), "left")
    words = weighed.select((1 / F.coalesce("n", F.lit(1))).alias("w"), F.explode(F.array_distinct(F.transform(F.array_distinct(F.split("text", BLANK)), term_of))).alias("held"))
    if fits(terms, broadcast_bytes):
        words = words.join(F.broadcast(terms), F.col("held") == F.col("term"), "left_semi")
    counts = words.groupBy("held").agg(F.round(F.sum("w")).alias("n_term"))
    return counts.join(terms, F.col("held") == F.col("term")).select("term", "n_term")


def disclosing_terms(marked: DataFrame, reach: int = 5, prior: float = 0.25, generalise: float = 0.85, remove: float = 0.95, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """(term, kind): the terms that tell too much about a protected entity of marked (text, base)."""
    texts = marked.select("text").where(F.col("text").isNotNull())
    n = texts.select(F.xxhash64("text").alias("t")).distinct().count()
    pairs = near_terms(marked, n, reach, generalise, prior)
    candidates = materialise(pairs.select("term").distinct(), "candidates")
    counted = pairs.join(text_counts(texts, candidates, broadcast_bytes), "term").where(_tied(F.col("n_near"), F.col("n_term")))
    told = counted.select("term", told_share(F.col("n_both"), F.col("n_term"), F.col("n_entity"), n, prior).alias("share"))
    told = told.groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") >= generalise)
    return materialise(told.select("term", F.when(F.col("share") >= remove, REMOVED).otherwise(GENERALISED).alias("kind")), "disclosing")


def _marked(texts: DataFrame, broadcast_bytes: int = BROADCAST, **options) -> DataFrame:
    """texts (text and columns of names of the caller's) with base and spans added; its names must not clash with those used here."""
    marked = texts.withColumn("base", F.concat(*(base_spans(F.coalesce(F.col("text"), F.lit("")), k) for k in KINDS)))
    terms = disclosing_terms(marked.select("text", "base"), broadcast_bytes=broadcast_bytes, **options)
    if terms.isEmpty():
        return marked.withColumn("spans", F.col("base"))
    # Texts that hold a disclosing term, by hash; copies are one row, so a text meets its terms once.
    words = texts.select("text").where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("found"), F.explode(F.array_distinct(F.split("text", BLANK))).alias("w"))
    found = words.select("found", term_of(F.col("w")).alias("term")).join(within(terms, broadcast_bytes), "term").distinct()
    found = found.groupBy("found").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "kind")))).alias("known"))
    found = within(materialise(found, "term-texts"), broadcast_bytes)
    marked = marked.withColumn("t", F.xxhash64("text")).join(found, F.col("t") == F.col("found"), "left")
    return marked.withColumn("spans", F.when(F.col("known").isNull(), F.col("base")).otherwise(F.concat("base", _term_spans()))).drop("t", "found", "known")


def find_pii(docs: DataFrame, **options) -> DataFrame:
    """docs (text) with two columns added: base, array<struct(kind, start, end, value)> of valid base matches by kind and start, and spans, base and then the method's terms by start.

    A null text counts as empty and has no spans; texts of any length are searched whole. Repeated rows are marked
    alike; copies of a text are one piece of evidence; ties need no rule, as every term that exceeds a threshold counts.
    Columns that are called base or spans are replaced; others stay, whatever their names; an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in ("base", "spans", "text")]
    marked = _marked(docs.select(F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept))), **options)
    return marked.select(*(F.col("text") if c == "text" else F.col(f"_{kept.index(c)}").alias(c) for c in docs.columns if c not in ("base", "spans")), "base", "spans")


def _term_spans() -> Column:
    """Spans of the row's terms in its text, outside base spans, from the words of the text."""
    known = F.col("known")
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    gaps, words = F.split("text", WORD, -1), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    pieces = F.arrays_zip(F.transform(gaps, F.length).alias("g"), F.concat(words, F.array(F.lit(""))).alias("w"))

    def step(acc: Column, x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["w"], r"^[^\p{L}\p{N}]*", 0))
        term = term_of(x["w"])
        begin = acc["at"] + x["g"]
        kind = F.element_at(known, term)
        span = F.struct(kind.alias("kind"), (begin + lead).alias("start"), (begin + lead + F.length(F.regexp_replace(x["w"], EDGES, ""))).alias("end"), x["w"].alias("value"))
        return F.struct((begin + F.length(x["w"])).alias("at"), F.when(kind.isNotNull(), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    all_ = F.aggregate(pieces, start, step, lambda acc: acc["spans"])
    outside = F.filter(all_, lambda s: ~F.exists("base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    return F.concat(*(of_kind(outside, k) for k in (GENERALISED, REMOVED)))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with its texts sanitised: spans replaced by MASKS; overlapping spans of several kinds are one, masked as the first of them.

    Columns stay as they are, whatever their names; n_chars, where there is one, is set to the new length of a text that
    changed. Null and empty texts stay; every row stays; an empty table gives an empty one.
    """
    places = {c: f"_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    found = _marked(docs.select(F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(p) for c, p in places.items())), **options)
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    mask = lambda kind: F.element_at(F.create_map(*(F.lit(x) for k in MASKS.items() for x in k)), kind)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr("text", acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap, mask(s["kind"])))).otherwise(acc["parts"]).alias("parts"))

    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr("text", acc["at"] + 1, F.length("text")))
    clean = F.when(F.size("spans") > 0, F.aggregate(order, start, step, rest)).otherwise(F.col("text"))
    found = found.withColumn("text", clean)
    if "n_chars" in places:
        n = F.col(places["n_chars"])
        found = found.withColumn(places["n_chars"], F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(n))
    return found.select(*(F.col("text") if c == "text" else F.col(places[c]).alias(c) for c in docs.columns))


def pii_query(spark, sf_dir: str) -> DataFrame:
    """op4: personal data of every document."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
