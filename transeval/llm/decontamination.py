"""Benchmark decontamination by a distributed positional inverted index.

The terms of the benchmark are counted in the training documents, and each phrase is looked up
from its rarest terms, three at most. The index holds a posting (document, term, place) for each
word that is one of these, written as a table where the documents are read, beside the length
of each document. The postings of a phrase's rarest terms are moved back by the term's offset in
the phrase. Places where all of them meet, or come as near as ``SLOP`` words, are candidates,
which are compared with the words of the text, all terms of the phrase:

* an exact match has each term at its place;
* a proximity match has each term at most ``SLOP`` words behind its place, as where words were
  put in or left out, or neighbours changed places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, words_of, written

PHRASE = 13
RAREST = 3
#: Words by which the terms of a proximity match may lie apart from their places.
SLOP = 2
#: Tables derived from the benchmark are joined by broadcast up to this many bytes, measured
#: before; a larger benchmark is joined by shuffling.
BROADCAST_BYTES = 64 << 20
#: Share of hit words from which a document counts as contaminated: one in so many.
ONE_IN = 20

KEY = ["doc_id", "text_hash"]


def with_words(df: DataFrame, id_col: str, text_col: str, name: str = "doc_id") -> DataFrame:
    """id, hash of the normalised text, words."""
    norm = df.select(F.col(id_col).alias(name), ascii_lower(F.col(text_col)).alias("norm"))
    return norm.select(name, F.xxhash64("norm").alias("text_hash"), words_of(F.col("norm")).alias("words"))


def bounded(df: DataFrame) -> DataFrame:
    """``df`` for a broadcast join if its rows, measured as text, allow it, else unchanged."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def phrases(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct phrases (phrase_id, phrase: its words joined, length) of items (item_id,
    words), and which item has which. An item of fewer words than ``PHRASE``, but not none,
    is one phrase."""
    size = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(size - PHRASE + 1, F.lit(1)))
    cut = (items.filter(size > 0).select("item_id", "words", F.explode(starts).alias("at"))
           .select("item_id", F.slice("words", F.col("at"), PHRASE).alias("terms"))
           .select("item_id", "terms", F.array_join("terms", " ").alias("phrase")))
    cut = cut.withColumn("phrase_id", F.xxhash64("phrase")).distinct()
    return cut.select("phrase_id", "phrase", "terms").distinct(), cut.select("phrase_id", "phrase", "item_id").distinct()


def term_counts(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, n: how often each of the given distinct terms occurs in the documents."""
    words = with_words(docs, id_col, text_col).select(F.explode("words").alias("word"))
    named = bounded(terms.select(F.col("term").alias("term_")))
    return words.join(named, F.col("word") == F.col("term_")).groupBy(F.col("term_").alias("term")).agg(F.count(F.lit(1)).alias("n"))


def rarest_terms(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Up to ``RAREST`` places (phrase_id, offset, term, needed) of each phrase whose terms
    are rarest. Phrases with a term that no document has are left out: they cannot occur."""
    places = found.select("phrase_id", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    known = places.join(counts, "term")
    by_phrase = Window.partitionBy("phrase_id")
    ranked = (known.withColumn("complete", F.count(F.lit(1)).over(by_phrase) == F.col("size"))
              .withColumn("rank", F.row_number().over(by_phrase.orderBy("n", "offset"))))
    return ranked.filter(F.col("complete") & (F.col("rank") <= RAREST)).select(
        "phrase_id", "offset", "term", F.least("size", F.lit(RAREST)).alias("needed"))


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (doc_id, text_hash, term, at) of the given distinct terms, written as a
    table. The last word of each document is kept as well, whatever it is, with ``last`` set,
    so that each document's length is known; a document without words has one row with a
    null place."""
    named = terms.select(F.col("term").alias("term_"))
    words = with_words(docs, id_col, text_col)
    tokens = words.select(*KEY, F.size("words").alias("size"), F.posexplode_outer("words").alias("at", "word"))
    hit = tokens.join(bounded(named), F.col("word") == F.col("term_"), "left")
    last = F.col("at").isNull() | (F.col("at") == F.col("size") - 1)
    return written(hit.filter(F.col("term_").isNotNull() | last)
                   .select(*KEY, F.col("term_").alias("term"), "at", last.alias("last")), "postings")


def moved_back(index: DataFrame, rare: DataFrame) -> DataFrame:
    """For each posting of a rare term, where a phrase that has it would start."""
    return (index.filter(F.col("term").isNotNull()).join(rare, "term")
            .select(*KEY, "phrase_id", "offset", "needed", (F.col("at") - F.col("offset")).alias("start")))


def candidates(index: DataFrame, rare: DataFrame, slop: int = SLOP) -> DataFrame:
    """(document, phrase_id, start): starts from which the moved postings of all rare terms lie
    at most ``slop`` words on. Rows that repeat a document repeat its postings, so distinct
    offsets are counted, as bits."""
    mine = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("offset")))
    # what follows needs the rows of a document together: they are dealt once
    moved = moved_back(index, rare).repartition(*KEY)
    lists = moved.groupBy(*KEY, "phrase_id", "start").agg(mine.alias("bits"), F.max("needed").alias("needed"))
    near = Window.partitionBy(*KEY, "phrase_id").orderBy("start").rangeBetween(0, slop)
    return lists.withColumn("met", F.bit_count(F.bit_or("bits").over(near))).filter(F.col("met") == F.col("needed")).select(*KEY, "phrase_id", "start")


def _near(words: Column, c: Column, slop: int) -> Column:
    """Whether from some start at most ``slop`` words before the candidate's each term stands at
    most ``slop`` words behind its place."""
    def from_start(s: Column) -> Column:
        def term(o: Column) -> Column:
            low = F.greatest(s + o, F.lit(0))
            return F.array_contains(F.slice(words, low + 1, F.greatest(s + o + slop + 1 - low, F.lit(0))), F.get(c["terms"], o))

        return F.forall(F.sequence(F.lit(0), F.size(c["terms"]) - 1), term)

    return F.exists(F.sequence(c["start"] - slop, c["start"]), from_start)


def phrase_matches(docs: DataFrame, found: DataFrame, index: DataFrame, rare: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   slop: int = SLOP) -> DataFrame:
    """One row for each document with a match: ``matches`` (start, size, phrase_id), exact to
    the word, and ``near``, the phrases with a proximity match."""
    named = bounded(found.select("phrase_id", "terms"))
    wanted = (candidates(index, rare, slop).join(named, "phrase_id")
              .groupBy(*KEY).agg(F.collect_list(F.struct("start", "terms", "phrase_id")).alias("wanted")))
    texts = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm")).withColumn("text_hash", F.xxhash64("norm"))
    pairs = texts.join(wanted.withColumnsRenamed({"doc_id": "id_", "text_hash": "hash_"}),
                       F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")))
    held = pairs.select(*KEY, "wanted", words_of(F.col("norm")).alias("words"))

    def exact(w: Column, c: Column) -> Column:
        return (c["start"] >= 0) & (F.slice(w, F.greatest(c["start"], F.lit(0)) + 1, F.size(c["terms"])) == c["terms"])

    # the words are bound to a variable, so that they are made once for all candidates
    checked = F.transform(F.array("words"), lambda w: F.transform("wanted", lambda c: F.struct(
        c["start"].alias("start"), F.size(c["terms"]).alias("size"), c["phrase_id"].alias("phrase_id"),
        exact(w, c).alias("exact"))))[0]
    close = F.transform(F.array("words"), lambda w: F.filter("wanted", lambda c: exact(w, c) | _near(w, c, slop)))[0]
    out = held.select(*KEY, F.filter(checked, lambda c: c["exact"]).alias("matches"), F.array_distinct(F.transform(close, lambda c: c["phrase_id"])).alias("near"))
    return out.filter(F.size("near") > 0).dropDuplicates(KEY)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of each document,
    whose key is id and text: rows that repeat both are one document.

    A word is hit if it is inside any occurrence of a phrase; ``n_near`` counts the items with
    a proximity match, those that occur exactly among them. Null texts, and items without
    words, have none. Other columns of either table are not read.
    """
    return documents_hit(docs, benchmark, id_col, text_col, item_col, item_text_col).drop("text_hash")


def documents_hit(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """What ``contamination`` gives, and the hash of the text lower-cased in A-Z, so that
    documents that share an id are told apart."""
    items = with_words(benchmark, item_col, item_text_col, "item_id").select("item_id", "words")
    found, owners = phrases(items)
    found, owners = found.select("phrase_id", "terms"), owners.select("phrase_id", "item_id")
    terms = found.select(F.explode("terms").alias("term")).distinct()
    # small, and used more than once: written, so that the documents are counted once
    rare = written(rarest_terms(found, term_counts(docs, terms, id_col, text_col)), "rarest")
    index = build_index(docs, rare.select("term").distinct(), id_col, text_col)
    # two documents may only share a key if they are the same row twice
    lengths = (index.filter("last").groupBy(*KEY).agg(F.coalesce(F.max("at") + 1, F.lit(0)).cast("long").alias("n_words")))
    matched = phrase_matches(docs, found, index, bounded(rare), id_col, text_col)
    covered = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["size"] - 1))))
    hits = matched.select(*KEY, F.size(covered).cast("long").alias("n_hit"))
    sure = F.transform("matches", lambda m: m["phrase_id"])
    told = F.transform("near", lambda p: F.struct(p.alias("phrase_id"), F.array_contains(sure, p).alias("exact")))
    whose = (matched.select(*KEY, F.explode(told).alias("t")).select(*KEY, "t.phrase_id", "t.exact")
             .join(bounded(owners), "phrase_id")
             .groupBy(*KEY).agg(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item_id").cast("string")))).alias("items"),
                                F.size(F.collect_set(F.col("item_id").cast("string"))).alias("n_near")))
    both = (hits.join(whose, _same(hits, whose), "inner")
            .select(hits["doc_id"].alias("id_"), hits["text_hash"].alias("hash_"), "n_hit", "items", "n_near"))
    out = lengths.join(both, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
                      ((n_hit > 0) & (n_hit * ONE_IN >= F.col("n_words"))).alias("contaminated"),
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
