"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

Windows of `size` words of the benchmark are looked up in the corpus.  One pass counts how often each benchmark
term occurs in the corpus.  Every window then gets a plan: its rarest term leads, and up to LISTS - 1 next
rarest terms follow while their lists are not much longer.  A second pass stores the postings
(term, document, position) of the planned terms; leading terms carry the words around them.  Lists
are intersected on the offset-adjusted start, and the surviving starts are compared with the
window word by word.  A window whose rarest term does not occur costs nothing.

Proximity matches stand on the same leading postings: the words stored around one show whether the window's other terms,
all of them however frequent, lie within `slop` words of their places, and at least `need` of the distinct terms must.  A
place is reckoned from an occurrence of the window's rarest term.

Words: A-Z lower-cased runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`.  An item of fewer words than a window is one window.

Cases: null texts have no words; items without words have no window; items with a null id mark hits
but are not listed; rows that share an id are told apart by their texts; repeated rows get equal results; empty
tables give empty results or clean documents.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearwright.llm.common import text_digest, written

SIZE = 13
LISTS = 3
LONGER = 16
SHORT_LIST = 1000
BROADCAST_ROWS = 200_000
SLOP = 3
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # upper case counts as word here; words are folded later
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DOC = ["doc_id", "digest"]


def _pieces(text: str) -> Column:
    """Unfolded words; the first and the last may be empty."""
    return F.split(F.coalesce(F.col(text), F.lit("")), _SEPARATORS)


def _fold(word: Column) -> Column:
    """A-Z to a-z, nothing else; ASCII takes the fast way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def _checked(small: DataFrame) -> DataFrame:
    """A broadcast hint where the stored table is within a fixed bound; else the join shuffles."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def words(table: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """A row per word: the kept columns, pos (from 0), word, and the unfolded pieces they come from."""
    cut = table.select(*keep, _pieces(text).alias("pieces"))
    skipped = (F.element_at("pieces", 1) == "").cast("int")
    rows = cut.select(*keep, "pieces", skipped.alias("skipped"), F.posexplode("pieces").alias("at", "piece")).filter("piece != ''")
    return rows.select(*keep, "pieces", "at", (F.col("at") - F.col("skipped")).alias("pos"), _fold(F.col("piece")).alias("word"))


def word_count(text: str = "text") -> Column:
    pieces = _pieces(text)
    first, last = F.element_at(pieces, 1) == "", F.element_at(pieces, -1) == ""
    return (F.size(pieces) - first.cast("int") - (last & (F.size(pieces) > 1)).cast("int")).cast("long")


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, phrase, length): the windows of every item, words joined by a space."""
    folded = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    cut = items.select("item_id", F.filter(F.split(folded, _SEPARATORS), lambda w: w != "").alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    each = cut.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(size)).alias("w"))
    return each.select("item_id", F.array_join("w", " ").alias("phrase"), F.size("w").alias("length")).distinct()


def plan(phrases: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """(wid, term, off, turn, lists): the rarest terms of each phrase that can occur; turn 1 leads."""
    terms = phrases.select("wid", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
    known = terms.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    once = known.withColumn("again", F.row_number().over(Window.partitionBy("wid", "term").orderBy("off"))).filter("again = 1")
    order = Window.partitionBy("wid").orderBy("n", "off")
    ranked = once.withColumn("turn", F.row_number().over(order)).withColumn("least", F.min("n").over(Window.partitionBy("wid")))
    useful = (F.col("turn") == 1) | ((F.col("turn") <= lists) & (F.col("n") <= F.greatest(F.lit(SHORT_LIST), LONGER * F.col("least"))))
    chosen = ranked.filter((F.col("least") > 0) & useful)
    return chosen.withColumn("lists", F.count(F.lit(1)).over(Window.partitionBy("wid"))).select("wid", "term", "off", "turn", "lists")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences of each listed term in the corpus."""
    found = words(docs, "doc_id").select("word").join(_checked(terms), F.col("word") == F.col("term"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (term, doc_id, digest, pos, near, from_pos) of the listed (term, left, right).

    `near` has the folded words from position `from_pos` on, as many on either side as the windows that the term leads
    ask for; it is null for terms that lead none (left is null).
    """
    rows = words(docs.select("doc_id", "text", text_digest().alias("digest")), *_DOC)
    found = rows.join(_checked(terms), F.col("word") == F.col("term"))
    begin = F.greatest(F.lit(0), F.col("at") - F.col("left"))
    near = F.slice("pieces", begin + 1, F.col("at") - begin + F.col("right") + 1)
    return written(found.select(
        "term", *_DOC, "pos", F.when(F.col("left").isNotNull(), F.translate(F.array_join(near, " "), _UPPER, _LOWER)).alias("near"),
        (begin - F.col("at") + F.col("pos")).alias("from_pos")), "postings")


def phrase_matches(index: DataFrame, plans: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, digest, wid, start, length): exact occurrences."""
    lists = index.join(_checked(plans), "term").withColumn("start", F.col("pos") - F.col("off")).filter("start >= 0")
    leads = F.col("turn") == 1
    both = lists.groupBy(*_DOC, "start", "wid").agg(
        F.bit_or(F.expr("shiftleft(1, turn - 1)")).alias("met"), F.max("lists").alias("lists"),  # a set: repeated rows count once
        F.max(F.when(leads, F.col("near"))).alias("near"), F.max(F.when(leads, F.col("from_pos"))).alias("from_pos"),
    ).filter("met = shiftleft(1, lists) - 1")
    # A position before the text's first word is an empty piece, at from_pos = -1.
    seen = F.array_join(F.slice(F.split("near", " "), F.col("start") - F.col("from_pos") + 1, F.col("length")), " ")
    return both.join(phrases, "wid").filter(seen == F.col("phrase")).select(*_DOC, "wid", "start", "length")


def proximity_matches(index: DataFrame, plans: DataFrame, phrases: DataFrame, slop: int = SLOP, need: float = 1.0) -> DataFrame:
    """(doc_id, digest, wid, start, met, terms): leading postings around which `met` of the phrase's distinct `terms` lie within `slop` words of their places.

    Only those with met >= need * terms; the index must have been prepared with this slop.
    """
    leads = plans.filter("turn = 1").join(phrases, "wid").select("term", "wid", "off", F.split("phrase", " ").alias("wanted"))
    at = index.filter("near is not null").join(_checked(leads), "term").select(
        *_DOC, "wid", (F.col("pos") - F.col("off")).alias("start"), "wanted", F.split("near", " ").alias("words"), "from_pos")

    def lies_near(word: Column, off: Column) -> Column:
        place = F.col("start") + off - F.col("from_pos")  # in `words`, from 0
        first = F.greatest(F.lit(0), place - slop)
        return F.array_contains(F.slice("words", first + 1, F.greatest(F.lit(0), place + slop - first + 1)), word)

    marked = F.transform("wanted", lambda w, i: F.when(lies_near(w, i), w))
    met, terms = F.size(F.array_distinct(F.array_compact(marked))), F.size(F.array_distinct("wanted"))
    found = at.select(*_DOC, "wid", "start", met.alias("met"), terms.alias("terms"))
    return found.filter(F.col("met") >= need * F.col("terms") - 1e-9).distinct()


def prepare(docs: DataFrame, items: DataFrame, size: int = SIZE, slop: int = SLOP) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(owners, phrases, plans, index): what the benchmark asks for and the postings that answer it."""
    owners = written(windows(items, size), "windows")
    phrases = written(owners.select("phrase", "length").distinct().withColumn("wid", F.monotonically_increasing_id()), "phrases")
    vocabulary = written(phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct(), "vocabulary")
    counts = written(term_counts(docs, vocabulary), "term-counts")
    plans = written(plan(phrases, counts), "plans")
    # A window of one word is met by the posting itself.
    leads, longer = F.col("turn") == 1, F.when(F.col("length") > 1, slop).otherwise(0)
    terms = plans.join(phrases.select("wid", "length"), "wid").groupBy("term").agg(
        F.max(F.when(leads, F.col("off") + longer)).alias("left"), F.max(F.when(leads, F.col("length") - 1 - F.col("off") + longer)).alias("right"))
    return owners, phrases, plans, build_index(docs, written(terms, "planned-terms"))


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, slop: int = SLOP) -> DataFrame:
    """(doc_id, digest, n_words, n_hit, items, near_items, contaminated), a row per row of `docs`; items and near_items are sorted arrays of strings.

    near_items are the items with a window whose terms all lie within `slop` words of their places; they do not decide.
    """
    owners, phrases, plans, index = prepare(docs, items, size, slop)
    matches = written(phrase_matches(index, plans, phrases), "matches")
    spans = matches.groupBy(*_DOC, "start").agg(F.max("length").alias("length"))
    end = F.col("start") + F.col("length")
    earlier = F.max(end).over(Window.partitionBy(*_DOC).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce("earlier", F.lit(0))))
    hits = spans.withColumn("earlier", earlier).groupBy(*_DOC).agg(F.sum(fresh).cast("long").alias("n_hit"))
    named = owners.join(phrases, "phrase").select("wid", F.col("item_id").cast("string").alias("item")).filter("item is not null")

    def listed(found: DataFrame, out: str) -> DataFrame:
        """Per document the items of its matches, and no row without one."""
        of = found.select(*_DOC, "wid").distinct().join(named, "wid").groupBy(*_DOC).agg(F.sort_array(F.collect_set("item")).alias(out))
        return of.withColumnsRenamed({"doc_id": f"{out}_d", "digest": f"{out}_g"})

    rows = docs.select("doc_id", text_digest().alias("digest"), word_count().alias("n_words"))
    hits = hits.withColumnsRenamed({"doc_id": "n_hit_d", "digest": "n_hit_g"})
    near = written(proximity_matches(index, plans, phrases, slop), "near-matches")
    for part, out in ((hits, "n_hit"), (listed(matches, "items"), "items"), (listed(near, "near_items"), "near_items")):
        rows = rows.join(written(part, f"contamination-{out}"), rows.doc_id.eqNullSafe(F.col(f"{out}_d")) & (rows.digest == F.col(f"{out}_g")), "left").drop(f"{out}_d", f"{out}_g")
    n_hit, none = F.coalesce("n_hit", F.lit(0).cast("long")), F.array().cast("array<string>")
    return rows.select(
        *_DOC, "n_words", n_hit.alias("n_hit"), *(F.coalesce(c, none).alias(c) for c in ("items", "near_items")),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs` without contaminated rows."""
    bad = contamination(docs, items).filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("digest").alias("bad_digest")).distinct()
    # The row travels as one column, so that no column of it can clash with ours.
    keyed = docs.select(F.col("doc_id").alias("of_id"), text_digest().alias("of_digest"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return keyed.join(bad, keyed.of_id.eqNullSafe(bad.bad_id) & (keyed.of_digest == bad.bad_digest), "left_anti").select("row.*")
