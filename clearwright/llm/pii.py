"""PII: base detectors, and terms that reveal the protected entities around them, in DataFrame operations only.

Base detectors (leftmost, non-overlapping per kind): email, ip, card (Luhn), phone.  Matches that fail their
test are dropped.  The patterns are written so that long runs of digits or letters cost linear time:
a failed start inside a run is never tried again.

Disclosing terms: a protected entity is a base value, and, above it, what the value shares with others of its kind: the host of an
address, the first half of an ip, the first four digits of a phone number, the first six of a card.  So evidence gathers
where single values do not recur.  Over the corpus, N is the number of distinct texts, n_e those with entity e,
n_t those with term t, and n_et those with t within CONTEXT characters of e.  Counts are smoothed by PRIOR texts with the term, in which it
meets e as often as chance has it: PMI(e; t) = log(N (n_et + PRIOR n_e / N) / (n_e (n_t + PRIOR))).  It is at most about
IC(e) = log(N / n_e), which it nears if t hardly occurs without e, in many texts; PMI / IC is the share of the entity's information that the
term gives away.  From GENERALISE on a term becomes a placeholder, from REMOVE on
it is deleted, wherever it occurs outside of base spans, in texts without the entity too; its largest share over all entities counts.  Both n_e and n_et must reach SUPPORT texts, so that one text alone proves nothing.
Copies of a text count once.  All counts cover the whole corpus, pre-aggregated per key.

A term is a run of letters of any length that lies wholly in the context and outside of base spans.

Cases: null texts are empty and have no spans; rows that share an id are told apart by their texts;
repeated rows get equal results; an empty table gives an empty result.  Only the named columns are read.
Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwright.llm.common import text_digest, written

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 60
SUPPORT = 3
PRIOR = 0.5
GENERALISE = 0.7
REMOVE = 0.95
BROADCAST_ROWS = 200_000

_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_PATTERNS = {
    # A run of local characters is tried from its start, or from the end of the match before it.
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A run of digits with single separators; runs of fewer than 14 digits are passed over.
    "card": r"(?:\G|(?<![0-9]))(?=(?:[0-9][ -]?){13}[0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_HINTS = {"email": "@", "phone": "+"}
_RARE = {"ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}"}
_SPAN = "array<struct<s:int,e:int,v:string>>"
_TERMS = "array<struct<s:int,e:int,share:double>>"
_DOC = ["doc_id", "digest"]


def _words(text: str) -> Column:
    """Distinct lower-cased runs of letters."""
    runs = F.split(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}]+")
    return F.array_distinct(F.transform(F.filter(runs, lambda w: w != ""), F.lower))


def _checked(small: DataFrame) -> DataFrame:
    """A broadcast hint where the stored table is within a fixed bound; else the join shuffles."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def _matches(text: Column, pattern: str | Column) -> Column:
    """Array of (s, e, v) of all matches: pieces between matches and matches alternate."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.char_length(x["gap"])
        e = s + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("v")))
        return F.struct(e.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits: every second digit from the right is doubled."""
    each = F.split(F.reverse(digits), "")

    def add(acc: Column, at: Column) -> Column:
        d = F.element_at(each, at + 1).cast("int")
        twice = d * 2
        return acc + F.when(at % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})?"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.char_length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (s, k, e, v) in order of start, then of KINDS."""
    text = F.coalesce(text, F.lit(""))

    def of_kind(k: int, kind: str) -> Column:
        may = F.contains(text, F.lit(_HINTS[kind])) if kind in _HINTS else text.rlike(_RARE[kind])
        spans = F.filter(_matches(text, _PATTERNS[kind]), lambda x: _holds(kind, x["v"]))
        named = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v")))
        return F.when(may, named).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,v:string>>"))

    return F.array_sort(F.concat(*(of_kind(k, kind) for k, kind in enumerate(KINDS))))


def _kind(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), k + 1)


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stored (doc_id, digest, base, near), a row per row of `docs`; near has what stands around each base span."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", text_digest(text).alias("digest"), whole.alias("t"), base_spans(F.col(text)).alias("base"))

    def around(x: Column) -> Column:
        begin = F.greatest(F.lit(0), x["s"] - CONTEXT)
        left, right = F.substring(F.col("t"), begin + 1, x["s"] - begin), F.substring(F.col("t"), x["e"] + 1, F.lit(CONTEXT))
        # A space stands for the start and the end of the text.
        at_start, at_end = begin == 0, x["e"] + CONTEXT >= F.char_length("t")
        return F.struct((begin - at_start.cast("int")).alias("begin"), F.when(at_start, F.concat(F.lit(" "), left)).otherwise(left).alias("left"),
                        F.when(at_end, F.concat(right, F.lit(" "))).otherwise(right).alias("right"))

    near = F.when(F.size("base") > 0, F.transform("base", around))
    return written(rows.select(*_DOC, "base", near.alias("near")), "pii")


def entities(span: Column) -> Column:
    """The entities that a base span names: its value, and the wider one it belongs to."""
    k, kind = span["k"], _kind(span["k"])
    digits, value = _digits(span["v"]), F.lower(span["v"])
    numbers = k.isin(KINDS.index("card"), KINDS.index("phone"))
    wide = (
        F.when(k == KINDS.index("email"), F.substring_index(value, "@", -1)).when(k == KINDS.index("ip"), F.substring_index(value, ".", 2))
        .when(k == KINDS.index("card"), F.left(digits, F.lit(6))).otherwise(F.left(digits, F.lit(4))))
    return F.array(F.concat_ws(":", kind, F.when(numbers, digits).otherwise(value)), F.concat_ws(":", F.concat(kind, F.lit("-like")), wide))


def mentions(found: DataFrame) -> DataFrame:
    """(doc_id, digest, entity, term, s, e): terms near each base span, with their positions, once per entity of the span."""
    each = found.filter(F.size("base") > 0).select(*_DOC, "base", F.explode(F.arrays_zip("base", "near")).alias("m"))
    span, near = F.col("m.base"), F.col("m.near")
    # The context may cut a word, so a term needs a neighbour on the cut side.
    left = F.transform(_matches(near["left"], r"(?<=[^\p{L}])\p{L}++"), lambda x: F.struct((x["s"] + near["begin"]).alias("s"), (x["e"] + near["begin"]).alias("e"), x["v"].alias("v")))
    right = F.transform(_matches(near["right"], r"(?<!\p{L})\p{L}++(?=[^\p{L}])"), lambda x: F.struct((x["s"] + span["e"]).alias("s"), (x["e"] + span["e"]).alias("e"), x["v"].alias("v")))
    free = F.filter(F.concat(left, right), lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    terms = each.select(*_DOC, entities(span).alias("entities"), F.explode(free).alias("x"))
    return terms.select(*_DOC, F.explode("entities").alias("entity"), "x").select(*_DOC, "entity", F.lower("x.v").alias("term"), F.col("x.s").alias("s"), F.col("x.e").alias("e"))


def disclosing_terms(docs: DataFrame, found: DataFrame, near: DataFrame, text: str = "text", support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """Stored (entity, term, share): pairs whose term gives away at least `threshold` of the entity's information."""
    spans = found.select("digest", F.explode("base").alias("b"))
    holders = spans.select("digest", F.explode(entities(F.col("b"))).alias("entity")).distinct()
    n_e = holders.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= support)
    n_et = near.select("entity", "term", "digest").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).filter(F.col("n_et") >= support)
    total = float(found.select("digest").distinct().count())
    information = F.log(F.lit(total) / F.col("n_e"))
    met = F.col("n_et") + F.lit(PRIOR) * F.col("n_e") / F.lit(total)
    # Texts with the term near any entity are among those with the term, so they bound its share from above.
    near_any = near.select("term", "digest").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    most = F.log(F.lit(total) * met / (F.col("n_e") * (F.col("n_near") + PRIOR)))
    pairs = n_et.join(n_e, "entity").join(near_any, "term").filter(most >= threshold * information - 1e-9).drop("n_near")
    pairs = written(pairs, "pii-pairs")
    terms = written(pairs.select("term").distinct(), "pii-terms")
    listed = _checked(terms.select(F.col("term").alias("listed")))
    if terms.isEmpty():  # nothing to count: no entity has support
        n_t = terms.select("term", F.lit(0).alias("n_t"))
    else:
        words = docs.select(text_digest(text).alias("digest"), F.explode(_words(text)).alias("term"))
        n_t = words.join(listed, F.col("term") == F.col("listed")).select("term", "digest").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    pmi = F.log(F.lit(total) * met / (F.col("n_e") * (F.col("n_t") + PRIOR)))
    share = F.when(information > 0, pmi / information).otherwise(0.0)
    return written(pairs.join(n_t, "term").select("entity", "term", share.alias("share")).filter(F.col("share") >= threshold), "pii-disclosing")


def occurrences(docs: DataFrame, told: DataFrame, text: str = "text") -> DataFrame:
    """(d, g, every) by doc_id and digest: (s, e, share) of every occurrence of a told term, in order; only texts with one, each once."""
    best = written(told.groupBy(F.col("term").alias("listed")).agg(F.max("share").alias("share")), "pii-told")
    rows = docs.select("doc_id", text_digest(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    held = rows.select(*_DOC, F.explode(_words("t")).alias("word")).join(_checked(best), F.col("word") == F.col("listed"))
    held = written(held.groupBy(F.col("doc_id").alias("d"), F.col("digest").alias("g")).agg(F.map_from_entries(F.collect_set(F.struct("word", "share"))).alias("told")), "pii-held")
    kept = rows.join(held, rows.doc_id.eqNullSafe(held.d) & (rows.digest == held.g))
    # The told words of this text as whole runs of letters; words are letters only, so they need no quoting.
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("told"), "|"), F.lit(r")(?!\p{L})"))
    hits = F.transform(_matches(F.col("t"), pattern), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.try_element_at("told", F.lower(x["v"])).alias("share")))
    marked = kept.select(F.col("d"), F.col("g"), F.filter(hits, lambda x: x["share"].isNotNull()).alias("every"))
    return written(marked.dropDuplicates(["d", "g"]), "pii-marked")


def all_spans(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """(doc_id, digest, base, terms), a row per row of `docs`: base spans and (s, e, share) of disclosing terms in order."""
    found = detect(docs, text)
    near = written(mentions(found), "pii-mentions")
    told = disclosing_terms(docs, found, near, text, **options)
    extra = occurrences(docs, told, text)
    both = found.join(extra, found.doc_id.eqNullSafe(extra.d) & (found.digest == extra.g), "left")
    free = F.filter(F.coalesce("every", F.array().cast(_TERMS)), lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return both.select(*_DOC, "base", free.alias("terms"))


def count_of(kind: str) -> Column:
    """Number of base spans of a kind."""
    k = KINDS.index(kind)
    return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")


def span_text(spans: Column) -> Column:
    """kind:start:end of an array of (s, k, e, …), comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", _kind(x["k"]), x["s"], x["e"])), ",")


def every_span_text() -> Column:
    """Base and term spans by start, base ones first among equals."""
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    terms = F.transform("terms", lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("k"), x["e"].alias("e")))
    names = F.array(*map(F.lit, (*KINDS, "term")))
    return F.array_join(F.transform(F.array_sort(F.concat(base, terms)), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def _rewritten(text: Column, base: Column, terms: Column) -> Column:
    """The text with base values replaced by [KIND], disclosing terms by [TERM] or nothing; overlapping spans are one."""
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    marks = F.array_sort(F.concat(
        F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(labels, x["k"] + 1).alias("by"))),
        F.transform(terms, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["share"] >= REMOVE, "").otherwise("[TERM]").alias("by")))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["by"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    return F.aggregate(marks, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """`docs` with personal data and disclosing terms taken out of the text; texts without any are left as they are."""
    spans = all_spans(docs, **options).filter((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(_DOC).select(
        F.col("doc_id").alias("span_id"), F.col("digest").alias("span_digest"), F.col("base").alias("span_base"), F.col("terms").alias("span_terms"))
    # The row travels as one column, so that no column of it can clash with ours.
    keyed = docs.select(F.col("doc_id").alias("of_id"), text_digest().alias("of_digest"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    both = keyed.join(spans, keyed.of_id.eqNullSafe(F.col("span_id")) & (F.col("of_digest") == F.col("span_digest")), "left")
    given = F.col("row")["text"]
    text = F.when(F.col("span_base").isNull(), given).otherwise(_rewritten(F.coalesce(given, F.lit("")), F.col("span_base"), F.col("span_terms")))
    return both.select(*(text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
