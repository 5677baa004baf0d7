"""Regexes over many texts, by way of an index of the literal pieces that a match must hold.

Every literal factor a regex needs is read off its syntax.  The grams of these factors are looked up among the texts'
own grams, counted over the corpus, and each regex is tried only on texts that hold its rarest gram.  Where each alternative has a
factor with a space between words, the grams are seams, the letters on both sides of a space: a text has one per word
and not one per position.  Other regexes are looked up by n-grams of all positions.  Texts
travel as 64-bit keys until candidates are known; a key that two texts share costs one more trial of
the regex and nothing else.  No row holds a text per position, and grams are never the side that is broadcast.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearwright.operators.tables import materialize

# Lengths of grams, the best first; a shorter one is taken only where no factor is long enough.
GRAMS = (8, 4, 2)
# Letters before and behind a space, the best first; `10 * before + behind` stands where a gram has its length.
SEAMS = (44, 33, 22, 12, 21)
CHUNK = 65_536
BROADCAST_ROWS = 200_000
BLOCK = 64

_ESCAPE = re.compile(r"\\(?:[pPN]\{[^}]*\}|[pP].|x\{[^}]*\}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|k<[^>]*>|0[0-7]+|c.|[0-9]+|.)", re.S)
_FLAGS = re.compile(r"\(\?([A-Za-z]*)(?:-[A-Za-z]*)?\)")
_GROUP = re.compile(r"\((?:\?(?:<[A-Za-z][A-Za-z0-9]*>|>|([ims]*)(?:-[ims]*)?:))?(?!\?)")
_QUANTIFIER = re.compile(r"(?:[?*+]|\{[0-9]*,?[0-9]*\})[?+]?")


class _Unclear(Exception):
    """Syntax this reader does not follow."""


def required_factors(pattern: str | None) -> list[list[str]]:
    """Lower-cased ASCII texts that matches hold: one list per alternative, of which all hold.  Empty where that is not plain."""
    try:
        flags = _FLAGS.match(pattern or "")
        if flags and set(flags.group(1)) & set("uxU"):
            return []  # wider case folding, or white space and comments
        found, end = _alternatives(pattern or "", flags.end() if flags else 0)
        if end != len(pattern or ""):
            return []
    except (_Unclear, RecursionError):
        return []
    return found if all(found) else []


def _class_end(p: str, at: int) -> int:
    """Behind a bracket expression, which may hold others."""
    depth, at = 1, at + 1
    if p[at:at + 1] == "^":
        at += 1
    if p[at:at + 1] == "]":
        raise _Unclear
    while depth:
        if at >= len(p):
            raise _Unclear
        if p[at] == "\\":
            if p.startswith("\\Q", at):
                raise _Unclear
            at += len(_ESCAPE.match(p, at).group(0)) if _ESCAPE.match(p, at) else 1
            continue
        depth += (p[at] == "[") - (p[at] == "]")
        at += 1
    return at


def _quantifier(p: str, at: int) -> tuple[bool, int]:
    """Whether what stands before may be missing, and the place behind the quantifier."""
    q = _QUANTIFIER.match(p, at)
    return (bool(q) and q.group(0)[0] != "+", q.end() if q else at)


def _alternatives(p: str, at: int) -> tuple[list[list[str]], int]:
    """Factors of each alternative up to a closing bracket or the end."""
    done: list[list[str]] = []
    factors: list[str] = []
    choices: list[list[list[str]]] = []
    run = ""

    def flush() -> None:
        nonlocal run
        if run:
            factors.append(run)
        run = ""

    def close() -> None:
        nonlocal factors, choices
        flush()
        longest = max(map(len, factors), default=0)
        better = [c for c in choices if all(c) and min(max(map(len, a)) for a in c) > longest]
        if better:  # a group of alternatives says more than the rest
            done.extend(factors + a for a in better[0])
        else:
            done.append(factors)
        factors, choices = [], []

    while at < len(p):
        c = p[at]
        if c == ")":
            break
        if c == "|":
            close()
            at += 1
        elif c == "(":
            flush()
            group = _GROUP.match(p, at)
            look = re.compile(r"\(\?(?:[=!]|<[=!])").match(p, at)
            if not (group or look):
                raise _Unclear
            inner, end = _alternatives(p, (look or group).end())
            if p[end:end + 1] != ")":
                raise _Unclear
            optional, at = _quantifier(p, end + 1)
            if look or optional:
                continue
            if len(inner) == 1:
                factors.extend(inner[0])
            else:
                choices.append(inner)
        elif c == "[":
            flush()
            _, at = _quantifier(p, _class_end(p, at))
        elif c in ".^$":
            flush()
            _, at = _quantifier(p, at + 1)
        else:
            letter, at = c, at + 1
            if c == "\\":
                escape = _ESCAPE.match(p, at - 1)
                if not escape or escape.group(0) in ("\\Q", "\\E"):
                    raise _Unclear
                letter, at = escape.group(0)[1:], escape.end()
                if len(letter) > 1 or letter.isalnum():
                    letter = ""
            elif c in "?*+{":
                raise _Unclear
            optional, after = _quantifier(p, at)
            if not letter.isascii() or not letter or optional:
                flush()
            else:
                run += letter.lower()
                if after != at:
                    flush()
            at = after
    close()
    return done, at


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _factors(patterns: pd.Series) -> pd.Series:
    return patterns.map(required_factors)


def compiles(pattern: Column) -> Column:
    """Whether the engine that runs the regexes accepts one; judged where the row is."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def grams_of(text: Column, n: int) -> Column:
    """Distinct lower-cased n-grams of a text, in linear time."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _seam(n: int) -> str:
    """The seam of size `n` at each place as a regex; no space but the one between."""
    return f"(?=([^ ]{{{n // 10}}} [^ ]{{{n % 10}}}))"


def _pieces_of(n: int) -> Column:
    """The grams or seams of size `n` in the factors `texts`."""
    found = (lambda t: F.regexp_extract_all(t, F.lit(_seam(n)), F.lit(1))) if n in SEAMS else (lambda t: grams_of(t, n))
    return F.array_distinct(F.flatten(F.transform("texts", found)))


def _reach(n: int) -> int:
    """Characters that a gram or seam of size `n` has."""
    return n // 10 + n % 10 + 1 if n in SEAMS else n


def _probes(patterns: DataFrame) -> DataFrame:
    """(pattern, alternative, n, gram) for patterns with factors, n and gram null for the others."""
    each = patterns.select("pattern").distinct().where(compiles(F.col("pattern"))).withColumn("factors", _factors("pattern"))
    rows = each.select("pattern", F.posexplode_outer("factors").alias("alternative", "texts"))
    longest = F.array_max(F.transform("texts", F.length))
    size = F.coalesce(*(F.when(F.exists("texts", lambda t: F.regexp_like(t, F.lit(_seam(n)))), F.lit(n)) for n in SEAMS),
                      *(F.when(longest >= n, F.lit(n)) for n in GRAMS))
    # A pattern is indexed if each of its alternatives is.
    sized = rows.withColumn("n", size)
    bare = sized.where("n IS NULL").select("pattern").distinct()
    pieces = F.coalesce(*(F.when(F.col("n") == n, _pieces_of(n)) for n in (*SEAMS, *GRAMS)))
    indexed = sized.join(bare, "pattern", "left_anti").select("pattern", "alternative", "n", F.explode(pieces).alias("gram"))
    none = F.lit(None)
    return indexed.unionByName(bare.select("pattern", none.cast("int").alias("alternative"), none.cast("int").alias("n"), none.cast("string").alias("gram")))


def joined(big: DataFrame, small: DataFrame, rows: int, on: str | list[str], how: str = "inner") -> DataFrame:
    """An equi-join that broadcasts the small side up to a number of rows and shuffles beyond; never the big side."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("merge"), on, how)


def text_key(value: Column) -> Column:
    return F.xxhash64(value)


def postings(texts: DataFrame, wanted: DataFrame, sizes: list[int], rows: int) -> DataFrame:
    """(gram, key): which texts hold which of the wanted grams; a long text is cut into pieces that overlap.

    Equal texts repeat their rows, and a text those of its repeated seams; no shuffle is spent on that, as candidates are made distinct later.
    """
    value, reach = F.col("value"), max(map(_reach, sizes))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(value) - 1) / CHUNK)).cast("int"))
    piece = F.when(F.length(value) <= CHUNK, F.array(value)).otherwise(
        F.transform(starts, lambda i: F.substring(value, i * CHUNK + 1, F.lit(CHUNK + reach - 1))))
    pieces = texts.where(F.length("value") >= min(map(_reach, sizes))).select(text_key(value).alias("key"), F.explode(piece).alias("piece"))
    grams, seams = [n for n in sizes if n not in SEAMS], [n for n in sizes if n in SEAMS]
    found = None
    if grams:
        every = F.concat(*(grams_of(F.col("piece"), n) for n in grams))
        found = joined(pieces.select("key", F.explode(every).alias("gram")), wanted, rows, "gram")
    if seams:
        words = pieces.select("key", F.split(F.lower("piece"), " ").alias("words")).where(F.size("words") > 1)
        pair = F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.size("words") - 1).alias("b"))
        pairs = words.select("key", F.inline(pair).alias("a", "b"))
        at = [F.when((F.length("a") >= n // 10) & (F.length("b") >= n % 10),
                     F.concat(F.right("a", F.lit(n // 10)), F.lit(" "), F.left("b", F.lit(n % 10)))) for n in seams]
        rest = joined(pairs.select("key", F.explode(F.array(*at)).alias("gram")).where("gram IS NOT NULL"), wanted, rows, "gram")
        found = rest if found is None else found.unionByName(rest)
    return found


def matches(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """`texts` (with a column `value`) once per distinct pattern that finds a match in it, as column `pattern`.

    Patterns that the regex engine does not accept match nothing; `compiles` lists them.
    """
    probes = materialize(_probes(patterns))
    hits = texts.limit(0).withColumn("pattern", F.lit(""))
    wanted = materialize(probes.where("gram IS NOT NULL").select("n", "gram").distinct())
    sizes = sorted(r.n for r in wanted.select("n").distinct().collect())
    if sizes:
        rows = wanted.count()
        found = materialize(postings(texts, wanted.select("gram").distinct(), sizes, rows))
        counts = found.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
        known = probes.where("gram IS NOT NULL").join(counts, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
        rarest = materialize(known.groupBy("pattern", "alternative").agg(F.min(F.struct("texts", "gram")).alias("r"))
                             .where("r.texts > 0").select("pattern", F.col("r.gram").alias("gram")).distinct())
        candidates = materialize(joined(found, rarest, rarest.count(), "gram").select("key", "pattern").distinct())
        keyed = texts.withColumn("key", text_key(F.col("value"))).join(candidates, "key")
        hits = keyed.where(F.expr("value RLIKE pattern")).drop("key").select(*texts.columns, "pattern")
    bare = probes.where("gram IS NULL").select("pattern")
    count = bare.count()
    if count:  # nothing to look up: blocks of patterns, each tried on every text
        blocks = -(-count // BLOCK)
        dealt = bare.groupBy(F.pmod(F.xxhash64("pattern"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("pattern").alias("patterns"))
        every = texts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        tried = joined(every, dealt, count, "block")
        found = F.filter("patterns", lambda p: F.regexp_like(F.col("value"), p))
        hits = hits.unionByName(tried.select(*texts.columns, F.explode(found).alias("pattern")))
    return hits
