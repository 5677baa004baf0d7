"""Small tables for the tests, with awkward rows and columns whose names clash with the operators' own."""

import random

SF = "/root/testdata/sf0.001"
CLASHING = ("digest", "fp", "label", "component_id", "base", "terms", "near", "word", "pos", "pieces", "start", "ids", "decoded", "score", "kept_id",
            "digest_of_row", "row", "size", "text_crc32", "repeat", "slot", "node", "key")
AWKWARD = [None, "", " \t\n", "one", "one two", "One  TWO", "Ärger ÉCOLE Σ İ", "x" * 5000, "word " * 4000, "漢字 かな 😀", "<|endoftext|> a <|startoftext|>"]


def rows(seed=1, n=40):
    """(doc_id, text): words of a small vocabulary, exact and near copies, awkward texts, a repeated row and a repeated id."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 120))) for _ in range(n)]
    for base in texts[:8]:
        changed = base.split()
        changed[rnd.randrange(len(changed))] = "other"
        texts += [base, " ".join(changed)]
    out = list(enumerate(texts + AWKWARD))
    return [*out, out[3], (out[4][0], "another text with the same id"), (None, "a row without an id")]


def documents(spark, data=None, clash=True):
    data = rows() if data is None else data
    extra = CLASHING if clash else ()
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in extra)
    filled = [(i, t, "en", None if i is None else f"s{i % 3}", None if t is None else len(t), *("x" for _ in extra)) for i, t in data]
    return spark.createDataFrame(filled, schema)


def empty(df):
    return df.limit(0)
