"""SimHash groups against all pairs of brute-force fingerprints."""

import random
import re

import pytest
import xxhash
from tables import AWKWARD, documents, empty, rows

from clearwright.llm import simhash
from clearwright.llm.components import connected_components


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(prints, tau=3):
    """Component by position, all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= tau:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [*AWKWARD, "a b c a b c a b c", "X Y\x0bZ\x0cÄ"])
def test_fingerprint(text):
    assert simhash.simhash(text) % (1 << 64) == brute(text)


def test_fingerprint_of_many_shingles_in_pieces(monkeypatch):
    text = " ".join(str(i) for i in range(500))
    whole = simhash.simhash(text)
    monkeypatch.setattr(simhash, "_HASHES_AT_ONCE", 7)
    assert simhash.simhash(text) == whole


def test_groups(spark):
    data = rows()
    got = simhash.near_duplicates(documents(spark, data)).collect()
    prints = [brute(t) for _, t in data]
    root = groups(prints)
    least = {r: min((i for (i, _), q in zip(data, root) if q == r and i is not None), default=None) for r in root}
    want = sorted((str(i), f"{p:016x}", str(least[r])) for (i, _), p, r in zip(data, prints, root))
    assert sorted((str(r.doc_id), f"{r.fp % (1 << 64):016x}", str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_every_link_is_found_in_any_block_size(spark, block):
    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(30)]
    prints = list({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for c in centres for _ in range(12)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), block=block).collect()
    at = {p: i for i, p in enumerate(signed)}
    assert all((prints[at[a]] ^ prints[at[b]]).bit_count() <= 3 for a, b in links)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(at[a])] = find(at[b])
    want = groups(prints)
    assert len({(find(i), want[i]) for i in range(len(prints))}) == len(set(want)) == len({find(i) for i in range(len(prints))})


def test_budgets_are_the_chain_quotas():
    assert simhash.budgets(8, 3) == [0, 0, 1, 1, 1, 2, 2, 3]


def test_one_row_of_each_group_stays(spark):
    data = rows()
    docs = documents(spark, data)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    prints = {t: brute(t) for _, t in data}
    root = groups([brute(t) for _, t in data])
    got = kept.select("doc_id", "text").collect()
    assert len(got) == len(set(root)) == len({root[[t for _, t in data].index(r.text)] for r in got})
    assert all(r.text in prints for r in got)


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(documents(spark))).collect() == []
    assert simhash.keep_representatives(empty(documents(spark))).collect() == []


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    hub = [(100, 100 + i) for i in range(1, 80)]
    noise = [(7, 7), (None, 3), (101, 100)]
    got = connected_components(spark.createDataFrame(path + hub + noise, "a long, b long"), "a", "b").collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in range(61)} | {(100 + i, 100) for i in range(80)}
    assert len(got) == 61 + 80


def test_only_repeated_rows_are_shuffled_to_be_told_apart(spark):
    texts = ["one two three four", "one two three four", "five six seven", "Five Six Seven", None]
    docs = documents(spark, [(1, texts[0]), (1, texts[0]), (2, texts[1]), (3, texts[2]), (None, texts[4]), (None, texts[4]), (9, texts[3])])
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, texts[0]), (3, texts[2]), (None, None)], key=str)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    union = plan[plan.index("Union"):]
    assert union.count("times#") and "(k#" in union and " = 1)" in union and " > 1)" in union
