"""Links between similar shingle sets against all pairs, also where a group or a key is hot."""

import random

import numpy as np
import pytest
import test_simhash
from tables import SF, documents, empty

from clearwright.llm import shingle_sets as S
from clearwright.llm import simhash


def brute_set(text, width=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similar_pairs(texts, similarity=0.8):
    """All pairs (i, j), j < i, by counting common shingles."""
    sets, holders, common = [brute_set(t) for t in texts], {}, {}
    for i, s in enumerate(sets):
        for x in s:
            for j in holders.setdefault(x, []):
                common[i, j] = common.get((i, j), 0) + 1
            holders[x].append(i)
    return [(i, j) for (i, j), n in common.items() if n >= similarity * (len(sets[i]) + len(sets[j]) - n) - 1e-9]


def stage_groups(texts, similarity):
    """Groups by either law of the pipeline's stage: fingerprints 3 bits apart, or similar sets."""
    root = test_simhash.groups([test_simhash.brute(t) for t in texts])
    for i, j in similar_pairs(texts, similarity):
        if root[i] != root[j]:
            root = [root[j] if r == root[i] else r for r in root]
    return root


def edited(rnd, base, share):
    words = base.split()
    for _ in range(rnd.randrange(1, 2 + int(len(words) * share))):
        words[rnd.randrange(len(words))] = "other"
    return " ".join(words)


def corpus(seed=3):
    """Edited copies around a similarity of 0.8, a hot group of near copies, and a passage that many texts share."""
    rnd = random.Random(seed)
    texts = [" ".join(f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(40, 300))) for _ in range(40)]
    passage = " ".join(f"p{i}" for i in range(120))
    texts += [edited(rnd, b, 0.04) for b in texts[:30] + texts[:1] * 60]
    texts += [passage + " " + " ".join(f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(20, 200))) for _ in range(60)]
    return texts + [None, "", "one two", "One Two", texts[2]]


@pytest.mark.parametrize("block", [3, 512])
def test_every_similar_pair_is_connected(spark, block):
    texts = corpus()
    docs = documents(spark, list(enumerate(texts)))
    node = {r.text: r.d for r in docs.select("text", S.text_digest().alias("d")).distinct().collect()}
    links = [(r.a, r.b) for r in S.similar_links(docs, 0.8, block=block).collect()]
    want = similar_pairs(texts)
    allowed = {frozenset((node[texts[i]], node[texts[j]])) for i, j in want}
    assert links and all(frozenset(x) in allowed for x in links)
    root = {n: n for n in node.values()}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        root[find(a)] = find(b)
    assert all(find(node[texts[i]]) == find(node[texts[j]]) for i, j in want)
    assert len(links) < 4 * len(texts)


def test_one_text_of_each_group_stays(spark):
    texts = corpus(5)
    root = stage_groups(texts, 0.8)
    got = simhash.keep_representatives(documents(spark, list(enumerate(texts))), similarity=0.8)
    assert sorted(r.doc_id for r in got.collect()) == sorted({r: i for i, r in reversed(list(enumerate(root)))}.values())


def test_recall_of_candidates_on_given_documents(spark):
    """All pairs of distinct texts of the given table with a similarity of 0.8 or more are linked."""
    texts = sorted({r.text for r in spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").collect() if r.text})
    docs = documents(spark, list(enumerate(texts)), clash=False)
    node = {r.text: r.d for r in docs.select("text", S.text_digest().alias("d")).collect()}
    want = similar_pairs(texts)
    linked = {r.node: r.component for r in S.connected_components(S.similar_links(docs, 0.8), "a", "b").collect()}
    met = sum(linked.get(node[texts[i]], -1) == linked.get(node[texts[j]], -2) for i, j in want)
    assert want and met == len(want)


def test_bitmaps_never_exclude_a_similar_set():
    rnd = np.random.default_rng(1)
    for size in (1, 5, 200, 5000):
        a = np.unique(rnd.integers(0, 1 << 63, size, dtype=np.uint64))
        for kept in (1.0, 0.9, 0.5, 0.0):
            b = np.unique(np.concatenate((a[:int(len(a) * kept)], rnd.integers(0, 1 << 63, len(a) - int(len(a) * kept), dtype=np.uint64))))
            if S.similar(a, b, 0.8):
                assert S.may_be_similar(S.bitmap(a)[None], np.array([len(a)]), S.bitmap(b), len(b), 0.8).all()


def test_repeated_row_and_empty_table(spark):
    docs = documents(spark, [(1, "a b c d e f g h i j k l m n o p q r s t u v w x y z")] * 300 + [(2, "A b c d e f g h i j k l m n o p q r s t u v w x y z 1")])
    assert len(S.similar_links(docs, 0.8).collect()) == 1
    assert S.similar_links(empty(docs), 0.8).collect() == []


def test_buckets_that_say_nothing_new_are_not_compared(spark):
    rows = [(1, 5, 5), (1, 6, 6)]  # the head met the other node
    rows += [(2, n, 7) for n in (7, 8, 9)]  # one group
    rows += [(k, n, n) for k in (3, 4, 5) for n in (10, 11, 12)]  # the same nodes three times
    rows += [(6, n, n) for n in (10, 11, 13)]
    grouped = spark.createDataFrame(rows, "key long, node long, group long")
    assert sorted(r.key for r in S.open_buckets(grouped).collect()) == [3, 6]
