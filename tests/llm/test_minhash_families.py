"""Near-duplicates in a family below the threshold: the few links among its members are found."""

import numpy as np

from rillet.llm import minhash_dedup as md
from rillet.llm import shingles


def family(n, similar, seed=1, words=200, edits=9, vocabulary=60_000):
    """``n`` copies of one text with ``edits`` words replaced (0.7 alike, two by two); the last ``similar`` are
    copies of the first ones with one more word replaced."""
    rng = np.random.default_rng(seed)
    texts = []
    for i in range(n):
        if i >= n - similar:
            text = texts[i - (n - similar)].split()
            text[rng.integers(words)] = f"z{i}"
        else:
            text = [f"t{k}" for k in range(words)]
            for at in rng.choice(words, edits, replace=False):
                text[at] = f"v{rng.integers(vocabulary)}"
        texts.append(" ".join(text))
    return texts


def test_members_left_outside_a_star_are_linked(spark):
    texts = family(600, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in md.near_duplicates(docs, n_words=2).collect()}
    sets = shingles.shingle_sets([t.encode() for t in texts], 2)
    want = list(range(600))
    for i in range(600):
        for j in range(i):
            both = np.intersect1d(sets[i], sets[j]).size
            if 100 * both >= 80 * (sets[i].size + sets[j].size - both):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    assert got == dict(enumerate(want)) and len(set(want)) <= 560
