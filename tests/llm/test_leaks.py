import random

import numpy as np
import pytest

from quarterloom.llm import leaks as K
from quarterloom.llm.wordruns import words

ITEM = " ".join(f"w{k} quay{k % 7} lamp{k % 5}x{k}" for k in range(40))
SAID = ITEM.split()
PAD = " ".join(f"z{k}" for k in range(50))


def altered(said, every, rng):
    out = []
    for k, w in enumerate(said):
        if k % every == every - 1:
            kind = rng.randint(0, 2)
            out += [] if kind == 0 else [f"other{rng.getrandbits(30)}"] if kind == 1 else [w, f"extra{rng.getrandbits(30)}"]
        else:
            out.append(w.upper() if k % 3 == 0 else w)
    return out


def found(items, text):
    return sorted(key for _, key, *_ in items.found([text]))


def test_words_are_compared_without_their_dress():
    same = lambda a, b: words([a]).hashes.tolist() == words([b]).hashes.tolist()
    assert same("Fen\u200bley wal-\nnut ﬁne DON’T", "fenley walnut fine don't")
    assert same("A_b, c", "a b c") and not same("ab", "ba") and not same("a b", "ab")
    got = words(["one two", None, "", "'' !", "three", "x" * 100_000])
    assert np.diff(got.starts).tolist() == [2, 0, 0, 0, 1, 1]
    assert words([]).starts.tolist() == [0]


def test_alignment():
    rng = random.Random(3)
    items = K.Items([(1, ITEM), (2, "short"), (3, None)])
    assert next(iter(items.found([f"{PAD} {ITEM}, {PAD}"])))[1:3] == (1, 1.0)
    half = " - ".join(altered(SAID[20:80], 9, rng))
    assert found(items, f"{PAD}\n{half}\n{PAD}") == [1]
    assert found(items, " ".join(SAID[:40]) + PAD) == []
    scattered = f" {PAD} ".join(" ".join(SAID[k : k + 12]) for k in range(0, 120, 12))
    assert found(items, scattered) == []
    assert found(items, None) == [] and found(items, "") == [] and found(items, "w0") == []
    # A very long text is aligned in windows, with the same result.
    noise = ["z"] * 5000
    assert found(items, " ".join(noise + SAID[:6] + noise + SAID)) == [1]


def test_an_exact_part_counts_though_the_alignment_goes_on():
    tail = [w if k % 3 else f"q{k}" for k, w in enumerate(SAID[50:])]
    assert found(K.Items([(1, ITEM)]), " ".join(SAID[:50] + tail)) == [1]


@pytest.mark.parametrize("copies", [1, 4, 5, 50])
def test_repeated_items_are_all_found(copies):
    items = K.Items([(k, ITEM) for k in range(copies)])
    assert found(items, f"{PAD} {ITEM}") == list(range(copies))


def test_items_that_differ_little_hide_nothing():
    rng = random.Random(8)
    versions = [" ".join([*SAID[:60], *rng.choices(SAID, k=10), *SAID[60:]]) for _ in range(20)]
    assert found(K.Items(list(enumerate(versions))), versions[3]) == list(range(20))


@pytest.mark.parametrize("size", [4, 5, 7, 8, 11, 12, 13, 15, 17, 30, 90])
def test_recall_of_edited_parts_by_length(size):
    """Two fifths of an item, and a bit more, with every k-th word changed, lost or followed by another one: all are found."""
    rng = random.Random(size)
    vocabulary = [f"v{k}" for k in range(2000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=size))) for k in range(40)]
    for every in (5, 8, 12, 10**6):
        set_ = K.Items(items)
        for key, text in items:
            said = text.split()
            part = min(size, int(np.ceil(K._least(size) * (every / (every - 1) + 0.15))))
            at = rng.randint(0, size - part)
            assert key in found(set_, " ".join([*rng.choices(vocabulary, k=30), *altered(said[at : at + part], every, rng), *rng.choices(vocabulary, k=30)]))


def test_alignment_table_against_brute_force():
    rng = random.Random(4)
    pairs = [tuple(np.array(rng.choices(range(4, 8), k=rng.randint(1, 14)), np.uint64) * np.uint64(4) for _ in range(2)) for _ in range(60)]
    for (a, b), (share, alike) in zip(pairs, K.held_all(pairs)):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (K.MATCH if a[i - 1] == b[j - 1] else K.MISMATCH), h[i - 1, j] + K.GAP, h[i, j - 1] + K.GAP)
        assert (share, alike) == K.held(a, b)
        if share:
            assert alike >= K.ALIKE and round(share * len(b)) >= K._least(len(b)) and h.max() >= 3 * K._least(len(b))


def test_blocks_change_nothing(spark):
    rng = random.Random(5)
    docs = [(1, ITEM), (2, None), (3, ""), (4, "nothing here at all of it"), (5, " ".join(altered(SAID[:70], 8, rng))), (1, ITEM)]
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "w0 quay0"), (10, ITEM), (11, "nothing here at all")], "item_id bigint, text string")
    one = sorted((r.doc_id, r.item_id) for r in K.leaked(df, items).collect())
    assert one == [(1, 7), (1, 7), (1, 10), (1, 10), (4, 11), (5, 7), (5, 10)]
    assert sorted((r.doc_id, r.item_id) for r in K.leaked(df, items, block=300).collect()) == one
    assert K.leaked(df.limit(0), items).count() == 0 and K.leaked(df, items.limit(0)).count() == 0
