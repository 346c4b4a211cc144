"""Words of two blocks whose first lane collides by choice are told apart by every operator that compares words."""

import numpy as np
import pyarrow as pa
import pytest

from cellmend.llm import fingerprints, minhash_dedup, substring_dedup
from cellmend.llm.common import Words, joint_runs, mix64

#: Pairs that an unkeyed chain of ``mix64`` takes for equal.
KNOWN = [("vjlmww7_s-ava3be", "8m4c_t2m__z_8_--")]
LETTERS = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-.", np.uint8)


def chosen(rng, firsts=3000, most=40):
    """Pairs of words of 16 letters that collide in the first lane: second halves that undo what the first halves did."""
    allowed = np.zeros(256, bool)
    allowed[LETTERS] = True
    halves = LETTERS[rng.integers(0, len(LETTERS), (firsts, 8))].astype(np.uint8)
    state = mix64(mix64(np.full(firsts, 16, np.uint64)) ^ np.ascontiguousarray(halves).view(np.uint64)[:, 0])
    partner = {}  # for each difference of two bytes a letter whose partner is a letter, too
    for x in LETTERS.tolist():
        for y in LETTERS.tolist():
            partner.setdefault(x ^ y, x)
    can = np.array([d in partner for d in range(256)])
    out = []
    for i in range(firsts):
        apart = np.ascontiguousarray(state[i] ^ state[i + 1 :]).view(np.uint8).reshape(-1, 8)
        for j in np.flatnonzero(can[apart].all(axis=1)).tolist():
            tail = bytes(partner[d] for d in apart[j].tolist())
            other = bytes(x ^ d for x, d in zip(tail, apart[j].tolist()))
            out.append(((halves[i].tobytes() + tail).decode(), (halves[i + 1 + j].tobytes() + other).decode()))
            if len(out) == most:
                return out
    return out


@pytest.fixture(scope="module")
def pairs():
    found = chosen(np.random.default_rng(6))
    assert len(found) == 40
    return KNOWN + found


def test_words_that_collide_in_one_lane_differ_in_both_hashes(pairs):
    for a, b in pairs:
        words = Words(pa.array([a, b]))
        assert a != b and words.hashes[0] != words.hashes[1] and words.checks[0] != words.checks[1]


def test_a_collision_of_one_hash_is_not_one_of_runs():
    hashes, checks = np.array([7, 7], np.uint64), np.array([1, 2], np.uint64)
    assert len(set(joint_runs(hashes, checks, 1, 5).tolist())) == 2


def test_many_words_have_distinct_hashes():
    rng = np.random.default_rng(7)
    made = {"".join(map(chr, LETTERS[rng.integers(0, len(LETTERS), n)])) for n in rng.integers(1, 80, 60000).tolist()}
    words = Words(pa.array([" ".join(sorted(made))]))
    assert len(np.unique(words.hashes)) == len(np.unique(words.checks)) == len(made)


def test_substrings_and_sets_of_colliding_words_are_apart(spark, pairs):
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(2 * i + j, f"{w} {tail} p{i}") for i, p in enumerate(pairs[:6]) for j, w in enumerate(p)]
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(spark.createDataFrame([(i, f"{t.split()[0]} {tail}") for i, t in rows], "doc_id long, text string")).collect()}
    assert set(removed.values()) == {0}
    alone = spark.createDataFrame([(2 * i + j, w) for i, p in enumerate(pairs) for j, w in enumerate(p)], "doc_id long, text string")
    linked = minhash_dedup.near_duplicates(alone).collect()
    assert all(r["kept"] for r in linked) and len(linked) == 2 * len(pairs)
    prints = [r["fingerprint"] for r in fingerprints.fingerprint_documents(alone).collect()]
    assert len(set(prints)) == len(prints)
