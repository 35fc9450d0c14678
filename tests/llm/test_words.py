import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tapelake.llm import words as w

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é\t\n\x0b.-0", max_size=40)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.booleans(), st.sampled_from([1, 2, 5, 1 << 18]))
def test_words_are_those_of_a_pattern(texts, alnum, block):
    held, w._BLOCK = w._BLOCK, block
    try:
        data = [None if t is None else t.encode() for t in texts]
        got = w.Words(data, w.ALNUM if alnum else w.SPACED, lower=True)
    finally:
        w._BLOCK = held
    pattern = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" if alnum else rb"[^\x20\x09-\x0D]+"
    want = [re.findall(pattern, (d or b"").lower()) for d in data]
    assert np.diff(got.bounds).tolist() == [len(x) for x in want]
    flat = [x for one in want for x in one]
    assert [got.word(i).lower() for i in range(len(flat))] == flat
    # Equal words have equal hashes, others differ.
    assert len(set(zip(flat, got.hashes.tolist()))) == len(set(flat)) == len(set(got.hashes.tolist()))


def test_packed_keys_come_back():
    from tapelake.llm import chunks
    keys = np.unique(w.mixed(np.arange(5000, dtype=np.uint64)))
    assert (chunks.unpacked48(chunks.packed48(keys)) == keys >> np.uint64(16) << np.uint64(16)).all()
    cuts = chunks.range_cuts(keys, 7)
    assert cuts[0] == 0 and cuts[-1] == len(keys)
    for i in range(7):
        own = chunks.unpacked48(chunks.offsets48(keys[cuts[i]:cuts[i + 1]], i, 7))
        assert len(np.unique(own)) == len(own) and (np.diff(own.astype(float)) > 0).all()
