import numpy as np
from hypothesis import given, settings, strategies as st

from skyledger.llm.common import BoundedCache, shingle_set, word_lists


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t\x0b", max_size=60), st.integers(1, 9))
def test_words_in_pieces_are_the_words(text, size):
    data = text.encode()
    assert [w for words in word_lists(data, size) for w in words] == data.split()


def test_a_full_cache_only_computes_again():
    calls = []
    cache = BoundedCache(lambda k: calls.append(k) or len(k), entries=2, longest=3)
    assert [cache[k] for k in ("a", "bb", "a", "ccc", "a", "long key", "long key")] == [1, 2, 1, 3, 1, 8, 8]
    assert len(cache) <= 2


def test_a_short_sequence_is_one_shingle():
    words = np.arange(1, 5, dtype=np.uint64)
    assert len(shingle_set(words)) == 1 and len(shingle_set(words[:0])) == 0
    assert len(shingle_set(np.arange(9, dtype=np.uint64))) == 5
    assert shingle_set(words[:2]) != shingle_set(words[:3])
