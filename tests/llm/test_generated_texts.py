"""Properties over generated texts."""

import brute
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.llm import decontaminate, langid, licenses, pieces, simhash, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY, TABLE = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PrefixTable(MODEL)
TEXT = st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=200)
WORDY = st.lists(st.sampled_from(["the", "The", "a", "Ärger", "x", "9", "river", "-", "\n", "  ", "日本", "\x85", " "]), max_size=60).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(TEXT, WORDY))
def test_pieces(text):
    ids = LIBRARY.encode(text)
    assert TABLE.both([text]) == [(",".join(map(str, ids)), LIBRARY.decode(ids))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TEXT, WORDY, st.none()), max_size=6))
def test_fingerprints(texts):
    assert simhash.fingerprints(pa.array(texts, pa.string())).tolist() == [brute.fingerprint(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDY, max_size=5), st.lists(WORDY, min_size=1, max_size=4), st.integers(2, 13))
def test_windows_of_items(docs, items, cut):
    items = [*items, *(" ".join(d.split()[:cut]) for d in docs)]
    tests = decontaminate.Tests.of(list(enumerate(items)))
    words, offsets = decontaminate.hashed_words(pa.array(docs, pa.string()))
    at, which = decontaminate.find(words, offsets, tests)
    for k, (doc, n_words, n_hit, found, _) in enumerate(brute.contamination(list(enumerate(docs)), list(enumerate(items)))):
        mine = (at >= offsets[k]) & (at < offsets[k + 1])
        hit = {p for a, w in zip(at[mine], which[mine]) for p in range(a, a + tests.lengths[w])}
        assert offsets[k + 1] - offsets[k] == n_words and len(hit) == n_hit
        assert sorted({tests.names[i] for i in tests.item[which[mine]]}) == found


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(TEXT, WORDY), min_size=1, max_size=6))
def test_signs_of_a_text_do_not_depend_on_its_neighbours(texts):
    data, ends = toxicity.buffers(pa.array(texts))
    s, offsets = toxicity.signs(data, ends)
    for t, a, b in zip(texts, offsets, offsets[1:]):
        one, at = toxicity.signs(*toxicity.buffers(pa.array([t])))
        assert s[a:b].tolist() == one[at[0] : at[1]].tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(TEXT, WORDY), min_size=1, max_size=6))
def test_trigrams_of_a_text_do_not_depend_on_its_neighbours(texts):
    code, counts = langid._trigrams(*langid.buffers(pa.array(texts)))
    _, ends = langid.buffers(pa.array(texts))
    for t, a, b in zip(texts, ends, ends[1:]):
        one, good = langid._trigrams(*langid.buffers(pa.array([t])))
        assert counts[a:b].tolist() == good.tolist() and code[a:b][counts[a:b]].tolist() == one[good].tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(TEXT, WORDY), max_size=6))
def test_shingles_are_runs_of_five_words(texts):
    h, offsets = licenses.shingles(pa.array(texts, pa.string()))
    seen = {}
    for k, t in enumerate(texts):
        words = brute.ALNUM_WORD.findall(t.translate(brute.LOWER))
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        mine = h[offsets[k] : offsets[k + 1]].tolist()
        assert len(mine) == len(grams)
        for x, g in zip(mine, grams):
            assert seen.setdefault(x, g) == g
    assert len(seen) == len(set(seen.values()))
