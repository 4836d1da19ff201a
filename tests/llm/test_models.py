"""Models on held-out labelled samples, and round trips of codes and tokens."""

import html
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sextant.llm import huffman, pages, secrets, trees
from sextant.llm.dom import blocks_of
from sextant.llm.tokens import WordCachedTokenizer, vocabulary_path


def test_field_on_held_out_pages():
    model = pages.default_model()
    right = total = 0
    for x, y in pages.training_set(seed=99, n=120):
        right += int((model.decode(x) == y).sum())
        total += len(y)
    assert right / total > 0.97


def test_decoding_is_the_best_sequence():
    model, rng = pages.default_model(), np.random.default_rng(4)
    for _ in range(20):
        x = (rng.random((6, pages.N_FEATURES)) < 0.2).astype(float)
        e = x @ model.emit

        def score(y):
            return model.first[y[0]] + sum(e[i, v] for i, v in enumerate(y)) + sum(model.step[a, b] for a, b in zip(y, y[1:]))

        best = max(score([(k >> i) & 1 for i in range(6)]) for k in range(64))
        assert abs(score(model.decode(x).tolist()) - best) < 1e-9


def test_driver_like_page():
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy now.</div>'
        "<article><h1>A title &amp; more</h1><p><b>First words of it.<br><p>Second paragraph, with words in it.</p></article><div class=comments><p>I think this is a comment, and a long one.</p></div>"
        "<form><input><label>Mail</label></form><footer>&copy; site &middot; rights</footer></body></html>"
    )
    assert pages.main_text(page, pages.default_model()) == "A title & more First words of it. Second paragraph, with words in it."


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("<>/ab =\"'&;p!-\n\x00é")), max_size=80))
def test_any_markup_is_read(page):
    for b in blocks_of(page):
        assert b.text and b.text == " ".join(b.text.split())


def test_text_of_blocks():
    assert [b.text for b in blocks_of("<p>a&nbsp; &lt;b&gt;<i>c</i>d<br>e</p>f<script>x</script>g")] == ["a <b>cd e", "fg"]
    assert html.unescape("&amp;amp;") == "&amp;"


def test_secret_model_on_held_out_samples():
    w, size = secrets.default_weights(), len(secrets.ALPHABET) + 1
    place = {c: i + 1 for i, c in enumerate(secrets.ALPHABET)}
    right = {0: [], 1: []}
    for text, label in secrets.labelled_samples(seed=77):
        if len(text) >= secrets.LEAST_LENGTH:
            ratio = sum(w[place.get(a, 0) * size + place.get(b, 0)] for a, b in zip(text, text[1:]))
            right[label].append((ratio >= max(secrets.IN_ALL, secrets.PER_PAIR * (len(text) - 1))) == bool(label))
    assert np.mean(right[0]) > 0.99 and np.mean(right[1]) > 0.93


def test_trees_learn_and_are_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(12 * x[:, 1]) + 0.1 * rng.standard_normal(3000)) > 0.6).astype(float)
    model = trees.train(x[:2000], y[:2000], np.array([1, 0, -1]))
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    for j, sign in ((0, 1), (2, -1)):
        grid = np.repeat(x[:50], 40, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(model.margin(grid).reshape(50, 40), axis=1) * sign
        assert steps.min() >= -1e-12


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65_535), max_size=700), min_size=1, max_size=6), st.integers(0, 3))
def test_codes_round_trip(docs, skew):
    ids = np.array([i >> (4 * skew) for d in docs for i in [*d, 2]], np.uint16)
    counts = np.array([len(d) + 1 for d in docs], np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=huffman.ID_VALUES))
    used = lengths[lengths > 0]
    assert used.max() <= huffman.LIMIT and (2.0**-used).sum() <= 1
    codes = huffman.canonical_codes(lengths)
    payload, at, inside = huffman.encode_batch(ids, counts, lengths, codes)
    first = np.cumsum(counts) - counts
    places = huffman._checkpoint_places(first, counts)
    k = -(-counts // huffman.CHECKPOINT)
    size = np.full(len(places), huffman.CHECKPOINT)
    size[np.cumsum(k) - 1] = counts - (k - 1) * huffman.CHECKPOINT
    bit_at = inside[places] + np.repeat(at[:-1] * 8, k)
    assert (huffman.decode_lanes(payload, bit_at, size, huffman.decode_table(lengths, codes)) == ids).all()


def test_codes_reach_the_limit():
    counts = np.zeros(huffman.ID_VALUES, np.int64)
    counts[:40] = 2 ** np.arange(40, dtype=np.int64)
    lengths = huffman.code_lengths(counts)
    assert lengths.max() == huffman.LIMIT and abs((2.0 ** -lengths[lengths > 0]).sum() - 1) < 1e-12
    assert huffman.code_lengths(np.ones(huffman.ID_VALUES, np.int64)).max() == 16


TOKENIZER = WordCachedTokenizer(vocabulary_path(), cache_entries=300)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aBcé'sTdlm. ,!?09_-\n\t\x1c\x85\xa0<|>ſKİΣßŉ")), st.characters()), max_size=40), min_size=1, max_size=4))
def test_tokens_equal_the_library(texts):
    texts = [re.sub(r"[\ud800-\udfff]", "", t) for t in texts] + ["Don't <|endoftext|> stop'em", None]
    got = TOKENIZER.encode_texts(texts)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, np.uint16).tolist() == TOKENIZER._tok.encode(t or "", add_special_tokens=False).ids


def test_another_vocabulary_is_left_to_the_library():
    other = WordCachedTokenizer(vocabulary_path("byte_bpe_50k.json"))
    assert TOKENIZER.by_chunks and not other.by_chunks
    texts = ["Two  words\n", "", None, "é😀 x"]
    assert [np.frombuffer(x, np.uint16).tolist() for x in other.encode_texts(texts)] == [other._tok.encode(t or "", add_special_tokens=False).ids for t in texts]
