"""Exact sizes, lossless round trips, and the rules of the kernels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from octavo.functions import codecs, kernels
from octavo.functions.constants import PAGE
from octavo.sources import synthetic

ORDER = ("same_page", "bdi_ref", "bdi", "wkdm32", "wkdm64", "block_class", "ai_fp16", "ai_int8")
#: Golden sizes; 0 where the codec declines.
GOLDEN = {
    "random": (0, 0, 0, 0, 0, 0, 0, 0), "zero": (5, 68, 68, 268, 140, 28, 100, 28), "repeat_val": (0, 580, 580, 1298, 659, 0, 3812, 92),
    "pointer_heavy": (0, 0, 0, 1965, 2729, 0, 2941, 0), "integer_heavy": (0, 0, 0, 1291, 1764, 1695, 1441, 3282),
    "pte": (0, 0, 0, 2381, 3428, 0, 3234, 3675), "ai_fp16": (0, 3468, 3468, 3731, 3596, 3876, 2085, 4032), "ai_int8": (0,) * 8,
    "ai_sparse": (0, 3012, 3012, 3212, 3084, 2972, 3044, 3932), "delta_pair": (0,) * 8, "mixed": (0, 0, 0, 3138, 3496, 4083, 3603, 0),
    "uniform": (5, 580, 580, 1295, 659, 92, 228, 29), "small_200": (0, 1092, 1092, 1292, 2185, 1052, 868, 1052),
    "small_20": (0, 1092, 1092, 1292, 2188, 1052, 868, 1052), "delta_200": (0, 1092, 0, 782, 658, 1116, 1188, 45), "mostly_zero": (0, 140, 140, 290, 164, 49, 122, 74),
}


def made():
    out = {synthetic.PAGE_TYPES[k][0]: synthetic.page(k, 42 + k)[0] for k in synthetic.PAGE_TYPES}
    n = np.arange(512, dtype="<u8")
    return out | {
        "uniform": b"\x42" * PAGE, "small_200": (1 + n % 200).astype("<u8").tobytes(), "small_20": (1 + n % 20).astype("<u8").tobytes(),
        "delta_200": np.tile(np.array([0x100, 0x1C8] + [0x100] * 6, "<u8"), 64).tobytes(), "mostly_zero": bytes(4020) + b"\x07" * 76}


PAGES = made()


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_sizes(name):
    p = np.frombuffer(PAGES[name], np.uint8)[None]
    got = tuple(int(kernels.encoded_size(p, c).filled(0)[0]) for c in ORDER)
    assert got == GOLDEN[name]


@pytest.mark.parametrize("name", GOLDEN)
def test_codes_have_the_size_and_round_trip(name):
    p = np.frombuffer(PAGES[name], np.uint8)[None]
    for c in ("same_page", "bdi", "wkdm32", "wkdm64", "block_class", "ai_fp16", "ai_int8"):
        code, size = codecs.encode(c, PAGES[name]), kernels.encoded_size(p, c)
        assert (code is None) == bool(np.ma.getmaskarray(size)[0])
        if code is not None:
            assert len(code) == size[0]
            assert codecs.decode(c, code) == PAGES[name]


def test_every_codec_encodes_some_page():
    for c in ("same_page", "bdi", "wkdm32", "wkdm64", "block_class", "ai_fp16", "ai_bf16", "ai_int8", "lz4", "zstd"):
        assert any(codecs.encode(c, p) for p in PAGES.values())


def test_wide_deltas_are_declined():
    assert codecs.encode("bdi", PAGES["delta_200"]) is None


words = st.lists(st.sampled_from([0, 1, 200, 0xFFFF, 0x10000, 0xDEADBEEF, 1 << 40, (1 << 64) - 1]), min_size=1, max_size=512)


@settings(max_examples=60, deadline=None)
@given(words)
def test_round_trip_of_word_pages(values):
    page = np.resize(np.array(values, "<u8"), 512).tobytes()
    for c in ("bdi", "wkdm32", "wkdm64", "block_class", "ai_fp16", "ai_int8", "lz4", "zstd"):
        code = codecs.encode(c, page)
        assert code is None or codecs.decode(c, code) == page


def test_dictionary_tags_equal_a_loop():
    rng = np.random.default_rng(3)
    p = rng.choice([0, 0, 1, 7, 255], (4, PAGE)).astype(np.uint8)
    for page, tags in zip(p, kernels.tags32(p)):
        slots, want = [0] * 16, []
        for w in page.view("<u4").tolist():
            k = w >> 4 & 15
            want.append(0 if not w else 1 if slots[k] == w else 2 if w < 1 << 16 else 3)
            slots[k] = w if w else slots[k]
        assert tags.tolist() == want


def test_profile_of_a_known_page():
    page = np.array([[0, 1, 0, 255] + [9] * (PAGE - 4)], np.uint8)
    got = {k: int(v[0]) for k, v in kernels.profile(page).items()}
    assert got["most_common_byte"] == 9 and got["zero_bytes"] == 2 and (got["min_byte"], got["max_byte"]) == (0, 255)
    tie = np.array([[5, 3] * (PAGE // 2)], np.uint8)
    assert kernels.profile(tie)["most_common_byte"][0] == 3


def test_xor_delta():
    assert codecs.xor_delta(codecs.xor_delta(b"\xab" * 64, b"\xcd" * 64), b"\xcd" * 64) == b"\xab" * 64
    assert codecs.xor_delta(b"ab", b"ab") == b"\0\0"
    with pytest.raises(ValueError):
        codecs.xor_delta(b"a", b"ab")


def test_synthetic_pages_depend_on_the_seed(spark):
    rows = synthetic.synthetic_pages(spark, 2).collect()
    assert len(rows) == 22 and all(len(r.page) == PAGE for r in rows)
    assert (rows[9].delta_base is not None) and sum(a != b for a, b in zip(rows[9].page, rows[9].delta_base)) <= 51
    assert synthetic.page(0, 1) == synthetic.page(0, 1) != synthetic.page(0, 2)


def test_batch_coders_equal_the_single_ones():
    from octavo.functions import batches

    rng = np.random.default_rng(2)
    made_ = [rng.choice([0, 0, 0, 1, 2, 255], PAGE).astype(np.uint8).tobytes() for _ in range(12)]
    made_ += [np.resize(rng.choice(np.array([0, 1, 200, 0xFFFF, 0x10000, 0xDEADBEEF, 1 << 40, (1 << 64) - 1], "<u8"), 50), 512).tobytes() for _ in range(12)]
    pages = [*PAGES.values(), *made_]
    p = np.stack([np.frombuffer(x, np.uint8) for x in pages])
    for c in ("same_page", "bdi", "wkdm32", "wkdm64", "block_class", "ai_fp16", "ai_bf16", "ai_int8", "lz4", "zstd"):
        data, offsets = batches.encoded(c, p)
        there = batches.shrinks(c, p, offsets)
        want = [codecs.encode(c, x) for x in pages]
        assert [w is not None for w in want] == there.tolist()
        assert all(data[a:b].tobytes() == w for a, b, w in zip(offsets, offsets[1:], want) if w is not None)
        own = np.flatnonzero(there)
        assert (batches.decoded(c, *batches.taken(data, offsets, own)) == p[own]).all()


def test_kernel_form_of_a_page_of_one_value():
    assert codecs.encode_same_kernel(b"\7" * PAGE) == b"\7" and codecs.encode_same_kernel(b"\7\6" * 2048) is None
    assert codecs.decode_same_kernel(b"\7") == b"\7" * PAGE and codecs.decode_same_kernel(b"\7", 64) == b"\7" * 64
    p = np.frombuffer(b"\7" * PAGE, np.uint8)[None]
    assert int(kernels.encoded_size(p, "same_page_kernel")[0]) == 1


def test_batches_without_some_kind_of_line():
    from octavo.functions import batches

    rng = np.random.default_rng(5)
    raw = rng.integers(0, 1 << 62, (2, 512)).astype("<u8").view(np.uint8)
    one_word = np.repeat(rng.integers(1 << 61, 1 << 62, (2, 64)).astype("<u8"), 8, axis=1).view(np.uint8)
    close = (np.repeat(rng.integers(1 << 61, 1 << 62, (2, 64)), 8, axis=1) + np.tile(np.arange(8), 64)).astype("<u8").view(np.uint8)
    for p in (raw, np.zeros((2, PAGE), np.uint8), one_word, close):
        for c in ("same_page", "bdi", "wkdm32", "wkdm64", "block_class", "ai_fp16", "ai_bf16", "ai_int8", "lz4", "zstd"):
            data, offsets = batches.encoded(c, p)
            own = np.flatnonzero(batches.shrinks(c, p, offsets))
            want = [codecs.encode(c, x.tobytes()) for x in p]
            assert [w is not None for w in want] == np.isin(np.arange(2), own).tolist()
            assert all(data[offsets[k]:offsets[k + 1]].tobytes() == want[k] for k in own)
            assert (batches.decoded(c, *batches.taken(data, offsets, own)) == p[own]).all()
