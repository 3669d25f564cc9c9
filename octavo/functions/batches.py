"""Codec bytes for whole batches of pages: every step handles all pages of a batch in a few NumPy calls.

The layouts are those of ``codecs``, page by page; a batch of codes is one flat
array of bytes with the offsets of its pages.
"""

from __future__ import annotations

import math

import numpy as np

from . import codecs, kernels
from .constants import DENSE, LINE, LINES, PAGE, SMALL_RANGE, SPARSE, UNIFORM, ZERO


def _place(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Writes each row's bytes from its place on."""
    out[at[:, None] + np.arange(rows.shape[1])] = rows


def _rows(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return data[at[:, None] + np.arange(n)]


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Rows of values, little-endian, so many bits each."""
    return np.packbits((values[..., None] >> np.arange(bits) & 1).astype(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(rows: np.ndarray, n: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(rows, axis=1, bitorder="little")[:, :n * bits]
    return (flat.reshape(len(rows), n, bits).astype(np.int64) << np.arange(bits)).sum(2)


def _ranks(owner: np.ndarray) -> np.ndarray:
    """The number of each value within its run; owners come in order."""
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
    return np.arange(len(owner)) - np.repeat(first, np.diff(first, append=len(owner)))


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _encode_blocks(blocks: np.ndarray, header: np.ndarray, kinds: np.ndarray, payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat, offsets) of pages of classified blocks, each behind its header."""
    pages, _, length = blocks.shape
    sizes = header.shape[1] + payload.sum(1)
    offsets = _offsets(sizes)
    out = np.zeros(offsets[-1], np.uint8)
    _place(out, offsets[:-1], header)
    at = (offsets[:-1, None] + header.shape[1] + np.cumsum(payload, 1) - payload).ravel()
    flat, kind = blocks.reshape(-1, length), kinds.ravel()
    own = kind == UNIFORM
    out[at[own]] = flat[own, 0]
    own = kind == DENSE
    _place(out, at[own], flat[own])
    own = np.flatnonzero(kind == SPARSE)
    there = flat[own] != 0
    _place(out, at[own], np.packbits(there, axis=1, bitorder="little"))
    row, col = np.nonzero(there)
    out[at[own][row] + length // 8 + _ranks(row)] = flat[own[row], col]
    own = np.flatnonzero(kind == SMALL_RANGE)
    low = flat[own].min(1)
    spread = flat[own].max(1) - low
    out[at[own]], out[at[own] + 1] = low, spread
    bits = kernels.BITS[spread]
    for b in np.unique(bits).tolist():
        mine = own[bits == b]
        _place(out, at[mine] + 2, _pack((flat[mine] - low[bits == b, None]).astype(np.int64), b))
    return out, offsets


def _decode_blocks(data: np.ndarray, at: np.ndarray, kinds: np.ndarray, length: int) -> np.ndarray:
    """Blocks of the pages whose payloads begin at the places; block by block, for all pages at once."""
    pages, many = kinds.shape
    out, at = np.zeros((pages, many, length), np.uint8), at.copy()
    for k in range(many):
        kind = kinds[:, k]
        own = np.flatnonzero(kind == UNIFORM)
        out[own, k] = data[at[own], None]
        at[own] += 1
        own = np.flatnonzero(kind == DENSE)
        out[own, k] = _rows(data, at[own], length)
        at[own] += length
        own = np.flatnonzero(kind == SPARSE)
        if len(own):
            there = np.unpackbits(_rows(data, at[own], length // 8), axis=1, bitorder="little").astype(bool)
            row, col = np.nonzero(there)
            out[own[row], k, col] = data[at[own][row] + length // 8 + _ranks(row)]
            at[own] += length // 8 + there.sum(1)
        own = np.flatnonzero(kind == SMALL_RANGE)
        if len(own):
            low, bits = data[at[own]], kernels.BITS[data[at[own] + 1]]
            for b in np.unique(bits).tolist():
                mine = own[bits == b]
                size = (length * b + 7) // 8
                out[mine, k] = low[bits == b, None] + _unpack(_rows(data, at[mine] + 2, size), length, b).astype(np.uint8)
                at[mine] += 2 + size
    return out


def _u16(*values: int) -> np.ndarray:
    return np.array(values, "<u2").view(np.uint8)


def _encode_classed(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, payload = kernels.block_shapes(blocks)
    packed = _pack(kinds, 3)
    header = np.concatenate([np.tile(_u16(LINES, packed.shape[1]), (len(blocks), 1)), packed], 1)
    return _encode_blocks(blocks, header, kinds, payload)


def _decode_classed(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    kinds = _unpack(_rows(data, offsets[:-1] + 4, 24), LINES, 3)
    return _decode_blocks(data, offsets[:-1] + 28, kinds, LINE)


def _encode_split(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = p.reshape(len(p), LINES, LINE // 2, 2).transpose(0, 1, 3, 2).reshape(len(p), 2 * LINES, LINE // 2)
    kinds, payload = kernels.block_shapes(rows)
    halves = [np.pad(_pack(kinds[:, k::2], 3), ((0, 0), (0, 24))) for k in (0, 1)]
    header = np.concatenate([np.tile(_u16(LINES, 48), (len(p), 1)), *halves], 1)
    return _encode_blocks(rows, header, kinds, payload)


def _decode_split(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    kinds = np.empty((len(offsets) - 1, 2 * LINES), np.int64)
    for k in (0, 1):
        kinds[:, k::2] = _unpack(_rows(data, offsets[:-1] + 4 + 48 * k, 24), LINES, 3)
    rows = _decode_blocks(data, offsets[:-1] + 100, kinds, LINE // 2)
    return rows.reshape(-1, LINES, 2, LINE // 2).transpose(0, 1, 3, 2).reshape(-1, PAGE)


def _bytes_of(values: np.ndarray) -> np.ndarray:
    """Rows of the values' bytes; the width is given, as none can be guessed from no rows."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize * math.prod(values.shape[1:]))


def _encode_words(p: np.ndarray, tags: np.ndarray, word: str, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, size = p.view(word), np.dtype(word).itemsize
    n = words.shape[1]
    exact, partial, miss = ((tags == k).sum(1) for k in (1, 2, 3))
    offsets = _offsets(12 + n // 4 + exact + partial * size // 2 + miss * size)
    out = np.zeros(offsets[-1], np.uint8)
    _place(out, offsets[:-1], _bytes_of(np.stack([np.full(len(p), n), exact, partial], 1).astype("<u4")))
    _place(out, offsets[:-1] + 12, _pack(tags.astype(np.int64), 2))
    at = offsets[:-1] + 12 + n // 4
    for kind, made in ((1, lambda w, s: s.astype(np.uint8)[:, None]), (2, lambda w, s: _bytes_of(w)[:, :size // 2]), (3, lambda w, s: _bytes_of(w))):
        row, col = np.nonzero(tags == kind)
        if len(row):
            rows = made(words[row, col], slots[row, col])
            _place(out, at[row] + _ranks(row) * rows.shape[1], rows)
        at = at + (tags == kind).sum(1) * {1: 1, 2: size // 2, 3: size}[kind]
    return out, offsets


def _decode_words(data: np.ndarray, offsets: np.ndarray, word: str, shift: int, mask: int) -> np.ndarray:
    size, pages = np.dtype(word).itemsize, len(offsets) - 1
    n = PAGE // size
    tags = _unpack(_rows(data, offsets[:-1] + 12, n // 4), n, 2)
    out, slots = np.zeros((pages, n), word), np.zeros((pages, n), np.int64)
    at = offsets[:-1] + 12 + n // 4
    for kind, width in ((1, 1), (2, size // 2), (3, size)):
        row, col = np.nonzero(tags == kind)
        if len(row):
            found = _rows(data, at[row] + _ranks(row) * width, width)
            if kind == 1:
                slots[row, col] = found[:, 0]
            else:
                whole = np.zeros((len(row), size), np.uint8)
                whole[:, :width] = found
                out[row, col] = whole.view(word)[:, 0]
        at = at + (tags == kind).sum(1) * width
    # an exact word is the last other one of its slot
    own = (out >> np.dtype(word).type(shift) & np.dtype(word).type(mask)).astype(np.int64)
    slots = np.where(tags == 1, slots, own)
    row, col = np.nonzero(tags)
    order = np.argsort(row * (mask + 1) + slots[row, col], kind="stable")
    row, col = row[order], col[order]
    source = np.maximum.accumulate(np.where(tags[row, col] > 1, np.arange(len(row)), 0)) if len(row) else row
    out[row, col] = out[row, col][source]
    return out.view(np.uint8)


def _encode_bdi(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds = kernels.bdi_kinds(p)
    sizes = np.array([1 + LINE, 1, 9, 17])[kinds]
    offsets = _offsets(4 + sizes.sum(1))
    out = np.zeros(offsets[-1], np.uint8)
    _place(out, offsets[:-1], np.tile(np.array([LINES], "<u4").view(np.uint8), (len(p), 1)))
    at = (offsets[:-1, None] + 4 + np.cumsum(sizes, 1) - sizes).ravel()
    lines, kind = p.reshape(-1, LINE), kinds.ravel()
    out[at] = kind
    words = lines.view("<u8")
    _place(out, at[kind == 0] + 1, lines[kind == 0])
    own = kind >= 2
    _place(out, at[own] + 1, _bytes_of(words[own, :1]))
    own = kind == 3
    _place(out, at[own] + 9, _bytes_of((words[own] - words[own, :1]).astype(np.int8)))
    return out, offsets


def _decode_bdi(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    at, out = offsets[:-1] + 4, np.zeros((len(offsets) - 1, LINES, LINE // 8), "<u8")
    for k in range(LINES):
        kind = data[at]
        own = np.flatnonzero(kind == 0)
        out[own, k] = _rows(data, at[own] + 1, LINE).copy().view("<u8")
        own = np.flatnonzero(kind >= 2)
        out[own, k] = _rows(data, at[own] + 1, 8).copy().view("<u8")
        own = np.flatnonzero(kind == 3)
        out[own, k] += _rows(data, at[own] + 9, 8).view(np.int8).astype(np.int64).view(np.uint64)
        at = at + np.array([1 + LINE, 1, 9, 17])[kind]
    return out.reshape(len(out), -1).view(np.uint8)


_SLOTS = {"wkdm32": ("<u4", 4, 15), "wkdm64": ("<u8", 3, 31)}


def encoded(codec: str, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat, offsets) of the codes of all pages, though they may be longer than a page."""
    if codec == "same_page":
        code = np.concatenate([p[:, :1], np.tile(np.array([PAGE], "<u4").view(np.uint8), (len(p), 1))], 1)
        return code.ravel(), np.arange(len(p) + 1) * 5
    if codec == "bdi":
        return _encode_bdi(p)
    if codec in _SLOTS:
        word, shift, mask = _SLOTS[codec]
        w = p.view(word)
        tags = (kernels.tags32 if codec == "wkdm32" else kernels.tags64)(p)
        return _encode_words(p, tags, word, w >> w.dtype.type(shift) & w.dtype.type(mask))
    if codec in ("block_class", "ai_int8"):
        return _encode_classed(kernels.lines(p) if codec == "block_class" else kernels.row_deltas(p))
    if codec in ("ai_fp16", "ai_bf16"):
        return _encode_split(p)
    parts = [np.frombuffer(codecs.library_code(codec, page), np.uint8) for page in map(bytes, p)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8), _offsets([len(x) for x in parts])


def decoded(codec: str, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The pages of codes of one codec."""
    pages = len(offsets) - 1
    if not pages:
        return np.zeros((0, PAGE), np.uint8)
    if codec == "same_page":
        return np.repeat(data[offsets[:-1], None], PAGE, 1)
    if codec == "bdi":
        return _decode_bdi(data, offsets)
    if codec in _SLOTS:
        return _decode_words(data, offsets, *_SLOTS[codec])
    if codec == "block_class":
        return _decode_classed(data, offsets).reshape(pages, PAGE)
    if codec == "ai_int8":
        return np.bitwise_xor.accumulate(_decode_classed(data, offsets), axis=1).reshape(pages, PAGE)
    if codec in ("ai_fp16", "ai_bf16"):
        return _decode_split(data, offsets)
    return np.stack([np.frombuffer(codecs.decode(codec, data[a:b].tobytes()), np.uint8) for a, b in zip(offsets[:-1], offsets[1:])])


def shrinks(codec: str, p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which pages the codec takes: those that it can code, in fewer bytes than a page."""
    short = np.diff(offsets) < PAGE
    return short & (p == p[:, :1]).all(1) if codec == "same_page" else short


def taken(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of some pages."""
    sizes = np.diff(offsets)[rows]
    new = _offsets(sizes)
    return data[np.repeat(offsets[rows] - new[:-1], sizes) + np.arange(new[-1])], new
