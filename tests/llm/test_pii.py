"""The field of personal data: the best segmentation, pruning, and what it adds on texts that it wasn't trained on."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from octavo.llm import pii

from ..conftest import SF
from .data import sentence


@pytest.fixture(scope="module")
def field():
    return pii.Field.fit(pii.sentences())


def lattice_of(text):
    codes = pii.codes_of([text])
    starts, kinds = pii.token_starts(codes)
    starts = np.append(starts, len(codes))
    return pii.Lattice(codes, starts, kinds), starts


def best_total(field, text):
    """The best score of all segmentations, by trying every one that ends at each token."""
    lattice, _ = lattice_of(text)
    n, turns = len(lattice.kind), field.turns
    i, j = lattice.segments(0, n, False)
    scores, ending = field.scores(lattice, i, j), {}
    for a, b, s in zip(i.tolist(), j.tolist(), scores):
        ending.setdefault(b, []).append((a, s))
    best = [[0.0] + [float("-inf")] * 4]
    for p in range(1, n + 1):
        row = [max(best[p - 1][x] + turns[x, 0] for x in range(5))]
        row += [max((best[a][x] + turns[x, k] + s[k - 1] for a, s in ending.get(p, ()) for x in range(5)), default=float("-inf")) for k in range(1, 5)]
        best.append(row)
    return max(best[n][x] + turns[x, 0] for x in range(5))


def total_of(field, text, spans):
    lattice, starts = lattice_of(text)
    total, at, last = 0.0, 0, 0
    for k, a, b in spans:
        i, j = (np.searchsorted(starts, [x]) for x in (a, b))
        if i[0] > at:
            total, last = total + field.turns[last, 0], 0
        total += field.turns[last, k + 1] + field.scores(lattice, i, j)[0, k]
        at, last = j[0], k + 1
    return total + field.turns[last, 0]


def wild(rng):
    """Fields of random weights find entities everywhere, and side by side."""
    return pii.Field({g: rng.normal(size=(n, 4)) * 0.7 for g, n in pii.GROUPS.items()}, np.where(np.eye(5) * np.arange(5)[::-1] == 4, 0, rng.normal(size=(5, 5))))


def test_decoding_is_the_best_segmentation(field):
    rng = np.random.default_rng(3)
    for n, (text, _) in enumerate(pii.sentences(30, seed=5)):
        for own in (field, wild(rng)):
            spans = own.decode(text[:45])
            assert np.isclose(total_of(own, text[:45], spans), best_total(own, text[:45])), (n, text)


def test_pruning_changes_nothing(field):
    rng = np.random.default_rng(4)
    texts = [t for t, _ in pii.sentences(60, seed=6)] + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:40]
    for text in texts:
        assert field.decode(text) == field.decode(text, pruned=False)
    for text in texts[:20]:
        own = wild(rng)
        assert own.decode(text) == own.decode(text, pruned=False)
    assert field.anchored()


def test_slices_and_batches_change_nothing(field, monkeypatch):
    texts = [t for t, _ in pii.sentences(40, seed=8)]
    want = [field.decode(t) for t in texts]
    edges = np.cumsum([0] + [len(t) + 1 for t in texts]).tolist()
    monkeypatch.setattr(pii, "SLICE", 7)
    assert [(k, s, e) for k, s, e in field.decoded(pii.codes_of(texts))] == [(k, s + at, e + at) for at, own in zip(edges, want) for k, s, e in own]


def test_turns_are_learnt(field):
    assert (field.turns[1:, :1] < 0).all() and (field.turns[0, 1:] < 0).all() and len(np.unique(field.turns.round(3))) > 4


def test_added_spans_on_unseen_sentences(field):
    """Recall and precision of what the field adds; spans that touch a base span don't count."""
    hits = wrong = total = 0
    for text, gold in pii.sentences(300, seed=99):
        base = pii.base_spans(text)
        gold, found = set(pii.overlapping_base(base, gold)), set(pii.added_spans(text, base, field))
        total, hits, wrong = total + len(gold), hits + len(found & gold), wrong + len(found - gold)
    assert total > 100 and hits > 0.9 * total and wrong < 0.05 * total


FORMS = {
    "brackets": (0, lambda r: f"{sentence(r, 1)} [at] {sentence(r, 1)} [dot] com"), "one dot": (0, lambda r: f"{sentence(r, 1)}.{sentence(r, 1)} (at) {sentence(r, 1)} dot org"),
    "words": (0, lambda r: f"{sentence(r, 1)} at {sentence(r, 1)} dot net"), "capitals": (0, lambda r: f"{sentence(r, 1)} AT {sentence(r, 1)} DOT com"), "long": (0, lambda r: f"{'abcdefgh' * 9} [at] {sentence(r, 1)} [dot] org"),
    "ip": (1, lambda r: "[.]".join(str(r.randint(1, 254)) for _ in range(4))), "spaced ip": (1, lambda r: " . ".join(str(r.randint(1, 254)) for _ in range(4))),
    "phone": (3, lambda r: f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"),
}


@pytest.mark.parametrize("form", FORMS)
def test_planted_in_documents(field, form):
    """Entities set into real texts are found, and the texts without them stay as they are."""
    kind, make = FORMS[form]
    rng = random.Random(21)
    texts = [t for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() if t and "\n" not in t[:40] and not pii.base_spans(t)][:60]
    hits = spoilt = 0
    for text in texts:
        own, at = make(rng), text.find(" ", rng.randrange(max(1, len(text) // 2)))
        at = max(at, 0)
        before = text[:at].rstrip() + ", write to: "
        found = pii.added_spans(before + own + ", " + text[at:].lstrip(), [], field)
        hits += (kind, len(before), len(before) + len(own)) in found
        spoilt += len(found) > 1
    assert hits >= 0.9 * len(texts) and spoilt <= 0.05 * len(texts)


def test_plain_prose_stays(field):
    plain = ["look at the dot on the map", "we met at noon (at) the gate and left", "the dot product is large", "see [dot] below for more", "It was at home. It rained at ten. At last it ended.",
             "version 1.2.3 of 2024-01-31 at 10:30", "page 12, 13 and 14 (1999)", "sum 1,234,567.89 dollars"]
    assert not [(t, s) for t in plain for s in pii.added_spans(t, [], field)]


def test_long_texts(field):
    for text in ("9 " * 40_000, "0" * 200_000 + ".1.1.1", "a@" * 30_000, "at dot " * 20_000, "1" * 100_000, " " * 200_000, "x" * 200_000, "\0\0a [at] b [dot] com\0"):
        base = pii.base_spans(text)
        pii.added_spans(text, base, field)
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(1, 0, 5006)] and pii.base_spans("0" * 5000 + "300.1.1.1") == []
