"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from octavo.llm import chunk_dedup, decontaminate, jaccard_join, line_dedup, lm_score, packing, pii, quality, registry, shared, url_filter, vector_dedup

from ..conftest import SF
from .data import documents, sentence, texts


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, SF).select(*columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


# --- near duplicates ---


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def word_sets(rows, width):
    out = {}
    for i, t in rows:
        w = shared.words_of(t)
        k = min(width, len(w))
        out[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    return out


def brute_components(rows, width, percent):
    sets = word_sets(rows, width)
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[a] & sets[b]]
    return {i: (len(sets[i]), c) for i, c in roots(sets, pairs).items()}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, width, percent):
    rows = list(enumerate(texts()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(documents(spark, rows), width, percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_jaccard_of_a_large_near_group(spark):
    rng = random.Random(2)
    base = [sentence(rng, 1) for _ in range(90)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(90)] = sentence(rng, 1)
        rows.append((i, " ".join(words)))
    for width, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(documents(spark, rows), width, percent).collect()}
        assert got == brute_components(rows, width, percent)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    pairs = [(a, b) for a, b in pairs if a != b]
    assert got == roots({x for p in pairs for x in p}, pairs)


def brute_vectors(rows):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    ids = [i for i, _ in rows]
    c = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b])
    return {i: (int(near[k].sum()) - 1, c[i]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("chunk", [2048, 16])
def test_vectors_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(vector_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 24))
    v = np.concatenate([base, base[:20] + rng.normal(size=(20, 24)) * 0.2, base[:1] + rng.normal(size=(60, 24)) * 0.25, base[:5], base[:3] * 4.0]).astype(np.float32)
    rows = [(int(i), list(map(float, x))) for i, x in zip(rng.permutation(len(v)), v)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(df).collect()}
    assert got == brute_vectors(rows)


# --- decontamination, lines, chunks ---


def test_tiling_finds_reordered_passages(spark):
    rng = random.Random(9)
    item = sentence(rng, 40)
    w = item.split()
    moved = " ".join([*w[25:], "filler", *w[:10], "more", *w[10:25]])
    rows = [(1, f"before {item} after"), (2, moved), (3, sentence(rng, 60)), (4, " ".join(w[:12]))]
    got = {r.doc_id: (r.matched_words, r.n_tiles) for r in decontaminate.contained(documents(spark, rows), spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()}
    assert got == {1: (40, 1), 2: (40, 3)}
    blocks = decontaminate.contained(documents(spark, rows), spark.createDataFrame([(7, item), (8, sentence(rng, 30))], "item_id bigint, text string"), block_chars=100)
    assert {r.doc_id for r in blocks.collect()} == {1, 2}


def plain_tiling(a, b, least):
    """Longest matches first, by comparing all places."""
    free_a, free_b, total = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return total
        free_a[i:i + k] = free_b[j:j + k] = [False] * k
        total += k


def test_tiling_covers_as_the_plain_algorithm():
    rng = random.Random(3)
    for _ in range(25):
        a = [rng.randrange(1, 9) for _ in range(rng.randint(5, 30))]
        b = a[10:] + [99] + a[:12] + [rng.randrange(1, 9) for _ in range(10)]
        tiles = decontaminate.tiling(a, b)
        assert all(a[i:i + k] == b[j:j + k] and k >= 5 for i, j, k in tiles)
        assert sum(k for _, _, k in tiles) == plain_tiling(a, b, 5)


def test_decontamination_equals_brute_force(spark):
    """The whole operator against tilings of every document with every item, without seeds or pieces."""
    rng = random.Random(31)
    words = [sentence(rng, 1) for _ in range(60)]
    phrase = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, phrase(n)) for k, n in enumerate([30, 18, 9, 7, 5, 4, 3, 2, 1, 0, 30, 12])] + [(50, None), (51, "never seen here"), (52, "never seen")]
    rows = []
    for k in range(60):
        text = phrase(rng.randint(0, 60)).split()
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(own) + 1)
            cut = own[a:] + ["filler"] * rng.randint(0, 2) + own[:a] if rng.random() < 0.5 else own[:rng.randint(0, len(own))]
            at = rng.randrange(len(text) + 1)
            text[at:at] = cut
        rows.append((k, " ".join(text).upper() if k % 7 == 0 else ", ".join(text)))
    want = set()
    for doc, text in rows:
        number: dict = {}
        b = [number.setdefault(w, len(number)) for w in decontaminate.words(text)]
        for item, words_ in items:
            a = [number.setdefault(w, len(number)) for w in decontaminate.words(words_)]
            if 0 < len(a) < 5:
                matched = len(a) * any(b[i:i + len(a)] == a for i in range(len(b)))
            else:
                matched = plain_tiling(a, b, 5)
            if a and 2 * matched >= len(a) and matched:
                want.add((doc, item, len(a), matched))
    df = spark.createDataFrame(items, "item_id bigint, text string")
    for chars in (decontaminate.BLOCK_CHARS, 150):
        got = {(r.doc_id, r.item_id, r.item_words, r.matched_words) for r in decontaminate.contained(documents(spark, rows), df, block_chars=chars).collect()}
        assert got == want
        clean = {r.doc_id for r in decontaminate.clean(documents(spark, rows), df, block_chars=chars).collect()}
        assert clean == {k for k, _ in rows} - {d for d, *_ in want}
    assert len({i for _, i, *_ in want}) > 8


def plain_chunks(data):
    """Chunk by chunk with a rolling hash of the last 32 bytes."""
    out, start = [], 0
    while start < len(data):
        end = None
        for k in range(start + chunk_dedup.LEAST, min(len(data), start + chunk_dedup.MOST) + 1):
            h = 0
            for b in data[max(0, k - 32):k]:
                h = (2 * h + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
            if k < len(data) and data[k] & 0xC0 == 0x80:
                continue
            if h >> 27 & chunk_dedup.MASK == 0:
                end = k
                break
        if end is None:
            end = start + chunk_dedup.MOST
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        if len(data) - end < chunk_dedup.LEAST:
            end = len(data)
        out.append((start, end))
        start = end
    return out


@pytest.mark.parametrize("bits", [1 << 27, 1 << 10])
def test_chunk_dedup_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(chunk_dedup, "FILTER_BITS", bits)
    rng = random.Random(41)
    shared_ = [sentence(rng, 40) for _ in range(6)]
    rows = list(enumerate(texts()[:8])) + [(10, "x" * 700), (11, "x" * 650), (12, "end."), (13, "end."), (14, None)]
    rows += [(20 + k, " ".join([sentence(rng, rng.randint(0, 30)), shared_[k % 6], "é" * (k % 5), shared_[(k * 5) % 6][k:], sentence(rng, 9)])) for k in range(40)]
    seen, want = set(), {}
    for doc, text in rows:
        data, out, removed = (text or "").encode(), b"", 0
        for a, b in plain_chunks(data):
            if data[a:b] in seen:
                removed += b - a
            else:
                out += data[a:b]
                seen.add(data[a:b])
        want[doc] = (None if text is None else out.decode(), removed)
    got = {r.doc_id: (r.text, r.removed_bytes) for r in chunk_dedup.dedup_chunks(documents(spark, rows)).collect()}
    assert got == want and sum(n for _, n in want.values()) > 5000


def test_lines_and_repeated_windows(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "q\n\n\n\nr"), (4, "\n\n\n\n"), (5, "a\nb\nc\nd"), (6, "u\nu\nu\nu")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got[1] == ("a\nb\nc\nd", 0) and got[2] == ("x\ny", 3) and got[5] == ("", 4) and got[4][1] == 0 and got[6] == ("u", 3)


def test_chunks_resist_shifts_and_keep_the_first(spark):
    rng = random.Random(6)
    passage = sentence(rng, 80)
    rows = [(1, sentence(rng, 50) + " " + passage + " " + sentence(rng, 30)), (2, sentence(rng, 33) + " " + passage + sentence(rng, 41)), (3, sentence(rng, 90)), (4, "é" * 400 + passage)]
    got = {r.doc_id: r for r in chunk_dedup.dedup_chunks(documents(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    for k in (2, 4):
        assert got[k].removed_bytes > 0.6 * len(passage) and passage not in got[k].text
    data = rows[3][1].encode()
    assert b"".join(data[a:b] for a, b in zip([0, *chunk_dedup.cuts(data)], chunk_dedup.cuts(data))) == data


def test_short_copies_and_single_chunks_go(spark):
    rng = random.Random(12)
    short, tiny = sentence(rng, 12)[:70], "so short"
    rows = [(1, short), (2, short), (3, tiny), (4, tiny), (5, "x" + sentence(rng, 60))]
    data = rows[4][1].encode()
    ends = chunk_dedup.cuts(data)
    lone = next(data[a:b].decode() for a, b in zip(ends, ends[1:]) if b - a < 96)
    rows.append((6, data[:ends[0]].decode() + lone + sentence(rng, 3)))
    got = {r.doc_id: r for r in chunk_dedup.dedup_chunks(documents(spark, rows)).collect()}
    assert (got[1].text, got[2].text, got[3].text, got[4].text, got[5].text) == (short, "", tiny, "", rows[4][1])
    assert got[6].removed_bytes >= ends[0]


def test_gear_hash_equals_the_rolling_one():
    data = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = (2 * h + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunk_dedup.gear_hash(data).tolist() == want


# --- urls ---


def test_cascade_is_exact_in_one_part_and_in_several(spark):
    rng = random.Random(8)
    hosts = [f"{sentence(rng, 1)}.{sentence(rng, 1)}.com" for _ in range(400)]
    bad = [h.split(".", 1)[1] for h in hosts[::7]]
    pages = spark.createDataFrame([(k, f"https://{h}/p") for k, h in enumerate(hosts)], "page_id bigint, url string")
    listed = spark.createDataFrame([(b,) for b in bad], "key string")
    want = {k: "block" if h.split(".", 1)[1] in set(bad) else "allow" for k, h in enumerate(hosts)}
    for most in (url_filter.BROADCAST_BYTES, 40):
        assert {r.page_id: r.verdict for r in url_filter.judge(pages, listed, rules=(), most_bytes=most).collect()} == want


def test_hosts_of_many_labels(spark):
    """However many labels a host has, it and its parents can be listed."""
    long = ".".join("abcdefghij"[k % 10] for k in range(131))
    hosts = [long, f"x.{long}", f"x{long}", long[2:], "q." * 5000 + long, ".".join(["z"] * 200)]
    pages = spark.createDataFrame([(k, f"http://{h}/") for k, h in enumerate(hosts)], "page_id bigint, url string")
    got = url_filter.judge(pages, spark.createDataFrame([(long,)], "key string"), rules=())
    assert {r.page_id: r.verdict for r in got.collect()} == dict(enumerate(["block", "block", "allow", "allow", "block", "allow"]))


def test_rules(spark):
    rows = ["http://EXAMPLE.com/en/1", "http://www.example.com/en/1", "http://a.www.example.com/en/", "http://x.com", "http://x.com?q", "http://b.net/es/#f", "ftp://badexample.com/en/", "http://x.org/"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, spark.createDataFrame([], "key string")).collect()}
    assert [got[k] for k in range(8)] == [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("www.example.com/en/", "allow"), (None, "allow"), (None, "allow"),
                                          ("net/es/", "block"), ("com/", "allow"), (None, "allow")]


# --- packing ---


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = ids_of.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_packing_round_trip(spark):
    rows = [*enumerate(texts()), (900, "before <|endoftext|> after")]
    pieces = packing.pack(documents(spark, rows)).toPandas()
    for doc, text in rows:
        ids, own = ids_of(text), pieces[pieces.doc_id == doc].drop_duplicates("start").sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length).tolist()[:-1]] and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[s:s + n].tobytes()) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        total = own.length.sum()
        assert own.offset.tolist() == [0, *np.cumsum(own.length).tolist()[:-1]] and total <= 1024 and (total & (total - 1)) == 0


def test_plan_places_every_rank_once():
    rng = np.random.default_rng(5)
    histogram = np.bincount(rng.integers(1, 1024, 3000), minlength=1024)
    histogram[600] += 2000
    plan, used = packing.Plan(histogram), Counter()
    for length, n in enumerate(histogram):
        for rank in range(n):
            parts = plan.places(length, rank)
            assert sum(p[1] for p in parts) == length
            for _, n_, sequence, offset in parts:
                used[sequence] += n_
    assert all(n & (n - 1) == 0 and n <= 1024 for n in used.values()) and sum(used.values()) == (histogram * np.arange(1024)).sum()
    assert plan.taken.sum() > 0.4 * histogram.sum()  # most pieces of usual lengths are whole


def test_nnls_solves_a_small_system():
    columns = np.array([[3, 1, 0], [2, 2, 0], [2, 1, 1]])
    x = packing.nnls(columns, np.array([0, 5.0, 7, 2, 0]), 4000)
    assert np.allclose(x, [2, 2.75, 1.5], atol=0.01)


# --- personal data ---


def base_by_the_book(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    for _ in range(3000):
        t = "".join(rng.choice(["@", ".", "1", "22", "255", "4111111111111111", "a", "b.c", "+1", " ", "-", "(", "x@y.z", "@@", "%", "é"]) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(t) == base_by_the_book(t), t


def test_pii_counts_and_digest(spark):
    rows = [(1, "é bob.x@mail.example.com and 10.0.0.255, 4111 1111 1111 1111 or +1 (234) 555-7777."), (2, "nothing 12.5 here"), (3, None)]
    got = {r.doc_id: r for r in pii.find(documents(spark, rows)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    want = pii.joined(base_by_the_book(rows[0][1]))
    assert got[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(got[1].spans.split(","))
    assert got[2].spans == got[3].spans == ""


# --- scores ---


def test_lm_base_equals_brute_force_and_model_is_better(spark):
    got = lm_score.query(spark, SF).collect()
    docs = {r.doc_id: shared.words_of(r.text) + [None] for r in table(spark, "documents").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    c = Counter(w for i, ws in docs.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    base = model = 0.0
    for r in got:
        ws = docs[r.doc_id]
        want = sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, want, rel_tol=1e-9)
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > base


def test_lm_with_joined_counts_is_the_same(spark, monkeypatch):
    rows = list(enumerate(texts()))
    want = {r.doc_id: (round(r.base_score, 6), r.n_known) for r in lm_score.scores(documents(spark, rows)).collect()}
    monkeypatch.setattr(lm_score, "FREQUENT", 3)
    got = {r.doc_id: (round(r.base_score, 6), r.n_known) for r in lm_score.scores(documents(spark, rows)).collect()}
    assert got == want


def test_lm_probabilities_sum_to_one():
    import pandas as pd

    top = pd.DataFrame({"h": np.arange(5, dtype=np.int64), "c": [9, 7, 5, 3, 2]})
    rare = pd.DataFrame({"h": np.arange(5, 9, dtype=np.int64), "c": [1, 1, 1, 1]})
    m = lm_score.Model(pd.concat([top, rare]), top, 30, 9)
    rng = np.random.default_rng(2)
    m.class_weights += rng.normal(size=m.class_weights.shape).astype(np.float32)
    m.word_weights += rng.normal(size=m.word_weights.shape).astype(np.float32)
    ids = np.array([0, 1, 2, 3, 4, lm_score.OTHER])
    p = np.exp(m.log_probabilities(ids, np.full(6, 3), np.full(6, 1)))
    dead = 1 - p.sum()  # places without a word have a share of e^-60
    shares = (np.array([1, 1, 1, 1, 0]) + 0.1) / m.rest
    assert abs(dead) < 1e-4 and math.isclose(shares.sum() + 0.0, 1.0, rel_tol=1e-9)


def test_lm_tree_probabilities_sum_to_one():
    import pandas as pd

    rng = np.random.default_rng(4)
    words = pd.DataFrame({"h": rng.integers(-(1 << 62), 1 << 62, 9000), "c": np.sort(rng.integers(1, 40, 9000))[::-1]})
    top, n, v = words[:lm_score.WORDS], int(words["c"].sum()), len(words)
    h, c = words["h"].to_numpy(), words["c"].to_numpy()
    levels = lm_score.levels_of(v - len(top))
    path = (h.view(np.uint64) >> np.uint64(64 - lm_score.BRANCH * levels)).astype(np.int64)
    leaves = np.bincount(path[len(top):], c[len(top):] + lm_score.SMOOTH, 1 << lm_score.BRANCH * levels)
    m = lm_score.Model(words, top, n, v, leaves)
    m.class_weights += rng.normal(size=m.class_weights.shape).astype(np.float32)
    m.word_weights += rng.normal(size=m.word_weights.shape).astype(np.float32)
    assert levels > 1 and (m.paths(h) == path).all()
    ids = m.ids(h)
    own, leaf = m.scored(ids, np.full(v, h[8000]), np.full(v, h[10]), path)
    known = 10 ** (own + np.where(ids == lm_score.OTHER, leaf + m.leaf_logs[path] + np.log10(c + lm_score.SMOOTH), 0))
    unknown = 10 ** own[-1] * lm_score.SMOOTH / m.rest
    assert math.isclose(known.sum() + unknown, 1.0, abs_tol=1e-4)


@pytest.mark.parametrize("frequent", [1 << 18, 3])
def test_lm_knows_which_rare_words_follow_each_other(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    rng = random.Random(8)
    usual = [f"usual{k}" for k in range(lm_score.WORDS)]
    pairs = [(f"first{k}", f"second{k}") for k in range(200)]
    out = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0][:2]
    rows = [(k, " ".join(rng.sample(usual, len(usual)))) for k in range(400, 440)]
    rows += [(k, " ".join(w for p in rng.sample(pairs, 10) for w in p)) for k in range(400) if k not in out]
    rows += [(out[0], " ".join(w for p in pairs for w in p)), (out[1], " ".join(w for k, p in enumerate(pairs) for w in (p[0], pairs[k - 1][1])))]
    got = {r.doc_id: r for r in lm_score.scores(documents(spark, rows)).collect()}
    right, wrong = (got[k] for k in out)
    assert right.held_out and wrong.held_out and math.isclose(right.base_score, wrong.base_score, rel_tol=1e-9)
    assert right.score > wrong.score + 1  # the same words, and only the order tells them apart


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "LEAST_ROWS", 256)
    monkeypatch.setattr(lm_score, "TOKENS_A_ROW", 2)  # some ten shards, in rounds
    df = documents(spark, list(enumerate(texts(count=150))))
    few, many = ({r.doc_id: r.score for r in lm_score.scores(df.repartition(n)).collect()} for n in (2, 16))
    assert few.keys() == many.keys() and all(math.isclose(few[k], many[k], rel_tol=1e-9) for k in few)


def test_lm_score_equals_a_plain_model(spark):
    """One gradient step over a small table, token by token and with dictionaries of features."""
    rng = random.Random(14)
    usual = [f"u{k}" for k in range(lm_score.WORDS)]
    rows = [(k, " ".join(rng.sample(usual, 500) + [f"rare{rng.randrange(300)}" for _ in range(40)] + ["end"] * (k % 3))) for k in range(6)] + [(50, "u3 Unknown u3"), (51, None)]
    rows = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 10 or k >= 50]
    training = [t for k, t in rows if zlib.crc32(str(k).encode()) % 10]
    got = {r.doc_id: r for r in lm_score.scores(documents(spark, rows)).collect()}

    import pandas as pd

    hashed = lambda t: lm_score.token_hashes([t])[0].tolist()
    counts = Counter(h for t in training for h in hashed(t))
    order = sorted(counts, key=lambda h: (-counts[h], h))
    frame = pd.DataFrame({"h": order, "c": [counts[h] for h in order]})
    top, n, v = frame[:lm_score.WORDS], sum(counts.values()), len(counts)
    assert v > lm_score.WORDS and n < lm_score.BATCH
    smooth, width, classes, bits = lm_score.SMOOTH, lm_score.WIDTH, lm_score.CLASSES, lm_score.BRANCH
    levels = lm_score.levels_of(v - len(top))
    path = lambda h: (h & (1 << 64) - 1) >> 64 - bits * levels
    leaf = Counter()
    for h in order[lm_score.WORDS:]:
        leaf[path(h)] += counts[h] + smooth
    rest = sum(leaf.values()) + smooth
    masses = [sum(counts[h] + smooth for h in order[k * width:(k + 1) * width]) for k in range(classes)] + [rest]
    bias = {("class",): [math.log(m / sum(masses)) for m in masses]}
    model = lm_score.Model(frame, top, n, v, np.array([leaf[k] for k in range(1 << bits * levels)]))

    def steps(h, one, two):
        """(choice, branch, rows) of a token: the class, then the word or the path."""
        x, y = np.array([one]), np.array([two])
        at = order.index(h) if h in counts else len(order)
        out = [(("class",), min(at, lm_score.WORDS) // width, [("c", k, int(r[0])) for k, r in enumerate(model.class_features(x, y))])]
        def inner(choice, branch, shares, words):
            bias.setdefault(("word", choice), [math.log(s / sum(shares)) if s > 0 else -60 for s in shares])
            rows = model.word_features(np.array([choice]), *words)
            out.append((("word", choice), branch, [("w", k, int(r[0])) for k, r in enumerate(rows)]))
        if at < lm_score.WORDS:
            inner(at // width, at % width, [counts[w] + smooth for w in order[at // width * width:(at // width + 1) * width]], (x, y))
        else:
            before = classes
            for k in range(levels):
                own = path(h) >> bits * (levels - k - 1)
                size = 1 << bits * (levels - k - 1)
                shares = [sum(leaf[j] for j in range((own >> bits << bits) * size + b * size, (own >> bits << bits) * size + (b + 1) * size)) for b in range(width)]
                inner(before + (own >> bits), own & width - 1, shares, (x, y) if k == 0 else (x,))
                before += 1 << bits * k
        return out

    weights = {}

    def shares_of(choice, rows):
        x = [b + sum(weights.get((r[0], r[2]), {}).get(k, 0.0) for r in rows) for k, b in enumerate(bias[choice])]
        z = sum(map(math.exp, x))
        return [math.exp(a) / z for a in x]

    def walk(text):
        before = [lm_score.BEFORE, lm_score.BEFORE]
        for h in hashed(text):
            yield h, steps(h, before[1], before[0])
            before = [before[1], h]

    # the classes, the choices of two features and those of one are steps of their own, and within each one feature after the other
    sums = {}
    for phase in range(3):
        slopes = {}
        for t in training:
            for _, parts in walk(t):
                for choice, branch, features in parts:
                    if (0 if choice[0] == "class" else 3 - len(features)) == phase:
                        p = shares_of(choice, features)
                        for kind, k, row in features:
                            own = slopes.setdefault(k, {}).setdefault((kind, row), Counter())
                            for b, x in enumerate(p):
                                own[b] += x - (b == branch)
        for k in sorted(slopes):
            for key, own in slopes[k].items():
                for b, g in own.items():
                    sums[key, b] = sums.get((key, b), 1.0) + g * g
                    weights.setdefault(key, {})[b] = weights.get(key, {}).get(b, 0.0) - lm_score.RATE * g / math.sqrt(sums[key, b])
    weights.update({k: {b: float(np.float16(x)) for b, x in own.items()} for k, own in weights.items()})
    for doc, text in rows:
        want = 0.0
        for h, parts in walk(text):
            if h not in counts:
                parts = parts[:1]
            own = sum(math.log10(shares_of(choice, r)[branch]) for choice, branch, r in parts)
            if h not in counts:
                own += math.log10(smooth / rest)
            elif order.index(h) >= lm_score.WORDS:
                own += math.log10((rest - smooth) / rest * (counts[h] + smooth) / leaf[path(h)])
            want += own
        assert math.isclose(got[doc].score, want, rel_tol=1e-5), (doc, got[doc].score, want)


def test_quality_held_out(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    got = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def plain_pieces(text):
    """Buckets of a text's words, of their n-grams and of its repeats, one by one."""
    def hashed(piece, n):
        h = 0
        for b in piece:
            h = (h * int(quality._FACTOR) + int(shared.CASED[b])) % (1 << 64)
        return int(quality.bucketed(np.array([(h + n) % (1 << 64)], np.uint64))[0])

    words = (text or "").encode().split()
    out = [int(b) for w in words for b in quality.bucketed(shared.word_hashes([w.decode()], cased=True)[0] ^ np.uint64(1))]
    out += [quality.BUCKETS - 1] * quality.REPEATED * sum(a == b for a, b in zip(words, words[1:]))
    for w in words:
        padded = b"<" + w + b">"
        out += [hashed(padded[i:i + n], n) for n in quality.GRAMS for i in range(len(padded) - n + 1)]
    return out


def test_pieces_equal_the_plain_ones(monkeypatch):
    rows = [t for t in texts()[:40] if len(t or "") < 3000]
    want = [Counter(plain_pieces(t)) for t in rows]
    for at_once in (quality.AT_ONCE, 9):
        monkeypatch.setattr(quality, "AT_ONCE", at_once)
        got = [Counter() for _ in rows]
        for owner, buckets in quality.pieces(rows):
            for k, b in zip(owner.tolist(), buckets.tolist()):
                got[k][b] += 1
        assert got == want


def test_quality_scores_are_the_softmax_of_averaged_vectors(spark):
    """The shares of the scorer against averaging the vectors of all features and a softmax over the two classes."""
    rng = np.random.default_rng(6)
    vectors, out, bias = rng.normal(size=(quality.BUCKETS, quality.DIM)), rng.normal(size=(quality.DIM, 2)), rng.normal(size=2)
    model = quality.Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
    rows = [(i, t) for i, t in enumerate(texts()[:30]) if len(t or "") < 3000]
    got = {r.doc_id: r.score for r in quality.score(documents(spark, rows), model).collect()}
    for doc, text in rows:
        features = plain_pieces(text)
        hidden = vectors[features].mean(0) if features else np.zeros(quality.DIM)
        logits = hidden @ out + bias
        assert math.isclose(got[doc], 1 / (1 + math.exp(logits[0] - logits[1])), abs_tol=1e-4)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.train(documents(spark), none)
    assert {round(r.score, 3) for r in quality.score(documents(spark), model).collect()} == {0.5}


def test_pipeline_drops_what_it_should(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    item = sentence(rng, 40)
    good = [sentence(rng, 60) for _ in range(30)]
    rows = [*enumerate(good), (100, good[0]), (101, good[1] + " extra"), (102, sentence(rng, 30) + " " + item + " " + sentence(rng, 20))]
    rows += [(200 + k, " ".join(w.upper() + "!!" for w in sentence(rng, 50).split())) for k in range(12)]
    df = documents(spark, rows).dropDuplicates(["doc_id"])
    df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    marks = [(i, int(i < 200), 0) for i, _ in rows]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(range(30))
