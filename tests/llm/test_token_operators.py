"""Operators on words and tokens: periodic runs, token alignment, BPE by rank arrays."""

import hashlib
import random
import tracemalloc
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seriesloom.llm import byte_tokens, queries, rank_bpe, square_runs, token_alignment
from tests.llm.helpers import DOCS, clashing, corpus, frame, prose

A, B, W = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = [
    None, "", " \n\t ", "a", "▁x y", "<|endoftext|> x<|startoftext|>y", "\r\n a\r\n\r\nb", "x" * 3000, "ab" * 400,
    "日本語 テキスト 👩‍👩‍👧 " * 40, "  many      spaces\n\n\n\there ", "İ ΣΑΣ ẞ é é <|endoftext|>́", "\x00\x1c\x85!\x1c!",
    "don't WE'LL 'sx ½²", "a  " * 500,
]


def brute_runs(words, least):
    """Every stretch of every period, compared word by word."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = p
        while i < n:
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            if j - i >= p:
                found.setdefault((i - p, j), p)
            i = max(j, i + 1)
    return sorted(((x, y, p) for (x, y), p in found.items() if y - x >= least), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return [i.bit_count() & 1 for i in range(n)]


def test_runs_of_famous_words():
    texts = [fibonacci(300), thue_morse(1100), [0] * 200, ([0] * 30 + [1]) * 9, list(range(100)), [], [7], [1, 2] * 6]
    at = np.concatenate([[0], np.cumsum(list(map(len, texts)))])
    got = square_runs.find_runs(np.array(sum(texts, [])), at)
    want = [(x + s, y + s, p) for t, s in zip(texts, at) for x, y, p in brute_runs(t, 12)]
    assert [tuple(r) for r in got.tolist()] == want


@settings(max_examples=150, deadline=None)
@given(
    st.lists(
        st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=25), st.integers(1, 5)), max_size=6),
        min_size=1, max_size=5,
    ),
    st.sampled_from([2, 12]),
)
def test_runs_against_brute_force(parts, least):
    texts = [[w for unit, times in text for w in unit * times] for text in parts]
    at = np.concatenate([[0], np.cumsum(list(map(len, texts)))])
    got = square_runs.find_runs(np.array(sum(texts, []), np.int64), at, least)
    want = [(x + s, y + s, p) for t, s in zip(texts, at) for x, y, p in brute_runs(t, least)]
    assert [tuple(r) for r in got.tolist()] == want


def test_runs_with_equal_hashes_of_different_words(monkeypatch):
    """Hashes that never differ only cost time: runs are confirmed on the words."""
    monkeypatch.setattr(square_runs.Words, "hashed", lambda self, start, size: np.zeros(len(start), np.uint64))
    text = fibonacci(80) + [5, 6, 7] + [1, 2, 3, 4, 5, 6, 7, 8, 9] * 3
    got = square_runs.find_runs(np.array(text), np.array([0, len(text)]))
    assert set(map(tuple, got.tolist())) >= {(x, y, p) for x, y, p in brute_runs(text, 12) if p < 8}
    assert all(text[i] == text[i + p] for x, y, p in got.tolist() for i in range(x, y - p))


def split(text):
    return (text or "").encode().split()


def expected_op11(doc_id, text):
    words = split(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words, 12)
    drop = {i for x, y, p in runs for i in range(x + p, y)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    best = min(((x - y, x, p) for x, y, p in runs), default=None)
    lines = "".join(f"{x},{y - x},{p}\n" for x, y, p in runs)
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = corpus(n=120)
    rows += [(1000 + i, t, "en", "s", 0) for i, t in enumerate(ODD)]
    rows += [(2000 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(80))), None, None, 0) for i in range(60)]
    rows += [(5, rows[5][1], "en", "s", 0), (1001, "again", None, None, None)]
    path = str(tmp_path_factory.mktemp("tokens"))
    clashing(spark, rows).write.parquet(f"{path}/documents.parquet")
    return path, rows


def order(rows):
    return sorted(rows, key=repr)


def test_op11_against_brute_force(spark, folder):
    path, rows = folder
    got = queries.op11_square_runs(spark, path).collect()
    assert order(map(tuple, got)) == order(expected_op11(r[0], r[1]) for r in rows)


def test_periodic_runs_keep_the_text_of_clean_documents(spark):
    docs = spark.createDataFrame([("k", "one  two\nthree"), (None, "a b " * 10), ("n", None)], "doc_id string, text string")
    got = {r["doc_id"]: r for r in square_runs.periodic_runs(docs).collect()}
    assert got["k"]["collapsed"] == "one two three" and got["k"]["runs"] == []
    assert got[None]["collapsed"] == "a b" and tuple(got[None]["runs"][0]) == (0, 20, 2)
    assert (got["n"]["n_words"], got["n"]["collapsed"]) == (0, "")


def brute_groups(text, library_a, library_b, pair):
    if not text:
        return []
    a, b = library_a.encode(" " + text, add_special_tokens=False).ids, library_b.encode(text)
    ends = []
    for ids, names in ((a, pair.bytes_a), (b, pair.bytes_b)):
        if b"".join(names[i] for i in ids) != (" " + text).encode():
            return []
        ends.append(np.cumsum([len(names[i]) for i in ids]).tolist())
    out, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


@pytest.fixture(scope="module")
def libraries():
    library_a = Tokenizer.from_file(A)
    library_a.encode_special_tokens = True
    return library_a, sentencepiece.SentencePieceProcessor(model_file=B), token_alignment.load(A, B)


def spelled(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_op12_against_brute_force(spark, folder, libraries, monkeypatch):
    path, rows = folder
    all_groups = [brute_groups(r[1], *libraries) for r in rows]
    links = [[(i, j) for a, b in groups for i in a for j in b] for groups in all_groups]
    count = {}
    for found in links:
        for pair in set(found):
            count[pair] = count.get(pair, 0) + 1
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    want = [
        (
            r[0], sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(found),
            sum(count[p] == best[p[0]] for p in found), sum(count[p] for p in found),
            hashlib.sha256(spelled(g).encode()).hexdigest() if g else "",
        )
        for r, g, found in zip(rows, all_groups, links, strict=True)
    ]
    assert order(map(tuple, queries.op12_token_alignment(spark, path).collect())) == order(want)


def test_lanes_and_small_unfoldings_change_nothing(libraries, monkeypatch):
    pair = libraries[2]
    texts = [t for t in ODD if t] + [" ".join(map(str, range(400)))] + ["日本語" * 300]
    whole = token_alignment.Aligned(pair, texts)
    held = whole.held()
    monkeypatch.setattr(token_alignment, "UNFOLD", 13)
    ends = [np.cumsum(s[x]) for s, x in ((pair.sizes_a, whole.a), (pair.sizes_b, whole.b))]
    lanes = token_alignment.lanes(ends[0], whole.at_a, ends[1], whole.at_b, lane=5)
    assert len(lanes) > 2 * len(texts)
    assert (token_alignment.lockstep(*ends, lanes) == whole.groups).all()
    again = whole.held()
    as_set = lambda h: {(int(d), int(h[0][p]), int(n)) for d, p, n in zip(*h[1:], strict=True)}
    assert as_set(again) == as_set(held)


def test_parts_of_a_slice_change_nothing(libraries, monkeypatch):
    pair, texts = libraries[2], [*ODD, *(r[1] for r in corpus()[:20]), None]
    whole = token_alignment.Aligned(pair, texts)
    monkeypatch.setattr(token_alignment, "TOKENISED", 40)
    monkeypatch.setattr(token_alignment, "WRITTEN", 7)
    parts = token_alignment.Aligned(pair, texts)
    for name in ("a", "at_a", "b", "at_b", "groups", "at_group"):
        assert (getattr(parts, name) == getattr(whole, name)).all()
    want = [spelled(brute_groups(t, *libraries)).encode() for t in texts]
    assert whole.texts() == want
    assert parts.texts() == want


def test_memory_of_a_slice(libraries):
    pair, rng = libraries[2], random.Random(3)
    texts = [prose(rng, 300) for _ in range(500)]
    token_alignment.Aligned(pair, texts[:1]).texts()
    tracemalloc.start()
    try:
        found = token_alignment.Aligned(pair, texts)
        found.held()
        found.texts()
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 50 * sum(map(len, texts))


@pytest.mark.parametrize(("most", "width"), [(0, 1), (255, 1), (256, 2), (65_535, 2), (65_536, 4)])
def test_packed_numbers(most, width):
    values = np.array([0, most, 1 if most else 0])
    data = token_alignment.packed(values)
    assert len(data) == 3 * width
    assert token_alignment.unpacked(data, 3).tolist() == values.tolist()
    assert token_alignment.unpacked(token_alignment.packed(values[:0]), 0).tolist() == []


def test_the_sums_of_a_slice_come_alone(spark):
    texts = [(i % 5, "Zwölf 12345 straße" if i % 3 else None) for i in range(24)]
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(8)
    found = token_alignment.linked(docs, A, B)
    plan = found._jdf.queryExecution().toString()
    assert "CoGroups" in plan
    assert "collect_list" not in plan
    assert order(map(tuple, found.collect())) == order(map(tuple, token_alignment.linked(docs.coalesce(1), A, B).collect()))


def test_align_gives_ids_cuts_and_groups(spark, libraries):
    texts = {"x": "Zwölf 12345 straße", "y": None, None: "a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    for r in token_alignment.align(docs, A, B).collect():
        groups = brute_groups(texts[r["doc_id"]], *libraries)
        assert r["groups"] == spelled(groups)
        assert (r["a"], r["b"]) == (sum((a for a, _ in groups), []), sum((b for _, b in groups), []))
        assert r["a_cuts"] == np.cumsum([len(a) for a, _ in groups]).tolist()
        assert r["b_cuts"] == np.cumsum([len(b) for _, b in groups]).tolist()


def test_op13_against_the_library(spark, folder):
    path, rows = folder
    library = Tokenizer.from_file(W)
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append(
            (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256(decoded.encode()).hexdigest())
        )
    assert order(map(tuple, queries.op13_rank_bpe(spark, path).collect())) == order(want)


@cache
def word_library():
    return Tokenizer.from_file(W)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="'sStTrRvVlLmMdD <|endoftext>startİß12́", max_size=80))
def test_bpe_of_any_text(text):
    library, bpe = word_library(), rank_bpe.load(W)
    ids = library.encode(text, add_special_tokens=False).ids
    (mine,) = bpe.encode([text.encode()], {})
    assert np.frombuffer(mine, "<u4").tolist() == ids
    assert bpe.decode(mine).decode() == library.decode(ids, skip_special_tokens=False)


def test_long_words_take_the_same_merges():
    bpe, rng = rank_bpe.load(W), random.Random(2)
    for alphabet in ("ab", "aeinrst", "=-"):
        word = "".join(rng.choice(alphabet) for _ in range(600))
        parts = [bpe.single[c] for c in word]
        assert bpe.scan(list(parts)) == bpe.heap(list(parts))


def test_decode_reverses_ids(spark):
    docs = spark.createDataFrame([(1, "Some words, 12!"), (2, None)], "doc_id int, text string")
    both = rank_bpe.encode_decode(docs, W)
    again = rank_bpe.decode(both.drop("decoded"), W)
    assert {r["doc_id"]: r["decoded"] for r in again.collect()} == {1: "some</w> words</w> ,</w> 1</w> 2</w> !</w>", 2: ""}


def test_byte_encoder_equals_the_library(libraries):
    library, encode = libraries[0], byte_tokens.encoder(A).encode_ordinary
    for text in [t for t in ODD if t] + [r[1] for r in corpus() if r[1]]:
        assert encode(text) == library.encode(text, add_special_tokens=False).ids


def test_empty_tables(spark):
    none = frame(spark, []).select("doc_id", "text")
    assert square_runs.periodic_runs(none).count() == 0
    assert rank_bpe.encode_decode(none, W).count() == 0
    assert token_alignment.align(none, A, B).count() == 0
    assert token_alignment.linked(none, A, B).count() == 0
    assert DOCS.startswith("doc_id")
