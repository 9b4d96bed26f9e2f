"""Operators over the whole corpus, against brute force on small tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import minhash_join, packing, repeat_index, source_mix, top_products
from seriesloom.llm.components import components
from seriesloom.llm.queries import tokenizer_path
from tests.llm.helpers import clashing, corpus, frame, prose
from tests.llm.test_row_operators import WORD


def test_targets_fill_up_to_the_limit(spark):
    sizes = spark.createDataFrame([(1, "a", 10), (2, "b", 1000), (3, None, 400), (4, "z", 0)], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in source_mix.targets(sizes).collect()}
    # Weights a 5, b 2, z 1, null 5: a and null stop at twice their size, b takes the rest.
    assert got == {"a": 20.0, None: 800.0, "z": 0.0, "b": 1.5 * 1410 - 820}


def test_mix_nears_targets_and_repeats(spark):
    docs = clashing(spark, corpus(5, 400))
    sizes = source_mix.sized(docs)
    one = source_mix.decide(sizes)
    assert sorted(map(str, one.collect())) == sorted(map(str, source_mix.decide(sizes).collect()))
    taken = docs.groupBy().count().first()[0]
    assert taken == 400
    per = defaultdict(lambda: [0, 0.0])
    for r in one.collect():
        assert 0 <= r["copies"] <= 2
    mixed = source_mix.mix(docs)
    assert mixed.columns == docs.columns
    goal = {r["source"]: r["target"] for r in one.collect()}
    for r in source_mix.sized(mixed).collect():
        per[r["source"]][0] += r["size"]
    for source, (words, _) in per.items():
        assert abs(words - goal[source]) < 0.02 * goal[source] + 310
    assert source_mix.mix(frame(spark, [])).count() == 0


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(0)
    sizes, counts = rng.integers(1, 3000, 300).astype(float), np.ones(300)
    mean = np.zeros(300)
    for k in range(60):
        pi = source_mix.flight(np.full(300, 0.3), sizes, counts, np.random.default_rng(k))
        assert abs(pi @ sizes - 0.3 * sizes.sum()) < 1e-5 * sizes.sum() and abs(pi.sum() - 90) < 1e-4
        assert ((pi > 0) & (pi < 1)).sum() <= source_mix.LANDING
        mean += pi / 60
    assert abs(mean.mean() - 0.3) < 1e-6 and mean.max() < 0.6
    equal = source_mix.land(source_mix.flight(np.full(50, 0.5), np.full(50, 7.0), np.ones(50), rng), np.full(50, 7.0), np.ones(50))
    assert set(equal) <= {0, 1} and equal.sum() == 25


def repeats_by_force(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for b in bodies:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


@pytest.mark.parametrize("how, heavy", [({}, 1 << 14), ({"bucket": 4}, 3), ({"hot": 1}, 3)])
def test_repeats_against_all_windows(spark, monkeypatch, how, heavy):
    monkeypatch.setattr(repeat_index, "HEAVY", heavy)
    rng = random.Random(9)
    passage = prose(rng, 40)
    texts = [r[1] for r in corpus()]
    texts += [prose(rng, 20) + passage + prose(rng, 20) for _ in range(8)] + [passage[k : k + 150] for k in range(0, 60, 7)]
    docs = spark.createDataFrame([(i % 70, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_removed string")
    rows = repeat_index.remove_repeats(docs, length=100, anchor=32, **how).collect()
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in rows)
    assert got == repeats_by_force(texts, 100)
    # A string of 64 bytes that starts elsewhere too shows in n_shared; without one of 32 bytes it is 0.
    shared = sorted((r["n_bytes"], r["n_shared"]) for r in rows)
    wide, narrow = repeats_by_force(texts, 64), repeats_by_force(texts, 32)
    removed = {n: {w[1] > 0 for w in wide if w[0] == n} for n, _ in shared}
    assert all(n > 0 for size, n in shared if removed[size] == {True})
    removed = {n: {w[1] > 0 for w in narrow if w[0] == n} for n, _ in shared}
    assert all(n == 0 for size, n in shared if removed[size] == {False})


def test_repeats_in_a_text_above_one_slice(spark):
    passage, rng = prose(random.Random(3), 60)[:420], np.random.default_rng(3)
    long = bytes(rng.integers(97, 123, repeat_index.CHUNK + 5000, dtype=np.uint8)).decode()
    short = passage[:300]
    texts = [long + passage, "A" + passage + "B", "C" + short + "D", "E" * 30, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in repeat_index.remove_repeats(docs).collect()}
    assert [rows[i]["n_removed"] for i in range(5)] == [420, 420, 0, 0, 0]
    assert bytes(rows[0]["kept_bytes"]).decode() == long and bytes(rows[1]["kept_bytes"]) == b"AB"
    assert [rows[i]["n_shared"] > 0 for i in range(5)] == [True, True, True, False, False]


def test_repeats_of_an_empty_table(spark):
    assert repeat_index.remove_repeats(frame(spark, [])).count() == 0


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


@pytest.mark.parametrize("cell", [4096, 7])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(minhash_join, "CELL", cell)
    rows = [r for r in corpus(2, 80) if r[0] is not None]
    rng = random.Random(4)
    base = prose(rng, 150).split()
    for i in range(30):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(150)] = f"edit{i}"
        rows.append((1000 + i, " ".join(copy), None, None, 0))
    # Two texts under one id, each with a near copy elsewhere.
    for k, i in enumerate((2000, 2000)):
        own = prose(rng, 90).split()
        rows.append((i, " ".join(own), None, None, 0))
        rows.append((2001 + k, " ".join([*own[:-1], "other"]), None, None, 0))
    # Texts that share a passage of two thirds, in pairs of near copies.
    passage = prose(rng, 100)
    for i in range(40):
        own = prose(rng, 50) if i % 2 == 0 else own + " end"
        rows.append((3000 + i, passage + " " + own, None, None, 0))
    sets = defaultdict(list)
    for r in rows:
        sets[r[0]].append(shingle_set(r[1]))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            a, b = ids[x], ids[y]
            if any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
    got = minhash_join.near_duplicates(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, root(i)) for i in ids}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert sorted(r["n_shingles"] for r in got) == sorted(len(shingle_set(r[1])) for r in rows)


def test_near_duplicates_null_ids_and_empty(spark):
    got = minhash_join.near_duplicates(frame(spark, [(None, "a b c d e f", None, None, 0)] * 2 + [(1, None, None, None, 0)])).collect()
    assert all(r["kept"] for r in got) and len(got) == 3
    assert minhash_join.near_duplicates(frame(spark, [])).count() == 0
    assert minhash_join.keep_one(frame(spark)).columns == frame(spark).columns


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = corpus(3, 60) + [(500, "x <|endoftext|> y  z  \x1c a\n\n b", None, None, 0)]
    got = packing.pack(clashing(spark, rows), tokenizer_path()).collect()
    want = []
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        cuts = ([0] if head else []) + list(range(head, len(ids), 2048))
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            want.append((r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) <= sum(x[3] for x in want) / 2048 + 2
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_sweep_is_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(30):
        counts = {rng.randint(1, 64): rng.randint(1, 9) for _ in range(12)}
        plan = packing.sweep(counts, 64)
        used = defaultdict(int)
        for length, _, n, first, offset in plan.tolist():
            for k in range(n):
                assert used[first + k] <= offset or offset + length <= 64
                used[first + k] += length
        assert max(used.values()) <= 64 and sum(used.values()) == sum(v * n for v, n in counts.items())
        open_ = []
        for length in sorted((v for v, n in counts.items() for _ in range(n)), reverse=True):
            fit = [g for g in open_ if g >= length]
            if fit:
                open_.remove(min(fit))
                open_.append(min(fit) - length)
            else:
                open_.append(64 - length)
        assert len(used) == len(open_)


@pytest.mark.parametrize("block,chunk", [(4096, 512), (16, 3)])
def test_top_products_against_all_products(spark, block, chunk):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=rng.choice([3, 8]))]) for i in range(120)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (201, None), (202, [1.0, None]), (203, [float("nan")]), (204, [float("inf")]), (None, [9.0]), (250, [0.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    usable = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows
              if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, (i, v) in enumerate(usable):
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v.tolist(), w.tolist(), strict=False)), j) for p, (j, w) in enumerate(usable) if p != q)
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores[:5])]
    got = top_products.top_products(table, lambda key: key % 50 == 0, block=block, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert top_products.top_products(table.limit(0), lambda key: key % 50 == 0).count() == 0


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    rows = corpus(7, 60)
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
    packed = corpus_pipeline.run(spark, folder)
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_hash_of_removed_text_is_that_of_the_rest(spark):
    text = "a" * 450
    row = repeat_index.remove_repeats(frame(spark, [(1, text, None, None, 0)])).first()
    # 51 windows of one letter, all equal: everything goes.
    assert row["n_removed"] == 450 and hashlib.sha256(bytes(row["kept_bytes"])).hexdigest() == hashlib.sha256(b"").hexdigest()
