"""Operators that judge or rewrite one document at a time."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import language_id, line_dedup, quality_rules, toxicity, url_filters
from tests.llm.helpers import clashing, corpus, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_verdict(spark):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = quality_rules.judge(clashing(spark)).collect()
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(expected_measures(r[1]) for r in corpus())
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert any(r["kept"] for r in rows)


def test_quality_many_repeats_take_the_sorted_way(spark):
    text = " ".join(f"w{i % 97}" for i in range(500))
    row = quality_rules.judge(frame(spark, [(1, text, None, None, 0)])).first()
    assert row["n_repeat_words"] == expected_measures(text)[4] == 500


def test_rule_order_changes_no_verdict(spark):
    measured = quality_rules.measures(frame(spark)).withColumn("bad", quality_rules.base_failed())
    rules = quality_rules.default_rules()
    one = measured.select(quality_rules.cascade(rules, F.col("bad")).alias("k")).collect()
    two = measured.select(quality_rules.cascade(rules[::-1], F.col("bad")).alias("k")).collect()
    assert one == two


def test_quality_empty_table(spark):
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_site_lines(spark):
    rows = [(i, f"Own line {i}\nFooter\n\nmore {i}", None, "s" if i < 20 else None, 0) for i in range(30)]
    rows += [(90, "Footer", None, "s", 0), (91, None, None, "s", 0), (92, "Footer\nrare", None, "t", 0)]
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(clashing(spark, rows)).collect()}
    assert got[3]["text"] == "Own line 3\n\nmore 3" and (got[3]["n_lines"], got[3]["n_dropped"]) == (3, 1)
    assert got[25]["text"] == "Own line 25\n\nmore 25"
    assert got[90]["text"] == "Footer"
    assert got[91]["text"] is None and got[91]["n_lines"] == 0
    assert got[92]["text"] == "Footer\nrare"
    assert line_dedup.drop_lines(frame(spark, [])).count() == 0


def test_url_rules_and_mined_rules(spark):
    urls = [f"https://www.bad-shop.example.net/en/{i}" for i in range(40)] + [f"https://good.example.net/fr/{i}" for i in range(40)]
    urls += ["http://A.ORG/x", "https://sub.example.org/es/1?x=1", "http://example.org/en/12", "http://x.com/de/", "http://x.com/fr/#a",
             "http://notorg/x", None, "no scheme", "http://org", ""]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(i, i < 40) for i in range(0, 80, 2)] + [(1, None), (None, True)], "page_id long, block boolean")
    got = {r["page_id"]: r for r in url_filters.judge(pages, labels).collect()}
    assert len(got) == len(urls)
    assert got[1]["verdict"] == "block" and got[1]["rule"] is None and got[41]["verdict"] == "allow"
    assert (got[80]["host"], got[80]["path"], got[80]["rule"], got[80]["verdict"]) == ("a.org", "/x", "org/", "allow")
    assert (got[81]["rule"], got[81]["verdict"]) == ("example.org/es/", "block")
    assert (got[82]["rule"], got[82]["verdict"]) == ("example.org/en/1", "block")
    assert got[83]["rule"] == "com/de/" and got[84]["rule"] == "com/fr/"
    assert got[85]["rule"] is None
    assert (got[86]["host"], got[86]["path"], got[87]["host"], got[88]["path"]) == ("", "", "", "")
    assert url_filters.judge(pages.limit(0), labels).count() == 0
    assert url_filters.judge(pages, labels.limit(0)).where("rule IS NULL AND verdict <> 'allow'").count() == 0


def test_url_rules_of_long_shared_paths(spark):
    """Thirty segments that always occur together are mined as one; any of them still counts."""
    shared = "/".join(f"seg{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30))
    urls = [f"http://shop.net/{shared}/{i}" for i in range(60)] + [f"http://shop.net/plain/{i}" for i in range(60)]
    urls += ["http://other.net/segaa/sega", "http://other.net/segba", "http://other.net/plain", "http://unseen.test/new"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 60) for i in range(0, 120, 2)], "page_id long, block boolean")
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, labels).collect()}
    assert all(got[i] == ("block" if i < 60 else "allow") for i in range(120))
    assert [got[i] for i in range(120, 124)] == ["block", "block", "allow", "allow"]


def longest_phrases(word, text):
    """Greedy parse by plain substring search."""
    count, at = 0, 0
    while at < len(word):
        n = 1
        while at + n < len(word) and any(word[at : at + n + 1] in t for t in text):
            n += 1
        at, count = at + n, count + 1
    return count


def test_suffix_automaton_against_substring_search():
    rng = np.random.default_rng(3)
    for _ in range(20):
        text = ["".join(rng.choice(list("abc"), rng.integers(1, 12))) for _ in range(5)]
        automaton = language_id.SuffixAutomaton(text)
        for _ in range(20):
            word = "".join(rng.choice(list("abcd"), rng.integers(1, 10)))
            assert automaton.phrases(word) == longest_phrases(word, text)


def parsed_by_words(model, text):
    """Language and score of a text by the automata alone, word after word."""
    found = [w for w in (text or "").lower().split() if any(c.isalpha() for c in w)]
    names = sorted(model)
    if not names or not found:
        return "und", 0.0
    of = {n: language_id.SuffixAutomaton(model[n]) for n in names}
    total = sorted((sum(of[n].phrases(f" {w} ") for w in found), n) for n in names)
    return total[0][1], 1 - total[0][0] / total[1][0] if len(names) > 1 else 1.0


def odd_texts():
    """Unknown letters, letters beyond 16 bits, capitals that grow, rare white space, words without a letter, words
    around the length that may be parsed alone, and repeated texts."""
    rng = np.random.default_rng(5)
    letters = list("abcdeñß12!. \t\n") + ["😀", "中", "𐐀", "İ", "Σ", "\x1c", "\x85", "\xa0", "$"]
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 60, 150)]
    for n in (language_id.LONG - 1, language_id.LONG, language_id.LONG + 1, 5 * language_id.LONG):
        texts += ["".join(rng.choice(list("abcd"), n)), "!" * n, "a b " + "中" * n]
    return texts + texts[:20] + ["", " \n", "12 !"]


ODD_MODEL = {
    "a": [" abc ", " bca ", " 中a ", " ñ. "],
    "b": [" dd ", " eabcd ", " ß1 ", " 𐐀 "],
    "c": [" abc ", " i̇σ "],
    "d": [],
}


def test_words_parsed_together_count_as_parsed_alone(monkeypatch):
    monkeypatch.setattr(language_id, "TOGETHER", 3000)
    monkeypatch.setattr(language_id, "FEW", 2)
    monkeypatch.setattr(language_id, "REMEMBER", 100)
    for names in ("", "a", "ab", "abcd"):
        model = {n: ODD_MODEL[n] for n in names}
        parser = language_id.Parser(language_id.Languages(model))
        texts = [None, *odd_texts()]
        for at in range(0, len(texts), 40):
            found = zip(*parser.judge(texts[at : at + 40]), strict=True)
            assert list(found) == [parsed_by_words(model, t) for t in texts[at : at + 40]]


def test_words_are_parsed_in_arrays_and_automata_built_once(monkeypatch):
    alone, built = [], []
    phrases, build = language_id.SuffixAutomaton.phrases, language_id.SuffixAutomaton.__init__
    monkeypatch.setattr(language_id.SuffixAutomaton, "phrases", lambda a, w: alone.append(w) or phrases(a, w))
    monkeypatch.setattr(language_id.SuffixAutomaton, "__init__", lambda a, w: built.append(1) or build(a, w))
    languages = language_id.Languages({n: ODD_MODEL[n] for n in "ab"})
    for _ in range(3):
        parser = language_id.Parser(languages)
        parser.totals([f"abc{i} eabcd" for i in range(500)])
    assert not alone and len(built) == 2


def test_languages_of_a_table_against_plain_parsing(spark):
    model = {"en": [" stone ", " cloud ", " under ", " the "], "de": [" alpha ", " gamma ", " der "], "xx": [" unï "]}
    rows = [(k, t, None, None, 0) for k, t in enumerate([r[1] for r in corpus()] + odd_texts())]
    found = language_id.predict(frame(spark, rows).select("doc_id", "text"), model).collect()
    assert sorted(found) == [(k, *parsed_by_words(model, t)) for k, t, *_ in rows]


def test_language_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs.where("doc_id % 3 <> 1"))
    found = language_id.predict(docs.where("doc_id % 3 = 1"), model)
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.95
    odd = {r["n_chars"]: r for r in language_id.predict(
        frame(spark, [(1, t, None, None, k) for k, t in enumerate([None, "", "12 3 !", "der und die"])]), model).collect()}
    assert [odd[k]["lang_pred"] for k in range(4)] == ["und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert language_id.predict(frame(spark), {}).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(clashing(spark), model).count() == len(corpus())


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(1)
    n = np.zeros((2, toxicity.CELLS))
    for k in range(2):
        np.add.at(n[k], rng.integers(0, toxicity.CELLS, 20_000), 1)
    lower = np.full(toxicity.LETTERS, 1 / toxicity.LETTERS)
    p = toxicity._interpolate(n[0].reshape((toxicity.LETTERS,) * 4), lower, 0.7)
    assert np.allclose(p.sum(axis=-1), 1)
    assert np.isfinite(toxicity.log_ratio(n[0], n[1])).all()
    assert not toxicity.log_ratio(np.zeros(toxicity.CELLS), np.zeros(toxicity.CELLS)).any()


def test_toxicity_held_out_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 6000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.learn(docs.where("doc_id % 5 <> 0"), labels, (F.col("doc_id") % 5 != 1).cast("int"))
    found = toxicity.score(docs.where("doc_id % 5 = 0"), model).join(labels, "doc_id")
    marked = docs.where(r"lower(text) rlike '\\b(clown|moron|trash|stupid|idiot)\\b'").select("doc_id")
    assert found.join(marked, "doc_id").agg(F.avg("predicted")).first()[0] > 0.85
    clean = found.where("toxic = 0")
    assert clean.agg(F.avg("predicted")).first()[0] < 0.03
    odd = toxicity.score(clashing(spark), model)
    assert odd.count() == len(corpus()) and odd.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    kept = toxicity.keep_clean(frame(spark), model)
    assert kept.columns == frame(spark).columns
    assert kept.count() == odd.where("predicted = 0").count()


@pytest.mark.parametrize("rows", [[], [(1, None), (None, 1)]])
def test_toxicity_without_labels(spark, rows):
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    model = toxicity.learn(frame(spark), labels, F.lit(1))
    assert toxicity.score(frame(spark), model).where("score <> 0.5").count() == 0
