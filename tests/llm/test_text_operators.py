"""Rules, classifier, language, licence and tokenizer operators against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from paymend.llm import langid, license_scan, packing, quality_classifier, quality_rules
from paymend.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality_rules_count_like_a_plain_loop(messy):
    got = {}
    for r in quality_rules.quality_report(messy).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == messy.count()
    for row in messy.select("doc_id", "text").collect():
        text = row.text or ""
        words = WORD.findall(text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))
        mine = [r for r in got[row.doc_id] if (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want]
        assert mine, (row.doc_id, want, got[row.doc_id])
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert all(r.base_failed == failed and (not r.kept or not failed) for r in mine)


def test_quality_rules_keep_prose_and_reject_noise_and_repetition(messy, no_docs):
    kept = {r.doc_id: r.kept for r in quality_rules.quality_report(messy).collect()}
    assert kept[5] and kept[10] and kept[17]
    assert not any(kept[i] for i in (0, 1, 2, 11, 12, 13, 22))
    left = quality_rules.keep_good(messy)
    assert left.columns == messy.columns
    assert {r.doc_id for r in left.collect()} - {None} == {i for i, k in kept.items() if k and i is not None}
    assert quality_rules.quality_report(no_docs).count() == 0 == quality_rules.keep_good(no_docs).count()


def test_quality_rules_reject_repetition_that_the_base_rule_passes(spark):
    pick = random.Random(8)
    vocabulary = ["".join(pick.choice("etaoinshrdlu") for _ in range(pick.randint(2, 9))) for _ in range(2000)]

    def words(n):
        return [pick.choice(vocabulary) for _ in range(n)]

    good = [" ".join(words(220 + 7 * (i % 40))) for i in range(300)] + [" ".join(words(1200)) for _ in range(80)]
    shuffled = []
    for few in (words(25) for _ in range(12)):  # the words of one sentence again and again, in another order each time
        shuffled.append(" ".join(w for _ in range(16) for w in pick.sample(few, len(few))))
    tails = [" ".join(words(600))[:2100] + " " + shuffled[i][:1900] for i in range(12)]  # prose, and repetition in the last, partial chunk
    texts = good + shuffled + tails + [good[0]] * 400  # many copies do not move the limits
    got = {r.doc_id: r for r in quality_rules.quality_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    n = len(good)
    assert all(got[i].kept for i in range(n))
    assert not any(got[i].base_failed or got[i].kept for i in range(n, n + 24))


def test_classifier_separates_held_out_documents(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/../sf0.01/documents.parquet"), spark.read.parquet(f"{folder}/../sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality_classifier.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert len(held) > 50 and np.mean([q == r.predicted for q, r in held]) >= 0.97


def test_classifier_matches_closed_form():
    pick = np.random.default_rng(5)
    d = len(quality_classifier.NAMES)
    x = {c: pick.normal(c, 1 + c, (400, d)) for c in (0, 1)}
    moments = {c: (float(len(v)), v.sum(0), v.T @ v) for c, v in x.items()}
    covs = {c: np.cov(v.T, bias=True) for c, v in x.items()}
    pooled = (covs[0] + covs[1]) / 2
    point, logs = pick.normal(0.5, 1, d), []
    for c in (0, 1):
        cov = 0.9 * covs[c] + 0.1 * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-3 * np.eye(d)
        away = point - x[c].mean(0)
        logs.append(np.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * away @ np.linalg.solve(cov, away))
    keep = quality_classifier._moments
    quality_classifier._moments = lambda rows: moments
    try:
        model = quality_classifier.fit(None)
    finally:
        quality_classifier._moments = keep
    want = 1 / (1 + np.exp(-quality_classifier.SOFT * (logs[1] - logs[0])))
    assert model.score(point[None])[0] == pytest.approx(want, rel=1e-6)


def test_classifier_without_labels_or_with_one_class(spark, messy, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (None, 0, 0), (7, None, 0), (8, 5, 0)], "doc_id long, quality int, toxic int")
    one = quality_classifier.quality_scores(messy, labels).collect()
    assert len(one) == messy.count() and {r.score for r in one} == {1.0}
    none = quality_classifier.quality_scores(messy, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    assert quality_classifier.quality_scores(no_docs, labels).count() == 0
    assert quality_classifier.keep_good(messy, labels).count() == messy.count()
    assert all(np.isfinite(quality_classifier.statistics(r.text)).all() for r in messy.select("text").collect())


def brute_grams(text):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        padded = f" {word} "
        out.update(word)
        for n in (2, 3):
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return out


def test_language_profiles_and_distance_match_a_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/../sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    totals = {}
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang and r.text:
            totals.setdefault(r.lang, Counter()).update(brute_grams(r.text))
    known = {lang: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], code(g)))[: langid.PROFILE])} for lang, c in totals.items()}
    held = right = 0
    for r in rows[:150]:
        mine = brute_grams(r.text)
        top = sorted(mine, key=lambda g: (-mine[g], code(g)))[: langid.RANKS]
        far = {lang: sum(min(abs(k[g] - i), langid.PROFILE) if g in k else langid.PROFILE for i, g in enumerate(top)) for lang, k in known.items()}
        assert got[r.doc_id].lang_pred == (min(sorted(far), key=far.get) if top else "und")
    for r in rows:
        if got[r.doc_id].held_out:
            held, right = held + 1, right + (got[r.doc_id].lang_pred == r.lang)
    assert held > 200 and right / held >= 0.97


def test_language_edge_cases(messy, no_docs):
    got = langid.languages(messy).collect()
    assert len(got) == messy.count()
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (0, 1, 2, 21)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got} <= {"en", "de", "und"} and not by[None].held_out
    assert langid.languages(no_docs).count() == 0
    assert {r.lang_pred for r in langid.detect(langid.held_out(messy), {}).collect()} == {"und"}


def test_licence_base_places_match_a_plain_search(messy, no_docs):
    got = license_scan.scan_licences(messy).collect()
    assert len(got) == messy.count()
    for row in messy.select("doc_id", "text").where("doc_id is not null").distinct().collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), row.text or ""))
        found = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = next(r for r in got if r.doc_id == row.doc_id)
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert (r.first_word, r.last_word) == (min(found)[0] if found else None, max(found)[0] if found else None)
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert license_scan.scan_licences(no_docs).count() == 0


def test_automaton_reports_longest_runs():
    texts = ["a b c d e", "b c d b c", "x a b a b", "d e f"]
    lib = license_scan.Licences([(t, t) for t in texts], [("b c", "bc"), ("a b", "ab"), ("c", "c")])
    runs = {" ".join(t.split()[i:j]) for t in texts for i in range(5) for j in range(i + 1, 6)}
    for state, size in enumerate(lib.size[1:], 1):
        for number, place in lib.ends[state]:
            words = (lib.templates + lib.phrases)[number][1]
            assert place + 1 >= size and b" ".join(words[place + 1 - size : place + 1]).decode() in runs
    text = "z a b c d b c d e f x a b a b c".split()
    found = lib.scan(" ".join(text).encode())
    want = sorted((i, label) for phrase, label in (("b c", "bc"), ("a b", "ab"), ("c", "c")) for i in range(len(text)) if " ".join(text[i : i + len(phrase.split())]) == phrase)
    assert sorted(found.base) == want
    assert {s[0] for s in found.spans} >= {"a b c d e", "b c d b c", "x a b a b", "d e f"}


def test_licence_spans_survive_small_changes():
    notice = dict((t, label) for label, t in license_scan.TEMPLATES)
    lib = license_scan.Licences()
    for text, label in notice.items():
        words = text.split()
        assert label in {s[0] for s in lib.scan(f"before {text} after".encode()).spans}, text
        if len(words) > 14:
            cut = " ".join(words[:7] + ["oddity"] + words[8:])
            assert label in {s[0] for s in lib.scan(cut.encode()).spans}, cut
    assert not lib.scan(b"you may use of this in the other of any kind").spans


def test_word_tokens_equal_the_tokenizer(messy):
    words = packing.WordTokens(tokenizer_path())
    texts = [r.text for r in messy.select("text").collect()] + ["'S It'LL ,'s 'tis", "ÀÉ×÷ß ªº µ ²³ ½1", "a\x00b \x7f\x80\x9f", "<|startoftext|>"]
    for _ in range(2):
        assert words.encode(texts) == [words.direct(t or "") for t in texts]
    packing.WORDS, keep = 10, packing.WORDS
    try:
        assert words.encode(texts) == [words.direct(t or "") for t in texts]
    finally:
        packing.WORDS = keep


def test_word_tokens_in_few_places(messy):
    keep = packing.WORDS, packing.STRETCH
    packing.WORDS, packing.STRETCH = 16, 7
    try:
        words = packing.WordTokens(tokenizer_path())
        texts = [r.text for r in messy.select("text").collect()] + ["", "  ", "a\x00 a a\x00\x00 \x00", "zqxjkvbw" * 3, "zqxjkvbw" * 3 + "z", "é" * 24 + " " + "é" * 25, "qzxqzxqzxqzxqzxqzx qzx", "last"]
        want = [words.direct(t or "") for t in texts]
        for _ in range(3):
            assert words.encode(texts) == want
            assert [words.encode([t])[0] for t in texts] == want
    finally:
        packing.WORDS, packing.STRETCH = keep


def test_word_tokens_remember_many_words():
    words = packing.WordTokens(tokenizer_path())
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [letters[i % 26] + letters[i // 26 % 26] + letters[i // 676 % 26] + letters[i // 17576] for i in range(150_000)]
    texts = [" ".join(names[i : i + 10_000]) for i in range(0, len(names), 10_000)]
    learn, learned = words._learn, []
    words._learn = lambda new: learned.append(len(new)) or learn(new)
    first = [words.encode([t]) for t in texts]
    assert sum(learned) == len(names)
    learned.clear()
    assert [words.encode([t]) for t in texts] == first
    assert sum(learned) < len(names) // 4
