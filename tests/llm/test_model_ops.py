"""Learned operators by held-out accuracy, dedup operators and the pipeline against brute force, all on odd rows too."""

import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from starloom.llm import common, langid, line_dedup, near_dedup, packing, substring_dedup, toxicity
from starloom.llm.common import words_of
from starloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "en er ch sch ein ung keit zu ver ö", "fr": "eau oui é è que tion le la ment ç", "es": "ción ar os as el ñ que do la í"}


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def sentence(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)


# language ID
def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang := rng.choice(list(SYLLABLES)), rng.randrange(20, 60)), lang) for i in range(400)]
    odd = [(900, None, "en"), (901, "", "en"), (902, "123 !?", "fr"), (903, "én", None), (None, sentence(rng, "de", 30), "de"), (904, sentence(rng, "es", 20_000), None), (905, "δ", None)]
    got = {r["doc_id"]: r for r in langid.language_report(frame(spark, rows + odd + odd[-1:])).collect()}
    held = [r for r in rows if fold(r[0]) == 2]
    assert all(got[i]["held_out"] == (fold(i) == 2) for i, _, _ in rows)
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) / len(held) > 0.97
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[None]["lang_pred"] == "de" and not got[None]["held_out"]
    assert got[904]["lang_pred"] == "es" and got[905]["lang_pred"] in SYLLABLES and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_learns_nothing_from_held_out_rows(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, "en", 20), "en" if fold(i) != 2 else "zz") for i in range(60)]
    assert {r["lang_pred"] for r in langid.language_report(frame(spark, rows)).collect()} == {"en"}
    assert langid.language_report(frame(spark, [])).collect() == []
    alone = langid.language_report(frame(spark, [(1, "abc", None)])).first()
    assert (alone["lang_pred"], alone["score"]) == ("und", 0.0)


def test_added_columns_give_way(spark):
    df = frame(spark, [(1, "the end", "en")]).withColumn("lang_pred", F.lit("old"))
    assert langid.identify(df, langid.train(df)).columns == [*df.columns[:-1], "lang_pred", "lang_score"]


# toxicity
def test_segments_are_maximal():
    def brute(full):
        out = []

        def best(lo, hi):
            top = max(((round(sum(full[i : j + 1]), 9), i - j, i, j) for i in range(lo, hi) for j in range(i, hi)), default=(0, 0, 0, 0))
            if top[0] > 1e-9:
                out.append((top[2], top[3], round(top[0], 6)))
                best(lo, top[2])
                best(top[3] + 1, hi)

        best(0, len(full))
        return sorted(out)

    rng = random.Random(4)
    for _ in range(200):
        full = [rng.choice([-0.7, -1.3, -3.1, 1.0, 2.5, 4.0]) for _ in range(rng.randrange(1, 14))]
        assert sorted((a, b, round(s, 6)) for a, b, s in toxicity.segments(np.array(full))) == brute(full)


def test_segments_take_linear_time():
    score = np.full(1_000_000, -0.7)
    score[::10] = 2.0
    began = time.perf_counter()
    assert len(toxicity.segments(score)) == 100_000
    score[::10] = 7.0
    assert len(toxicity.segments(score)) == 1 and time.perf_counter() - began < 5


def test_toxicity(spark):
    rng = random.Random(3)
    bad = ["zorkel", "zorkig", "blaffe", "grumzig"]
    rows, labels = [], []
    for i in range(700):
        toxic = rng.random() < 0.15
        words = sentence(rng, "en", rng.randrange(5, 200)).split()
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        rows.append((i, " ".join(words), "en"))
        labels += [(i, 1, int(toxic))] * (1 if i % 2 else 2)
    odd = [(900, None, "en"), (901, "", "en"), (None, "zorkel zorkig", "en"), (902, "the " * 20_000 + "zorkel blaffe", "en")]
    marks = spark.createDataFrame([*labels, (None, 1, 1), (901, None, None)], "doc_id long, quality int, toxic int")
    df = frame(spark, rows + odd).withColumn("score", F.lit(1))
    got = {r["doc_id"]: r for r in toxicity.toxicity_report(df.union(df.filter("doc_id = 902")), marks).collect()}
    assert toxicity.toxicity_report(df.filter("doc_id > 9999"), marks).collect() == []
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if fold(i) == 2]
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97
    assert got[None]["predicted"] == 1 and got[901]["predicted"] == 0 and got[900]["score"] == got[901]["score"]
    assert got[902]["score"] > got[901]["score"] and all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 704
    model = toxicity.train(df, marks)
    passages = toxicity.score_texts(frame(spark, [(1, "on he zorkel blaffe in", "en")]), model).first()["passages"]
    assert [(p["first"], p["last"]) for p in passages] == [(2, 3)]


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(frame(spark, [(1, "a b", "en"), (2, None, "en")]), none).collect()
    assert [r["predicted"] for r in got] == [0, 0]


# near-dedup
def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**62, 300).astype(np.uint64))
    ca = rng.integers(1, 6, len(a))
    keep = rng.random(len(a)) < 0.85
    b, cb = np.concatenate([a[keep], a[~keep] + np.uint64(1)]), np.concatenate([np.maximum(1, ca[keep] - 1), ca[~keep]])
    order = np.argsort(b)
    want = near_dedup.similarity((a, ca), (b[order], cb[order]))
    agree = []
    for salt in range(80):
        first = near_dedup.bag_minhash(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]) ^ np.uint64(salt * 99991), np.concatenate([ca, cb]), 2, 48)
        agree.append((first[0] == first[1]).mean())
    assert abs(np.mean(agree) - want) < 0.03


def mutate(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def near_rows():
    rng = random.Random(6)
    rows = []
    for _ in range(12):
        base = sentence(rng, rng.choice(list(SYLLABLES)), rng.randrange(60, 200)).split()
        rows += [" ".join(base)] * rng.randrange(1, 3)
        for _ in range(rng.randrange(0, 5)):
            base = mutate(rng, base, rng.randrange(1, 4))
            rows.append(" ".join(base).upper() if rng.random() < 0.2 else ", ".join(base))
    rows += ["short one", "Short, one!", "la la la la la la la la", "la la la la la la la la la", "", None, "!!", "!!"]
    return [(i, t, "en") for i, t in enumerate(rows)]


def brute_classes(rows):
    some = [(i, t) for i, t, _ in rows if i is not None]
    words = words_of([None if t is None else t.encode() for _, t in some])
    sets = [near_dedup.multiset(words.hash[words.begin[k] : words.begin[k + 1]]) for k in range(len(some))]
    label = {i: i for i, _ in some}
    while True:
        before = dict(label)
        for x in range(len(some)):
            for y in range(x):
                if len(sets[x][0]) and len(sets[y][0]) and near_dedup.similarity(sets[x], sets[y]) >= 0.8:
                    label[some[x][0]] = label[some[y][0]] = min(label[some[x][0]], label[some[y][0]])
        if before == label:
            return label


def test_near_duplicates(spark):
    rows = near_rows()
    df = frame(spark, [*rows, (None, rows[0][1], "en")]).withColumn("rep_id", F.lit("x"))
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) + 1
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == brute_classes(rows)
    kept = near_dedup.drop_near_duplicates(df.unionByName(df.filter("doc_id = 0")))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({*brute_classes(rows).values()})
    assert kept.filter("doc_id is null").count() == 1 and kept.columns == df.columns
    assert near_dedup.near_duplicates(df.filter("doc_id > 9999")).collect() == []


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rng = random.Random(12)
    base, rows = sentence(rng, "en", 100).split(), []
    for _ in range(120):  # pairs that only their own link connects, in buckets of many
        mother = mutate(rng, base, 3)
        rows += [mother, mutate(rng, mother, 1)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w), "en") for i, w in enumerate(rows)]
    want = brute_classes(rows)
    for words in (near_dedup.GROUP_WORDS, 3000):
        monkeypatch.setattr(near_dedup, "GROUP_WORDS", words)
        assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()} == want


def test_near_duplicates_with_other_ids(spark):
    rng = random.Random(40)
    base = sentence(rng, "en", 80).split()
    rows = [("b", " ".join(base)), ("a", " ".join(mutate(rng, base, 1))), ("a", sentence(rng, "fr", 50)), ("c", " ".join(base)), ("c", " ".join(base)), ("d", " ".join(mutate(rng, base, 1))), ("d", " ".join(mutate(rng, base, 1)))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [("a", "a"), ("a", "a"), ("b", "a"), ("c", "a"), ("c", "a"), ("d", "a"), ("d", "a")]
    kept = sorted((r["doc_id"], r["text"]) for r in near_dedup.drop_near_duplicates(df).collect())
    assert kept == sorted([rows[1], rows[2]])


def test_many_near_copies_are_one_class(spark, monkeypatch):
    """700 near copies around the limit, with hot keys and without, against all pairs."""
    rng = random.Random(41)
    base = sentence(rng, "de", 200).split()
    rows = [(i, " ".join(mutate(rng, base, 4)), "de") for i in range(700)]
    want = brute_classes(rows)
    for least in (1000, 1):
        monkeypatch.setattr(common, "LEAST_HOT", least)
        assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()} == want


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(90, 70), (70, 80), (5, 5)], "a long, b long")
    got = {r["id"]: r["label"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 21 for i in range(21, 41)} | {90: 70, 70: 70, 80: 70}


# substring dedup
def sliced(text):
    words = words_of([text.encode()]).hash
    return substring_dedup.Sliced(np.array([0]), np.array([len(words)]), words)


def test_fragments_match_every_place():
    a, b = sliced("x y z a b c d e f g h q"), sliced("a b c d e f g h r r r r")
    assert substring_dedup.fragments(a, b) == [(3, 0, 8)]
    assert substring_dedup.fragments(sliced("a b"), b) == []
    once, twice = [f"w{k}" for k in range(60)], [f"w{k}" for k in range(60)] * 2
    for x, y in ((once, ["u"] + twice), (["u"] + twice, once), (twice, ["u"] + twice * 2)):
        spans = substring_dedup.shared_spans(sliced(" ".join(x)), sliced(" ".join(y)))
        for side, text in ((0, x), (2, y)):
            covered = {k for s in spans for k in range(s[side], s[side + 1])}
            assert covered >= {k for k, w in enumerate(text) if w != "u"}


def test_long_repeats_take_linear_time():
    began = time.perf_counter()
    spans = substring_dedup.shared_spans(sliced("spam " * 20_000), sliced("spam " * 15_000))
    assert spans and time.perf_counter() - began < 20


def test_chains_follow_order():
    parts = [(0, 100, 20), (22, 122, 20), (50, 10, 30), (45, 145, 10)]
    best = substring_dedup.chains(sorted(parts), 400)[0]
    assert best == [(0, 100, 20), (22, 122, 20), (45, 145, 10)]


def test_chains_take_the_best_within_reach():
    parts = [(0, 0, 100), (150, 150, 10), (165, 165, 10)]
    assert substring_dedup.chains(parts, 400) == [[(0, 0, 100)], parts[1:]]
    rng, cost, most, k = random.Random(4), substring_dedup.GAP_COST, substring_dedup.GAP_MOST, substring_dedup.KMER
    for _ in range(60):
        parts = sorted({(rng.randrange(200), rng.randrange(200), rng.randrange(k, 40)) for _ in range(40)})
        score = []
        for i, j, n in parts:
            fits = [s - cost * (i + j - a - b - 2 * m) for (a, b, m), s in zip(parts, score, strict=False) if 1 - k <= i - a - m <= most and 1 - k <= j - b - m <= most]
            score.append(n + max(0, *fits, 0))
        best = substring_dedup.chains(parts, 300)[0]
        got = sum(n for *_, n in best) - cost * sum(c - a - m + d - b - m for (a, b, m), (c, d, _) in zip(best, best[1:], strict=False))
        assert abs(got - max(score)) < 1e-6


def test_winnowing_guarantee():
    rng = random.Random(9)
    shared = sentence(rng, "en", 50).split()
    for _ in range(30):
        texts = [" ".join(sentence(rng, "en", rng.randrange(40)).split() + shared + sentence(rng, "en", rng.randrange(40)).split()).encode() for _ in range(2)]
        words = words_of(texts)
        found = [substring_dedup.winnow(substring_dedup.kmers(words.hash[words.begin[k] : words.begin[k + 1]]))[0] for k in range(2)]
        assert len({*found[0].tolist()} & {*found[1].tolist()}) >= 2


def unique(rng, n):
    """Long words of their own: chance matches are unlikely."""
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def passages_of(spark, table):
    got = defaultdict(list)
    for r in substring_dedup.repeated_passages(frame(spark, table).withColumn("n_words", F.lit(1))).collect():
        got[r["doc_id"]].append((r["first_word"], r["end_word"]))
        assert r["n_words"] == r["end_word"] - r["first_word"]
    return got


def test_repeated_passages(spark):
    rng = random.Random(8)
    passage, fuzzy = unique(rng, 70), unique(rng, 90)
    other = list(fuzzy)
    for k in range(10, 90, 15):
        other[k] = "changed"
    del other[40]
    rows = [
        (1, unique(rng, 100) + passage + unique(rng, 50)),
        (2, passage + unique(rng, 60)),
        (3, unique(rng, 80)),
        (4, unique(rng, 30) + passage),
        (5, unique(rng, 20) + fuzzy + unique(rng, 20)),
        (6, other + unique(rng, 200)),
        (7, unique(rng, 30) + passage[:40] + unique(rng, 30)),
        (8, ["spam"] * 90 + unique(rng, 20)),
        (9, unique(rng, 25) + ["spam"] * 70),
        (10, sentence(rng, "de", 5).split()),
        (11, unique(rng, 60) * 2),
        (12, unique(rng, 30_000) + passage + unique(rng, 3000)),
    ]
    table = [(i, " ".join(w), "en") for i, w in rows] + [(20, None, "en"), (21, "", "en"), (None, " ".join(passage), "en"), (2, " ".join(rows[1][1]), "en")]
    table += [(i, " ".join(rows[2][1]), "en") for i in (30, 31)]
    got = passages_of(spark, table)
    assert got[1] == [(100, 170)] and got[2] == [(0, 70)] and got[4] == [(30, 100)] and got[12] == [(30_000, 30_070)]
    assert len(got[5]) == len(got[6]) == 1 and got[5][0][0] <= 22 and got[5][0][1] >= 105
    assert got[3] == got[30] == got[31] == [(0, 80)]
    assert got[8] and got[9] and not {7, 10, 11, 20, 21, None} & set(got)
    assert substring_dedup.repeated_passages(frame(spark, table[2:3])).collect() == []
    assert substring_dedup.repeated_passages(frame(spark, [])).collect() == []


def test_passages_do_not_depend_on_other_rows(spark):
    rng = random.Random(31)
    passage = unique(rng, 50)
    rows = [(10, unique(rng, 40) + passage + unique(rng, 40)), (11, unique(rng, 60) + passage + unique(rng, 20))]
    for d, at in enumerate(range(0, 50, 6)):  # each seed of the passage has a lower document of its own
        rows.append((d, unique(rng, 30) + passage[at : at + 11] + unique(rng, 30)))
    got = passages_of(spark, [(i, " ".join(w), "en") for i, w in rows])
    assert dict(got) == {10: [(40, 90)], 11: [(60, 110)]}


def test_pieces_of_several_partners_are_no_passage(spark):
    rng = random.Random(32)
    a, b = unique(rng, 38), unique(rng, 38)
    rows = [(1, unique(rng, 40) + a + unique(rng, 40)), (2, unique(rng, 50) + b + unique(rng, 20)), (3, unique(rng, 60) + a + b + unique(rng, 60))]
    assert passages_of(spark, [(i, " ".join(w), "en") for i, w in rows]) == {}


def test_exact_passages_against_brute_force(spark):
    """Documents from a common stock of phrases, so that seeds have many holders: all repeated runs of 50 words and nothing else."""
    rng = random.Random(33)
    stock = [unique(rng, rng.choice([5, 9, 14, 25, 40])) for _ in range(25)]
    long = [unique(rng, 30) + rng.choice(stock) + unique(rng, 20) for _ in range(6)]
    docs = []
    for _ in range(160):
        text = unique(rng, 3)
        while len(text) < 150:
            text += rng.choice(long) if rng.random() < 0.1 else rng.choice(stock) if rng.random() < 0.75 else unique(rng, rng.randrange(1, 12))
        docs.append(text)
    held = defaultdict(set)
    for d, text in enumerate(docs):
        for k in range(len(text) - 49):
            held[tuple(text[k : k + 50])].add(d)
    got = passages_of(spark, [(d, " ".join(t), "en") for d, t in enumerate(docs)])
    want, missed = set(), 0
    for d, text in enumerate(docs):
        inside = {k + x for k in range(len(text) - 49) if len(held[tuple(text[k : k + 50])]) > 1 for x in range(50)}
        covered = {x for s, e in got.get(d, []) for x in range(s, e)}
        missed += len(inside - covered)
        assert not inside or covered & inside
        want |= {d} if inside else set()
        for s, e in got.get(d, []):  # nothing without a partner that has most of it
            mine = {tuple(text[k : k + 6]) for k in range(s, e - 5)}
            best = max(len(mine & {tuple(t[k : k + 6]) for k in range(len(t) - 5)}) for o, t in enumerate(docs) if o != d)
            assert best >= 12  # seven in ten words may agree
    assert len(want) > 30 and missed <= 0.02 * sum(e - s for spans in got.values() for s, e in spans)


def test_fuzzy_passages_recall(spark):
    rng = random.Random(21)
    rows = {}
    for k in range(0, 300, 2):
        passage = unique(rng, 60)
        other = [w if rng.random() > 0.1 else f"x{rng.randrange(10**9)}" for w in passage]
        for d, some in ((k, passage), (k + 1, other)):
            rows[d] = unique(rng, 40) + some + unique(rng, 40)
    spans = {d: substring_dedup.shared_spans(sliced(" ".join(rows[d])), sliced(" ".join(rows[d - 1]))) for d in range(1, len(rows), 2)}
    want = {d for d, some in spans.items() if any(e - s >= 50 for s, e, _ in substring_dedup.join_spans([(s, e, 0) for s, e, _, _ in some]))}
    got = set(passages_of(spark, [(d, " ".join(w), "en") for d, w in rows.items()]))
    assert len(want - got) <= 0.05 * len(want) and len(want) > 90  # some 3 in 100 keep no seed


@pytest.mark.parametrize("every", [0, 8, 3])
def test_planted_fuzzy_passages(spark, every):
    """Pairs that share 80 words with one in ten replaced are found, also where lower documents quote 12 words of the passage from many places."""
    rng, quotes, pairs = random.Random(50 + every), [], []
    for _ in range(60):
        passage = unique(rng, 80)
        other = [w if rng.random() > 0.1 else f"x{rng.randrange(10**9)}" for w in passage]
        for some in (passage, other):
            before = rng.randrange(30, 80)
            pairs.append((unique(rng, before) + some + unique(rng, 40), before))
        quotes += [unique(rng, 30) + passage[at : at + 12] + unique(rng, 30) for at in range(0, 68, every)] if every else []
    rows = [*quotes, *(w for w, _ in pairs)]
    got = passages_of(spark, [(i, " ".join(w), "en") for i, w in enumerate(rows)])
    seen = [any(min(e, at + 80) - max(s, at) >= 40 for s, e in got.get(len(quotes) + i, [])) for i, (_, at) in enumerate(pairs)]
    assert sum(a and b for a, b in zip(seen[::2], seen[1::2], strict=True)) >= 54
    assert not any(i in got for i in range(len(quotes)))  # a dozen words are no passage


def test_hot_keys_change_nothing(spark, monkeypatch):
    rng = random.Random(35)
    passage, line = unique(rng, 60), unique(rng, 20)
    rows = [(i, " ".join(unique(rng, 40) + (passage if i % 3 else line) + unique(rng, 40)), "en") for i in range(60)]
    rows += [(100 + i, rows[0][1], "en") for i in range(30)]
    want = {i: [(40, 100)] for i in range(60) if i % 3} | {i: [(0, 100)] for i in (0, *range(100, 130))}
    for hot, least in ((1000, 1000), (1000, 1), (3, 1)):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        monkeypatch.setattr(common, "HOT", hot)
        monkeypatch.setattr(common, "LEAST_HOT", least)
        assert dict(passages_of(spark, rows)) == want


def test_ids_of_any_type_and_repeated_ids(spark):
    rng = random.Random(36)
    passage = unique(rng, 60)
    rows = [("b", " ".join(unique(rng, 9) + passage)), ("a", " ".join(passage + unique(rng, 9))), ("a", " ".join(unique(rng, 70))), ("c", " ".join(unique(rng, 20) + passage))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r["doc_id"], r["first_word"], r["end_word"]) for r in got} == {("b", 9, 69), ("a", 0, 60), ("c", 20, 80)}
    assert all(r["other_id"] in "abc" for r in got)


# pipeline
def test_pipeline(spark, tmp_path):
    rng = random.Random(10)
    item = " ".join(f"item{k}" for k in range(40))
    rows = [(i, sentence(rng, "en" if i % 2 else "fr", 60) + ("\nAll rights reserved." if i < 15 else ""), "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, rows[3][1], "en"), (101, " ".join(mutate(rng, rows[20][1].split(), 1)), "fr"), (102, sentence(rng, "en", 20) + " " + item, "en"), (103, "123 456", "en"), (104, None, "en"), (105, "All rights reserved.", "en")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert k == 4 or docs.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    ids = {n: {r[0] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    everything = {r[0] for r in rows}
    assert ids["language"] == everything - {103, 104}
    assert ids["lines"] == ids["language"] and not seen["lines"].filter("text like '%rights%'").count()
    assert seen["lines"].filter("doc_id = 105").first()["text"] == "" and not seen["lines"].filter("n_chars <> length(text)").count()
    cut = [(r["doc_id"], r["text"], "") for r in seen["lines"].collect()]
    assert ids["near"] == set(brute_classes(cut).values()) and not {100, 101} & ids["near"]
    assert ids["clean"] == ids["near"] - {102} and ids["pack"] == ids["clean"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.drop("sequence_id", "offset").collect())) == sorted(map(tuple, seen["pack"].drop("sequence_id", "offset").collect()))


def test_pipeline_of_nothing(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "clean", "pack"] and corpus_pipeline.ORACLE_SQL is None
    assert line_dedup.BROADCAST_KEYS and packing.CAPACITY == 2048
    with pytest.raises(TypeError):
        corpus_pipeline.run()


def test_pairs_without_a_passage_are_not_chained():
    """A pair whose shared k-mers reach over fewer words than a passage is left at once; one that has a passage never is."""
    rng = np.random.default_rng(5)
    seen = {True: 0, False: 0}
    for turn in range(300):
        a, b = (rng.integers(1, 1 << 32, 200).astype(np.uint64) for _ in range(2))
        some = rng.integers(8, 90)
        i, j = rng.integers(0, 200 - some, 2)
        b[j : j + some] = a[i : i + some]
        if turn % 2:
            b[rng.random(200) < 0.06] = 7
        if turn % 3 == 0:
            a[100:], b[100:] = np.resize(a[:9], 100), np.resize(a[:9], 100)
        left, right = (substring_dedup.Sliced(np.array([0]), np.array([200]), x) for x in (a, b))
        found = [x for t in (0, 2) for x in substring_dedup.join_spans([(*s[t : t + 2], 0) for s in substring_dedup.shared_spans(left, right)]) if x[1] - x[0] >= 50]
        told = substring_dedup.may_share(left, right, 50)
        assert told or not found
        seen[told] += 1
    assert min(seen.values()) > 50
    many = substring_dedup.Sliced.many(np.array([2, 1]), np.array([3, 300, 0]), np.array([40, 7, 60]), np.arange(107))
    alone = [substring_dedup.Sliced(np.array([3, 300]), np.array([40, 7]), np.arange(47)), substring_dedup.Sliced(np.array([0]), np.array([60]), np.arange(47, 107))]
    assert all((vars(x)[k] == vars(y)[k]).all() for x, y in zip(many, alone, strict=True) for k in ("first", "begin", "words", "at", "kmers"))


def test_hashes_of_long_runs():
    words = np.random.default_rng(2).integers(0, 1 << 32, 120).astype(np.uint64)
    words[70:] = words[:50]
    for k in (22, 50, 64, 121):
        h = substring_dedup.runs(words, k)
        assert len(h) == max(0, 121 - k) and len(np.unique(h)) == len({words[i : i + k].tobytes() for i in range(len(h))})
