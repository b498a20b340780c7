"""Line dedup, decontamination, extraction, URL filters, audio and packing against brute force and on odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starloom.llm import decontaminate, html_extract, line_dedup, mpeg_audio, packing, url_filter
from starloom.llm.common import words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=""):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_words():
    texts = ["Ab cd-É2 x", None, "", "aaaaaaaaaaaaaaaaaaaaa aaaaaaaaaaaaaaaaaaaaa b" + "c" * 70, "\x00a\x7fb"]
    got = words_of([t if t is None else t.encode() for t in texts])
    assert np.diff(got.begin).tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    by = defaultdict(set)
    for w, h in zip(flat, got.hash.tolist(), strict=True):
        by[w].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({*map(min, by.values())}) == len(by)


# line dedup
def brute_lines(texts, min_docs, min_chars=1):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 0])
@pytest.mark.parametrize("min_chars", [1, 3])
def test_line_dedup(spark, limit, min_chars):
    rng = random.Random(3)
    lines = ["Same line", " same LINE\t", "é", "É", "xy", "", "rare %d"]
    texts = [None, "", "\n\n", "same line"] + ["\n".join(rng.choice(lines).replace("%d", str(rng.randrange(50))) for _ in range(rng.randrange(12))) for _ in range(40)]
    texts += texts[-3:] + ["Same line\n" * 3000 + "last"]
    df = docs(spark, texts).selectExpr("*", "1 as N_LINES", "2 as kept_text")
    got = line_dedup.line_dedup(df, min_docs=4, min_chars=min_chars, broadcast_keys=limit).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got] == brute_lines(texts, 4, min_chars)


def test_line_digest_of_nothing(spark):
    assert line_dedup.line_digest(docs(spark, ["x"]).filter("doc_id > 5")).collect() == []
    one = line_dedup.line_digest(docs(spark, [None])).first()
    assert one[:] == (0, 1, 0, hashlib.sha256(b"").hexdigest())


# decontamination
def brute_windows(texts, items, size=13):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k : k + m])].add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for window, ids in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= ids
        ids = sorted(str(i) for i in found if i is not None)
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 150])
def test_decontamination(spark, limit):
    rng = random.Random(5)
    vocabulary = ["a", "b", "Éa", "c9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(20)), (2, "Q Q"), (3, text(13)), (3, text(13)), (4, ""), (5, None), (None, "z"), (22, "q, q!"), (7, "a " * 30)]
    texts = [None, "", "q-Q q", "zz Z", items[0][1] + ". " + text(30), text(12) + " " + items[2][1].upper(), "a " * 200, text(400), "...", "x " * 50 + "z"]
    texts += [texts[4]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, texts).selectExpr("*", "1 as runs")
    got = decontaminate.find_windows(df, bench, max_bytes=limit)
    report = got.selectExpr("doc_id", "n_words").join(decontaminate.contamination_report(docs(spark, texts), bench, max_bytes=limit).drop("n_words"), "doc_id").orderBy("doc_id")
    assert [r[1:] for r in report.collect()] == brute_windows(texts, items)
    none = decontaminate.contamination_report(docs(spark, texts), bench.filter("item_id > 99"))
    assert none.filter("n_hit > 0").count() == 0 and none.count() == len(texts)


# extraction
PAGES = [
    (None, ""),
    ("", ""),
    ("<p></p>", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>One <b>two</b>\n three<p>Four&nbsp;five<script>if (a<b) '</p>'</script></p></article><footer>foot</footer>", "Head\nOne two three\nFour five"),
    ("<main><p>kept</p><aside>not</aside><div class='ad'>Buy</div><p>also</p></main><div id=comments><p>" + "talk " * 99 + "</p></div>", "kept\nalso"),
    ("<body><div class=header>Site</div><div><p>Body text of some length.</p><form>name <input></form><p>Second.</p></div><div class='cookie-notice'>We use cookies</div></body>", "Body text of some length.\nSecond."),
    ("<article><p>a <!-- x <p> --> b &lt;tag&gt; &#233;&#x41;</p></article>", "a b <tag> éA"),
    ("<article><p title=\"a>b\">x</p>tail</article>", "x\ntail"),
    ("<article>" + "<div>" * 6000 + "deep" + "</div>" * 6000 + "</article>", "deep"),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "t") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(df.union(df)).orderBy("page_id").collect()
    assert [r["text"] for r in got[::2]] == [t for _, t in PAGES]
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == 2 * len(PAGES)
    assert html_extract.extract_pages(df.filter("page_id > 99")).collect() == []


def test_no_part_of_an_article_is_lost():
    long = "<p>" + "text " * 40 + "</p>"
    for page, want in (
        ("<main><h1>T</h1><article><p>A</p><div class=ad>Buy</div><p>B</p></article></main>", ["T", "A", "B"]),
        ("<main><p>Intro</p><aside>Not</aside><article>" + long + "</article></main>", ["Intro", "text " * 39 + "text"]),
        ("<body><div>" + long + "</div><div class=ad>Buy</div><section><p>Short.</p></section><div class=ad>Buy</div><div>" + long + "</div></body>", ["text " * 39 + "text", "Short.", "text " * 39 + "text"]),
        ("<article>" + long + "</article><div class=ad>Buy</div><article>" + long + "</article>", ["text " * 39 + "text"] * 2),
        ("<div>Call us</div><article>" + long + "</article>", ["text " * 39 + "text"]),
    ):
        assert html_extract.main_text(page).split("\n") == want


def brute_passages(lines, window, surge):
    """Runs between borders, joined: a passage goes on over a border unless the sum from there falls under the threshold."""
    total = lambda i: sum(x.weight for x in lines[i : i + window])
    surge = min(surge, max(map(total, range(len(lines))), default=0))
    runs, run = [], []
    for i, x in enumerate(lines):
        if x.text:
            run.append(i)
        else:
            runs.append((run, i))
            run = []
    runs.append((run, None))
    found, open_ = [], None
    for run, border in runs:
        if open_ is None and any(lines[i].weight and total(i) >= surge for i in run):
            open_ = run[0]
        if open_ is not None and (border is None or total(border) < surge):
            found.append((open_, len(lines) if border is None else border))
            open_ = None
    return found


def test_passages_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        lines = [html_extract.Line("x" if (w := rng.choice([None, 0, 5, 40, 90, 200])) is not None else "", float(w or 0)) for _ in range(rng.randrange(0, 25))]
        for window in (1, 2, 5, 1000):
            assert html_extract.passages(lines, window, 86) == brute_passages(lines, window, 86)


def test_windows_decide():
    text = lambda n: "word " * n
    page = f"<div>Buy this now</div><section><p>{text(40)}</p><p>Yes.</p><p>{text(30)}</p></section><div>Call us today</div>"
    want = [text(40).strip(), "Yes.", text(30).strip()]
    assert html_extract.main_text(page).split("\n") == want
    assert html_extract.main_text(page, window=4).split("\n") == ["Buy this now", *want]
    assert html_extract.main_text(page, window=1000).split("\n") == ["Buy this now", *want]
    lines = html_extract.lines_of(page)
    assert [len(html_extract.passages(lines, surge=s)) for s in (5, 86, 10_000)] == [3, 1, 1]


def test_names_are_only_evidence(monkeypatch):
    long = "<p>" + "text " * 60 + "</p>"
    page = f"<nav><a href=/>Home</a></nav><div class=ad>Buy now</div><article><h1>Title</h1>{long}<p>End.</p></article><footer>foot</footer>"
    want = "Title\n" + ("text " * 60).strip() + "\nEnd."
    assert html_extract.main_text(page) == want
    monkeypatch.setattr(html_extract, "BOILER_NAMES", frozenset())
    assert html_extract.main_text(page) == want
    assert html_extract.main_text(page.replace("article", "div")) == want


def test_names_inside_an_article():
    """Comments marked up as articles and hidden articles go; a section of another name stays if its text surges."""
    long = "word " * 40
    for inner, kept in (
        (f"<article class=comment><p>{long}</p></article>", False),
        (f"<article hidden><p>{long}</p></article>", False),
        (f"<div class=comments><article><p>{long}</p></article></div>", False),
        (f"<section class=privacy><p>{long}</p></section>", True),
        (f"<div class=related-work><p>{long}</p></div>", True),
        ("<div class=related-work><p>See also</p></div>", False),
        (f"<div class=tags><a href=/a>{long}</a></div>", False),
        (f"<article><p>{long}</p></article>", True),
        ("<section><p>B</p></section>", True),
    ):
        got = html_extract.main_text(f"<article class=privacy><h1>Title</h1><p>{long}</p>{inner}<p>E</p></article>").split("\n")
        text = long.strip() if long.strip() in inner else "See also" if "See" in inner else "B"
        assert got == ["Title", long.strip(), *([text] if kept else []), "E"], inner
    assert html_extract.main_text(f"<main hidden><p>{long}</p></main><div><p>Seen</p></div>") == "Seen"


@pytest.mark.parametrize("piece", ['<a "', "<a '", "<a <", "<a ", '<a b="', '<a b=">" ', "<!--", "<script>", "</p", "<p>", "<div>", "</div><b>"])
def test_extraction_is_linear(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    html_extract.main_text("<p>start</p>" + page)
    assert time.perf_counter() - began < 15  # a second or two on an idle machine


def test_long_pages(spark):
    page = "<article>" + "".join(f"<p>Paragraph {k}.</p>" for k in range(60_000)) + "</article>"
    row = html_extract.extract_pages(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert row["text"].split("\n") == [f"Paragraph {k}." for k in range(60_000)] and row["n_chars"] == len(row["text"])


# URL filters
def test_url_filter(spark):
    rng = random.Random(1)
    hosts = ["com", "example.com", "xexample.com", "a.Example.NET", "net", "org", "b.org:80", "é.com", ""]
    urls = [None, "", "no scheme.com/en/", "http://a.com", "x://y://com/en/", "http://com/en/?q#f", "http://com/en\n/"]
    urls += [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(['/en/', '/en', '/de/8', '/de/9/8', '/en/7x', '/es/a', '', '/EN/'])}{rng.choice(['', '?a=/en/', '#x'])}" for _ in range(200)]
    rules = url_filter.RULES
    got = url_filter.url_filter(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")).orderBy("page_id").collect()
    for r, u in zip(got, urls, strict=True):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.text), default=None)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best.text, best.verdict if best else "allow")


def test_rule_index_with_wildcards():
    rules = [url_filter.Rule("block", "ads.example", "/*/banner/"), url_filter.Rule("block", "", "/track*"), url_filter.Rule("allow", "b.example", "/x_y/z")]
    index = url_filter.RuleIndex(rules)
    assert index.best("www.ads.example", "/a/b/banner/1").text == "ads.example/*/banner/"
    assert index.best("any.", "/tracker").verdict == "block" and index.best("b.example", "/x_y/zz").verdict == "allow"
    assert index.best("b.example", "/x/y/z") is None and len(index.by) == 3


def test_url_filter_ties_and_nothing(spark):
    rules = [url_filter.Rule("block", "a.com", "/x/"), url_filter.Rule("allow", "a.com", "/*/"), url_filter.Rule("block", "com", "/1234/")]
    pages = spark.createDataFrame([(1, "http://a.com/x/"), (2, "http://b.com/1234/"), (2, "http://b.com/1234/")], "page_id long, url string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, rules).collect())
    assert got == [(1, "a.com/*/", "allow"), (2, "com/1234/", "block"), (2, "com/1234/", "block")]  # equally long: allow
    assert url_filter.url_filter(pages.filter("page_id > 9")).collect() == []


# audio
def test_audio_round_trip(spark):
    texts = [None, "", "x", "é" * 32, "y" * 63, "z" * 64, "\x00" * 65, "long é " * 20_000]
    df = docs(spark, texts + texts).selectExpr("*", "1 as media", "2 as n_bytes")
    got = mpeg_audio.media_digest(df).orderBy("doc_id").collect()
    for r, t in zip(got, texts + texts, strict=True):
        raw = (t or "").encode()
        want = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        media = mpeg_audio.encode(want)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert [r["feature"] for r in got[:8]] == [r["feature"] for r in got[8:]]


def test_audio_damage():
    payload = mpeg_audio.pad("text é ".encode() * 700)
    media = mpeg_audio.encode(payload)
    whole = mpeg_audio.parse(media)
    assert whole.duration == (384 * (len(whole.offsets) - 1), 32000) and whole.wrong == 0
    assert whole.table["frames"] == len(whole.offsets) and sum(whole.table["entries"]) == whole.table["bytes"] == 432 * len(whole.offsets)
    assert whole.offsets == list(range(whole.offsets[0], len(media), 432))
    at = whole.offsets[5]
    junk = mpeg_audio.parse(media[:at] + b"\xff\xfbjunk\xff" + media[at:])
    assert junk.payload == payload and junk.skipped == 7 and len(junk.offsets) == len(whole.offsets)
    flipped = bytearray(media)
    flipped[at + 8] ^= 1  # inside the allocation that the checksum covers
    assert mpeg_audio.parse(bytes(flipped)).wrong == 1
    assert mpeg_audio.parse(b"").offsets == [] and mpeg_audio.parse(b"\xff" * 99).payload == b""
    with pytest.raises(ValueError):
        mpeg_audio.encode(b"\xff")
    assert mpeg_audio.parse(media + b"TAG" + b"Song".ljust(125, b"\0")).tags["TIT2"] == "Song"


def test_stereo_checksums_and_all_offsets(spark):
    head, bits = bytes([0xFF, 0xFE, 0x48, 0x00]), bytes(32)  # Layer I, 32,000 Hz, stereo, with checksums
    size = mpeg_audio.header(head).size
    frame = bytearray((head + mpeg_audio.crc16(head[2:] + bits).to_bytes(2, "big") + bits).ljust(size, b"\0"))
    damaged = bytearray(frame)
    damaged[30] ^= 1  # behind the bytes that a mono frame protects
    a = mpeg_audio.parse(bytes(frame + damaged + frame))
    assert (a.checked, a.wrong) == (3, 1)
    media = mpeg_audio.encode(mpeg_audio.pad(b"x" * 90_000))
    offsets = mpeg_audio.parse(media).offsets
    [row] = mpeg_audio.parse_media(spark.createDataFrame([(1, bytearray(media))], "doc_id long, media binary")).collect()
    assert len(offsets) > 2 * mpeg_audio.SEEK_ENTRIES and row["seek_offsets"] == offsets and row["frames"] == len(offsets)


def test_layer_two_is_not_verified(spark):
    head = bytes([0xFF, 0xFC, 0x18, 0xC0])  # layer II, 32 kbit/s, mono, with a checksum
    size = mpeg_audio.header(head).size
    media = head.ljust(size, b"\1") * 4
    a = mpeg_audio.parse(media)
    assert (len(a.offsets), a.checked, a.wrong, a.unverified) == (4, 0, 0, 4)
    table = spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(b"junk"))], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in mpeg_audio.parse_media(table).collect()}
    assert got[1]["unverified"] == 4 and got[2]["frames"] == got[3]["frames"] == 0
    assert mpeg_audio.media_digest(docs(spark, ["x"]).filter("doc_id > 5")).collect() == []


def test_layer_three():
    head = bytes([0xFF, 0xFB, 0x90, 0x00])  # 128 kbit/s, 44,100 Hz, stereo
    first = bytearray(head.ljust(417, b"\0"))
    first[36:44] = b"Xing\0\0\0\3"
    first[44:52] = (3).to_bytes(4, "big") + (4 * 417).to_bytes(4, "big")
    a = mpeg_audio.parse(bytes(first) + head.ljust(417, b"\0") * 3)
    assert a.table == {"frames": 3, "bytes": 1668} and a.duration == (3 * 1152, 44100) and a.offsets == [0, 417, 834, 1251]


# packing
def test_packing(spark):
    rng = random.Random(2)
    texts = [None, "", "A b. C", "Word's don't; x" * 400, "<|endoftext|> plain", "ΑΣ. Σ", "a\x1cb c\xa0d \x85"] + ["lorem ipsum dolor " * rng.randrange(1, 900) for _ in range(60)]
    texts += texts[-2:]
    got = packing.pack(docs(spark, texts).selectExpr("*", "1 as piece"), group=20).collect()
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        rows = sorted(by[i], key=lambda r: r["piece"])
        cuts = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows] == [(k, 2048 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cuts)]
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + len({s >> 32 for s in bins})
    assert packing.pack(docs(spark, ["x"]).filter("doc_id > 5")).collect() == []


def test_packing_rows_that_share_an_id(spark):
    df = docs(spark, ["lorem " * 3000, "ipsum"]).withColumn("doc_id", F.lit(7))
    got = packing.pack(df.union(df)).collect()
    assert len(got) == 2 * len(packing.pack(df).collect()) and {r["doc_id"] for r in got} == {7}
    places = [(r["sequence_id"], r["offset"]) for r in got]
    assert len({*places}) == len(places)


def test_local_search_empties_bins():
    lengths = [6, 5, 5, 4, 4, 3, 3]
    bins = packing.local_search([[0, 5], [1, 3], [2, 4], [6]], lengths, 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(7)) and all(sum(lengths[i] for i in b) <= 10 for b in bins)
    rng = random.Random(7)
    for _ in range(20):
        lengths = [rng.randrange(1, 2048) for _ in range(300)]
        first = packing.best_fit(lengths, 2048)
        after = packing.local_search([list(b) for b in first], lengths, 2048)
        assert len(after) <= len(first) and sorted(i for b in after for i in b) == list(range(300))
        assert all(sum(lengths[i] for i in b) <= 2048 for b in after)


def test_local_search_goes_on_until_nothing_changes():
    rng = random.Random(7782)
    capacity, n = rng.choice([30, 60, 100]), rng.randrange(10, 50)
    lengths = [rng.randrange(1, capacity // 2) for _ in range(n)]
    after = packing.local_search([[i] for i in range(n)], lengths, capacity)
    assert len(after) == 11 and packing.local_search([list(b) for b in after], lengths, capacity) == after
    lengths = [10] * 70 + [15]  # two pieces of a giver of many for one
    given, back = packing._exchange(list(range(70)), [70], lengths, 5)
    assert len(given) == 2 and back == (70,)


# Capacity and lengths that best-fit decreasing packs into one sequence more than they need.
STUBBORN = [(20, [8, 8, 7, 6, 6, 5]), (30, [14, 13, 12, 11, 10, 9, 5, 5, 4, 4]), (20, [12, 10, 10, 9, 9, 7, 7, 7, 4, 4, 4, 4, 4, 3, 3]), (100, [56, 46, 31, 24, 21, 14, 2])]


@pytest.mark.parametrize(("capacity", "lengths"), STUBBORN)
def test_the_search_saves_a_sequence(capacity, lengths):
    packed = packing.best_fit(lengths, capacity)
    better = packing.local_search([list(b) for b in packed], lengths, capacity)
    assert len(packed) == -(-sum(lengths) // capacity) + 1 == len(better) + 1
    assert sorted(i for b in better for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= capacity for b in better)
