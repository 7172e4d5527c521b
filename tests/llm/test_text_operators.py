import os
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import backoff, byte_bpe, html_text, licences, packing, warc
from tidemark.llm.queries import CAPTURED, QUERIES
from tidemark.sources.tables import load_table

from .conftest import EDGES

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


# byte-level BPE


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}
    )


@pytest.fixture(scope="module")
def ours():
    tokenizer = byte_bpe.load(RANKS)
    return byte_bpe.Encoder(tokenizer), byte_bpe.token_bytes(tokenizer)


TEXT = st.lists(st.sampled_from([*" \n\t\x1c\x85\xa0aabcdeE'sltv019.,!é漢🙂", "the", " of", "  ", "'ll", "<|endoftext|>"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(TEXT, st.text(max_size=60), st.builds(lambda c, n: c * n, st.sampled_from("a =.é0"), st.integers(0, 70))))
def test_ids_are_those_of_the_rank_file(theirs, ours, text):
    text = text.encode("utf-8", "ignore").decode()
    encoder, table = ours
    ids = np.frombuffer(encoder(text), np.uint32).tolist()
    assert ids == theirs.encode_ordinary(text)
    assert byte_bpe.decode(ids, table) == text.encode()


def test_memory_of_pieces_is_bounded(ours, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED_BYTES", 1000)
    encoder = byte_bpe.Encoder(ours[0].tokenizer)
    text = " ".join(f"word{i}" for i in range(50))
    assert encoder(text) == encoder.ids(text) and 0 < len(encoder.later) <= 6 and len(encoder.later.older) <= 6


def test_long_pieces_are_not_remembered(ours):
    """A thousand texts without a space: each is one piece, and none is kept."""
    encoder = byte_bpe.Encoder(ours[0].tokenizer)
    for i in range(1000):
        assert encoder("漢字" * 100 + str(i))
    assert not encoder.first and not encoder.later and encoder.first.held == 0


def test_split_characters_and_offsets(ours):
    encoder, table = ours
    text = "漢字 🙂 é"
    ids = np.frombuffer(encoder(text), np.uint32)
    assert "".join(byte_bpe.decode_parts([[i] for i in ids.tolist()], table)) == text
    assert not any("�" in part for part in byte_bpe.decode_parts([[i] for i in ids.tolist()], table))
    at = byte_bpe.offsets(ids, table)
    assert at[-1] == len(text.encode()) and b"".join(text.encode()[a:b] for a, b in zip(at[:-1], at[1:])) == text.encode()


def test_encode_edges(spark, edges, theirs):
    rows = byte_bpe.round_trip(edges, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(theirs.encode_ordinary(t or "")) for _, t, *_ in EDGES)
    wide = byte_bpe.encode_column(edges, RANKS)
    assert wide.columns == [*edges.columns, "ids", "offsets"]
    for r in wide.collect():
        assert r["ids"] == theirs.encode_ordinary(r["text"] or "") and r["offsets"][-1] == len((r["text"] or "").encode())
    assert byte_bpe.round_trip(edges.limit(0), RANKS).collect() == []


# packing


def checked(rows, capacity):
    """Pieces lie in their sequences without gaps."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_packing_edges(edges):
    rows = packing.best_fit_packing(edges, JSON).collect()
    checked(rows, 1024)
    encoder = byte_bpe.Encoder(byte_bpe.load(JSON))
    totals = sorted((len(encoder(t or "")) // 4 + 1 for _, t, *_ in EDGES))
    whole = {}
    for r in rows:
        key = (r["doc_id"], r["sequence_id"]) if r["start"] == 0 else None
        whole.setdefault(key, 0)
    assert sum(r["length"] for r in rows) == sum(totals)
    assert sum(r["piece"] == 0 for r in rows) == len(EDGES)
    assert packing.best_fit_packing(edges.limit(0), JSON).collect() == []


@settings(max_examples=50, deadline=None)
@given(total=st.integers(1, 6000))
def test_only_the_first_piece_is_shorter(total):
    parts = packing.cut(total, 1024)
    assert sum(n for _, n in parts) == total and [s for s, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist()
    assert all(n == 1024 for _, n in parts[1:]) and 1 <= parts[0][1] <= 1024


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(1, 100), max_size=150))
def test_search_keeps_pieces_and_saves_bins(lengths):
    sizes = np.array(lengths, np.int64)
    first = packing.best_fit(sizes, 100)
    bins = packing.local_search([list(b) for b in first], sizes, 100)
    assert sorted(p for b in bins for p in b) == list(range(len(lengths)))
    assert all(sizes[b].sum() <= 100 for b in bins) and len(bins) <= len(first)


def test_search_empties_a_bin():
    # 6 + 3 | 5 + 3 | 2: exchanging 3 for 2 and so on fills two bins of ten but for one unit
    sizes = np.array([6, 3, 5, 3, 2], np.int64)
    assert len(packing.local_search([[0, 1], [2, 3], [4]], sizes, 10)) == 2


def rises(bins, sizes, capacity):
    """Exchanges one for one, two for one and moves that would still raise the squares, by brute force."""
    fill = np.array([sizes[b].sum() for b in bins])
    owner = np.concatenate([np.repeat(np.arange(len(bins)), list(map(len, bins))), np.arange(len(bins))])
    taken = np.concatenate([np.concatenate([sizes[b] for b in bins]), np.zeros(len(bins), np.int64)])
    found = 0
    for k, b in enumerate(bins):
        own = sizes[b].tolist()
        for two, give in [*((False, x) for x in own), *((True, x + y) for i, x in enumerate(own) for y in own[:i])]:
            gain = give - taken
            found += int(((owner != k) & (gain > 0) & (fill[owner] + gain <= capacity) & (fill[owner] - fill[k] + gain > 0) & ~(two & (taken == 0))).sum())
    return found


@pytest.mark.parametrize(("low", "high", "count"), [(300, 700, 6000), (1, 60, 500), (341, 700, 2500)])
def test_no_exchange_is_left_after_the_search(low, high, count):
    # even sizes and an odd capacity: no bin is ever full
    sizes = np.random.default_rng(5).integers(low, high, count) // 2 * 2 + 2
    bins = packing.local_search(packing.best_fit(sizes, 1023), sizes, 1023)
    assert sorted(p for b in bins for p in b) == list(range(count)) and all(sizes[b].sum() <= 1023 for b in bins)
    assert rises(bins, sizes, 1023) == 0


def test_rounds_end_only_when_one_saves_nothing(spark, monkeypatch):
    rounds = []

    def settled(frame, name):
        out = settle(frame, name)
        if name == "packing-round":
            rounds.append(out.filter("offset = 0").count())
        return out

    settle = packing.settle
    monkeypatch.setattr(packing, "settle", settled)
    # no sequence can be full
    lengths = (np.random.default_rng(4).integers(5, 30, 400) * 2).tolist()
    found = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    rows = packing.pack(found, capacity=101, block=40).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(400))
    assert len(rounds) > 1 and rounds[-1] >= rounds[-2] and rounds[:-1] == sorted(set(rounds[:-1]), reverse=True)
    assert checked(rows, 101) == min(rounds)


def test_rounds_over_blocks(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 3000).tolist()
    found = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    rows = packing.pack(found, capacity=100, block=200).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    least = max(-(-sum(lengths) // 100), sum(n > 50 for n in lengths))
    assert checked(rows, 100) <= 1.02 * least


# HTML


def test_main_text_of_a_marked_article():
    page = (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li>Home</li></ul></nav>'
        '<div class="ad">Buy now</div><article><h1>Head &amp; tail</h1><p>One <b>bold\nword</b>.<br>Two<p>Three</p>'
        '<aside>side</aside><form>name</form><section class="comments"><p>so long a comment</p></section></article>'
        "<footer>&copy; x</footer></body></html>"
    )
    assert html_text.main_text(page) == "Head & tail One bold word. Two Three"


def test_main_text_by_surge_and_dive():
    page = "<body><p>Menu</p><div class='cookie-notice'>We use cookies</div>" + "<p>" + "words of the text " * 10 + "</p>" + "<hr>" * 3
    page += "<p>" + "and more of it " * 10 + "</p><div id=comments><p>" + "reader " * 50 + "</p></div></body>"
    text = html_text.main_text(page)
    assert text.endswith("and more of it") and "cookies" not in text and "reader" not in text and "words of the text" in text


@pytest.mark.parametrize(
    ("page", "text"),
    [("", ""), ("plain", "plain"), ("a < b <p>c & d&nbsp;e", "a < b c & d e"), ("<script>x", ""), ("<nav>x<article>y", "y"), ("<p>&bogus; &#65;", "&bogus; A")],
)
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p class="notice">x<p>one</p><p>two</p></article>', "one two"),
        ('<article><ul><li class="ad">x<li>one<li>two</ul><p>three</article>', "one two three"),
        ('<article><dl><dt class="ad">x<dd>one<dt>two</dl>three</article>', "one two three"),
        ('<article><table><tr class="ad"><td>x<tr><td class="ad">y<td>one</table>two</article>', "one two"),
        ('<article><div class="ad"><p>x<div>y<p>z</div>w</div>one</article>', "one"),
        ('<article><p>one<span class="share">x<b>y</p>two</article>', "one two"),
        ('<article><p>one</p><div class="ad">x</article><article>two</article>', "one two"),
        ('<article><p>one</p><section class="comments"><article class="comment">x</article>y</section><p>two</article>', "one two"),
        ("<article>one</article><aside><article>x</article></aside>", "one"),
        ('<div class="menu">x<article>one</article>', "one"),
        ("<head><meta charset=utf-8><p>one", "one"),
        # raw elements closed in their own tag, or never
        ("<article><p>a</p><svg class='i'/><p>b</p></article>", "a b"),
        ("<article><p>a</p><iframe src=x /><p>b</p><object data=x><p>c</p></article>", "a b c"),
        ("<article><p>a</p><svg><text>x</text></svg><iframe>y</iframe><p>b</p></article>", "a b"),
        # quotes and signs inside values, quotes that open none
        ('<article><p title="a<b">one</p><p title=it\'s>two</p><p title="x > y">three</p></article>', "one two three"),
        ("<article><p title='>one</p><p \">two</p></article>", "one two"),
        # only the naming attributes name, and tokens do so as a whole
        ("<article><p data-id=\"comments\">one</p><p data-testid='login banner' title='class=menu'>two</p></article>", "one two"),
        ("<div class='page has-sidebar'><article>one<p class='share-price'>two<p class=search-engines>three</p></article></div>", "one two three"),
        ("<article>one<ul class='x comment-list'><li>y</ul><p class='site-footer'>z<p class=\"ad-slot-2\">w</p></article>", "one"),
        # articles of comments are no main text, beside the main article or in it
        ("<article>one<article class='comment'>x</article>two</article><article class='comment reply'>y</article>", "one two"),
        ("<div class=menu><article class=comment>x</article><article>one</article></div>", "one"),
    ],
)
def test_ends_that_html_implies(page, text):
    assert html_text.main_text(page) == text


def test_text_after_the_main_text_of_an_unmarked_page_goes():
    long = "<p>" + "words of the text " * 10 + "</p>"
    table = "<table><tr><td>cell</td></tr><tr><td>more</td></tr></table>"
    page = f"<body><div><div>{long}<div><p>Short.</p></div>{table}{long}</div></div><section><div><p>Nice one</p><p>Thanks</p></div></section></body>"
    text = html_text.main_text(page)
    assert "Short. cell more words" in text and text.endswith("of the text") and "Nice" not in text and "Thanks" not in text


def test_links_among_the_lines_of_an_unmarked_page_stay():
    long = "<p>" + "words of the text " * 10 + "</p>"
    text = html_text.main_text(f"<body><nav>x</nav><div>{long}<h2><a href=a>A linked headline</a></h2><p><a href=b>Linked</a></p>{long}</div></body>")
    assert "text A linked headline Linked words" in text and "x" not in text.split()


def test_deep_and_unmatched_tags_are_read_once():
    import time

    start = time.time()
    html_text.main_text("<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "<p>x</table>" * 10_000)
    for odd in ("<a x=\"", "<a x='<b y=\"", "<svg ", "<a =", "<a\"'"):
        html_text.main_text(odd * 50_000)
    assert time.time() - start < 20


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None, "q"), (None, "u", "<p>x</p>", "q"), (1, None, None, "q")], "page_id long, url string, html string, text string")
    assert sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()), key=str) == [
        (1, None, "", 0), (1, None, "", 0), (None, "u", "x", 1)
    ]
    assert html_text.extract(pages.limit(0)).collect() == []


@tables
def test_articles_of_the_pages(spark):
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in load_table(spark, SF, "pages").collect()}
    for r in QUERIES["op3_html_main_text"](spark, SF).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        plain = re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else "\0", inner)
        assert r["text"] == " ".join(unescape(plain).replace("\0", " ").split())


# WARC


@tables
def test_derivatives_link_back(spark):
    rows = QUERIES["op5_warc_derivatives"](spark, SF).collect()
    pages = {r["page_id"]: r for r in load_table(spark, SF, "pages").collect()}
    assert len(rows) == 2 * len(pages) and len({r["record_id"] for r in rows}) == len(rows)
    made = {(r["page_id"], r["record_type"]): r for r in rows}
    for page_id, page in pages.items():
        meta, text = made[page_id, "metadata"], made[page_id, "conversion"]
        assert text["concurrent_to"] == meta["record_id"] and text["refers_to"] == meta["refers_to"]
        for r in (meta, text):
            headers, block = warc.parse(r["record"])
            assert headers["WARC-Refers-To"] == r["refers_to"] and headers["WARC-Date"] == CAPTURED
            assert headers["WARC-Target-URI"] == page["url"]
            assert int(headers["Content-Length"]) == len(block.encode()) == r["content_length"]
            assert headers["WARC-Block-Digest"] == warc.digest(block.encode()) == r["block_digest"]
            assert r["source_payload_digest"] == warc.digest(page["html"].encode())
        fields = warc.parse(meta["record"])[1]
        assert f"source-payload-digest: {meta['source_payload_digest']}\r\n" in fields


def test_warc_edges_and_files(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame(
        [(1, "http://a/\r\nX: y", "<a href='/b &amp; c'>t</a>"), (None, None, None), (1, "u", "")], "page_id long, url string, html string"
    )
    records = warc.derivatives(pages, CAPTURED)
    assert records.count() == 6 and warc.derivatives(pages.limit(0), CAPTURED).collect() == []
    warc.write_files(records.coalesce(1), str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("*.gz")
    parts = gzip.open(file).read().decode().split("\r\n\r\nWARC/1.1\r\n")
    assert len(parts) == 6
    found = [warc.parse(p if p.startswith("WARC/1.1") else f"WARC/1.1\r\n{p}") for p in parts]
    assert all("X" not in headers for headers, _ in found)
    assert any("outlink: /b & c\r\n" in block for _, block in found)


def test_conversions_have_all_visible_text():
    page = (
        "<head><title>T</title><style>p{}</style></head><nav><ul><li>Home<li>News</ul></nav><div class='ad'>Buy</div><article><p>one</p>"
        "<section class=comments>so</section></article><form>name<select><option>a<option>b</select></form><script>x</script><footer>end</footer>"
    )
    (_, made) = warc.derived(1, "u", page, CAPTURED, warc.HTTP_HEADERS)
    assert warc.parse(made["record"])[1].split("\n") == ["Home", "News", "Buy", "one", "so", "name", "a", "b", "end"]


def test_what_a_response_says_of_itself_is_kept(spark):
    import datetime

    head = "HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nX-Long: a\r\n b\r\nContent-Length: 8"
    when = datetime.datetime(2020, 5, 6, 7, 8, 9)
    rows = [(1, "u", "<p>x</p>", "<urn:uuid:1>", when, head, "sha1:P", "sha1:B"), (2, "u", "<p>x</p>", None, None, None, None, None)]
    kinds = "page_id long, url string, html string, record_id string, date timestamp_ntz, http_headers string, payload_digest string, block_digest string"
    pages = spark.createDataFrame(rows, kinds)
    plain = {(r["page_id"], r["record_type"]): r for r in warc.derivatives(pages.select("page_id", "url", "html"), CAPTURED).collect()}
    for r in warc.derivatives(pages, CAPTURED).collect():
        if r["page_id"] == 2:
            assert r == plain[2, r["record_type"]]
            continue
        headers, block = warc.parse(r["record"])
        assert headers["WARC-Refers-To"] == r["refers_to"] == "<urn:uuid:1>" and headers["WARC-Refers-To-Date"] == "2020-05-06T07:08:09Z"
        assert (r["source_payload_digest"], r["source_block_digest"]) == ("sha1:P", "sha1:B")
        assert r["source_headers"] == "Content-Type: text/html\r\nX-Long: a b\r\nContent-Length: 8"
        assert r["record_type"] != "metadata" or "source-x-long: a b\r\n" in block
    mapped = pages.filter("page_id = 1").select("page_id", "url", "html", F.create_map(F.lit("Server"), F.lit("s")).alias("http_headers"))
    assert {r["source_headers"] for r in warc.derivatives(mapped, CAPTURED).collect()} == {"Server: s"}
    # the digest of the block is that of the head as sent, with the body
    own = warc.derivatives(pages.filter("page_id = 1").drop("block_digest"), CAPTURED).first()
    assert own["source_block_digest"] == warc.digest(f"{head.replace(chr(13) + chr(10) + ' b', ' b')}\r\n\r\n<p>x</p>".encode())


# licences

BASE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NOTES = [
    "CC BY", "cc-by. cc  by\ncc by", "all rights reserved all rights reserved", "xall rights reserved", "ALL RIGHTS\nRESERVED.",
    "the GNU General Public License, version 2", "Ünder general public licenseß general-public-license é", "Kcc by İcc by",
    "cc cc by by", "all all rights rights reserved", "mit license", "x " * 500 + "Released under the MIT License. " * 3,
    "Permission is hereby granted, free of charge, to any person", "Licensed under the Apache License, Version 2.0.", "license " * 3000,
]


def base_places(text):
    words = BASE_WORD.findall((text or "").translate(LOWER))
    found = [(i, label) for phrase, label in licences.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_base_phrases_against_brute_force(spark):
    texts = [t for _, t, *_ in EDGES] + NOTES
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, n_words int")
    rows = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_places(text), text
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    label = {text: rows[i]["labels"] for i, text in enumerate(texts) if text}
    assert label[NOTES[5]] == "gpl,gpl-2.0" and label[NOTES[11]] == label[NOTES[12]] == "mit" and label[NOTES[13]] == "apache-2.0"
    assert label[NOTES[10]] == label[NOTES[14]] == ""
    assert licences.scan(docs.limit(0)).collect() == []


def test_every_notice_is_found(spark):
    docs = spark.createDataFrame([(i, f"before it. {text.title()} after") for i, (_, text, _) in enumerate(licences.NOTICES)], "doc_id long, text string")
    for r in licences.scan(docs).collect():
        assert licences.NOTICES[r["doc_id"]][0] in r["labels"].split(",") and r["score"] == 1


def test_all_notices_of_one_long_text_are_found(spark):
    text = " between them ".join(text for _, text, _ in licences.NOTICES) + " in the use of any free software " * 2000
    # the other texts make the words of some notices common
    rows = [(0, text), *[(i, "released under the mit license") for i in range(1, 9)]]
    found = {r["doc_id"]: r["labels"].split(",") for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {label for label, _, _ in licences.NOTICES} <= set(found.pop(0)) and all(labels == ["mit"] for labels in found.values())


def test_a_key_phrase_of_one_word_is_enough(spark):
    index = licences.Index([("zlib", "under the zlib terms", ["zlib"])])
    docs = spark.createDataFrame([(1, "under the zlib terms"), (2, "zlib zlib"), (3, "under the terms")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licences.scan(docs, index).collect()} == {1: "zlib", 2: "zlib", 3: ""}


# stupid backoff


def test_backoff_edges(spark, edges):
    rows = backoff.scores(edges).collect()
    assert len(rows) == len(EDGES)
    assert all(r["log_score"] == 0 for r in rows if not r["n_words"]) and all(r["log_score"] <= 0 for r in rows)
    assert backoff.scores(edges.limit(0)).collect() == []


def plain_backoff(texts, order):
    """Log scores, position by position."""
    import math
    from collections import Counter

    split = [(t or "").translate(LOWER).encode().split() for t in texts]
    counts = [Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = sum(map(len, split))

    def score(w, i):
        given_up = 0.0
        for n in range(min(order, i + 1), 0, -1):
            gram = tuple(w[i - n + 1 : i + 1])
            if n == 1:
                return given_up + math.log(counts[0][gram] / total)
            if counts[n - 1][gram] >= backoff.MIN_COUNT:
                return given_up + math.log(counts[n - 1][gram] / counts[n - 2][gram[:-1]])
            given_up += math.log(backoff.ALPHA)

    return [sum(score(w, i) for i in range(len(w))) for w in split]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_of_any_order(spark, monkeypatch, order):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 200)
    monkeypatch.setattr(backoff, "RANGE_BYTES", 300)
    rng = np.random.default_rng(order)
    texts = [" ".join(rng.choice(list("abCdeF"), rng.integers(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["log_score"] for r in backoff.scores(docs, order=order).collect()}
    for i, expected in enumerate(plain_backoff(texts, order)):
        assert abs(rows[i] - expected) < 1e-3


@tables
def test_the_query_of_order_three(spark):
    docs = load_table(spark, SF, "documents").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r["log_score"] for r in QUERIES["op2_stupid_backoff_order3"](spark, SF).collect()}
    expected = plain_backoff([r["text"] for r in docs], 3)
    assert len(rows) == len(docs) and expected != plain_backoff([r["text"] for r in docs], 2)
    assert all(abs(rows[r["doc_id"]] - score) < 1e-3 * max(1, abs(score)) for r, score in zip(docs, expected, strict=True))
