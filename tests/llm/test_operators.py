"""Each operator against a brute-force version, on odd rows, an empty table and the smallest driver tables."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from veilgraph.llm import op1_line_dedup as op1
from veilgraph.llm import op2_html as op2
from veilgraph.llm import op3_sentencepiece as op3
from veilgraph.llm import op4_wavelet as op4
from veilgraph.llm import op5_substring as op5
from veilgraph.llm import op6_decontaminate as op6
from veilgraph.llm import op7_kneser_ney as op7
from veilgraph.llm import op8_quality_rules as op8
from veilgraph.llm import op9_separators as op9
from veilgraph.llm import op10_simhash as op10
from veilgraph.llm import queries
from veilgraph.llm.components import connected_components
from veilgraph.llm.shared import work_path
from veilgraph.llm.wavelet import WaveletMatrix, pack, unpack

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def both(odd, spark, small):
    """The odd rows and the smallest driver documents."""
    yield odd
    yield spark.read.parquet(f"{small}/documents.parquet")


# ---- 1


def _line_classes(docs):
    """Per document its places and texts of full lines; the first document of each line sequence; what later ones lose."""
    split = [[x.strip() for x in (t or "").split("\n")] for _, t in docs]
    full = [[k for k, x in enumerate(s) if x] for s in split]
    text = [[s[k] for k in f] for s, f in zip(split, full, strict=True)]
    classes, heads, gone = {}, [], defaultdict(set)
    for i, s in enumerate(text):
        if not s or docs[i][0] is None or docs[i][1] is None:
            continue
        if tuple(s) not in classes:
            classes[tuple(s)] = i
            heads.append(i)
        elif docs[i] != docs[classes[tuple(s)]] and sum(map(len, s)) >= op1.MIN_CHARS:
            gone[i] = set(range(len(s)))
    return full, text, heads, gone, classes


def _without_lines(docs, full, text, gone, classes):
    for i, s in enumerate(text):  # rows equal as a whole lose the same
        if tuple(s) in classes and docs[i] == docs[classes[tuple(s)]]:
            gone[i] = gone[classes[tuple(s)]]
    return [(d, len(gone[i]), None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in {full[i][g] for g in gone[i]})) for i, (d, t) in enumerate(docs)]


def all_pairs_lines(docs):
    """The rule: every first document loses what patience diff with any earlier one deletes."""
    full, text, heads, gone, classes = _line_classes(docs)
    for n, b in enumerate(heads):
        for a in heads[:n]:
            gone[b] |= set(op1.common_lines(text[a], text[b], [len(x) for x in text[b]]))
    return _without_lines(docs, full, text, gone, classes)


def in_order(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy("doc_id", "h").collect()]


def test_lines(odd, spark, small):
    short = [f"shared short line {k}" for k in range(3)]  # 57 characters together
    lone = "one line that is much longer than forty characters by itself"
    # the short lines have three different first holders; the long line comes twice in its first holders
    blocks = [(k, f"own {k}\n{short[k]}\nend {k}") for k in range(3)] + [(3 + k, "\n".join([f"own {3 + k}", *short, f"end {3 + k}"])) for k in range(30)]
    twice = [(k, "\n".join([f"p {k}", lone, f"q {k}", lone, f"r {k}"])) for k in range(12)] + [(12 + k, "\n".join([f"p {12 + k}", lone, f"r {12 + k}"])) for k in range(30)]
    page = "\n".join(f"line {k} of a page that is there twice as a whole row" for k in range(4))
    repeated = [(1, page), (1, page), (2, "start\n" + page), (2, "start\n" + page), (2, "other text\nof this id"), (3, page), (None, page)]
    # the line stays twice in all of them; then some hold it once, or between lines that others have
    doubled = [(k, "\n".join([f"a {k}", lone, f"b {k}", lone, f"c {k}"])) for k in range(40)]
    mixed = [(k, "\n".join([f"a {k}", *(["x"] if k % 3 else []), lone, *(["y", f"b {k}"] if k % 2 else ["z"]), *([lone] if k % 4 else []), *(["x"] if k % 5 == 0 else []), f"c {k}"])) for k in range(40)]
    # two passages that cross each other
    crossed = [(k, "\n".join((["u" * 45, f"own {k}", "v" * 45] if k % 2 else ["v" * 45, f"own {k}", "u" * 45]) + [f"end {k % 7}"])) for k in range(24)]
    apart = []  # one table of all these, no line of one in another
    for n, rows in enumerate((blocks, twice, doubled, doubled[:9], mixed, crossed)):
        apart += [(len(apart) + i, "\n".join(f"{x} in {n}" for x in t.split("\n"))) for i, (_, t) in enumerate(rows)]
    frames = [spark.createDataFrame(rows, "doc_id long, text string") for rows in (apart, repeated)]
    assert sum(r[1] for r in all_pairs_lines(blocks)) == 87 and sum(r[1] for r in all_pairs_lines(doubled)) == 0
    for frame in (*both(odd, spark, small), *frames):
        found = op1.drop_lines(frame)
        assert set(frame.columns) <= set(found.columns)
        assert rows_of(found, "doc_id", "n_removed", "text") == sorted(all_pairs_lines(in_order(frame)), key=repr)
    assert [r[1] for r in all_pairs_lines(repeated)] == [0, 0, 4, 4, 0, 4, 0]
    assert op1.drop_lines(odd.limit(0)).count() == 0


@pytest.mark.parametrize("holders", [2, 9, 40])
def test_lines_of_random_pages(spark, holders, monkeypatch):
    """As all pairs do, whatever the number of holders and where the switch to shapes lies."""
    rng = np.random.default_rng(holders)
    lines = ["s%d" % k for k in range(6)] + ["a longer line of a template, number %d, over forty" % k for k in range(4)]
    docs = []
    for k in range(holders):
        own = [lines[j] if rng.random() < 0.7 else f"own {k} {i}" for i, j in enumerate(rng.integers(0, len(lines), rng.integers(3, 14)).tolist())]
        docs.append((k, "\n".join(own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for switch in (1, op1.HOLDERS):
        monkeypatch.setattr(op1, "HOLDERS", switch)
        assert rows_of(op1.drop_lines(frame), "doc_id", "n_removed", "text") == sorted(all_pairs_lines(docs), key=repr)


def test_shortest_runs_cover_every_block():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes = rng.integers(1, 50, rng.integers(0, 12)).tolist()
        runs = op1.shortest_runs(sizes)
        for i in range(len(sizes)):
            for j in range(i + 1, len(sizes) + 1):
                if sum(sizes[i:j]) >= op1.MIN_CHARS:
                    assert {x for p, q in runs if i <= p and q <= j for x in range(p, q)} == set(range(i, j))


def test_patience():
    assert op1.align([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert op1.align([], [1]) == [] and op1.align([1, 1], [1, 1]) == [(0, 0), (1, 1)]
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 9, rng.integers(0, 15)).tolist(), rng.integers(0, 9, rng.integers(0, 15)).tolist()
        found = op1.align(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


# ---- 2


def test_pages(spark, small):
    nav = "<nav><a href=/x>menu</a></nav><div class='cookie-notice'>We use cookies, all of us, and you should agree to that now.</div>"
    body = "<article><h1>Title &amp; more</h1><p>One, two, three, and a long enough paragraph.<p>Second <b>bold</b>\n text,<br>after a break &#233;.<div id=comments><p>A reader, who has much to say, says it here.</div></article>"
    cases = [
        (1, None, ""), (2, "", ""), (3, f"<html><body>{nav}{body}<aside>related, stuff, here, more, and more</aside><footer>foot</footer>", "Title & more\nOne, two, three, and a long enough paragraph.\nSecond bold text, after a break é."),
        (4, "<p>short", "short"), (5, "<script>var a='<p>no</p>'</script><!-- <p>no --><style>p{}", ""), (6, "a &lt;b&gt; 1 < 2", "a <b> 1 < 2"),
        (7, "<div>" * 3000 + "deep enough to be scored as a paragraph, is it" + "</div>" * 2999, "deep enough to be scored as a paragraph, is it"),
    ]
    frame = spark.createDataFrame([(i, f"u{i}", h) for i, h, _ in cases] + [(None, None, "<p>x")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = {r["page_id"]: r for r in op2.extract(frame).collect()}
    assert {i: found[i]["text"] for i, _, _ in cases} == {i: t for i, _, t in cases} and found[None]["text"] == "x"
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
    pages = spark.read.parquet(f"{small}/pages.parquet")
    assert rows_of(op2.extract(pages), "page_id", "text") == sorted(((r["page_id"], article_of(r["html"])) for r in pages.collect()), key=repr)
    assert op2.extract(pages.limit(0)).count() == 0
    assert op2.extract(pages.union(pages)).count() == 2 * pages.count()


class _Article(HTMLParser):
    """Blocks of the article element by the standard library's parser: enough for the driver's pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.advert, self.text, self.blocks = False, 0, "", []

    def flush(self):
        if " ".join(self.text.split()):
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag == "br":
            self.text += " "
        elif tag in op2.BLOCKS:
            self.flush()
            if self.advert or dict(attrs).get("class") == "ad":
                self.advert += tag == "div"

    def handle_endtag(self, tag):
        if tag in op2.BLOCKS:
            self.flush()
            self.advert -= bool(self.advert) and tag == "div"
            self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside and not self.advert:
            self.text += data


def article_of(source):
    reader = _Article()
    reader.feed(source)
    reader.close()
    reader.flush()
    return "\n".join(reader.blocks)


def test_article_keeps_what_only_sounds_like_boilerplate():
    p = "<p>This is a paragraph, with commas, and enough text to be scored as one by the rules of the tree.</p>"
    line = re.sub("<.*?>", "", p)
    inside = "<div class='related-work'><p>Related work stays.</p></div><p class='search'>On search.</p><section id='search'>A section.</section><p class='share-price'>Prices.</p>"
    lists = "<ul><li><a href=1>source one</a><li><a href=2>source two</a></ul><p>the sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> of two</p>"
    gone = "<div class='share-buttons'>share this</div><p class='ad'>buy this</p><div id='comments'><p>a reader writes, at length, that this is so</p></div><div hidden>none</div>"
    kept = "Related work stays.\nOn search.\nA section.\nPrices.\nsource one\nsource two\nthe sum x+y of two"
    assert op2.main_text(f"<body><article>{p}{inside}{lists}{gone}</article><footer>foot</footer></body>") == f"{line}\n{kept}"
    beside = f"<div id=nav><a href=1>home</a></div><h1>Title</h1><h2>Under it</h2><div class=content>{p * 3}</div><h2>Related</h2><ul><li><a>z</a></ul>"
    assert op2.main_text(f"<body>{beside}</body>") == "\n".join(["Title", "Under it", line, line, line])
    # a container that mentions comments loses to an equal one that doesn't
    assert op2.main_text(f"<body><div class='old-comments-archive'>{p * 3}</div><div>{p * 3}</div></body>").count(line) == 3


def test_readers_and_notices_inside_the_article():
    p = "<p>This is a paragraph, with commas, and enough text to be scored as one by the rules of the tree.</p>"
    line, prose = re.sub("<.*?>", "", p), "Prices rose in March, as they had in May, and the ministry, which had said otherwise, now says that it will look at them again."
    reader = "<div class='user-comments-v2'><p>A reader writes, at length, that all of this is wrong, and that the paper should know it.</p></div>"
    letter = "<div class='wp-block-newsletter'><p>Sign up, and get our stories every day.</p></div>"
    assert op2.main_text(f"<body><article>{p * 3}{letter}{p * 2}{reader}</article></body>") == "\n".join([line] * 5)
    assert op2.main_text(f"<body><article>{p}<p class=ads>{prose}</p><p id=notice>{prose}</p><p class=ad>buy this, now, and cheap</p></article></body>") == f"{line}\n{prose}\n{prose}"
    parts = f"<div class=part>{p * 3}</div><div class=part><p>Short.</p></div><h2>Next</h2><div class=part>{p * 3}</div><div><a href=1>more</a></div>"
    assert op2.main_text(f"<body><div>{parts}</div><footer>x</footer></body>") == "\n".join([line] * 3 + ["Short.", "Next"] + [line] * 3)
    # an article on comments, in a container of that name
    assert op2.main_text(f"<body><div class='the-comments-debate'>{p * 20}</div></body>") == "\n".join([line] * 20)


def test_generated_layouts():
    """Pages of nested div layouts whose article is known: its blocks come back, and nothing else."""
    rng = np.random.default_rng(8)
    sentence = lambda n: " ".join(f"w{x}" + ("," if x % 5 == 0 else "") for x in rng.integers(0, 500, n).tolist()) + "."
    for number in range(60):
        blocks, body = [f"Title {number}"], f"<h1>Title {number}</h1>"
        for k in range(int(rng.integers(3, 9))):
            if k and rng.random() < 0.3:
                blocks.append(f"Part {k}")
                body += f"<h2>Part {k}</h2>"
            text = sentence(int(rng.integers(20, 60)))
            blocks.append(text)
            body += f"<p>{text}</p>" if rng.random() < 0.8 else f"<blockquote>{text}</blockquote>"
        links = "".join(f"<li><a href=/{k}>section {k}</a></li>" for k in range(6))
        comments = "".join(f"<div class=comment><p>{sentence(12)}</p></div>" for _ in range(int(rng.integers(0, 5))))
        kind = ("article", "main", "div", "section")[number % 4]
        inner = f"<{kind} class=story>{body}</{kind}>"
        for _ in range(int(rng.integers(0, 3))):
            inner = f"<div>{inner}</div>"
        side = f"<div class=sidebar><ul>{links}</ul><p>{sentence(8)}</p></div>"
        page = f"<html><head><title>x</title></head><body><header><p>{sentence(6)}</p></header><nav><ul>{links}</ul></nav><div class=layout>{side if number % 2 else ''}{inner}{'' if number % 2 else side}</div><div id=comments>{comments}</div><div class='cookie-banner'><p>{sentence(15)}</p></div><footer><p>{sentence(9)}</p></footer><script>var x='<p>no</p>'</script></body></html>"
        assert op2.main_text(page) == "\n".join(blocks), number


@pytest.mark.parametrize("piece", ['<a x="', '<a ">"<a "', "<a x='\">", '<li class="', "<!--", "<b>", "<", "</", "<script>"])
def test_hostile_pages_take_one_pass(piece):
    began = time.process_time()
    op2.main_text(piece * (1_000_000 // len(piece)) + "<p>an end, with some text to it</p>")
    assert time.process_time() - began < 6


# ---- 3


def test_sampled_segmentations_match_their_distribution():
    n = 6000
    batch = pa.record_batch({"doc_id": pa.array(range(n)), "text": pa.array(["the cat"] * n)})
    found = pa.Table.from_batches(list(op3._sampler(PIECES, 2, 0.5, 7, ("ids",))([batch]))).to_pylist()
    p, first, either, weight = {}, Counter(), Counter(), defaultdict(float)
    for r in found:
        key = tuple(r["ids"])
        p[key] = math.exp(r["log_prob"])
        first[key] += r["sample"] == 0
        either[key] += 1
        weight[key] += math.exp(-r["inclusion"])
    for key in sorted(p, key=p.get)[-4:]:
        assert first[key] / n == pytest.approx(p[key], abs=4 * math.sqrt(p[key] / n))
        exact = p[key] + sum(p[o] * p[key] / (1 - p[o]) for o in p if o != key)
        assert either[key] / n == pytest.approx(exact, abs=0.03)
        assert weight[key] / n == pytest.approx(1, abs=0.1)  # unbiased by inclusion score
    seen = defaultdict(set)
    for r in found:
        seen[r["doc_id"]].add(tuple(r["ids"]))
    assert all(len(x) == 2 for x in seen.values())


def test_all_segmentations_come_once():
    batch = pa.record_batch({"doc_id": pa.array([1, 2]), "text": pa.array(["ab", ""])})
    found = pa.Table.from_batches(list(op3._sampler(PIECES, 500, 0.5, 3, ("ids", "text"))([batch]))).to_pylist()
    own = [r for r in found if r["doc_id"] == 1]
    assert len({tuple(r["ids"]) for r in own}) == len(own) and sum(math.exp(r["log_prob"]) for r in own) == pytest.approx(1)
    assert {r["text"] for r in own} == {"ab"} and all(r["inclusion"] == 0 for r in own)
    assert [r["perturbed"] for r in sorted(own, key=lambda r: r["sample"])] == sorted((r["perturbed"] for r in own), reverse=True)
    assert [(r["ids"], r["log_prob"]) for r in found if r["doc_id"] == 2] == [([], 0.0)]


def test_long_paths_branch_anywhere():
    """Samples past the first nodes come from the shared bound of later nodes."""
    batch = pa.record_batch({"doc_id": pa.array([5]), "text": pa.array(["alpha beta gamma " * 4])})
    found = pa.Table.from_batches(list(op3._sampler(PIECES, 300, 3.0, 3, ("ids", "same"))([batch]))).to_pylist()
    assert len({tuple(r["ids"]) for r in found}) == 300 and all(r["same"] for r in found)


def test_samples_decode_back(odd, spark, small):
    for frame in both(odd, spark, small):
        found = op3.sample_encode(frame, PIECES, k=3, wanted=("ids", "same"))
        assert found.where("not same").count() == 0
        texts = op3.decode_ids(found.select("doc_id", "ids"), PIECES)
        assert {(r["doc_id"], r["text"]) for r in texts.collect()} == {(r["doc_id"], r["text"] or "") for r in frame.collect()}
        again = op3.sample_encode(frame.repartition(3), PIECES, k=3, wanted=("ids", "same"))
        assert rows_of(again, "doc_id", "sample", "ids") == rows_of(found, "doc_id", "sample", "ids")
    assert op3.sample_encode(odd.limit(0), PIECES).count() == 0


# ---- 4


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for size in (0, 1, 7, 511, 512, 513, 5000):
        for depth in (1, 9, 16, 20):
            values = rng.integers(0, min(1 << depth, 700), size)
            matrix = unpack(pack(WaveletMatrix.build(values, depth), np.array([4]), np.array([True]), np.array([size]), 0, 0))[0]
            assert np.array_equal(matrix.tokens(), values)
            if not size:
                assert matrix.count(0) == 0 and matrix.select(0, 0) == -1 and not len(matrix.occurrences(0))
                continue
            at = rng.integers(0, size, 50)
            assert np.array_equal(matrix.access(at), values[at])
            for token in {*values[:3].tolist(), (1 << depth) - 1}:
                places = np.flatnonzero(values == token)
                assert matrix.count(token) == len(places) and np.array_equal(matrix.occurrences(token), places)
                assert matrix.rank(token, size // 2) == (places < size // 2).sum()
                assert [matrix.select(token, k) for k in range(min(3, len(places)))] == places[:3].tolist()
                assert matrix.select(token, len(places)) == -1


def test_token_shards(odd, spark, small):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    for frame in both(odd, spark, small):
        path = work_path(spark, "test-wavelet")
        op4.write_shards(frame, WORDS, path)
        docs = sorted(((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
        expected, start, quotes = [], 0, Counter()
        for doc_id, text in docs:
            ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
            expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            start += len(ids)
            quotes[doc_id] += ids.count(320)
        assert rows_of(op4.read_shards(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)
        assert {r["doc_id"]: r["count"] for r in op4.find_token(spark, path, 320).groupBy("doc_id").count().collect()} == {k: v for k, v in quotes.items() if v}
    path = work_path(spark, "test-wavelet")
    op4.write_shards(odd.limit(0), WORDS, path)
    assert op4.read_shards(spark, path).count() == 0


# ---- 5


def brute_repeats(docs, length):
    first, out = {}, []
    for doc_id, text in docs:
        words = SPACE.findall(text or "")
        if doc_id is not None:
            for s in range(len(words) - length + 1):
                key = tuple(words[s : s + length])
                first[key] = min(first.get(key, doc_id), doc_id)
    for doc_id, text in docs:
        words = SPACE.findall(text or "")
        gone = set()
        for s in range(len(words) - length + 1):
            if doc_id is not None and first[tuple(words[s : s + length])] < doc_id:
                gone |= set(range(s, s + length))
        out.append((doc_id, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [10, 50])
def test_repeats(odd, spark, small, length):
    for frame in both(odd, spark, small):
        docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
        assert rows_of(op5.drop_repeats(frame, length), "doc_id", "n_words", "n_removed", "kept_text") == brute_repeats(docs, length)
    assert op5.drop_repeats(odd.limit(0)).count() == 0


def test_repeats_of_few_words(spark):
    rng = np.random.default_rng(2)
    docs = [(int(i), " ".join(rng.choice(["a", "b"], rng.integers(0, 60)))) for i in rng.permutation(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(op5.drop_repeats(frame, 10), "doc_id", "n_words", "n_removed", "kept_text") == brute_repeats(docs, 10)


# ---- 6


def brute_hits(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        size = min(10, len(words))
        for s in range(len(words) - size + 1) if size and item is not None else ():
            windows[tuple(words[s : s + size])].add(str(item))
    out = []
    for doc_id, text in docs:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, mine = set(), set()
        for size in {len(w) for w in windows}:
            for s in range(len(words) - size + 1):
                if found := windows.get(tuple(words[s : s + size])):
                    hit |= set(range(s, s + size))
                    mine |= found
        out.append((doc_id, len(words), len(hit), sorted(mine)))
    return sorted(out, key=repr)


def test_hits(odd, spark, small, monkeypatch):
    items = [(1, "A b c d e f g h i j"), (2, "x"), (3, None), (4, "..."), (None, "w1 w2 w3"), (5, "w10 w11 w12 w13 W14 w15 w16 w17 w18 w19 w20 w21"), (5, "w10 w11 w12 w13 W14 w15 w16 w17 w18 w19 w20 w21"), (30, "Und und UND und und und und und und und und"), (200, "ÀÉ naïve café"), (7, "never seen words")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("clash"))
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    columns = ("doc_id", "n_words", "n_hit", "items")
    assert rows_of(op6.decontaminate(odd, bench), *columns) == brute_hits(docs, items)
    monkeypatch.setattr(op6, "BLOCK_CHARS", 200)  # several blocks
    assert rows_of(op6.decontaminate(odd, bench), *columns) == brute_hits(docs, items)
    monkeypatch.undo()
    frame, bench2 = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    assert rows_of(op6.decontaminate(frame, bench2), *columns) == brute_hits([(r["doc_id"], r["text"]) for r in frame.collect()], [tuple(r) for r in bench2.select("item_id", "text").collect()])
    assert op6.decontaminate(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert op6.decontaminate(odd.limit(0), bench).count() == 0


def test_proximity(odd):
    found = rows_of(op6.proximity_matches(odd, "w10 w14 W12", 4), "doc_id", "position")
    assert (0, 10) in found or (0, 12) in found or (0, 14) in found
    assert not rows_of(op6.proximity_matches(odd, "w10 absent", 4), "doc_id", "position")


# ---- 7


def brute_kneser_ney(texts):
    """Log probability of each byte n-gram by the textbook recursion."""
    n = op7.ORDER
    grams = Counter(bytes(n - 1) [len(bytes(n - 1)) :] + (bytes(n - 1) + t.encode())[i : i + n] for t in texts for i in range(len(t.encode())))
    counts = {n: grams}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k in counts:
        of = Counter(counts[k].values())
        n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            discount[k] = [0.5] * 3
            continue
        y = n1 / (n1 + 2 * n2)
        discount[k] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]
    context = {k: defaultdict(list) for k in counts}
    for k in counts:
        for g, c in counts[k].items():
            context[k][g[:-1]].append(c)

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / 256
        own = context[len(g)].get(g[:-1])
        if not own:
            return below
        d = lambda c: discount[len(g)][min(c, 3) - 1]
        c = counts[len(g)].get(g, 0)
        return ((c - d(c)) / sum(own) if c else 0.0) + sum(map(d, own)) / sum(own) * below

    return p


@pytest.mark.parametrize("hot", [1 << 17, 300, 0])
def test_entropy(odd, labels, hot, monkeypatch):
    monkeypatch.setattr(op7, "HOT", hot)
    monkeypatch.setattr(op7, "MERGED", 100)
    docs = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    found = op7.score(odd, labels).collect()
    held = {r["doc_id"] for r in found if r["held"]}
    assert {r["doc_id"] for r in found if r["trusted"]} == {0, 1, 6} and held < {0, 1, 6}
    p = brute_kneser_ney([t for d, t in docs if d in {0, 1, 6} - held])
    expected, cache = [], {}
    for doc_id, text in docs:
        size = len(text.encode())
        body = bytes(op7.ORDER - 1) + text.encode()
        total = rare = 0
        for i in range(size):
            g = body[i : i + op7.ORDER]
            if g not in cache:
                cache[g] = round(math.log(p(g)) * op7.MICRO)
            total += cache[g]
            rare += cache[g] < -op7.SURPRISE * op7.MICRO
        expected.append((doc_id, -total / max(size, 1), rare * 1_000_000 / (size + op7.RATE_BYTES)))
    order = lambda r: (str(r[0]), r[1])
    got = sorted(((r["doc_id"], r["entropy"], r["rare_rate"]) for r in found), key=order)
    assert len(got) == len(expected)
    for (a, x, m), (b, y, n) in zip(got, sorted(expected, key=order), strict=True):
        assert a == b and x == pytest.approx(y, abs=3) and m == pytest.approx(n, abs=1)


def brute_bounds(rows):
    """Bounds by sorted lists of held-out values, in bins of 1,000 and 10."""

    def quantile(values, q, width):
        ordered = sorted(v // width * width for v in values)
        return ordered[max(math.ceil(q * len(ordered)), 1) - 1]

    of = defaultdict(list)
    for r in rows:
        if r["held"] and r["n_bytes"]:
            of[r["lang"] or "?"].append(r)
            of["*"].append(r)
    found = {}
    for lang, x in of.items():
        if len(x) >= op7.MIN_TRUSTED:
            entropy, rate = [r["entropy"] for r in x], [r["rare_rate"] for r in x]
            found[lang] = (quantile(entropy, op7.LOW, 1_000), quantile(entropy, op7.HIGH, 1_000) + 1_000, quantile(rate, op7.RARE_HIGH, 10) + 10)
    return found


def test_classifier(odd, labels, spark, small):
    assert op7.classify(odd, labels).count() == odd.count()
    assert op7.classify(odd, labels.limit(0)).where("n_bytes > 0 and not kept").count() == 0
    assert op7.classify(odd.limit(0), labels).count() == 0
    docs, marks = (spark.read.parquet(f"{small}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = op7.classify(docs, marks).collect()
    limits = brute_bounds(found)
    for r in found:
        low, high, rare = limits.get(r["lang"], limits["*"])
        slack = op7.MARGIN_ROOT / math.sqrt(max(r["n_bytes"], 1))
        assert (r["low"], r["high"], r["rare_high"]) == (low, high, rare)
        assert r["kept"] == (r["n_bytes"] > 0 and low - slack <= r["entropy"] <= high + slack and r["rare_rate"] <= rare)
    kept, of = {r["doc_id"]: r["kept"] for r in found}, defaultdict(list)
    for r in marks.collect():
        of[r["quality"], r["toxic"]].append(kept[r["doc_id"]])
    share = {k: sum(v) / len(v) for k, v in of.items()}
    assert share[1, 0] > 0.95 and share[0, 0] < 0.1 and share[0, 1] < 0.25
    # of clean texts that the model was not fitted on, most stay
    unseen = [r["kept"] for r in found if r["held"]]
    assert sum(unseen) >= 0.9 * len(unseen)


# ---- 8


def brute_base(text):
    words = SPACE.findall(text or "")
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.search(line):
            copies += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), copies, len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def features(text, buckets):
    hashes = [_chain((w.encode(),)) for w in SPACE.findall(text or "")]
    words = [x.to_bytes(8, "little") for x in hashes]
    return [signed(x) % buckets for x in hashes], [buckets + signed(_chain(pair)) % op8.PAIR_BUCKETS for pair in zip(words, words[1:], strict=False)]


def _chain(parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p, seed)
    return seed


def test_rules(odd, labels, spark, small, monkeypatch):
    monkeypatch.setattr(op8, "WORD_BUCKETS", (1 << 10, 1 << 14))
    monkeypatch.setattr(op8, "PAIR_BUCKETS", 1 << 10)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for frame, marks in ((odd, labels), (spark.read.parquet(f"{small}/../sf0.01/documents.parquet"), spark.read.parquet(f"{small}/../sf0.01/labels.parquet"))):
        docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
        held = {r["trusted_id"]: r["held"] for r in op8._trusted(marks).collect()}
        assert set(held) == {r["doc_id"] for r in marks.collect() if r["doc_id"] is not None and r["quality"] == 1 and not r["toxic"]}
        b = op8.word_buckets(op8.feature_counts(op8._texts(frame), op8._fitted(op8._trusted(marks))))
        raw, target, of = Counter(), Counter(), [features(t, b) for _, t in docs]
        for (d, _), f in zip(docs, of, strict=True):
            raw.update(f[0] + f[1])
            target.update(f[0] + f[1] if held.get(d) is False else [])
        size = b + op8.PAIR_BUCKETS
        shift = math.log(sum(raw.values()) + size) - math.log(sum(target.values()) + size)
        weight = [round(op8.MICRO * (math.log(target[k] + 1) - math.log(raw[k] + 1) + shift)) for k in range(size)]
        expected = []
        for (d, t), (single, pairs) in zip(docs, of, strict=True):
            low = sum(weight[k] <= op8.LOW_WEIGHT for k in single) * 1_000_000 // (len(single) + op8.RATE_WORDS)
            expected.append((d, *brute_base(t), sum(weight[k] for k in single + pairs) // max(len(single + pairs), 1), low))
        expected.sort(key=repr)
        found = op8.score_documents(frame, marks)
        got = rows_of(found, *columns, "score", "low_rate", "kept")
        assert [r[:-3] for r in got] == [r[:-2] for r in expected]
        assert all(abs(x[-3] - y[-2]) <= 1 and x[-2] == y[-1] for x, y in zip(got, expected, strict=True))
        passing = [r for r in got if not r[6]]
        own = [r for r in passing if held.get(r[0])]
        if len(own) < op8.MIN_HELD:
            assert all(r[-1] for r in passing)
        else:
            least = sorted(r[-3] // 1_000 for r in own)[int(op8.REJECT_SCORE * len(own))] * 1_000
            most = sorted(r[-2] // 100 for r in own)[int((1 - op8.REJECT_LOW) * len(own))] * 100 + 100
            assert all(r[-1] == (r[-3] >= least and r[-2] <= most) for r in passing)
        assert not any(r[-1] for r in got if r[6])
    assert op8.score_documents(odd, labels.limit(0)).where("kept = base_failed").count() == 0
    assert op8.score_documents(odd.limit(0), labels).count() == 0


# ---- 9


@pytest.mark.parametrize("block", [1 << 18, 64, 7])
def test_token_counts(odd, spark, small, block, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(op9, "BLOCK_TOKENS", block)
    monkeypatch.setattr(op9, "FILE_TOKENS", 1 << 23 if block == 64 else 100 * block)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for frame in both(odd, spark, small) if block > 7 else (odd.where("doc_id <> 6 and doc_id <> 14"),):
        path = work_path(spark, "test-flat")
        found = op9.token_counts(frame, PIECES, path)
        docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
        expected, start = [], 0
        for k, (_, text) in enumerate(docs):
            n = len(model.encode(text or "")) + 1
            expected.append((docs[k][0], k, start, n))
            start += n
        assert rows_of(found, "doc_id", "doc_no", "start", "n_tokens") == sorted(expected, key=repr)
    assert op9.token_counts(odd.limit(0), PIECES, work_path(spark, "test-flat")).count() == 0


# ---- 10


def fingerprint(text):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Smallest id reachable over links of three bits."""
    ids = sorted(prints, key=lambda x: (x[0] is None, x[0] or 0))
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (ids[i][1] ^ ids[j][1]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return sorted(((d, f, ids[find(k)][0]) for k, (d, f) in enumerate(ids)), key=repr)


def test_simhash(odd, spark, small):
    for frame in both(odd, spark, small):
        prints = [(r["doc_id"], fingerprint(r["text"])) for r in frame.collect()]
        found = op10.near_duplicates(frame)
        assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in found.collect()), key=repr) == sorted(groups(prints), key=repr)
    assert op10.near_duplicates(odd.limit(0)).count() == 0
    assert op10.near_duplicates(odd.where("doc_id is null")).first()["component_id"] is None


def test_a_row_without_id_links(spark, monkeypatch):
    """It joins what lies on either side of it."""
    frame = spark.createDataFrame([(1, 7, 0), (None, 8, 0b111), (2, 9, 0b111111), (None, 5, 255 << 40)], "doc_id long, tk long, fp long")
    monkeypatch.setattr(op10, "fingerprints", lambda _: frame)
    assert rows_of(op10.near_duplicates(frame), "doc_id", "fp", "component_id") == sorted([(1, 0, 1), (None, 7, 1), (2, 63, 1), (None, 255 << 40, None)], key=repr)
    assert rows_of(op10.later_copies(frame), "doc_id", "tk") == sorted([(None, 8), (2, 9)], key=repr)


def test_dense_groups_of_fingerprints(spark, monkeypatch):
    """Hot cells, cut into blocks, connect what all pairs connect."""
    rng = np.random.default_rng(4)
    values = {0}
    for base in rng.integers(0, 1 << 62, 6).tolist():
        for _ in range(60):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            values.add(x)
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    frame = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in rows], "rep long, fp long")
    expected = {d: c for d, _, c in groups(rows)}
    for hot, block in ((2_000, 1_024), (3, 8)):
        monkeypatch.setattr(op10, "HOT_PAIRS", hot)
        monkeypatch.setattr(op10, "BLOCK", block)
        found = {r["node"]: r["component"] for r in connected_components(op10.links(frame), "a", "b").collect()}
        assert {i: found.get(i, i) for i, _ in rows} == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (60, 50), (70, 60), (50, 70)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in found} == {i: 0 for i in range(41)} | {100: 100, 50: 50, 60: 50, 70: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_returns_every_row(spark, small, name):
    table = {"op2_html": "pages", "op11_heap_lloyd": "embeddings", "op13_ranked": "benchmark"}.get(name, "documents")
    n = spark.read.parquet(f"{small}/{table}.parquet").count()
    found = queries.QUERIES[name](spark, small)
    if name == "op13_ranked":
        assert found.select("item_id", "rank").distinct().count() == found.count() == 20 * n
        return
    assert (found.select("doc_id").distinct() if name == "op3_sentencepiece" else found).count() == n
    if name == "op5_substring":
        assert found.where(F.col("n_removed") == 0).count() > 0
    if name == "op6_decontaminate":
        assert found.where("n_items = 0").select("items_sha256").distinct().first()[0] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, small, name):
    import duckdb

    duck = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        duck.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    answer = duck.sql(queries.ORACLES[name])
    columns = sorted(answer.columns)
    frame = queries.QUERIES[name](spark, small)
    assert sorted(frame.columns) == columns
    place = [answer.columns.index(c) for c in columns]
    assert rows_of(frame, *columns) == sorted((tuple(row[i] for i in place) for row in answer.fetchall()), key=repr)
