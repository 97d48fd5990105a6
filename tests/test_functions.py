from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwood.functions import chunking, model_text, readable, routing, scoring, similar, text, url


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_canonical_url(spark):
    raw = "HTTPS://Example.com:443/a/b/?utm_source=x&b=2&a=1#section"
    assert url.canonical(raw) == "https://example.com/a/b?a=1&b=2"
    assert url.canonical("http://example.com:99999/") == ""
    assert url.canonical("ftp://example.com/") == "" and url.canonical(None) == ""
    hard = ["http://a.b/", "https://m.example.com/x/?b=2&a=1&ref=z#f", "//Example.com", "http://a.b/x?b&c=1&d=", "https://e.com/a%20b", "https://e.com/über", "https://e.com/?q=a+b", "https://e.com:443/", "https://e.com:8080/x", "https://e.com:0/x", "https://e.com:/x"]
    hard += ["http://u:p@e.com/x", "http://e.com/%zz", "http://e.com/%E9", "http://[::1]:80/x", "http://[bad/x", "http://münchen.de/ü", "https://e.com/?a=b=c", "https://e.com/a//b//", "http://e.com./x", "https://e.com/?a=%26&b=%3D+", "HTTP://E.COM/A;p=1?x=~*", "http://e.com/a b", "mailto:x@e.com", "http:///x", "http://e.com:65536/", "https://e.com/?=v&k=", "  http://e.com/x  ", "http://e.com/?UTM_Source=x&From=y&q=1", "http://e.com?a=1#b?c=2", "http://e.com/日本?k=語", "http://e\x00.com/", "http://e.com/x\ny"]
    got = {r["u"]: r["c"] for r in spark.createDataFrame([(u,) for u in hard], "u string").select("u", url.canonical_url(F.col("u")).alias("c")).collect()}
    assert got == {u: url.canonical(u) for u in hard}
    assert one(spark, url.canonical_url(F.lit(raw))) == "https://example.com/a/b?a=1&b=2"
    assert one(spark, url.canonical_url(F.lit(None).cast("string"))) == ""


@given(st.from_regex(r"https?://(m\.|www\.)?[a-z]{1,8}\.(com|org)(/[a-z0-9]{0,4}){0,3}/?(\?[a-z]{1,3}=[0-9a-z]{0,3}(&[a-z]{1,3}=[0-9]{1,3})?)?(#[a-z]*)?", fullmatch=True))
@settings(max_examples=200, deadline=None)
def test_canonical_is_idempotent(raw):
    assert url.canonical(url.canonical(raw)) == url.canonical(raw)


def test_image_urls(spark):
    good = ["https://x.com/a/photo.jpg", "https://x.com/image?id=3"]
    bad = ["https://x.com/a.js", "https://x.com/a.css", "https://x.com/f.woff2", "https://x.com/a.ico", "https://x.com/a.svg", "https://x.com/bgr_1.png", "https://x.com/channel_tag/a.jpg", "data:image/png;base64,x"]
    for u, want in [(u, True) for u in good] + [(u, False) for u in bad]:
        assert readable.valid_image(u) is want
        assert one(spark, url.valid_image_url(F.lit(u))) is want


HTML = """<html lang="en"><head><title>Page - Site</title><meta property="og:title" content="Big story - Site"><meta property="og:site_name" content="Site">
<meta property="article:published_time" content="2024-01-02"><meta property="og:image" content="/img/p.jpg"></head><body><nav>Home Menu</nav><article class="content"><h1>Big story</h1>
<p>{p}</p><p>{p}</p><p>{q}</p></article><aside>Related stuff here</aside><footer>Copyright</footer></body></html>"""


def test_article():
    p, q = "The first paragraph of the story says many things at some length. " * 4, "A second paragraph adds what the first one left out of the story. " * 4
    page = readable.read_html("https://example.com/x", HTML.format(p=p, q=q))
    assert page["title"] == "Big story" and page["site_name"] == "Site" and page["date_published"] == "2024-01-02" and page["language"] == "en"
    assert page["text"].count("The first paragraph") == 4 and "Related" not in page["text"] and "Home" not in page["text"]
    assert page["image_urls"] == ["https://example.com/img/p.jpg"] and page["fetch_status"] == "success"
    assert readable.read_html("https://example.com", "")["fetch_status"] == "empty_content"


def test_void_meta_outside_head_silences_what_follows():
    assert readable.read_html("https://e.com", "<body><meta name=a content=b><p>" + "Long text of a page. " * 20 + "</p></body>")["text"] == ""


def test_chunks():
    assert chunking.chunks("one two\n\nthree four\n\nfive", 140) == ["one two\n\nthree four\n\nfive"]
    words = chunking.chunks("word " * 100, 90)
    assert all(len(c) <= 90 for c in words)
    assert chunking.paragraphs("Open\nAI\nis\nhere\nnow\nfine") == ["Open AI is here now fine"]
    assert all(len(c) <= 70 for c in chunking.chunks("这是一个句子。" * 40, 70))
    assert chunking.chunks("", 100) == [] and chunking.chunks(None, 100) == []


@given(st.text(alphabet="abc .!?\n中", max_size=300), st.integers(10, 80))
@settings(max_examples=150, deadline=None)
def test_chunks_hold_only_what_the_text_holds(t, size):
    squeezed = "".join(c for c in t if c.isalnum())
    for c in chunking.chunks(t, size):
        assert c.strip() == c and c
    assert set("".join(chunking.chunks(t, size))) - set(" \n") <= set(t)
    if squeezed:
        assert chunking.chunks(t, size)


@given(st.lists(st.text(alphabet="ab", min_size=0, max_size=60), max_size=8), st.sampled_from([0.5, 0.8, 0.9, 0.96]))
@settings(max_examples=300, deadline=None)
def test_bounds_never_reject_a_match(strings, threshold):
    seen = similar.Seen(threshold)
    for i, s in enumerate(strings):
        want = any(similar.ratio(s, o) >= threshold or s == o for o in strings[:i])
        assert seen.like(s) == want
        seen.add(s)


def test_assignment_is_optimal():
    from itertools import permutations

    import numpy as np

    rng = np.random.default_rng(1)
    for shape in [(3, 3), (2, 4), (4, 2), (1, 5), (5, 5)] * 5:
        s = rng.normal(size=shape)
        got = model_text.assign(s)
        wide = s if shape[0] <= shape[1] else s.T
        best = max(sum(wide[i, p[i]] for i in range(len(wide))) for p in permutations(range(wide.shape[1]), len(wide)))
        assert len(got) == min(shape) and abs(sum(s[r, c] for r, c in got) - best) < 1e-9
    assert model_text.assign(np.zeros((0, 3))) == []


def test_router(spark):
    cases = {"": "EMPTY_QUERY", "hello!": "GREETING_OR_SMALLTALK", "what is in this image": "RAG_RISK_SIGNAL", "translate: bonjour tout le monde": "INLINE_TEXT_TRANSFORM", "summarize 'a b c d'": "INLINE_TEXT_SUMMARIZATION_OR_EXTRACTION", "write a haiku": "GENERAL_CREATIVE_GENERATION", "python loop": "GENERAL_CODE_TASK", "compute 3 + 4": "INLINE_MATH_TASK", "what is overfitting?": "GENERAL_CONCEPT_WHITELIST", "who won": "NO_HIGH_CONFIDENCE_RULE_MATCH", "linear regression": "RAG_RISK_SIGNAL"}
    rows = spark.createDataFrame([(k,) for k in cases], "q string").select("q", routing.route(F.col("q")).alias("r")).collect()
    assert {r["q"]: r["r"]["reason"] for r in rows} == cases
    assert one(spark, routing.route(F.lit(None).cast("string")))["reason"] == "EMPTY_QUERY"


def test_model_text(spark):
    found = model_text.candidates('x {"candidates": [{"name": "A", "confidence": 2, "aliases": ["a", "B", "B"]}, {"name": ""}, {"name": "Long", "confidence": "bad"}]} y')
    assert [c["name"] for c in found] == ["A", "Long"] and found[0]["confidence"] == 1.0 and found[0]["aliases"] == ["B"]
    assert one(spark, model_text.sufficiency(F.lit('t {"judge": "true"}')))["judgement"] == "YES"
    assert one(spark, model_text.sufficiency(F.lit("none"))) is None
    assert one(spark, model_text.judge_verdict(F.lit('{"label": "incorrect"}'))) is False


def test_scores(spark):
    assert one(spark, scoring.freshness(F.lit("2024-02-10").cast("timestamp"), "2024-02-15")) == 0.04
    assert one(spark, scoring.freshness(F.lit(None).cast("timestamp"), "2024-02-15")) == 0.0
    assert one(spark, scoring.source_reliability(F.lit("x.gov"), F.lit("/"), F.lit(None))) == 0.08
    assert one(spark, scoring.lexical_score(text.lexical_tokens(F.lit("a b")), text.lexical_tokens(F.lit("A c 中")))) == 0.75 / 2 + 0.25 / 3
    assert one(spark, text.listing_noise(F.lit("Latest news and trending"))) is True
    assert one(spark, text.text_signature(F.lit("Ab-c² 中!"))) == "abc²中"


def test_unreadable_dates_and_numbers(spark):
    assert one(spark, scoring.freshness(F.lit("Feb 3, 2024"), "2024-02-15 00:00:00")) == 0.0
    assert one(spark, scoring.freshness(F.lit("2024-02-10T08:00:00Z"), "2024-02-15 00:00:00")) == 0.04
    assert one(spark, text.safe_float(F.lit("1.5"))) == 1.5 and one(spark, text.safe_float(F.lit("x"))) == 0.0


def test_charsets():
    assert readable.decode_body("日本語のテキスト、ここにあります".encode("shift_jis")) == "日本語のテキスト、ここにあります"
    assert readable.decode_body("中文网页的内容在这里，很长的一段".encode("gb18030")) == "中文网页的内容在这里，很长的一段"
    assert readable.decode_body("déjà vu à côté".encode("cp1252")) == "déjà vu à côté" == readable.decode_body("déjà vu à côté".encode())
    assert readable.decode_body("words".encode("utf-16")) == "words" and readable.decode_body("é".encode("latin-1"), "text/html; charset=latin-1") == "é"
    assert readable.decode_body(b'<meta charset="nonsense">x').endswith("x")


def test_assignment_is_the_best_of_all():
    from itertools import permutations

    import numpy as np

    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (6, 6)):
        for _ in range(8):
            s = rng.normal(size=(n, m)).round(1)
            best = max(sum(s[r, c] for r, c in (zip(range(n), p) if n <= m else zip(p, range(m)))) for p in permutations(range(max(n, m)), min(n, m)))
            assert abs(sum(s[r, c] for r, c in model_text.assign(s)) - best) < 1e-9


def test_text_pages_equal_plain_rules():
    """Lines of every document: cleaned, without boilerplate, without those equal or alike to an earlier one by the plain ratio."""
    import difflib

    import pyarrow.parquet as pq

    from siftwood.functions import readable

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])
    compared = dropped = 0
    for text in table.column("text").to_pylist():
        kept, sigs = [], []
        for line in (text or "").splitlines():
            line = " ".join(line.split())
            sig = "".join(c for c in line if c.isalnum()).lower()[:1000]
            if not sig or readable.boilerplate(line) or sig in sigs:
                continue
            # equal lengths bound the ratio from above, so most lines need no comparison
            near = [s for s in sigs if min(len(s), len(sig)) >= 80 and 2 * min(len(s), len(sig)) >= 0.96 * (len(s) + len(sig))]
            compared += len(near)
            if any(difflib.SequenceMatcher(None, s, sig).ratio() >= 0.96 or difflib.SequenceMatcher(None, sig, s).ratio() >= 0.96 for s in near):
                dropped += 1
                continue
            kept.append(line)
            sigs.append(sig)
        assert readable.read_text("https://e.com/", text)["text"] == "\n\n".join(kept)
    assert compared > 100 and dropped > 0


def test_reaches_decides_as_the_whole_ratio_in_fewer_steps():
    import random
    from difflib import SequenceMatcher

    from siftwood.functions import similar

    rng, steps = random.Random(9), [0, 0]

    class Counted(SequenceMatcher):
        def find_longest_match(self, *a):
            steps[self.early] += 1
            return super().find_longest_match(*a)

    for trial in range(300):
        letters = rng.choice(("ab", "abcdefghijklmnopqrstuvwxyz0123456789"))
        old = "".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 90, 300, 800))))
        new = "".join(rng.choice(letters) if rng.random() < rng.choice((0.01, 0.05, 0.12)) else c for c in old)[rng.randrange(20) :]
        m = Counted(None, new, old)
        m.early = 1
        t = rng.choice((0.9, 0.92))
        got = similar.reaches(m, t)
        m.early = 0
        assert got == (m.ratio() >= t)
    assert steps[1] < steps[0]


def test_matcher_finds_the_matches_of_difflib():
    import random
    from difflib import SequenceMatcher

    from siftwood.functions.similar import Matcher, reaches

    rng, popular = random.Random(3), 0
    for trial in range(600):
        letters = rng.choice(("ab", "abcdefghijklmnopqrstuvwxyz0123456789", "^-]\\[ab", "eeeeeeeetttttaaaaooovvkq", "".join(chr(0x4E00 + i) for i in range(300))))
        b = "".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 90, 199, 200, 300, 1500))))
        a = "".join(rng.choice(letters) if rng.random() < rng.choice((0.01, 0.1, 0.5)) else c for c in b)[rng.randrange(20) :]
        plain, mine = SequenceMatcher(None, a, b), Matcher(b)
        mine.set_seq1(a)
        popular += bool(plain.bpopular)
        for _ in range(5):
            (alo, ahi), (blo, bhi) = (sorted(rng.randint(0, len(x)) for _ in range(2)) for x in (a, b))
            assert mine.find_longest_match(alo, ahi, blo, bhi) == tuple(plain.find_longest_match(alo, ahi, blo, bhi))
        assert reaches(mine, 0.9) == (plain.ratio() >= 0.9)
    assert popular > 100


def test_links_judge_each_pair_of_a_shared_bucket_once():
    import random
    from itertools import combinations

    import pyarrow as pa

    from siftwood.functions.similar import ratio
    from siftwood.operators.dedup import _links

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(150))] * 30
    texts = ["".join(rng.choice("xyz") if rng.random() < 0.04 else c for c in t) for t in texts] + ["".join(rng.choice("abcd") for _ in range(150)) for _ in range(10)]
    buckets = [sorted(rng.sample(range(40), rng.randrange(2, 25))) for _ in range(20)]
    held = {i: [(k, b[0]) for k, b in enumerate(buckets) if i in b] for i in range(40)}
    rows, want = [], {(x, y) for b in buckets for x, y in combinations(b, 2) if ratio(texts[y], texts[x]) >= 0.9}
    for low in sorted({b[0] for b in buckets}):  # two blocks by parity, so three units a leader
        for bi, bj in ((0, 0), (0, 1), (1, 1)):
            rows += [{"low": low, "bi": bi, "bj": bj, "id": i, "own": i % 2, "keys": [k for k, _ in held[i]], "lows": [x for _, x in held[i]], "s": texts[i]} for i in range(40) if i % 2 in (bi, bj) and any(x == low for _, x in held[i])]
    got = [(r["low"], r["id"]) for out in _links(pa.Table.from_pylist(rows).to_batches(max_chunksize=7), 0.9) for r in out.to_pylist()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_minhash_of_many_equals_each_alone_and_skips_null(spark):
    from siftwood.operators.dedup import _minhash

    rows = [(i, None if i % 7 == 3 else chr(97 + i % 26) * 5 + "é日" * (i % 40) + "".join(chr(97 + (i * k) % 23) for k in range(20 + i))) for i in range(100)]
    df = spark.createDataFrame(rows, "i long, s string").coalesce(1)
    many = {r["i"]: r["k"] for r in df.select("i", _minhash(F.col("s"), 4, 3, 8).alias("k")).collect()}
    alone = {r["i"]: r["k"] for r in df.repartition(50, "i").select("i", _minhash(F.col("s"), 4, 3, 8).alias("k")).collect()}
    assert many == alone and all(len(k) == (0 if s is None else 4) for (_, s), k in zip(rows, (many[i] for i, _ in rows)))
