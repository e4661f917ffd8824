"""Small tests of the operators against brute force, and of their defined results at the edges."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_words string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    base = " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(160))
    rows = []
    for i in range(n):
        kind = i % 6
        words = base.split()
        if kind == 0:
            text = " ".join(rng.choice(WORDS) + str(rng.randrange(2000)) for _ in range(rng.randrange(1, 200)))
        elif kind == 1:
            text = base
        elif kind == 2:
            for _ in range(rng.randrange(1, 12)):
                words[rng.randrange(len(words))] = "edited" + str(rng.randrange(999))
            text = " ".join(words)
        elif kind == 3:
            text = "own " + str(i) + "\n" + " ".join(words[30:110]) + "\nThe End Of This Shared Line\n" + " ".join(rng.choice(WORDS) for _ in range(30))
        elif kind == 4:
            text = "  The end of this shared line \nshort\nÜber die lange gemeinsame Zeile\n\t\n" + str(i)
        else:
            text = "über " * rng.randrange(60) + "\n über die lange gemeinsame zeile"
        rows.append((i, text, "en", f"src{i % 2}", "x"))
    return rows + [(900, None, None, None, None), (901, "", "en", None, "x"), (902, " \n ", "en", "src1", "x"), (None, base, "en", "src0", "x"), (903, "x" * 200_000, "en", "src0", "x"), (7, rows[7][1], "en", "src1", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_rules(spark, docs):
    from lociweave.llm.quality_rules import quality_rules, strip_frequent_lines

    got = defaultdict(list)
    for r in quality_rules(docs, min_docs=3, share=0.1).collect():
        got[r.doc_id].append(r)
    for i, text, _, _, _ in corpus():
        w = words(text)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {k + j for k, t in enumerate(tri) if tri.count(t) > 1 for j in range(3)}
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert any(r[0].n_lines_removed for r in got.values())
    assert strip_frequent_lines(docs, min_docs=3, share=0.1).columns == docs.columns
    assert quality_rules(empty(spark)).count() == 0


def test_line_dedup(spark, docs):
    from lociweave.llm.line_dedup import dedup_lines

    rows = corpus()
    holders = defaultdict(set)
    key = lambda line: lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(-1 if i is None else i)
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 3 and (-1 if i is None else i) < max(holders[key(x)]))]
        want = ("\n".join(kept), len(lines), len(lines) - len(kept))
        rows[rows.index((i, text, *_))] = (i, want)
    got = {(r.doc_id, (r.text, r.n_lines, r.n_dropped)) for r in dedup_lines(docs).collect()}
    assert got == {(i, w) for i, w in rows}
    assert dedup_lines(empty(spark)).count() == 0


def test_decontaminate(spark, docs):
    from lociweave.llm.decontaminate import mark_contamination

    rows = corpus()
    items = [(1, " ".join(rows[1][1].split()[20:45])), (2, "The End, of THIS!"), (3, None), (4, "..."), (10, "the end of this"), (5, "nothing here matches at all in any of the texts we have")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    for most in (8_000_000, 300):
        got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in mark_contamination(docs, bench, most_chars=most).collect()}
        want = set()
        for i, text, *_ in rows:
            w, hit, names = re.findall(pattern, lower(text)), set(), set()
            for item, t in items:
                b = re.findall(pattern, lower(t))
                n = min(10, len(b))
                for k in range(len(b) - n + 1 if n else 0):
                    for p in range(len(w) - n + 1):
                        if w[p : p + n] == b[k : k + n]:
                            hit.update(range(p, p + n))
                            names.add(str(item))
            want.add((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
        assert got == want
    spans = mark_contamination(docs, bench).filter("doc_id = 3").first()
    assert any(spans.text[s.start : s.end].startswith("The End Of This") for s in spans.hit_spans)
    assert mark_contamination(empty(spark), bench).count() == 0
    assert mark_contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_near_dedup(spark, docs):
    from lociweave.llm.near_dedup import near_duplicates

    rows = [r for r in corpus() if r[0] is not None]
    sets, own = {}, {}
    for i, text, *_ in rows:
        w = words(lower(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        own[i] = i
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and own[a] != own[b]:
                    own[a] = own[b] = min(own[a], own[b])
                    changed = True
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs.filter("doc_id is not null")).collect()}
    assert got == {(i, len(sets[i]), own[i], own[i] == i) for i in ids}
    assert near_duplicates(docs).filter("doc_id is null").first().kept
    assert near_duplicates(empty(spark)).count() == 0


def test_sketch_fills_and_estimates():
    import numpy as np

    from lociweave.llm.near_dedup import mix, sketch

    a = mix(np.arange(400, dtype=np.uint64))
    for n in (1, 2, 7, 400):
        assert (sketch(a[:n]) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    same = (sketch(a[:350], 9) == sketch(a[50:400], 9)).mean()
    assert abs(same - 300 / 400) < 0.08


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    from lociweave.llm.packing import divide, pack_documents, tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    rows = corpus() + [(950, "word " * 9000, "en", "s", "x"), (951, "<|endoftext|> it's  \U0001f600 42", "en", "s", "x")]
    frame = spark.createDataFrame([r for r in rows if r[0] not in (7, 903)], DOCS).repartition(2)
    pieces = pack_documents(frame).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
        assert len(p.ids) == p.length and p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids))
    for i, text, *_ in rows:
        if i in (7, 903):
            continue
        want = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by[i], key=lambda p: p.start)
        assert sum((p.ids for p in own), []) == want and all(p.doc_tokens == len(want) for p in own)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    rng = random.Random(3)
    sizes = [rng.randrange(1, 900) for _ in range(500)]
    bins = divide(sizes, 2048)
    assert sorted(sum(bins, [])) == list(range(500)) and len(bins) <= 1.03 * sum(sizes) / 2048 + 1
    for hard in ([1100] * 40, [2048] * 5 + [1] * 7, [700] * 100, [1], [1025, 1023, 1025, 1023]):
        bins = divide(hard, 2048)
        assert sorted(sum(bins, [])) == list(range(len(hard))) and all(0 < sum(hard[i] for i in b) <= 2048 for b in bins)
    assert len(divide([1100] * 40, 2048)) == 40 and len(divide([700] * 100, 2048)) == 50 and len(divide([1025, 1023] * 30, 2048)) == 30
    assert pack_documents(empty(spark)).count() == 0


def test_substring_dedup(spark, docs):
    from lociweave.llm.substring_dedup import dedup_substrings

    rows = corpus()
    first = {}
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - 49):
            t = tuple(w[k : k + 50])
            first[t] = min(first.get(t, 10**9), -1 if i is None else i)
    want = set()
    for i, text, *_ in rows:
        w = words(text)
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < (-1 if i is None else i) for j in range(50)}
        want.add((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = {(r.doc_id, r.n_words, r.n_removed, r.text) for r in dedup_substrings(docs).collect()}
    assert got == want
    assert dedup_substrings(empty(spark)).count() == 0


def test_quality_classifier(spark):
    from lociweave.llm.quality_classifier import fit, score_quality

    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(60))
    rows = [(i, bad() if i % 3 == 0 else good(), None, None, None) for i in range(300)]
    docs = spark.createDataFrame([*rows, (1000, None, None, None, None), (1001, "", None, None, None), (None, good(), None, None, None)], DOCS)
    labels = spark.createDataFrame([*((i, int(i % 3 > 0), 0) for i in range(300)), (None, 1, 0), (5, None, 0), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in score_quality(docs, fit(docs, labels)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(out[i].predicted == int(i % 3 > 0) for i in held)
    assert 0 < out[1000].score < 1 and out[1000].score == out[1001].score
    assert score_quality(docs, fit(docs, labels.limit(0))).filter("score = 0.5").count() == docs.count()
    assert score_quality(docs.limit(0), fit(docs, labels)).count() == 0


def test_license_scan(spark):
    from lociweave.llm.license_scan import BASE, rules, scan_licenses

    rng = random.Random(1)
    bits = ["mit license", "MIT License", "apache", "license", "gnu general public", "Gnu General-Public  License", "cc", "by", "cc-by", "nc 4.0", "bär", "version 3", "or later", "apache license, version 2.0", "permit", "bsd 3-clause license"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(14)))) for i in range(150)] + [(900, None), (901, ""), (902, " \n"), (903, "mit license mit license")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(j, label) for phrase, label in BASE for j in range(len(w)) if w[j : j + len(phrase.split())] == phrase.split()]
        s = f" {' '.join(w)} "
        spans = [(m.start(), m.end(), k, r) for k, r in enumerate(rules()) for m in re.finditer(r[2], s)]
        beats = lambda y, x: y[0] <= x[0] and y[1] >= x[1] and (y[3][3], y[1] - y[0], -y[2]) > (x[3][3], x[1] - x[0], -x[2])
        left = [x for x in spans if not any(beats(y, x) for y in spans)]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert r.labels == ",".join(sorted({x for _, x in places} | {x[3][0] for x in left}))
        assert 0 <= r.score <= 1 and len(r.detections) == len(left)
    assert len(rules()) > 300


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><script>var t="</p><article>no</article>";</script></head><body><nav><ul><li><a href="/x">Menu {i}</a></li></ul></nav>
<div class="ad">Buy {i}</div><div id="cookie-notice">We use cookies</div><article><h1>Title {i}</h1><p><b>First&nbsp;&amp; {i}<br><p>Sec<i>ond</i>  line
 {i}</p>{more}<aside>Related</aside><form><p>Sign up</p></form></article><div class="comments"><p>Nice post</p></div><footer>&copy; site</footer>"""


def test_html_extract(spark):
    from lociweave.llm.html_extract import extract_pages, infer

    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(i=i, more="<p>More</p>" * (i % 4)), "x") for i in range(12)]
    rows += [(100, "http://h0.example.com/n", None, "x"), (101, None, "<p>only</p> text", "x"), (102, "http://h1.example.com/e", "", "x"), (103, "http://h0.example.com/o", "<body><main><p>other</p></main></body>", "x"), (104, "http://h0.example.com/b", "<article><p>broken &lt;", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for most in (32 << 20, 0):
        got = {r.page_id: r for r in extract_pages(pages, most_bytes=most).collect()}
        for i in range(12):
            assert got[i].text == "\n".join([f"Title {i}", f"First & {i}", f"Second line {i}", *["More"] * (i % 4)])
            assert got[i].n_chars == len(got[i].text)
        assert [got[i].text for i in (100, 101, 102, 103, 104)] == ["", "only\ntext", "", "other", "broken <"]
    wrapper = infer([r[2] for r in rows[:6]])
    assert wrapper["path"] == "html/body/article" and "+" in wrapper["expression"] and "?" in wrapper["expression"]
    assert extract_pages(pages.limit(0)).count() == 0


def test_pii(spark):
    from lociweave.llm.pii import feistel, luhn, mask_documents, pseudonymise

    key = b"k"
    assert sorted(feistel(v, 1000, key) for v in range(1000)) == list(range(1000))
    assert all(feistel(feistel(v, 997, key), 997, key, back=True) == v for v in range(997))
    text = "Card 4111 1111 1111 1111, again 4111111111111111; bad 4111111111111112. Mail A.b@Mail.example.com and a.b@mail.example.com. 10.1.2.3 not 10.1.2.300; +1 (017) 555-7713 170.106.47.218; born 1980-02-29 or February 29, 1980; 13/13/2000; SSN 123-45-6789."
    new, counts = pseudonymise(text, key)
    assert counts == {"card": 2, "email": 2, "ip": 2, "phone": 1, "date": 2, "ssn": 1}
    assert "4111111111111112" in new and "10.1.2.300" in new and "13/13/2000" in new
    for gone in ("4111111111111111", "1111 1111", "example.com", "10.1.2.3 ", "555-7713", "1980-02-29", "123-45-6789"):
        assert gone not in new
    cards = re.findall(r"(?:\d{4} ){3}\d{4}|\d{16}", new)
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[1])
    mails = re.findall(r"\S+@\S+?\.invalid", new)
    assert mails[0] == mails[1]
    rows = [(1, text), (2, None), (3, ""), (4, text), (None, "no numbers")]
    got = mask_documents(spark.createDataFrame(rows, "doc_id long, text string"), key).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].text == by[4].text == new and by[1].n_pii == 10 and by[2].text is None and by[3].text == "" and by[None].n_pii == 0
    assert mask_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pii_iban_before_words():
    from lociweave.llm.pii import _iban_number, pseudonymise

    def valid(s):
        return _iban_number(s[4:] + s[:4]) % 97 == 1

    plain = "BE68539007547034"
    pseudonym = pseudonymise(plain, b"k")[0]
    assert pseudonym != plain and valid(pseudonym)
    for iban, rest in (("BE68 5390 0754 7034", " EUR 100"), (plain, " EUR"), (plain, " A 2024 EUROS"), ("AT61 1904 3002 3457 3201", " USD"), ("ES91 2100 0418 4502 0005 1332", " OK."), ("NO9386011117947", " NOK")):
        new, counts = pseudonymise(iban + rest, b"k")
        got = new[: len(iban)]
        assert counts == {"iban": 1} and new == got + rest and got != iban and valid(got.replace(" ", ""))
        assert iban[:2] != "BE" or got.replace(" ", "") == pseudonym
    # what was taken with a number, or with one that isn't valid, is searched as well
    new, counts = pseudonymise("BE68539007547034 4111 1111 1111 1111 and REF DE12 4111 1111 1111 1111", b"k")
    assert counts == {"iban": 1, "card": 2} and "4111" not in new
    assert pseudonymise("BE68 5390 0754 7035 EUR", b"k") == ("BE68 5390 0754 7035 EUR", {})


def _extracted(spark, htmls, most=32 << 20):
    from lociweave.llm.html_extract import extract_pages

    pages = spark.createDataFrame([(i, f"http://one.example.com/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r.text for r in sorted(extract_pages(pages, most_bytes=most).collect(), key=lambda r: r.page_id)]


def test_html_constants_inside_the_container(spark):
    page = "<body><div><h1>Title {i}</h1><p>Of {i} there is much to be told here.</p>{more}<p>Read on with our <b>letter</b></p><p>yes</p></div></body>"
    htmls = [page.format(i=i, more="<p>yes</p>" * (i % 3) + "<ul><li>Point</li></ul>" * (i == 5)) for i in range(12)]
    for most in (32 << 20, 0):
        for i, text in enumerate(_extracted(spark, htmls, most)):
            assert text == "\n".join([f"Title {i}", f"Of {i} there is much to be told here.", *["yes"] * (i % 3), *["Point"] * (i == 5), "yes"])
    # an article that was fetched several times isn't a template
    same = [f"<body><div><h1>Title</h1><p>All the words of the same article.</p><p>{i} views</p></div></body>" for i in range(5)]
    assert _extracted(spark, same) == [f"Title\nAll the words of the same article.\n{i} views" for i in range(5)]
    assert _extracted(spark, same[:1] * 5) == ["Title\nAll the words of the same article.\n0 views"] * 5


def test_html_container_of_every_template(spark):
    long = "word {i} " * 30
    htmls = [f"<body><div><h1>Title {i}</h1><p>Short {i}</p><div><p>{long.format(i=i).strip()}</p></div></div></body>" for i in range(30)]
    htmls.append("<body><div>promo</div><section><article><p>The article of another template.</p></article></section></body>")
    got = _extracted(spark, htmls)
    assert got[:30] == [f"Title {i}\nShort {i}\n{long.format(i=i).strip()}" for i in range(30)]
    assert got[30] == "The article of another template."


def test_html_chrome_names(spark):
    inner = "<article><h1>T {i}</h1><figure><pre>code {i}</pre><figcaption>Caption {i}</figcaption></figure><fieldset>Set {i}</fieldset><div class='ad'>Buy</div></article>"
    want = "T {i}\ncode {i}\nCaption {i}\nSet {i}"
    for name in ("page has-sidebar", "no-sidebar", "with-ads", "share-article"):
        htmls = [f"<body><div class='{name}'>{inner.format(i=i)}</div><div class='sidebar'>Side {i}</div><div id='comments'><article>Much said of {i} by many</article></div></body>" for i in range(2)]
        assert _extracted(spark, htmls) == [want.format(i=i) for i in range(2)]
    # no article: the element with most of the text isn't chrome, a longer discussion is
    assert _extracted(spark, ["<body><div class='menu-page'><p>Nearly all of the text</p></div><div class='menu'>x</div></body>"]) == ["Nearly all of the text"]
    assert _extracted(spark, ["<body><div><p>The text</p></div><div class='comments-area'><p>More words than in the text</p></div></body>"]) == ["The text"]


def test_packing_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from lociweave.llm.packing import tokenizer_path
    from lociweave.llm.queries import op6_packing

    t = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>  \n", "  <|endoftext|>'s", "<|endoftext| <|endoftext", "none it's", ""]
    frame = spark.createDataFrame([(i, x, "en", "s", "x") for i, x in enumerate(texts)], DOCS)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 1]
    joined = defaultdict(list)
    for p in sorted(corpus_pipeline.packing_stage(spark, frame, str(tmp_path)).collect(), key=lambda p: p.start):
        joined[p.doc_id] += p.ids
    assert joined == want
    for p in op6_packing(spark, str(tmp_path)).collect():
        own = want[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own[p.start : p.start + p.length]))


def test_packing_pieces_and_padding(spark):
    """Ids of the unmodified tokenizer; hardly any small pieces, little padding."""
    from tokenizers import Tokenizer

    from lociweave.llm.packing import pack_documents, tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "<|endoftext|>", "naïve", "x1", "it's"]) for _ in range(int(rng.lognormvariate(5.8, 1)))) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    pieces = pack_documents(frame, added_tokens=True).collect()
    joined, fill = defaultdict(list), Counter()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(joined[p.doc_id])
        joined[p.doc_id] += p.ids
        fill[p.sequence_id] += p.length
    assert joined == {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    assert max(fill.values()) <= 2048 and sum(fill.values()) >= 0.98 * 2048 * (len(fill) - 1)
    # a document is cut where it is longer than a window, and one at the end of each pool
    pools = sum(fill.values()) // (256 * 2044) + 1
    assert len(pieces) <= sum(-(-len(x) // 2048) for x in joined.values()) + pools
