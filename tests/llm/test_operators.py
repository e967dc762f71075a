"""The operators against brute force, exact round trips and held-out labels, and on odd input."""

import collections
import hashlib
import random
import re
import string
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, html_extract, langid, media, packing, queries, simhash_dedup, suffix_dedup, token_counts, toxicity, url_filters
from folioscope.llm.common import id_bucket
from folioscope.llm.components import connected_components


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# 1 media --------------------------------------------------------------------------------------------------------------


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\1")) + chunk(b"IEND", b"")


SAMPLES = {
    "png": png(),
    "gif": b"GIF89a\x01\0\x01\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;",
    "wav": media.to_wav(b"abc"),
    "gzip": zlib.compress(b"x" * 99, wbits=31),
    "bmp": b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0",
    "jpeg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x01\x02\xff\x00\x03\xff\xd9",
    "pdf": b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF",
    "ogg": b"OggS\0\x04" + bytes(20) + b"\x01\x03abc",
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_media_is_found_and_carved(kind):
    data = SAMPLES[kind]
    assert media.sniff(data)[0] == (kind, 0, len(data))
    assert (kind, 7, len(data)) in media.sniff(b"padding" + data + b"" * 3)
    broken = bytearray(data)
    if kind == "png":
        broken[20] ^= 1  # a checksum fails
    else:
        broken = broken[: len(data) // 2]
    assert kind not in {k for k, at, _ in media.sniff(bytes(broken)) if at == 0}


def test_media_types_are_corrected(spark):
    df = spark.createDataFrame([(1, SAMPLES["png"], "jpeg"), (2, b"text BM GIF89a RIFF", "gif"), (3, None, None), (4, b"", "png"), (5, b"x" + SAMPLES["gif"], "bin")], "id int, payload binary, said string")
    got = {r["id"]: r["media_type"] for r in media.sniff_media(df, "payload", "said").collect()}
    assert (got[1]["detected"], got[1]["corrected"]) == ("png", True)
    assert got[2]["detected"] == got[3]["detected"] == got[4]["detected"] == "unknown" and not got[2]["embedded"]
    assert got[5]["embedded"][0]["type"] == "gif" and got[5]["embedded"][0]["start"] == 1


def test_media_inside_media_are_carved(spark):
    outer = media.to_wav(b"ab" + SAMPLES["png"] + b"cd" + SAMPLES["gif"])
    assert media.sniff(outer) == [("wav", 0, len(outer))]
    inner = [("png", 46, len(SAMPLES["png"])), ("gif", 48 + len(SAMPLES["png"]), len(SAMPLES["gif"]))]
    assert media.sniff(outer, inside=True) == [("wav", 0, len(outer)), *inner]
    updated = SAMPLES["pdf"] + b"\n2 0 obj\nstartxref\n33\n%%EOF"
    assert media.sniff(updated + b" tail " + SAMPLES["pdf"])[0] == ("pdf", 0, len(updated))
    for many in (b"%PDF-" * 40_000, b"PK\x03\x04" * 40_000, b"RIFF" * 40_000):
        assert media.sniff(many) == []
    text = f"so {SAMPLES['pdf'].decode()} it is"
    (row,) = media.store_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row["media_type"], row["corrected"], row["n_embedded"]) == ("wav", True, 1)
    assert (row["embedded"][0]["type"], row["embedded"][0]["start"], row["embedded"][0]["length"]) == ("pdf", 47, len(SAMPLES["pdf"]))


def test_texts_are_stored_without_loss(odd_docs, no_docs, some_docs):
    for docs in (odd_docs, some_docs):
        got = collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.store_documents(docs).collect())
        want = collections.Counter()
        for d, t in texts_of(docs):
            b = t.encode()
            p = b + b"\xff" * (-len(b) % 576 if b else 576)
            want[(d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
        assert got == want
    assert media.store_documents(no_docs).count() == 0


# 2 decontamination ----------------------------------------------------------------------------------------------------


def brute_matches(docs, items):
    out = set()
    for d, t in docs:
        w = re.findall(r"\w+", t.lower())
        for i, x in items:
            y = re.findall(r"\w+", x.lower())
            if len(y) < 5:
                continue
            want = collections.Counter(tuple(y[k : k + 5]) for k in range(len(y) - 4))
            for s in range(len(w) - len(y) + 1):
                z = w[s : s + len(y)]
                have = collections.Counter(tuple(z[k : k + 5]) for k in range(len(z) - 4))
                both = sum((want & have).values())
                if both and both / (sum(want.values()) + sum(have.values()) - both) >= 0.8:
                    out.add((d, i, s))
    return out


def test_decontamination_finds_near_passages(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices(string.ascii_lowercase, k=4)) for _ in range(300)]
    pick = lambda n: rng.choices(words, k=n)
    items = [(i, " ".join(pick(rng.randint(12, 60)))) for i in range(25)]
    docs = []
    for d in range(80):
        w = pick(rng.randint(20, 150))
        x = items[rng.randrange(25)][1].split()
        kind = d % 4
        if kind == 1:
            x[-1] = "changed"
        if kind == 2:
            x[len(x) // 2] = "changed"
        if kind:
            at = rng.randrange(len(w))
            w[at:at] = [q.upper() + "," for q in x] if d % 3 else x
        docs.append((d, " ".join(w)))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, items[1][1]), (102, items[1][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (77, None), (78, "two words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.matches(df, bench).collect()}
    assert got == brute_matches([(d, t or "") for d, t in docs], items)
    best = {r["doc_id"]: r for r in decontaminate.contaminated(df, bench).collect()}
    assert best[102]["item_id"] == 1 and best[102]["similarity"] == 1.0 and 100 not in best and 101 not in best


def test_decontamination_of_texts_shorter_than_an_item(spark):
    rng = random.Random(13)
    items = [(i, " ".join("".join(rng.choices(string.ascii_lowercase, k=4)) for _ in range(n))) for i, n in enumerate((5, 9, 14, 30, 31, 60))]
    docs = [(100 * i + cut + 50 * end, " ".join(x.split()[cut:] if end else x.split()[: len(x.split()) - cut])) for i, x in items for cut in range(1, 16) for end in (0, 1)]
    want = set()
    for d, t in docs:
        for i, x in items:
            a, b = ({tuple(y[k : k + 5]) for k in range(len(y) - 4)} for y in (t.split(), x.split()))
            if a and b and len(a & b) / len(a | b) >= 0.8:
                want.add((d, i, 0))
    got = [(r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_decontamination_in_parts(spark, monkeypatch):
    rng = random.Random(12)
    pick = lambda n: " ".join(rng.choices("abcdefghij", k=n))
    items = [(i, pick(rng.choice((15, 20)))) for i in range(12)]
    docs = [(d, f"{pick(9)} {items[d % 12][1]} {pick(5)} {items[5 * d % 12][1]}") for d in range(30)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 1000)
    assert decontaminate.in_parts(decontaminate.item_table(bench))[1] > 2
    got = [(r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.matches(df, bench).collect()]
    assert sorted(got) == sorted(brute_matches(docs, items)) and got


def test_decontamination_without_rows(spark, no_docs, some_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(some_docs, empty).count() == 0
    assert decontaminate.contaminated(no_docs, spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")).count() == 0


def test_hamming_index_is_complete():
    rng = np.random.default_rng(1)
    block = np.concatenate([np.full(width, k) for k, (_, width) in enumerate(decontaminate.BLOCKS)])
    assert len(block) == 64
    share = decontaminate.RADIUS // len(decontaminate.BLOCKS)
    for _ in range(300):
        flipped = rng.choice(64, decontaminate.RADIUS, replace=False)
        assert min(np.bincount(block[flipped], minlength=len(decontaminate.BLOCKS))) <= share


def test_radius_takes_in_the_least_similarity():
    rng = np.random.default_rng(2)
    fp = lambda g: decontaminate.bits(g).sum(axis=0, dtype=np.int64) * 2 > len(g)
    apart = []
    for _ in range(3000):
        n = int(rng.integers(30, 200))
        a = rng.integers(1, 1 << 62, n, np.uint64)
        b = a.copy()
        while True:  # words change until one more would go below the similarity
            c = b.copy()
            c[rng.integers(0, n)] = rng.integers(1, 1 << 62, dtype=np.uint64)
            if decontaminate.weighted_similarity(decontaminate.shingles(a), decontaminate.shingles(c)) < decontaminate.SIMILARITY:
                break
            b = c
        apart.append(int((fp(decontaminate.shingles(a)) != fp(decontaminate.shingles(b))).sum()))
    assert np.mean(np.array(apart) <= decontaminate.RADIUS) >= 0.99


def test_decontamination_tells_rows_apart(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, f"before {item} after", 1), (None, "quite another text of some words", 2), (7, item, 3), (7, "a clean text under the id of a dirty one", 4), (7, item, 5), (8, None, 6), (9, " ".join(f"w{k}" for k in range(40_000)) + " " + item, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key int")
    bench = spark.createDataFrame([(1, item), (1, item), (None, "x y z")], "item_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"], r["similarity"]) for r in found) == [(-1, 1, 1.0), (7, 1, 1.0), (9, 1, 1.0)]
    left = decontaminate.without_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r["text_key"] for r in left.collect()) == [2, 4, 6]


# 3 html ---------------------------------------------------------------------------------------------------------------


def brute_article(html):
    import html as entities

    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    body = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?p>|</?h1>", "\n", body)))
    return "\n".join(x for x in (re.sub(r"\s+", " ", entities.unescape(y)).strip() for y in body.split("\n")) if x)


def test_html_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    trees = html_extract.train(pages)
    rows = html_extract.extract(pages, trees).select("html", "main_text").collect()
    assert sum(r["main_text"] == brute_article(r["html"]) for r in rows) >= 0.99 * len(rows)
    odd = [(1, None), (2, ""), (3, "plain words"), (4, "<p>cut <b>off"), (5, "</div></p><<<"), (6, "<script>var x='<p>no</p>'"), (7, "<!-- open"), (8, "<div " * 3000)]
    df = spark.createDataFrame(odd, "page_id long, html string").withColumn("x", F.lit(1))
    got = {r["page_id"]: r["main_text"] for r in html_extract.extract(df, trees).collect()}
    assert got[1] == got[2] == got[6] == got[7] == "" and got[3] == "plain words"
    assert html_extract.extract(df.limit(0), html_extract.train(df.limit(0))).count() == 0


LINE = "A tale of many words was told here, and it went on for long. Nobody knew how it would end. "
MENU = '<ul class="menu">' + "".join(f'<li><a href="/{k}">Topic {k}</a></li>' for k in range(7)) + "</ul>"
FOOT = '<div class="footer"><p>Copyright 2020 all rights reserved.</p></div>'
#: Pages of templates that no example has, without an article element, and their main text.
TEMPLATES = [
    ("<html><body>Some plain words of a page.</body></html>", "Some plain words of a page."),
    ("Some plain words", "Some plain words"),
    (f"<html><body>{LINE * 3}<br><br>{LINE}</body></html>", f"{LINE * 3} {LINE}"),
    (f"<html><body>{MENU}{LINE * 3}<br>{LINE}{FOOT}</body></html>", f"{LINE * 3} {LINE}"),
    (f"<article><p title=it's>{LINE}</p><p data-x=a\"b>{LINE * 2}</p></article>", f"{LINE}\n{LINE * 2}"),
    (f'<html><body><nav>{MENU}</nav><article><h1>T</h1><p class="performance">{LINE}</p><p>{LINE}</p></article></body></html>', f"T\n{LINE}\n{LINE}"),
    (f'<html><body>{MENU}<div id="page"><div class="post"><h1>Head</h1><p>{LINE * 2}</p><p>{LINE}</p></div><div class="sidebar"><h3>More</h3>{MENU}</div></div>{FOOT}</body></html>', f"Head\n{LINE * 2}\n{LINE}"),
    (f"<html><body><table><tr><td>{MENU}</td><td><h1>Head</h1><p>{LINE * 2}</p><p>{LINE}</p></td></tr></table>{FOOT}</body></html>", f"Head\n{LINE * 2}\n{LINE}"),
    (f'<html><body><div class="x1"><div class="x2">{MENU}</div><div class="x3"><h2>Head</h2><p>{LINE * 2}</p><blockquote><p>{LINE}</p></blockquote></div><div class="comments"><div class="comment"><p>{LINE}</p></div></div></div></body></html>', f"Head\n{LINE * 2}\n{LINE}"),
    (f'<html><body><div id="wrapper"><div id="header"><h1>My site</h1>{MENU}</div><div id="main"><h2>Head</h2>{LINE * 2}<p>{LINE}</p><ul><li>{LINE}</li></ul></div></div>{FOOT}</body></html>', f"Head\n{LINE * 2}\n{LINE}\n{LINE}"),
    (f'<html><body><section class="entry-content"><h1>Head</h1><p>{LINE * 2}</p><pre>code here</pre></section><section class="related"><h3>Related</h3>{MENU}</section><form><p>Name</p></form></body></html>', f"Head\n{LINE * 2}\ncode here"),
]


def test_html_of_other_templates(spark):
    trees = html_extract.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    tidy = lambda t: "\n".join(" ".join(x.split()) for x in t.split("\n"))
    rows = [(k, html, tidy(text)) for k, (html, text) in enumerate(TEMPLATES)]
    df = spark.createDataFrame([*rows, rows[6]], "page_id long, html string, text string")
    for r in html_extract.extract(df, trees).collect():
        assert r["main_text"] == r["text"], r["page_id"]


def test_html_is_read_in_linear_time():
    for page in ("<p><div>" * 20_000, "<div>" * 20_000 + "</x>" * 50_000, '<a x="' * 50_000, "<" * 50_000, "<a " * 50_000):
        html_extract.read_page(page)
    assert html_extract.attribute_tokens(""" data-class="no" title='class=no' CLASS="Yes it" id=is""") == "yes it is"


def test_html_decoding_is_consistent_and_best():
    page = html_extract.read_page("<body><div><p>a</p><ul><li>b<li>c</ul></div><nav><a>d</a></nav></body>")
    assert page.tag == ["#root", "body", "div", "p", "ul", "li", "li", "nav"] and page.parent == [-1, 0, 1, 2, 2, 4, 4, 1]
    rng = np.random.default_rng(2)
    for _ in range(50):
        p = rng.random(len(page.tag))
        got = html_extract.decode(page, p)
        best, top = None, -np.inf
        for mask in range(1 << len(page.tag)):
            y = np.array([mask >> k & 1 for k in range(len(page.tag))], bool)
            if y[0] and y[1] and all(not y[k] or y[page.parent[k]] for k in range(1, len(y))):
                s = np.log(np.where(y, p, 1 - p))[2:].sum()
                if s > top:
                    best, top = y, s
        assert (got == best).all()


# 4 token counts -------------------------------------------------------------------------------------------------------


def random_texts(n, extra=()):
    rng = random.Random(4)
    bits = [" ", "  ", "▁", "a", "b\n", "\n", ".\n", "\t", "the's", "\r", "\xa0", "é", "́", "\U0001f600", "\x00", "<s>", "</s>", "<|endoftext|>", ".", "1", "x" * 50, "　", "\x85", "\x1c", "'", "Σ", "ß", "(ab)", '"x', "('re", " foo", *extra]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_token_counts_are_the_librarys(spark, odd_docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path("piece_bpe_32k.model"))
    docs = spark.createDataFrame(list(enumerate(random_texts(2000))), "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs).collect())
    assert got == collections.Counter((d, len(t.encode()), len(sp.encode(t))) for d, t in texts_of(docs))
    assert token_counts.count_tokens(no_docs).count() == 0


# 5 suffix dedup -------------------------------------------------------------------------------------------------------


def brute_removal(docs, n=suffix_dedup.LENGTH):
    seen = collections.Counter(b[i : i + n] for _, b in docs for i in range(len(b) - n + 1))
    out = []
    for d, b in docs:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        out.append((d, len(b), int(mask.sum()), int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def planted(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé ", k=rng.randint(2, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    shared = [make(n) for n in (60, 80, 100, 150, 400)]
    docs = []
    for d in range(60):
        t = make(rng.randint(1, 300))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 60)
            at = rng.randint(0, len(t))
            t = t[:at] + p[a : len(p) - rng.randint(0, 60)] + t[at:]
        docs.append((d, t))
    for d in range(60, 80):
        t = list(docs[d % 7][1])
        for _ in range(d % 4):
            t[rng.randrange(len(t))] = "#"
        docs.append((d, "".join(t)))
    return [*docs, (90, "a" * 399), (91, "b" * 401), (92, "ab" * 300), (93, "x" * 400 + "y" * 400), (94, "x" * 401), (95, shared[4]), (96, shared[4][1:])]


@pytest.mark.parametrize("seed, length", [(1, 400), (2, 400), (3, 250), (4, 100)])
def test_removal_is_exact(spark, seed, length):
    docs = planted(seed)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), length=length)
    assert collections.Counter(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == brute_removal([(d, t.encode()) for d, t in docs], length)


def test_removal_on_odd_rows(odd_docs, no_docs, some_docs):
    for docs in (odd_docs, some_docs):
        got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert collections.Counter(map(tuple, got)) == brute_removal([(d, t.encode()) for d, t in texts_of(docs)])
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_shared_passages_are_told(spark):
    rng = random.Random(15)
    words = lambda n: [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(1000)}" for _ in range(n)]
    passages = [words(100) for _ in range(40)]
    docs = [(2 * k + j, " ".join([*words(60), *passages[k], *words(60)])) for k in range(40) for j in range(2)]
    own = words(120)
    docs += [(1000 + k, " ".join(words(150))) for k in range(30)] + [(2000, " ".join([*own, *words(9), *own]))]
    got = {r["doc_id"]: (r["repeats"], r["n_removed"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[d][0] == (d < 1000) for d, _ in docs) and got[2000][1] > 0


def test_long_texts_are_read_in_parts(monkeypatch):
    data = " ".join(f"w{k * k % 7919}" for k in range(4000)).encode()
    whole = [np.stack([x["a"], x["p0"], x["p1"], x["name"].view(np.int64), x["whole"].view(np.int64)]) for x in suffix_dedup.sampled(data)]
    monkeypatch.setattr(suffix_dedup, "PART", 1000)
    parts = [np.stack([x["a"], x["p0"], x["p1"], x["name"].view(np.int64), x["whole"].view(np.int64)]) for x in suffix_dedup.sampled(data)]
    assert len(parts) > 5 and (np.concatenate(parts, axis=1) == np.concatenate(whole, axis=1)).all()


# 6 url filters --------------------------------------------------------------------------------------------------------


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if c in string.ascii_uppercase else c for c in host)
    fit = [r for _, r in url_filters.RULES if url_filters.fits(host, path, r)]
    return host, path, max(fit, key=len) if fit else None


URLS = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x", "ftp://example.org", "http://x.com/fr/", "http://x.com/de/a#b", "http://com/fr/x", "http://xcom/fr/x", "no url", None, "", "://org/", "http://É.org/É?q", "http://a.b.net/x://y", "http://x.com#/fr/", "http://example.org/es", "a://org/en/1"]


def test_urls_and_rules(spark):
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(URLS)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filters.judge(df).collect()}
    assert got == {k: brute_url(u) for k, u in enumerate(URLS)}
    assert url_filters.judge(df.limit(0)).count() == 0


def test_long_lists_of_rules_are_joined(spark):
    rng = random.Random(16)
    domains = ["org", "com", "a.org", "b.a.org", "x.com", *(f"h{k}.net" for k in range(300))]
    rules = tuple(dict.fromkeys((rng.choice(("allow", "block")), f"{rng.choice(domains)}/{rng.choice(('', 'a', 'ab/', 'c/1'))}") for _ in range(900)))
    rules = tuple({rule: (said, rule) for said, rule in rules}.values())
    assert len(rules) > url_filters.MOST_RULES
    rows = [(k, f"http://{rng.choice(('', 'www.', 'q.'))}{rng.choice([*domains, 'xa.org', 'net'])}/{rng.choice(('', 'a', 'ab/c', 'c/12'))}", "") for k in range(600)] + [(600, None, None), (600, None, None)]
    got = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()
    assert len(got) == len(rows)
    for r in got:
        fitting = sorted(((-len(rule), said != "block", rule) for said, rule in rules if url_filters.fits(r["host"], r["path"], rule)))
        assert r["rule"] == (fitting[0][2] if fitting else None)
        assert not fitting or r["verdict"] == ("allow" if fitting[0][1] else "block")


def test_trust_and_distrust_follow_links(spark):
    edges = [("a.org", "b.net", 3), ("a.org", "c.net", 1), ("b.net", "c.net", 1), ("d.net", "bad.com", 1), ("e.net", "d.net", 2), ("c.net", "a.org", 1)]
    seeds = [("a.org", 2, 0), ("bad.com", 0, 3)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filters.propagate(spark.createDataFrame(seeds, "host string, allowed long, blocked long"), spark.createDataFrame(edges, "src string, dst string, n long")).collect()}
    hosts = sorted({x for e in edges for x in e[:2]})
    at = {h: k for k, h in enumerate(hosts)}
    fwd = np.zeros((len(hosts), len(hosts)))
    for s, d, n in edges:
        fwd[at[d], at[s]] = n
    back = fwd.T / np.maximum(fwd.T.sum(axis=0), 1e-9)
    fwd = fwd / np.maximum(fwd.sum(axis=0), 1e-9)
    s, b = np.eye(len(hosts))[at["a.org"]], np.eye(len(hosts))[at["bad.com"]]
    t, d = s.copy(), b.copy()
    for _ in range(200):
        t, d = 0.15 * s + 0.85 * fwd @ t, 0.15 * b + 0.85 * back @ d
    for h, k in at.items():
        assert got.get(h, (0, 0)) == pytest.approx((t[k], d[k]), abs=2e-3)
    pages = [(1, "http://a.org/x", ""), (2, "http://bad.com/de/x", ""), (3, "http://d.net/x", '<a href="http://bad.com/y">'), (4, "http://b.net/", "<A HREF = '//a.org/'>"), (5, "http://a.org/z", '<a href=https://b.net/q>'), (6, "http://q.net/", None)]
    verdicts = {r["page_id"]: r["verdict"] for r in url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert verdicts == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_hosts_far_from_a_seed_are_reached(spark):
    # the ring around the seed takes nearly all of the rank; a chain of 40 hosts hangs on one of its hosts
    edges = [(f"ring{k}", "bad.com", 1) for k in range(3000)] + [("chain0", "ring0", 1)] + [(f"chain{k + 1}", f"chain{k}", 1) for k in range(39)]
    seeds = [("bad.com", 0, 1), ("good.org", 1, 0)]
    df = spark.createDataFrame(edges, "src string, dst string, n long")
    got = {r["host"]: r["distrust"] for r in url_filters.propagate(spark.createDataFrame(seeds, "host string, allowed long, blocked long"), df).collect()}
    assert all(got.get(f"chain{k}", 0) > 0 for k in range(40))
    assert got["chain39"] == pytest.approx(0.15 * 0.85**41 / 3000, rel=1e-3)


def test_url_filter_runs_no_python(spark, sf):
    df = queries.op6_url_filters(spark, sf)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


# 7 simhash ------------------------------------------------------------------------------------------------------------


def brute_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    """Least index reachable."""
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    label = np.arange(len(f))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(f))])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def test_fingerprints_and_groups(spark, odd_docs, no_docs, some_docs):
    got = collections.Counter((r["doc_id"], r["fp"]) for r in simhash_dedup.fingerprints(odd_docs).collect())
    assert got == collections.Counter((d, np.array([brute_fingerprint(t)], np.uint64).view(np.int64)[0]) for d, t in texts_of(odd_docs))
    rows = simhash_dedup.near_duplicates(some_docs).collect()
    ids = sorted(r["doc_id"] for r in rows)
    fp = {d: brute_fingerprint(t) for d, t in texts_of(some_docs)}
    label = brute_components([fp[d] for d in ids])
    assert {r["doc_id"]: r["component_id"] for r in rows} == {d: ids[k] for d, k in zip(ids, label)}
    assert simhash_dedup.near_duplicates(no_docs).count() == 0
    odd = simhash_dedup.near_duplicates(odd_docs).collect()
    assert len(odd) == odd_docs.count() and {r["component_id"] for r in odd if r["doc_id"] in (5, 6)} == {5}


@pytest.mark.parametrize("cells", [(2048, 8192), (4, 9)])
@pytest.mark.parametrize("how", [simhash_dedup.SMALL, simhash_dedup.LARGE])
def test_links_lose_no_pair(spark, monkeypatch, cells, how):
    monkeypatch.setattr(simhash_dedup, "CELL_HOME", cells[0])
    monkeypatch.setattr(simhash_dedup, "CELL_NEAR", cells[1])
    rng = np.random.default_rng(6)
    fps = set()
    for base in rng.integers(0, 1 << 63, 12, dtype=np.int64).tolist():
        at = base
        for _ in range(25):  # chains of close fingerprints
            for b in rng.choice(64, rng.integers(1, 7), replace=False).tolist():
                at ^= 1 << b
            fps.add(at)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash_dedup.near_links(spark.createDataFrame([(x, x) for x in signed], "id long, w0 long"), how)
    root = {r["node"]: r["root"] for r in connected_components(links.select("u", "v")).collect()}
    label = brute_components(fps)
    groups = collections.defaultdict(set)
    for x, k in zip(signed, label):
        groups[k].add(root.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_isolated_pairs_meet_in_a_crowded_anchor(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CELL_NEAR", 16)
    rng = np.random.default_rng(9)
    fps = set()
    for k in range(60):  # the three blocks are words of few bits, so the pairs crowd around the same anchors
        at = sum(1 << int(b) for ((start, width),) in simhash_dedup.THREE for b in start + rng.choice(width, 3, replace=False))
        fps |= {at, at ^ sum(1 << int(b) for b in rng.choice(64, 1 + k % 4, replace=False))}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64)
    keys = np.concatenate([keys for _, keys, _ in simhash_dedup.anchors(signed[:, None], simhash_dedup.SMALL)])
    assert np.unique(keys, return_counts=True)[1].max() > 32
    links = simhash_dedup.near_links(spark.createDataFrame([(x, x) for x in signed.tolist()], "id long, w0 long"))
    root = {r["node"]: r["root"] for r in connected_components(links.select("u", "v")).collect()}
    groups = collections.defaultdict(set)
    for x, k in zip(signed.tolist(), brute_components(fps)):
        groups[k].add(root.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_cover_is_a_perfect_code():
    table, size = simhash_dedup.cover((23,), 1)
    assert (np.bitwise_count(table[:, 0]) <= 3).all() and np.bincount(np.bitwise_count(table[:, 0])).tolist() == [1, 23, 253, 1771]
    assert size.sum() == 1 + 23 + 253 + 1771 + 8855


@pytest.mark.parametrize("how", [simhash_dedup.SMALL, simhash_dedup.LARGE])
def test_cover_is_complete(how):
    assert how.keeps_all()
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, (400, 1), np.int64)
    y = x.copy()
    for k in range(len(y)):
        for b in rng.choice(64, how.radius, replace=False):
            y[k, 0] ^= np.uint64(1 << int(b)).view(np.int64)
    homes, reached = (collections.defaultdict(set) for _ in range(2))
    for fps, into, only in ((x, homes, True), (y, reached, False)):
        for row, keys, home in simhash_dedup.anchors(fps, how):
            for r, key in zip(row[home | (not only)].tolist(), keys[home | (not only)].tolist()):
                into[r].add(key)
    assert all(homes[k] & reached[k] and len(homes[k]) == len(how.blocks) for k in range(len(x)))


def test_texts_of_the_least_similarity_meet():
    rng = np.random.default_rng(8)
    pairs, n_met = [], 0
    for _ in range(1500):
        words = rng.integers(1, 1 << 62, int(rng.integers(30, 400)), np.uint64)
        other = words.copy()
        while True:  # words change until one more would go below the similarity
            c = other.copy()
            c[rng.integers(0, len(c))] = rng.integers(1, 1 << 62, dtype=np.uint64)
            a, b = decontaminate.shingles(words), decontaminate.shingles(c)
            if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < simhash_dedup.SIMILARITY:
                break
            other = c
        pairs.append([simhash_dedup.wide_fingerprint(decontaminate.shingles(z)) for z in (words, other)])
    x, y = np.array(pairs).transpose(1, 0, 2)
    keys = [[(set(), set()) for _ in pairs] for _ in range(2)]
    for side, fps in enumerate((x, y)):
        for row, key, home in simhash_dedup.anchors(np.ascontiguousarray(fps), simhash_dedup.WIDE):
            for r, k, h in zip(row.tolist(), key.tolist(), home.tolist()):
                keys[side][r][1].add(k)
                if h:
                    keys[side][r][0].add(k)
    how = simhash_dedup.WIDE
    for k in range(len(pairs)):
        apart = np.bitwise_count((x[k, : how.compared] ^ y[k, : how.compared]).view(np.uint64)).sum()
        whole = np.bitwise_count((x[k] ^ y[k]).view(np.uint64)).sum()
        n_met += bool(apart <= how.radius and whole <= simhash_dedup.WIDE_RADIUS and (keys[0][k][0] & keys[1][k][1] or keys[1][k][0] & keys[0][k][1]))
    assert n_met >= 0.995 * len(pairs)


def test_components_of_paths_and_hubs(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (7, 8)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 1 for k in range(2, 61)}, **{k: 100 for k in range(101, 160)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 8 toxicity -----------------------------------------------------------------------------------------------------------


def test_toxicity_holds_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    model = toxicity.train(docs, labels, id_bucket("doc_id", 5) != 0)
    rows = toxicity.score_documents(docs, model).filter(id_bucket("doc_id", 5) == 0).join(labels, "doc_id").collect()
    y, p = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    assert ((p >= 0.5) == y).mean() > 0.97 and p[y == 1].mean() > 0.8
    hit = next(r for r in rows if r["toxic"] and r["score"] > 0.9)
    assert hit["offending"] and all(s["p"] >= 0.5 and s["start"] < s["end"] for s in hit["offending"])


def test_toxicity_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (5, 1), (6, 1), (2, 1), (3, 0), (8, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels, F.lit(True))
    rows = toxicity.score_documents(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0.0}
    none = toxicity.train(no_docs, labels, F.lit(True))
    assert toxicity.score_documents(no_docs, none).count() == 0
    one = toxicity.train(odd_docs, labels.filter("toxic = 0"), F.lit(True))
    assert max(r["score"] for r in toxicity.score_documents(odd_docs, one).collect()) < 1e-6


def test_noisy_or_is_of_the_sentences():
    model = toxicity.BagModel(-2.0, {f: 1.5 for f in toxicity.features_of("bad")[:1]})
    s = model.scorer()
    p = 1 / (1 + np.exp(-np.array([-2.0, -0.5])))
    assert s.score("Good day. A bad one!", 0.3)[0] == pytest.approx(1 - np.prod(1 - p))
    assert s.score("Good day. A bad one!", 0.3)[1] == [{"start": 9, "end": 19, "p": pytest.approx(p[1])}]
    assert s.score("") == s.score("...") == (0.0, [])


# 9 packing ------------------------------------------------------------------------------------------------------------


def check_packing(rows, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_counts.tokenizer_path("word_bpe_49k.json"))
    want = collections.Counter()
    for d, t in docs:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[(d, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), -(-sum(r["length"] for r in rows) // 2048)


def test_packing_is_whole_and_tight(spark, odd_docs, no_docs, some_docs):
    n, least = check_packing(packing.pack(packing.token_pieces(some_docs)).collect(), texts_of(some_docs))
    assert n <= 1.05 * least + 1
    check_packing(packing.pack(packing.token_pieces(odd_docs)).collect(), texts_of(odd_docs))
    assert packing.pack(packing.token_pieces(no_docs)).count() == 0
    ids = packing.WordIds(token_counts.tokenizer_path("word_bpe_49k.json"))
    tried = random_texts(3000)
    assert [ids.of(x) for x in tried] == [np.array(e.ids, "<u4").tobytes() for e in ids.encoder.encode_batch(tried, add_special_tokens=False)]


def test_packing_keeps_other_columns(spark):
    pieces = spark.createDataFrame([(k, 1 + k * 37 % 2048, 1, 2, 3, "x", 4) for k in range(60)], "doc_id long, length long, item int, bin int, at int, `odd name` string, offset int")
    out = packing.pack(pieces)
    assert out.columns == ["doc_id", "length", "item", "bin", "at", "odd name", "sequence_id", "offset"]
    rows = out.collect()
    assert len(rows) == 60 and all((r["item"], r["bin"], r["at"], r["odd name"]) == (1, 2, 3, "x") for r in rows)


def test_packing_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    rng = random.Random(9)
    pieces = spark.createDataFrame([(k, rng.choice((2048, rng.randint(1, 2047), rng.randint(1, 300)))) for k in range(1500)], "doc_id long, length long")
    rows = packing.pack(pieces).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(rows) == 1500 and len(bins) <= 1.03 * sum(r["length"] for r in rows) / 2048 + 1


# 10 languages ---------------------------------------------------------------------------------------------------------


def test_languages_hold_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, id_bucket("doc_id", 3) != 1)
    rows = langid.predict(docs, model).filter(id_bucket("doc_id", 3) == 1).select("lang", "language.*").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows(odd_docs, no_docs):
    model = langid.train(odd_docs, F.lit(True))
    rows = langid.predict(odd_docs.drop("language"), model).select("doc_id", "text", "language.*").collect()
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and (r["lang_pred"] != "und" or r["score"] == 0)
    none = langid.train(no_docs, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(odd_docs, none, into="y").select("y.*").collect()} == {"und"}
    assert langid.predict(no_docs, none).count() == 0


def test_languages_of_few_rows_and_of_many_kinds(spark):
    rng = random.Random(6)
    kinds = {f"L{k:03d}": ["".join(rng.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(60)] for k in range(70)}
    rows = [(1000 * k + i, " ".join(rng.choices(words, k=12)), name) for k, (name, words) in enumerate(kinds.items()) for i in range(200 if k < 3 else 12)]
    few = ["qqxzj", "zzkqv", "wwpqx", "jjvvk", "xxqqp"]
    rows += [(900_000 + i, " ".join(rng.choices(few, k=8)), "few") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    assert model.languages == sorted([*kinds, "few"]) and len(model.slices) == 2
    assert model.predict(" ".join(few))[0] == "few"
    assert sum(model.predict(" ".join(words[:20]))[0] == name for name, words in kinds.items()) >= 68


def test_filters_return_all_languages_of_a_trigram():
    grams = {k: np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k, n in (("aa", 500), ("bb", 900))}
    f = langid.LanguageFilters.build(grams)
    mask = np.bitwise_and.reduce([f.slices[0][p] for p in langid.positions(grams["bb"])])
    assert (mask >> np.uint64(1) & np.uint64(1)).all() and (mask[:500] & np.uint64(1)).all()
    assert (mask[500:] & np.uint64(1)).mean() < 0.02


def test_url_filter_equals_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(8)
    hosts = ["a.org", "b.example.org", "c.com", "d.net", "e.net", "f.net", "g.com", "h.net"]
    rows = []
    for k in range(200):
        links = " ".join(f'<a href="http://{rng.choice(hosts)}/x">y</a>' for _ in range(rng.randint(0, 3)))
        rows.append((k, f"http://{rng.choice(hosts)}{rng.choice(('/fr/1', '/de/2', '/es/3', '/en/1', ''))}", links))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for sf in (str(tmp_path), "/root/testdata/sf0.01"):
        got = queries.op6_url_filters(spark, sf)
        con = duckdb.connect()
        con.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet{'/*.parquet' if sf == str(tmp_path) else ''}')")
        rel = con.sql(queries.ORACLE_SQL["op6_url_filters"])
        at = [rel.columns.index(c) for c in got.columns]
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


# what several operators share ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text, want", [("67108864", 64 << 20), ("64m", 64 << 20), ("512MB", 512 << 20), ("1g", 1 << 30), ("8 k", 8192), ("-1", -1), ("3b", 3)])
def test_sizes_have_units(text, want):
    from folioscope.llm.common import byte_size

    assert byte_size(text) == want


def test_batches_are_bounded_whatever_the_unit(spark):
    from folioscope.llm.common import BATCH_BYTES, bounded_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for value, want in (("64m", BATCH_BYTES), ("1m", "1m")):
        spark.conf.set(key, value)
        bounded_batches(spark)
        assert spark.conf.get(key) == str(want)
    spark.conf.set(key, before)


def test_scopes_of_threads_are_apart(spark):
    import threading

    from folioscope.llm.common import materialize, temporary_tables

    kept, inside, leave = [], threading.Event(), threading.Event()

    def other():
        with temporary_tables(spark):
            kept.append(materialize(spark.range(3), "other"))
            inside.set()
            leave.wait(60)

    t = threading.Thread(target=other)
    t.start()
    inside.wait(60)
    with temporary_tables(spark):
        mine = materialize(spark.range(5), "mine")
        assert mine.count() == 5
    # the other's table is still there
    assert kept[0].count() == 3
    leave.set()
    t.join()
    with pytest.raises(Exception):
        kept[0].count()


# short items, repeated rows, pages in valid html ------------------------------------------------------------------------


def test_short_items_lose_no_window(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(4000)}"
    items = {k: [word() for _ in range(rng.randrange(8, 34))] for k in range(120)}
    docs, want = [], set()
    for d in range(400):
        item = rng.choice(list(items))
        own = list(items[item])
        for _ in range(rng.randrange(0, 3)):
            own[rng.choice((0, 1, len(own) - 1, rng.randrange(len(own))))] = word()
        docs.append((d, [word() for _ in range(rng.randrange(0, 9))] + own + [word() for _ in range(rng.randrange(0, 9))]))
    grams = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    own = {k: grams(w) for k, w in items.items()}
    for d, w in docs:
        for k, item in items.items():
            for at in range(max(1, len(w) - len(item) + 1)):
                x = grams(w[at : at + len(item)])
                both = sum((x & own[k]).values())
                if both / (sum(x.values()) + sum(own[k].values()) - both) >= 0.8:
                    want.add((d, k, at))
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} long, text string")
    got = decontaminate.matches(frame(docs, "doc_id"), frame(items.items(), "item_id")).collect()
    assert {(r["doc_id"], r["item_id"], r["start"]) for r in got} == want and len(want) > 200


def test_windows_are_counted_once(spark):
    item = " ".join(f"w{k}" for k in range(30))
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    docs = spark.createDataFrame([(7, f"{item} and more"), (7, f"{item} and more"), (None, item)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_windows"], r["n_items"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    # with one and two words left out 25 and 24 of 26 shingles are the same
    assert got == {7: (3, 2, 1), None: (1, 2, 1)}


def test_many_equal_rows_cost_no_square(spark):
    long = " ".join(f"word{k * 7919 % 9973}" for k in range(700))
    rows = [(None, long)] * 1000 + [(1, long[:600]), (2, "short")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1002 and all(r["n_removed"] == r["n_bytes"] and r["n_spans"] == 1 for r in got if r["doc_id"] is None)
    assert {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"]} == {1: 600, 2: 0}
    starts = suffix_dedup.repeated_starts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert max(len(r["starts"]) for r in starts) < 100


ARTICLE = "<article><h1>The headline of it</h1><p>" + "A first paragraph of the story, with some words in it. " * 3 + "</p><p>" + "A second one, which goes on about the same things. " * 3 + "</p></article>"


@pytest.mark.parametrize(
    "before, after",
    [
        ("<html><head><meta charset=utf-8><title>T</title><nav><a href=/>Home</a></nav>", "</html>"),
        ("<html><head><title>T</title><link rel=x href=y><style>p{}</style>", ""),
        ("<!doctype html><html><head><title>T</title><script>var a='<p>';</script><main>", "</main>"),
        ("<html><head></head><body><!--><div>", "</div><!-- gone --!>"),
        ("<html><body><!---><!-- a -- b -->", "</body>"),
        ("<head><title>T</title>", ""),
    ],
)
def test_pages_in_valid_html_keep_their_article(some_trees, before, after):
    text = html_extract.extract_text(f"{before}{ARTICLE}{after}", some_trees)
    assert text.startswith("The headline of it\nA first paragraph") and "which goes on about the same things." in text
    assert "gone" not in text and "var a" not in text and "Home" not in text


@pytest.fixture(scope="module")
def some_trees(spark):
    return html_extract.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_broken_pages_have_defined_texts(some_trees):
    long = "Some words of a story, told at length. " * 4
    assert html_extract.extract_text(f"<article><p>{long}<b>off", some_trees) == f"{long}off"
    assert html_extract.extract_text(f"<article><p>{long}</div></p><<<", some_trees).startswith(long.strip())
    assert html_extract.extract_text("<div " * 3000, some_trees) == ""
