"""Page texts, web archives and token shards: templates by hand, exact round trips."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lagfield.llm import html_text, token_shards, warc

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><header><h1>Site</h1></header>"
    "<nav><ul><li><a href='/'>home</a><li>more</ul></nav><div class='ad'>buy</div>"
    "<div id=main><h2>Title {0}</h2><p>One &amp; t&#119;o\n  lines {0}<br>x<p class=lead>Second <b>bold</b>text{0} &eacute;</p>"
    "<div class='share-box share'>share</div><p>{1}</p></div>"
    "<section class='comments'><p>nice {0}</p></section><aside>side</aside><form>mail <input name=q></form>"
    "<!-- <p>hidden</p> --><footer>&copy; foot</footer>"
)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def text_of(i, tail):
    return f"Title {i}\nOne & two lines {i} x\nSecond boldtext{i} é" + (f"\n{tail}" if tail else "")


def test_extract(spark, clash):
    rows = [(i, f"https://h.example/{i}", PAGE.format(i, "Follow us daily.")) for i in range(8)]
    rows += [(20 + i, "http://small.example:80/x", PAGE.format(i, "kept")) for i in range(2)]
    rows += [(40, None, None), (41, "bad", ""), (42, None, "plain words only"), (43, "https://h.example/z", "<p>alone &lt;b&gt;</p> <div>and"), (0, "https://h.example/0", PAGE.format(0, "Follow us daily."))]
    got = html_text.extract(clash(pages_of(spark, rows))).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    for i in range(2):
        assert by_id[20 + i].text == text_of(i, "kept")
    # the same sentence at the same place of every page of the host is part of its template
    assert {by_id[i].text for i in range(8)} <= {text_of(i, t) for i in range(8) for t in ("", "Follow us daily.")}
    assert [by_id[i].text for i in (40, 41, 42, 43)] == ["", "", "plain words only", "alone <b>\nand"]
    assert html_text.extract(pages_of(spark, [])).collect() == []


def test_host_template_outweighs_a_single_page(spark):
    """A page whose own article is short still gives the article, as its host's other pages place it."""
    body = "<body><div class=x>{}</div><div class=y><p>{}</p></div></body>"
    rows = [(i, "http://a.example/", body.format("menu of words", f"text {i} " * 60)) for i in range(9)]
    rows.append((9, "http://a.example/", body.format("menu of words", "brief")))
    got = {r.page_id: r.text for r in html_text.extract(pages_of(spark, rows)).collect()}
    assert got[9] == "brief" and got[3] == ("text 3 " * 60).strip()


def by_id(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(pages_of(spark, rows)).collect()}


def host(i):
    return f"http://h{i}.example/"


def test_every_kind_of_page_ends_whole(spark):
    """Fragments, text outside of elements, any class of html; lists and tables inside articles; hosts of one to six pages."""
    shapes = [
        "words {0} only",
        "<body><p>one {0}</p><p>two {0}</p></body>",
        "<p>a {0}</p> and more {0}",
        "<html><body><p>in {0}</p></body></html> after {0}",
        "<article><p>lead {0}</p><ul><li>" + "long item {0} " * 30 + "</li></ul><p>end {0}</p></article>",
        '<article><h1>head {0}</h1><p class=lead>lead {0}</p><div class=body>' + "<p>para {0} words</p>" * 3 + "</div></article>",
        '<div class="content-sidebar-wrap"><article>real {0} text</article></div>',
        '<div class="post share"><article>real {0} text</article>around</div>',
        "<table><tr><td>cell {0}</td></tr></table>",
    ]
    shapes += [f'<html class="{c}"><body><div id=x>text {{0}}</div></body></html>' for c in ("no-js", "page", "wp", "home", "js")]
    rows, want, n = [], {}, 0
    for h, shape in enumerate(shapes):
        for size in (1, 2, 3, 6):
            for i in range(size):
                rows.append((n, host(f"{h}-{size}"), shape.format(f"w{n}q")))
                walk = html_text.Walk(rows[-1][2])
                blocks = {}
                for _, piece, block in walk.texts:
                    blocks[block] = " ".join((blocks.get(block, "") + piece).split())
                want[n] = "\n".join(b for b in blocks.values() if b and b != "around")
                n += 1
    assert by_id(spark, rows) == want


def test_condemned_parts(spark):
    page = (
        "<body><div class='site_footer'>top</div><div class='comments-open'><p>a{0}</p></div><div class='x-comments'>"
        "<article>c{0}</article></div><div id=page-sidebar><article class=post><p>b{0}</p></article>s{0}</div>"
        "<aside><article>t{0}</article></aside><span class=ad>buy</span></body>"
    )
    got = by_id(spark, [(i, host(1), page.format(i)) for i in range(2)])
    assert got == {i: f"b{i}" for i in range(2)}
    got = by_id(spark, [(i, host(1), page.format(i).replace("article", "div")) for i in range(2)])
    assert got == {i: f"a{i}" for i in range(2)}


def test_copies_are_no_template(spark):
    """The same article on many pages of a host, and near copies of it, keep their texts."""
    page = "<html><body><div><h1>Head of it</h1><p>{}</p></div><div><p>end {}</p></div></body></html>"
    rows = [(i, host(1), page.format("same words", "x")) for i in range(9)]
    assert by_id(spark, rows) == {i: "Head of it\nsame words\nend x" for i in range(9)}


def plain_fixed(pages):
    """Keys of the template's texts of one host by comparing whole vectors of all tokens with each other."""
    walks = [(i, html_text.Walk(p)) for i, p in pages]
    vectors, parents, kinds = {}, {}, {}
    for at, (_, walk) in enumerate(walks):
        kind = min((zlib.crc32(t.encode()) for t in walk.own_texts().values()), default=0)
        for key, parent, _, n in walk.tokens():
            vectors.setdefault(key, [0] * len(walks))[at] = n
            parents[key] = parent
            kinds.setdefault(key, set()).add(kind)
    classes = {}
    for key, v in vectors.items():
        if max(v) == 1 and len(kinds[key]) >= html_text.SUPPORT:
            classes.setdefault(tuple(v), set()).add(key)
    fixed = set()
    for v, members in classes.items():
        texts = {k for k in members if k & 1 and parents[k] in members}
        if texts:
            orders = set()
            for at, (_, walk) in enumerate(walks):
                if v[at]:
                    orders.add(tuple(k for k, *_ in walk.tokens() if k in members))
            if len(orders) == 1:
                fixed |= texts
    return fixed


def test_template_equals_whole_vectors(spark):
    rng = random.Random(4)
    parts = ["<div class=a>fixed a</div>", "<div class=b>fixed b</div>", "<section id=c><h2>fixed c</h2></section>"]
    hosts = {}
    for h in range(6):
        pages = []
        for i in range(rng.randrange(1, 12)):
            mine = [p for p in parts if rng.random() < (1 if h % 2 else 0.7)]
            if h == 2:
                rng.shuffle(mine)
            body = "".join(mine) + "<div class=m>" + "".join(f"<p>{rng.random()}</p>" for _ in range(rng.randrange(1, 4))) + "</div>"
            pages.append((h * 100 + i, f"<html><body>{body}</body></html>"))
        hosts[f"h{h}.example"] = pages
    rows = [(i, f"http://{h}/x", p) for h, pages in hosts.items() for i, p in pages]
    got = {r.host: set(r.fixed) for r in html_text.templates(pages_of(spark, rows)).collect()}
    want = {h: f for h, pages in hosts.items() if (f := plain_fixed(pages))}
    assert want and got == want


def test_order_and_nesting_are_checked():
    """A class whose tokens change places, or lie in two slots of the class around them, is not valid."""
    def checks(pages, of):
        batch = pa.RecordBatch.from_pylist(
            [{"url": "http://h/", "html": p, "members": [{"key": k, "class": c} for k, c in of.items()]} for p in pages],
            schema=pa.schema([("url", pa.string()), ("html", pa.string()), ("members", pa.list_(pa.struct([("key", pa.int64()), ("class", pa.int64())])))]),
        )
        return next(html_text._checked([batch])).to_pylist()

    one, two = "<div id=o><i class=ad></i><div id=a>a</div><div id=p>p</div><div id=b>b</div></div>", "<div id=o><div id=b>b</div><div id=p>p</div><div id=a>a</div></div>"
    keys = {e[2] + str(n): e[0] for n, e in enumerate(html_text.Walk(one.replace("<i class=ad></i>", "")).elements)}
    o, a, p, b = (keys[k] for k in ("div1", "div2", "div3", "div4"))
    rows = checks([one, two], {a: 1, b: 1, o: 2, p: 2})
    assert len({r["order"] for r in rows if r["class"] == 1}) == 2 and len({r["order"] for r in rows if r["class"] == 2}) == 1
    assert [r["nested"] for r in rows if r["class"] == 1] == [False, False]
    assert all(r["nested"] for r in checks([one], {a: 1, b: 1, o: 2}))


def test_long_and_broken_pages():
    assert html_text.main_text("<div>" * 3000 + "deep" + "<b" * 50) in ("deep", "deep<b" + "<b" * 49)
    long = "<article>" + "".join(f"<p>w{i}" for i in range(20_000)) + "</article>"
    assert html_text.main_text(long).count("\n") == 19_999


# archives


def test_archive_round_trip(spark, clash, tmp_path):
    rng = random.Random(1)
    big = "".join(rng.choice("abé\r\n<>") for _ in range(30_000))
    htmls = [None, "", "x", big, big, "x", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "ü" * 4000, None, "0\r\n\r\n"]
    rows = [(i, f"http://h/{i} \n" if i % 2 else None, h) for i, h in enumerate(htmls)] + [(3, "http://h/3", big), (None, None, "x")]
    folder = str(tmp_path / "warc")
    warc.write_warc(clash(pages_of(spark, rows)), folder, segment_bytes=1000, chunk_bytes=300, file_records=7)
    records = warc.read_records(spark, folder)
    assert records.where("type = 'continuation'").count() > 30
    shuffled = records.repartition(5, F.rand(3))
    for source in (records, shuffled):
        back = warc.reassemble(source).mapInArrow(warc._payloads, "page_id long, type string, refers_to long, length long, digest string, payload binary, found_digest string, sound boolean").collect()
        assert len(back) == len(rows) and all(r.sound for r in back)
        want = Counter()
        for i, _, h in rows:
            same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
            keeper = max(same)
            revisit = i is not None and i != keeper
            data = (h or "").encode()
            want[i, "revisit" if revisit else "response", keeper if revisit else None, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), None if revisit else data] += 1
        assert Counter((r.page_id, r.type, r.refers_to, r.length, r.found_digest, None if r.payload is None else bytes(r.payload)) for r in back) == want


def test_revisits_name_a_record(spark, tmp_path):
    """Every record has an identifier of its own, and what a revisit names is the response with its payload."""
    htmls = ["x", "x", "x", "y" * 3000, "y" * 3000, None, "", "z"]
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(htmls)]
    rows += [(4, "http://h/4", "y" * 3000), (4, "http://h/4", "y" * 3000), (None, None, "x"), (None, None, "x"), (7, "http://h/7", "q")]
    for nth, least in enumerate((0, 2)):
        folder = str(tmp_path / f"warc{nth}")
        warc.write_warc(pages_of(spark, rows), folder, revisit_bytes=least, segment_bytes=1000)
        files = spark.read.format("binaryFile").load(folder).collect()
        heads = [h for f in files for h in warc._inflate(bytes(f.content)).decode().split("WARC/1.1\r\n")[1:]]
        fields = [dict(x.split(": ", 1) for x in h.split("\r\n\r\n")[0].split("\r\n")) for h in heads]
        ids = {f["WARC-Record-ID"]: f for f in fields}
        assert len(ids) == len(fields)
        revisits = [f for f in fields if f["WARC-Type"] == "revisit"]
        assert len(revisits) == (4 if least == 0 else 1)
        for f in revisits:
            named = ids[f["WARC-Refers-To"]]
            assert named["WARC-Type"] == "response" and named["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
            assert f["WARC-Refers-To-Target-URI"] == named["WARC-Target-URI"]
        back = warc.read_warc(spark, folder).collect()
        assert len(back) == len(rows) and all(r.sound for r in back)


def test_missing_segment_is_told(spark, tmp_path):
    folder = str(tmp_path / "warc")
    warc.write_warc(pages_of(spark, [(1, "u", "a" * 5000), (2, "u", "b")]), folder, segment_bytes=1000)
    records = warc.read_records(spark, folder).where("segment IS NULL OR segment <> 3")
    assert {r.page_id: r.whole for r in warc.reassemble(records).collect()} == {1: False, 2: True}


def test_empty_archive(spark, tmp_path):
    assert warc.archive_table(pages_of(spark, []), str(tmp_path / "warc")).collect() == []


def test_chunks():
    assert warc.unchunk(b"3;ext=1\r\nabc\r\nA\r\n0123456789\r\n0\r\nTrailer: x\r\n\r\n") == b"abc0123456789"
    with pytest.raises(ValueError):
        warc.unchunk(b"5\r\nabc\r\n0\r\n\r\n")


# token shards


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_encoder_equals_whole_texts():
    rng = random.Random(2)
    encoder = token_shards.WordEncoder(tokenizer())
    texts = ["", "foo<|endoftext|>bar it's A b", "ÉTÉ é İx 12ab ab12 <|startoftext|> x", "Straße×2 don't we'LL", "a\x1cb c é", "\x00 ‍ ß"]
    texts += [" ".join("".join(rng.choice("abÀé.,#!'1日 ") for _ in range(rng.randrange(1, 9))) for _ in range(30)) for _ in range(200)]
    for _ in range(2):  # the second time from memory
        assert [x.tolist() for x in encoder.encode(texts)] == encoder.whole(texts)


def test_encoder_learns_letters_and_marks_apart(monkeypatch):
    encoder = token_shards.WordEncoder(tokenizer())
    asked = []
    whole = encoder.whole
    encoder.whole = lambda texts: asked.extend(w for t in texts for w in t.split()) or whole(texts)
    texts = ["Abcd, abcd. ABCD!", "  abcd,. Ébc, ébc  12, abcd", " ", "<|ENDOFTEXT|> abcd|> H\u0331, K\u0327."]
    got = [x.tolist() for x in encoder.encode(texts) + encoder.encode(["abcd? éBC!! abcd"])]
    assert max(Counter(asked).values()) == 1
    assert encoder.n == 14  # letters, marks and other words, each once; "abcd," and "abcd." are none of them
    assert got == whole([*texts, "abcd? éBC!! abcd"])
    monkeypatch.setattr(token_shards, "CACHE_WORDS", 3)  # all is forgotten and learned again
    assert [encoder.encode([t])[0].tolist() for t in texts] == whole(texts)


def test_perfect_hash():
    for n in (1, 2, 3, 7, 100, 1500):
        h = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
        seeds, slots = token_shards.perfect_seeds(h)
        assert sorted(slots.tolist()) == list(range(n))
        assert np.array_equal(token_shards.slots_of(h, seeds, n), slots)


def test_token_table(make, clash, spark, tmp_path):
    texts = [None, "", "hello world", "Hello, World!", "x " * 30_000, "ü # # \x1e\x1e"] + [f"doc {i} word" for i in range(50)]
    rows = [(i * 7 % 59, t, "en", "s") for i, t in enumerate(texts)] + [(5, "again", "en", "s"), (5, "again", "en", "s"), (None, "no id", "en", "s")]
    docs = make(rows)
    folder = str(tmp_path / "shards")
    got = token_shards.token_table(clash(docs), folder, tokenizer(), shard_bytes=20_000).collect()
    encode = token_shards.WordEncoder(tokenizer()).whole
    ids = {i: [] for i, *_ in rows}
    for i, t, *_ in rows:
        ids[i].append(encode([t or ""])[0] + [2])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, group in ids.items() for x in group
    )
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()
    keys = [r.doc_id for r in ordered]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert len({r.shard for r in got}) > 1
    # keyed access
    blocks = 1 + len(rows) // token_shards.BLOCK_KEYS
    asked = spark.createDataFrame([(14, 0), (5, 1), (None, 0), (777, 0), (14, 1)], "doc_id long, copy long")
    found = {(r.doc_id, r.copy): r.ids for r in token_shards.fetch(asked, folder, blocks, "<u2").collect()}
    assert set(found) == {(14, 0), (5, 1), (None, 0)}
    assert found[14, 0] == ids[14][0] and found[None, 0] == ids[None][0]


def test_shards_go_by_number(spark):
    """Beyond 99999 the names of shards no longer sort as text."""
    numbers = [0, 1, 4095, 4096, 9999, 99_998, 99_999, 100_000, 100_001, 1_234_567]
    rows = [(f"part-{n:05d}-abc-c000.txt", n + 1) for n in numbers]
    totals = spark.createDataFrame(rows[::-1], "shard string, ids bigint")
    got = {r.shard: r.first for r in token_shards._before(totals, "ids").collect()}
    assert [got[s] for s, _ in rows] == np.cumsum([0] + [n for _, n in rows])[:-1].tolist()


def test_keyed_reads_open_few_shards(make, spark, tmp_path):
    docs = make([(i, f"text {i} " * 200, "en", "s") for i in range(120)])
    folder = str(tmp_path / "shards")
    token_shards.token_table(docs, folder, tokenizer(), shard_bytes=20_000)
    asked = spark.createDataFrame([(3, 0), (4, 0)], "doc_id long, copy long")
    got = token_shards.fetch(asked, folder, 1, "<u2")
    assert {r.doc_id for r in got.collect()} == {3, 4}
    opened = [f for f in got.inputFiles() if "part-" in f and f.endswith(".txt")]
    assert 0 < len(opened) <= 2 < len([f for f in (tmp_path / "shards" / "shards").iterdir() if f.name.endswith(".txt")])
    none = spark.createDataFrame([(999, 0)], "doc_id long, copy long")
    assert token_shards.fetch(none, folder, 1, "<u2").collect() == []


def test_empty_token_table(make, tmp_path):
    assert token_shards.token_table(make([]), str(tmp_path / "shards"), tokenizer()).collect() == []
