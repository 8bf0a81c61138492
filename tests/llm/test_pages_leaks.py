"""Main text of pages, benchmark leaks, and the pipeline."""

import random
import re
import time

import numpy as np
import pyarrow as pa
from brute import CLASH, collected, edit_distance, frame, groups, repeated_words, sha

import corpus_pipeline
from barloom.llm import decontaminate as leak
from barloom.llm.html_text import extract, main_text
from barloom.llm.tables import written

SMALL = "/root/testdata/sf0.001"


def test_main_text():
    page = (
        '<!DOCTYPE html><html><head><title>x</title><script>var a="</p><p>no</p>";</script></head><body><header>Site name</header>'
        '<nav><ul><li><a href="/">Home</a></ul></nav><div id=wrap><div class="post"><h2>A &amp; B</h2><div><p>One,  two,\nthree &lt;words&gt; here'
        "<p>Second&nbsp;para<br>line</div><ul><li>a item<li>b item</ul></div><div class='comments'><p>nice, post, indeed, very</div>"
        '<div class="sidebar"><p>more, more, more</div></div><form><p>mail, please</form><footer>&copy; all, of, us</footer>'
    )
    assert main_text(page) == "A & B\nOne, two, three <words> here\nSecond para line\na item\nb item"


def test_odd_pages():
    assert main_text(None) == main_text("") == ""
    assert main_text("just text & more") == "just text & more"
    assert main_text("<p>a<p>b</p></div></p>") == "a\nb"
    assert main_text("<!-- never closed <p>x</p>") == ""
    assert main_text("<article><p>short<p>other</article><aside><p>long, long, long, long text of an advert</aside>") == "short\nother"
    assert main_text("<div>" * 3000 + "<p>deep" + "</div>" * 3000) == "deep"
    assert main_text("<p>" + "word " * 200000).count("word") == 200000
    assert main_text("<article><table><tr><td>a<td>b<tr><td>c</table></article>") == "a\nb\nc"
    for inside in ('p title="hidden gems"', 'div aria-label="show hidden rows"', 'p data-hidden="false"', 'p data-role="navigation"', "p title='class=ad'"):
        assert main_text(f"<article><p>one, two</p><{inside}>three, four</{inside[:3].strip()}></article>") == "one, two\nthree, four"
    assert main_text("<article><p>one, two</p><p hidden>gone</p><p style='display: none'>gone</p><p HIDDEN=''>gone</p></article>") == "one, two"
    assert main_text('<article><p>see <a href="/x?id=ad">this page</a> for more</p></article>') == "see this page for more"
    assert main_text("<p>a</p> b <c") == "a\nb <c"
    assert main_text("<p>a</p> b <!-- c") == main_text("<p>a</p> b <!-- c > d") == main_text("<p>a</p> b <script>x > y") == "a\nb"


def test_time_of_malformed_pages():
    """Pages of 500 KB that no tag ends, or that nest without end, take seconds, not hours."""
    for page in ("<a " * 170_000, "<a '" * 120_000 + ">", "<div>a, b" * 50_000, "<p><b>" * 80_000, "<li><i>" * 70_000, "</x>" * 120_000, "<!-" * 170_000, "&amp" * 120_000):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 20


def test_article_in_doubtful_wrappers():
    """Words like sidebar on a wrapper of the article don't drop it; parts of that name still go."""
    body = "".join(f"<p>Sentence {i}, with commas, and some more words to make it long enough.</p>" for i in range(6))
    want = [f"Sentence {i}, with commas, and some more words to make it long enough." for i in range(6)]
    more = (
        '<div class="sidebar"><p>more, more, more</p></div><div class="related"><article><p>teaser, one</p></article></div>'
        '<div id="comments"><article class="comment-body"><p>nice, post</p></article></div>'
    )
    for name in ("content-sidebar-wrap", "layout has-sidebar", "no-sidebar", "with-nav", "ad-free", "page-share", "comments-open", "header-fixed"):
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<h1>Title</h1>{body}", body, f'<div class="post">{body}</div>'):
            for page in (f'<div class="{name}">{inner}</div>', f'<div class="{name}">{inner}{more}</div>', f'<div class="{name}">{inner}</div>{more}'):
                for top in (page, f"<html><body><div class='banner'><p>Shop</p></div><p>Intro.</p>{page}", f'<div class="{name}"><div id="{name}">{page}</div></div>'):
                    got = [x for x in main_text(top).split("\n") if x not in ("Title", "Intro.")]
                    assert got == want, (top, got)
        assert main_text(f'<article class="{name}">{body}</article>{more}').split("\n") == want
    replies = '<div class="comments">' + "<p>me, too, and so on, and on, and on, and on, for long</p>" * 12 + "</div>"
    assert main_text(f'<div class="post">{body}</div>{replies}').split("\n") == want
    assert main_text(f"<div><div>{body}</div>{replies}</div>").split("\n") == want
    assert main_text(f"<article>{body}</article>{replies}").split("\n") == want


def test_pages(spark):
    df = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = extract(df).collect()
    assert len(rows) == df.count() and all(r.n_chars == len(r.text) and "  " not in r.text for r in rows)
    for r, p in zip(sorted(rows), sorted(df.collect())):
        body = re.search("<article>(.*?)</article>", p.html, re.S)
        assert body and r.text.split("\n")[-1].split(" ")[0] in body[1]
    odd = spark.createDataFrame([(1, "u", None), (None, None, "<p>x"), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string").selectExpr(
        "*", *(f"cast(null as {c.split(' ')[1]}) as `{c.split(' ')[0]}`" for c in CLASH.split(", ")),
    )
    assert collected(extract(odd)) == sorted([(1, "u", "", 0), (None, None, "x", 1), (2, "u", "", 0), (2, "u", "", 0)], key=str)
    assert extract(odd.limit(0)).count() == 0


def _plain(text):
    return re.sub(r"[!-/:-@\[-`{-~]", " ", text.lower()).split()


def _planted(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 9, 15, 24, 40])))) for i in range(60)]
    docs = []
    for i in range(240):
        lone = lambda: [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        body = _plain(items[i % 60][1])
        for _ in range(rng.randrange(leak.edits_allowed(len(body)) + 3) if i % 4 else 0):
            at, kind = rng.randrange(len(body)), rng.random()
            body[at:at + 1] = [f"z{rng.random()}"] if kind < 0.5 else [] if kind < 0.75 else [body[at], "extra"]
        docs.append((i, " ".join(lone()) + ", " + " ".join(body).upper() + ". " + " ".join(lone()) if i % 5 else " ".join(lone())))
    return items, docs


def test_leaks(spark):
    items, docs = _planted()
    docs += [(900, None), (901, ""), (None, items[3][1]), (4, docs[4][1])]
    items += [(100, None), (101, ""), (102, "too short"), (None, items[5][1])]
    found = leak.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in found}
    want = {}
    for d, t in docs:
        for i, x in items:
            words = _plain(x or "")
            if len(words) >= leak.LEAST_WORDS and (n := edit_distance(words, _plain(t or ""))) <= leak.edits_allowed(len(words)):
                want[d, i] = n
    assert set(got) <= set(want) and all(want[k] == n for k, n in got.items())
    assert {k for k, n in want.items() if n == 0} <= set(got)
    assert len(got) >= 0.97 * len(want) and len(want) > 100
    texts = dict(docs)
    for r in found:
        assert 0 <= r.first_word <= r.end_word <= len(_plain(texts[r.doc_id] or "")) or r.doc_id in (None, 4)


def test_leaks_at_edges():
    """Items that lose one to k words, alone in a text or at its start or end: all are found."""
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, [rng.choice(vocabulary) for _ in range(5 + i)]) for i in range(56)]
    bench = leak.Items([(i, " ".join(w)) for i, w in items])
    texts, want = [], {}
    for i, w in items:
        for gone in range(1, leak.edits_allowed(len(w)) + 1):
            out = rng.sample(range(len(w)), gone)
            for places in (range(gone), range(len(w) - gone, len(w)), out):
                left = [x for j, x in enumerate(w) if j not in places]
                lone = [f"z{rng.random()}" for _ in range(rng.randrange(30))]
                for text in (left, left + lone, lone + left):
                    want[len(texts), i] = edit_distance(w, text)
                    texts.append(" ".join(text))
    found = {(t, i): d for t, i, _, d, _, _ in bench.search(*leak.plain_words(pa.array(texts)))}
    assert len(want) > 2000 and {key: found.get(key) for key in want} == want


def test_short_and_spaceless_items():
    """Items under five words are found as they stand; without spaces the characters count."""
    items = ["Twelve apples", "why", "红楼梦里有多少首诗词", "ประเทศไทย", "a b c d"]
    texts = ["we had twelve, apples!", "so WHY not", "twelve big apples", "问:红楼梦里有首诗词?", "日本語の文", "xประเทศไทยx y", "a b d", "", "a b c d", None]
    bench = leak.Items(list(enumerate(items)))
    found = {(t, i, d) for t, i, _, d, _, _ in bench.search(*leak.plain_words(pa.array(texts)))}
    assert found == {(0, 0, 0), (1, 1, 0), (3, 2, 2), (5, 3, 0), (8, 4, 0)}


def test_slices_and_empty(spark, monkeypatch):
    items, docs = _planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = collected(leak.leaks(frame(spark, docs), bench))
    monkeypatch.setattr(leak, "SLICE_BYTES", 1000)
    assert collected(leak.leaks(frame(spark, docs), bench)) == whole
    assert leak.leaks(frame(spark, []), bench).count() == 0 and leak.leaks(frame(spark, docs), bench.limit(0)).count() == 0
    bad = {r[0] for r in whole}
    assert {r.doc_id for r in leak.clean(frame(spark, docs), bench).collect()} == {d for d, _ in docs} - bad


def test_best_match():
    rng = random.Random(8)
    for _ in range(200):
        item, region = ([rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        n, a, b = leak.best_match(np.array(item, np.uint64), np.array(region, np.uint64))
        assert n == edit_distance(item, region) and 0 <= a <= b <= len(region)
        whole = [list(range(len(item) + 1))]
        for j, y in enumerate(region[a:b], 1):
            row = [j]
            for i, x in enumerate(item, 1):
                row.append(min(row[-1] + 1, whole[-1][i] + 1, whole[-1][i - 1] + (x != y)))
            whole.append(row)
        assert whole[-1][-1] == n


def test_pipeline_stages(spark):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = written(spark, stage(spark, docs, SMALL), name)
        if name == "minhash_near_dedup":
            assert {r.doc_id for r in out.collect()} == {d for d, _, _, stays in groups(rows) if stays}
        elif name == "substring_dedup":
            got = sorted((r.doc_id, sha(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text)).encode())) for r in out.collect())
            assert got == sorted((d, digest) for d, _, _, digest in repeated_words(rows))
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            left = {r.doc_id for r in out.collect()}
            for d, t in rows:
                exact = any(x in t for _, x in items)
                assert not (exact and d in left)
        elif name == "packing":
            assert {r.doc_id for r in out.collect()} == {d for d, _ in rows}
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS) and dict(out.dtypes) == dict(docs.dtypes)
        kept[name] = out.count()
        docs = out
    assert kept["quality_classifier"] > 100 and corpus_pipeline.run(spark, SMALL).count() > 0


def test_names(spark):
    names, before = leak.plain_words(pa.array(["A b.", None, "", "a B"]))
    assert before.tolist() == [0, 2, 2, 2, 4] and names[:2].tolist() == names[2:].tolist()
