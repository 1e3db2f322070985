"""Main text, aligned tokens and periodic runs against plain versions, and their defined cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from . import brute
from .test_llm import docs_of, words


# Periodic runs


def made_words(rng):
    kind, k = rng.random(), rng.choice([1, 2, 3, 5])
    n = rng.choice([0, 1, 5, 8, 20, 40, 90])
    if kind < 0.4:
        return [rng.randrange(k) for _ in range(n)]
    if kind < 0.8:
        base = [rng.randrange(k + 1) for _ in range(rng.randint(1, max(1, n // 4)))]
        w = [rng.randrange(3) for _ in range(rng.randint(0, 5))] + (base * (n // len(base) + 1))[:n] + [rng.randrange(3) for _ in range(rng.randint(0, 9))]
        if w and rng.random() < 0.4:
            w[rng.randrange(len(w))] = 7
        return w
    return ([rng.randrange(2)] * rng.randint(1, 9) * rng.randint(1, 5) + [9]) * rng.randint(1, 8)


def test_runs_equal_all_pairs_of_positions():
    from seqsieve.llm import periodic

    rng = random.Random(3)
    for _ in range(600):
        docs = [made_words(rng) for _ in range(rng.randint(1, 4))]
        ends = np.cumsum([len(d) for d in docs])
        got = [[] for _ in docs]
        for doc, start, end, q in periodic.runs_of(np.array([x for d in docs for x in d], np.int64), ends).tolist():
            begin = int(ends[doc]) - len(docs[doc])
            if end - start >= 6:
                got[doc].append((start - begin, end - start, q))
        assert [sorted(g) for g in got] == [brute.runs(d) for d in docs]


def test_long_periods_and_no_runs():
    from seqsieve.llm import periodic

    one = np.resize(np.random.default_rng(0).integers(0, 2000, 10_007), 100_000)
    assert periodic.runs_of(one, np.array([len(one)])).tolist() == [[0, 0, 100_000, 10_007]]
    a, b = "a", "ab"
    while len(b) < 20_000:
        a, b = b, b + a  # a Fibonacci word has cubes but no fourth powers
    assert not len(periodic.runs_of(np.frombuffer(b.encode(), np.uint8).astype(np.int64), np.array([len(b)])))
    assert not len(periodic.runs_of(np.zeros(0, np.int64), np.array([0, 0])))


@pytest.fixture(scope="module")
def run_rows():
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in made_words(rng))) for i in range(120)]
    rows += [(200 + i, words(40 + i, i, 3)) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \t\x0b\n"), (None, "a " * 12), (304, "  lead a a\x0ca a a a\ttrail "), (305, "é\xa0x " * 9), (306, "A a " * 5), (307, words(3000, 1) + " " + "x y z " * 4000)]
    return rows + [rows[3], rows[3]]


def test_find_runs(spark, run_rows):
    from seqsieve.llm import periodic

    out = periodic.find_runs(docs_of(spark, run_rows), tail=periodic.stated_tail).collect()
    assert len(out) == len(run_rows)
    left = Counter()
    for r in out:
        left[r.doc_id, r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed] += 1
        assert r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{x.start},{x.length},{x.period}\n" for x in r.runs).encode()).hexdigest()
    planted = 0
    for doc_id, text in run_rows:
        w = brute.WORD.findall(text or "")
        tail = brute.repeated_tail(doc_id, w)
        planted += tail != w
        found = brute.runs(tail) if len(tail) < 500 else [(r.start, r.length, r.period) for r in next(x for x in out if x.doc_id == doc_id).runs]
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        left[doc_id, len(w), len(found), *best, 1000 * best[1] // best[2] if found else None, tuple(found), brute.collapsed(tail, found)] -= 1
    assert planted > 5 and not any(left.values())
    long = next(x for x in out if x.doc_id == 307)
    assert (3000, 12_000, 3) in [(x.start, x.length, x.period) for x in long.runs]
    assert periodic.find_runs(docs_of(spark, [])).count() == 0


def test_runs_query(spark, tmp_path, run_rows):
    from seqsieve.llm import queries

    docs_of(spark, run_rows).write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op13_synchronising_runs(spark, str(tmp_path)).collect():
        if r.doc_id == 304:
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 1, 6, 1, 6000)
            assert r.collapsed_sha256 == hashlib.sha256(b"lead a trail").hexdigest()
        if r.doc_id in (300, 301, 302):
            empty = hashlib.sha256(b"").hexdigest()
            assert (r.n_runs, r.start, r.runs_sha256, r.collapsed_sha256) == (0, None, empty, empty)


# Aligned tokens


ODD = ["a  b", "a \n b", " lead", "trail ", "trail  ", "x\n\ny  \n z", " ", "  ", "\n", "日本語 テスト　全角 x", "é a b c", "<s> </s> <|endoftext|> <0x41> <unk>", "x ▁y", "a▁b", "y" * 3000, "don't  we'll 've it's 'S", "a\x1cb \x1c c\x1d d", "\t a\t b", "​ x ​", "🙂🙂 ﬂﬁ ½", "a\x85b \x85c", "\xa0x \xa0y", "aaaaa" + " " * 40 + "b ", None, "", "x ́y"]


def odd_texts(n):
    rng = random.Random(0)
    parts = ["a", "b", " ", "  ", "\n", "é", "日", "'s", "\xa0", "🙂", "1", ".", " the", " The", "́", "\t", "\x1c", "ing", "\r\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_pointer_jumping_finds_common_ends():
    from seqsieve.llm import alignment

    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 5000):
        a, b = (np.unique(np.append(rng.integers(1, 3 * n + 1, n), 3 * n + 1)) for _ in range(2))
        group_a, group_b = alignment.group_ends(a, b)
        common = np.intersect1d(a, b)
        assert np.array_equal(b[group_a], common[np.searchsorted(common, a)]) and np.array_equal(b[group_b], common[np.searchsorted(common, b)])
    chain = np.arange(2, 4001, 2)  # one group only: the tokens end at different offsets until the last
    group_a, group_b = alignment.group_ends(np.append(chain - 1, 4000), chain)
    assert set(group_a) == set(group_b) == {len(chain) - 1}


def test_aligned_tokens(spark):
    from seqsieve.llm import alignment
    from seqsieve.llm.tokens import vocabulary_path

    texts = ODD + odd_texts(300) + [words(300, i) for i in range(5)] + [words(300, 1).title(), words(20_000, 8)]
    rows = list(enumerate(texts)) + [(None, "some words"), (1, texts[1]), (1, texts[1])]
    plain = brute.aligned([t for _, t in rows])
    count = Counter(x for p in plain if p for x in p[1])
    top = Counter()
    for (a, b), n in count.items():
        top[b] = max(top[b], n)
    want = Counter()
    for (doc_id, text), p in zip(rows, plain):
        groups, links = p or ([], [])
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in groups)
        n_best = sum(count[x] == top[x[1]] for x in links)
        want[doc_id, sum(len(a) for a, _, _ in groups), sum(len(b) for _, b, _ in groups), len(groups), len(links), n_best, sum(count[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if shown else "", shown, tuple(c for _, _, c in groups)] += 1
    own = alignment.align(docs_of(spark, rows), a_path=vocabulary_path(alignment.A_VOCABULARY), b_path=vocabulary_path(alignment.B_VOCABULARY))
    got = Counter((*r[:9], tuple(r.cuts)) for r in own.collect())
    assert got == want and sum(p is None for p in plain) == 4
    assert alignment.align(docs_of(spark, []), a_path=vocabulary_path(alignment.A_VOCABULARY), b_path=vocabulary_path(alignment.B_VOCABULARY)).count() == 0


def test_stretches_are_forgotten_without_harm():
    from seqsieve.llm import alignment
    from seqsieve.llm.tokens import vocabulary_path

    paths = vocabulary_path(alignment.A_VOCABULARY), vocabulary_path(alignment.B_VOCABULARY)
    small, large = alignment.Stretches(*paths, keep=20), alignment.Stretches(*paths)
    for seed in range(4):
        texts = [words(50, seed, 60).encode(), b"", b"\xff bad", words(30, seed + 9, 60).encode()]
        a, b = (alignment._aligned(x, texts, True) for x in (small, large))
        assert np.array_equal(a[0], b[0]) and a[1] == b[1] and a[2] == b[2]
        assert a[0][2].tolist() == [0, 0, 0, 0, 0] and a[1][2] == ""


def test_alignment_query(spark, tmp_path):
    from seqsieve.llm import queries

    docs_of(spark, [(1, "same words here"), (2, "same words"), (3, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in queries.op12_pointer_jump_alignment(spark, str(tmp_path)).collect()}
    assert (out[3].n_a, out[3].n_links, out[3].n_best, out[3].count_sum, out[3].groups_sha256) == (0, 0, 0, 0, "")
    assert out[1].count_sum == out[2].count_sum + 1 and out[1].n_best == out[1].n_links == 3


# Main text

LONG = ["This is the first paragraph, which has some words in it; and some more.", "The second one, no less long than the first, goes on and on. It ends here.", "A third paragraph, at last, says nothing new: it is there, that is all."]


@pytest.mark.parametrize(
    "before, article, after",
    [
        ("<nav><ul><li><a href=/>Home, sweet home.</a></ul></nav>", "<article><h1>Title</h1>{}</article>", "<footer>All rights, reserved. Really, all.</footer>"),
        ("<div id=header><a href=/>Logo</a></div><div class='top-menu'><a>One</a> | <a>Two</a></div>", "<div id=content><h1>Title</h1>{}</div>", "<div class=footer><p>A long text of the footer, with marks. And so on, on.</p></div>"),
        ("<table><tr><td><a href=1>One</a><td><a href=2>Two</a></table>", "<main><div><h2>Title</h2>{}</div></main>", "<section class=comments><article class=comment><p>I like this, and that. And more, of it.</p></article></section>"),
        ("<form><p>Enter words, many of them, please. Do it now.</p></form>", "<div class=x17><div class=y><h3>Title</h3>{}</div></div>", "<div class=z9>&copy; 2020 Some Company</div><p class=cookie-notice>We use cookies, as all do. You agree, of course.</p>"),
        ("<script>if (a < b) document.write('<p>No text, at all.</p>')</script><style>p > a {{}}</style><!-- <p>No, no. -->", "<div class=post><header><h1>Title</h1></header>{}</div>", "<aside><p>Something, that stands aside. As it is, always.</p></aside><div hidden>Nobody, sees this. Never.</div>"),
        ("", "<section><h1>Title</h1>{}<section><h2>3 Comments</h2><p>A comment, of some length. It is, what it is.</p></section></section>", "<div class=ad>Buy this, now. Or that, later.</div>"),
    ],
)
@pytest.mark.parametrize("closed", ["</p>", ""])
def test_templates(before, article, after, closed):
    from seqsieve.llm import main_text

    page = f"<!DOCTYPE html><html><head><title>T</title></head><body class=has-sidebar>{before}{article}{after}"
    body = "".join(f"<p>{x}{closed}" for x in (LONG[0], "Short.", LONG[1].replace("less", "<b>le</b>ss"), LONG[2].replace(" at", "\n\t<i>at</i>")))
    assert main_text.extract(page.format(body)) == "\n".join(["Title", LONG[0], "Short.", LONG[1], LONG[2].replace(" at", " at")])


def test_markup():
    from seqsieve.llm import main_text

    for page, text in {
        "": "", "<nav>a, b.</nav>": "", "just text &amp; &lt;b&gt; 1 < 2": "just text & <b> 1 < 2", "<p title='a>b' x=\"c > d\" y=z>Text": "Text", "<p>&eacute;&#233;&#xe9;&nbsp;&copy x": "ééé © x", "<p>x <!-- never": "x", "<p>a<br>b": "a b",
        "<p>one<p>two</div></p>three": "one\ntwo\nthree", "<article><ul><li>a<li>b</ul><p>Some words, here.": "a\nb\nSome words, here.", "<p>ends in <a href=": "ends in", "<SCRIPT>x</SCRIPT><P>Y</P>": "Y", "<p>a<textarea>b</p></textarea>c": "a\nc",
    }.items():
        assert main_text.extract(page) == text, page


@pytest.mark.parametrize("piece", ["<", "<p a=\"", "</p>", "<b", "<!--", "<script>", "<ul><li>", "<div>", "<p><button><div>", "<article>", "<form><h1>", "<a>", "<!x", "&amp", "<p x='\">"])
def test_reading_is_linear(piece):
    import time

    from seqsieve.llm import main_text

    began = time.time()
    main_text.extract(piece * 60_000)
    assert time.time() - began < 20


def test_path_ratios_choose_without_names():
    """Nothing but the paths' ratios tells the article from the rest."""
    from seqsieve.llm import main_text

    rest = "".join(f"<div><span>Item {i}</span></div>" for i in range(12))
    page = f"<body>{rest}<table><tr><td><p>{'<p>'.join(LONG)}</td></tr></table>{rest}"
    blocks = main_text._allowed(main_text._Reader(page).blocks)
    chosen, _ = main_text.content_paths(blocks)
    assert [b.text for b, c in zip(blocks, chosen) if c] == LONG
    assert main_text.extract(page) == "\n".join(LONG)


def test_main_text_query(spark, tmp_path):
    import pyarrow.parquet as pq

    from seqsieve.llm import queries

    own = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    rows = [(r["page_id"], r["url"], r["html"], 1) for r in own] + [(None, None, None, 1), (10**9, "u", "", 2), (10**9, "u", "", 2), (-1, "long", "<article>" + "<p>Words, of text." * 30_000, 3)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter(map(tuple, queries.op11_tag_path_ratios(spark, str(tmp_path)).collect()))
    want = Counter()
    for page_id, url, html, _ in rows:
        text = "" if not html else "\n".join(["Words, of text."] * 30_000) if url == "long" else brute.page_text(html)
        want[page_id, url, text, len(text)] += 1
    assert got == want
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "none/pages.parquet"))
    assert queries.op11_tag_path_ratios(spark, str(tmp_path / "none")).count() == 0
