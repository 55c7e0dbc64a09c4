"""Manifest, source divergence and HTML extraction against brute force and edge rows."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from turnstile.llm import divergence, html_text, manifest, queries

# --- Merkle manifest -------------------------------------------------------------------


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def _path(levels, place):
    out = []
    for level in levels[:-1]:
        beside = place ^ 1
        out.append(level[beside] if beside < len(level) else None)
        place //= 2
    return out


def brute_manifest(rows):
    """rows of (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof digest)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, _h(*map(_field, r)), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = _tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        above = [s for s in _path(top, k) if s]
        for place, x in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            proof = [s for s in _path(trees[g], place) if s] + above
            out.append((x[3][0], x[2], trees[g][-1][0], top[-1][0], _h(*proof)))
    return sorted(out, key=str)


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def _made(df):
    made = manifest.manifest(df, also={"again": manifest.leaf_digest("doc_id", "source", "lang", "n_chars", "text")})
    return made.withColumn("folded", manifest.fold("again")).withColumn("proof", F.sha2("siblings", 256)).collect()


def test_manifest_of_several_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    langs = ["en"] * 2300 + ["de"] * 1024 + ["fr"] * 1025 + ["", None, "zz", "é", "日本"] + ["es"] * 7
    rows = [(int(i), f"s{rng.integers(0, 3)}", lang, int(rng.integers(0, 99)), f"text {i} é") for i, lang in enumerate(rng.permutation(np.array(langs, dtype=object)))]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (None, "s", "en", 1, ""), rows[0], rows[0]]
    got = _made(spark.createDataFrame(rows, FIELDS).repartition(7))
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got], key=str) == brute_manifest(rows)
    assert all(r.folded == r.root for r in got)
    places = defaultdict(list)
    for r in got:
        places[r.grp].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


@pytest.mark.parametrize("n", [1, 3])
def test_manifest_of_one_group_and_of_single_leaves(spark, n):
    for rows in ([(i, "s", "en", i, "t") for i in range(n)], [(i, "s", f"l{i}", i, "t") for i in range(n)]):
        got = _made(spark.createDataFrame(rows, FIELDS))
        assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got], key=str) == brute_manifest(rows)


def test_manifest_of_edge_rows_and_of_none(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in edge_docs.collect()]
    got = _made(edge_docs)
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got], key=str) == brute_manifest(rows)
    assert _made(no_docs) == []


def test_tampered_rows_fail_and_only_these(spark):
    got = queries.op12_merkle_manifest(spark, SF_SMALL).collect()
    docs = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    import zlib
    for r in got:
        changed = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and docs[r.doc_id] is not None
        assert r.verified == (not changed) and (r.folded_root == r.root) == r.verified


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70))
def test_sweeps_of_one_block(n):
    digests = [_h(str(i)) for i in range(n)]
    sweep = manifest.Sweep(digests, manifest.height(n))
    levels = _tree(digests)
    assert sweep.nodes == levels
    for place, (siblings, sides) in enumerate(sweep.proofs("above", "L")):
        path = _path(levels, place)
        assert siblings == "".join(s for s in path if s) + "above"
        assert sides == "".join("-" if s is None else "R" if (place >> k) % 2 == 0 else "L" for k, s in enumerate(path)) + "L"


# --- source divergence -------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute_divergence(rows, least=3, ranks=200):
    """rows of (text, lang, source)."""
    by_lang = defaultdict(list)
    for t, lang, s in rows:
        by_lang[lang or ""].append((_terms(t), s or ""))
    out = []
    for lang, docs in by_lang.items():
        held = Counter(t for words, _ in docs for t in set(words))
        kept = [t for t, n in held.items() if n >= least]
        counts = {s: Counter() for _, s in docs}
        for words, s in docs:
            counts[s].update(t for t in words if held[t] >= least)
        total = sum(counts.values(), Counter())

        def share(c):
            n = sum(c.values())
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        for s in counts:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            over = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", over, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:top])]
    return sorted(out)


def _audited(df, **kw):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(df, **kw).collect())


def test_divergence_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    words = [f"{'x' * int(rng.integers(0, 30))}wörd{chr(97 + i % 26)}{'日本' if i % 7 == 0 else ''}{chr(97 + i // 26)}" for i in range(300)] + ["A", "a", "É", "é", "Aa"]
    rows = []
    for i in range(400):
        picked = [words[k] for k in rng.zipf(1.3, rng.integers(0, 60)) % len(words)]
        rows.append((", ".join(picked) if i % 11 else None, ["en", "de", None][int(rng.integers(0, 3))], [None, "s1", "s2", "s3"][min(3, int(rng.integers(0, 7)))]))
    rows += [("lone", "xx", "a"), ("", "xx", "b"), (None, "yy", "only")] + [("same same text", "en", "s1")] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert _audited(df) == brute_divergence(rows)
    assert _audited(df, min_documents=1, term_ranks=3) == brute_divergence(rows, 1, 3)


def test_divergence_of_edge_rows_and_of_none(spark, edge_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in edge_docs.collect()]
    assert _audited(edge_docs) == brute_divergence(rows)
    assert _audited(no_docs) == []


def test_very_long_texts_and_terms(spark):
    long_term = "x" * 1_500_000
    rows = [(long_term + " b " + "word " * 300_000, "en", f"s{k}") for k in range(2)] + [(long_term[:-1] + "y", "en", "s0"), (long_term, "en", "s1")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert _audited(df, min_documents=2) == brute_divergence(rows, 2)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abAB é-9中", max_size=40), max_size=30))
def test_pointer_sort_orders_and_groups(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    starts, ends, rows = divergence.terms(data, offs)
    found = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    assert found == [t.encode() for x in texts for t in TERM.findall(x)]
    order, first = divergence.sort_pointers(data, starts, ends)
    runs = [found[i] for i in order]
    assert runs == sorted(runs)
    assert first.tolist() == [k == 0 or runs[k] != runs[k - 1] for k in range(len(runs))]


def test_pivot_split_of_large_slices(monkeypatch):
    monkeypatch.setattr(divergence, "SMALL", 8)
    rng = np.random.default_rng(1)
    texts = ["prefixprefix" * int(rng.integers(0, 3)) + "".join(rng.choice(list("ab"), rng.integers(1, 12))) for _ in range(3000)]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    starts, ends, _ = divergence.terms(data, np.array([0, len(data)]))
    order, first = divergence.sort_pointers(data, starts, ends)
    assert [texts[i] for i in order] == sorted(texts)
    assert first.sum() == len(set(texts))


def test_pair_sums_in_several_tables(monkeypatch):
    rng = np.random.default_rng(2)
    has = rng.random((40, 5)) < 0.4
    share = np.where(has, rng.integers(1, 10 ** 9, has.shape), 0)
    zero = rng.integers(1, 100, 5)
    term, source = np.nonzero(has)
    full = np.where(has, share, zero[None, :])
    full = full[has.any(1).nonzero()[0]]
    codes = np.unique(term, return_inverse=True)[1]
    want = np.array([[sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(full[:, i], full[:, j])) for j in range(5)] for i in range(5)])
    for cells in (1, 17, 1 << 20):
        monkeypatch.setattr(divergence, "CELLS", cells)
        assert (divergence.pair_sums(codes, source, share[has], zero) == want).all()


# --- HTML extraction -----------------------------------------------------------------------

FRAME = """<!DOCTYPE html><html><head><title>Site</title><style>p{margin:0}</style><script>var t="</p><p>no</p>";</script></head>
<body><header><h1>Site name</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div class="cookie-notice">We use cookies and so on and on and on.</div><div id="sidebar-left"><p>Sidebar words, several of them, here.</p></div>
%s
<form><p>Your name</p><input name=n><button>Send</button></form><aside>Aside text that is long enough to be seen.</aside>
<div class="advert">Buy this now, it is very cheap and very good.</div>
<section id="commentList"><p>A reader's long comment, which goes on and on about the matter at hand.</p></section>
<footer>&copy; Site</footer></body></html>"""
BLOCKS = ["A headline &amp; more", "First paragraph with a good number of words in it,\n  over two lines.", "Short.",
          "Third   <b>bold <i>nested</i></b> paragraph&nbsp;with <a href=z>a link</a> and words &lt;enough&gt;.", "1 < 2 &#233;"]
WANT = "A headline & more\nFirst paragraph with a good number of words in it, over two lines.\nShort.\n" \
       "Third bold nested paragraph with a link and words <enough>.\n1 < 2 é"


def _body(open_, close, p="<p>%s</p>"):
    return open_ + f"<h1>{BLOCKS[0]}</h1>" + "".join(p % b for b in BLOCKS[1:]) + close


@pytest.mark.parametrize("body", [
    _body("<article>", "</article>"), _body("<main>", "</main>"), _body("<ARTICLE class='post header'>", "</ARTICLE>"),
    _body("<div class='post'>", "</div>"), _body("<div class=a><div class=b>", "</div></div>"), _body("<article>", "</article>", "<p>%s"),
    _body("<article><div><section>", "</section></div></article>"),
    _body("<article>", "<div class=share>Share this</div><article><p>A nested comment article.</p></article></article>")])
def test_main_text_of_framed_pages(body):
    assert html_text.main_text(FRAME % body) == WANT


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("   \n", ""), ("<p></p>", ""), ("plain words", "plain words"), ("<article><p>One.</article>", "One."),
    ("<p>a<p>b", "a\nb"), ("<nav>only a menu</nav>", ""), ("<article></article><p>Body text.</p>", "Body text."),
    ("<article><p>x<br>y</p></article>", "x y"), ("<article><p>cut <b", "cut <b"), ("</p></div></article>", ""),
    ("<article><ul><li>one<li>two</ul></article>", "one\ntwo"), ("<article><p>a <span class=ad>buy</span> b</p></article>", "a b"),
    ("<article><p hidden>no</p><p>yes</p><template><p>no</p></template></article>", "yes")])
def test_main_text_of_odd_pages(html, want):
    assert html_text.main_text(html) == want


def test_long_and_deep_pages():
    long_ = "<article>" + "<p>" + "word " * 400_000 + "</p>" + "<p>end</article>"
    assert html_text.main_text(long_) == ("word " * 400_000).strip() + "\nend"
    deep = "<div>" * 50_000 + "<p>deep text</p>" + "</span>" * 50_000 + "</div>" * 50_000
    assert html_text.main_text(deep) == "deep text"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/abp!-=\"' &;#", max_size=80))
def test_any_text_is_parsed(html):
    html_text.main_text(html)


def test_every_page_is_extracted(spark):
    """Against a plain cut of the given pages, whose articles stand in article elements."""
    import html as entities
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = queries.op11_html_extraction(spark, SF_SMALL).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        body = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<[a-z/][^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_pages_with_nulls_clashes_and_none(spark):
    rows = [(None, None, None, 1), (1, "u", "<article><p>x</p></article>", 2), (1, "u", "<article><p>x</p></article>", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = html_text.extract(df).select("row.page_id", "row.text", F.col("text").alias("found")).collect()
    assert sorted((r.page_id or 0, r.text, r.found) for r in got) == [(0, 1, ""), (1, 2, "x"), (1, 2, "x")]
    assert html_text.extract(df.where("false")).count() == 0
