"""Near-duplicates, phrases, licenses, rules, classifier and pages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from treeloom.llm import bk_trees, co_training, license_scan, ngram_ratio, phrase_index, tag_paths

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# Near-duplicates -------------------------------------------------------------------------


def fingerprint(text):
    w = BLANK_WORDS.findall(lower(text))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(fps, radius):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(fps))]


def test_near_duplicates(spark, docs):
    rows = docs.collect()
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in bk_trees.near_duplicates(docs).collect()), key=repr)
    fps = [fingerprint(r.text) for r in rows]
    root = reachable(fps, 3)
    least = {t: min((r.doc_id for r, u in zip(rows, root) if u == t and r.doc_id is not None), default=None) for t in root}
    assert got == sorted(((r.doc_id, f, least[t]) for r, f, t in zip(rows, fps, root)), key=repr)


def test_components_of_chains_and_balls():
    """Chains of fingerprints three bits apart, and a tight ball, in one shard and in many."""
    rnd = random.Random(5)
    fps = set()
    for _ in range(20):
        at = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            fps.add(at)
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                at ^= 1 << b
    centre = rnd.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rnd.sample(range(64), 3)) for _ in range(200)}
    fps = sorted(fps)
    signed = np.sort(np.array(fps, dtype=np.uint64).view(np.int64))
    want = reachable([int(x) & (2**64 - 1) for x in signed], 3)
    assert bk_trees.linked(np.zeros(len(signed), np.int64), signed, 3).tolist() == want


def test_links_hold_components_together(spark):
    rnd = random.Random(7)
    fps, at = [], rnd.getrandbits(63)
    for _ in range(40):
        fps.append(at)
        for b in rnd.sample(range(62), 3):
            at ^= 1 << b
    fps += [rnd.getrandbits(63) for _ in range(50)]
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp bigint")
    roots = {r.fp: r.root for r in bk_trees.components(bk_trees.links(df)).collect()}
    order = sorted(set(fps))
    want = reachable(order, 3)
    for f, t in zip(order, want):
        assert roots.get(f, f) == order[t]


def test_dense_shard_is_cut(spark):
    """Many distinct fingerprints around one: no shard stays above the bound, and no link is lost."""
    rnd = random.Random(6)
    centre = rnd.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 9))) for _ in range(1500)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    cut = bk_trees.shards(df, dense=100)
    assert cut.groupBy("shard").count().agg(F.max("count")).first()[0] <= 100
    roots = {r.fp: r.root for r in bk_trees.components(bk_trees.links(df, dense=100)).collect()}
    order = sorted(range(len(fps)), key=lambda i: signed[i])
    want = reachable([fps[i] for i in order], 3)
    assert [roots.get(signed[i], signed[i]) for i in order] == [signed[order[t]] for t in want]


def test_search_in_small_steps(monkeypatch):
    """The links are the same however few pairs are looked at together."""
    rnd = np.random.default_rng(7)
    fps = np.unique(rnd.integers(0, 1 << 12, 900))
    want = bk_trees.linked(np.zeros(len(fps), np.int64), fps, 1).tolist()
    monkeypatch.setattr(bk_trees, "VISITED", 64)
    assert bk_trees.linked(np.zeros(len(fps), np.int64), fps, 1).tolist() == want


def test_one_of_each(docs):
    kept = bk_trees.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = docs.collect()
    groups = reachable([fingerprint(r.text) for r in rows], 3)
    assert kept.count() == len(set(groups))


def test_near_duplicates_of_nothing(empty):
    assert bk_trees.near_duplicates(empty).count() == 0
    assert bk_trees.one_of_each(empty).count() == 0


# Benchmark phrases -----------------------------------------------------------------------


def phrase_hits(text, items):
    w = PLAIN_WORDS.findall(lower(text))
    hit, found = set(), set()
    for item, said in items:
        v = PLAIN_WORDS.findall(lower(said))
        for k in range(max(1, len(v) - 9)) if v else ():
            window = v[k : k + 10]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit)


def test_phrases(spark, docs):
    items = [
        (1, "quick brown fox jumps over the lazy dog and then as dogs do"),
        (10, "brown fox jumps over the LAZY dog and then as"),
        (10, "brown fox jumps over the LAZY dog and then as"),
        (2, "word"),
        (3, ""),
        (4, None),
        (None, "all day in the warm sun"),
        (5, "never seen anywhere at all in any of these texts here"),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    plain = docs.select("doc_id", "text")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.hit_items, r.contaminated) for r in phrase_index.judged(plain, bench).collect() if r.doc_id)
    assert got == sorted((r.doc_id, *phrase_hits(r.text, items)) for r in plain.collect() if r.doc_id)
    assert phrase_index.judged(plain, bench).count() == plain.count()
    assert phrase_index.judged(plain, bench.limit(0)).filter("contaminated").count() == 0
    assert phrase_index.judged(plain.limit(0), bench).count() == 0


def near_items(text, items, slop=5, share=0.8):
    """Items with a window of which a stretch of words holds enough terms, all places tried."""
    w, found = PLAIN_WORDS.findall(lower(text)), set()
    for item, said in items:
        v = PLAIN_WORDS.findall(lower(said))
        for k in range(max(1, len(v) - 9)) if v else ():
            terms = set(v[k : k + 10])
            length, needed = len(terms) + slop, -(-len(terms) * 4 // 5)
            if any(len(terms & set(w[i : i + length])) >= needed for i in range(len(w))):
                found.add(item)
    return found


def test_proximity(spark):
    """Against brute force: rarest words changed or absent, words moved, dropped and put between."""
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(str(i), " ".join([f"rare{i}", *rnd.choices(vocabulary, k=rnd.randint(2, 16))])) for i in range(12)] + [("e", ""), ("n", None), ("o", "w1 w2")]
    texts = [None, "", "w1", "zebra eats"]
    for _ in range(120):
        w = rnd.choices(vocabulary, k=rnd.randint(5, 30))
        said = rnd.choice(items[:12])[1].split()
        for _ in range(rnd.randint(0, 4)):
            change = rnd.randrange(4)
            at = rnd.randrange(len(said))
            if change == 0:
                said[at] = rnd.choice(vocabulary + ["unheard"])
            elif change == 1:
                said.insert(at, rnd.choice(vocabulary))
            elif change == 2 and len(said) > 2:
                said.pop(at)
            else:
                said.append(said.pop(at))
        cut = rnd.randrange(len(w))
        texts.append(" ".join(w[:cut] + said + w[cut:]))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(5, texts[5])], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {}
    for r in phrase_index.proximity_matches(docs, bench).collect():
        got.setdefault(r.doc_id, set()).add(r.item)
    want = {i: near_items(t, items) for i, t in enumerate(texts)}
    assert got == {i: found for i, found in want.items() if found} and len(got) > 30
    assert phrase_index.proximity_matches(docs.limit(0), bench).count() == 0
    assert phrase_index.proximity_matches(docs, bench.limit(0)).count() == 0


# Licenses --------------------------------------------------------------------------------


def shingles(text):
    w = PLAIN_WORDS.findall(lower(text))
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_licenses(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    filler = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    rows = []
    for i in range(96):
        _, text = license_scan.TEMPLATES[i % len(license_scan.TEMPLATES)]
        w = text.split()
        # Up to five words changed, in long templates well above the least containment.
        for _ in range(i // 17):
            w[rnd.randrange(len(w))] = "changed"
        rows.append((i, f"{filler(rnd.randint(0, 90))} {' '.join(w)} {filler(rnd.randint(0, 90))}"))
    rows += [(100, None), (101, ""), (102, "four words are few"), (103, filler(4000))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.license, round(r.contained, 6)) for r in license_scan.license_matches(docs, license_scan.default_templates(spark)).collect()}
    want = set()
    for i, text in rows:
        s = shingles(text)
        for name, template in license_scan.TEMPLATES:
            t = shingles(template)
            slack = -(-len(t) // 4)
            best = max((len(set(t) & set(s[max(0, a - slack) : a + len(t) + slack])) / len(set(t)) for a in range(-len(t), len(s))), default=0)
            if best >= 0.8:
                want.add((i, name, round(best, 6)))
    assert got == want
    assert license_scan.license_matches(docs.limit(0), license_scan.default_templates(spark)).count() == 0


def test_templates_of_a_folder(spark, tmp_path):
    whole = "\n".join(f"Clause {i} of this license says that thing number {i} may be done, and that others may not." for i in range(60))
    (tmp_path / "Own-1.0.txt").write_text(whole)
    (tmp_path / "Empty.txt").write_text("")
    templates = license_scan.folder_templates(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, f"before {whole} after"), (2, whole[:1500]), (3, "none")], "doc_id bigint, text string")
    found = [(r.doc_id, r.license, r.contained) for r in license_scan.license_matches(docs, templates).collect()]
    assert found == [(1, "Own-1.0", 1.0)]


# Quality ---------------------------------------------------------------------------------


def base(text):
    text = text or ""
    w = BLANK_WORDS.findall(text)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK_WORDS.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_base_counts(spark, docs):
    rnd = random.Random(2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(100 + i, "".join(rnd.choice(["a ", "b ", "a b c d e ", "\n", "x#\n", "  ", "é "]) for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = ngram_ratio.judged(df, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
        assert not (r.base_failed and r.kept)


def test_ratio_matches_counting(spark):
    """Scores worked out again from the same hashes."""
    rows = [(i, f"good words stand here {i} and there are many of them so all is well") for i in range(30)]
    rows += [(100 + i, f"bad### junk### stands### here### {i} and### there### is### much### of### it###") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 30, 2)] + [(0, 0, 0)], "doc_id bigint, quality int, toxic int")
    grams = {r.doc_id: r.g for r in ngram_ratio.base_counts(df).select("doc_id", ngram_ratio.grams(F.col("words_")).alias("g")).collect()}
    trusted = set(range(2, 30, 2))
    n, t = np.zeros(ngram_ratio.BUCKETS), np.zeros(ngram_ratio.BUCKETS)
    for i, g in grams.items():
        np.add.at(n, g, 1)
        np.add.at(t, g, i in trusted)
    weight = np.rint(1000 * np.log((t + ngram_ratio.SMOOTHING) / (n * t.sum() / n.sum() + ngram_ratio.SMOOTHING))).astype(int)
    for r in ngram_ratio.judged(df, labels).collect():
        assert r.score == weight[grams[r.doc_id]].sum() // len(grams[r.doc_id])
        assert r.kept == (r.doc_id < 100)


def test_filters_on_long_texts(spark):
    """Nothing is worked out anew below a filter, whichever column it is on."""
    text = " ".join(f"word{i % 900} and{i % 7}" for i in range(10_000))
    docs = spark.createDataFrame([(1, text), (2, "few")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    judged = ngram_ratio.judged(docs, labels)
    assert judged.filter("kept").count() + judged.filter("not kept").count() == 2
    assert [r.doc_id for r in judged.filter("n_repeat_words > 10 and n_words > 10").collect()] == [1]
    bench = spark.createDataFrame([(1, text[:3000])], "item_id bigint, text string")
    assert [r.doc_id for r in phrase_index.judged(docs, bench).filter("contaminated and n_hit > 5").collect()] == [1]


def test_classifier_probabilities_hold(spark):
    """On labels it has not seen, a view's sure calls are right as often as it says."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = co_training.judged(docs, labels.filter(~held_out)).join(labels.filter(held_out), "doc_id").toPandas()
    for view in ("p_text", "p_meta"):
        good = found[view].to_numpy()
        sure = (good >= co_training.SURE) | (good <= 1 - co_training.SURE)
        right = (good[sure] >= 0.5) == (found.quality[sure] == 1)
        assert not len(right) or right.mean() >= co_training.SURE - 0.03
        # The mean probability is near the share of good documents.
        assert abs(good.mean() - (found.quality == 1).mean()) < 0.08


def test_kept_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = co_training.kept_rows(plain, labels)
    assert kept.columns == plain.columns
    want = co_training.judged(plain, labels).filter("kept").select(plain.columns)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, want.collect()))


def test_rules_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert ngram_ratio.judged(empty.select("doc_id", "text"), none).count() == 0
    assert {r.score for r in ngram_ratio.judged(docs.select("doc_id", "text"), none).collect()} == {0}


def test_classifier_on_labels_it_has_not_seen(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    found = co_training.judged(docs, labels.filter(~held_out)).join(labels.filter(held_out), "doc_id").toPandas()
    assert len(found) > 100
    assert (found.kept == (found.quality == 1)).mean() > 0.97


@pytest.mark.parametrize("labels,kept", [([], True), ([(1, 1, 0)], True), ([(1, 0, 0)], False)])
def test_classifier_without_both_kinds(spark, docs, labels, kept):
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    found = co_training.judged(plain, known).collect()
    assert len(found) == docs.count() and {r.kept for r in found} == {kept}


def test_classifier_of_nothing(spark, empty):
    known = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert co_training.judged(empty.select("doc_id", "text"), known).count() == 0


# Pages -----------------------------------------------------------------------------------

PROSE = "Some real prose stands here, with commas. It goes on and on, as such text does."


@pytest.mark.parametrize(
    "source,text",
    [
        (None, ""),
        ("", ""),
        ("a &lt; b &amp; c", "a < b & c"),
        ("<script>var t='</p>'", ""),
        ("<!-- never ended", ""),
        ("<p>one<p>two <b>bo</b>ld<br>x", "one two bold x"),
        (f"<nav>menu</nav><article><h1>T</h1><p>{PROSE}<div class=ad>buy</div></article><footer>f</footer>", f"T {PROSE}"),
        (f"<div class='side-bar sidebar'>{PROSE}</div><div id=content><h2>T</h2><p>{PROSE}</p></div><div class=comments>{PROSE}</div>", f"T {PROSE}"),
        (f"<main><p>{PROSE}</p><form>{PROSE}<input></form><aside>{PROSE}</aside><div class='cookie-notice'>{PROSE}</div></main>", PROSE),
    ],
)
def test_main_text(source, text):
    assert tag_paths.main_text(source) == text


LONG = " ".join(f"<p>{PROSE} Part {i} of it says more, and then more.</p>" for i in range(8))
LONG_TEXT = re.sub("</?p>", "", LONG)
CARD = "<article><h2>Card</h2><p>Read this, too.</p></article>"


@pytest.mark.parametrize(
    "source",
    [
        f"<div><h2>T</h2>{LONG}</div>{CARD}",
        f"{CARD * 3}<div><h2>T</h2>{LONG}</div>{CARD * 3}",
        f"<article><h2>T</h2>{LONG}</article><div>{CARD * 4}</div>",
        f"<main><div><h2>T</h2>{LONG}</div>{CARD * 3}</main>",
        f"<main><h2>T</h2><article>{LONG}</article></main>",
    ],
)
def test_teaser_articles(source):
    assert tag_paths.main_text(f"<body>{source}</body>") == f"T {LONG_TEXT}"


@pytest.mark.parametrize(
    "source",
    [
        f"<div class='page has-sidebar'><article><h2>T</h2>{LONG}</article></div>",
        f"<div class='no-sidebar with-header'><article><h2>T</h2>{LONG}</article></div>",
        f"<article><h2 id=related-work>T</h2><div id='form-and-function'>{LONG}</div></article>",
        f"<article><section id='social-history'><h2 id='search'>T</h2>{LONG}</section><div class='share-box'>{PROSE}</div></article>",
        f"<div class='widget'><h2>T</h2>{LONG}<div class='sidebar'>{PROSE}</div></div><p class=ad>buy</p>",
    ],
)
def test_names_do_not_drop_content(source):
    assert tag_paths.main_text(f"<body>{source}</body>") == f"T {LONG_TEXT}"


@pytest.mark.parametrize(
    "aside",
    [
        f"<section id='comments'>{LONG * 5}</section>",
        f"<section id='comment-list'>{LONG}</section>",
        f"<div class='comment-body'>{LONG}</div><div class='comment-text'>{LONG}</div>",
        f"<div class='comments'>{LONG * 6}</div>",
        f"<div id='comments'>{'<article class=comment>' + LONG + '</article>'}</div>",
        f"<div class='footer'>{LONG * 6}</div>",
        f"<div class='footer-inner-text'>{LONG}</div>",
        f"<div class='ad-slot'>{LONG}</div><div class='sponsored-content'>{LONG * 4}</div>",
        f"<p class='ad'>{PROSE}</p><p class='sponsored'>{PROSE}</p>",
    ],
)
@pytest.mark.parametrize("page", ["<article><h2>T</h2>{}</article>{}", "<div id=content><h2>T</h2>{}</div>{}", "<main><h2>T</h2>{}{}</main>"])
def test_asides_of_any_size(page, aside):
    assert tag_paths.main_text(f"<body>{page.format(LONG, aside)}</body>") == f"T {LONG_TEXT}"


def test_paragraphs_of_the_article_stay():
    body = f"<h2>T</h2><p class='form'>{PROSE}</p><p class='search'>{PROSE}</p><p title='a hidden gem'>{PROSE}</p>{LONG}"
    assert tag_paths.main_text(f"<article>{body}</article>") == f"T {PROSE} {PROSE} {PROSE} {LONG_TEXT}"


@pytest.mark.parametrize(
    "source",
    [
        "<div><p>Some text, here.</p>" * 8000,
        "<a x='" * 40_000,
        "<a x='" * 40_000 + ">",
        "<a " * 60_000 + "'",
        "<p " + "a" * 200_000 + ">text",
        "<div class=ad>" * 8000 + "text",
        "<div>" * 8000 + "</b>" * 8000 + "text</span>" * 2000,
        "<b>" * 8000 + "<li>x" * 2000,
        "<!-" * 50_000,
        "<p>" + "&amp" * 50_000,
    ],
)
def test_hostile_pages_in_linear_time(source):
    import time

    begin = time.process_time()
    tag_paths.main_text(source)
    assert time.process_time() - begin < 2


@pytest.mark.parametrize(
    "source,text",
    [
        ("<p title='a > b'>one</p><p title=\"it's\">two</p>", "one two"),
        ("<p title='never closed>one</p><p>two</p>", "one two"),
        ("1 < 2 and <3", "1 < 2 and <3"),
        ("<p>a<!-- > -->b<![CDATA[ > ]]>c<!doctype x>d", "abcd"),
        ("<p>a <a b", "a <a b"),
    ],
)
def test_markup_as_it_stands(source, text):
    assert tag_paths.main_text(source) == text


def test_equal_articles_stay():
    assert tag_paths.main_text(f"<body><div><article>{LONG}</article><article>{LONG}</article></div></body>") == f"{LONG_TEXT} {LONG_TEXT}"


def test_pages(spark):
    rows = [(1, "u", f"<article>{'<p>long text, long.</p>' * 20000}</article>"), (2, None, None), (2, None, None), (None, "v", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("mine"))
    got = {(r.page_id, r.n_chars) for r in tag_paths.extract(pages).collect()}
    assert got == {(1, 20000 * 17 - 1), (2, 0), (None, 1)}
    assert tag_paths.extract(pages).count() == 4
    assert tag_paths.extract(pages.limit(0)).count() == 0


def test_article_of_every_given_page(spark):
    import html

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert tag_paths.main_text(r.html) == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())


def test_sha_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
