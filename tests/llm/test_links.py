"""Token alignment, phrase mining and line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import itemset_phrases, line_runs, token_alignment


# Alignment -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def aligner():
    return token_alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")


def groups_of(aligner, text):
    """The groups of one text by hand; None without tokens."""
    if not text:
        return None
    full = b" " + text.encode()
    a, b = aligner.a.library.encode(" " + text, add_special_tokens=False).ids, aligner.b.model.encode(text)
    spelled = [[side.bytes[i] for i in ids] for side, ids in ((aligner.a, a), (aligner.b, b))]
    if any(b"".join(x) != full for x in spelled):
        return None
    ends = [np.cumsum([len(x) for x in each]).tolist() for each in spelled]
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return groups


def pairs_of(groups):
    return Counter((x, y) for a, b in groups or [] for x in a for y in b)


def said(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups or [])


def overlaps(aligner, groups):
    """Token pairs that share a byte, found byte by byte."""
    n = 0
    for a, b in groups or []:
        owner = [[k for k, i in enumerate(ids) for _ in side.bytes[i]] for side, ids in ((aligner.a, a), (aligner.b, b))]
        n += len(set(zip(*owner)))
    return n


ODD = [None, "", "a", " ", "\n", "\na", "a\n", "a\n\nb", "<|endoftext|>", "<s>", "<unk>", "<0x0A>", "▁▁", "a" * 3000, "漢" * 300 + "字", "ÀÉ ﬁ²", "x\0y", "  a  b "]


def test_links_of_any_text(aligner):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choices("aB béİß1²|'st!\n \t\r是яか<>\u0085 ́▁\0😀﷽ﬁ½x", k=rnd.randint(1, 15))) for _ in range(3000)]
    got = aligner.links(texts)
    for k, text in enumerate(texts):
        groups = groups_of(aligner, text)
        pairs = pairs_of(groups)
        n = [sum(len(g[i]) for g in groups or []) for i in (0, 1)]
        assert got.counts[:, k].tolist() == [*n, len(groups or []), pairs.total(), overlaps(aligner, groups)], text
        assert got.said[k] == said(groups)
        own = slice(*got.pairs.starts[k : k + 2])
        assert dict(zip(got.pairs.columns[own].tolist(), got.pairs.values[own].tolist())) == {a << 16 | b: c for (a, b), c in pairs.items()}


def test_blocks_beyond_what_is_kept(monkeypatch):
    """Results do not depend on which blocks a worker remembers, nor on the sizes of steps."""
    texts = [f"word{i % 7} and more{i} of it\nanother line {i}" for i in range(50)]
    want = token_alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model").links(texts)
    monkeypatch.setattr(token_alignment, "REMEMBERED", 5)
    monkeypatch.setattr(token_alignment, "LINKS", 16)
    monkeypatch.setattr(token_alignment, "LARGE", 1)
    few = token_alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    for _ in range(2):
        got = few.links(texts)
        assert len(few.kept) <= 5 and len(few.at) <= 5
        assert (got.counts == want.counts).all() and got.said == want.said
        assert (got.pairs.columns == want.pairs.columns).all() and (got.pairs.values == want.pairs.values).all()


def test_settled_characters_are_spelled(aligner):
    settled = re.compile(f"[{token_alignment.SETTLED}]")
    chars = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and settled.match(c)]
    texts = [f"x{c}y {c} z{c}\n{c}w" for c in chars[:: max(1, len(chars) // 4000)]]
    got = aligner.links(texts)
    for k, text in enumerate(texts):
        assert got.said[k] == said(groups_of(aligner, text)), text


@pytest.mark.parametrize("head", [0, 5, token_alignment.HEAD])
def test_counts_over_the_corpus(spark, docs, aligner, head):
    rows = docs.collect()
    each = [pairs_of(groups_of(aligner, r.text)) for r in rows]
    held = Counter(p for pairs in each for p in pairs)
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    want = []
    for r, pairs in zip(rows, each):
        groups = groups_of(aligner, r.text)
        best = sum(c for p, c in pairs.items() if held[p] == most[p[0]])
        digest = hashlib.sha256(said(groups).encode()).hexdigest() if groups else ""
        want.append((r.doc_id, pairs.total(), best, sum(c * held[p] for p, c in pairs.items()), digest))
    got = token_alignment.linked(docs, "byte_bpe_50k.json", "piece_bpe_32k.model", head)
    got = [(r.doc_id, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_links_of_nothing(empty):
    assert token_alignment.linked(empty, "byte_bpe_50k.json", "piece_bpe_32k.model").count() == 0


def test_sparse_products():
    rnd = np.random.default_rng(3)
    left, right = (rnd.integers(0, 3, (7, 7)) for _ in range(2))

    def csr(m):
        rows, columns = np.nonzero(m)
        return token_alignment.Csr(np.r_[0, np.cumsum(np.bincount(rows, minlength=len(m)))], columns, m[rows, columns])

    out = np.zeros((7, 7), np.int64)
    for begin, end in csr(left).row_blocks(csr(right), 5):
        np.add.at(out, (lambda r, c, v: (r, c))(*csr(left).product(csr(right), begin, end)), csr(left).product(csr(right), begin, end)[2])
    assert (out == left @ right).all()
    assert (csr(left).transposed(7).starts == csr(left.T).starts).all()


# Phrases ---------------------------------------------------------------------------------


def phrases_by_hand(rows, threshold, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < threshold:
            continue
        cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        longer = [f for (other, q), f in counts.items() if other == lang and len(q) > len(p) and f >= threshold and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if longer and 100 * max(longer) >= 80 * a:
            continue
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, at = [], Counter()
    for r in out:
        at[r[0]] += 1
        if at[r[0]] <= top:
            ranked.append((r[0], at[r[0]], *r[1:]))
    return ranked


def mined(df, **settings):
    found = itemset_phrases.collocations(df, **settings).collect()
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found)


@pytest.mark.parametrize("shards,bits", [(1, 24), (3, 24), (4, 3)])
def test_phrases(spark, monkeypatch, shards, bits):
    """Whatever the number of shards, and where nearly all buckets collide."""
    monkeypatch.setattr(itemset_phrases, "BITS", bits)
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "New", "york", "city", "漢字"]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rnd.randint(0, 25)):
            w += ["new", "York", "city"] if rnd.random() < 0.2 else [rnd.choice(vocabulary)]
        rows.append((" ".join(x + rnd.choice(["", "", "", ",", ".\n"]) for x in w), rnd.choice(["en", "fr", None])))
    rows += [(None, "en"), ("", None), ("  \t ", "de"), ("lone", "de"), (" ".join(["again"] * 400), "en"), ("a b c d " * 10, "und")]
    # Words that come late: only the last rows hold them.
    rows += [("late comer here now", "en")] * 12
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("mine") for c in ("n", "score", "shard", "w1")})
    assert mined(df, threshold=5, shards=shards, top=40) == phrases_by_hand(rows, 5, 40)


def test_phrases_of_nothing(spark, empty):
    assert mined(empty) == []
    assert mined(spark.createDataFrame([(None, None)], "text string, lang string")) == []


@pytest.mark.parametrize("bits", [6, 7, 8])
def test_phrases_of_shared_buckets(spark, monkeypatch, bits):
    """A bucket opened early by another phrase does not end a longer phrase's probation before
    its own shorter ones are counted."""
    monkeypatch.setattr(itemset_phrases, "BITS", bits)
    rnd = random.Random(bits)
    rows = []
    for i in range(40):
        rows += [(" ".join([f"x{i}"] * 4), "en")] * rnd.randint(5, 9)
        rows += [(f"a{i} b{i} c{i} d{i}", rnd.choice(["en", "fr"])) for _ in range(16)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert mined(df, threshold=5, top=500) == phrases_by_hand(rows, 5, 500)


def test_phrases_in_blocks(spark, monkeypatch):
    """Documents of a task are one block for a language and shard, unless it grows too large."""
    rows = [(f"Some words, no {i % 7}! some\n", lang) for i in range(200) for lang in ("en", None)]
    df = spark.createDataFrame([*rows, ("", "de"), (None, "de")], "text string, lang string").coalesce(1)
    blocks = itemset_phrases.shards_of(df, 2).collect()
    assert sorted((b.lang, b.shard, b.n) for b in blocks) == [("en", 0, 1000), ("und", 1, 1000)]
    spelled = {}
    for b in blocks:
        for w, word in zip(b.new, b.spelled):
            assert spelled.setdefault(w, (b.lang, word)) == (b.lang, word)
    assert sorted(spelled.values()) == sorted((lang, w) for lang in ("en", "und") for w in ["some", "words", "no", *"0123456"])
    for b in blocks:
        ids, codes = np.frombuffer(b.ids, np.uint64), np.frombuffer(b.codes, np.uint16)
        said = [spelled[w][1] if w else "|" for w in ids.view(np.int64)[codes].tolist()]
        assert " ".join(said[:10]) == "some words | no 0 | some | some words"
    monkeypatch.setattr(itemset_phrases, "BLOCK", 64)
    parts = list(itemset_phrases._shards(1)(iter(df.limit(40).toArrow().to_batches())))
    assert len(parts) > 5 and sum(p.column("n")[0].as_py() for p in parts) == 40 * 5


def test_scores_are_exact(spark):
    rows = [(2**62, 2**62, 2**62 + 1), (10**17 + 7, 3 * 10**17, 10**17 + 9), (30, 30, 31)]
    df = spark.createDataFrame(rows, "a bigint, l bigint, r bigint")
    got = [r[0] for r in df.select(itemset_phrases.score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [2_000_000 * a // (left + right) for a, left, right in rows]


# Lines -----------------------------------------------------------------------------------


def lines_by_hand(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    order = lambda i: (i is None, i or 0)
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)], key=order) != doc_id for x in lines]
        out.append((doc_id, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def deduped(df, **settings):
    found = line_runs.without_repeats(df, **settings)
    return sorted(((r[0], r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()), key=repr)


@pytest.mark.parametrize("batches,fanout,hot", [(1, 3, 400_000), (5, 2, 400_000), (6, 3, 0)])
def test_lines(spark, docs, monkeypatch, batches, fanout, hot):
    """Whatever the batches and levels, with repeated lines broadcast or all shuffled."""
    monkeypatch.setattr(line_runs, "BROADCAST_ROWS", hot)
    rnd = random.Random(9)
    pool = [f"a line that is said often, number {i}" for i in range(12)] + [" A LINE that is said often, number 3\t", "short", "", "é" * 9, "É" * 10, "é" * 10, " " * 12]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(rnd.randint(0, 60), "\n".join(rnd.choices(pool, k=rnd.randint(0, 9)))) for _ in range(80)]
    rows += [(None, pool[0] + "\n" + pool[5]), (None, pool[0]), (200, "only here twice\nonly here twice"), (None, "nameless alone\nnameless alone")]
    rows += [(300, "\n".join(f"line number {i}" for i in range(3000))), (301, "\n".join(f"LINE number {i}" for i in range(0, 3000, 2)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert deduped(df, batches=batches, fanout=fanout) == lines_by_hand(rows)


def test_lines_leave_other_columns(docs):
    marked = docs.withColumns({c: F.lit("mine") for c in ("n_lines", "drop", "h1", "batch")})
    found = line_runs.without_repeats(marked)
    assert found.columns == [*marked.columns, "n_lines", "n_dropped", "kept_text"]
    assert found.count() == docs.count()


def test_lines_of_nothing(empty):
    assert line_runs.without_repeats(empty).count() == 0


def test_runs_are_not_shuffled(spark):
    """Levels fill up and are compacted; a batch is dealt to the runs' buckets, never a run."""
    runs = line_runs.Runs(spark, buckets=4, fanout=2)
    keys = lambda a, b: spark.range(a, b).select(F.col("id").alias("h1"), F.col("id").alias("h2"))
    for i in range(5):
        runs.add(keys(10 * i, 10 * i + 10))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    found = runs.held(keys(35, 55))
    assert sorted(r.h1 for r in found.filter("old").collect()) == list(range(35, 50))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and plan.count("Exchange hashpartitioning(h1") <= 1
    runs.close()
