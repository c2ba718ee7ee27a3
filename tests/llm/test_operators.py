"""Each operator against brute force on small fixtures, with the awkward rows among them."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import class_lm, components, decontaminate, embedding_dedup, encode, fm_index, html_extract, ngram_join, packing, sieve, suffix_dedup, token_counts, token_output, toxicity
from lodestone.llm import text as X
from lodestone.llm.encode import Encoder, tokenizer_path
from lodestone.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, score double, part int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, lower(text))


def make_docs(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "Mi", "né", "tu") for b in ("ra", "so", "x1") for c in ("", "na", "pé.")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 9, 40, 120)))) for _ in range(n)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(150)) for _ in range(3)]
    for b in base:
        for k in range(6):
            w = b.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    passage = " ".join(rng.choice(vocabulary) for _ in range(63))
    texts += [f"begin {i} {passage} end {i * 7}" for i in range(4)] + [passage, passage.upper()]
    texts += [None, "", " \t\n ", "a", "A", "a b", "b a", "word " * 300, texts[0], "naïve café", "<|endoftext|> x"]
    return [(i, t) for i, t in enumerate(texts)]


DOCS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), "x", 1, 0.5, 2) for i, t in DOCS]
    rows.append((None, "no id here at all", None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def roots(n, links):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# Words


def test_word_hashes_follow_the_text():
    texts = ["Ab  cd", "", "ab\ncd\x0bé", "x" * 5000, "cd"]
    w = X.Words(pa.array(texts))
    got = [[w.word(i) for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [words(t) for t in texts]
    h = w.hashes()
    assert h[0] == h[2] and h[1] == h[3] == h[-1] and len(set(h.tolist())) == 4
    assert X.word_hash(b"cd") == int(h[-1])


def test_blocks_cover_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 0, 900, 3, 3, 3)]})
    got = [x for b in X.blocks([batch], "text", 10) for x in b.column("text").to_pylist()]
    assert got == batch.column("text").to_pylist()


def test_workers_keep_nothing_of_another_kind_of_task():
    path = tokenizer_path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_pydict({"text": ["some words here"]})
    for e, block in encode.encoded(path, iter([batch])):
        e.encode(block.column("text"))
    assert encode._encoders
    for block in X.blocks(iter([batch]), "text"):
        X.Words(block.column("text")).hashes()
    assert not encode._encoders and len(X._powers[0]) == 1


# Components


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(5)
    n = 80
    links = {"chain": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n - 1)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(60)], "none": []}[shape]
    rng.shuffle(links)
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    got = {r.id: r.component_id for r in components.components(df, Scratch(spark, "t")).collect()}
    want = roots(n, links)
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}


# 1


def test_training_holds_few_copies_of_the_features():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << toxicity.BITS, (6, 100_000)).astype(np.int32)
    tags = (rng.random(100_000) < 0.1).astype(np.int64)
    tracemalloc.start()
    toxicity.train_field(f, np.arange(0, 100_001, 50), tags, steps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    table = 8 << toxicity.BITS  # the weights, whatever the number of words
    assert peak - 4 * table < 7 * f.nbytes


def test_field_matches_enumeration():
    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros(1), 0.0, 0.3, rng.normal(size=(2, 2)))
    first = np.array([0, 3, 3, 8])
    em = rng.normal(size=8)
    got = field.marginals(em, first)
    for a, b in zip(first[:-1], first[1:]):
        n, total, on = b - a, 0.0, np.zeros(b - a)
        for code in range(2**n if n else 0):
            tags = [code >> i & 1 for i in range(n)]
            s = tags[0] * field.start + sum(em[a + i] for i in range(n) if tags[i]) + sum(field.trans[x, y] for x, y in zip(tags[:-1], tags[1:]))
            total += math.exp(s)
            on += np.array(tags) * math.exp(s)
        if n:
            assert np.allclose(got[a:b], on / total)


def toxic_rows(seed, n):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ano", "eru", "ilo", "ota")]
    out = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        bad = i % 4 == 0
        for _ in range(rng.randrange(2, 5) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(("vexor", "Zurtish", "zurtic")) + rng.choice(("", "al")))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_learns_words(spark):
    rows = toxic_rows(1, 400)
    df = spark.createDataFrame([(i, t, None) for i, t, _ in rows] + [(1000, None, None), (1001, "", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    test = rows[300:]
    assert sum((got[i].score >= 0.3) == y for i, _, y in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == got[1001].score < 0.3
    spans = [(lower(t)[s.start : s.end], y) for i, t, y in test for s in got[i].toxic_spans]
    assert len(spans) > 20 and sum(w.startswith(("vexor", "zurt")) for w, _ in spans) >= 0.95 * len(spans)


def test_toxicity_without_labels(spark, docs, empty):
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, none).select("score").collect()} == {0.0}
    assert toxicity.score(empty, none).count() == 0


# 2


def test_token_tree_edits():
    enc = Encoder(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(2)
    bad = 0
    for text in [t or "" for _, t in DOCS][:60] + ["ab  cd", "<|endof", "日本語 x"]:
        tree, now = token_counts.TokenTree.of(enc, pa.array([text]))[0], text
        for _ in range(5):
            a = rng.randint(0, len(now))
            b = min(len(now), a + rng.choice((0, 1, 6, 200)))
            new = rng.choice(("", " ", "'s", "été ", "\n\n", "Hello 12", "text|>", "x " * 400))
            tree.edit(a, b, new)
            now = now[:a] + new + now[b:]
            bad += tree.text() != now or tree.tokens != len(enc.tokenizer.encode(now, add_special_tokens=False).ids) or tree.chars != len(now)
    assert not bad


def test_token_counts(spark, docs, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    enc = Encoder(path).tokenizer
    df = docs.withColumn("edits", token_counts.sample_edits())
    rows = token_counts.count_edited(df, path, keep_text=True).collect()
    text = dict(DOCS) | {None: "no id here at all"}
    assert len(rows) == len(DOCS) + 1
    for r in rows:
        assert r.n_tokens == len(enc.encode(text[r.id] or "", add_special_tokens=False).ids)
        assert r.n_tokens_edited == len(enc.encode(r.edited, add_special_tokens=False).ids) and r.n_chars_edited == len(r.edited)
    assert token_counts.count_edited(empty.withColumn("edits", token_counts.sample_edits()), path).count() == 0


# 3


def test_exchange_finds_classes():
    rng = np.random.default_rng(1)
    n = 40  # even words are followed by odd ones and the other way round
    big = rng.poisson(0.05, (n + 1, n + 1))
    for _ in range(6000):
        a = rng.integers(n)
        big[a, (rng.integers(n // 2) * 2 + (a + 1) % 2)] += 1
    cls = class_lm.exchange(big, 2)
    assert len(set(cls[::2])) == len(set(cls[1::2])) == 1 and cls[0] != cls[1]


def test_transitions_sum_to_one():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.4, (6, 6, 6))
    t = class_lm.Transitions.of(counts, rng.random(6))
    assert np.allclose((10**t.known).sum(2), 1)


def test_class_lm(spark, docs, empty):
    from pyspark.sql import functions as F

    rows = class_lm.score(docs, F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True)), frequent=30, classes=5).collect()
    c = Counter()
    both = [*DOCS, (None, "no id here at all")]
    for i, t in both:
        if i is None or i % 7 != 2:
            c.update([*words(t), None])
    total, kinds = sum(c.values()), len(c)
    by = {r.id: r for r in rows}
    assert len(rows) == len(both)
    for i, t in both:
        w, r = [*words(t), None], by[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 0
    held = [r for r in rows if not r.learn]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert class_lm.score(empty, F.lit(True)).count() == 0


def test_scores_are_the_models(spark, docs, monkeypatch):
    """Probabilities computed again, token by token, from the counts and classes of the words."""
    from pyspark.sql import functions as F

    seen, coded = {}, class_lm._coded

    def spy(tmp, docs, asked, classed, n_classes, parts, totals, discount, name):
        seen.update(n=n_classes, d=discount, words={})
        for r in classed.rows.collect():
            h, c, cls = classed.of({x: pa.scalar(bytes(r[x]), pa.binary()) for x in ("h", "c", "class")})
            seen["words"].update(zip(h.tolist(), zip(c.tolist(), cls.tolist(), strict=True), strict=True))
        return coded(tmp, docs, asked, classed, n_classes, parts, totals, discount, name)

    monkeypatch.setattr(class_lm, "_coded", spy)
    got = {r.id: r for r in class_lm.score(docs, F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True)), frequent=30, classes=5, lookup_bytes=2000).collect()}
    words_, n, d = seen["words"], seen["n"], seen["d"]
    end = int(class_lm.END)
    ids = lambda t: [*(X.word_hash(w.encode()) for w in words(t)), end]
    both = [*DOCS, (None, "no id here at all")]
    own = Counter(h for i, t in both if i is None or i % 7 != 2 for h in ids(t))
    assert {h: c for h, (c, _) in words_.items()} == own
    tri, mass, kinds = np.zeros((n, n, n)), np.zeros(n), np.zeros(n)
    for i, t in both:
        if i is None or i % 7 != 2:
            a = b = words_[end][1]
            for h in ids(t):
                c = words_[h][1]
                tri[a, b, c] += 1
                a, b = b, c
    for c, k in words_.values():
        mass[k] += c
        kinds[k] += 1

    def chance(a, b, c):
        two = tri.sum(0)
        held = two.sum(0) > 0
        uni = (two[:, c].sum() + 0.5) * held[c] / (two.sum() + 0.5 * held.sum())
        k = max(1, (two[b] > 0).sum())
        low = (two[b, c] + k * uni) / (two[b].sum() + k)
        k = max(1, (tri[a, b] > 0).sum())
        return (tri[a, b, c] + k * low) / (tri[a, b].sum() + k)

    def word(a, b, h):
        if h in words_:
            c, k = words_[h]
            return chance(a, b, k) * (c - d) / mass[k]
        return sum(chance(a, b, k) * d * kinds[k] / max(mass[k], 1) for k in range(n))

    for i, t in both:
        a = b = words_[end][1]
        total = 0.0
        for h in ids(t):
            total += math.log10(word(a, b, h))
            if h in words_:
                a, b = b, words_[h][1]
        assert math.isclose(total, got[i].score, rel_tol=1e-9), i
    for a, b in ((0, 0), (n - 1, 1), (2, n // 2)):
        assert math.isclose(sum(word(a, b, h) for h in words_) + word(a, b, -1), 1)


def test_rare_words_are_exchanged(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)  # two kinds of words take turns; few of either are frequent, so rare ones stand beside rare ones
    kinds = [[f"{k}{i}" for i in range(100)] for k in "xy"]
    draw = lambda k: kinds[k][rng.randrange(2) if rng.random() < 0.3 else rng.randrange(100)]
    rows = [(i, " ".join(draw((i + j) % 2) for j in range(60))) for i in range(200)]
    learn = F.col("doc_id") < 150
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = lambda **o: sum(r.score for r in class_lm.score(docs, learn, frequent=5, classes=3, lookup_bytes=20_000, **o).where("not learn").collect())
    # Knowing the kind of each word saves a bit a word; votes of frequent neighbours alone don't tell the kinds apart.
    assert held() > held(rounds=0) + 0.5 * math.log10(2) * 50 * 60 * 0.3


def test_moves_raise_the_likelihood():
    rng = np.random.default_rng(2)
    n, k = 60, 4
    big = rng.poisson(0.1, (n, n))
    for _ in range(4000):
        a = rng.integers(n)
        big[a, rng.integers(n // 2) * 2 + (a + 1) % 2] += 1
    cls = rng.integers(0, k, n)
    values = []
    for _ in range(4):
        one = np.eye(k, dtype=np.int64)[cls]
        values.append(class_lm.likelihood(one.T @ big @ one))
        beside = np.hstack([big @ one, big.T @ one])
        word, slot = np.nonzero(beside)
        cls = class_lm.moves(one.T @ big @ one, cls, np.searchsorted(word, np.arange(n + 1)), slot, beside[word, slot])
    assert values[1] > values[0] and values[-1] > values[0] + 1000


# 4


def test_fm_index():
    rng = np.random.default_rng(4)
    for sigma in (2, 3, 9):
        s = rng.integers(0, sigma, 300)
        index = fm_index.FMIndex(s, sigma, 7)
        patterns = rng.integers(1, sigma, (60, 4))
        lengths = rng.integers(1, 5, 60)
        lo, hi = index.search(patterns, lengths)
        for p, n, a, b in zip(patterns, lengths, lo, hi):
            want = [i for i in range(len(s) - n + 1) if (s[i : i + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("block_bytes", [1 << 20, 200, 40])
def test_decontaminate(spark, docs, empty, block_bytes):
    text = dict(DOCS)
    long = text[3 + 60] or ""
    items = [(1, long), (2, "a"), (3, None), (4, "  ,, "), (5, " ".join(long.split()[20:30])), (None, "b a"), (6, "lora tuso"), (6, "word word word"), (7, "é")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for i, t in items:
        w = words(t, pattern)
        for k in range(max(1, len(w) - 7) if w and i is not None else 0):
            windows[tuple(w[k : k + 8])].add(str(i))
    rows = {r.doc_id: r for r in decontaminate.digest(decontaminate.hits(docs, bench, block_bytes=block_bytes)).collect()}
    for i, t in DOCS:
        w, hit, own = words(t, pattern), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    own |= found
                    hit |= set(range(k, k + n))
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(own), len(own) >= 2)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
    assert decontaminate.hits(empty, bench).count() == 0
    assert decontaminate.digest(decontaminate.hits(docs, bench.limit(0))).where("n_hit > 0 or contaminated").count() == 0
    left = decontaminate.remove(docs, bench, block_bytes=block_bytes)
    assert left.columns == docs.columns
    assert sorted(left.collect(), key=str) == sorted(decontaminate.remove(docs, bench).collect(), key=str)
    clean = {i for i in rows if rows[i].n_hit == 0}
    kept = {r.doc_id: r for r in left.collect()}
    assert clean <= set(kept) and all(kept[i].text == text.get(i, "no id here at all") for i in clean)
    assert all(r.n_chars == len(r.text) for i, r in kept.items() if i not in clean)


# 5


def test_main_text_of_other_layouts():
    def of(source):
        page = html_extract.Page(source)
        return html_extract.extract(page, html_extract.template([page]), False)

    assert of("<html><body><header>h</header><div class='sidebar'>s</div><main><h1>T &amp; u</h1><p>a\n <b>b</b>c<br>d</main><form>f</form><footer>z</footer>") == "T & u a bc d"
    assert of("<article><h1>T<p>x<aside>no</aside><div class='newsletter'>n</div><section id=comments><p>bad</section><script>var a='<p>';</script></article>") == "T x"
    assert of("<body><p>a<p>b<!-- c --></body>") == "a b"
    assert of("x &lt; y&nbsp;&nbsp;z") == "x < y z"
    assert of("") == "" and of("<p>") == "" and of("<article><p>open &am") == "open &am"


def test_template_words_are_dropped():
    sources = [f"<html><body><div><p>Welcome to Site</p><p>{t}</p><p>All rights kept</p></div></body></html>" for t in ("one text of its own", "another thing entirely", "third")]
    pages = [html_extract.Page(s) for s in sources]
    own = html_extract.template(pages)
    assert [html_extract.extract(p, own, True) for p in pages] == ["one text of its own", "another thing entirely", "third"]


def test_slots_are_the_text_of_articles_too():
    def texts(sources):
        pages = [html_extract.Page(s) for s in sources]
        own = html_extract.template(pages)
        return [html_extract.extract(p, own, True) for p in pages]

    items = (["ant", "bee"], ["cow"], ["dog", "eel", "fox"])
    page = "<html><body><nav>{0}</nav><article><p>Read more of us</p><h1>the {0}</h1><ul>{1}</ul><p>Sent from our desk</p></article></body></html>"
    sources = [page.format(i, "".join(f"<li><p>Item no</p><p>{x}</p></li>" for x in x)) for i, x in enumerate(items)]
    assert texts(sources) == ["the 0 ant bee", "the 1 cow", "the 2 dog eel fox"]  # "Item no" is of a class that nests in the slot of the list
    assert texts(sources[:1]) == ["Read more of us the 0 Item no ant Item no bee Sent from our desk"]
    copies = [f"<nav>{i}</nav><article><p>one and the same</p></article>" for i in range(3)]
    assert texts(copies) == ["one and the same"] * 3


def test_names_choose_among_slots():
    def text(source):
        return html_extract.extract(html_extract.Page(source), {}, False)

    assert text("<div id=content><p>body one</p></div><article class=comment><p>reader comment</p></article>") == "body one"
    assert text("<article class='post with-sidebar'><p>a</p><section class='related-work'><p>b</p></section><div class='related-posts'><p>c</p></div></article>") == "a b"
    assert text("<article class='ad'><p>buy</p></article><article id=story><p>a</p><div class='share-bar'>x</div></article>") == "a"


def test_html_table(spark):
    rows = [(i, f"https://h{i % 2}.example/{i}", f"<html><body><nav><ul><li>m</li></ul></nav><article><h1>t{i}</h1><p>x  {i}</p></article><footer>f</footer></body></html>") for i in range(130)]
    rows += [(200, None, None), (201, "http://a", ""), (201, "http://a", ""), (None, "x", "<p>q")]
    got = html_extract.main_text(spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id long, url string, html string, host int, part string")).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got if r.page_id is not None and r.page_id < 130} == {i: f"t{i} x {i}" for i in range(130)}
    assert Counter((r.page_id, r.text) for r in got if r.page_id is None or r.page_id >= 200) == Counter([(200, ""), (201, ""), (201, ""), (None, "q")])


# 6


def test_suffix_dedup(spark, docs, empty):
    both = [(i, words(t)) for i, t in DOCS]
    first, places = {}, Counter()
    for i, w in both:
        for s in range(len(w) - 49):
            key = tuple(w[s : s + 50])
            places[key] += 1
            first.setdefault(key, (i, s))
    got = {r.id: r for r in suffix_dedup.repeats(docs).collect()}

    def flat(spans):
        return {x for s in spans for x in range(s.start, s.start + s.words)}

    for i, w in both:
        again, gone = set(), set()
        for s in range(len(w) - 49):
            key = tuple(w[s : s + 50])
            if places[key] > 1:
                again |= set(range(s, s + 50))
                if first[key] != (i, s):
                    gone |= set(range(s, s + 50))
        found = (flat(got[i].repeated), flat(got[i].removable)) if i in got else (set(), set())
        assert found == (again, gone), i
    left = suffix_dedup.remove(docs)
    assert left.columns == docs.columns and left.where("doc_id is null").count() == 1
    kept = {r.doc_id: r.text for r in left.collect()}
    assert all(kept[i] == t for i, t in DOCS if i not in got)
    assert suffix_dedup.repeats(empty).count() == 0


# 7


def test_ngram_join_passes_few_rows_at_once(spark, docs, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, cut = spark.conf.get(name), Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, at: seen.append(int(spark.conf.get(name))) or cut(self, df, at))
    ngram_join.similar(docs, k=3, percent=90)
    assert seen and max(seen) <= 1000 and spark.conf.get(name) == before


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, docs, empty, k, percent):
    sets = []
    for _, t in DOCS:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = roots(len(sets), links)
    twice = docs.union(docs.where("doc_id in (1, 61)"))
    got = ngram_join.similar(twice, k=k, percent=percent).collect()
    assert len(got) == len(DOCS) + 3
    for r in got:
        if r.id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.id]), want[r.id]), r
        else:
            assert r.component_id is None
    assert ngram_join.similar(empty, k=k, percent=percent).count() == 0


def test_texts_of_one_id_are_one_document(spark):
    rows = [(5, "a b c d e"), (5, "f g h i j"), (3, "f g h i j"), (9, "A B C D E"), (7, "k l m")]
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=90).collect()
    assert sorted((r.id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 7), (9, 3)]


@pytest.mark.parametrize("split", [4, 1 << 14])
def test_common_shingle_in_unlike_texts(spark, monkeypatch, split):
    """A passage that hundreds of texts share, a few of them alike in the rest too; long lists may be split."""
    monkeypatch.setattr(ngram_join, "HEADS", 2)
    monkeypatch.setattr(ngram_join, "MORE", 2)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [f"{passage} u{i} v{i} w{i} x{i}" for i in range(300)] + [f"{passage} u{i} v{i} w{i} y{i}" for i in range(0, 300, 50)]
    texts += [f"{passage} {i}" for i in range(40)]
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = roots(len(sets), links)
    got = ngram_join.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=3, percent=90, split=split).collect()
    assert {r.id: r.component_id for r in got} == dict(enumerate(want))


# 8


def test_embedding_dedup(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(20, 16))
    x = [b + rng.normal(size=16) * s for b in base for s in (0.0, 0.0, 0.05, 0.2, 0.4)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [1.0, None], 1), (204, [], 1), (205, [1.0, 2.0], 1), (None, x[0].tolist(), 1)]
    got = {r.id: r for r in embedding_dedup.links(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), tile=8).collect()}
    y = np.array(x)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = y @ y.T >= 0.95
    np.fill_diagonal(hit, False)
    assert sum(got[i].n_links for i in range(100)) >= 0.9 * hit.sum()
    assert all(got[i].n_links <= hit[i].sum() for i in range(100))
    want = roots(100, zip(*np.nonzero(hit)))
    assert sum(got[i].component_id == want[i] for i in range(100)) >= 95
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(200, 206))
    assert (got[None].n_links, got[None].component_id) == (0, None)
    assert embedding_dedup.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_traversal_is_in_order():
    rng = np.random.default_rng(9)
    a, b = rng.random(6), rng.random(5)
    sums = (a[:, None] + b[None]).ravel()
    assert embedding_dedup.traversal(a, b, 30) == np.argsort(sums, kind="stable").tolist()


# 9


def test_bounds_and_packing():
    rng = np.random.default_rng(10)
    for _ in range(30):
        sizes = rng.integers(1, 101, rng.integers(1, 80))
        at = packing.best_fit_decreasing(sizes, 100)
        fill = np.bincount(at, sizes)
        assert fill.max() <= 100 and packing.lower_bound(sizes, 100) <= len(fill)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 7), 100) == 4


def test_packing(spark, docs, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    enc = Encoder(path).tokenizer
    rows = packing.pack(packing.pieces(docs, path, capacity=128), capacity=128, partition=20).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in [*DOCS, (None, "no id here at all")]:
        ids, at = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert k == 0 or r.length == 128
            at += r.length
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 128
    assert len(bins) <= 1.1 * sum(r.length for r in rows) / 128 + 1
    assert packing.pack(packing.pieces(empty, path)).count() == 0


# 10


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    enc = Encoder(tokenizer_path(name))
    texts = [t or "" for _, t in DOCS] + ["  a", "a  b", "it's I'll o'neil 'tis", "a\n\nb\nc\t d", "x<|endoftext|>y", "<|STARTOFTEXT|>z", "café×3 ½ ١٢ word́ éa", "a b ’s don’t", "#!? 'S", "tab\tx\r\ny", "日本語。abc", "😀 s😀x", "ŉ İst ΑΣ foo", "\x1c a\x1fb", "ẞ ß ﬁ"]
    ids, first = enc.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_encoder_looks_a_piece_up_once():
    class Counted(dict):
        looks = 0

        def get(self, *args):
            self.looks += 1
            return super().get(*args)

        def __contains__(self, key):
            self.looks += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            self.looks += 1
            return super().__getitem__(key)

    enc = Encoder(tokenizer_path("word_bpe_49k.json"))
    enc.known = Counted()
    for looks in (3, 6):  # three distinct pieces, unknown and then known
        ids, _ = enc.encode(pa.array(["ab cd cd 12"]))
        assert ids.tolist() == enc.tokenizer.encode("ab cd cd 12", add_special_tokens=False).ids
        assert enc.known.looks == looks


def test_token_files(spark, docs, empty, tmp_path):
    path = tokenizer_path("word_bpe_49k.json")
    enc = Encoder(path).tokenizer
    out = f"file://{tmp_path}/ids"
    manifest = token_output.write(docs, path, out)
    rows = sorted(token_output.read(spark, out, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, *range(len(DOCS))]
    at = 0
    for r in rows:
        text = dict(DOCS).get(r.doc_id, "no id here at all") if r.doc_id is not None else "no id here at all"
        ids = np.array([*enc.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    data = (tmp_path / "ids" / manifest[0][0]).read_bytes()
    codec = token_output.Codec((tmp_path / "ids" / "dictionary").read_bytes())
    assert codec.document(data, 1).astype("<u4").tobytes() == bytes(rows[1].ids)
    with pytest.raises(ValueError):
        token_output.Codec(b"").index(data)
    none = token_output.write(empty, path, f"file://{tmp_path}/none")
    assert none == [] and token_output.read(spark, f"file://{tmp_path}/none", none).count() == 0


# All


def test_long_and_repeated_rows(spark, tmp_path):
    """A text beyond a block of work, in two rows of one id, beside a short one."""
    rng = random.Random(12)
    long = " ".join("".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 6))) for _ in range(180_000))
    assert len(long) > X.BLOCK_BYTES
    docs = spark.createDataFrame([(1, long), (1, long), (2, "a b c d e f g h"), (3, long.upper())], "doc_id long, text string").repartition(2)
    path = tokenizer_path("word_bpe_49k.json")
    ids = [*Encoder(path).tokenizer.encode(long, add_special_tokens=False).ids, 1]
    shards = f"file://{tmp_path}/ids"
    back = token_output.read(spark, shards, token_output.write(docs, path, shards)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in back)[:2] == [(1, len(ids))] * 2
    assert {r.ids_crc32 for r in back if r.doc_id == 1} == {zlib.crc32(np.array(ids, "<u4").tobytes())}
    from pyspark.sql import functions as F

    edits = F.array(F.struct(F.lit(len(long) // 2).alias("start"), F.lit(len(long) // 2 + 3).alias("stop"), F.lit("x").alias("new")))
    counted = {r.id: r for r in token_counts.count_edited(docs.withColumn("edits", edits), path).collect()}
    half = long[: len(long) // 2] + "x" + long[len(long) // 2 + 3 :]
    assert (counted[1].n_tokens, counted[1].n_tokens_edited) == (len(ids) - 1, len(Encoder(path).tokenizer.encode(half, add_special_tokens=False).ids))
    assert counted[1].n_bytes_encoded < 2000
    scored = class_lm.score(docs, F.col("doc_id") != 2, frequent=50).collect()
    assert sorted((r.id, r.n_tokens, r.n_known) for r in scored) == [(1, 180_001, 180_001)] * 2 + [(2, 9, 1), (3, 180_001, 180_001)]
    linked = {(r.id, r.component_id, r.n_copies) for r in ngram_join.similar(docs).collect()}
    assert linked == {(1, 1, 3), (2, 2, 1), (3, 1, 3)}
    bench = spark.createDataFrame([(9, " ".join(long.split()[1000:1010]))], "item_id long, text string")
    hits = decontaminate.digest(decontaminate.hits(docs, bench)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in hits) == [(1, 180_000, 10)] * 2 + [(2, 8, 0), (3, 180_000, 10)]
    assert {r.id: [tuple(s) for s in r.removable] for r in suffix_dedup.repeats(docs).collect()} == {1: [], 3: [(0, 180_000)]}
    assert packing.pack(packing.pieces(docs, path)).groupBy().sum("length").first()[0] == 3 * len(ids) + len(Encoder(path).tokenizer.encode("a b c d e f g h", add_special_tokens=False).ids) + 1
    pages = spark.createDataFrame([(1, "http://a", f"<article><p>{long}</p></article>")] * 2 + [(2, "http://a", "<p>x</p>")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in html_extract.main_text(pages).collect()) == [(1, long), (1, long), (2, "x")]


# Pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = toxic_rows(3, 200) + [(500, None, 0), (501, "", 0)]
    rng = random.Random(6)
    fresh = [" ".join("".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(90)) for _ in range(5)]
    rows += [(600, fresh[0], 0), (601, fresh[0] + " tail", 0), (602, fresh[1], 0), (603, fresh[2] + " " + " ".join(fresh[1].split()[:60]), 0), (604, fresh[3] + " " + " ".join(fresh[4].split()[:20]), 0)]
    long = " ".join("".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(130_000))
    again = [(602, fresh[1], 0), (None, "a text without an id", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, found int, removable int, id int"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, 3) for i, t, _ in rows + again], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 150], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, fresh[4])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":  # learnt from short texts; one beyond a block of work goes through the others
            docs = docs.unionByName(spark.createDataFrame([(605, long, "en", "s", len(long), "x", 1, 2, 3)], schema))
        elif name != "packing":
            assert docs.where("doc_id = 602").count() == 1
            assert seen[name][605].text == long and seen[name][None].text == "a text without an id"
    toxic = {i for i, _, y in rows if y}
    assert len(toxic & set(seen["toxicity"])) <= 3 and len(seen["toxicity"]) >= len(rows) - len(toxic) - 3
    assert {500, 501, 600, 602, 603, 604} <= set(seen["near_duplicates"]) and 601 not in seen["near_duplicates"]
    assert seen["repeats"][603].text == fresh[2] and seen["repeats"][602].text == fresh[1]
    assert seen["benchmark"][604].text == fresh[3]
    assert {r for r in seen["packing"]} == set(seen["benchmark"])


def test_ngram_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * X.U(2)
    pairs = [(own := draw(n), np.concatenate([own[: n - gone], draw(more)])) for n, gone, more in ((1, 0, 0), (3, 1, 1), (40, 4, 3), (400, 100, 20), (2700, 300, 900), (9000, 0, 1), (9000, 9000, 9000))]
    x, y = (pa.array([ngram_join._sketch(np.unique(p[i])) for p in pairs], pa.binary()) for i in (0, 1))
    found = ngram_join._differ(x, y)
    truth = [len(np.setxor1d(a, b)) for a, b in pairs]
    assert all(f <= t and (t - f) % 2 == 0 for f, t in zip(found, truth, strict=True))
    assert found[-2] == 1 and list(ngram_join._differ(y, x)) == list(found)
    # Long sets that share nothing pass no filter, as they did where a set had 128 counts whatever its size.
    assert found[-1] > 18000 - 2 * (80 * 18000 / 180)


def test_parted_by_a_sieve(spark):
    rows = spark.createDataFrame([(i, "t") for i in range(-50, 50)] + [(None, "t")], "doc_id long, text string")
    inside, outside = (sorted(((r.doc_id is None, r.doc_id) for r in d.collect()), key=str) for d in sieve.parted(rows, spark.createDataFrame([(-7,), (3,), (None,)], "id long"), "doc_id"))
    assert {(False, -7), (False, 3)} <= set(inside) and (True, None) in outside
    assert len(inside) + len(outside) == 101 and len(inside) < 10


def test_texts_without_cuts_do_not_move(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    found = spark.createDataFrame([(3, [], [(0, 1)])], f"id long, repeated {suffix_dedup.SPANS}, removable {suffix_dedup.SPANS}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = suffix_dedup.remove(docs, found)
        assert {r.doc_id: r.text for r in out.collect()} == {i: f"text {i}" if i != 3 else "3" for i in range(50)}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Union" in plan


def test_pipeline_rejects_what_the_operator_calls_toxic(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for score, kept in ((0.29, 1), (0.3, 0), (0.4, 0)):
        monkeypatch.setattr(toxicity, "train", lambda *a, score=score: toxicity.Model(None, np.zeros(4), score))
        assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == kept


def test_toxicity_of_long_texts_without_known_words():
    rows = toxic_rows(3, 200)
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]), 0.25)
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(3000))
    score, _ = model.score(X.Words(pa.array([long, long + " vexor zurtic", ""], pa.large_string()), X.ALNUM))
    assert score[0] < 0.3 and score[2] < 0.3


def test_pipeline_without_rows(spark, tmp_path, empty):
    import corpus_pipeline

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
