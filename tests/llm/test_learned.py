"""Page texts, quality, sound and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessaline.llm")

from tessaline.llm import chroma, cotrain, htmltext, queries  # noqa: E402

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie notice">We use cookies, accept them all.</div>
<article><h1>A &amp; B</h1><p>First   paragraph of\nthe story, long enough to be one.<p>Second one with <b>bold</b> words &eacute;.<br>And more.</p></article>
<section id="comments"><h3>Comments</h3><p>Nice story indeed, thanks a lot.</p></section><footer>&copy; 2020 Somebody</footer></body></html>"""


def test_page(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (2, None, None, 3), (3, "u", "", 3), (None, "u", "plain words only", 3), (1, "u", PAGE, 3)], "page_id long, url string, html string, text int")
    got = sorted(map(tuple, htmltext.extract(pages).collect()), key=str)
    want = "A & B\nFirst paragraph of the story, long enough to be one.\nSecond one with bold words é. And more."
    assert [r for r in got if r[0] == 1] == [(1, "u", want, len(want))] * 2
    assert (2, None, "", 0) in got and (3, "u", "", 0) in got and len(got) == 5
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_blocks_close_as_browsers_do():
    texts = lambda h: [b.text for b in htmltext.blocks(h)]
    assert texts("<p>a<p>b<div>c</div>d") == ["a", "b", "c", "d"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>e<!-- x --><textarea>z</textarea>") == ["a", "b", "c", "e"]
    assert texts("<style>p{}</style>x<script>'</p>'") == ["x"]
    assert texts("a &lt;b&gt; <br/>c<img src='>'>d </unknown> e") == ["a <b> cd e"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert texts("<" * 50 + "p") and texts("") == []


#: Pages written by hand, and their main text.
BY_HAND = [
    ("<article><p>Hello world.</p></article>", "Hello world."), ("<article><p>a&nbsp;b and more of it.</p></article>", "a b and more of it."), ("<p>A lone paragraph.</p>", "A lone paragraph."),
    ("<div>Some bare words in a box.</div>", "Some bare words in a box."), ("plain words only", "plain words only"), ("<html><body><p>One.</p><p>Two has more words.</p></body></html>", "One.\nTwo has more words."),
    ('<p class="x>broken</p>', "broken"), ("<p title='it>Never closed quote here.", "Never closed quote here."), ('<p data-x="a > b">Kept text of the story.</p>', "Kept text of the story."),
    ("<header>My Site</header><nav><a href=/>Home</a> <a href=/n>News</a></nav><main><h1>Big news today</h1><p>It happened at noon, they said.</p></main><footer>Copyright 2020 Me</footer>", "Big news today\nIt happened at noon, they said."),
    ('<div class="menu"><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><article><h1>Title of it</h1><p>Body text of the article goes here.</p><div class="ad">Buy this now!</div><p>And it goes on after that.</p></article>', "Title of it\nBody text of the article goes here.\nAnd it goes on after that."),
    ('<article><p>The story is told in full here.</p><div class="comments"><p>Great story, I liked it.</p></div></article><footer>&copy; Somebody</footer>', "The story is told in full here."),
    ("<article><p>a</p></article><script>if (a < b) document.write('<p>no</p>')</script>", "a"),
]


def test_pages_by_hand(spark):
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(BY_HAND)], "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(BY_HAND))] == [w for _, w in BY_HAND]


@pytest.mark.parametrize("page", [
    "<a '" * 250_000, "<a =\"" * 200_000, "<a b='" * 170_000, "<div>" * 100_000 + "x", "<div>x" * 100_000, "<b>" * 100_000 + "<hr>" * 100_000, "<p>" + "<b>" * 50_000 + "<li></li>" * 50_000, "</x>" * 200_000, "<" * 1_000_000,
    "<!--" * 200_000, "&amp" * 200_000, '<div class="a b c d">y' * 40_000, "<ul><li>" * 50_000, "".join(f'<i class="{k}z">w' for k in range(60_000)).replace("0", "o"),
])
def test_long_and_deep_pages_take_linear_time(page):
    import time

    began = time.perf_counter()
    found = htmltext.blocks(page, {"up:div", "name:a"})
    assert time.perf_counter() - began < 6, len(found)


def test_markup_never_is_text():
    rng = np.random.default_rng(9)
    parts = ["<p>", "</p>", "<div class='a'>", "</div>", "word ", "<b", ">", '<a href="x', '">', "<!-- c -->", "<script>x<y</script>", "&lt;", "é", "<br/>", "<li>", "'", '"', "="]
    for _ in range(2000):
        page = "".join(rng.choice(parts, rng.integers(1, 12)))
        for b in htmltext.blocks(page):
            assert "<p>" not in b.text and "</" not in b.text and "<!--" not in b.text and "class=" not in b.text, page


def test_pages_held_out():
    rows = htmltext.seed_pages()
    assert all(len(htmltext.blocks(h)) == len(y) for h, y in rows)
    m = htmltext.Model(htmltext.LABELS).fit([htmltext.features(htmltext.blocks(h)) for h, _ in rows], [y for _, y in rows])
    right = total = 0
    for h, y in htmltext.seed_pages(60, seed=5):
        b = htmltext.blocks(h)
        best = m.decode(m.emissions(htmltext.features(b)), np.array([len(b)]))
        right += sum(m.labels[k] == want for k, want in zip(best, y))
        total += len(y)
    assert right / total > 0.97


def test_quality(spark):
    rng = np.random.default_rng(0)
    plain = ["one two three river stone light green house".split()[i] for i in range(8)]
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(plain, 30))
        bad, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            w[3:3] = ["scoundrel", "scoundrel"]
        text = " ".join(w).upper().replace(" ", "!! ") if bad else " ".join(w) + "."
        rows.append((i, text, "en", f"src{i % 3 if not bad else 9}", len(text), 1.0))
        if i % 2:
            labels.append((i, 0 if bad else 1, 1 if toxic else 0, "x"))
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, 1.0), (1, "", "en", "src1", 0, 1.0)], "doc_id long, text string, lang string, source string, n_chars long, quality double")
    known = spark.createDataFrame([*labels, (None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    got = cotrain.classify(docs, known).collect()
    assert len(got) == 402
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 2 == 0]
    assert np.mean([r["accepted"] == (r["doc_id"] % 5 != 0 and r["doc_id"] % 7 != 0) for r in held]) > 0.95
    assert all(r["accepted"] for r in cotrain.classify(docs, known.limit(0)).collect())
    assert cotrain.classify(docs.limit(0), known).count() == 0


def split_corpus(spark, n=1500, labelled=200):
    """Documents whose words and whose source both tell the quality, each seldom seen; few labels."""
    rng = np.random.default_rng(4)
    good, bad = [f"clear{i}" for i in range(120)], [f"spam{i}" for i in range(120)]
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.5)
        w = [*rng.choice(good if y else bad, 2), *(f"w{x}" for x in rng.integers(0, 300, 20))]
        rows.append((i, " ".join(rng.permutation(w)), "en", f"{'good' if y else 'bad'}{rng.integers(0, 40)}"))
        if i < labelled:
            labels.append((i, y, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), [int(r[3][0] == "g") for r in rows]


def test_the_exchange_pays(spark):
    docs, labels, truth = split_corpus(spark)

    def right(rounds):
        got = {r["doc_id"]: r["quality"] for r in cotrain.classify(docs, labels, rounds=rounds).collect()}
        return np.mean([(got[i] >= 0.5) == truth[i] for i in range(200, len(truth))])

    alone, together = right(0), right(3)
    assert together >= alone and together > 0.9, (alone, together)


def test_a_view_at_chance_teaches_nothing():
    m = cotrain.CoTrained(prior=0.05)
    of_one, of_zero = m.sure(0.95, 10.0)
    assert of_one == pytest.approx(np.log(19)) and of_zero == pytest.approx(np.log(19) + np.log(10))


def test_training_is_the_same_on_repeated_ids(spark):
    docs, labels, _ = split_corpus(spark, 300, 200)
    more = docs.union(docs.limit(50)).union(docs.limit(20).withColumn("text", F.lit("other words")))
    one, two = ({(r["doc_id"], r["quality"]) for r in cotrain.classify(more.repartition(k), labels, rounds=1).collect()} for k in (3, 5))
    assert one == two


def test_quality_of_very_long_texts(spark):
    docs, labels, _ = split_corpus(spark, 200, 150)
    long = spark.createDataFrame([(9000, "clear1 word " * 300_000, "en", "good1"), (9001, "x" * 2_000_000, None, None)], docs.schema)
    assert cotrain.classify(docs.union(long), labels, rounds=1).where("doc_id >= 9000").count() == 2


def test_sound(spark):
    rng = np.random.default_rng(1)
    tune = rng.normal(size=64)
    sound = chroma.notes(tune)
    a = chroma.codes(chroma.chroma(sound))
    assert chroma.align(a, chroma.codes(chroma.chroma(sound + 0.05 * rng.normal(size=len(sound)))), 0)[1] < 0.05
    assert chroma.Queries([1], [a]).matches(chroma.codes(chroma.chroma(sound[20 * chroma.HOP :])), 16, 0.2)[0][1:] == (1, -20, 92)
    near = tune.copy()
    near[5] += 0.5
    rows = [(100, tune), (7, tune), (8, near), (9, rng.normal(size=64)), (50, rng.normal(size=64)), (10, np.zeros(0)), (None, tune)]
    table = spark.createDataFrame([(i, v.tolist(), "x") for i, v in rows] + [(11, None, "x")], "vec_id long, embedding array<float>, codes string")
    got = {r["vec_id"]: r for r in chroma.search(table, "vec_id", "embedding").collect()}
    assert got[100]["class_id"] == got[7]["class_id"] == got[None]["class_id"] == 7
    assert (got[8]["n_matches"], got[8]["best_query"], got[8]["best_offset"]) == (1, 7, 0) and got[9]["n_matches"] == 0 and got[10]["n_codes"] == got[11]["n_codes"] == 0
    pcm = (np.clip(sound, -1, 1) * 32767).astype("<i2").tobytes()
    files = spark.createDataFrame([(0, pcm), (1, pcm[: len(pcm) // 2]), (2, None)], "vec_id long, audio binary")
    found = {r["vec_id"]: r for r in chroma.search(files, "vec_id", "audio", block=1).collect()}
    assert found[1]["best_query"] == 0 and found[1]["best_error"] < 0.05
    assert chroma.search(table.limit(0), "vec_id", "embedding").count() == 0


def brute_matches(row, queries, overlap, error):
    out = []
    for i, q in queries:
        found = [(wrong, -size, shift) for shift in range(-len(q), len(row) + 1) for size, wrong in [chroma.align(row, q, shift)] if size >= overlap and wrong <= error]
        if found:
            wrong, size, shift = min(found)
            out.append((wrong, i, shift, -size))
    return sorted(out)


def test_sound_is_compared_at_every_offset(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 32, 112, dtype=np.uint32)
    b = a ^ np.uint32(1)  # no code in common
    assert chroma.Queries([5], [a]).matches(b, 32, 0.25) == [(1 / 32, 5, 0, 112)]
    b[3] = a[93]  # one equal code, where 22 places overlap
    a[40] = b[40]
    assert chroma.Queries([5], [a]).matches(b, 32, 0.25)[0][1:] == (5, 0, 112)
    tunes = [rng.normal(size=n) for n in (64, 64, 30, 64, 40, 9, 2)]
    tunes += [np.concatenate([tunes[0][20:], tunes[1][:20]]), np.tile(tunes[2][:6], 10), np.repeat(tunes[3][:8], 8), np.zeros(64)]
    sounds = [chroma.codes(chroma.chroma(chroma.notes(t))) for t in tunes]
    asked = [(i, c) for i, c in enumerate(sounds) if len(c)]
    queries = chroma.Queries(*map(list, zip(*asked)))
    for row in sounds:
        for overlap, error in ((32, 0.25), (8, 0.3)):
            got = sorted(queries.matches(row, overlap, error))
            assert got == brute_matches(row, asked, overlap, error)
    table = spark.createDataFrame([(50 * i if i < 6 else i, t.tolist()) for i, t in enumerate(tunes)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in chroma.search(table, "vec_id", "embedding").collect()}
    asked = [(50 * i, c) for i, c in enumerate(sounds) if i < 6 and len(c)]
    for i, c in enumerate(sounds):
        own = 50 * i if i < 6 else i
        want = [w for w in brute_matches(c, asked, 32, 0.25) if w[1] != own]
        assert found[own]["n_matches"] == len(want)
        if want:
            assert tuple(found[own][f"best_{x}"] for x in ("query", "offset", "overlap")) == min(want)[1:]


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in c.STAGES][0].startswith("quality") and len(c.STAGES) == 5
    columns = docs.columns
    for _, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
    ids = {r["doc_id"] for r in docs.collect()}
    packed = {r["doc_id"] for r in c.STAGES[-1][1](spark, docs, sf).collect()}
    assert packed == ids and 0 < len(ids) <= 200


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], DOCS).repartition(3)


def outcome(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "too short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = [(i, f"a plain text number {i} that reads well and has words of its own w{i} v{i}.") for i in range(60)]
    bad = [(100 + i, f"BUY!!! NOW$$$ {i}### CHEAP*** DEAL%%% X{i}!!!") for i in range(60)]
    spark.createDataFrame([*((i, 1, 0) for i, _ in good), *((i, 0, 0) for i, _ in bad)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), good, bad


def test_decontamination_judges_rows(spark, folder):
    import corpus_pipeline as c

    rows = [(1, f"so {PASSAGE} it goes"), (1, "a clean text of its own words here"), (None, PASSAGE.upper()), (None, "clean too"), (2, None), (3, ""), (3, "")]
    want = [r for r in rows if "alpha" not in (r[1] or "").lower()]
    assert outcome(c.decontamination(spark, corpus(spark, rows), folder[0])) == sorted(want, key=repr)
    assert c.decontamination(spark, corpus(spark, []), folder[0]).count() == 0


def test_quality_judges_rows(spark, folder):
    import corpus_pipeline as c

    path, good, bad = folder
    rows = [*good, *bad, (500, bad[0][1]), (500, good[3][1]), (None, bad[1][1]), (None, good[1][1]), (501, good[2][1]), (501, good[2][1]), (502, None), (503, "")]
    docs = corpus(spark, rows)
    verdict = {}
    for r in cotrain.classify(docs.withColumn("doc_id", F.xxhash64("doc_id", "text")), spark.read.parquet(f"{path}/labels.parquet").limit(0)).collect():
        verdict[r["doc_id"]] = r["accepted"]
    assert all(verdict.values())
    kept = outcome(c.quality(spark, docs, path))
    want = [r for r in rows if r[1] and r[1].startswith("a plain")]
    assert [r for r in kept if r[1]] == sorted(want, key=repr)
    assert c.quality(spark, corpus(spark, []), path).count() == 0


def test_near_dedup_keeps_one_row(spark, folder):
    import corpus_pipeline as c

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (None, text), (None, text), (4, text + " x"), (None, "lonely words"), (None, "lonely words"), (2, None), (3, "  ")]
    assert outcome(c.near_dedup(spark, corpus(spark, rows), folder[0])) == sorted([(1, text), (None, "lonely words"), (2, None)], key=repr)
    clash = corpus(spark, rows).withColumn("own", F.lit(3)).withColumn("node", F.lit("x")).withColumn("root", F.lit(None).cast("int"))
    assert c.near_dedup(spark, clash, folder[0]).count() == 3


def test_pipeline_is_its_stages_by_hand(spark, folder, tmp_path):
    """A plain version of the whole: what is dropped and what is left of each text."""
    import corpus_pipeline as c

    path, good, bad = folder
    line = "this very line is in many of the texts again"
    base = " ".join(f"n{i}" for i in range(60))
    rows = [*good, *bad, (200, f"{line}\nfirst of them all has more words"), (201, f"{line}\nsecond has other words than that"), (202, base), (203, base + " extra"), (204, f"see {PASSAGE} here"), (None, base)]
    corpus(spark, rows).write.parquet(f"{path}/documents.parquet")
    got = {}
    for r in c.run(spark, path).collect():
        got.setdefault(r["doc_id"], 0)
        got[r["doc_id"]] += r["length"]
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left = {**dict(good), 200: rows[120][1], 201: "second has other words than that", 202: base, None: ""}  # its one line went as a repeat
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in left.items()}


def test_all_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
