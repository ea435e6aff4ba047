"""Operators of the subpackage: against SQL or brute force, and on awkward rows."""

import collections
import html
import itertools
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelloom.llm import decontaminate, language, lines, mixing, near, quality, tokens, topk, toxicity
from labelloom.llm.html import content_blocks, extract_main_text, main_text, max_flow_source_side
from labelloom.llm.labels import fold

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like outputs."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", "a", 1), (4, "one two three four five six\nB", None, "b", 1),
        (4, "one two three four five six\nB", None, "b", 1), (5, "!?", "de", "b", 2), (None, "one two", "en", "a", 7),
    ]
    extra = [F.lit("x").alias(c) for c in ("score", "class_id", "n_lines", "stream", "slot", "n_tokens", "lang_pred", "item_id", "y")]
    return spark.createDataFrame(rows, DOC).select("*", *extra)


@pytest.fixture(scope="module")
def no_docs(odd_docs):
    return odd_docs.where("false")


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def bag(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def test_html_by_hand():
    page = """<header><h1>Site</h1><a href=x>Home</a></header><div id="cookie-notice">We use cookies.</div><main><article>
      <h1>A  title</h1><p>Hello <b>wor</b>ld &amp; co.<ul><li>one<li>two</ul><script>var t="</p>";</script><p>End&nbsp;here</article>
      <section class="comments"><p>Great article, I really loved reading it all the way to the end.</p></section></main>
      <aside><p>Side text.</p></aside><form><label>Name</label></form><footer>foot &copy; us</footer>"""
    assert content_blocks(page) == ["A title", "Hello world & co.", "one", "two", "End here"]
    assert main_text(None) == main_text("") == main_text("<p>") == ""
    assert main_text("<article><p>" + "word " * 20_000).count("word") == 20_000


def test_html_hidden_inline_elements_end():
    def texts(inner):
        return content_blocks(f"<article>{inner}</article>")

    assert texts('<p>Some text <i class="icon" aria-hidden="true"></i> and more.</p><p>Next one.</p>') == ["Some text and more.", "Next one."]
    assert texts('<i aria-hidden="true">x</i><p>First one.</p><p>Next one.</p>') == ["First one.", "Next one."]
    assert texts('<p>Seen <span hidden>not <span>nor</span> this</span> again.</p>') == ["Seen again."]
    assert texts('<p>Seen <b style="display: none">not this</p><p>Next one.</p>') == ["Seen", "Next one."]
    assert texts('<p>Seen <a href="x" hidden>not this</a> again.</p>') == ["Seen again."]
    assert texts('<p>Seen <span class="overflow-hidden">as well</span> here.</p>') == ["Seen as well here."]
    for start in ("<body>", "", "<div>"):
        page = f'<html><head><meta charset="utf-8"><title>T</title><script>x</script>\n{start}<article><p>Text of the page.</p></article>'
        assert content_blocks(page) == ["Text of the page."]
    assert content_blocks("<head><title>T</title>Bare words of this page, here.") == content_blocks("Bare words of this page, here.")


def test_html_on_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "<article><p>cut &am", "t")], "page_id long, html string, text string")
    assert [r["text"] for r in extract_main_text(df).orderBy("page_id").collect()] == ["", "", "cut &am"]
    assert extract_main_text(df.where("false")).count() == 0


def test_least_cut_is_least():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 6
        edges = [(int(a), int(b), float(rng.integers(0, 9)), float(rng.integers(0, 9))) for a, b in itertools.combinations(range(n), 2)]
        cost = lambda side: sum(f * (side[a] and not side[b]) + g * (side[b] and not side[a]) for a, b, f, g in edges)
        found = max_flow_source_side(n, edges, 0, n - 1)
        assert found[0] and not found[n - 1]
        assert cost(found) == min(cost((True, *m, False)) for m in itertools.product((False, True), repeat=n - 2))


def test_articles_of_pages(spark, small_dir):
    for row in spark.read.parquet(f"{small_dir}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", row["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", body))
        assert main_text(row["html"]) == " ".join(p for p in parts if p)


ODD_TEXTS = [
    "", "  a b  ", " ", "     ", "日本 語", "▁▁a", "<0x41>", "a<s>b", "x</s>", "tag:<0x41><0x42>", "<unk>", "def f():\n    return 1", "a  b", "a                   b",
    "the quick brown fox", "hello world, this is a normal sentence about tokenizers", "\t\ttabs", "é" * 50, "x" * 300,
]


def test_token_counts_equal_the_library(spark, small_dir, odd_docs, no_docs):
    """Whole texts against another implementation of the unigram search, over the same pieces and scores."""
    from tokenizers import Tokenizer, models

    vocabulary = tokens.read_vocabulary()
    exact = Tokenizer(models.Unigram([("\0unknown", min(x for _, x in vocabulary.pieces)), *vocabulary.pieces], unk_id=0, byte_fallback=False))
    plain = tokens.Vocabulary(vocabulary.pieces, False)
    df = spark.read.parquet(f"{small_dir}/documents.parquet").select("text")
    df = df.union(spark.createDataFrame([(t,) for t in ODD_TEXTS + ["😀 a 😀😀"]], "text string"))
    for row in tokens.count_tokens(df, plain).collect():
        marked = "▁" + row["text"].replace(" ", "▁") if row["text"] else ""
        assert row["n_tokens"] == len(exact.encode(marked).ids), row["text"]
    assert {r["n_tokens"] for r in tokens.count_tokens(odd_docs, vocabulary).where("text IS NULL OR text = ''").collect()} == {0}
    assert tokens.count_tokens(no_docs, vocabulary).count() == 0


def test_unknown_characters_count_as_their_bytes():
    counter = tokens.UnigramCounter(tokens.read_vocabulary())
    assert counter.text("🜚🜚") == 1 + 8 and counter.text("\0") == 1 + 1


def test_control_and_byte_pieces_are_ordinary_text():
    vocabulary = tokens.read_vocabulary()
    assert not {"<s>", "</s>", "<unk>", "<0x41>"} & {p for p, _ in vocabulary.pieces} and vocabulary.byte_fallback
    counter = tokens.UnigramCounter(vocabulary)
    assert counter.text("a<s>b") > 3 and counter.text("<0x41>") > 3
    assert counter.text("the quick brown fox") <= 5


def test_tied_segmentations_take_the_longest_last_piece():
    counter = tokens.UnigramCounter(tokens.Vocabulary([("▁", 0.0), ("▁a", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁ab", -2.0)], False))
    assert counter.text("ab") == 1


def test_pieces_across_words_keep_the_text_whole():
    counter = tokens.UnigramCounter(tokens.Vocabulary([("▁", -1.0), ("a", -1.0), ("a▁a", -1.5)], False))
    assert counter.whole and counter.text("a a") == 2


def test_pfair_lag_is_below_one_block():
    for weights in ([0.9] + [0.01] * 10, [1, 2, 3, 5, 8], [1], [0.5, 0.5]):
        shares = mixing.quotas(weights, 200)
        slots = mixing.pfair_slots(shares)
        assert sorted(itertools.chain(*slots)) == list(range(200))
        for q, own in zip(shares, slots):
            assert all(abs(sum(s < t for s in own) - t * q / 200) < 1 for t in range(201))


def test_pfair_lag_is_against_the_weights_themselves():
    ends = [7, 400, 30] + [25] * 17
    for weights, counts in (([9.5] + [1.0] * 19, [1_000] + [106] * 19), ([0.1, 3**0.5, 0.7] + [0.3] * 17, ends), ([2.0**-40, 1.0], [3, 9])):
        exact, fluid, taken = [Fraction(w) for w in weights], [Fraction(0)] * len(weights), [0] * len(weights)
        order = list(mixing.pfair_order(mixing.whole(weights), counts))
        assert collections.Counter(order) == dict(enumerate(counts))
        for i in order:
            taken[i] += 1
            left = Fraction(1)  # of the slot, shared by the streams that have not ended
            while left and any(f < n for f, n in zip(fluid, counts)):
                on = [j for j, n in enumerate(counts) if fluid[j] < n]
                total = sum(exact[j] for j in on)
                step = min(left / total, min((counts[j] - fluid[j]) / exact[j] for j in on))
                for j in on:
                    fluid[j] += exact[j] * step
                left -= step * total
            assert all(abs(f - n) < 1 for f, n in zip(fluid, taken))


def test_mixture_follows_the_weights_themselves(spark):
    docs = spark.range(2_000).selectExpr("id AS doc_id", "if(id < 600, 'hot', concat('s', id % 19)) AS source", "repeat('x', 10) AS text")
    weights = {"hot": 9.5} | {f"s{i}": 1.0 for i in range(19)}
    found = mixing.mix_sources(docs, weights=weights, block_chars=10).toPandas()
    hot = np.sort(found[found.source == "hot"].slot.to_numpy())
    assert (abs(hot - np.arange(len(hot)) * 3) <= 3).all()


def test_every_source_is_a_stream(spark):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "if(id < 1800, nullif(concat('s', id % 600), 's7'), 'hot') AS source", "repeat('x', 10) AS text")
    for weights in (None, {"hot": 2.0, "s1": 1.0}):
        found = mixing.mix_sources(docs, weights=weights, block_chars=10).toPandas()
        assert len(found) == 3_000 and found.stream.nunique() == 601
        assert found.fillna({"source": "none"}).groupby("stream").source.nunique().max() == 1
        assert found.slot.is_unique


def test_mixture_keeps_all_rows(spark, small_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    found = mixing.mix_sources(docs, block_chars=5_000).toPandas()
    assert sorted(found.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert found.groupby(["stream"]).source.nunique().max() == 1
    assert (found.groupby("slot")[["stream", "block"]].nunique() == 1).all(axis=None)
    ends = found.groupby(["stream", "block"]).n_chars.sum()
    assert ends.max() <= 5_000 + found.n_chars.max()
    assert mixing.mix_sources(odd_docs).count() == odd_docs.count()
    assert mixing.mix_sources(odd_docs, weights={"a": 3.0, "zz": 1.0}).count() == odd_docs.count()
    assert mixing.mix_sources(no_docs).count() == 0


def test_line_dedup_by_hand(spark, odd_docs, no_docs):
    long = "This line is long enough"
    rows = [(i, f"own {i}\n  {long.upper() if i % 2 else long}\t\n{long}") for i in range(4)] + [(9, None), (10, ""), (11, "\n")]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup_lines(df).collect()}
    assert found[0] == (3, 2, "own 0") and found[3] == (3, 0, rows[3][1])
    assert found[9] == found[10] == (1, 0, "") and found[11] == (2, 0, "\n")
    assert lines.dedup_lines(odd_docs).count() == odd_docs.count() and lines.dedup_lines(no_docs).count() == 0


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = np.repeat(grams[:50], rng.integers(1, 20, 50)), np.repeat(grams[10:], rng.integers(1, 20, 50))
    x, y = collections.Counter(a.tolist()), collections.Counter(b.tolist())
    true = sum((x & y).values()) / sum((x | y).values())
    both = near.bag_minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), m=20_000)
    assert abs((both[0] == both[1]).mean() - true) < 0.02


def test_components_go_on_from_earlier_labels(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(20, 40)], "a long, b long")
    first = near.components(chain)
    assert {r["comp"] for r in first.collect()} == {20}
    more = chain.union(spark.createDataFrame([(30, 7), (50, 51)], "a long, b long"))
    found = {r["node"]: r["comp"] for r in near.components(more, first).collect()}
    assert found == {7: 7, 50: 50, 51: 50} | {i: 7 for i in range(20, 41)}
    assert near.components(chain.where("a < 0")).collect() == []


def test_near_duplicates_equal_brute_force(spark, small_dir, odd_docs):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").limit(120).collect()]
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    for i in range(60):  # a family whose members are far from some and near to others
        own = list(base)
        for p in rng.choice(150, int(rng.integers(0, 8)), replace=False):
            own[p] = f"x{i}_{p}"
        docs.append((10_000 + i, " ".join(own)))
    docs += [(20_000, docs[0][1].upper() + " !"), (20_001, ""), (20_002, None), (20_003, "two words"), (20_004, "Two words.")]
    bags, parent = {i: bag(t) for i, t in docs}, {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(bags, 2):
        union = sum((bags[a] | bags[b]).values())
        if union and sum((bags[a] & bags[b]).values()) >= 0.8 * union:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    assert {r["doc_id"]: r["class_id"] for r in near.near_duplicates(df).collect()} == {i: root(i) for i in parent}
    odd = near.near_duplicates(odd_docs).collect()
    assert len(odd) == odd_docs.count() and {r["class_id"] for r in odd if r["doc_id"] is None} == {None}


def test_tiles_of_a_cut_and_reordered_passage(spark, odd_docs, no_docs):
    item = [f"t{i}" for i in range(30)]
    docs = [
        (1, " ".join(["a", *item[15:], "b c d", *item[:15]])), (2, " ".join(item[:10])), (3, "nothing of it here at all"), (4, None),
        (5, " ".join(item * 3)), (6, " ".join(x for i in range(0, 30, 4) for x in [*item[i : i + 4], "gap"])),
    ]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (None, " ".join(item)), (10, "nothing of")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for bound in ({}, {"max_items": 1}):
        found = {(r["doc_id"], r["item_id"]): (r["tiles"], r["covered"]) for r in decontaminate.find_leaks(df, bench, **bound).collect()}
        assert found == {(1, 7): (2, 30), (5, 7): (1, 30), (3, 10): (1, 2)}
    assert decontaminate.find_leaks(odd_docs, bench).count() == 0 and decontaminate.find_leaks(no_docs, bench).count() == 0
    assert decontaminate.find_leaks(df, bench.where("false")).count() == 0


def plain_tiles(doc, item, least):
    """Greedy string tiling by looking for the longest common run of free words, again and again."""
    number = {w: n for n, w in enumerate(dict.fromkeys(doc + item))}
    a, b = np.array([number[w] for w in doc]), np.array([number[w] for w in item])
    doc_free, item_free, tiles = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool), 0
    while True:
        best, run = (0, 0, 0), np.zeros(len(b) + 1, dtype=int)
        for p in range(len(a) - 1, -1, -1):
            run[:-1] = np.where((b == a[p]) & item_free & doc_free[p], run[1:] + 1, 0)
            top = int(run.max())
            if top >= best[0]:
                best = (top, p, int(run.argmax()))
        if best[0] < least:
            return tiles, int((~item_free).sum())
        n, p, i = best
        doc_free[p : p + n], item_free[i : i + n], tiles = False, False, tiles + 1


def test_matches_equal_plain_tiling_on_repeating_texts():
    rng = np.random.default_rng(8)
    for size in (2, 3, 5):
        items = [" ".join(f"w{x}" for x in rng.integers(0, size, int(n))) for n in rng.integers(1, 40, 12)]
        docs = [" ".join(f"w{x}" for x in rng.integers(0, size, int(n))) for n in rng.integers(1, 80, 12)] + [items[0] + " x " + items[3]]
        found = {(d, i): (t, c) for d, i, t, c, *_ in decontaminate.matches(list(range(13)), docs, decontaminate.seeds_of(list(range(12)), items), 0.5)}
        for d, i in itertools.product(range(13), range(12)):
            tiles, covered = plain_tiles(words(docs[d]), words(items[i]), min(5, len(words(items[i]))))
            assert found.get((d, i)) == ((tiles, covered) if covered >= 0.5 * len(words(items[i])) else None)


def test_leaks_equal_plain_tiling_over_the_tables(spark, small_dir):
    docs, bench = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]): (r["tiles"], r["covered"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    seeds = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in items.items()}
    expected = {}
    for r in docs.collect():
        w = words(r["text"])
        own = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        for i, item in items.items():
            if own & seeds[i]:
                tiles, covered = plain_tiles(w, item, 5)
                if covered >= 0.5 * len(item):
                    expected[r["doc_id"], i] = (tiles, covered)
    assert found == expected and len(found) > 0


def test_hot_phrases_and_repeats_are_tiled_in_no_time():
    import time

    opening = " ".join(f"p{i}" for i in range(12))
    items = [opening + " " + " ".join(f"i{k}x{j}" for j in range(30)) for k in range(2_000)] + ["w " * 2_000]
    groups = decontaminate.seeds_of(list(range(2_001)), items)
    docs = [opening + " " + " ".join(f"d{k}x{j}" for j in range(128)) for k in range(20)] + [items[3], "w " * 2_000]
    start = time.perf_counter()
    found = list(decontaminate.matches(list(range(22)), docs, groups, 0.5))
    assert [(d, i) for d, i, *_ in found] == [(20, 3), (21, 2_000)] and time.perf_counter() - start < 1


def test_quality_on_held_out_rows(spark, small_dir, odd_docs, no_docs):
    path = small_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = quality.fit_quality(docs, labels, "quality", fold("doc_id", 3) != 1)
    out = quality.score_quality(docs, model).join(labels, "doc_id").where(fold("doc_id", 3) == 1).toPandas()
    assert ((out.score >= 0.5) == (out.quality == 1)).mean() > 0.93
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(odd_docs, model).collect())
    empty = quality.fit_quality(no_docs, labels, "quality", F.lit(True))
    assert {r["score"] for r in quality.score_quality(odd_docs, empty).collect()} == {0.5}


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3_000, 4))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert model.pairs[0] == (1, 0) and ((model.score(x) > 0.5) == y).mean() > 0.9


def test_language_on_held_out_rows(spark, small_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{small_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = language.fit_language(docs, fold("doc_id", 4) != 2)
    out = language.identify_language(docs, model).where(fold("doc_id", 4) == 2).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95
    odd = {r["doc_id"]: r["lang_pred"] for r in language.identify_language(odd_docs, model).collect()}
    assert odd[1] == odd[2] == odd[5] == "und" and odd[3] in model.languages
    assert language.fit_language(no_docs, F.lit(True)).decode("words") == ("und", 0.0, True)
    for n in (1, 2, 4, 7, 20):
        code = language.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == n


def test_toxicity_restores_disguised_words(spark, small_dir, odd_docs, no_docs):
    path = small_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, "toxic", fold("doc_id", 3) != 1)
    restorer = toxicity.Restorer(model.costs)
    for hidden, plain in (("m0ron", "moron"), ("scuuuum", "scum"), ("l.o.s.e.r", "loser"), ("tr@sh", "trash"), ("c l o w n", "clown")):
        assert plain in restorer.words(f"the {hidden} of")[1]
    out = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(fold("doc_id", 3) == 1).toPandas()
    assert (out.score[out.toxic == 0] < 0.7).mean() > 0.97 and (out.score[out.toxic == 1] >= 0.7).mean() > 0.6
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(odd_docs, model).collect())
    assert toxicity.fit_toxicity(no_docs, labels, "toxic", F.lit(True)).share < 0.1


def test_disguises_are_found_wherever_they_stand():
    def found(text):
        return toxicity.disguised(text, [p for p in set(text.split()) if not p.isalpha()])

    for piece in ('"h4te"', "[h4te]", "*h4te*", "(h4te)", "h4te-speech", "you/h4te", "h4te_you", "\u201ch4te\u201d", "'h4te!'/x", "\u00a1h4te!", "h4te"):
        assert "h4te" in found(f"the {piece} of"), piece
    assert "a.s.s" in found("an a.s.s, no") and "f o x" in found("the f o x ran") and not found("at 1 2 3 or 1.2.3 now")
    assert {"даааа", "ჰააა", "niiice"} <= found("ну даааа ჰააა so niiice... ---")
    assert not found("plain words, 'quoted' and [bracketed] or well-known ones; i am a man. don't!")


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(700, 5)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(800, None), (801, [1.0, None]), (802, [float("nan")] * 5), (None, [1.0])]
    rows += [(803, [1e17] * 5), (804, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for part in (df, df.where("vec_id < 5")):
        ints = {}
        for r in part.collect():
            if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]):
                ints[r[0]] = [int(np.floor(1024 * x)) for x in r[1]] + [0] * (5 - len(r[1]))
        dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
        want = []
        for q in (i for i in ints if i % 50 == 0):
            best = sorted((-dot(ints[q], v), i) for i, v in ints.items() if i != q)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
        got = topk.top_k(part, F.col("id") % 50 == 0, block_rows=64, pack_rows=4, slice_blocks=3, edge_blocks=2).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0
    flat = spark.createDataFrame([(i, []) for i in range(3)], "vec_id long, embedding array<double>")
    got = topk.top_k(flat, F.col("id") == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_top_k_of_tables_with_clashing_columns(spark):
    names = "block pack query_id rank score floor slice cluster".split()
    df = spark.range(30).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("embedding"), *(F.lit(7).alias(c) for c in names))
    got = topk.top_k(df, F.col("id") == 20, k=2).collect()
    assert sorted(map(tuple, got)) == [(20, 1, 29, 20480 * 29696), (20, 2, 28, 20480 * 28672)]


@pytest.mark.parametrize("n,share", [(600, 1.0), (2400, 0.4), (4800, 0.3)])
def test_top_k_sends_only_blocks_that_reach_a_floor(spark, monkeypatch, n, share):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(12, 16)) * 4
    data = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 16)) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    tables = []
    keep = lambda t: tables.append(topk_stage(t)) or tables[-1]
    topk_stage = topk.stage
    monkeypatch.setattr(topk, "stage", keep)
    got = topk.top_k(df, F.col("id") % 10 == 0, block_rows=16, pack_rows=8, slice_blocks=4, edge_blocks=16).collect()
    ints = np.floor(1024 * data).astype(np.int64)
    scores = ints[::10] @ ints.T
    want = []
    for at, q in enumerate(range(0, n, 10)):
        best = sorted((-scores[at, i], i) for i in range(n) if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    blocks = next(t.count() for t in tables if "largest" in t.columns)
    pairs = [t.count() for t in tables if t.columns == ["pack", "block"]]
    packs = next(t.select("pack").distinct().count() for t in tables if "floor" in t.columns)
    assert len(pairs) == 2 and sum(pairs) < blocks * packs * share


def test_packs_of_queries():
    assert topk.deal_packs({}, 4) == []
    assert topk.deal_packs({0: 2, 1: 2, 2: 1, 5: 9, 6: 4, 7: 1}, 4) == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (5, 2, 3), (6, 5, 1), (7, 6, 1)]


@pytest.mark.parametrize("name", ["op4_line_dedup", "op10_top_k"])
def test_queries_equal_sql(spark, small_dir, name):
    import duckdb

    from labelloom.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    df = QUERIES[name](spark, small_dir)
    result = con.execute(ORACLES[name])
    at = [[c[0] for c in result.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in result.fetchall())


def plain_quality(model, text):
    """A plain sum of one table entry for each feature and pair."""
    x = quality.features([text or ""])[0]
    bins = [sum(float(v) >= e for e in edges) for v, edges in zip(x, model.edges)]
    total = model.bias + sum(table[b] for table, b in zip(model.tables, bins))
    for (i, j), grid in zip(model.pairs, model.pair_tables):
        total += grid[bins[i] * quality.PAIR_BINS // quality.BINS][bins[j] * quality.PAIR_BINS // quality.BINS]
    return 1 / (1 + np.exp(-total))


def plain_classes(texts):
    """{key: keys of its class}, by comparing all pairs."""
    bags, classes = {k: bag(t) for k, t in texts.items()}, {k: {k} for k in texts}
    for a, b in itertools.combinations(bags, 2):
        small, large = sorted((sum(bags[a].values()), sum(bags[b].values())))
        if large and small >= 0.8 * large and classes[a] is not classes[b]:
            if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                both = classes[a] | classes[b]
                classes.update((k, both) for k in both)
    return classes


def test_quality_equals_a_plain_sum_of_its_tables(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels, "quality", fold("doc_id", 3) != 1)
    for r in quality.score_quality(docs.select("doc_id", "text"), model).collect():
        assert abs(r["score"] - plain_quality(model, r["text"])) < 1e-9


def test_ids_with_several_texts_lose_none(spark, small_dir):
    base = [f"w{i}" for i in range(60)]
    near_base = " ".join(base[:-2] + ["y", "z"])
    rows = [
        (1, " ".join(base)), (1, "another text of some words that stands alone here"), (1, ""), (2, near_base), (2, near_base), (2, None),
        (3, "another text of some words that stands alone here"), (4, ""), (5, " ".join(base)), (5, near_base), (None, near_base), (6, near_base.upper()),
    ]
    crowd = [(100 + i // 3, " ".join(base[: 58 - i % 7] + [f"c{i}", f"d{i}"])) for i in range(40)]
    docs = spark.createDataFrame(rows + crowd, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("fp"))
    texts = sorted({(i, t or "") for i, t in rows + crowd if i is not None})
    classes = plain_classes({k: t for k, (_, t) in enumerate(texts)})
    least = {key: min(texts[k][0] for k in classes[n]) for n, key in enumerate(texts)}
    found = near.near_duplicates(docs)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((i, least.get((i, t or ""))) for i, t in rows + crowd), key=repr)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, small_dir)
    assert kept.columns == docs.columns
    left = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    assert left.count((None, near_base)) == 1
    named = [x for x in left if x[0] is not None]
    number = {key: n for n, key in enumerate(texts)}
    assert len(named) == len(set(named)) == len({id(c) for c in classes.values()}) == len({id(classes[number[x]]) for x in named})
    assert all(x[0] == least[x] for x in named)


def test_pipeline_equals_its_stages_by_brute_force(spark, small_dir):
    """Every stage's decision, from its own input."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    bench = [set(bag(r["text"])) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, small_dir)
        after = {r["doc_id"]: r for r in out.collect()}
        assert after.keys() <= before.keys() and len(after) == out.count()
        if name == "line dedup":
            keys = collections.defaultdict(set)
            key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
            for i, r in before.items():
                for line in (r["text"] or "").split("\n"):
                    keys[key(line)].add(i)
            gone = {k: max(v) for k, v in keys.items() if len(k) >= 20 and len(v) >= 3}
            for i, r in before.items():
                assert after[i]["text"] == "\n".join(x for x in (r["text"] or "").split("\n") if gone.get(key(x), i) == i)
        if name == "quality classifier":
            labels = spark.read.parquet(f"{small_dir}/labels.parquet")
            model = quality.fit_quality(docs, labels, "quality", fold("doc_id", 3) != 1)
            assert after.keys() == {i for i, r in before.items() if plain_quality(model, r["text"]) >= 0.5} and after.keys() != before.keys()
        if name == "minhash near-dedup":
            assert after.keys() == {min(c) for c in plain_classes({i: r["text"] for i, r in before.items()}).values()}
        if name == "benchmark decontamination":
            for i in before.keys() - after.keys():
                assert any(len(b & set(bag(before[i]["text"]))) >= 0.3 * len(b) for b in bench)
            assert not any(b <= set(bag(r["text"])) for r in after.values() for b in bench if len(b) > 1)
        if name == "source mixing":
            assert after.keys() == before.keys() and "slot" in out.columns
        else:
            assert out.columns == docs.columns
        docs, before = corpus_pipeline.stage(out), after


def test_empty_tables_pass_the_pipeline(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").where("false")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, small_dir)
        assert docs.count() == 0


ARTICLE = "<h1>A title of it</h1>" + "".join(f"<p>{'This is a full sentence of the article, with many words in it. ' * 3}Part {i}.</p>" for i in range(3))
SIDE = "<p>Read this other thing, it is good. Yes, it really is that good.</p>"
LAYOUTS = [
    '<div class="content has-sidebar"><article>{a}</article></div>',
    '<div class="post-with-comments"><div class="entry">{a}</div></div>',
    '<div class="wrapper-side"><article>{a}</article></div>',
    '<article class="post tag-news category-legal">{a}</article>',
    '<article class="post type-post status-publish hentry category-legal tag-cookies">{a}</article>',
    '<div class="sidebar-right layout"><div class="sidebar">{s}</div><main>{a}</main></div>',
    '<div id="page" class="no-sidebar"><div id="primary" class="content-area"><main class="site-main">{a}</main></div></div>',
    '<body class="single comments-open"><div class="site-header">{s}</div><div class="entry-content">{a}</div></body>',
    '<div class="widgets"><div class="post-content">{a}</div><ul class="widget">{s}</ul></div>',
    '<section class="search-layout"><div class="article-body">{a}</div><div class="related-posts">{s}</div></section>',
    '<article>{a}</article><section class="comments"><article class="comment">{s}</article></section>',
    '<div role="main">{a}</div><div role="complementary">{s}</div>',
    '<div class="menu-open"><article>{a}<footer>{s}</footer></article><div class="post-comments">{s}</div></div>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_articles_of_many_layouts(layout):
    expected = " ".join(re.sub("<[^>]*>", " ", ARTICLE).split())
    assert main_text(layout.format(a=ARTICLE, s=SIDE)) == expected


def test_an_article_keeps_the_title_in_its_header():
    assert main_text(f"<header>{SIDE}</header><article><header><h1>Own title</h1></header>{ARTICLE}</article>").startswith("Own title A title")


@pytest.mark.parametrize("sign", list(".-=!#*~?\"'(<+"))
def test_long_runs_of_signs_take_no_time(sign):
    import time

    start = time.perf_counter()
    for text in (sign * 100_000 + "5a", "page" + sign * 100_000 + "5a", "a" + sign * 100_000, (sign + ".") * 50_000 + "h4te"):
        toxicity.disguised(text, [text])
    assert time.perf_counter() - start < 5


def test_signs_around_a_word_go_as_by_the_pattern():
    head, tail = re.compile(r"^(?:[(<!|+¡]|([^\w\s])\1+)+"), re.compile(r"(?:[.,;:!?)\]\"'…]|([^\w\s])\1+)+$")
    for signs in itertools.product(".!(#-", repeat=4):
        for text in ("".join(signs), "a" + "".join(signs), "".join(signs) + "5a", "x-".join(signs)):
            assert toxicity.headless(text) == head.sub("", text) and toxicity.tailless(text) == tail.sub("", text)


def test_viterbi_reads_as_listing_all_readings():
    rng = np.random.default_rng(4)
    costs = rng.random((toxicity.SYMBOLS,) * 3).astype(np.float32) * 4
    code = lambda c: int(toxicity._CODE[ord(c)])

    def listed(word):
        best = (np.inf, "")
        choices = []
        for before, c in zip(" " + word, word):
            if c.isalpha():
                choices.append([(c, 0.0)] + ([("", toxicity.DROP)] if c == before else []))
            else:
                choices.append([(x, toxicity.SWAP) for x in toxicity.DISGUISES.get(c, "")] + [("", toxicity.DROP if c in toxicity.SEPARATORS else toxicity.DROP_SIGN)])
        for reading in itertools.product(*choices):
            letters, a, b = "".join(x for x, _ in reading), toxicity.BOUNDARY, toxicity.BOUNDARY
            cost = sum(x for _, x in reading)
            for c in letters:
                cost, a, b = cost + float(costs[a, b, code(c)]), b, code(c)
            best = min(best, (cost + float(costs[a, b, toxicity.BOUNDARY]), letters))
        return best[1]

    for word in ("h4te", "1d10t", "h.a.t.e", "baaad", "$t0p", "6r6", "x", "ll1ll", "a-@-a", "5000b"):
        assert toxicity.decode(word, costs) == listed(word)


def test_three_hundred_languages_are_all_learnt(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k, j: "".join(letters[(k * 7 + j * 3 + i * (k // 26 + 1)) % 26] for i in range(6)) + letters[k % 26] + letters[k // 26]
    rows = [(k * 10 + d, " ".join(word(k, (d + j) % 5) for j in range(40)), f"l{k:03}") for k in range(300) for d in range(3)]
    docs = spark.createDataFrame([*rows, (9_999, "123", "digits")], "doc_id long, text string, lang string")
    model = language.fit_language(docs, F.lit(True))
    assert len(model.languages) == 300
    sure = sum(model.decode(text)[0] == lang for _, text, lang in rows)
    assert sure >= 0.95 * len(rows)


def test_language_equals_a_plain_search_for_the_nearest_codeword(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    model = language.fit_language(docs, fold("doc_id", 4) != 2)
    for r in language.identify_language(docs.select("doc_id", "text"), model).limit(60).collect():
        grams = language.trigrams(r["text"] or "")
        losses = []
        for word in model.code:
            loss = 0.0
            for b, bit in enumerate(word):
                margin = sum(float(model.weights[g, b]) for g in grams) / max(len(grams), 1)
                loss += model.bit_weight[b] * np.log1p(np.exp(-language.SHARPNESS * bit * min(max(margin, -4), 4)))
            losses.append(loss)
        if r["lang_pred"] != language.UNKNOWN:
            assert model.languages[int(np.argmin(losses))] == r["lang_pred"]


def test_repeated_ids_count_once_in_the_fit(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    from labelloom.llm.labels import labelled_sample

    found = labelled_sample(docs, labels, "quality", "doc_id", "text", F.lit(True)).collect()
    assert sorted((r["id"], r["text"], r["y"]) for r in found) == [(1, "a", 1), (2, "", 0)]
