"""The training-data operators against brute force, libraries and round trips, with odd rows."""

import hashlib
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import context_tree, cover_tree, html_content, langid, lsh_forest, multi_index, packing, sentencepiece_bpe, toxicity, warc
from tidewell.llm.components import connected_components
from tidewell.llm.registry import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "  a  b ", "Grüße\n\tan alle 👋🏽", "x" * 5000, "same words again", "same words again", "<s> ▁ </s>", "é ﬁ ½ ٣"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, a repeated row, and a null id."""
    rows = [(i, t, "en", None, None) for i, t in enumerate(ODD)] + [(0, "", "en", None, None), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_sentencepiece_equals_the_library(spark, docs, corpus):
    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    every = docs.unionByName(corpus.select(docs.columns))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in sentencepiece_bpe.token_digests(every, model).collect())
    want = []
    for r in every.collect():
        ids = lib.encode(r["text"] or "")
        want.append((str(r["doc_id"]), len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids) if ids else "")))
    assert got == sorted(want)
    assert sentencepiece_bpe.token_digests(docs.limit(0), model).count() == 0


def test_sentencepiece_decodes_its_ids(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    own = sentencepiece_bpe.coder(sentencepiece_bpe.read_model(path))
    rng = np.random.default_rng(6)
    for _ in range(300):  # any ids, byte pieces that are no valid text included
        ids = rng.integers(0, own.library.get_piece_size() if rng.random() < 0.5 else 300, rng.integers(1, 12)).tolist()
        assert own.decode(ids) == lib.decode(ids), ids
    long = [(1, "x" * 300_000), (2, "ab " * 100_000), (3, "é漢" * 50_000)]
    got = {r["doc_id"]: r for r in sentencepiece_bpe.encode_documents(spark.createDataFrame(long, "doc_id long, text string"), path).collect()}
    for k, text in long:
        assert got[k]["ids"] == lib.encode(text) and got[k]["decoded"] == lib.decode(lib.encode(text))


def test_packing_places_every_piece_once(spark, docs, corpus):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    every = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(corpus.select((F.col("doc_id") + 100).alias("doc_id"), "text", "lang", "source", "n_chars"))
    got = packing.pack_documents(every, path).toPandas()
    for r in every.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got.doc_id == r["doc_id"]].sort_values("piece")
        assert own.length.tolist() == [len(ids[k : k + 4096]) for k in range(0, len(ids), 4096)]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[k : k + 4096].tobytes()) for k in range(0, len(ids), 4096)]
        assert own.start.tolist() == list(range(0, len(ids), 4096))
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == [0, *bin_.length.cumsum().tolist()[:-1]] and bin_.length.sum() <= 4096
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 4096 + 1
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_packing_ids_do_not_depend_on_unicode_tables():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        own = packing.word_ids(f.read())
    newer = [0x1C89, *range(0xA7CB, 0xA7DD), *range(0x105C0, 0x105F4), *range(0x13460, 0x13480), *range(0x16100, 0x1611E), 0x1FADF, 0x40000]
    for point in [*newer, *range(0xC0, 0x3000, 7), *range(0x1F300, 0x1F700, 11)]:
        for text in (f"Word{chr(point)}Next 1{chr(point)}2", f"{chr(point)} {chr(point) * 2}"):
            assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(point)


def test_packing_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "same words in each row")] * 300 + [(None, "no id here")] * 200 + [(None, None), (2, "")]
    got = packing.pack(packing.piece_table(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("word_bpe_49k.json")), group_size=40, capacity=64).toPandas()
    assert len(got) == 502 and (got.groupby("sequence_id").length.sum() <= 64).all()
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == [0, *bin_.length.cumsum().tolist()[:-1]]
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 64 + 1


def test_packing_of_small_groups_is_nearly_the_best():
    def fewest(left, rooms):
        if not left:
            return len(rooms)
        best = fewest(left[1:], [*rooms, 10 - left[0]])
        for k, room in enumerate(rooms):
            if room >= left[0] and rooms.index(room) == k:
                best = min(best, fewest(left[1:], [*rooms[:k], room - left[0], *rooms[k + 1 :]]))
        return best

    rng = np.random.default_rng(12)
    extra = 0
    for _ in range(60):
        lengths = sorted(rng.integers(2, 8, 9).tolist(), reverse=True)
        extra += len(packing.improve(packing.best_fit(lengths, 10), lengths, 10)) - fewest(lengths, [])
    assert 0 <= extra <= 2


def test_local_search_empties_bins():
    lengths = [6, 5, 5, 4, 4, 3, 3]
    bins = packing.improve([[0], [1], [2], [3], [4], [5], [6]], lengths, 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(7))


def test_local_search_goes_on_to_the_end():
    rng = np.random.default_rng(9)
    for _ in range(40):
        lengths = rng.integers(100, 900, 60).tolist()
        bins = packing.improve(packing.best_fit(lengths, 1000), lengths, 1000)
        assert sorted(i for b in bins for i in b) == list(range(60))
        fill = [sum(lengths[i] for i in b) for b in bins]
        live = [k for k in range(len(bins)) if fill[k] < 1000]
        assert all(packing._exchange(bins[g], bins[t], lengths, 1000 - fill[t], fill[g], fill[t]) is None for g in live for t in live if fill[g] < fill[t])


def test_html(spark):
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><header>Site</header><article><h1>Title &amp;\n more</h1><p>First   <b>bold</b> words of a text.<br>next"
        "<p>Second &lt;block&gt; here with some words.<script>var a='<p>x</p>'</script></p><ul><li>one thing</li><li>two</li></ul></article><div class='comments'><p>I disagree</p></div><footer>Legal</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed words stay here"), (None, None, "<<>>&&&")]
    got = {r["page_id"]: r for r in html_content.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Title & more\nFirst bold words of a text. next\nSecond <block> here with some words.\none thing\ntwo"
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "unclosed words stay here" and got[1]["n_chars"] == len(got[1]["text"])


def test_html_keeps_articles_in_wrappers():
    weights = html_content.default_weights()
    body = "<p>The ferry leaves the harbour at nine and reaches the island before noon on most days.</p><p>Its crew of six has sailed together for many years.</p>"
    want = "The ferry leaves the harbour at nine and reaches the island before noon on most days.\nIts crew of six has sailed together for many years."
    beside = "<div class='sidebar'><a href=x>More of this</a> and that</div>"
    for page in (
        f"<html><head><title>no</title><meta charset=utf-8><body>{body}</body></html>",
        f"<head><title>no</title>{body}",
        *(f"<body><div class='{name}'>{inner}{beside}</div></body>" for name in ("content-sidebar-wrap", "container has-sidebar", "no-sidebar", "page-header-fixed", "legal-news", "search-page") for inner in (body, f"<main>{body}</main>", f"<article>{body}</article>")),
        f"<body><form id='aspnetForm'><div class='search'>Find it</div>{body}</form></body>",
        f"<body><main><div class='has-sidebar'>{body}</div></main></body>",
        f"<body><aside><article>Teaser text</article></aside><div>{body}</div></body>",
    ):
        assert html_content.extract(page, weights) == want, page
    assert html_content.extract("<head><title>no</title>Bare words of a page without any tags", weights) == "Bare words of a page without any tags"
    # Comments stay out, however long, and so does a sidebar of articles beside a main.
    comments = "<div id='comments'>" + f"<article class='comment-body'>{body}</article>" * 5 + "</div>"
    assert html_content.extract(f"<body><div class='has-sidebar'><article>{body}</article>{comments}</div></body>", weights) == want
    assert html_content.extract(f"<body><main><article>{body}</article>{comments}</main></body>", weights) == want
    assert html_content.extract(f"<body><main>{body}</main><div class='related'><article>{body}</article></div></body>", weights) == want


def test_html_keeps_what_stands_in_the_articles_own_element():
    weights = html_content.default_weights()
    body = "<p>The ferry leaves the harbour at nine and reaches the island before noon on most days, whatever the weather.</p><p>Its crew of six has sailed together for many years.</p>"
    want = [*("The ferry leaves the harbour at nine and reaches the island before noon on most days, whatever the weather.", "Its crew of six has sailed together for many years.")]
    box = "<div class='widget'><h3>More of this</h3><p>" + "Other readers liked these stories of the sea " * 3 + "</p></div>"
    comments = "<div id='disqus'>" + "<p>I went there once and did not like it at all, said a reader</p>" * 9 + "</div>"
    for page, blocks in (
        (f"<body><div><h1>Ferry</h1>{box}{body}</div></body>", ["Ferry", *want]),  # a short title before a box
        (f"<body><div>{body}{box}{box}<p>The end.</p></div><div>{box}</div></body>", [*want, "The end."]),
        (f"<body><div class='content'><h1>Ferry</h1>{body}</div>{comments}</body>", ["Ferry", *want]),  # more comments than article
        (f"<body><div><p>Buy now! 50% off!</p></div>{box}<div>{body}</div></body>", want),  # another element's
    ):
        assert html_content.extract(page, weights) == "\n".join(blocks), page


def test_html_region_is_not_cut_by_tables_lists_or_names():
    weights = html_content.default_weights()
    first, last = "The ferry leaves the harbour at nine and reaches the island before noon on most days.", "Its crew of six has sailed together for many years."
    p, q = f"<p>{first}</p>", f"<p>{last}</p>"
    rows = "<table>" + "".join(f"<tr><td>{i}</td><td>boat</td></tr>" for i in range(30)) + "</table>"
    links = "<ul>" + "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(40)) + "</ul>"
    for page, want in (
        (f"<body><nav><a href=x>Menu</a></nav><article>{p}{rows}{q}</article><footer>Legal</footer></body>", [first, *(x for i in range(30) for x in (str(i), "boat")), last]),
        (f"<article>{p}{links}{q}</article>", [first, *(f"link {i}" for i in range(40)), last]),
        (f"<article>{p}<p class='legal'>All of it is true in law.</p>{q}</article>", [first, "All of it is true in law.", last]),
        (f"<article><h1 class='article-header'>The ferry</h1>{p}</article>", ["The ferry", first]),
        (f'<body>{p}<a href="x>quote</a> after words{q}</body>', [first, "quote after words", last]),
        (f"<article><header><h1>A title</h1><p>by me</p></header>{p}<div class='ad'>Buy it now</div>{q}</article>", ["A title", first, last]),
    ):
        assert html_content.extract(page, weights) == "\n".join(want), page


def test_html_on_pages_that_were_not_learned_from(spark, sf_dir):
    import re
    from html import unescape

    weights = html_content.default_weights()
    for seed in (7, 77):
        assert sum(html_content.extract(html, weights) == "\n".join(main) for html, main in html_content.labelled_pages(200, seed=seed)) >= 195
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():  # their articles hold everything that is wanted
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1|ul|li|div)>", article))
        assert html_content.extract(r["html"], weights) == "\n".join(filter(None, blocks))
    # Without their article element, and with a table of tags between, the scan finds the same region.
    body = "".join(f"<p>{'plain words of a longer text ' * 5}{i}.</p>" for i in range(6))
    menu = "<div>" + "".join(f"<a href=/{i}>Menu {i}</a> " for i in range(12)) + "</div>"
    got = html_content.extract(f"<body>{menu}<div>{body}</div>{menu}</body>", weights).split("\n")
    assert len(got) == 6 and not any("Menu" in line for line in got)


def test_html_region_is_the_best_of_all(spark, sf_dir):
    weights = html_content.default_weights()
    for html, _ in html_content.labelled_pages(6, seed=3):
        stream = html_content.events(html)
        scores = [weights.tag(e) if e.tag else weights.word(e) * len(e.text.split()) for e in stream][:160]
        sums = np.concatenate(([0.0], np.cumsum(scores)))
        a, b = html_content.best_region(scores)
        assert sums[b] - sums[a] == pytest.approx(max(0.0, max(sums[j] - sums[: j + 1].min() for j in range(1, len(sums)))))


def test_best_region_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(50):
        s = rng.integers(-4, 4, 12)
        a, b = html_content.best_region(s.tolist())
        assert s[a:b].sum() == max([0, *(s[i:j].sum() for i in range(12) for j in range(i + 1, 13))])


def test_context_tree(spark, docs, corpus):
    import math
    from collections import Counter

    got = context_tree.score_documents(corpus).toPandas().set_index("doc_id")
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in corpus.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    c = Counter(w for k, words in texts.items() if not held[k] for w in words)
    end = sum(not h for h in held.values())
    n, v = sum(c.values()) + end, len(c) + 1
    for k, words in texts.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words) + math.log10((end + 0.5) / (n + 0.5 * (v + 1)))
        assert got.base_score[k] == pytest.approx(base) and got.held_out[k] == held[k] and got.n_tokens[k] == len(words) + 1 and got.train_tokens[k] == n
    # The probabilities of all bytes after a context add up to one.
    keys, counts = np.unique(context_tree.strings_of([b" ".join(w) + b"\n" for w in texts.values()])[0], return_counts=True)
    deep = context_tree.deep_levels(keys, counts)
    top = context_tree.top_levels(*deep[-1].parents())
    for some in keys[:: len(keys) // 5]:
        after = (int(some) >> 8 << 8) | np.arange(256)
        assert (10 ** context_tree.log_probability(after, [*deep, *top])).sum() == pytest.approx(1.0)
    assert got.bits_per_byte.tolist() == pytest.approx((-got.score * math.log2(10) / got.n_bytes).tolist())
    odd = context_tree.score_documents(docs).toPandas()
    assert len(odd) == 11 and (odd.score < 0).all() and context_tree.score_documents(docs.limit(0)).count() == 0


def test_context_tree_equals_a_sequential_one(spark):
    import math

    texts = {0: "the cat sat on the mat", 2: "the dog sat on the log and the cat", 3: "a cat", 5: "", 8: "the log of the cat ON THE mat", 21: "unseen ÿ words"}
    depth, counts = context_tree.DEPTH, {}

    def decisions(text):
        stream = b" ".join(text.encode().lower().split()) + b"\n"
        padded = b"\n" * depth + stream
        for i, byte in enumerate(stream):
            for j in range(8):
                yield padded[i : i + depth], 1 << j | byte >> (8 - j), byte >> (7 - j) & 1

    for k, text in texts.items():
        if zlib.crc32(str(k).encode()) % 5 != 1:
            for context, node, bit in decisions(text):
                for d in range(depth + 1):
                    counts.setdefault((context[depth - d :], node), [0, 0])[bit] += 1
    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[1:], node), []).append((context, node))

    def own(key):
        a, b = counts[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    mixed = {}
    for key in sorted(counts, key=lambda x: -len(x[0])):
        mixed[key] = own(key) if len(key[0]) == depth else np.logaddexp(own(key), sum(mixed[c] for c in children[key])) - math.log(2)

    def one(context, node):
        p = None
        for d in range(depth, -1, -1):
            key = (context[depth - d :], node)
            if key in counts:
                a, b = counts[key]
                estimate = (b + 0.5) / (a + b + 1)
                share = math.exp(own(key) - math.log(2) - mixed[key]) if d < depth else 1.0
                p = estimate if p is None else share * estimate + (1 - share) * p
        return 0.5 if p is None else p

    got = {r["doc_id"]: r["score"] for r in context_tree.score_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for k, text in texts.items():
        want = sum(math.log10(one(c, n) if bit else 1 - one(c, n)) for c, n, bit in decisions(text))
        assert got[k] == pytest.approx(want, rel=1e-6), k


def test_context_tree_parts_and_blocks_make_no_difference(spark, corpus, monkeypatch):
    some = corpus.where("doc_id % 3 = 0")
    one = context_tree.score_documents(some).toPandas().set_index("doc_id").score
    many = context_tree.score_documents(some, block_bytes=1 << 14).toPandas().set_index("doc_id").score
    assert (one - many).abs().max() < 1e-3
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 56, 5000))
    assert (context_tree.unpack(context_tree.pack(keys), len(keys)) == keys).all()


def test_multi_index_search(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 64))
    v[100:140] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(7, v[7].tolist()), (None, v[1].tolist()), (900, None), (901, [float("nan")] * 64)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in multi_index.search_table(e, k=5).collect())
    bits, want = v > 0, []
    for q in range(0, 300, 20):
        d = (bits ^ bits[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(300), d)) if i != q][:5]
        want += [(q, r + 1, int(i), int(d[i])) for r, i in enumerate(order)]
    assert got == want
    assert multi_index.search_table(e.limit(0)).count() == 0


def test_multi_index_search_of_longer_codes(spark):
    rng = np.random.default_rng(13)
    lengths = {0: 96, 1: 200, 2: 7}
    v = {i: rng.normal(size=lengths[i % 3]) for i in range(240)}
    e = spark.createDataFrame([(i, x.tolist(), "x") for i, x in v.items()] + [(500, [], "x")], "vec_id long, embedding array<double>, segment string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in multi_index.search_table(e, k=4).collect())
    want = []
    for q in range(0, 240, 20):
        d = sorted((int(((v[q] > 0) != (x > 0)).sum()), i) for i, x in v.items() if i != q and i % 3 == q % 3)
        want += [(q, k + 1, i, n) for k, (n, i) in enumerate(d[:4])]
    assert got == want
    codes = e.where("vec_id % 3 = 0").select("vec_id", multi_index.sign_code("embedding").alias("code"))
    cut = multi_index.search(codes, codes.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 4, 96, part_rows=8, query_rows=2)
    assert sorted(tuple(r) for r in cut.collect()) == [w for w in want if w[0] % 3 == 0]


def test_cover_tree(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(120, 16))
    v[40:70] = v[3] + 0.05 * rng.normal(size=(30, 16))
    v[70:75] = v[5]
    label = [int(i % 3 == 0) for i in range(120)]
    rows = [(i, x.tolist(), label[i]) for i, x in enumerate(v)] + [(200, [0.0] * 16, 1), (201, None, 1), (202, [float("inf")] * 16, 1), (203, v[3].tolist(), None), (204, [1.0], 1), (None, v[3].tolist(), 1)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    links = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :]) & ~np.eye(120, dtype=bool)
    root = np.arange(120)
    for _ in range(120):
        root = np.minimum(root, np.where(links, root[None, :], 999).min(1))
    for options in ({}, {"block": 16, "sample": 20, "centres": 4}):
        got = {r["vec_id"]: r for r in cover_tree.near_duplicates(e, **options).collect()}
        assert [got[i]["n_links"] for i in range(120)] == links.sum(1).tolist()
        assert [got[i]["component_id"] for i in range(120)] == root.tolist()
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (200, 201, 202, 203, 204)) and len(got) == 126
    assert cover_tree.near_duplicates(e.limit(0)).count() == 0


def test_cover_tree_of_labels_with_equal_endings(spark):
    rows = [(1, [1.0, 2.0], 10**18 + 7), (2, [1.0, 2.0], 2 * 10**18 + 7), (3, [1.0, 2.0], 10**18 + 7)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1)}


def test_cover_tree_threshold_is_exact():
    rng = np.random.default_rng(20)
    x = rng.normal(size=(2000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=(2000, 8))
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y  # cosines of 0.93, give or take the last digits
    import math

    at = np.arange(2000)
    want = [math.fsum((a * b).tolist()) >= 0.93 for a, b in zip(x, y, strict=True)]
    assert cover_tree._reaches(x, y, at, at, 0.93).tolist() == want and 100 < sum(want) < 1900


def test_warc(spark):
    long = "ä" * 60
    rows = [(5, "http://a/ä b\r\n", long), (3, None, long), (9, "u", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", long)]
    got = {r["page_id"]: r for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 3), 1: ("response", None), 2: ("response", None), 4: ("response", None), None: ("response", None)}
    assert got[9]["payload_bytes"] == 120 and got[9]["payload_digest"] == sha(long) and got[4]["payload_digest"] == sha("")
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_normaliser_reads_one_stream():
    records = [warc.warc_record(i, "u", b"x" * i, hashlib.sha256(b"x" * i).hexdigest(), None) for i in range(5)]
    blob = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = blob.compress(b"".join(records)) + blob.flush()
    assert list(warc.split_records(warc.inflate(whole[k : k + 7] for k in range(0, len(whole), 7)))) == records
    with pytest.raises(ValueError, match="ends within"):
        list(warc.split_records([records[0][:-3]]))


def toxic_corpus(spark):
    rows = [(i, ("vile scum filth " * (1 + i % 5) if i % 4 == 0 else "") + f"plain words number {i} of a clean text", "en", None, None) for i in range(200)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(100)] + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")


def test_toxicity(spark, docs):
    d, labels = toxic_corpus(spark)
    got = {r["doc_id"]: r for r in toxicity.grade_documents(d, labels).collect()}
    assert all(got[i]["toxic"] == (i % 4 == 0) for i in range(200))
    assert got[4]["severity"] > got[1]["severity"] and all(0 <= r["severity"] <= 3 for r in got.values())
    odd = toxicity.grade_documents(docs, labels.limit(0)).collect()
    assert len(odd) == 11 and not any(r["toxic"] for r in odd)
    assert toxicity.without_toxic(d, labels).columns == d.columns and toxicity.grade_documents(d.limit(0), labels).count() == 0


def test_toxicity_on_labels_that_were_not_learned_from(spark, sf_dir):
    from tidewell.llm.common import fold

    docs, labels = (spark.read.parquet(f"{Path(sf_dir).parent}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    graded = toxicity.grade_documents(docs, labels.where(fold("doc_id") != 2)).withColumnRenamed("toxic", "found")
    got = graded.join(labels.where(fold("doc_id") == 2), "doc_id").toPandas()
    assert got.found[got.toxic == 1].mean() >= 0.85 and got.found[got.toxic == 0].mean() <= 0.02


def test_ordinal_regression_is_the_least_loss():
    rng = np.random.default_rng(5)
    n, width = 200, 3
    x = rng.normal(size=(n, width))
    grades = np.digitize(x @ [1.0, -2.0, 0.5] + rng.logistic(size=n), [-1, 0.5, 2])
    rows, columns = np.repeat(np.arange(n), width), np.tile(np.arange(width), n)
    w, theta = toxicity.fit_ordinal(rows, columns, x.ravel(), grades, width, steps=3000)

    def loss(w, theta):
        above = 1 / (1 + np.exp(theta[None, :] - (x @ w)[:, None]))
        padded = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), axis=1)
        i = np.arange(n)
        return -np.log(padded[i, grades] - padded[i, grades + 1]).mean() + 1e-3 / 2 * (w @ w)

    best = loss(w, theta)
    for step in (0.05, 0.01):
        for k in range(width):
            for sign in (-1, 1):
                assert loss(w + sign * step * np.eye(width)[k], theta) >= best - 1e-4
        for k in range(3):
            for sign in (-1, 1):
                assert loss(w, theta + sign * step * np.eye(3)[k]) >= best - 1e-4


def test_toxicity_on_few_labels(spark):
    d, labels = toxic_corpus(spark)
    few = labels.where("doc_id < 16 and doc_id % 4 in (0, 1)")  # 8 labels, half of them toxic
    got = {r["doc_id"]: r["toxic"] for r in toxicity.grade_documents(d, few).collect()}
    assert all(got[i] for i in range(0, 200, 4)) and sum(got.values()) < 100
    assert not any(r["toxic"] for r in toxicity.grade_documents(d, few.where("doc_id < 2")).collect())  # too few for any term


def test_vocabulary_is_a_parameter(spark):
    d, labels = toxic_corpus(spark)
    assert len(toxicity.fit(d, labels, vocabulary=2).columns) == 2 < len(toxicity.fit(d, labels).columns)


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    grades = np.digitize(2 * x + 0.3 * rng.normal(size=400), [-1, 0.5, 2])
    w, theta = toxicity.fit_ordinal(np.arange(400), np.zeros(400, np.int64), x, grades, 1)
    assert w[0] > 0 and (np.diff(theta) > 0).all()


def test_language(spark, docs, corpus):
    got = langid.identify(corpus).toPandas().merge(corpus.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() >= 0.95 and got.score.between(0, 1).all()
    odd = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert odd[1]["lang_pred"] == odd[0]["lang_pred"] == "und" and odd[1]["score"] == 0
    assert langid.identify(docs.limit(0)).count() == 0


def test_every_language_is_learned(spark):
    # 300 languages of an alphabet of two letters each: more than any fixed number of the frequent ones.
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        a, b = chr(0x4E00 + 2 * k), chr(0x4E01 + 2 * k)
        rows += [(10 * k + i, "".join(rng.choice([a, b, " "], 60)), f"l{k:03}") for i in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d, sample=2400, bits=14)
    assert len(model.languages) == 300
    assert sum(model.predict(t)[0] == lang for _, t, lang in rows) >= 0.9 * len(rows)


def test_ftrl_against_plain_gradient_descent():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 4))
    y = (x @ rng.normal(size=(4, 3))).argmax(1)
    w, b = langid.ftrl([(np.arange(4, dtype=np.int32), row) for row in x], y.tolist(), 3, 4, epochs=30, l1=0.0, l2=0.0)
    other = np.zeros((4, 3))
    for _ in range(3000):
        p = np.exp(x @ other)
        p /= p.sum(1, keepdims=True)
        p[np.arange(300), y] -= 1
        other -= 0.5 * x.T @ p / 300
    assert ((x @ w + b).argmax(1) == (x @ other).argmax(1)).mean() >= 0.97
    sparse, _ = langid.ftrl([(np.arange(4, dtype=np.int32), row) for row in x], y.tolist(), 3, 4, l1=1e6)
    assert not sparse.any()


def test_language_stage_rejects_what_no_language_fits(spark, sf_dir, corpus):
    import corpus_pipeline

    greek = "Καλημέρα σε όλους τους ανθρώπους που διαβάζουν αυτό το μεγάλο κείμενο σήμερα το πρωί"
    odd = {9001: "12 34 !?", 9002: "", 9003: None, 9004: "Καλημέρα σε όλους", 9005: "plain words 7", 9006: "👋🏽 ...", 9007: greek}
    extra = spark.createDataFrame([(k, t, None, None, None) for k, t in odd.items()], DOCS)
    learned = corpus.select(extra.columns).unionByName(extra)
    model = langid.fit(learned.where(~langid.held_out()))

    def stays(text):
        lang, score, familiar = model.predict(text)
        return lang != "und" and (score >= 0.35 and familiar >= 0.5 or sum(c.isalpha() for c in text) < 40)

    want = sorted(r["doc_id"] for r in learned.collect() if stays(r["text"]))
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_unknown_language(spark, learned, sf_dir).collect())
    assert got == want and 9007 not in got and {9004, 9005} <= set(got) and not {9001, 9002, 9003, 9006} & set(got)
    assert len(got) >= 0.99 * corpus.count()
    nothing = learned.where("doc_id > 9000")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_unknown_language(spark, nothing, sf_dir).collect()) == [9004, 9005, 9007]


def brute_jaccard(texts, threshold=0.8):
    sets = {}
    for k, t in texts.items():
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = {k: [j for j in sets if j != k and sets[k] and sets[j] and len(sets[k] & sets[j]) >= threshold * len(sets[k] | sets[j])] for k in sets}
    root = {k: k for k in sets}
    for _ in sets:
        new = {k: min([root[k], *(root[j] for j in links[k])]) for k in sets}
        if new == root:
            break
        root = new
    return links, root


def test_jaccard_join(spark, docs, corpus):
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    base = " ".join(f"w{i}" for i in range(100))
    texts |= {1000: base, 1001: base + " tail", 1002: base.replace("w50", "other"), 1003: base.upper(), 1004: None, 1005: "a b", 1006: "A  b"}
    links, root = brute_jaccard(texts)
    df = spark.createDataFrame([(k, t, "en", None, None) for k, t in texts.items()], DOCS)
    for options in ({}, {"block": 2}):
        got = {r["doc_id"]: r for r in lsh_forest.jaccard_classes(df, **options).collect()}
        assert {k: r["class_id"] for k, r in got.items()} == root
        assert {k: r["n_links"] for k, r in got.items()} == {k: len(v) for k, v in links.items()}
    kept = lsh_forest.without_copies(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(root.values())
    assert lsh_forest.jaccard_classes(docs).count() == 11 and lsh_forest.jaccard_classes(docs.limit(0)).count() == 0


def test_prefixes_are_shortened_from_the_data(spark):
    rng = np.random.default_rng(8)
    texts = {}
    for k in range(0, 240, 2):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        texts[k], texts[k + 1] = " ".join(words), " ".join(["other", *words[1:60], "new", *words[61:]])
    links, _ = brute_jaccard(texts)
    total = sum(map(len, links.values()))
    assert total == 240
    df = spark.createDataFrame([(k, t, "en", None, None) for k, t in texts.items()], DOCS)
    found = {}
    for recall in (0.1, 0.6, 0.95):
        *_, checked, steps = lsh_forest.link_classes(df, trees=3, depth=8, recall=recall)
        assert [d for d, _ in steps] == sorted({d for d, _ in steps}, reverse=True) and steps[0][0] == 8
        assert steps[-1][1] >= recall  # as measured on the links
        found[recall] = checked.agg(F.sum("n")).first()[0] or 0
        assert found[recall] >= (recall - 0.12) * total  # as it is
    assert found[0.1] < found[0.95]  # prefixes did get shorter, and more was found


def test_sorted_tries_hold_every_common_prefix(spark):
    rng = np.random.default_rng(14)
    labels = rng.integers(0, 3, (90, 2, 4)).astype(">u4")  # 2 trees of 4 values
    classes = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(labels)], "node long, labels binary").repartition(3)
    edges = [(r["a"], r["b"], r["prefix"]) for r in lsh_forest.forest(classes, 2, 4).collect()]
    for depth in range(1, 5):
        got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame([e for e in edges if e[2] >= depth] or [(0, 0, 9)], "a long, b long, prefix int")).collect()}
        root = np.arange(90)
        same = (labels[:, None, :, :depth] == labels[None, :, :, :depth]).all(-1).any(-1)
        for _ in range(90):
            root = np.where(same, root[None, :], 999).min(1)
        assert [got.get(i, i) for i in range(90)] == root.tolist()


def test_groups_larger_than_a_block(spark):
    rng = np.random.default_rng(15)
    base = [f"w{x}" for x in range(200)]
    texts = {}
    for k in range(60):  # near copies of each other
        words = list(base)
        words[rng.integers(0, 200)] = f"x{k}"
        texts[k] = " ".join(words)
    chain = [f"c{x}" for x in range(900)]
    for k in range(60):  # each like its neighbours only
        texts[100 + k] = " ".join(chain[8 * k : 8 * k + 120])
    links, root = brute_jaccard(texts)
    df = spark.createDataFrame([(k, t, "en", None, None) for k, t in texts.items()], DOCS)
    for block in (7, 64):
        got = {r["doc_id"]: r for r in lsh_forest.jaccard_classes(df, block=block).collect()}
        assert {k: r["n_links"] for k, r in got.items()} == {k: len(v) for k, v in links.items()}
        assert {k: r["class_id"] for k, r in got.items()} == root


def test_one_id_on_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (3, a), (1, b), (3, b), (5, b), (7, "alone in the world"), (7, "alone in the world")]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], DOCS)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in lsh_forest.jaccard_classes(df).collect())
    assert got == [(1, 1, 1), (1, 1, 2), (3, 1, 1), (3, 1, 2), (5, 1, 2), (7, 7, 1), (7, 7, 1)]
    assert sorted((r["doc_id"], r["text"]) for r in lsh_forest.without_copies(df).collect()) == sorted([(1, a), (1, b), (7, "alone in the world")])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 101: 100, 102: 100}


CLASHING = "rep long, own long, task long, node long, block int, part int, n long, token string, keys string, labels string, grp long, unit string, row long, fill long, lang_pred string, score double, is_toxic int, class_id long, code string, segment int"


def clashing(spark, rows, schema):
    names = [c.split()[0] for c in CLASHING.split(", ")]
    wide = spark.createDataFrame(rows, schema)
    return wide.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHING.split(", ") if c.split()[0] not in wide.columns and names))


def test_clashing_columns(spark):
    texts = [(1, "some words here of a text", "en", "s", 1), (None, None, None, None, None), (1, "some words here of a text", "en", "s", 1)]
    extra = clashing(spark, texts, DOCS)
    labels = clashing(spark, [(1, 1, 0)], "doc_id long, toxic int, quality int").withColumn("text", F.lit("x"))
    pages = clashing(spark, [(1, "u", "<p>some words</p>"), (None, None, None), (1, "u", "<p>some words</p>")], "page_id long, url string, html string").withColumn("payload", F.lit("x")).withColumn("digest", F.lit("y"))
    vectors = clashing(spark, [(20, [0.5, 1.0], 1), (21, [0.5, 1.0], 1), (20, [0.5, 1.0], 1), (None, None, None)], "vec_id long, embedding array<double>, label int").withColumn("query_id", F.lit(1)).withColumn("dims", F.lit(2))
    assert sentencepiece_bpe.token_digests(extra, tokenizer_path("piece_bpe_32k.model")).count() == 3
    assert html_content.extract_pages(pages).count() == 3
    assert context_tree.score_documents(extra).count() == 3
    assert multi_index.search_table(vectors).count() == 1
    assert cover_tree.near_duplicates(vectors).count() == 4
    assert warc.archive_pages(pages).count() == 3
    assert toxicity.grade_documents(extra, labels).count() == 3
    assert packing.pack_documents(extra, tokenizer_path("word_bpe_49k.json")).count() == 3
    assert langid.identify(extra).count() == 3
    assert lsh_forest.jaccard_classes(extra).count() == 3
    assert lsh_forest.without_copies(extra).columns == extra.columns
    assert toxicity.without_toxic(extra, labels).columns == langid.without_unknown(extra).columns == extra.columns


def test_texts_of_a_million_characters(spark):
    """Whole, in every operator on texts; two that differ in one word are near copies."""
    rng = np.random.default_rng(21)
    words = [f"{a}{b}" for a in ("bel", "cor", "dan", "fer", "gil") for b in ("amo", "ente", "isk", "oru", "ula")]
    long = " ".join(rng.choice(words, 150_000))
    other = long.replace(" ", " changed ", 1)
    docs = spark.createDataFrame([(1, long, "xx", None, None), (3, other, "xx", None, None), (4, "short text", "xx", None, None)], DOCS)
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int")
    assert len(long) > 1_000_000
    scored = {r["doc_id"]: r for r in context_tree.score_documents(docs).collect()}
    assert scored[1]["n_tokens"] == 150_001 and scored[3]["n_tokens"] == 150_002
    assert {r["doc_id"]: r["class_id"] for r in lsh_forest.jaccard_classes(docs).collect()} == {1: 1, 3: 1, 4: 4}
    assert {r["lang_pred"] for r in langid.identify(docs).collect()} == {"xx"}
    assert not any(r["toxic"] for r in toxicity.grade_documents(docs, labels).collect())
    pieces = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json")).toPandas()
    assert all(sorted(p.start) == list(range(0, int(p.length.sum()), 4096)) for _, p in pieces.groupby("doc_id")) and pieces[pieces.doc_id == 1].length.sum() > 150_000
    page = spark.createDataFrame([(1, "u", f"<body><nav><a href=x>Menu</a></nav><article><p>{long}</p><p>{other}</p></article></body>")], "page_id long, url string, html string")
    assert html_content.extract_pages(page).first()["text"] == f"{long}\n{other}"
    assert warc.archive_pages(page).first()["payload_bytes"] == len(page.first()["html"])


def test_html_of_no_pages(spark):
    assert html_content.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, sf_dir):
    """Each stage against a brute-force version, on what its predecessor kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())

    clean = stages["toxicity"](spark, docs, sf_dir)
    model = toxicity.fit(docs, labels)
    assert ids(clean) == sorted(r["doc_id"] for r in docs.collect() if (model.exceed(r["text"]) >= 0.5).sum() < 1)
    known = stages["language"](spark, clean, sf_dir)
    assert known.columns == clean.columns == docs.columns and 0 < known.count() <= clean.count() < docs.count()
    single = stages["near_duplicates"](spark, known, sf_dir)
    _, root = brute_jaccard({r["doc_id"]: r["text"] for r in known.collect()})
    assert single.columns == docs.columns and ids(single) == sorted(set(root.values()))
    packed = stages["packing"](spark, single, sf_dir).toPandas()
    assert sorted(packed.doc_id.unique()) == ids(single) and (packed.groupby("sequence_id").length.sum() <= 4096).all()


def test_pipeline_of_empty_tables(spark, sf_dir, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_packing_worker_keeps_a_bounded_number_of_words():
    """Executors hold two workers beside the heap; a million words kept by each took more than their memory in the pipeline."""
    from tidewell.llm import packing
    from tidewell.llm.registry import tokenizer_path

    with open(tokenizer_path("word_bpe_49k.json"), "rb") as f:
        own = packing.WordIds(f.read())
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join("q" + a + b + c + d for a in letters for b in letters for c in letters for d in letters)
    ids = own.ids(text)
    assert len(own.cache) + len(own.cache.old) <= 400_000
    assert ids == np.array(own.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() == own.ids(text)


def test_packing_ids_of_many_texts_at_once():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        own = packing.WordIds(f.read())
    marks = ["a", "B", "ß", "Σ", "don't", "'re", "'", "_", "\x1c", "\x1f", " ", "\n", "\x0b", "\x85", "\xa0", "\u2003", "\u3000", ".", ",", "..", "!?", "1", "²", "Ⅷ", "漢", "é", "e\u0301", "İ", "<|endoftext|>", "\U0001fadf"]
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(marks, rng.integers(0, 12))) for _ in range(3000)] + [None, "", " ", "\xa0", "a.", "a.\xa0", "x,y"]
    for text, ids in zip(texts, own.many(texts), strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert own.many([]) == []


def test_local_search_tries_two_bins_once_as_they_are(monkeypatch):
    vain, whole = [], packing._best_exchange

    def exchange(give, ordered, *rest):
        step = whole(give, ordered, *rest)
        if step is None:
            vain.append((tuple(give), tuple(ordered)))
        return step

    monkeypatch.setattr(packing, "_best_exchange", exchange)
    rng = np.random.default_rng(3)
    for _ in range(5):
        lengths = rng.integers(50, 900, 300).tolist()
        vain.clear()
        packing.improve(packing.best_fit(lengths, 1000), lengths, 1000)
        assert 100 < len(vain) < 1.1 * len(set(vain))  # a bin may come back to what it was
