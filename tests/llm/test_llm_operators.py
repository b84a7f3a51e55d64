"""The operators against brute force, exact round trips and held-out accuracy, and their defined results for odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from scorecube.llm import (bpe, catalog, eliasfano, op1_lm_score, op2_quality, op3_sharding, op4_decontamination,
                           op5_html_text, op6_byte_bpe, op7_near_dedup, op8_language_id, op9_embedding_near_dedup,
                           op10_substrings)
from scorecube.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk string, n string, row int, label string"
LONG = " ".join(f"w{i % 977}x{i % 89}" for i in range(60_000))
ODD = [None, "", "   \t\n", "a", "a b c", "???", "12 34", LONG, "same text here " * 30, "same text here " * 30,
       " ".join(f"k{i}" for i in range(80)), " ".join(f"k{i}" for i in range(80)) + " tail", "Ünï cödé ÄÖ " * 12]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], "s", None, "x", "y", 1, "z") for i, t in enumerate(ODD)]
    rows += [(5, "???", "en", "s", 1, "x", "y", 1, "z"), (None, "null id text", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def _tokens(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_elias_fano_finds_what_a_sorted_array_has():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 1), (1, 5), (10, 10), (1000, 1 << 20), (5000, 6000), (30000, 1 << 48)):
        values = np.unique(rng.integers(0, universe, n).astype(np.uint64))
        store = eliasfano.Store()
        head = eliasfano.Sequence.put(store, values, universe)
        seq = eliasfano.Sequence(head, store.map())
        assert (seq.access(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, rng.integers(0, universe, 200).astype(np.uint64)])
        place, found = seq.find(asked)
        assert (found == np.isin(asked, values)).all()
        assert (place[found] == np.searchsorted(values, asked[found])).all()


def test_lm_scores_equal_the_formula(spark, odd):
    docs = odd.withColumn("held_out", op1_lm_score.remainder("doc_id") == 1)
    got = _rows(op1_lm_score.scored(docs))
    texts = [(r["doc_id"], _tokens(_lower(r["text"])) + ["\0"], r["held_out"]) for r in docs.collect()]
    words, pairs, starts = Counter(), Counter(), 0
    for _, t, held in texts:
        if not held:
            words.update(t)
            pairs.update(zip(["^", *t], t, strict=False))
            starts += 1
    n, v, mu = sum(words.values()), len(words), op1_lm_score.MU
    want = []
    for i, t, held in texts:
        alone = [(words[w] + 0.5) / (n + 0.5 * (v + 1)) for w in t]
        both = [(pairs[h, w] + mu * p) / ((starts if h == "^" else words[h]) + mu)
                for h, w, p in zip(["^", *t], t, alone, strict=False)]
        want.append((str(i), held, len(t), sum(words[w] > 0 for w in t), n, sum(map(math.log10, alone)), sum(map(math.log10, both))))
    have = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got]
    for a, b in zip(sorted(have), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and abs(a[6] - b[6]) <= 2e-4 * a[2]


def test_lm_empty(spark, empty):
    assert op1_lm_score.scored(empty.withColumn("held_out", F.lit(False))).count() == 0


def test_quality_orders_held_out_labels(spark):
    got = {r["doc_id"]: r for r in _rows(catalog.QUERIES["op2_rff_quality"](spark, "/root/testdata/sf0.01"))}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [got[r["doc_id"]]["score"] for r in labels if got[r["doc_id"]]["held_out"] and r["quality"] == 1]
    bad = [got[r["doc_id"]]["score"] for r in labels if got[r["doc_id"]]["held_out"] and r["quality"] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    assert len(got) == 1000


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 7), (99, 1), (None, 1), (7, 1), (7, 0)], "doc_id bigint, quality int")
    got = _rows(op2_quality.scored(odd, labels))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    none = _rows(op2_quality.scored(odd, labels.where("false")))
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)}
    assert op2_quality.scored(empty, labels).count() == 0


def test_sharding_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in op3_sharding.sharded(docs).collect()}
    text = F.coalesce("text", F.lit(""))
    keys = docs.select("doc_id", F.xxhash64("doc_id").alias("p"), F.pmod(F.xxhash64(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long"), F.crc32(text.cast("binary"))), F.lit(16)).alias("sub")).collect()
    nodes = op3_sharding.ring(24, 64)
    arc = {r["doc_id"]: next((i for i, n in enumerate(nodes) if n[0] >= r["p"]), 0) for r in keys}
    room = [len(keys) // 24 + (s < len(keys) % 24) for s in range(24)]
    used, want = [0] * 24, {}
    for r in sorted(keys, key=lambda r: (arc[r["doc_id"]], r["sub"], r["p"])):
        shard = next(nodes[(arc[r["doc_id"]] + k) % len(nodes)][1] for k in range(len(nodes))
                     if used[nodes[(arc[r["doc_id"]] + k) % len(nodes)][1]] < room[nodes[(arc[r["doc_id"]] + k) % len(nodes)][1]])
        want[r["doc_id"]] = (shard, used[shard])
        used[shard] += 1
    # a shard's slots run through an arc's ranks; both orders place a key in the same shard
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_sharding_odd_rows(spark, odd, empty):
    rows = _rows(op3_sharding.sharded(odd.union(odd)))
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 0} == {(8, 0)}
    assert {r["text_crc32"] for r in rows if r["doc_id"] == 3} == {zlib.crc32(b"a")}
    assert op3_sharding.sharded(empty).count() == 0


def test_decontamination_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, " ".join(f"K{i}" for i in range(40, 55))), (2, "b C"), (2, "b C"), (3, None), (4, "?"),
                                   (None, "same text")], "item_id bigint, text string")
    got = _rows(op4_decontamination.contamination(odd, bench))
    assert len(got) == odd.count()
    hit = {r["doc_id"]: (r["n_hit"], r["items"]) for r in got if r["contaminated"]}
    assert hit == {4: (2, ["2"]), 8: (60, []), 9: (60, []), 10: (15, ["1"]), 11: (15, ["1"])}
    assert not any(r["contaminated"] for r in _rows(op4_decontamination.contamination(odd, bench.where("false"))))
    assert op4_decontamination.contamination(empty, bench).count() == 0


def test_main_text_of_pages(spark):
    nav = "<nav><ul><li><a href='/'>Home</a></ul></nav>"
    page = ("<!DOCTYPE html><head><title>T</title><script>var a='</p><article>';</script></head><body>{nav}<div class='ad'>Buy</div>"
            "<article><h1>One &amp; two</h1><p><b>Bold<br>line<p>Next&nbsp;para &lt;x&gt;<div class='share-bar'>Share</div>"
            "<section id=comments><p>Nice!</p></section><p>Shared</p></article><div>All rights {n}</div><footer>f</footer>")
    rows = [(i, f"http://h.example/{i}", page.format(nav=nav, n="reserved")) for i in range(4)]
    plain = "<body><div><i>Site line</i></div><p>Text {}</p></body>"
    rows += [(10 + i, f"http://p.example/{i}", plain.format(i)) for i in range(4)]
    rows += [(20, None, "<p>no host"), (21, "http://h.example/x", None), (22, "x", ""), (None, "http://q.example", "<p>a</p>b<!-- c"),
             (23, "http://d.example", "<div>" * 30_000 + "deep")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in _rows(op5_html_text.main_texts(df))}
    want = "One & two\nBold line\nNext para <x>\nShared"
    assert all(got[i] == (want, len(want)) for i in range(4))
    assert [got[10 + i][0] for i in range(4)] == [f"Text {i}" for i in range(4)]
    assert got[20] == ("no host", 7) and got[21] == ("", 0) == got[22] and got[None][0] == "a\nb" and got[23] == ("deep", 4)
    assert op5_html_text.main_texts(df.where("false")).count() == 0


def test_templates_are_judged_by_distinct_pages(spark):
    story = "<article><div><p>The story</p></div><section><p>Its end</p></section></article>"
    rows = [(i, f"http://a.example/{i}", f"{story}<i>{i}</i>") for i in range(6)]  # one article under many URLs
    rows += [(10 + i, "http://a.example/other", f"<article><p>Other {i}</p></article>") for i in range(4)]
    rows += [(100 + i, f"http://b.example/{i}", f"<article><p>Page {i}</p><p>Like <b>all</b></p>"
              + "<section><p>Maintenance on Sunday</p></section>" * (i % 10 == 0) + "</article>") for i in range(60)]
    rows += [(200 + i, f"http://c.example/{i}", f"<p>Page {i}{' <b>bold</b>' * (i % 10 == 0)}</p>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in _rows(op5_html_text.main_texts(df))}
    assert all(got[i] == "The story\nIts end" for i in range(6))
    assert all(got[100 + i] == f"Page {i}\nLike all" for i in range(60))
    assert got[200] == "Page 0 bold" and got[201] == "Page 1"


def test_names_made_of_titles_keep_their_text():
    parts = ('<section id="discussion"><p>A</p></section>', '<h2 id="side-effects">B</h2>', '<h2 id="related-work">C</h2>',
             '<div id="share-prices">D</div>', '<h3 id="social-policy">E</h3>', '<p id="notice-period">F</p>', '<h2 id="comments">G</h2>',
             '<p id="menu">H</p>')
    for page in ("<article>{}</article>", "<main>{}</main>", "<body>{}</body>"):
        assert op5_html_text.main_text(page.format("".join(parts)), frozenset()) == "A\nB\nC\nD\nE\nF\nG\nH"
        for gone in ('<div id="comments">x</div>', '<div id="disqus_thread">x</div>', '<div id="sidebar">x</div>', '<ul id="share-bar">x</ul>',
                     '<section class="comment-list">x</section>', '<div id="ad-1">x</div>', '<div class="lead share">x</div>'):
            assert op5_html_text.main_text(page.format("<p>y</p>" + gone), frozenset()) == "y"
    assert op5_html_text.main_text('<article><p>y <b class="notice">z</b></p><h2 class="related">w</h2></article>', frozenset()) == "y z\nw"


def test_pages_of_any_depth_keep_their_text():
    assert op5_html_text.main_text("<div>" * 30_000 + "deep", frozenset()) == "deep"
    unclosed = "".join(f"<font>line {i}<br>" for i in range(30_000))
    assert op5_html_text.main_text(unclosed, frozenset()) == " ".join(f"line {i}" for i in range(30_000))
    hashes = op5_html_text.template_hashes("<div>" * 30_000 + "deep")
    assert len(hashes) == 30_000 and op5_html_text.main_text("<p>a</p>" + "<div>" * 30_000 + "deep", frozenset(hashes)) == "a"


def test_bpe_equals_tiktoken_and_round_trips(spark, odd, empty):
    import base64

    import tiktoken
    path, pattern = op6_byte_bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.encoder(path, pattern)
    rng = np.random.default_rng(3)
    alphabet = list("aeiountrhsl áéçß漢字😀 \t\n '12!?𐍈<|>") + ["<|endoftext|>", " lll"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000)] + [t for t in ODD if t]
    for t in texts:
        ids = np.frombuffer(enc.encode(t), "<u4")
        assert ids.tolist() == ref.encode_ordinary(t)
        assert "".join(enc.decode(ids, step=1)) == t
    got = {(r["doc_id"], r["n_tokens"]): r for r in _rows(op6_byte_bpe.encoded(odd, path, pattern, keep_ids=True))}
    for r in odd.collect():
        ids = ref.encode_ordinary(r["text"] or "")
        row = got[r["doc_id"], len(ids)]
        assert row["ids"] == ids and row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert op6_byte_bpe.encoded(empty, path, pattern).count() == 0


def test_utf8_machine_holds_back_unfinished_characters():
    m = bpe.Utf8Machine()
    out = [m.feed(bytes([b])) for b in "aé漢😀".encode()] + [m.feed(b"\xf0\x9f"), m.end(), m.feed(b"\xff"), m.feed(b"\xe0\x80"), m.end()]
    assert "".join(out[:10]) == "aé漢😀" and out[10:12] == ["", "�"] and "".join(out[12:]).startswith("�")


def test_near_dedup_odd_rows(spark, odd, empty):
    got = _rows(op7_near_dedup.near_duplicates(odd))
    assert len(got) == odd.count()
    by = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in got}
    assert by[0, 0] == (0, True) and by[3, 1] == (3, True) and by[4, 1] == (4, True)
    assert by[9, 3] == (8, False) and by[11, 77] == (10, False) and by[10, 76] == (10, True)
    assert op7_near_dedup.near_duplicates(empty).count() == 0
    kept = op7_near_dedup.stage(spark, odd, "")
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        ["0", "1", "2", "3", "4", "5", "6", "7", "8", "10", "12", "None"])


def test_near_copies_beyond_a_block_are_joined_up(spark, monkeypatch):
    base = [f"b{i}" for i in range(400)]
    docs = [(i, " ".join(base[:i % 380] + [f"u{i}"] + base[i % 380 + 1:])) for i in range(60)]
    docs += [(100 + i, " ".join(f"v{i}.{k}" for k in range(50))) for i in range(20)]
    monkeypatch.setattr(op7_near_dedup, "SKETCH_BLOCK", 8)
    monkeypatch.setattr(op7_near_dedup, "BLOCK", 8)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("k", op7_near_dedup.row_key())
    got = {r["doc_id"]: r["component_id"] for r in _rows(op7_near_dedup.near_duplicates(df))}
    assert all(got[i] == 0 for i in range(60)) and all(got[100 + i] == 100 + i for i in range(20))


def test_what_leaders_leave_apart_meets_the_whole_group(spark):
    rows = [(g, f"{g}{i}".encode(), b"main" if i < 30 else f"{g}r{i}".encode()) for g in "ab" for i in range(41)]
    rows += [("c", f"c{i}".encode(), b"one") for i in range(50)]  # joined up already: nothing to compare
    df = spark.createDataFrame(rows, "g string, node binary, label binary")
    got = op7_near_dedup.rest_blocks(df, df, "g", [], 8).collect()
    label = {bytes(node): bytes(of) for _, node, of in rows}
    met = Counter()
    for r in got:
        for i, x in enumerate(r["members"]):
            for y in r["members"][:i]:
                if len({m["own"] for m in r["members"]}) == 1 or x["own"] != y["own"]:
                    met[frozenset((bytes(x["node"]), bytes(y["node"])))] += 1
    want = {frozenset((x, y)) for x in label for y in label if x < y and x[:1] == y[:1] and label[x] != label[y]}
    assert want <= set(met) and max(met.values()) == 1
    assert not any(label[x] == label[y] == b"main" for x, y in map(tuple, met))


def test_near_dedup_stage_links_from_80_per_cent(spark):
    assert op7_near_dedup.search(85) == (85, 30, 6, 88) and op7_near_dedup.search(80)[:3] == (80, 36, 5)
    docs = []
    for i in range(40):  # 104 and 100 shingles: 9 to 11 words at the end are others, a Jaccard of 0.85 to 0.80
        base, other = [f"p{i}.{k}" for k in range(104)], 9 + i % 3
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:-other] + [f"q{i}.{k}" for k in range(other)]))]
    docs += [(1000 + i, " ".join([f"r{k}" for k in range(88)] + [f"s{i}.{k}" for k in range(16)])) for i in range(2)]  # 0.72
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(100)} for i, t in docs}
    alike = [len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(40)]
    assert all(0.8 <= a < 0.85 for a in alike)
    assert sorted(r["doc_id"] for r in op7_near_dedup.stage(spark, df, "").collect()) == [*range(0, 80, 2), 1000, 1001]
    assert all(r["kept"] for r in _rows(op7_near_dedup.near_duplicates(df)))


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    parent = list(range(2000))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        if a is not None:
            parent[root(a)] = root(b)
    got = {r["node"]: r["component"] for r in _rows(components(spark.createDataFrame(links, "a bigint, b bigint")))}
    assert set(got) == {x for a, b in links if a is not None and a != b for x in (a, b)}
    for x in got:
        assert root(x) == root(got[x]) and got[x] == got[root(x)] if root(x) in got else True
    assert len(set(got.values())) == len({root(x) for x in got})
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_language_id(spark, odd, empty):
    got = _rows(catalog.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01"))
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.97 * len(held) > 0
    filters = op8_language_id.learned(odd.select("lang", "text"))
    rows = {r["doc_id"]: r for r in _rows(op8_language_id.identified(odd.drop("n"), filters))}
    assert {i for i, r in rows.items() if r["lang_pred"] == "und"} == {0, 1, 2, 5, 6}
    assert all(r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1 for r in rows.values())
    nothing = op8_language_id.learned(empty.select("lang", "text"))
    assert {r["lang_pred"] for r in _rows(op8_language_id.identified(odd, nothing))} == {"und"}
    assert op8_language_id.identified(empty, filters).count() == 0
    stage = op8_language_id.stage(spark, odd, "")
    assert stage.columns == odd.columns and stage.count() == odd.count() - 6


def test_lattice_decoding_is_nearest_and_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 2, (300, 8))
    own = op9_embedding_near_dedup.nearest_e8(x)
    around = own[:, None] + np.concatenate([op9_embedding_near_dedup.ROOTS, np.zeros((1, 8))])
    assert (((x[:, None] - around) ** 2).sum(-1).min(1) >= ((x - own) ** 2).sum(-1) - 1e-9).all()
    assert len({tuple(r) for r in op9_embedding_near_dedup.ROOTS}) == 240
    base = rng.normal(size=(60, 64))
    near = base[rng.integers(0, 60, 600)] + rng.normal(size=(600, 64)) * 0.14
    rows = [(i, [float(np.float32(v)) for v in e], 1) for i, e in enumerate(near)]
    df = spark.createDataFrame(rows, "row bigint, embedding array<float>, label int")
    found = {(r["a"], r["b"]) for r in op9_embedding_near_dedup.near_pairs(df).collect()}
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.98, 1)), strict=True)}
    assert len(true) > 100 and found <= true and len(found) >= 0.99 * len(true)


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
            (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (2, [3.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("cells", F.lit(1))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in _rows(op9_embedding_near_dedup.near_duplicates(df)))
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)] + [(i, 0, i, True) for i in range(3, 12)]
    assert op9_embedding_near_dedup.near_duplicates(df.where("false")).count() == 0


def test_substrings_equal_brute_force(spark, odd, empty):
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in _rows(op10_substrings.removals(odd)))
    texts = [(r["doc_id"], _tokens(r["text"])) for r in odd.collect()]
    seen = Counter(tuple(t[i:i + 35]) for _, t in texts for i in range(len(t) - 34))
    want = []
    for i, t in texts:
        gone = set()
        for p in range(len(t) - 34):
            if seen[tuple(t[p:p + 35])] > 1:
                gone.update(range(p, p + 35))
        kept = " ".join(w for p, w in enumerate(t) if p not in gone)
        want.append((str(i), len(t), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want)
    assert op10_substrings.removals(empty).count() == 0
    stage = op10_substrings.stage(spark, odd, "")
    assert stage.columns == odd.columns and stage.count() == odd.count()
    text = {r["doc_id"]: r["text"] for r in stage.collect()}
    assert text[11] == "tail" and text[10] == "" and text[0] is None and text[2] == ODD[2]


def test_pipeline_stages_compose(spark, tmp_dir):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_dir}/{number}")
        docs = spark.read.parquet(f"{tmp_dir}/{number}")
        assert number == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    rows = docs.collect()
    assert 0 < len(rows) < 200 and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF_SMALL).collect()) == sorted(r["doc_id"] for r in rows)
