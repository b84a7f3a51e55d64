"""Token files, alignment and spelling variants against brute force over whole tables, and their defined results for odd rows."""

import glob
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from scorecube.llm import memo, op11_token_files, op12_alignment, op13_spelling

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, start bigint, word string, bag int, list int"
ODD = [None, "", " ", "   \t\n", "a", "a  b c ", "12 34½", "<|endoftext|> x <|startoftext|>", "it's IT'S 'LL", "▁ x", "ﬁ Å",
       "école École", "中文字 \U0001f600", "same text here " * 30, "same text here " * 30, "spelling " * 5 + "speling spelings",
       "x" * 30_000, "Café " * 2000, "\x00\x1c\x85 zero", " lead and trail  ", "\n\n  two\n lines\r\n"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None, 7, "w", 1, 2) for i, t in enumerate(ODD)]
    rows += [(4, "a", "en", "s", 1, 7, "w", 1, 2), (4, "again", None, None, None, None, None, None, None),
             (None, "null id text", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None),
             (-3, "before", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def _pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def _key(x):
    return tuple((v is not None, v) for v in x)


# ---- op11 -----------------------------------------------------------------------------------------------------------
def _library(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def test_cached_tokenizers_equal_the_libraries():
    w, a, b = memo.WordBpe(op11_token_files.default_vocabulary()), *(
        c(p) for c, p in zip((memo.ByteBpe, memo.PieceBpe), op12_alignment.default_vocabularies()))
    assert w.cuts and a.cuts and b.cuts
    w.words.most = w.parts.most = a.chunks.most = b.chunks.most = 50  # generations change often
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "É", "'s", "'S", "'re", "'", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "23", "½", "!", ",",
             "\x1c", "\x85", "\xa0", " ", "　", "é", "́", "中", "İ", "ß", "​", "\U0001f600", "\0", "don't", "HELLO", "ª", "'LL", "ﬁ",
             "K", " ", "᠎", " ", "﻿"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    for t in texts + [t for t in ODD if t]:
        assert w.encode(t.encode()) == w.whole(t), repr(t)
        assert a.encode(" " + t) == a.whole(" " + t), repr(t)
        if "▁" not in t:  # such a text has no tokens in the alignment
            assert b.encode(t) == b.whole(t), repr(t)


def _token_rows(docs):
    tk = _library(op11_token_files.default_vocabulary())
    out, start = [], 0
    ids = {t: tk.encode(t or "", add_special_tokens=False).ids + [1] for _, t in docs}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        out.append((i, start, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())))
        start += len(ids[t])
    return out


def test_token_files_equal_the_library(spark, documents):
    got = [tuple(r) for r in op11_token_files.op11_token_files(spark, SF_SMALL).collect()]
    assert sorted(got, key=_key) == _token_rows(_pairs(documents))


def test_token_files_of_odd_rows(spark, odd, tmp_dir):
    index = op11_token_files.write_tokens(odd, f"file:{tmp_dir}/t", op11_token_files.default_vocabulary())
    got = [tuple(r) for r in op11_token_files.read_tokens(index, keep_ids=True).collect()]
    want = _token_rows(_pairs(odd))
    # ids that repeat are ordered among themselves by a hash: starts follow from the counts
    assert Counter((g[0], g[2], g[3]) for g in got) == Counter((w[0], w[2], w[3]) for w in want)
    got.sort(key=lambda g: (g[1], g[2]))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == np.cumsum([0, *[g[2] for g in got]]).tolist()[:-1]
    assert all(zlib.crc32(np.array(g[4], "<u4").tobytes()) == g[3] and len(g[4]) == g[2] for g in got)
    # the format: flat numbers, offsets one more than documents
    for r in index.collect():
        path = r["path"].removeprefix("file:")
        offsets = np.fromfile(path + ".off", "<i8")
        assert offsets[0] == 0 and len(offsets) == r["n_docs"] + 1 and offsets[-1] == r["n_tokens"]
        assert len(np.fromfile(path + ".ids", "<u2")) == r["n_tokens"] and len(np.fromfile(path + ".doc", "<i8")) == r["n_docs"]
    assert len(glob.glob(f"{tmp_dir}/t/data/*.ids")) == index.count()


def test_an_id_of_many_rows_spreads_over_parts(spark, tmp_dir):
    docs = spark.range(3000).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit("one text").alias("text"))
    index = op11_token_files.write_tokens(docs.repartition(8), f"file:{tmp_dir}/t", op11_token_files.default_vocabulary())
    assert index.count() > 3 and index.agg(F.max("n_docs")).first()[0] < 1500
    got = op11_token_files.read_tokens(index).collect()
    n = got[0]["n_tokens"]
    assert sorted(r["start"] for r in got) == list(range(0, 3000 * n, n))


def test_token_files_of_an_empty_table(spark, empty, tmp_dir):
    index = op11_token_files.write_tokens(empty, f"file:{tmp_dir}/t", op11_token_files.default_vocabulary())
    assert op11_token_files.read_tokens(index).collect() == []


def test_the_narrow_pattern_splits_alike():
    import public_tokenizers
    import regex
    assert public_tokenizers.PATTERN == memo.BYTE_PATTERN
    wide, rng = regex.compile(memo.BYTE_PATTERN), random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice(" \n\t'stLl1½ é!\x1c\x85\xa0ªµ×÷ßÿ²,\xad") if rng.random() < 0.7 else chr(rng.randrange(256))
                       for _ in range(rng.randint(0, 12)))
        assert memo.ByteBpe.SPLIT.findall(text) == wide.findall(text), repr(text)


# ---- op12 -----------------------------------------------------------------------------------------------------------
def test_gallop_is_a_search():
    rng = np.random.default_rng(0)
    for n, m, top in ((0, 5, 9), (5, 0, 9), (1, 1, 2), (40, 1000, 5000), (700, 800, 900), (3, 5000, 10 ** 6)):
        a, b = (np.unique(rng.integers(0, top, k)) for k in (n, m))
        assert (op12_alignment.gallop(a, b) == np.searchsorted(b, a)).all()
        x, y = op12_alignment.common_places(a, b)
        assert a[x].tolist() == b[y].tolist() == np.intersect1d(a, b).tolist()


def test_varint_round_trip():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 1 << 40, 5], np.int64)
    assert op12_alignment.from_varint(op12_alignment.varint(values)).tolist() == values.tolist()
    assert op12_alignment.from_varint(op12_alignment.varint(values[:0])).tolist() == []


def _aligned(docs):
    """By sets of ends and nested loops."""
    import sentencepiece
    a_path, b_path = op12_alignment.default_vocabularies()
    pair = op12_alignment.Pair(a_path, b_path)
    ta, tb = _library(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    ta.encode_special_tokens = True
    rows, holds = [], Counter()
    for i, t in docs:
        a = ta.encode(" " + t, add_special_tokens=False).ids if t else []
        b = tb.encode(t) if t else []
        want = (" " + (t or "")).encode()
        if not t or b"".join(pair.a.bytes[x] for x in a) != want or b"".join(pair.b.bytes[x] for x in b) != want:
            rows.append((i, [], [], [], []))
            continue
        ends_a, ends_b = (np.cumsum([len(s.bytes[x]) for x in v]).tolist() for s, v in ((pair.a, a), (pair.b, b)))
        groups, x, y, here = [], 0, 0, set(ends_a) & set(ends_b)
        for end in sorted(here):
            p, q = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
            groups.append((a[x:p], b[y:q]))
            x, y = p, q
        links = [(u, v) for g, h in groups for u in g for v in h]
        holds.update(set(links))
        rows.append((i, a, b, groups, links))
    most = defaultdict(int)
    for (u, _), n in holds.items():
        most[u] = max(most[u], n)
    out = []
    for i, a, b, groups, links in rows:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(holds[x] == most[x[0]] for x in links),
                    sum(holds[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out, holds


def test_alignment_equals_brute_force(spark, documents):
    got = [tuple(r) for r in op12_alignment.op12_token_alignment(spark, SF_SMALL).collect()]
    assert sorted(got) == sorted(_aligned(_pairs(documents))[0])


@pytest.mark.parametrize("bag,large", [(1, 1), (1 << 20, 1 << 12)])
def test_alignment_of_odd_rows(spark, odd, monkeypatch, bag, large):
    monkeypatch.setattr(op12_alignment, "LARGE_GROUP", large)  # in this process; tasks see the usual one
    docs = _pairs(odd)
    want, holds = _aligned(docs)
    done, pairs = op12_alignment.alignment(odd, *op12_alignment.default_vocabularies(), bag_bytes=bag)
    assert sorted(map(tuple, done.collect()), key=_key) == sorted(want, key=_key)
    assert {(r["a_id"], r["b_id"]): r["docs"] for r in pairs.collect()} == dict(holds)
    # the same links by distinct ids of a group
    pair = op12_alignment.Pair(*op12_alignment.default_vocabularies())
    texts = [(t or "").encode() for _, t in docs]
    some = [x.tolist() for x in op12_alignment.align(pair, texts)["links"]]
    monkeypatch.setattr(op12_alignment, "LARGE_GROUP", 1 << 30)
    assert some == [x.tolist() for x in op12_alignment.align(pair, texts)["links"]]


def test_alignment_of_an_empty_table(spark, empty):
    done, pairs = op12_alignment.alignment(empty, *op12_alignment.default_vocabularies())
    assert done.collect() == [] and pairs.collect() == []


# ---- op13 -----------------------------------------------------------------------------------------------------------
def _word_counts(docs, least=7, deletes=31):
    total = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % deletes == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _groups(words):
    by_rest = defaultdict(set)
    for w in words:
        for k in (w, *(w[:j] + w[j + 1:] for j in range(len(w)))):
            by_rest[k].add(w)
    near = defaultdict(set)
    for some in by_rest.values():
        for a in some:
            near[a] |= {b for b in some if _one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def test_spelling_variants_equal_brute_force(spark, documents):
    got = [tuple(r) for r in op13_spelling.op13_spelling_variants(spark, SF_SMALL).collect()]
    want = _groups(_word_counts(_pairs(documents)))
    assert len(want) > 500 and sum(x[1] is not None for x in want) > 5
    assert sorted(got, key=str) == sorted(want, key=str)


def test_words_of_odd_rows(spark, odd):
    got = {r["word"]: r["n"] for r in op13_spelling.count_words(odd).collect()}
    assert got == _word_counts(_pairs(odd))


def test_no_words(spark, empty):
    words = op13_spelling.count_words(empty)
    assert words.collect() == [] and op13_spelling.variant_groups(words).collect() == []


def _random_words(rng, n, letters, short, long):
    out = set()
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(short, long)))
        out.add(w)
        for _ in range(rng.randint(0, 3)):  # words near it
            k = rng.randrange(len(w) + 1)
            out.add(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]]))
    return {w: int(10 ** rng.uniform(0, 4)) for w in out if w}


@pytest.mark.parametrize("letters,short,long,index", [
    ("ab", 7, 12, {}), ("ab", 1, 9, {}), ("abc", 7, 9, {"hot_list": 1}), ("abc", 1, 6, {"hot_list": 3, "least_frequent": 1}),
    ("abcdeéœ\U0001f600", 7, 40, {"least_frequent": 2, "share": 1e-3}), ("aab", 5, 30, {"least": 3, "most": 4}),
    ("abcdefgh", 7, 8, {"least_frequent": 1, "share": 0.0, "hot_list": 5})])
def test_near_words_equal_brute_force(spark, letters, short, long, index):
    words = _random_words(random.Random(letters + str(short)), 600, letters, short, long)
    table = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    got = [tuple(r) for r in op13_spelling.variant_groups(table, **index).collect()]
    assert sorted(got, key=str) == sorted(_groups(words), key=str)


def test_colliding_hashes_are_told_apart(monkeypatch):
    import pyarrow as pa
    words = {"abcdefg": 50, "abcdefx": 3, "zzzzzzz": 9, "zzzzzzy": 90, "abcdefgh": 1}
    table = pa.table({"list": [7] * 5, "word": list(words), "n": list(words.values()), "lo": [0] * 5,
                      "hi": [len(w) - 1 for w in words], "itself": [True] * 5}, schema=pa.schema([
                          ("list", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()),
                          ("itself", pa.bool_())]))
    plain = op13_spelling._near(table).to_pylist()
    init = op13_spelling.Variants.__init__

    def collide(self, *args):
        init(self, *args)
        self.hash = self.hash & np.uint64(0)
    monkeypatch.setattr(op13_spelling.Variants, "__init__", collide)
    assert op13_spelling._near(table).to_pylist() == plain
